"""All queries of the library and their SQL."""

from tidemark.plans import cohort, matrix, signals, stored

QUERIES = {**signals.QUERIES, **cohort.QUERIES, **matrix.QUERIES, **stored.QUERIES}
ORACLES = {**signals.ORACLES, **cohort.ORACLES, **matrix.ORACLES, **stored.ORACLES}
