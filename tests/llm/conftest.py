import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_words import prose  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with every case operators must define: nulls, empty and long texts, ties, repeats, clashing columns."""
    rng = random.Random(11)
    shared = prose(rng, 40)
    base = prose(rng, 150)
    near = base.split()
    near[70] = "edited"
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, "One TWO three"), (None, "a text without an id, of some words in all"), (None, None),
        (7, base), (8, base), (9, " ".join(near)), (9, " ".join(near)), (10, shared + " " + prose(rng, 30)), (11, prose(rng, 25) + "\n" + shared), (12, shared),
        (13, "same " * 300), (14, "x" * 5000), (15, "ä ö ü 日本語   zero\u0000byte " * 3), (16, prose(rng, 12000)), (-5, prose(rng, 60)), (17, prose(rng, 20)), (18, "!!! ### $$$ %%% " * 20),
    ]
    rows += [(100 + i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    data = [(i, t, rng.choice(["de", "en", None]), rng.choice(["s1", "s2", None]), None if t is None else len(t), k, "r", "b", 0.5, True) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, chunk long, `row` string, bucket string, score double, keep boolean")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
