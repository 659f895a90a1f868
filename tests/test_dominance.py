"""Fronts in any number of columns against brute force."""

import random

import pytest

from tidemark.operators import board


def brute(rows):
    good = [r for r in rows if all(v is not None and v == v for v in r[1:])]
    worse = lambda a, b: all(y >= x for x, y in zip(a[1:], b[1:])) and a[1:] != b[1:]
    return sorted(r[0] for r in good if not any(worse(r, o) for o in good))


@pytest.mark.parametrize("columns", [1, 2, 3, 5])
@pytest.mark.parametrize("kind", ["even", "skewed", "ties", "opposed"])
@pytest.mark.parametrize("cells", [9, board.CELLS])
def test_front(spark, columns, kind, cells):
    rng = random.Random(columns)
    rows = []
    for i in range(400):
        v = [rng.random() for _ in range(columns)]
        if kind == "skewed":
            v = [x**20 * 1e6 if k else x for k, x in enumerate(v)]
        if kind == "ties":
            v = [float(int(4 * x)) for x in v]
        if kind == "opposed" and columns > 1:
            v[-1] = 1 - sum(v[:-1]) / (columns - 1)
        rows.append((i, *v))
    rows += [(1000, *[None] * columns), (1001, *[float("nan")] * columns), (1002, *rows[3][1:])]
    names = [f"m{k}" for k in range(columns)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    assert sorted(r.id for r in board.pareto_front(df, *names, cells=cells).collect()) == brute(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "id int, a double, b double")
    assert board.pareto_front(df, "a", "b").count() == 0 and board.pareto_front(df.where("false"), "a", "b").count() == 0
