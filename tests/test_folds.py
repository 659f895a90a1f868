"""Balanced folds of whole groups against the greedy rule over single groups."""

import random

import numpy as np
import pytest

from tidemark.operators import split


def spread(folds, k):
    """Mean over labels of the deviation of their shares over folds."""
    sums = np.zeros((k, 2))
    for fold, n, p in folds:
        sums[fold] += (n - p, p)
    return (sums / np.maximum(sums.sum(0), 1e-300)).std(0).mean()


def greedy(groups, k, seed):
    """One group after the other, those with the most uneven labels first, to the fold that keeps shares most even."""
    groups = list(groups)
    random.Random(seed).shuffle(groups)
    groups.sort(key=lambda g: -np.std([g[0] - g[1], g[1]]))
    total = np.maximum(np.sum([[n - p, p] for n, p in groups], axis=0), 1e-300)
    sums, out = np.zeros((k, 2)), []
    for n, p in groups:
        tried = [np.where((np.arange(k) == f)[:, None], sums + [n - p, p], sums) for f in range(k)]
        best = min(range(k), key=lambda f: (round((tried[f] / total).std(0).mean(), 12), sums[f].sum()))
        sums[best] += (n - p, p)
        out.append((best, n, p))
    return out


@pytest.mark.parametrize("kind", ["like", "rare", "long tail", "few"])
def test_as_even_as_the_greedy_rule(spark, kind):
    rng = random.Random(kind)
    sizes = {"like": lambda: rng.randint(3, 12), "rare": lambda: rng.randint(1, 30), "long tail": lambda: int(rng.paretovariate(0.9)) % 3000 + 1, "few": lambda: rng.randint(1, 9)}[kind]
    share = 0.03 if kind == "rare" else 0.4
    groups = []
    for _ in range(9 if kind == "few" else 250):
        n, r = sizes(), min(1.0, rng.random() * 2 * share)
        groups.append((n, sum(rng.random() < r for _ in range(n))))
    data = [(g, int(i < p)) for g, (n, p) in enumerate(groups) for i in range(n)]
    k, repeats = 5, 4
    got = split.balanced_group_kfold(spark.createDataFrame(data, "g int, y int"), "y", "g", k, repeats).collect()
    assert len(got) == repeats * len(groups) and all((r.n, r.positives) == groups[r.g] for r in got)
    mine = [spread([(r.fold, r.n, r.positives) for r in got if r.repeat == x], k) for x in range(repeats)]
    twin = [spread(greedy(groups, k, s), k) for s in range(repeats)]
    assert np.mean(mine) <= 1.1 * np.mean(twin) + 2e-3, (mine, twin)
    if kind != "few":
        assert len({tuple(sorted((r.g, r.fold) for r in got if r.repeat == x)) for x in range(repeats)}) == repeats


def test_kinds_stay_few(spark):
    big = spark.range(3000).selectExpr("id as g", "cast(pow(1.004, id) as bigint) as n")
    kinds = big.select(split._kind("n").alias("a")).distinct().count()
    assert kinds <= split.EXACT_SIZE + split.FINE * 18


def test_null_groups_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), (1, None), (2, 1)], "g int, y int")
    got = split.balanced_group_kfold(df, "y", "g", 2).collect()
    assert sorted((r.g or 0, r.n, r.positives) for r in got) == [(0, 2, 1), (1, 1, 0), (2, 1, 1)] and all(r.fold in (0, 1) for r in got)
    assert split.balanced_group_kfold(df.where("false"), "y", "g", 2).count() == 0


def test_subsample_keeps_shares(spark):
    rng = random.Random(1)
    data = [(g, int(rng.random() < 0.3)) for g in range(200) for _ in range(rng.randint(1, 20))]
    df = spark.createDataFrame(data, "g int, y int")
    some = split.balanced_group_subsample(df, "y", "g", len(data) // 4, len(data)).collect()
    whole = {g: sum(1 for x in data if x[0] == g) for g, _ in data}
    assert all(whole[g] == sum(1 for r in some if r.g == g) for g in {r.g for r in some})
    assert abs(len(some) / len(data) - 0.25) < 0.03 and abs(np.mean([r.y for r in some]) - np.mean([y for _, y in data])) < 0.02
