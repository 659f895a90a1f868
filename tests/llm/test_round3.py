"""Spelling variants, sorted-list top-k and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, contexttree, graphann, jaccard, pieces, prefixtrie, repeats, sharding, spelling, textarrays, toplists


def tally(rows):
    return Counter(map(tuple, rows))


# spelling variants


def words_of(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = words_of(rows)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeéüßxyz") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    rows = [(None, "Wörterbuch wörterbuch WÖRTERBUCH ×÷×÷×÷× ×÷×÷×÷×"), (1, None), (2, ""), (3, "1234567 abc_defghij")]
    for i in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(base[: 1 + int(40 * rng.random() ** 3)])
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "é" + w[k + 1 :], w.upper(), w.title()])
            words.append(w)
        rows.append((i % 250, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    rows += rows[10:12]
    rows += [(900 + i, " ".join(["chainword" + "abcd"[: i % 4]] * [3, 31, 320, 3300][i % 4])) for i in range(4)]  # forms of forms
    return rows


@pytest.mark.parametrize("pairs", [0, 3, spelling.PAIRS])
def test_variants(spark, misspelt, monkeypatch, pairs):
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    docs = spark.createDataFrame([(i, t, "x") for i, t in misspelt], "doc_id long, text string, word string")
    want = brute_variants(misspelt)
    assert tally(spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()) == tally(want)
    assert any(f and r != f for _, f, r, *_ in want) and any(m > 2 for *_, m, _ in want)


def test_variants_of_awkward_documents(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert tally(spelling.variants(awkward).collect()) == tally(brute_variants(rows))
    assert spelling.variants(nothing).count() == 0


def test_words_are_counted_in_parts(spark, misspelt, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD", 5)
    docs = spark.createDataFrame(misspelt, "doc_id long, text string").repartition(3)
    assert dict(map(tuple, spelling.vocabulary(docs).collect())) == words_of(misspelt)


def test_reduced_neighbours_meet_and_hot_classes_make_no_pairs(spark):
    """Words one edit apart have reduced words of which one is in the other's neighbourhood."""
    rng = random.Random(5)
    every = spelling.letters()
    pairs = []
    for _ in range(200):
        a = "".join(rng.choice(every) for _ in range(rng.randint(7, 10)))
        k, kind = rng.randrange(len(a)), rng.randrange(3)
        pairs.append((a, [a[:k] + a[k + 1 :], a[:k] + rng.choice(every) + a[k:], a[:k] + rng.choice(every) + a[k + 1 :]][kind]))
    df = spark.createDataFrame(pairs, "a string, b string").select(spelling.reduced(F.col("a")).alias("x"), spelling.reduced(F.col("b")).alias("y"))
    df = df.select("x", "y", spelling.one_edit("x").alias("nx"), spelling.one_edit("y").alias("ny"))
    assert df.where(~(F.array_contains("nx", F.col("y")) | F.array_contains("ny", F.col("x")))).count() == 0
    same = [c for c in every if spelling.symbol(c) == spelling.symbol("a")]
    hot = sorted({"".join(rng.choice(same) for _ in range(9)) for _ in range(3000)})  # one class of them all
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in hot], "word string")).collect()
    left = defaultdict(set)
    for w in hot:
        for i in range(9):
            left[i, w[:i] + w[i + 1 :]].add(w)
    assert {tuple(r) for r in got} == {(a, b) for s in left.values() for a in s for b in s if a < b} and len(got) == len({tuple(r) for r in got})


# top-k from sorted lists


def brute_rows(q, x, k):
    s = q.astype(object) @ x.T.astype(object)
    return [(i, int(j), max(-(1 << 63), min((1 << 63) - 1, int(s[i, j])))) for i in range(len(q)) for j in sorted(range(len(x)), key=lambda j: (-max(-(1 << 63), min((1 << 63) - 1, int(s[i, j]))), j))[:k]]


@pytest.mark.parametrize("n,m,width,k", [(10, 3, 4, 5), (3, 2, 2, 5), (1500, 40, 16, 6), (900, 30, 64, 6), (700, 20, 1, 3), (5, 2, 0, 3)])
@pytest.mark.parametrize("kind", ["even", "ties", "clusters", "stretched", "huge"])
def test_top_rows(n, m, width, k, kind):
    rng = np.random.default_rng(n + width)
    x = rng.normal(size=(n, width))
    if kind == "ties":
        x = np.round(x)
    if kind == "clusters":
        x = x[rng.integers(0, min(5, n), n)] + 0.01 * rng.normal(size=(n, width))
    if kind == "stretched" and width:
        x[:, 0] *= 100
    x = np.floor(x * (2.0**40 if kind == "huge" else 256)).astype(np.int64)
    q = x[rng.integers(0, n, m)]
    if kind == "huge" and n > 100:
        x, q = x[:100], q[:5]
    best = toplists.top_rows(q, x, k)
    assert list(zip(best.query.tolist(), best.row.tolist(), best.score.tolist())) == brute_rows(q, x, k)


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(7)
    x, q = np.floor(256 * rng.normal(size=(200, 12))), np.floor(256 * rng.normal(size=(9, 12)))
    lists, signed = toplists.Lists(x), np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
    before = None
    for depth in (1, 20, 100, 199, 200):
        upper, lower = (signed @ b.T for b in lists.read(depth))
        assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()
        assert before is None or ((upper <= before[0]).all() and (lower >= before[1]).all())
        before = upper, lower
    assert (upper == lower).all()


def test_lists_are_not_read_to_the_end():
    """Skewed lists close most rows before they are resolved."""
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(size=(4000, 32)) * np.exp(rng.normal(size=(4000, 1)))).astype(np.int64)
    resolved = []
    plain = toplists._resolve
    toplists._resolve = lambda q, x, i, j, exact: resolved.append(len(i)) or plain(q, x, i, j, exact)
    try:
        toplists.top_rows(x[:50], x, 6)
    finally:
        toplists._resolve = plain
    assert sum(resolved) < 0.1 * 50 * 4000


def test_top_k_of_awkward_vectors(spark):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    same = vec()
    rows = [(i, vec()) for i in range(120)] + [(50, vec()), (150, same), (None, same), (None, vec())] + [(200 + i, same) for i in range(30)]
    rows += [(300, None), (350, []), (351, []), (400, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (450, [float("nan")] * 6), (500, [float("inf")] + [0.0] * 5), (550, [1.0, 2.0]), (600, [0.0] * 6), (650, [-0.004] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2, "z") for i, v in rows], "vec_id long, embedding array<double>, label int, rank int, uid string").repartition(3)
    sound = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for a, (i, v) in enumerate(sound):
        if i is None or i % 50:
            continue
        others = [(sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(sound) if b != a and len(w) == len(v)]
        others.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0))
        want += [(i, r + 1, j, s) for r, (s, j) in enumerate(others[:5])]
    for sizes in ({}, {"shard": 40, "block": 2}):
        assert tally(toplists.top_k(df, **sizes).select("query_id", "rank", "vec_id", "score").collect()) == tally(want)
    assert toplists.top_k(df.where("false")).count() == 0


# prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[p] if len(made[c]) == len(p)))).encode()).hexdigest()
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items()]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(6)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice([None, "", "ja", "nein 日本", "x" * 40]))
    rows = []
    for c in [*range(-5, 40), *range(200, 230), *range(305, 310), 7_000_000_001]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([None, t, t, t]), *say()))
    rows += [(0, t, "user", f"turn {t % 7}") for t in range(3, 900)]
    rows += [(100, t, "user", "a") for t in range(2)] + [(c, t, "user", "a") for c in range(101, 160) for t in range(7)]  # copies
    rows += [(None, 1, "user", "nobody"), (5, 2, "user", "again"), (5, 2, "user", "again")]
    return rows


def test_trie(spark, talks):
    df = spark.createDataFrame([(*r, 1, 2) for r in talks], "conv_id long, turn long, role string, text string, depth int, digest int").repartition(5)
    want = tally(brute_trie(talks))
    assert tally(prefixtrie.trie(df).select(*COLUMNS).collect()) == want
    assert tally(prefixtrie.trie(df, cells=1).select(*COLUMNS).collect()) == want  # a crowded sketch only sends more
    assert prefixtrie.trie(df.where("false")).count() == 0


def test_strides_and_collisions(spark, talks, monkeypatch):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(prefixtrie, "STRIDE", 3)
    plain, seeds = prefixtrie._lanes, []

    def weak(seed):
        seeds.append(seed)
        return [F.pmod(c, F.lit(4 if seed == 0 else 1 << 62)) for c in plain(seed)]

    monkeypatch.setattr(prefixtrie, "_lanes", weak)
    assert tally(prefixtrie.trie(df).select(*COLUMNS).collect()) == tally(brute_trie(talks))
    assert seeds == [0, 1]  # different sequences under one digest were noticed


def test_sketch_proves_singletons_only(spark):
    rows = [(c, d, hash((c if c % 3 else 0, d)) % 1000003, 0) for c in range(60) for d in range(1, 5)]
    df = spark.createDataFrame(rows, "conv_id long, depth long, p1 long, p2 long").repartition(3)
    from tidemark.llm.common import materialize

    for cells in (1, 8):
        alone = {r.conv_id: r.alone for r in prefixtrie.first_alone(materialize(df, "t"), cells).collect()}
        counts = Counter((d, p) for _, d, p, _ in rows)
        assert all(counts[d, p] == 1 for c, d, p, _ in rows if alone.get(c) == d)
        assert cells == 1 or len(alone) >= 35


# nearest neighbours on vectors that aren't even


def uneven(kind, n, d=16):
    rng = np.random.default_rng(2)
    if kind == "elongated":
        return rng.normal(size=(n, d)) * np.exp(-np.arange(d) / 4)
    if kind == "copies":
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n)]
        x[:, :3] += 1e-6 * rng.normal(size=(n, 3))
        return x
    return rng.normal(size=(int(kind), d))[rng.integers(0, int(kind), n)] + 0.01 * rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["40", "200", "elongated", "copies"])
@pytest.mark.parametrize("shard_rows", [2000, 500])
def test_recall_on_uneven_vectors(spark, kind, shard_rows):
    x = uneven(kind, 2000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = graphann.search(graphann.build_index(df, shard_rows=shard_rows), graphann.usable(df).where("vec_id % 20 = 0")).collect()
    hits = 0
    for i in range(0, 2000, 20):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        mine = [r for r in got if r.query_id == i]
        assert len(mine) == 10 and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        hits += sum(r.score <= np.partition(d, 9)[9] + 1e-15 for r in mine)
    assert hits >= 0.9 * 1000


def test_every_node_is_reached():
    x = uneven("40", 1500)
    edges, entries = graphann.build_graph(x)
    assert graphann.reached(edges, entries).all()
    cut = np.full((300, 4), -1)  # no edges at all: one entry must lead to all others
    assert graphann.reached(graphann.reconnect(x[:300], cut, np.array([0]), 8, 16), np.array([0])).all()


# rows that repeat addresses, ties, heavy texts, colliding words


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [16, 1024, 4096])
def test_no_family_of_words_shares_hashes(spark, n):
    a, b = thue_morse(n)
    data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    h, _ = textarrays.hash_words(data, np.array([0, len(data)]))
    assert h[0] == h[2] != h[1]
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, a), (4, b), (5, f"{a} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 20}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs.where("doc_id in (3, 4)")).collect()} == {3: 3, 4: 4}
    words = [a, b] * 8
    sequences = [np.frombuffer(" ".join(words[k] for k in order).encode(), np.uint8) for order in ([0, 1, 1, 0] * 5, [1, 0, 0, 1] * 5)]
    one, two = (textarrays.windows(*textarrays.hash_words(s, np.array([0, len(s)])), 20)[0] for s in sequences)
    assert one[0] != two[0]


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_window_hashes_are_those_of_their_words(monkeypatch, block):
    monkeypatch.setattr(textarrays, "BLOCK", block)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(40)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    hashes, counts = textarrays.hash_words(data, offsets)
    for n in (1, 2, 5, 10, 20, 33):
        got, starts = textarrays.windows(hashes, counts, n)
        want = [tuple(t.split()[k : k + n]) for t in texts for k in range(len(t.split()) - n + 1)]
        firsts = [int(o) + k for o, t in zip(np.cumsum(counts) - counts, texts) for k in range(len(t.split()) - n + 1)]
        assert starts.tolist() == firsts and len(got) == len(want) and len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_joined_frames_repeat_no_addresses(spark, tmp_path, awkward):
    awkward.select("doc_id", "text").where("doc_id >= 100").coalesce(1).write.parquet(f"{tmp_path}/d")
    twice = spark.read.parquet(f"{tmp_path}/d").join(spark.createDataFrame([(1,), (2,), (3,)], "n int"))
    rows = common.Chunks(twice).rows
    assert rows.count() == rows.select("chunk", "row").distinct().count() == 180
    long = spark.createDataFrame([(1, "long words again " * 5000)], "doc_id long, text string")
    long.write.parquet(f"{tmp_path}/l")
    many = spark.read.parquet(f"{tmp_path}/l").join(spark.createDataFrame([(1,), (2,)], "n int"))
    one = pieces.encode_documents(long, giant=1000, chunk=700).first()
    assert one.n_chunks > 64 and one.ids == pieces.encode_documents(long, giant=10**9).first().ids
    assert [r.ids for r in pieces.encode_documents(many, giant=1000, chunk=700).collect()] == [one.ids] * 2
    assert sorted(r.n_removed for r in repeats.remove_repeats(many.withColumn("doc_id", F.col("n").cast("long"))).collect()) == [14997, 15000]


def test_a_heavy_text_leaves_other_chunks_alone(spark, tmp_path, monkeypatch):
    rows = [(i, "x" * (3_000_000 if i == 5000 else 100)) for i in range(9000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/h")
    docs = spark.read.parquet(f"{tmp_path}/h")
    for most in (1 << 20, 0):  # cuts broadcast, and joined by a shuffle
        monkeypatch.setattr(common, "MOST_CUTS", most)
        chunks = common.Chunks(docs, most_bytes=1_000_000)
        n = dict(map(tuple, chunks.rows.groupBy("chunk").count().collect()))
        heavy = chunks.rows.where("doc_id = 5000").first().chunk
        assert n[heavy] == 1 and sorted(n.values()) == sorted([1, 5000 - 4096, 6144 - 5001, 2048, 2048, 2048, 9000 - 8192])
        assert chunks.addressed("doc_id", prefix="_").join(chunks.rows.select(F.col("chunk").alias("_chunk"), F.col("row").alias("_row"), F.col("doc_id").alias("d")), ["_chunk", "_row"]).where("doc_id = d").count() == 9000


def test_ties_are_divided_into_ranges(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    placed = sharding.shard_documents(docs)
    assert placed.select("global_row").distinct().count() == 20_000 and {r["count"] for r in placed.groupBy("shard").count().collect()} == {1250}
    tied = docs.where("doc_id is null").select(F.xxhash64(F.monotonically_increasing_id()).alias("_tie"), "doc_id")
    sizes = [r["count"] for r in tied.repartitionByRange(8, "doc_id", "_tie").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3000


# co-training where the views know different things


def test_three_rounds_beat_one(spark):
    """Sources tell the class and are all labelled; words are too many to be, but pages with a source teach them."""
    from tidemark.llm import quality

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        y = i % 2
        words = [f"{'good' if y else 'bad'}{rng.randrange(80)}" for _ in range(2)] + [f"filler{rng.randrange(200)}" for _ in range(58)]
        rng.shuffle(words)
        source = None if i >= 200 and rng.random() < 0.3 else f"{'g' if y else 'b'}{rng.randrange(6)}"
        rows.append((i, " ".join(words), "en", source, 300))
        if i < 200:
            labels.append((i, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    right = {}
    for rounds in (1, 3):
        model = quality.train(docs, labels, rounds=rounds)
        unseen = quality.scored_by(docs, model).where("doc_id >= 200")
        good = F.col("doc_id") % 2 == 1
        hit = lambda c: F.avg(((F.col(c) >= 0.5) == good).cast("int"))
        right[rounds] = unseen.agg(hit("text_score"), hit("score")).first()[:] + unseen.where("source is null").agg(hit("score")).first()[:]
    assert all(b > a for a, b in zip(right[1], right[3])) and right[3][0] > right[1][0] + 0.05 and right[3][2] > right[1][2] + 0.02, right


# rollups that are compacted again and again


def test_compaction_forgets_what_it_covers(spark, tmp_path):
    from tidemark.llm.rollups import SCHEMA, Rollup

    r = Rollup(spark, str(tmp_path / "r"))
    row = lambda n: spark.createDataFrame([("s", "en", "words", 1, n)], SCHEMA)
    total = lambda: [tuple(t) for t in r.totals().collect()]
    for k in range(6):
        assert r.commit(f"b{k}", row(10**k)) and r.compact()
        assert total() == [("s", "en", "words", k + 1, int("1" * (k + 1)))]
        assert len(r._names("commits")) <= 2 and not r.commit("b0", row(7)) and not r.commit(f"b{k}", row(7))
    assert total() == [("s", "en", "words", 6, 111111)] and r.committed("b0") and not r.committed("b9")
    stored = [s.getPath().getName() for s in r._fs.listStatus(r._at("data"))]
    assert sum(not n.startswith("base-") for n in stored) <= 2


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_nra_top_k", "op13_prefix_trie"])
def test_queries_match_sql(spark, sf_dir, name):
    from compare import assert_same

    from tidemark.llm import catalog

    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)
