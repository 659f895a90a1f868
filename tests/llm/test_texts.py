"""Operators on texts against brute force, on awkward documents and on the given tables."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import assert_same
from conftest_words import prose

from tidemark.llm import catalog, common, contexttree, jaccard, media, packing, repeats, rollups, sharding, tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def tally(rows):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


def test_all_operators_are_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in catalog.QUERIES} == {str(n) for n in range(1, 14)}


# media


def test_media(awkward):
    def want(i, t):
        p = (t or "").encode()
        padded = p + b"\0" * (-len(p) % 64 if p else 64)
        return i, len(p), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])

    got = media.media_columns(awkward, keep_media=True).collect()
    assert tally((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == tally(want(*p) for p in pairs(awkward))
    for r in got:
        assert len(r.media) == r.media_bytes and hashlib.sha256(r.media).hexdigest() == r.media_sha256 and r.media[:2] == b"\xff\xd8" and r.media[-2:] == b"\xff\xd9"
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256, r.n_bytes].add((r.media_sha256, r.thumbnail_hash))
    assert all(len(v) == 1 for v in by_text.values())


def test_media_of_nothing(nothing):
    assert media.media_columns(nothing).count() == 0


# packing


def test_packing(awkward):
    encode = tokens.encoder(tokens.default_path())
    got = packing.pack_documents(awkward, keep_ids=True).collect()
    rebuilt = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    docs = Counter()
    for i, t in pairs(awkward):
        ids = tuple(encode(t or "") + [1])
        docs[i, ids] += 1
    for r in got:
        rebuilt[r.doc_id, r.doc_tokens, r.start].append(tuple(r.ids))
    want = defaultdict(list)
    for (i, ids), n in docs.items():
        at = 0
        for size in packing.cut(len(ids)):
            want[i, len(ids), at] += [ids[at : at + size]] * n
            at += size
        assert at == len(ids)
    assert {k: sorted(v) for k, v in rebuilt.items()} == {k: sorted(v) for k, v in want.items()}
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(v[-1]) <= 2048
    assert sum(n for v in by.values() for _, n in v) > 0.75 * 2048 * (len(by) - 1)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_ids_are_the_tokenizers(file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path(file))
    encode = tokens.encoder(tokens.default_path(file))
    texts = ["Hello  world\n\n don't 123 ünï 　 x", "<|endoftext|>", "hello <|endoftext|> x", "a<|endoftext|><|endoftext|>  b\n", "<|endoftext|", "<|startoftext|> y", "", "a" * 300, "日本語 テキスト\t\r\n ", "\u0085\u2028 \x1c\x0b zero\0byte ٣٤ ½²"]
    for text in texts:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_token_ids_of_all_given_documents(spark):
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(tokens.default_path()), tokens.encoder(tokens.default_path())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    assert [encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_harmonic_classes():
    for n in range(1, 5000, 7):
        assert sum(packing.cut(n)) == n and all(0 < p <= 2048 for p in packing.cut(n))


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing).count() == 0


# rollups


def test_rollup_is_idempotent(spark, awkward, tmp_path):
    rows = rollups.counted(awkward)
    encode = tokens.encoder(tokens.default_path())
    key = lambda name, c: rows.selectExpr("row_id", "source", "lang", f"'{name}' as tokenizer", f"{c} as tokens")
    first, second = key("words", "words"), key("byte_bpe_50k", "byte_bpe_50k")
    r = rollups.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("a", rollups.changes_between(None, first)) and not r.commit("a", rollups.changes_between(None, first))
    want = defaultdict(lambda: [0, 0])
    docs = awkward.select("text", "lang", "source").collect()
    for d in docs:
        want[d.source, d.lang, "words"][0] += 1
        want[d.source, d.lang, "words"][1] += len(WORD.findall((d.text or "").encode()))
    assert {(x.source, x.lang, x.tokenizer): [x.documents, x.tokens] for x in r.totals().collect()} == want
    assert r.commit("b", rollups.changes_between(first, second)) and not r.commit("b", rollups.changes_between(first, second))
    assert r.commit("c", rollups.changes_between(second, second.where("lang = 'de'")))
    want = defaultdict(lambda: [0, 0])
    for d in docs:
        if d.lang == "de":
            want[d.source, d.lang, "byte_bpe_50k"][0] += 1
            want[d.source, d.lang, "byte_bpe_50k"][1] += len(encode(d.text)) if d.text else 0
    assert {(x.source, x.lang, x.tokenizer): [x.documents, x.tokens] for x in r.totals().collect()} == want
    with pytest.raises(ValueError):
        r.commit("../x", first)


def test_rollup_of_two_writers_lost_attempts_and_compaction(spark, tmp_path):
    row = lambda n, t, source="s": spark.createDataFrame([(source, None, "words", n, t)], "source string, lang string, tokenizer string, documents long, tokens long")
    total = lambda r: {(x.source, x.documents, x.tokens) for x in r.totals().collect()}
    a, b = (rollups.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    assert a.compact() and a.totals().count() == 0
    # both writers are past the check and have stored a delta before either commits
    one, two = a._stored("x", row(1, 10)), b._stored("x", row(1, 99))
    assert total(a) == set()
    assert b._publish("commits/x", two) and not a._publish("commits/x", one)
    assert total(a) == total(b) == {("s", 1, 99)} and not a.commit("x", row(1, 10))
    a._stored("y", row(5, 50))  # an attempt that is lost before it commits
    assert total(a) == {("s", 1, 99)} and a.commit("y", row(2, 1)) and total(b) == {("s", 3, 100)}
    assert b.compact() and not b.commit("y", row(2, 1)) and total(a) == {("s", 3, 100)}
    assert a.commit("z", row(-3, -100)) and a.commit("w", row(0, 0, None)) and total(b) == set()
    assert a.compact() and total(a) == set() and a.commit("v", row(1, 1, None)) and total(a) == {(None, 1, 1)}
    parts, ids = a._parts()
    n = len(a._names("bases"))
    assert a._publish(f"bases/{n:012d}", a._base()) and not b._publish(f"bases/{n:012d}", "data/other") and ids == ["v"]


def test_rollup_query(spark):
    got = catalog.QUERIES["op3_token_rollups"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lowest = {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        lowest.setdefault(d.text, d)
    encode, want = tokens.encoder(tokens.default_path()), Counter()
    for d in lowest.values():
        want[d.source, d.lang] += len(encode(d.text or ""))
    assert {(r.source, r.lang): r.tokens for r in got} == want


# context trees


def brute_scores(rows):
    depth, train = contexttree.DEPTH, []
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            train.append((t or "").encode().translate(AZ))
    count = Counter(w for t in train for w in WORD.findall(t))
    count[None] = len(train)
    n, v = sum(count.values()), sum(c > 0 for c in count.values())
    nodes = defaultdict(lambda: [0, 0])
    for t in train:
        s = b"\0" * depth + t + b"\0"
        for p in range(depth, len(s)):
            for d in range(depth + 1):
                for j in range(8):
                    nodes[s[p - d : p], (1 << j) | (s[p] >> (8 - j))][(s[p] >> (7 - j)) & 1] += 1
    children, memo = defaultdict(list), {}
    for c, q in nodes:
        if c:
            children[c[1:], q].append(c)

    def weigh(c, q):
        if (c, q) not in memo:
            a, b = nodes[c, q]
            kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(c) == depth:
                memo[c, q] = kt, 1.0
            else:
                below = sum(weigh(x, q)[0] for x in children[c, q])
                memo[c, q] = float(np.logaddexp(kt, below)) - math.log(2), 1 / (1 + math.exp(min(700, max(-700, below - kt))))
        return memo[c, q]

    for node in list(nodes):
        weigh(*node)
    out = []
    for i, t in rows:
        low = (t or "").encode().translate(AZ)
        s, score = b"\0" * depth + low + b"\0", 0.0
        for p in range(depth, len(s)):
            for j in range(8):
                q, one, left = (1 << j) | (s[p] >> (8 - j)), 0.0, 1.0
                for d in range(depth + 1):
                    c = s[p - d : p]
                    if (c, q) not in memo:
                        break
                    a, b = nodes[c, q]
                    one += left * memo[c, q][1] * (b + 0.5) / (a + b + 1)
                    left *= 1 - memo[c, q][1]
                one += left / 2
                score += math.log10(one if (s[p] >> (7 - j)) & 1 else 1 - one)
        words = [*WORD.findall(low), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words) if n else None
        out.append((i, zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0, len(words), sum(count[w] > 0 for w in words), n, base, score))
    return out


@pytest.mark.parametrize("askers", [256, 2])
def test_context_tree(awkward, monkeypatch, askers):
    monkeypatch.setattr(contexttree, "ASKERS", askers)
    small = awkward.where("text is null or length(text) < 4000")
    got = sorted(contexttree.score_documents(small, chunk_rows=16).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, round(r.score, 3)))
    want = sorted(brute_scores(pairs(small)), key=lambda r: (r[0] is None, r[0] or 0, round(r[6], 3)))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9) and g.score == pytest.approx(w[6], rel=1e-9)
        assert g.bits_per_byte == pytest.approx(-w[6] / math.log10(2) / max(1, g.n_bytes), rel=1e-9)


def test_context_tree_without_training(spark, nothing):
    assert contexttree.score_documents(nothing).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    only = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    r = contexttree.score_documents(only).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-11 * 8 * math.log10(2))


# repeats


def brute_repeats(rows, order, window=20):
    docs = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    seen, out = set(), []
    for k in sorted(range(len(docs)), key=order):
        words = docs[k][1]
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((docs[k][0], len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_repeats(awkward):
    rows = pairs(awkward)
    got = repeats.remove_repeats(awkward).collect()
    want = brute_repeats(rows, lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    assert tally((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == tally(want)
    words = defaultdict(set)
    for i, t in rows:
        words[i, len(WORD.findall((t or "").encode()))].add(tuple(WORD.findall((t or "").encode())))
    for r in got:
        assert sum(x.end - x.start for x in r.repeats) == r.n_removed and all(x.end - x.start >= 20 for x in r.repeats)
        left = [[w for k, w in enumerate(t) if not any(x.start <= k < x.end for x in r.repeats)] for t in words[r.doc_id, r.n_words]]
        assert r.kept_sha256 in {hashlib.sha256(b" ".join(t)).hexdigest() for t in left}
        if r.kept_text is not None:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and r.n_removed > 0


def test_repeats_over_chunks_and_buckets(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pairs(docs)
    monkeypatch.setattr(repeats, "Chunks", functools.partial(common.Chunks, most=7))
    got = repeats.remove_repeats(docs, bucket_bytes=1 << 15).collect()
    assert tally((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == tally(brute_repeats(rows, lambda k: (rows[k][0], k)))


def test_repeats_of_nothing(nothing):
    assert repeats.remove_repeats(nothing).count() == 0


# chunks


def test_chunks_hold_bounded_bytes(spark, tmp_path):
    rows = [(i, "word " * (20000 if 100 <= i < 120 else 20)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    chunks = common.Chunks(docs, most=256, most_bytes=500_000)
    sizes = [(r.b, r.n) for r in chunks.rows.groupBy("chunk").agg({"*": "count"}).toDF("chunk", "n").join(chunks.rows.selectExpr("chunk", "octet_length(text) as b"), "chunk").groupBy("chunk").agg({"b": "sum", "n": "max"}).toDF("chunk", "b", "n").collect()]
    assert max(b for b, n in sizes if n > 1) <= 500_000 and sum(n for _, n in sizes) == 300 and chunks.size == sum(len(t) for _, t in rows)
    assert len({r.chunk for r in common.Chunks(docs, most=256).rows.collect()}) == 2


def test_columns_of_several_arrow_chunks():
    import pyarrow as pa

    from tidemark.llm.textarrays import column

    data, offsets = column(pa.chunked_array([pa.array([b"ab", None], pa.binary()), pa.array([b"", b"cde"], pa.binary())]))
    assert data.tobytes() == b"abcde" and offsets.tolist() == [0, 2, 2, 2, 5]


def test_texts_over_a_megabyte(spark):
    """Repeats, groups and scores of texts larger than what is hashed at a time, against brute force."""
    import random

    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(170_000))
    rows = [(1, long), (2, long[:700_000] + " changed " + long[700_000:]), (3, prose(rng, 30)), (4, "x" * 1_300_000), (5, long[-4000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > 1 << 20
    got = repeats.remove_repeats(docs).collect()
    assert tally((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == tally(brute_repeats(rows, lambda k: (rows[k][0], k)))
    assert tally((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs).collect()) == tally(brute_groups(rows))
    assert {r.doc_id: r.n_bytes for r in contexttree.score_documents(docs).collect()} == {i: len(t) for i, t in rows}


# Jaccard join


def brute_groups(rows, percent=75):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().translate(AZ))
        sets.append({tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    index = defaultdict(list)
    for k, s in enumerate(sets):
        for t in s:
            index[t].append(k)
    both = Counter((a, b) for v in index.values() for i, a in enumerate(v) for b in v[i + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            label[root(b)] = root(a)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return [(i, len(sets[k]), low.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("hot", [64, 1])
def test_groups(awkward, hot):
    got = jaccard.jaccard_groups(awkward, hot=hot).collect()
    assert tally((r.doc_id, r.n_shingles, r.component_id) for r in got) == tally(brute_groups(pairs(awkward)))


@pytest.mark.parametrize("hot,block", [(64, 1000), (3, 10)])
def test_groups_of_near_copies_and_common_passages(spark, hot, block):
    import random

    rng = random.Random(8)
    passage, rows = prose(rng, 60), []
    for k in range(40):  # a chain: neighbours link, ends don't
        rows.append((len(rows), " ".join(f"w{j}" for j in range(4 * k, 4 * k + 60))))
    base = [f"b{j}" for j in range(80)]
    for k in range(40):  # near copies of one text
        w = list(base)
        w[rng.randrange(80)] = f"edit{k}"
        rows.append((len(rows), " ".join(w)))
    for k in range(60):  # a common passage makes up most of unlike texts
        rows.append((len(rows), passage + " " + " ".join(f"p{k}_{j}" for j in range(rng.randint(5, 60)))))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_groups(docs, hot=hot, block=block, bucket_bytes=1 << 12).collect()
    assert tally((r.doc_id, r.n_shingles, r.component_id) for r in got) == tally(brute_groups(rows))


def test_signatures_find_every_linked_pair():
    """The pigeonhole itself: linked sets share a key, or both are told apart as `rest`."""
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        keep, new = int(rng.integers(int(0.7 * n), n + 1)), int(rng.integers(0, max(1, n // 4) + 1))
        b = np.concatenate((a[:keep], rng.integers(0, 2**63, new).astype(np.uint64)))
        a, b = np.unique(a), np.unique(b)
        if not len(b) or not jaccard.linked(a, b):
            continue
        universe = np.union1d(a, b)
        kind = dict(zip(universe.tolist(), rng.choice([1, 2], len(universe), p=[0.7, 0.3])))
        for t in universe.tolist():
            if (t in a) != (t in b) and rng.random() < 0.5:
                kind[t] = 0
        (x, r1), (y, r2) = (jaccard.signatures(s, np.array([kind[t] for t in s.tolist()], np.uint8)) for s in (a, b))
        if not len(np.intersect1d(x, y)):
            assert r1 and r2
            missed += 1
    assert missed < 400


def test_groups_of_nothing(nothing):
    assert jaccard.jaccard_groups(nothing).count() == 0


# sharding


def test_sharding(awkward):
    got = sharding.shard_documents(awkward).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(awkward))
    assert tally((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
        v = int(sharding.feistel(np.array([r.global_row]), len(got))[0])
        assert (v % 16, v // 16) == (r.shard, r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4096])
def test_feistel_is_a_permutation(n):
    assert sorted(sharding.feistel(np.arange(n), n).tolist()) == list(range(n))
    if n >= 97:
        assert sharding.feistel(np.arange(n), n, seed=1).tolist() != sharding.feistel(np.arange(n), n, seed=2).tolist() != list(range(n))


def test_sharding_of_nothing(nothing):
    assert sharding.shard_documents(nothing).count() == 0
