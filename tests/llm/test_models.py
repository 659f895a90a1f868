"""Images, encodings, neighbours, classifiers and the pipeline."""

import hashlib
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_words import prose
from pyspark.sql import functions as F

from tidemark.llm import catalog, graphann, jpeg, pieces, quality, tokens

SF = "/root/testdata/sf0.001"

# JPEG


def test_jpeg_round_trip():
    rng = np.random.default_rng(0)
    payloads = [bytes(rng.integers(0, 256, 64 * n, dtype=np.uint8)) for n in (1, 2, 7, 64)] + [b"\0" * 64, b"\x80" * 640, b"\xff" * 128, b"\x80" * 63 + b"a", b"a" + b"\x80" * 63]
    stored = jpeg.encode_payloads(payloads)
    images = [jpeg.parse(m) for m in stored]
    for p, image, blocks in zip(payloads, images, jpeg.decode_scan(stored, images)):
        assert jpeg.payload_of(image, blocks) == p
        grid = jpeg.thumbnail(image, blocks)
        assert (8 * grid.shape[1], 8 * grid.shape[0]) == (image.width, image.height)
        assert grid.ravel()[: len(p) // 64].tobytes() == p[::64]


def write_jpeg(blocks_by_component, sampling, width, height, restart=0):
    """A plain baseline writer: one scan, DC differences, Annex-style bits put one by one."""
    tables = jpeg.code_lengths()
    codes = {k: jpeg.canonical(v)[2] for k, v in tables.items()}
    out = b"\xff\xd8\xff\xdb" + struct.pack(">H", 67) + bytes([0] + [4] * 64)
    n = len(sampling)
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * n, 8, height, width, n) + b"".join(bytes([i + 1, x << 4 | y, 0]) for i, (x, y) in enumerate(sampling))
    for k, name in enumerate(("dc", "ac")):
        counts, symbols, _ = jpeg.canonical(tables[name])
        out += b"\xff\xc4" + struct.pack(">H", 19 + len(symbols)) + bytes([k << 4]) + bytes(counts) + bytes(symbols)
    if restart:
        out += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * n, n) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0])

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    def number(v, size):
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    queues = [list(b) for b in blocks_by_component]
    units = len(queues[0]) // (sampling[0][0] * sampling[0][1])
    bits, last, marker = "", [0] * n, 0
    for u in range(units):
        if restart and u and u % restart == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + marker % 8])
            bits, last, marker = "", [0] * n, marker + 1
        for c, (x, y) in enumerate(sampling):
            for _ in range(x * y):
                block = queues[c].pop(0)
                d, last[c] = int(block[0]) - last[c], int(block[0])
                size = abs(d).bit_length()
                code, length = codes["dc"][size]
                bits += format(code, f"0{length}b") + number(d, size)
                run = 0
                for v in map(int, block[1:]):
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        code, length = codes["ac"][0xF0]
                        bits, run = bits + format(code, f"0{length}b"), run - 16
                    size = abs(v).bit_length()
                    code, length = codes["ac"][run * 16 + size]
                    bits, run = bits + format(code, f"0{length}b") + number(v, size), 0
                if run:
                    code, length = codes["ac"][0]
                    bits += format(code, f"0{length}b")
    return out + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_jpeg_in_colour_with_and_without_restarts(restart):
    rng = np.random.default_rng(restart)
    sampling, across, down = [(2, 2), (1, 1), (1, 1)], 3, 2
    made = []
    for x, y in sampling:
        b = rng.integers(-200, 200, (across * down * x * y, 64)) * (rng.random((across * down * x * y, 64)) < 0.2)
        made.append(b)
    media = write_jpeg(made, sampling, 16 * across, 16 * down, restart)
    image = jpeg.parse(media)
    blocks = jpeg.decode_scan([media], [image])[0]
    schedule = np.tile(image.schedule(), across * down)
    for c in range(3):
        assert (blocks[schedule == c] == made[c]).all()
    grid = jpeg.thumbnail(image, blocks)
    assert grid.shape == (4, 6)
    dc = np.clip(np.rint(made[0][:, 0] * 4 / 8) + 128, 0, 255).reshape(down, across, 2, 2).transpose(0, 2, 1, 3).reshape(4, 6)
    assert (grid == dc).all()


def test_jpeg_refuses_what_is_not_baseline():
    with pytest.raises(ValueError):
        jpeg.parse(b"GIF89a")
    good = jpeg.encode_payloads([b"a" * 64])[0]
    with pytest.raises(ValueError):
        jpeg.parse(good.replace(b"\xff\xc0", b"\xff\xc2"))


# SentencePiece


def unigram_processor(path):
    """The library's own unigram engine over the same pieces and scores."""
    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    found = pieces.read_pieces(path)
    scores, out, k = pieces.zipf_scores(found), b"", 0
    with open(path, "rb") as f:
        for number, value in pieces._fields(f.read()):
            if number == 1:
                piece, _, kind = found[k]
                out += field(1, field(1, piece.encode()) + varint(2 << 3 | 5) + struct.pack("<f", scores[k]) + varint(3 << 3) + varint(kind))
                k += 1
            elif number == 2:
                out += field(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1))
            else:
                out += field(number, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out), scores


def test_encoding_is_the_librarys_best_path(spark):
    path = tokens.default_path("piece_bpe_32k.model")
    library, scores = unigram_processor(path)
    inv = pieces.inventory(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["", " ", "  two  spaces ", "日本語テキスト no", "a" * 60, "\n\n x\ty", "a▁b"]
    value = lambda ids: sum(scores[i] if i > 258 else inv.unknown for i in ids)
    same = 0
    for t, theirs in zip(texts, library.encode(texts)):
        mine = list(inv.encode(pieces.normalized(t)))
        same += mine == theirs
        if "▁" in t:  # spelled in bytes here
            assert inv.decode(mine)[1:] == t.encode()
            continue
        assert value(mine) == pytest.approx(value(theirs), abs=1e-2)  # ties may be broken otherwise
        assert inv.decode(mine)[1:] == t.encode()
    assert same > 0.95 * len(texts)


@pytest.mark.parametrize("giant,chunk,group", [(600, 50, 512), (200, 17, 3), (1500, 700, 2)])
def test_chunks_give_the_whole_texts_ids(spark, awkward, giant, chunk, group):
    path = tokens.default_path("piece_bpe_32k.model")
    inv, rng = pieces.inventory(path), random.Random(4)
    extra = ["ababab" * 700, "日本語" * 900, prose(rng, 3000), " " * 3000, "=" * 2500, "." * 3333, "-=" * 900, "a▁b ▁ " * 400, "=" * 300 + " " + "." * 451 + "  " + "-" * 399]
    extra += ["".join(rng.choice(a) for _ in range(rng.randint(600, 1600))) for a in ("=.", "=-_*", "a=", " =", "the ", "0123456789", "é日= ")]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    encoded = pieces.encode_documents(docs, giant=giant, chunk=chunk, group=group, decode=True)
    got = pieces.decode_documents(encoded.withColumnRenamed("decoded", "at_once")).collect()
    want = Counter((r.doc_id, inv.encode(pieces.normalized(r.text or "")).tobytes()) for r in docs.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert all(bytes(r.decoded) == bytes(r.at_once) == bytes(r.text or b"") for r in got)
    assert max(r.n_chunks for r in got) > 5 * group or group > 100


def brute_ids(inv, text):
    """All segmentations of a short text: the highest score, then the longer pieces from the end."""
    if not text:
        return 0.0, ()
    found = []
    for start in range(len(text)):
        for to, s in inv.edges(text, start):
            if to == len(text):
                r = brute_ids(inv, text[:start])
                found.append((r[0] + s, (to - start, *r[1])))
    return max(found)


def test_ties_go_to_the_longer_piece_from_the_end():
    inv, rng = pieces.inventory(tokens.default_path("piece_bpe_32k.model")), random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("=.-a") for _ in range(rng.randint(1, 9)))
        _, lengths = brute_ids(inv, text)
        ids, at = [], 0
        for n in lengths[::-1]:
            ids += inv.solve(text[at : at + n]).tolist()
            at += n
        assert inv.solve(text).tolist() == ids


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(1)
    for _ in range(50):  # few values, so many ties; each column ranks its entries
        a, b, c = ((np.where(rng.random((5, 5)) < 0.7, rng.integers(0, 3, (5, 5)).astype(float), -np.inf), rng.random((5, 5)).argsort(0)) for _ in range(3))
        x, y = pieces.max_plus(pieces.max_plus(a, b), c), pieces.max_plus(a, pieces.max_plus(b, c))
        live = np.isfinite(x[0])
        assert (x[0] == y[0]).all() and (x[1][live] == y[1][live]).all()


def test_encoding_of_nothing(nothing):
    assert pieces.encode_documents(nothing).count() == 0


# neighbours


def exact(x, ids, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        out[ids[q]] = [(ids[j], d[j]) for j in np.lexsort((ids, d))[:k]]
    return out


def test_recall(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 24)) * 3
    x = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 24))
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = graphann.search(graphann.build_index(df, shard_rows=500), graphann.usable(df).where("vec_id % 50 = 0")).collect()
    want = exact(x, ids, range(0, 1500, 50))
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
        assert r.score == pytest.approx(float(np.sqrt(((x[r.vec_id] - x[r.query_id]) ** 2).sum())), abs=1e-12)
    assert all(len(v) == 10 and v == sorted(v, key=lambda p: (p[1], p[0])) for v in by.values())
    assert sum(len({a for a, _ in by[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, float("nan")]), (5, [1.0, float("inf")]), (6, [1.0, None]), (7, [2.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (200, []), (7, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, shard string")
    got = graphann.search(graphann.build_index(df), graphann.usable(df).where("vec_id % 100 = 0")).collect()
    by = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    assert by[0] == [(1, 0.0), (100, 0.0), (7, 1.0), (7, 1.0)] and by[100] == [(0, 0.0), (1, 0.0), (7, 1.0), (7, 1.0)]
    assert {r.query_id for r in got} == {0, 100}
    none = df.where("false")
    assert graphann.search(graphann.build_index(none), graphann.usable(none)).count() == 0


def test_repeated_queries_and_rows(spark):
    """Against brute force: each distinct query once, each repeated row of another id a neighbour."""
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (70, 3)).astype(float)
    x[(x == 0).all(1), 0] = 1
    data = [(int(i), x[i].tolist()) for i in range(70)] + [(100, [1.0, 2.0, 2.0])] * 3 + [(100, [2.0, 1.0, -1.0])] + [(7, x[7].tolist())] * 4 + [(500, [0.5, 0.5, 0.5])] * 40
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = graphann.search(graphann.build_index(df, shard_rows=30), graphann.usable(df).where("vec_id % 50 = 0"), block=2)
    want = Counter()
    for q, v in {(i, tuple(v)) for i, v in data if i % 50 == 0}:
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in data if j != q)[:10]
        want.update((q, r + 1, j, d) for r, (d, j) in enumerate(near))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == want


# quality


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from pyspark.sql import functions as F

    seen = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2)) == 0
    got = {r.doc_id: r.keep for r in quality.classify(big[0], big[1].where(seen)).select("doc_id", "keep").collect()}
    held = big[1].where(~seen).collect()
    assert sum(got[r.doc_id] == (r.quality == 1) for r in held) >= 0.95 * len(held)
    assert docs.count() == quality.classify(docs, labels.where("quality = 1")).where("keep").count()  # one class only: nothing to learn


def test_quality_of_awkward_documents(spark, awkward, nothing):
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(18, 0, 0), (14, 0, 0), (13, 0, 0), (2, 0, 1), (None, 1, 0), (100, None, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(awkward, labels)
    assert got.count() == awkward.count() and set(awkward.columns) <= set(got.columns)
    assert all(0 <= r.score <= 1 for r in got.select("score").collect())
    assert quality.classify(nothing, labels).count() == 0
    unlabelled = quality.classify(awkward, labels.where("false")).select("score", "keep").collect()
    assert all(r.keep and r.score == 1 for r in unlabelled)


def newton_logistic(x, y, w, reg):
    """Weights and bias of a logistic fit with a ridge on scaled columns."""
    total = w.sum()
    mean = (w[:, None] * x).sum(0) / total
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (total - (w**2).sum() / total))
    live = sd > 0
    z = np.column_stack((x[:, live] / sd[live], np.ones(len(x))))
    beta, ridge = np.zeros(z.shape[1]), np.append(np.full(live.sum(), reg), 0)
    loss = lambda b: (w * np.logaddexp(0, -(2 * y - 1) * (z @ b))).sum() / total + (ridge * b * b).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / total + np.diag(ridge + 1e-12), z.T @ (w * (y - p)) / total - ridge * beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(step).max() < 1e-9:
            break
    weights = np.zeros(x.shape[1])
    weights[live] = beta[:-1] / sd[live]
    return weights, beta[-1]


def test_cotraining_against_a_twin_in_numpy(spark, monkeypatch):
    """The same rounds worked out on arrays; both views teach, and together they do no worse than either alone."""
    monkeypatch.setattr(quality, "STEPS", 400)
    monkeypatch.setattr(quality, "TOLERANCE", 1e-10)
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    unseen = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~unseen))
    got = {r.doc_id: r for r in quality.scored_by(docs, model).select("doc_id", "text_score", "meta_score", "score").collect()}
    assert {t[1] for t in model.taught} == {"text", "meta"} and {t[2] for t in model.taught if t[1] == "text"} == {0, 1}

    given = {r.doc_id: r.quality for r in labels.where(~unseen).collect()}
    f = quality.featured(docs).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).toPandas()
    x = [quality._matrix(f[f"{v}_x"]) for v in quality.VIEWS]
    y = np.array([given.get(i, -1) for i in f["doc_id"]], float)
    held, learnt, pool = f["held"].to_numpy() & (y >= 0), ~f["held"].to_numpy() & (y >= 0), y < 0
    reg, views, taught = max(1e-4, 0.5 / (y >= 0).sum()), [], []
    for k in range(quality.ROUNDS):
        new, lessons = [], [[], []]
        for t in range(2) if views else ():
            said = views[t].logit(x[t])
            ranked = np.sort(said[pool])
            lo, hi = ranked[int(np.ceil(quality.CONFIDENT * len(ranked))) - 1], ranked[int(np.ceil((1 - quality.CONFIDENT) * len(ranked))) - 1]
            for c, pick in ((1, said >= hi), (0, said <= lo)):
                right = (y == c)[pick & held]
                together = quality.PSEUDO_WEIGHT * (y[learnt] == c).sum() * max(0.0, 2 * (right.sum() + 1) / (len(right) + 2) - 1)
                if lo < hi and together:
                    rows = np.flatnonzero(pick & pool)
                    lessons[1 - t].append((rows, c, together / len(rows)))
                    taught.append((k, quality.VIEWS[t], c, len(rows), together))
        for t in range(2):
            rows = np.concatenate((np.flatnonzero(learnt), *(r for r, _, _ in lessons[t])))
            ys = np.concatenate((y[learnt], *(np.full(len(r), c) for r, c, _ in lessons[t])))
            w = np.concatenate((np.ones(learnt.sum()), *(np.full(len(r), v) for r, _, v in lessons[t])))
            view = quality.View(*newton_logistic(x[t][rows], ys, w, reg))
            view.a, view.b = quality._calibrate((x[t][held] @ view.weights + view.bias)[:, None], y[held])
            new.append(view)
        views = new
    logits = np.column_stack([v.logit(m) for v, m in zip(views, x)])
    mix = quality._calibrate(logits[held], y[held])
    want = quality._sigmoid(logits @ mix[:2] + mix[2])
    assert [t[:3] for t in taught] == [t[:3] for t in model.taught]
    assert np.abs(want - np.array([got[i].score for i in f["doc_id"]])).max() < 0.02

    test = [(r.quality, got[r.doc_id]) for r in labels.where(unseen).collect()]
    right = lambda c: sum((getattr(g, c) >= 0.5) == (q == 1) for q, g in test) / len(test)
    assert right("score") >= max(right("text_score"), right("meta_score")) - 0.01 and right("score") > 0.95


def test_a_view_of_no_use_leaves_the_others_calibration_alone():
    """A column that would get a weight below 0 is left out and the others and the bias are fitted without it."""
    rng = np.random.default_rng(5)
    y = (rng.random(2000) < 0.85).astype(float)
    telling = 2 * y - 1 + rng.normal(0, 0.7, 2000)
    contrary = 1.75 - 0.01 * y + rng.normal(0, 0.01, 2000)
    alone = quality._calibrate(telling[:, None], y)
    both = quality._calibrate(np.column_stack((telling, contrary)), y)
    assert both[1] == 0 and np.allclose(both[[0, 2]], alone)
    assert np.array_equal(quality._calibrate(np.column_stack((contrary, telling)), y), both[[1, 0, 2]])
    for useless in (contrary, np.full(2000, 1.7), 1.7 + 1e-16 * rng.normal(size=2000), 1e6 * (1 + 1e-15 * rng.normal(size=2000))):
        nothing = quality._calibrate(useless[:, None], y)
        assert nothing[0] == 0 and abs(quality._sigmoid(nothing[1]) - y.mean()) < 0.01


def test_columns_named_like_the_classifiers_own_stay(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 9, "mine", "too")], "doc_id long, text string, lang string, source string, n_chars long, _quality string, _quality_ string")
    r = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (r["_quality"], r["_quality_"], r.score, r.keep) == ("mine", "too", 1.0, True)


# pipeline


def test_pipeline(spark):
    """The stages one by one against brute force on what each was given."""
    import corpus_pipeline as cp
    from test_texts import brute_groups, brute_repeats

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = {n: f for n, f in cp.STAGES}
    good = stage["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)
    good_rows = [(r.doc_id, r.text) for r in good.collect()]
    unique = stage["n-gram Jaccard join"](spark, spark.createDataFrame(good.collect(), docs.schema), SF)
    want = {i for i, _, c in brute_groups(good_rows) if i == c}
    rows = unique.collect()
    assert unique.columns == docs.columns and {r.doc_id for r in rows} == want
    cut = stage["substring dedup"](spark, spark.createDataFrame(rows, docs.schema), SF)
    texts = [(r.doc_id, r.text) for r in rows]
    expect = {i: (n, g) for i, n, g, _ in brute_repeats(texts, lambda k: (texts[k][0], k))}
    out = cut.collect()
    assert cut.columns == docs.columns and {r.doc_id for r in out} == {i for i, (n, g) in expect.items() if n == 0 or g < n}
    assert all(len((r.text or "").encode().split()) == expect[r.doc_id][0] - expect[r.doc_id][1] for r in out)
    packed = stage["packing"](spark, spark.createDataFrame(out, docs.schema), SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in out}
    encode = tokens.encoder(tokens.default_path())
    assert sum(r.length for r in packed) == sum(len(encode(r.text or "")) + 1 for r in out)


def test_pipeline_on_awkward_documents(spark, awkward, nothing):
    import corpus_pipeline as cp

    for docs in (awkward, nothing):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
        docs.count()


def test_one_of_near_copies_with_null_and_repeated_ids(spark):
    """Rows against brute force; lang tells them apart."""
    import corpus_pipeline as cp
    from test_texts import brute_groups

    rng = random.Random(6)
    base, other, alone = prose(rng, 150), prose(rng, 100), prose(rng, 80)
    near = lambda t, k: " ".join("edited" if j == k else w for j, w in enumerate(t.split()))
    texts = [(None, alone), *[(None, near(base, 7 * k)) for k in range(8)], (9, near(base, 80)), (9, base), (4, near(other, 50)), (4, other), (4, prose(rng, 90)), (4, near(base, 99)), (3, near(other, 9)), (3, near(other, 9)), (None, alone), (None, None), (None, None), (5, " \t\n\x0b\x0c\r\n"), (5, " \t\n\x0b\x0c\r\n"), (5, ""), (6, None), (6, None), (2, "\x1c"), (2, "one\n"), (1, "\u00a0")]
    rows = [(i, t, f"r{k}", "s", k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    groups = [g for _, _, g in brute_groups([(k, t) for k, (_, t) in enumerate(texts)])]  # by row
    words = [n for _, n, _ in brute_groups([(k, t) for k, (_, t) in enumerate(texts)])]
    keep = {}
    for k, (i, t) in enumerate(texts):
        group = ("words", groups[k]) if words[k] else ("none", k) if i is None else ("none", i, t)
        keep[group] = min(keep.get(group, (True, 0, len(texts))), (i is None, i or 0, k))
    got = cp.keep_one_of_near_copies(spark, docs, SF)
    assert got.columns == cp.COLUMNS and sorted(int(r.lang[1:]) for r in got.collect()) == sorted(k for _, _, k in keep.values())


@pytest.mark.parametrize("kind", ["scan", "frame", "doubled"])
def test_cut_repeats_with_null_and_repeated_ids(spark, tmp_path, kind):
    """Rows against brute force; lang tells them apart."""
    import corpus_pipeline as cp
    from test_texts import brute_repeats

    rng = random.Random(5)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    texts = [(9, a), (9, a), (8, b), (8, prose(rng, 10) + " " + b + " tail of it"), (None, c), (None, c + " and more"), (None, prose(rng, 30)), (None, None), (None, d), (7, ""), (3, d + " end"), (3, None)]
    rows = [(i, t, f"r{k}", "s", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    if kind != "frame":
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    if kind == "doubled":  # keeps the scan's metadata columns, but each address occurs twice
        docs = docs.withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1)))).drop("twice")
        rows = [r for r in rows for _ in range(2)]
    want = []
    order = lambda k: (rows[k][0] is not None, rows[k][0] or 0, k)
    for k, (_, n, gone, sha) in zip(sorted(range(len(rows)), key=order), brute_repeats([r[:2] for r in rows], order)):
        if gone < n or not gone:
            want.append((rows[k][0], rows[k][2], gone, sha if gone else rows[k][1]))
    got = cp.cut_repeats(spark, docs, SF).collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    before = {r[2]: r[1] for r in rows}
    sha = lambda r: hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest()
    lost = lambda r: len((before[r.lang] or "").split()) - len((r.text or "").split())
    assert sorted(((r.doc_id, r.lang, lost(r), sha(r) if lost(r) else r.text) for r in got), key=repr) == sorted(want, key=repr)


def test_queries_run(spark):
    for name in ("op1_media_columns", "op6_sentencepiece_scan", "op7_graph_neighbours", "op8_cotrained_quality"):
        df = catalog.QUERIES[name](spark, SF)
        assert df.count() > 0
    assert catalog.QUERIES["op6_sentencepiece_scan"](spark, SF).where("not round_trip").count() == 0
