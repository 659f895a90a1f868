"""Spelling variants: words one edit apart, found by generation over a reduced alphabet."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read_table

#: Code points of a word, at least.
LEAST = 7
#: Occurrences of a word, at least.
OFTEN = 2
#: A form has so many times the word's occurrences, at least.
RATIO = 10
#: One in so many (document, run) pairs loses a letter.
SLIP = 31
#: Symbols of the reduced alphabet.
SYMBOLS = "abcdefgh"
#: Pairs of words that two classes of reduced words may make; those of larger classes meet by what is left of them without a letter.
PAIRS = 4096
#: Distinct words that a task counts before it sends them on.
_HELD = 100_000


def letters() -> str:
    """What a word is made of: a-z, and U+00C0 to U+00FF."""
    return "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))


def symbol(letter: str) -> str:
    """A letter's symbol: a hash that doesn't follow the alphabet."""
    return SYMBOLS[(ord(letter) * 0x9E3779B1 % (1 << 32)) * len(SYMBOLS) >> 32]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text, lower-cased, with slips, counted within the batch."""
    run_of = re.compile(f"[{letters()}]{{{LEAST},}}")
    lower = {c: c + 32 for c in range(65, 91)}

    def emit(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        held: Counter = Counter()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            start = crc32((b"" if doc_id is None else str(doc_id).encode()) + b":")
            for m in run_of.finditer((text.as_py() or "").translate(lower)):
                run = m[0]
                h = crc32(run.encode(), start)
                if h % SLIP == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
                    if len(run) < LEAST:
                        continue
                held[run] += 1
                if len(held) >= _HELD:
                    yield emit(held)
                    held = Counter()
        yield emit(held)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: distinct runs of letters after slips, with their occurrences; rare and short ones go."""
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_runs, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def reduced(word: Column) -> Column:
    every = letters()
    return F.translate(word, every, "".join(map(symbol, every)))


def one_edit(code: str) -> Column:
    """A reduced word's neighbourhood of one edit, so that of any two neighbours one has the other in it: the word
    itself, all deletions, and all replacements by a symbol of higher rank (insertions are the other word's deletions)."""
    places = f"sequence(1, char_length({code}))"
    deleted = f"transform({places}, i -> concat(left({code}, i - 1), substring({code}, i + 1)))"
    symbols = "array(" + ", ".join(f"'{s}'" for s in SYMBOLS) + ")"
    replaced = f"flatten(transform({places}, i -> transform(filter({symbols}, s -> s > substring({code}, i, 1)), s -> concat(left({code}, i - 1), s, substring({code}, i + 1)))))"
    return F.expr(f"array_distinct(concat(array({code}), {deleted}, {replaced}))")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: pairs of words of which one becomes the other by one inserted, deleted or replaced code point, each pair once.

    words: one row a word. 1. Letters become symbols, words of one reduced word make a class, and each
    class finds those classes that lie in its neighbourhood of one edit: two words one edit apart have
    reduced words at most one edit apart. 2. Words of two such classes are compared as they are. Where
    two classes would make more than PAIRS pairs, their words meet instead by (place, what is left
    without the letter there), which only words one edit apart share.
    """
    coded = words.select("word", reduced(F.col("word")).alias("code"))
    classes = materialize(coded.groupBy("code").agg(F.count("*").alias("size")), "classes")
    around = classes.select(F.col("code").alias("a_code"), F.col("size").alias("a_size"), F.explode(one_edit("code")).alias("b_code"))
    met = around.join(classes.select(F.col("code").alias("b_code"), F.col("size").alias("b_size")), "b_code")
    met = materialize(met.where("a_code != b_code or a_size > 1").select("a_code", "b_code", (F.col("a_size") * F.col("b_size") > PAIRS).alias("large")), "met")
    few = met.where("not large").select("a_code", "b_code")
    pairs = few.join(coded.select(F.col("word").alias("a"), F.col("code").alias("a_code")), "a_code").join(coded.select(F.col("word").alias("b"), F.col("code").alias("b_code")), "b_code")
    close = pairs.where("a_code != b_code or a < b").where(F.levenshtein("a", "b", 1) == 1).select("a", "b")
    crowded = met.where("large").select(F.explode(F.array("a_code", "b_code")).alias("code")).distinct()
    those = coded.join(crowded, "code", "left_semi").select("word")
    left = those.select("word", F.expr("explode(transform(sequence(1, char_length(word)), i -> struct(i as place, concat(left(word, i - 1), substring(word, i + 1)) as rest)))").alias("e")).select("word", "e.*")
    one, other = left.select(F.col("word").alias("a"), "place", "rest"), left.select(F.col("word").alias("b"), "place", "rest")
    swapped = one.join(other, ["place", "rest"]).where("a < b").select("a", "b")
    shortened = left.select(F.col("word").alias("a"), F.col("rest").alias("b")).join(those.select(F.col("word").alias("b")), "b").select("a", "b")
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered(close).unionByName(ordered(swapped).unionByName(ordered(shortened))).distinct()


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root of (word, form): the last word that forms lead to, by links that double in each step; form null: the end."""
    links = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(steps):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return links


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of documents (doc_id, text).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that has RATIO
    times the word's n at least, else null; form_n is the form's n; root is where forms lead in the end,
    the word itself if it has none. Null and empty texts have no words, a null doc_id counts as empty
    text in the slip, repeated rows count again; an empty table gives an empty result. Texts are read
    run by run, so a long one takes no more than its own memory. Other columns are not read.
    """
    words = materialize(vocabulary(docs), "words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("word"), F.col("b").alias("near"))
    known = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("top"))
    told = words.join(best, "word", "left").withColumn("_is", -F.col("top.less") >= RATIO * F.col("n"))
    forms = materialize(told.select("word", F.when(F.col("_is"), F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_is"), -F.col("top.less")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(0, math.ceil(math.log2(max(1, math.ceil(math.log(most, RATIO))))))  # n grows RATIO times along each link
    return forms.join(roots(forms, steps), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


OP11_SQL = """
with recursive tab as (
  select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))) as tab
), runs as (
  select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]{7,}')) as run from documents
), told as (
  select run, k, hex(encode(d || ':' || run)) as x from (select d, run, count(*) as k from runs group by all)
), hashed as (
  select run, k, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(x) // 2), lambda i: (16 * instr('123456789ABCDEF', substr(x, 2 * i::int + 1, 1)) + instr('123456789ABCDEF', substr(x, 2 * i::int + 2, 1)))::bigint)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) as h from told, tab
), words as (
  select word, sum(k)::bigint as n from (select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from hashed) group by word having length(word) >= 7 and sum(k) >= 2
), cut as (
  select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), near as (
  select a.word, b.word as near from cut a join cut b using (i, rest) where a.word != b.word
  union select c.word, w.word from cut c join words w on w.word = c.rest union select w.word, c.word from cut c join words w on w.word = c.rest
), ranked as (
  select near.word, near, w.n as near_n, count(*) over (partition by near.word) as n_near, row_number() over (partition by near.word order by w.n desc, near) as k from near join words w on w.word = near
), forms as (
  select words.word, case when near_n >= 10 * n then near end as form, n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 10 * n then near_n end as form_n from words left join ranked on ranked.word = words.word and k = 1
), walk(word, reached) as (
  select word, word from forms union all select walk.word, form from walk join forms on forms.word = walk.reached where form is not null
), ends as (
  select walk.word, walk.reached as root from walk join forms on forms.word = walk.reached where form is null
)
select forms.word, form, root, n, n_near, form_n from forms join ends using (word)
"""
