"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept; its decisions take effect. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Chunks, materialize, read_table
from tidemark.llm.jaccard import jaccard_groups
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import classify
from tidemark.llm.repeats import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of one Arrow batch, at most. Whole texts are long: Spark's 10,000 of them take much of a small executor's memory.
BATCH_ROWS = 1024


def _lean(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, also for what is read from the stage's result later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text, lang, source or n_chars is judged like any other value; repeated rows share one
    verdict; without labels of both classes every document stays; no documents give none.
    """
    _lean(spark)
    return classify(docs, read_table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity one row stays: the smallest doc_id's, nulls last.

    Among equal doc_ids the row's address decides. Rows without words are in no group: those without a
    doc_id stay, others as one for each doc_id and text.
    """
    _lean(spark)
    chunks = Chunks(docs, columns=tuple(COLUMNS))
    docs = chunks.docs
    grouped = jaccard_groups(chunks).where("label is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk", "row")).alias("m")
    chosen = grouped.groupBy("label").agg(first).select(F.col("m.chunk").alias("_chunk"), F.col("m.row").alias("_row"))
    rows = chunks.addressed(*COLUMNS, prefix="_").join(chosen, ["_chunk", "_row"], "left_semi")
    wordless = docs.where(F.coalesce(F.col("text").rlike(r"^[\x20\x09-\x0D]*\z"), F.lit(True)))
    named = wordless.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return rows.select(*COLUMNS).unionByName(named).unionByName(wordless.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that repeat earlier text are cut out; documents left without words go.

    Texts that lose nothing stay as they are; n_chars follows the text. Rows are told apart by their
    address, so null and repeated doc_ids don't mix. Of equal windows the one with the smallest (doc_id, start)
    stays, a null doc_id being smallest and equal ones in the order of their rows. Null and empty texts
    stay as they are; no documents give none.
    """
    _lean(spark)
    chunks = Chunks(docs, columns=tuple(COLUMNS))
    changed = remove_repeats(chunks).where("n_removed > 0").select(F.col("chunk").alias("_chunk"), F.col("row").alias("_row"), F.col("kept_text").alias("_kept"))
    joined = chunks.addressed(*COLUMNS, prefix="_").join(materialize(changed, "changed"), ["_chunk", "_row"], "left")
    text = F.coalesce("_kept", "text")
    rows = joined.withColumn("text", text).withColumn("n_chars", F.when(F.col("_kept").isNotNull(), F.length("_kept").cast("long")).otherwise(F.col("n_chars")))
    return rows.where("_kept is null or _kept != ''").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 2048 tokens.

    A null or empty text is one piece with the end id; repeated rows are packed as often as they occur, a
    null doc_id stays null; no documents give no pieces.
    """
    _lean(spark)
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]
#: SQL can't express the trained classifier and the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each one's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
