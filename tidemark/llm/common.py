"""Shared pieces: the cluster's shared folder, written tables, addressable document chunks."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import root

#: Rows of one document chunk, at most; a chunk is what one task holds at a time.
CHUNK_ROWS = 2048
#: Bytes of text that a chunk holds at most, if it holds more than one row.
CHUNK_BYTES = 1 << 26
#: Places where heavy chunks are cut that are broadcast, at most (16 MB); more are joined by a shuffle.
MOST_CUTS = 1 << 20
_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own in what all executors share (see sources.scratch.root). It is deleted when the
    application ends."""
    sc = spark.sparkContext
    path = f"{root(spark)}/tidemark/{sc.applicationId}"
    if path not in _kept:
        _kept.add(path)
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address(rows: int = CHUNK_ROWS, prefix: str = "") -> list[Column]:
    """A scanned row's address: chunk (a run of rows of one file) and row within the file."""
    row = F.col("_metadata.row_index")
    return [F.xxhash64("_metadata.file_path", F.floor(row / F.lit(rows))).alias(f"{prefix}chunk"), row.alias(f"{prefix}row")]


def scanned(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of docs as a plain scan, so that each row has an address of its own and Chunks gives the same one.

    Frames that are no plain scan (also joins and generators, which repeat addresses) are written to the shared folder.
    """
    picked, plan = docs.select(*columns), docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    try:
        picked.select(*address()).schema  # noqa: B018  resolves the columns
        plain = plan.nodeName().startswith("LogicalRelation")
    except AnalysisException:
        plain = False
    return picked if plain else materialize(picked, "documents")


class Chunks:
    """Documents in chunks: rows has doc_id, text as UTF-8 bytes, and a stable address: chunk (a run of rows of one
    file) and row within the file. size: UTF-8 bytes of all texts. count: how many chunks there are, about.

    The address comes from the Parquet reader, so a lost task that is run again finds the same chunks.
    Frames that are no plain scan are written to the shared folder first. A chunk is a run of `most` rows; a
    run whose texts hold more than `most_bytes` is cut into several chunks where its sum of bytes reaches
    that, and a text of more than half of it is a chunk of its own. Other runs stay as they are.
    """

    def __init__(self, docs: DataFrame, most: int = CHUNK_ROWS, most_bytes: int = CHUNK_BYTES, columns: tuple[str, ...] = ("doc_id", "text")):
        self.docs, self.most, half = scanned(docs, list(columns)), most, most_bytes // 2
        file, row = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
        sizes = self.docs.select(file, row, F.floor(F.col("_metadata.row_index") / F.lit(most)).alias("_run"), F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("_bytes"))
        run_bytes = sizes.groupBy("_file", "_run").agg(F.sum("_bytes").alias("_sum"))
        heavy = F.col("_sum") > most_bytes
        total, runs, many = run_bytes.agg(F.sum("_sum"), F.count("*"), F.count_if(heavy)).first()
        self.size, self.count, self.cuts, self.cut_rows = int(total or 0), runs, None, 0
        if many:
            along = Window.partitionBy("_file", "_run").orderBy("_row")
            cell = F.floor((F.sum("_bytes").over(along) - F.col("_bytes")) / half)
            marked = sizes.join(run_bytes.where(heavy), ["_file", "_run"], "left_semi").withColumns({"_cell": cell, "_big": F.col("_bytes") > half})
            new = (F.col("_cell") != F.lag("_cell").over(along)) | F.col("_big") | F.lag("_big").over(along)
            cuts = marked.withColumn("_new", new).where("_new").groupBy("_file", "_run").agg(F.sort_array(F.collect_list("_row")).alias("_cuts"))  # `most` at most
            self.cuts = materialize(cuts, "cuts")
            self.cut_rows = self.cuts.agg(F.sum(F.size("_cuts"))).first()[0] or 0
            self.count += self.cut_rows
        self.rows = self.addressed(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def addressed(self, *columns: Column | str, prefix: str = "") -> DataFrame:
        """Columns of all documents after their chunk and row."""
        chunk, row = f"{prefix}chunk", f"{prefix}row"
        if self.cuts is None:
            return self.docs.select(*address(self.most, prefix), *columns)
        at = F.col("_metadata.row_index")
        rows = self.docs.select(F.xxhash64("_metadata.file_path", F.floor(at / F.lit(self.most))).alias(chunk), at.alias(row), *columns, F.col("_metadata.file_path").alias("_file"), F.floor(at / F.lit(self.most)).alias("_run"))
        few = self.cut_rows <= MOST_CUTS
        joined = rows.join(F.broadcast(self.cuts) if few else self.cuts, ["_file", "_run"], "left")
        place = F.size(F.filter("_cuts", lambda c: c <= F.col(row)))
        out = joined.withColumn(chunk, F.when(F.col("_cuts").isNull() | (place == 0), F.col(chunk)).otherwise(F.xxhash64(chunk, place))).drop("_file", "_run", "_cuts")
        return out if few else out.repartition(chunk).sortWithinPartitions(chunk, row)


def power_of_two(x: float, least: int = 1) -> int:
    """The smallest power of two that is x at least."""
    n = least
    while n < x:
        n *= 2
    return n
