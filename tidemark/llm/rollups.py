"""Token-count rollups maintained by signed deltas, with batches that commit once."""

from __future__ import annotations

import uuid

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read_table, shared_dir
from tidemark.llm.tokens import default_path, encoder

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


class Rollup:
    """Totals by source, language and tokenizer version as a folder of committed deltas.

    A batch's changes are summed to one signed row a key before anything is stored, so a commit's size
    follows the number of keys. Every attempt writes its delta to a folder of its own under data/; a batch is
    committed by publishing one small file, commits/<id>, that names the folder, which only one attempt
    can do. So a batch that is delivered again, two writers of one batch and a job that is run again change
    nothing; what a lost attempt leaves is never read. compact() sums what is committed to a base, published
    alike as bases/<n>; totals are the newest base and the deltas it doesn't cover.

    The publishing needs a file system whose rename is atomic and refuses an existing target (HDFS and
    its like), or a local one, where a hard link is as good.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._root = self._fs.makeQualified(self._root)

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _names(self, folder: str) -> list[str]:
        p = self._at(folder)
        return sorted(s.getPath().getName() for s in (self._fs.listStatus(p) if self._fs.exists(p) else []) if not s.getPath().getName().startswith((".", "_")))

    def _read(self, name: str) -> str:
        jvm, stream = self.spark.sparkContext._jvm, self._fs.open(self._at(name))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, name: str, text: str) -> bool:
        """Make a file appear whole under a name that nothing has; False if something had it."""
        sc = self.spark.sparkContext
        aside, target = self._at(f"_aside/{uuid.uuid4().hex}"), self._at(name)
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        try:
            if self._fs.getScheme() == "file":
                file = lambda p: sc._jvm.java.io.File(p.toUri().getPath()).toPath()
                sc._jvm.java.nio.file.Files.createLink(file(target), file(aside))
            else:
                option = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
                plain = sc._gateway.new_array(option, 1)
                plain[0] = option.NONE
                sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), sc._jsc.hadoopConfiguration()).rename(aside, target, plain)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(aside, False)

    def _stored(self, batch_id: str, changes: DataFrame) -> str:
        """The batch's delta in a folder of this attempt's own."""
        delta = changes.groupBy(*KEYS).agg(F.sum("documents").cast("long").alias("documents"), F.sum("tokens").cast("long").alias("tokens"))
        folder = f"data/{batch_id}-{uuid.uuid4().hex}"
        delta.where("documents != 0 or tokens != 0").write.parquet(self._at(folder).toString())
        return folder

    def committed(self, batch_id: str) -> bool:
        return bool(self._fs.exists(self._at(f"commits/{batch_id}"))) or batch_id in self._covered(self._base(), [batch_id])

    def _covered(self, base: str | None, ids: list[str]) -> set[str]:
        """Those of some batches that a base covers."""
        if not base or not ids:
            return set()
        asked = self.spark.createDataFrame([(i,) for i in ids], "batch_id string")
        return {r[0] for r in self.spark.read.parquet(self._at(f"{base}/covered").toString()).join(F.broadcast(asked), "batch_id", "left_semi").collect()}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes (KEYS, documents, tokens: signed). False: it was there before, or another writer was first."""
        if not batch_id or batch_id[0] in "._" or not all(c.isalnum() or c in "-_." for c in batch_id):
            raise ValueError("a batch id has letters, digits, '-', '_' and '.' only, and starts with a letter or digit")
        if self.committed(batch_id):
            return False
        folder = self._stored(batch_id, changes)
        first = self._publish(f"commits/{batch_id}", folder)
        if not first:
            self._fs.delete(self._at(folder), True)
        return first

    def _base(self) -> str | None:
        found = self._names("bases")
        return self._read(f"bases/{found[-1]}") if found else None

    def _parts(self) -> tuple[DataFrame, list[str]]:
        """Signed rows that add up to the totals, and the ids of the batches in them that no base covers."""
        base, ids = self._base(), self._names("commits")
        folders = []
        if base:
            seen = self._covered(base, ids)
            ids = [i for i in ids if i not in seen]
            folders.append(f"{base}/totals")
        folders += [self._read(f"commits/{i}") for i in ids]
        paths = [self._at(f).toString() for f in folders]
        return (self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)), ids

    def compact(self) -> bool:
        """Sum up all that is committed, so that readers open one folder instead of many. False: another writer was first.

        What the base before covered is deleted, commits and deltas, so there are never more of them than
        two compactions leave; a reader may be one compaction behind. The ids stay known: a batch that is
        delivered again later still changes nothing.
        """
        n, before = len(self._names("bases")), self._base()
        parts, ids = self._parts()
        covered = self.spark.createDataFrame([(i,) for i in ids], "batch_id string")
        if n:
            covered = covered.unionByName(self.spark.read.parquet(self._at(f"{self._base()}/covered").toString()))
        folder = f"data/base-{uuid.uuid4().hex}"
        self._sums(parts).write.parquet(self._at(f"{folder}/totals").toString())
        covered.write.parquet(self._at(f"{folder}/covered").toString())
        if not self._publish(f"bases/{n:012d}", folder):
            return False
        for i in self._covered(before, self._names("commits")):
            self._fs.delete(self._at(self._read(f"commits/{i}")), True)
            self._fs.delete(self._at(f"commits/{i}"), False)
        return True

    def _sums(self, rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").cast("long").alias("documents"), F.sum("tokens").cast("long").alias("tokens"))
        return sums.where("documents != 0 or tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens; keys whose totals are both 0 are left out. Nothing committed: no rows."""
        return self._sums(self._parts()[0])


def changes_between(before: DataFrame | None, after: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Signed changes from one state of counted documents to the next.

    States: id_col, KEYS, tokens. A row only in `after` is an insert (+), only in `before` a delete (-); one
    in both with any difference is taken out under its old key and count and put in under the new.
    """
    plus = after.select(id_col, *KEYS, F.lit(1).alias("documents"), "tokens")
    if before is None:
        return plus.drop(id_col)
    minus = before.select(id_col, *KEYS, F.lit(-1).alias("documents"), (-F.col("tokens")).alias("tokens"))
    both = plus.unionByName(minus)
    net = both.groupBy(id_col, *KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return net.where("documents != 0 or tokens != 0").drop(id_col)


def counted(docs: DataFrame, tokenizer: str | None = None, version: str = "byte_bpe_50k") -> DataFrame:
    """Every document's word count (tokenizer `words`) and its number of ids under the given vocabulary file.

    row_id tells rows apart that share a doc_id. A null text has no words and no ids; null source and lang
    are keys of their own.
    """
    path = tokenizer or default_path()

    @F.pandas_udf("long")
    def n_ids(texts: pd.Series) -> pd.Series:
        encode = encoder(path)
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", "lang", words.alias("words"), n_ids("text").alias(version), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    return materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "counted")


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: load under word counts, recount under the vocabulary, delete exact copies.

    The second batch is delivered twice, then both are summed up to a base. The totals are those of the documents left, by the newest tokenizer.
    """
    rows = counted(read_table(spark, sf_dir, "documents"))
    first = rows.select("row_id", "source", "lang", F.lit("words").alias("tokenizer"), F.col("words").alias("tokens"))
    second = rows.select("row_id", "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"), F.col("byte_bpe_50k").alias("tokens"))
    lowest = rows.groupBy("text_md5").agg(F.min(F.struct(F.col("doc_id"), F.col("row_id"))).alias("kept")).select("text_md5", F.col("kept.row_id").alias("kept_row"))
    left = rows.join(lowest, rows["row_id"] == lowest["kept_row"], "left_semi").select("row_id", "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"), F.col("byte_bpe_50k").alias("tokens"))
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", changes_between(None, first))
    rollup.commit("recount", changes_between(first, second))
    rollup.commit("recount", changes_between(first, second))
    rollup.compact()
    rollup.commit("copies", changes_between(second, left))
    by_source = Window.partitionBy("source")
    return rollup.totals().withColumn("source_share", F.round(F.col("tokens") / F.sum("tokens").over(by_source), 9))
