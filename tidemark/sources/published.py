"""Tables that change as a whole: written aside, then published by one new file that readers follow."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PART = "_part_"
#: Folders that one version is written to, at most; partitions are dealt to them by hash.
BUCKETS = 64


def _key(by: list[str]) -> Column:
    """One text for each combination of partition values; nulls are values."""
    return F.to_json(F.struct(*by))


class Published:
    """A table in a folder: data/<attempt>/ holds what writers wrote, manifests/<number> says which of it counts.

    A manifest is created once and never changed: it names, for each of BUCKETS hashes of the partition columns, the
    folders with their rows, and the schema. So files and manifests don't grow with the number of partitions; where one is
    replaced, the others of its bucket are written again. Readers follow the manifest of the highest number, so they see
    a version whole or not at all; what a writer that was killed has left is in no manifest. Of two writers that make the
    same number one wins; the other starts from the winner's manifest.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        at = self._at("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"manifests/{version:012d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> bool:
        """Make the manifest appear whole, unless that version is there already."""
        jvm = self.spark.sparkContext._jvm
        aside, target = self._at(f"aside/{uuid.uuid4().hex}"), self._at(f"manifests/{version:012d}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        try:
            if self._fs.getScheme() == "file":  # a local rename replaces its target, a link refuses to
                local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, aside)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
                refusing = self.spark.sparkContext._gateway.new_array(option, 1)
                refusing[0] = option.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, refusing)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(aside, False)

    def _written(self, df: DataFrame, by: list[str]) -> dict[str, list[str]]:
        """Rows written aside: the folder of each bucket. The partition columns stay in the files, with their types."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = df.withColumn(_PART, F.pmod(F.xxhash64(_key(by)), F.lit(BUCKETS)))
        dealt.repartition(_PART).write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]
        return {n: [f"{folder}/{n}"] for n in names if n.startswith(_PART)}

    def _rows(self, schema: StructType, folders: dict) -> DataFrame:
        paths = [f"{self.path}/{f}" for some in folders.values() for f in ([some] if isinstance(some, str) else some)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _add(self, df: DataFrame, by: list[str], known) -> int:
        found = self._written(df, by)
        while True:
            have = self.versions()
            before = self._manifest(have[-1]) if have else {"schema": None, "folders": {}}
            stay = known(have, before["folders"])
            # what shares a bucket with df's partitions; all of a version with other buckets
            met = {b: f for b, f in stay.items() if b in found or before.get("buckets") != BUCKETS}
            folders = {b: f for b, f in stay.items() if b not in met}
            parts = [found]
            if met:
                replaced = self._rows(df.schema, found).select(_key(by).alias("_key")).distinct()
                others = self._rows(StructType.fromJson(before["schema"]), met).withColumn("_key", _key(by)).join(replaced, "_key", "left_anti")
                parts.append(self._written(others.drop("_key"), by))
            for part in parts:
                folders |= {b: folders.get(b, []) + f for b, f in part.items()}
            version = have[-1] + 1 if have else 0
            if self._publish(version, {"schema": json.loads(df.schema.json()), "buckets": BUCKETS, "folders": folders}):
                return version

    def create(self, df: DataFrame, by: list[str]) -> int:
        """The table's first version; FileExistsError if it has one, also if another writer is first."""

        def refuse(have, folders):
            if have:
                raise FileExistsError(self.path)
            return {}

        refuse(self.versions(), None)
        return self._add(df, by, refuse)

    def replace(self, df: DataFrame, by: list[str], whole: bool = False) -> int:
        """A version in which df's rows stand for all rows of their partitions (whole: for all rows there are)."""
        return self._add(df, by, lambda have, folders: {} if whole else folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The last version, or a given one; FileNotFoundError if there is none."""
        have = self.versions()
        if not have or version is not None and version not in have:
            raise FileNotFoundError(self.path)
        manifest = self._manifest(have[-1] if version is None else version)
        return self._rows(StructType.fromJson(manifest["schema"]), manifest["folders"])
