"""Media columns: texts stored as baseline JPEG images, and features read back from the stored bytes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jpeg
from tidemark.llm.common import read_table

#: Payload bytes coded at a time.
PIECE = 1 << 19

_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail_hash string, thumbnail_sha256 string"


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of items of about PIECE bytes in all."""
    a, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= PIECE:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def padded(text: bytes) -> bytes:
    """The text and as many zero bytes as make a positive multiple of 64."""
    return text + b"\0" * (-len(text) % jpeg.BLOCK if text else jpeg.BLOCK)


def store(text: Column) -> Column:
    """The text's bytes as a baseline JPEG, without loss."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        payloads = [padded(bytes(t) if t is not None else b"") for t in texts]
        out: list[bytes] = []
        for a, b in _groups([len(p) for p in payloads]):
            out += jpeg.encode_payloads(payloads[a:b])
        return pd.Series(out)

    return encode(text.cast("binary"))


def read_features(media: Column) -> Column:
    """Decodes stored images; a struct of their payload's digests, their size and their thumbnail's hashes."""

    @F.pandas_udf(_FEATURES)
    def decode(medias: pd.Series) -> pd.DataFrame:
        found, stored = [], [bytes(m) for m in medias]
        for a, b in _groups([len(m) for m in stored]):
            images = [jpeg.parse(m) for m in stored[a:b]]
            for m, image, blocks in zip(stored[a:b], images, jpeg.decode_scan(stored[a:b], images)):
                payload, grid = jpeg.payload_of(image, blocks), jpeg.thumbnail(image, blocks)
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-jpeg.BLOCK :]), len(m), hashlib.sha256(m).hexdigest(), image.width, image.height, f"{jpeg.difference_hash(grid):016x}", hashlib.sha256(grid.tobytes()).hexdigest()))
        return pd.DataFrame(found, columns=[x.split()[0] for x in _FEATURES.split(", ")])

    return decode(media)


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, the features read back from the stored image, and the image itself if asked.

    A null text counts as the empty one, whose payload is 64 zero bytes. Equal texts give equal values;
    repeated rows each give a row; a null doc_id stays null; an empty table gives an empty result. Other
    columns are not read.
    """
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), store(body).alias("media"))
    rows = rows.withColumn("f", read_features(F.col("media")))
    return rows.select("doc_id", "n_bytes", "f.*", *(["media"] if keep_media else []))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns(read_table(spark, sf_dir, "documents"))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash", "thumbnail_sha256")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
