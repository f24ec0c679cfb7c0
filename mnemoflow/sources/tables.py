"""The project's tables as the operators take them, and the versioned store of the index."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.functions import vectors
from mnemoflow.session import read_table

INDEX_SCHEMA = (
    "conv_id long, turn int, sequence int, paragraph string, summary string, source_text string, vector_chunk_id string, turn_fingerprint string, raw_turn_fingerprint string, "
    "content_fingerprint string, id string, enabled boolean, embedding_model string, embedding_dims int, embedding_encoding string, embedding_scale double, embedding_q string"
)


def latest_rows(rows: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key: the last by ``by``. Copies of a row become one; rows without key are left out."""
    others = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.coalesce(by, F.lit(0).cast("timestamp")))).alias("_r")).select(key, "_r.*")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, each once."""
    return latest_rows(read_table(spark, sf_dir, "messages"), "msg_id", "recv_ts")


def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored index records, each once."""
    return latest_rows(read_table(spark, sf_dir, "fragments"), "frag_id", "ts")


def with_vectors(index: DataFrame) -> DataFrame:
    """The records with ``vec``, the bytes of their vector; empty where there is none or it can't be decoded."""
    return index.withColumn("vec", vectors.decode_bytes(F.col("embedding_q")))


class IndexStore:
    """An index in Parquet folders, partitioned by conversation buckets: whole versions (v) and what was added to them since (d).

    A folder is written once and counts when it is complete, so readers of the one before aren't disturbed, and a write that fails leaves no trace in what is
    read. Records are only ever added; the markers of a conversation are those of the last folder that touched it. :meth:`compact` makes one version of all.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def bucket(self) -> Column:
        return F.pmod(F.hash("conv_id"), F.lit(self.buckets))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _folders(self) -> list[tuple[int, str]]:
        """(number, kind) of the complete folders, in order."""
        if not self._fs.exists(self._path):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path)]
        whole = lambda n: all(self._fs.exists(self._at(f"{n}/{part}/_SUCCESS")) for part in ("records", "empty", *(["touched"] if n[0] == "d" else [])))
        return sorted((int(n[1:]), n[0]) for n in names if n[:1] in ("v", "d") and n[1:].isdigit() and whole(n))

    def versions(self) -> list[int]:
        """Numbers of the complete versions, in order; each is the state after one write."""
        return [n for n, _ in self._folders()]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(records, empty-turn markers) of a version, the newest by default; with ``buckets`` only theirs. Empty frames where there is none."""
        known = [f for f in self._folders() if version is None or f[0] <= version]
        start = max((i for i, (_, kind) in enumerate(known) if kind == "v"), default=0)
        records, empty = self.spark.createDataFrame([], INDEX_SCHEMA), self.spark.createDataFrame([], "conv_id long, marker string")
        for number, kind in known[start:]:
            at = f"{self.root}/{kind}{number}"
            rows = self.spark.read.schema(INDEX_SCHEMA + ", bucket int").parquet(f"{at}/records")
            records = records.unionByName((rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket"))
            if kind == "d":
                empty = empty.join(self.spark.read.schema("conv_id long").parquet(f"{at}/touched"), "conv_id", "left_anti")
            marks = self.spark.read.schema("conv_id long, marker string, bucket int").parquet(f"{at}/empty")
            empty = empty.unionByName((marks if buckets is None else marks.where(F.col("bucket").isin(buckets))).drop("bucket"))
        return records, empty

    def _write(self, kind: str, records: DataFrame, empty: DataFrame) -> int:
        version = max([*self.versions(), time.time_ns() // 1_000_000 - 1]) + 1
        at = f"{self.root}/{kind}{version}"
        records.drop("vec", "embedding").withColumn("bucket", self.bucket()).write.partitionBy("bucket").parquet(f"{at}/records")
        empty.where("marker <> ''").select("conv_id", "marker").distinct().withColumn("bucket", self.bucket()).write.partitionBy("bucket").parquet(f"{at}/empty")
        return version

    def write(self, records: DataFrame, empty: DataFrame) -> int:
        """Write a whole version: records without decoded vectors, and distinct markers that aren't blank. Returns its number."""
        return self._write("v", records, empty)

    def append(self, records: DataFrame, empty: DataFrame, touched: DataFrame) -> int:
        """Add records, and in place of theirs the markers of the conversations ``touched`` (conv_id). What is written follows what is added."""
        version = self._write("d", records, empty)
        touched.select("conv_id").distinct().write.parquet(f"{self.root}/d{version}/touched")
        return version

    def compact(self, keep: int = 1) -> int:
        """One version of the newest state; of the folders before, those of the last ``keep`` whole versions and what was added to them stay."""
        version = self.write(*self.read())
        known = self._folders()
        whole = [n for n, kind in known if kind == "v"]
        first = whole[max(0, len(whole) - 1 - keep)]
        for number, kind in known:
            if number < first:
                self._fs.delete(self._at(f"{kind}{number}"), True)
        return version

    def clear(self) -> int:
        """An empty version."""
        records, empty = self.read()
        return self.write(records.limit(0), empty.limit(0))
