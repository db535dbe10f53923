"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

A batch is reduced to one row per digest (partial sums first, so that a text repeated by a third of
all rows is one row per task before any shuffle), anti-joined with the index by sort-merge and
appended to it. The index lives at a path, one folder a batch, and is opened there again by later sessions. It has as many
buckets as the session has shuffle partitions, so the anti-join moves the batch alone; compact() leaves one
sorted file a bucket, which the join then reads in order. DataFrame functions only.

Defined results: null text counts as the empty text, and all empty texts are one group; of equal texts exactly
one row stays, also where rows repeat whole or doc_id is null; rows with a null doc_id stay only where no other
has as many code points, and then keep_id is null; very long texts are one digest like others; an empty batch leaves
the index as it is; further columns of the input are not read, but they are kept by drop_exact().
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import FILE, PLACE, SPACE, identified, new_path, only, stored


def normalised(text: Column) -> Column:
    """The text without its ASCII white space."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), n_points (code points of the original) and the row's name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return identified(docs).select("doc_id", F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.length(text).cast("long").alias("n_points"), FILE, PLACE)


class DigestIndex:
    """The digests seen so far, at a path: digest, keep_id and the name of the row that stays, group_size, batch."""

    SCHEMA = "digest BINARY, keep_id BIGINT, keep_file BIGINT, keep_place BIGINT, group_size BIGINT, batch STRING, part STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """buckets counts for a new index only: as many as there are shuffle partitions, unless given."""
        self.spark, self.path = spark, path.rstrip("/")
        # sorted buckets are read in order where each is one file (the planner checks that)
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.version, self.buckets = max(self._versions(), default=(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self._register()

    def _fs(self):
        of = self.spark._jvm.org.apache.hadoop.fs.Path
        return of, of(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, int]]:
        """Complete versions at the path and their buckets: folders v<number>-<buckets>."""
        of, fs = self._fs()
        names = [f.getPath().getName() for f in fs.globStatus(of(f"{self.path}/v*-*")) or []]
        return [tuple(map(int, n[1:].split("-"))) for n in names if fs.exists(of(f"{self.path}/{n}/_complete"))]

    @property
    def folder(self) -> str:
        return f"{self.path}/v{self.version}-{self.buckets}"

    @property
    def table(self) -> str:
        return "digests_" + hashlib.md5(self.folder.encode()).hexdigest()

    def _register(self) -> None:
        of, fs = self._fs()
        if not self.spark.catalog.tableExists(self.table):
            fs.mkdirs(of(self.folder))
            self.spark.sql(f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet PARTITIONED BY (part) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")
        if self.parts():
            self.spark.sql(f"MSCK REPAIR TABLE {self.table}")  # the batches that lie there
        fs.create(of(f"{self.folder}/_complete"), True).close()

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def parts(self) -> int:
        of, fs = self._fs()
        return len(fs.globStatus(of(f"{self.folder}/part=*")) or [])

    def _append(self, rows: DataFrame, table: str) -> None:
        # one partition per bucket: each bucket is one sorted file
        out = rows.repartition(self.buckets, "digest").write.format("parquet").mode("append")
        out.partitionBy("part").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)

    def ingest(self, batch: DataFrame, name: str = "batch") -> DataFrame:
        """Append what is new in a frame of signed() rows; returns the index rows of this batch.

        Of rows with one digest, that with most code points, then the smallest doc_id, then the first row stays. A
        digest that an earlier batch brought keeps its earlier row.
        """
        last = [F.bitwise_not(F.col(c)).alias(c) for c in ("doc_id", FILE, PLACE)]
        found = batch.groupBy("digest").agg(F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("named"), *last)).alias("top"), F.count(F.lit(1)).alias("group_size"))
        keep = [F.bitwise_not(F.col(f"top.{c}")).alias(n) for c, n in (("doc_id", "keep_id"), (FILE, "keep_file"), (PLACE, "keep_place"))]
        found = found.select("digest", *keep, "group_size", F.lit(name).alias("batch"), F.lit(name).alias("part"))
        self._append(found.join(self.read().select("digest").hint("merge"), "digest", "left_anti"), self.table)
        return self.read().where(F.col("part") == name)

    def compact(self) -> None:
        """Rewrite the index as one sorted file a bucket, in a new version; the version before stays until discard_old()."""
        rows = self.read().withColumn("part", F.lit("all"))
        new = DigestIndex.__new__(DigestIndex)
        new.spark, new.path, new.version, new.buckets = self.spark, self.path, self.version + 1, self.buckets
        of, fs = new._fs()
        fs.delete(of(new.folder), True)  # what a failed attempt has left
        self.spark.sql(f"DROP TABLE IF EXISTS {new.table}")
        fs.mkdirs(of(new.folder))
        self.spark.sql(f"CREATE TABLE {new.table} ({self.SCHEMA}) USING parquet PARTITIONED BY (part) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{new.folder}'")
        self._append(rows, new.table)
        new._register()  # complete from here on
        self.version = new.version

    def discard_old(self) -> None:
        """Delete the versions before this one."""
        of, fs = self._fs()
        for version, buckets in self._versions():
            if version < self.version:
                fs.delete(of(f"{self.path}/v{version}-{buckets}"), True)

    def files(self) -> DataFrame:
        """The index as plain files, so that a join with hot digests can be split at run time."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)


def exact_groups(docs: DataFrame, path: str | None = None, name: str = "batch") -> DataFrame:
    """Each row with its group: doc_id, digest, n_points, the row's name, keep_id, group_size, kept.

    path: an index to go on with, under this name of the batch (a row whose text an earlier batch brought does not
    stay); without it a new one.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, path or new_path(spark, "digest-index"))
    rows = stored(signed(docs), "digests")
    index.ingest(rows, name)
    if path is None:  # an index of this run alone needs no entry in the catalog
        spark.sql(f"DROP TABLE {index.table}")
    kept = F.col(FILE).eqNullSafe(F.col("keep_file")) & F.col(PLACE).eqNullSafe(F.col("keep_place")) & (F.col("batch") == name)
    held = index.files().select("digest", "keep_id", "keep_file", "keep_place", "group_size", "batch")
    return rows.join(held, "digest").withColumn("kept", kept).drop("keep_file", "keep_place", "batch")


def drop_exact(docs: DataFrame, path: str | None = None, name: str = "batch") -> DataFrame:
    """The documents that stay, one row for each text, with all their columns."""
    docs = identified(docs)
    return only(docs, exact_groups(docs, path, name).where("kept"))
