"""Change feeds: dated folders of JSON lines as a stream of changes, and the state of each key that they leave.

A feed is a folder `stream/year=YYYY/month=MM/day=DD/` of (compressed) JSON lines, one change a line: the row after it, when it happened,
and whether it deletes. Lines arrive late, twice and in any order, so the state keeps the latest change of each key
by the feed's own order, deletions too: an older change that comes after a deletion does not bring the row back.

A state lies in buckets by a hash of the key (Buckets). A batch reads and rewrites only the buckets that its keys fall into, into a new folder, and commits
by writing a manifest, the last of its files: where each bucket lies now, and the last batch of each source. A batch that is in the
manifest is skipped, one that failed before its manifest starts over from the one before, so each counts once. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import latest_per_key
from ..operators.sinks import files

_MANIFEST = "kind string, name string, value long"


def changes(spark: SparkSession, root: str, stream: str, schema: T.StructType | str) -> DataFrame:
    """All changes of a stream's folders; a line that is no JSON or does not fit has nulls, and its text in _corrupt_record where the schema has it."""
    return spark.read.schema(schema).json(f"{root.rstrip('/')}/{stream}").drop("year", "month", "day")


def change_stream(spark: SparkSession, root: str, stream: str, schema: T.StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream, folder after folder as files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(f"{root.rstrip('/')}/{stream}").drop("year", "month", "day")


@dataclass
class Buckets:
    """A keyed state under a path that takes in each batch of a source once."""

    path: str
    keys: Sequence[str]
    buckets: int = field(default=64, kw_only=True)

    def _numbers(self, spark: SparkSession, below: str) -> list[int]:
        """Numbers of the folders of a kind, of manifests only those that are whole."""
        fs, Path = files(spark, self.path)
        folder = Path(f"{self.path}/{below}")
        if not fs.exists(folder):
            return []
        found = [f.getPath() for f in fs.listStatus(folder)]
        return sorted(int(p.getName().partition("=")[2]) for p in found if "=" in p.getName() and (below != "manifest" or fs.exists(Path(p, "_SUCCESS"))))

    def _manifest(self, spark: SparkSession) -> tuple[int, dict[str, dict[str, int]]]:
        """Number of the last commit, and what it holds: a row per bucket and source."""
        done = self._numbers(spark, "manifest")
        held: dict[str, dict[str, int]] = {"bucket": {}, "source": {}}
        if not done:
            return -1, held
        for r in spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/commit={done[-1]}").collect():
            held[r["kind"]][r["name"]] = r["value"]
        return done[-1], held

    def _read(self, spark: SparkSession, schema: T.StructType, where: dict[str, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/commit={n}/bucket={k}" for k, n in where.items()]
        return spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths) if paths else None

    def rows(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """All rows of the state."""
        found = self._read(spark, schema, self._manifest(spark)[1]["bucket"])
        return found.select(*schema.names) if found is not None else spark.createDataFrame([], schema)

    def take(self, batch: DataFrame, batch_id: int, source: str, reduced: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame], aside: Callable[[int], None] | None = None) -> bool:
        """Take a batch in; False if it has been taken in before. A source's batch ids only grow.

        reduced: the batch as rows of the state, one a key; merged: such rows of before and of now, one a key. aside: writes what else belongs to the commit, by its number.
        """
        spark = batch.sparkSession
        last, held = self._manifest(spark)
        if batch_id <= held["source"].get(source, -1):
            return False
        commit = last + 1
        rows = reduced(batch).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        if aside:
            aside(commit)
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets at most
        if touched:
            old = self._read(spark, rows.schema, {str(k): held["bucket"][str(k)] for k in touched if str(k) in held["bucket"]})
            out = merged(old.select(*rows.columns).unionByName(rows)) if old is not None else rows
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/commit={commit}")
        held["bucket"] |= {str(k): commit for k in touched}
        held["source"][source] = batch_id
        lines = [(kind, name, value) for kind, values in held.items() for name, value in values.items()]
        spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/commit={commit}")
        return True

    def vacuum(self, spark: SparkSession, keep: int = 2) -> int:
        """Delete folders that none of the newest `keep` manifests names; the number of folders deleted."""
        fs, Path = files(spark, self.path)
        done = self._numbers(spark, "manifest")
        if not done:
            return 0
        named = set(done[-keep:])
        for n in done[-keep:]:
            named |= {r["value"] for r in spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/commit={n}").where("kind = 'bucket'").collect()}
        gone = 0
        for below in ("manifest", "data"):
            for n in self._numbers(spark, below):
                if n <= done[-1] and n not in (set(done[-keep:]) if below == "manifest" else named):
                    gone += fs.delete(Path(f"{self.path}/{below}/commit={n}"), True)
        return gone


def run_once(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], object]) -> StreamingQuery:
    """Take in what there is, batch by batch, and end; called again, it goes on from its checkpoint."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class ChangeTable(Buckets):
    """The state that a change feed leaves at a path.

    order: columns by which a key's changes follow each other (the other columns break ties); deleted: an SQL condition that a deletion meets.
    Rows with a null key go to `rejected` below the path, by commit.
    """

    order: Sequence[str]
    deleted: str

    def apply(self, batch: DataFrame, batch_id: int, source: str = "feed") -> bool:
        """Take a batch of changes in; False if it has been taken in before."""
        whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.keys))
        latest = lambda df: latest_per_key(df, list(self.keys), list(self.order))

        def aside(commit: int) -> None:
            batch.where(~whole).write.mode("overwrite").parquet(f"{self.path}/rejected/commit={commit}")

        return self.take(batch, batch_id, source, lambda df: latest(df.where(whole)), latest, aside)

    def state(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The rows that are there; rows() has the deletions too. schema: of the changes."""
        return self.rows(spark, schema).where(~F.coalesce(F.expr(self.deleted), F.lit(False)))

    def start(self, stream: DataFrame, checkpoint: str, source: str = "feed") -> StreamingQuery:
        return run_once(stream, checkpoint, lambda df, i: self.apply(df, i, source))
