"""Shared storage and small column helpers used by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words (a fixed value of the contracts).
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or, in a local session without one, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cardmart-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by stored() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null text as the empty text."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """Words of a text as an array (none: an empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def share_of(h: Column) -> Column:
    """A place from 0 to 1 for a 64-bit hash, to 15 digits: rows below a share are a sample of that share, however small it is."""
    return F.pmod(h, F.lit(1_000_000)) / 1e6 + F.pmod(F.xxhash64(h), F.lit(1_000_000_000)) / 1e15


#: Names of a row: its file (as a hash) and its place there.
FILE, PLACE = "__file", "__place"


def _is_scan(docs: DataFrame) -> bool:
    """Whether the frame is a scan of files with at most filters on it, so that each row has a place of its own."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation") or plan.nodeName().startswith("Relation ")


def identified(docs: DataFrame) -> DataFrame:
    """docs with a name for each row (FILE, PLACE), also where doc_id is null or repeats; what is no scan of files is written first."""
    if FILE in docs.columns:
        return docs
    if not _is_scan(docs):
        docs = stored(docs, "rows")
    hidden = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(hidden["file_path"]).alias(FILE), hidden["row_index"].alias(PLACE))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs, identified(), that are named in kept, without their names."""
    kept = stored(kept.select(F.col(FILE).alias("kept_file"), F.col(PLACE).alias("kept_place")), "kept")
    # kept grows with the documents, so it is never broadcast
    named = docs.join(kept.hint("merge"), (docs[FILE] == kept["kept_file"]) & (docs[PLACE] == kept["kept_place"]), "left_semi")
    return named.drop(FILE, PLACE)
