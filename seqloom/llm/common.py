"""What the operators of this subpackage share: reading, writing of intermediate tables, joins with small tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same set as ``bytes.split()`` uses.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set. One that lies in fewer pieces than there are cores is dealt out, as the work on a text is more
    than its move; a larger one stays where it is."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine, said aloud and
    removed at the end: that does for local runs only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _local.get("path")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="seqloom-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = _local["path"] = f"file://{folder}"
        warnings.warn(f"spark.checkpoint.dir isn't set; intermediate tables go to {path}", stacklevel=2)
    return path.rstrip("/")


_local: dict[str, str] = {}
#: The folders that this process has made, the latest last.
_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/seqloom-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def marked() -> int:
    """For `release`: what is made from here on."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Deletes the intermediate tables made since a mark, all but one. Tables that read them can't be used any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _made[since:]:
        if path != keep:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    _made[since:] = [keep] if keep in _made[since:] else []


def materialized(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder: later uses neither compute it again nor depend on an executor's disk."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """fn on each Arrow batch. The batch's rows are few enough for long texts: see spark.sql.execution.arrow.maxRecordsPerBatch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                out = fn(batch.slice(start, 2000))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def key_of(column: Column) -> Column:
    """A string that tells null from any text, so that null is an ordinary key."""
    return F.when(column.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), column.cast("string")))


def salts_of(spark: SparkSession) -> int:
    """Over how many tasks a hot key is dealt: as many as a shuffle has."""
    return max(16, partitions(spark))


def known_small(df: DataFrame) -> bool:
    """Whether Spark's own estimate of a table is within its limit for broadcasts; for written tables, that is their files' size."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def with_groups(rows: DataFrame, groups: DataFrame, key: str, by: Column) -> DataFrame:
    """rows joined with the one row that groups, a written table, has for their key. Groups within Spark's limit for
    broadcasts go to the rows, which stay where they are. Else a key's rows are dealt by `by` over as many salts as a
    shuffle has tasks, and groups has each of its rows once for each salt that rows have: neither side is multiplied, and
    no key is one task's work."""
    if known_small(groups):
        return rows.join(F.broadcast(groups), key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts_of(rows.sparkSession))).cast("int"))
    many = groups.join(salted.select(key, "_salt").distinct(), key)
    return salted.join(many, [key, "_salt"]).drop("_salt")


def global_order(df: DataFrame, order: list[str], label: str) -> tuple[DataFrame, dict[int, int]]:
    """df in ranges of `order`, written with the range's number `_part`, and the rows before each range.
    What comes to the driver is one number a range."""
    n = partitions(df.sparkSession)
    out = materialized(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), label)
    counts = sorted((r["_part"], r["count"]) for r in out.groupBy("_part").count().collect())
    before, total = {}, 0
    for part, count in counts:
        before[part] = total
        total += count
    return out, before
