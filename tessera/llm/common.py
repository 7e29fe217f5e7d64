"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One ASCII white-space character, as the word rules of the contracts have it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that ``spark.checkpoint.dir`` names; only a session without one (tests) gets a local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage there.

    Executors keep the shuffle files of steps that nothing refers to any more until the driver collects its garbage, which a
    driver with little to do does late; so that they don't pile up over many steps, it is asked to here.
    """
    _shared_folder(df.sparkSession)
    out = df.checkpoint()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but in a compressed columnar table, for large results. It stays until ``dropped`` or the session's folder goes."""
    path = f"{_shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table of a result of ``stored`` that no later step reads any more; any other DataFrame is left alone."""
    if (path := _STORED.pop(df, None)) is not None:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_unique(left: DataFrame, right: DataFrame, on: str, salts: int = 64, counted: DataFrame | None = None) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has one row for each value of ``on``, where any value may be hot in ``left``.

    ``counted`` has the same values as ``left`` where that is dear to compute.

    Values with more than a quarter of a mean partition of ``left`` are found by a count that is combined before its shuffle;
    there are at most four of them for each partition. Their rows are salted by a hash, and the rows of ``right`` repeated.
    """
    n = partitions(left.sparkSession)
    counted = left if counted is None else counted
    counts = counted.groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
    total = counted.count()
    hot = checkpointed(counts.where(F.col("__n") > max(256.0, total / (4 * n))).select(on))
    if hot.isEmpty():
        return left.join(right, on)
    hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    others = [F.col(c) for c in left.columns]
    salted = left.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*others), F.lit(salts))).otherwise(0)).drop("__hot")
    spread = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    repeated = right.join(hot, on, "left").withColumn("__salt", spread).drop("__hot")
    return salted.join(repeated, [on, "__salt"]).drop("__salt")


def unit_hash(*columns: Column | str) -> Column:
    """A seeded uniform number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow map that works on slices of at most ``rows`` rows, which bounds a worker's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield function(batch.slice(start, rows))

    return run
