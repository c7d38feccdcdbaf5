"""What the corpus operators share: the shared folder, column access, checkpoints."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, `[\x20\x09-\x0D]`, as a Java and DuckDB pattern.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset (a local run, tests) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="wavespark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors.

    The table's path is added to paths, for one who drops it later.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if paths is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that no longer exist.

    The last plan that ran is held until another has, so a small one runs first.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)  # the cleaner works in a thread of its own


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_held: dict[tuple[str, str], object] = {}


def held(kind: str, key: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task: one thing at a time, so that stages don't add up in its memory."""
    if (kind, key) not in _held:
        _held.clear()
        _held[kind, key] = make()
    return _held[kind, key]


def text_of(column: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def salts(spark: SparkSession) -> int:
    """Into how many parts a hot key is split: as many as a shuffle has partitions, 64 at least."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt(columns: list[str], n: int) -> Column:
    """A part from 0 to n - 1, the same again for the same row."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


#: Cuts in one step of the search for a row's range.
_STRIDE = 64


def cuts(df: DataFrame, key: str, ranges: int) -> list[int]:
    """Quantiles of a long column that part it into so many ranges, or fewer."""
    shares = [i / ranges for i in range(1, ranges)]
    found = df.select(F.percentile_approx(key, shares, 20 * ranges).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below key, null 0: first among every 64th, then among the 64 after it."""
    if not cuts:
        return F.lit(0)
    below = lambda some: F.size(F.filter(some, lambda c: c < key))
    array = lambda some: F.lit(some) if some else F.array().cast("array<bigint>")
    coarse = below(array(cuts[_STRIDE - 1 :: _STRIDE]))
    fine = F.slice(array(cuts), coarse * _STRIDE + 1, F.lit(_STRIDE))
    return F.when(key.isNull(), 0).otherwise(coarse * _STRIDE + below(fine))


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return value - (1 << 64) if value >= 1 << 63 else value
