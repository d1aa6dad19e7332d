"""Size checks, hot keys, staging and ranks that hold on any number of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BROADCAST_BYTES = 256 * 1024 * 1024
MIN_SHARES = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session may do without it; it gets a scratch folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="covaria-"))
        named = context.getCheckpointDir()
    return named


def workspace(spark: SparkSession) -> str:
    """The folder of this application's staged tables inside the shared one."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove the staged tables, when the results that read them are written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(workspace(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folder, True)


def staged(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage, one evaluation."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_bytes(df: DataFrame) -> int:
    """Bytes that the rows would take in memory, summed where the rows are."""
    width = F.lit(16 + 16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.col(field.name))), F.lit(0))
        elif not isinstance(field.dataType, (T.NumericType, T.DateType, T.BooleanType)):
            shown = F.octet_length(F.col(field.name).cast("string"))
            width = width + F.coalesce(shown, F.lit(0))
    return df.agg(F.sum(width).alias("held")).first()["held"] or 0


def small(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    return held_bytes(df) <= limit_bytes


def fair_share(spark: SparkSession) -> int:
    """Rows are cut into this many shares; a key with more than one share is hot."""
    return max(MIN_SHARES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, keys: Sequence[str], shares: int) -> DataFrame:
    """Keys with more than one of ``shares`` equal shares of the rows, and how many they fill.

    There are fewer than ``shares`` such keys, whatever the data.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    filled = F.ceil(F.col("n") * shares / total).cast("int")
    return counts.where(F.col("n") * shares > total).select(*keys, filled.alias("_salts"))


def salted_join(
    big: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    spread_by: Column,
    how: str = "inner",
    shares: int | None = None,
) -> DataFrame:
    """Shuffle join in which a hot key goes to as many tasks as it fills shares.

    Rows without a key match nothing and are spread too. Rows of ``other`` are
    repeated for hot keys only, at most ``2 * shares`` times over all keys. The hot
    list is shorter than ``shares`` by definition, so it is broadcast unchecked.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"salted_join keeps the rows of the big side, not {how!r}")
    shares = shares or fair_share(big.sparkSession)
    hot = F.broadcast(hot_keys(big.select(*keys), keys, shares))
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    tasks = F.when(missing, F.lit(shares)).otherwise(F.coalesce("_salts", F.lit(1)))
    salt = F.pmod(F.xxhash64(spread_by), tasks).cast("int")
    left = big.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = other.join(hot, list(keys), "left").withColumn("_salt", F.explode(copies))
    return left.join(right.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def sized_join(
    big: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    spread_by: Column,
    how: str = "inner",
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Broadcast ``other`` when its summed size shows that it fits, else a salted shuffle join."""
    if small(other, limit_bytes):
        return big.join(F.broadcast(other), list(keys), how)
    return salted_join(big, other, keys, spread_by, how)


def largest(rows: DataFrame, k: int, count: str, name: str, rare: int = 0) -> DataFrame:
    """The ``k`` rows of the largest ``count``; of equal ones those with the smallest ``name``.

    A histogram of the counts shows above which one all rows are in. Only the rows that
    share the count at the edge are ordered, and only as many of them as are still wanted.
    Rows of a count up to ``rare`` are written only if the others are fewer than ``k``.
    """
    held = staged(rows.where(F.col(count) > rare) if rare else rows, "counted")

    def counted() -> list[tuple[int, int]]:
        # As many distinct counts as fit below the square root of twice their sum.
        sizes = held.groupBy(count).agg(F.count(F.lit(1)).alias("rows"))
        return sorted(map(tuple, sizes.collect()), reverse=True)

    sizes = counted()
    if rare and sum(members for _, members in sizes) < k:
        held = held.unionByName(staged(rows.where(F.col(count) <= rare), "counted-seldom"))
        sizes = counted()
    left = k
    for size, members in sizes:
        if members > left:
            edge = held.where(F.col(count) == size).orderBy(name).limit(left)
            return held.where(F.col(count) > size).unionByName(edge)
        left -= members
    return held


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows in as many tasks as the cluster runs at once at least, none with more than twice its share.

    Rows that lie so already stay where they are; a file that one task reads is dealt out by ``key``.
    Only ``key`` is read to find out.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select(key, F.spark_partition_id().alias("part"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    found = sizes.agg(F.max("rows").alias("most"), F.sum("rows").alias("all")).first()
    if found["all"] and found["most"] * tasks <= 2 * found["all"]:
        return rows
    return rows.repartition(key)


def exploded(df: DataFrame, kept: Sequence[str | Column], array: Column, name: str) -> DataFrame:
    """One row per array element.

    The outer form keeps Catalyst from adding ``size(array) > 0`` as a filter, which
    it would push below the joins and so compute the array several times.
    """
    rows = df.select(*kept, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())


def placed(
    df: DataFrame, kept: Sequence[str | Column], array: Column, place: str, name: str
) -> DataFrame:
    """``exploded`` with the position of each element, from 0."""
    rows = df.select(*kept, F.posexplode_outer(array).alias(place, name))
    return rows.where(F.col(name).isNotNull())


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, start: int = 0
) -> DataFrame:
    """Row number within ``keys`` that never puts a whole group into one task.

    ``order`` holds unbound columns (``F.col``) and must be free of ties. Rows are range-partitioned by key and order,
    numbered inside each slice of a key, and moved up by the sizes of the key's
    earlier slices. The slices are staged so that both steps see the same ones.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, 2)
    parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    sliced = staged(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    ranked = sliced.withColumn("_rank", inside)
    # Null keys are a group too.
    same = F.lit(True)
    for key in keys:
        same = same & ranked[key].eqNullSafe(offsets[key])
    joined = ranked.join(offsets, same & (ranked["_slice"] == offsets["_slice"]))
    return (
        joined.drop(*(offsets[key] for key in keys), offsets["_slice"])
        .withColumn(name, (F.col("_rank") + F.col("_offset") - 1 + start).cast("long"))
        .drop("_rank", "_offset", "_slice")
    )
