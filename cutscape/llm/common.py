"""Pieces shared by the operators: the shared folder, global row numbers, connected components, words as bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Upper case to lower case; what is no word character of [^\x00-\x2F\x3A-\x60\x7B-\x7F] (after that) to a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: Upper case to lower case; the white space of [\x20\x09-\x0D] to a space.
SPACE_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One is made only in local runs that name none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named is None and current is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
    if current is None:
        sc.setCheckpointDir(named)
    return named or current


def shared_path(spark: SparkSession, what: str) -> str:
    """A new, unused path below the shared folder."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


_MADE: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes what this program has put into the shared folder by shared_path(): tables of written(), items, files. Call it when
    the results are saved: frames that read these tables can't be read again. Returns the number of folders. Checkpoints are
    Spark's, which removes them with spark.cleaner.referenceTracking.cleanCheckpoints."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in (made := list(_MADE)):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _MADE.remove(path)
    return len(made)


def filesystem(uri: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are in the shared folder and survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder, read again. Unlike cut() it keeps no order, and takes less room."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_number(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Gapless numbers from 0 in the order of the columns, without a global window.

    The rows are dealt by range and sorted within partitions, then checkpointed, so that a row's partition and place
    stay as they are; the number is the place plus the counts of the partitions before. Only one count for each
    partition meets in one task. Ties of all columns get numbers in any order.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()
    placed = placed.withColumn("_at", at)
    part = F.shiftright("_at", 33).cast("int")
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(counts), "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, F.col("_before") + place).drop("_at", "_part", "_before")


def with_number(df: DataFrame, classes: list[str], tie: list[str], name: str = "row_no") -> DataFrame:
    """Gapless numbers from 0: rows of smaller classes first, in a class by slices of a hash of the tie columns.

    The numbers depend on the rows alone, so they stay the same if a lost part is computed again, without a checkpoint.
    A class is split into slices of about 1024 rows (more if there were over 100,000 of them), so no class, however
    large, meets in one task; only a count for each slice does. Rows alike in all tie columns get numbers in any order.
    The input is read three times: write it first if it is dear. Classes must not be null.
    """
    total = df.groupBy(*classes).agg(F.count("*").alias("_n"))
    sizes = total.crossJoin(F.broadcast(total.agg(F.sum("_n").alias("_all"))))  # one row
    sizes = sizes.withColumn("_slices", F.ceil(F.col("_n") / F.greatest(F.lit(1024), F.col("_all") / 100_000)))
    sizes = sizes.select(*classes, "_slices")
    sliced = df.join(F.broadcast(sizes), classes) if classes else df.crossJoin(F.broadcast(sizes))
    sliced = sliced.withColumn("_slice", F.pmod(F.xxhash64(*tie), F.col("_slices"))).drop("_slices")
    keys = [*classes, "_slice"]
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*keys).agg(F.count("*").alias("_m"))
    starts = starts.select(*keys, F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    placed = sliced.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*tie)) - 1)
    return placed.join(starts, keys).withColumn(name, F.col("_before") + F.col("_place")).drop("_slice", "_place", "_before")


def spare(df: DataFrame, name: str) -> str:
    """A name for a passing column that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined_evenly(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join with right, which has one row for each key and, in `count`, the number of left's rows that have it.

    Keys with more than a thousandth of the `total` rows (fewer than a thousand keys) are broadcast, and their rows and
    those without a key are dealt out evenly, so no key meets in one task. left must be a table or a plain scan, so that a
    row keeps its place if it is read again; its columns must not begin with `_hot`.
    """
    values = [c for c in right.columns if c not in (*keys, count)]
    often = F.col(count) > total / 1000
    hot = right.filter(often).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), *(F.col(v).alias(f"_hot_{v}") for v in values))
    same = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    first = left.join(F.broadcast(hot), same, "left")
    away = F.col(f"_hot_{keys[0]}").isNotNull()
    for k in keys:
        away = away | F.col(k).isNull()
    first = first.withColumn("_hot_deal", F.when(away, F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")))
    rest = right.filter(~often).select(*keys, *(F.col(v).alias(f"_hot_not_{v}") for v in values), F.lit(0).cast("long").alias("_hot_deal"))
    both = first.join(rest, [*keys, "_hot_deal"], "left")
    return both.select(*left.columns, *(F.coalesce(f"_hot_{v}", f"_hot_not_{v}").alias(v) for v in values))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (a, b long): root is the smallest node of its connected component.

    Alternating large-star and small-star steps; each step writes its edges to the shared folder. A node's edges are
    reduced to its smallest neighbour before they are shuffled, and joined with that one row. A hub's edges meet in one
    partition of that join, row by row, never as a group; adaptive execution splits such a partition.
    """
    state = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)))
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = e.agg(state.alias("s")).first()["s"]
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(state.alias("s")).first()["s"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
