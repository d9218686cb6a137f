"""Results of several samples side by side: pivots, common guides, correlations, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def side_by_side(rows: DataFrame, keys: list[str], value: str, samples: list[str], inner: bool = False) -> DataFrame:
    """keys, a column `value sample` for each sample, `value sum`. One aggregation, whatever the number of samples.

    Outer: missing values are 0. Inner: only keys that every sample has.
    """
    wide = rows.filter(F.col("sample").isin(samples)).groupBy(*keys).pivot("sample", samples).agg(F.sum(value))
    wide = wide.select(*keys, *(F.col(s).alias(f"{value}_{s}") for s in samples))
    cols = [f"{value}_{s}" for s in samples]
    wide = wide.na.drop(subset=cols) if inner else wide.na.fill(0, subset=cols)
    return wide.withColumn(f"{value}_sum", sum((F.col(c) for c in cols[1:]), F.col(cols[0])))


def common_guides(totals: DataFrame, least: int, samples: int) -> DataFrame:
    """Ids (oligo_id) with more than `least` reads in each of `samples` samples."""
    return totals.filter(F.col("reads") > least).groupBy("oligo_id").agg(F.count_distinct("sample").alias("n")).filter(F.col("n") == samples).select("oligo_id")


def partitions(targets: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(part, oligo_id): a row for each flag that holds; parts may overlap."""
    named = F.array(*(F.when(c, F.lit(name)) for name, c in flags.items()))
    return targets.select("oligo_id", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("part"))


def categories(profile: DataFrame, itype: Column, size: Column, shift: Column, mixed: Column) -> DataFrame:
    """Reads of each oligo by kind of edit: small and larger insertions, small and larger deletions, mixed ones."""
    of = lambda c: F.sum(F.when(c, F.col("reads")).otherwise(0)).alias
    plain = ~mixed
    ins, dele = (itype == "I") & plain, (itype == "D") & plain
    return profile.filter("indel <> '-'").groupBy("sample", "oligo_id").agg(
        F.sum("reads").alias("total"), of(ins & (size == 1))("i1"), of(ins & (size > 1))("i_more"), of(dele & (size == 1))("d1"), of(dele & (size == 2))("d2"),
        of(dele & (size > 2) & (shift > 0))("d_repeat"), of(dele & (size > 2) & (shift == 0))("d_plain"), of(mixed)("mixed"),
    )


def dominant(profile: DataFrame) -> DataFrame:
    """The most frequent edits of each oligo, all that tie."""
    w = Window.partitionBy("sample", "oligo_id")
    edits = profile.filter("indel <> '-'").withColumn("_m", F.max("reads").over(w))
    return edits.filter("reads = _m").drop("_m")


def consistency(profile: DataFrame, kind: Column, samples: int) -> DataFrame:
    """Oligos by the kind of their dominant edit where it is the same in all samples, else inconsistent."""
    one = dominant(profile).groupBy("sample", "oligo_id").agg(F.concat_ws("", F.sort_array(F.collect_list("indel"))).alias("indel"))
    by = one.groupBy("oligo_id").agg(F.count_distinct("indel").alias("d"), F.count("*").alias("n"), F.min("indel").alias("indel"))
    agreed = by.withColumn("kind", F.when((F.col("d") == 1) & (F.col("n") == samples), kind).otherwise("inconsistent"))
    return agreed.groupBy("kind").agg(F.count("*").alias("oligos"))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(w) + (ties - 1) / 2.0


def pearson(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.corr(x, y).alias("pearson"), F.count("*").alias("n"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    ranked = rows.withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("spearman"), F.count("*").alias("n"))


def regression(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Line with intercept, line through the origin, correlation."""
    return rows.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"),
        (F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope_origin"), F.count("*").alias("n"),
    )


def boxes(rows: DataFrame, value: str, by: list[str], least: int = 0) -> DataFrame:
    """Quartiles of groups with more than `least` rows."""
    got = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    return got.filter(F.col("n") > least).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "n")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows by fixed-width bin, 1..bins; those outside have 0 or bins + 1."""
    return rows.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def insert_summary(reads: DataFrame, details: DataFrame) -> DataFrame:
    """Reads of short inserts: repeats of the left base, of the right base (half each where both are equal), others.

    details: (oligo_id, ins, indel, left_base, right_base); reads: (oligo_id, indel, reads). Missing edits count 0.
    """
    rows = details.join(reads, ["oligo_id", "indel"], "left").withColumn("reads", F.coalesce("reads", F.lit(0)))
    n = F.length("ins")
    left, right = F.col("ins") == F.repeat("left_base", n), F.col("ins") == F.repeat("right_base", n)
    share = F.when(left & right, 0.5).otherwise(1.0) * F.col("reads")
    return rows.groupBy("oligo_id", n.alias("size")).agg(
        F.sum(F.when(left, share).otherwise(0.0)).alias("left_repeat"), F.sum(F.when(right, share).otherwise(0.0)).alias("right_repeat"),
        F.sum(F.when(~left & ~right, F.col("reads")).otherwise(0)).alias("other"),
    )


def digits(keys: list[str], seed: int) -> Column:
    """Hexadecimal digits that follow from the keys and a seed."""
    return F.md5(F.concat_ws("/", *keys, F.lit(str(seed))))


def weighted_pick(rows: DataFrame, keys: list[str], weight: str, order: list[str], seed: int = 0) -> DataFrame:
    """One row of each key with a chance in proportion to its weight, the same each time: inverse running sum of a hash."""
    w = Window.partitionBy(*keys)
    running = F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    draw = F.conv(F.substring(digits(keys, seed), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28)) * F.sum(weight).over(w)
    got = rows.withColumn("_r", running).withColumn("_d", draw)
    return got.filter((F.col("_r") > F.col("_d")) & (F.col("_r") - F.col(weight) <= F.col("_d"))).drop("_r", "_d")


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """rows with their `place` (from 0) in a reproducible random order, that of a hash of the key and then the key.

    The hash's first digits make 4,096 slices in order; only their counts meet in one task.
    """
    told = rows.withColumn("_d", digits([key], seed)).withColumn("_s", F.substring("_d", 1, 3))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = told.groupBy("_s").agg(F.count("*").alias("_n")).select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_s").orderBy("_d", key)) - 1
    return told.withColumn("_own", own).join(F.broadcast(starts), "_s").withColumn("place", F.col("_before") + F.col("_own")).drop("_d", "_s", "_own", "_before")


#: Keys that are looked at for each range of an order.
LOOKS = 32


def numbered(rows: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """rows with their place in an order, ascending, without a window over all: dealt out into a fixed number of ranges, a place
    in each, and the ranges' counts before it. Rows alike in the order get places in any order.

    The bounds are some of the keys, those with the least hashes, so they are the same each time that Spark makes the rows:
    the counts and the places come from two passes, which range partitioning would cut at other, sampled bounds.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_key", F.struct(*order))
    some = keyed.select("_key", F.xxhash64("_key").alias("_hash")).orderBy("_hash", "_key").limit(LOOKS * n)
    bounds = some.agg(F.array_sort(F.collect_list("_key")).alias("_bounds"))
    bounds = bounds.select(F.filter("_bounds", lambda k, i: i % LOOKS == LOOKS - 1).alias("_bounds"))
    at = keyed.crossJoin(F.broadcast(bounds)).withColumn("_part", F.size(F.filter("_bounds", lambda k: k < F.col("_key")))).drop("_bounds")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = at.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_key")).cast("long") - 1
    return at.withColumn("_at", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") + first).drop("_at", "_part", "_before", "_key")


def mean_by_cell_line(rows: DataFrame, cell_line: Column, cols: list[str]) -> DataFrame:
    """Means over the samples of each cell line."""
    return rows.groupBy(cell_line.alias("cell_line")).agg(*(F.avg(c).alias(c) for c in cols), F.count("*").alias("samples"))


def stride(numbered: DataFrame, place: str, first: int, step: int) -> DataFrame:
    """Every step-th row from a place on, of rows with a place (shuffled(), row numbers)."""
    return numbered.filter((F.col(place) >= first) & (F.pmod(F.col(place) - first, F.lit(step)) == 0))
