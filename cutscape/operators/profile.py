"""Mutation profiles: long tables (sample, oligo_id, indel, reads) from summaries (…, oligo_indel, reads)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutscape.functions import indel as ix

KEY = ["sample", "oligo_id"]


def tasks_for(rows: int) -> int:
    """Tasks for a number of mapped reads: some 25,000 each, up to 200, the most that Spark writes a shuffle for without
    holding its rows in memory; of up to 2 million each beyond."""
    return max(1, min(-(-rows // 25_000), 200), -(-rows // 2_000_000))


def by_oligo(reads: DataFrame, rows: int) -> DataFrame:
    """Mapped reads dealt out by oligo, for a given number of rows.

    Profiles and what is summed up by oligo are then made where the reads are, without another shuffle. The number of tasks
    follows the rows: Spark puts shuffled bytes together, and those of names shrink to a small part of what they take in memory.
    """
    return reads.repartition(tasks_for(rows), "oligo_id")


def indel_counts(reads: DataFrame) -> DataFrame:
    """Summary rows from mapped reads."""
    return reads.groupBy(*KEY, "indel", "oligo_indel").agg(F.count("*").alias("reads"))


def _kept(summary: DataFrame, drop_long: bool) -> DataFrame:
    """Rows that count, with _total, all reads of their oligo. Unedited reads and clean templates, the most of all, aren't parsed.

    The test looks at the reads, which are there once rows are summed up: else Spark would move it below the sum, where it
    parses the identifier of each single read, and makes it anew for each place at which the test names it.
    """
    spans = ix.in_cut_span("indel")
    if drop_long:
        spans = spans & (ix.isize("indel") <= 30)
    rows = summary.withColumn("_total", F.sum("reads").over(Window.partitionBy(*KEY)))
    fits = F.when(F.col("indel") == "-", True).otherwise(spans) & F.when(F.col("oligo_indel") == "-", True).otherwise(ix.allowed_oligo_indel("oligo_indel"))
    summed = F.coalesce("reads", F.lit(0)) >= 0
    return rows.filter(F.when(summed, F.col("indel").isNotNull() & F.col("oligo_indel").isNotNull() & fits))


def accepted_rows(summary: DataFrame, drop_long: bool = False) -> DataFrame:
    """(sample, oligo_id, indel, reads) of the accepted rows, an indel once for each oligo_indel; for what sums them up itself."""
    return _kept(summary, drop_long).select(*KEY, "indel", "reads")


def accepted_profile(summary: DataFrame, drop_long: bool = False) -> DataFrame:
    """(sample, oligo_id, indel, reads) of the accepted rows, without a wild-type control."""
    return accepted_rows(summary, drop_long).groupBy(*KEY, "indel").agg(F.sum("reads").alias("reads"))


def with_unedited(profile: DataFrame, summary: DataFrame) -> DataFrame:
    """profile with a row `-` of no reads for every oligo of the summary that has none."""
    zero = summary.select(*KEY).distinct().select(*KEY, F.lit("-").alias("indel"), F.lit(0).cast("long").alias("reads"))
    return profile.unionByName(zero).groupBy(*KEY, "indel").agg(F.sum("reads").alias("reads"))


def acceptance(summary: DataFrame, profile: DataFrame) -> DataFrame:
    """(sample, oligo_id, accepted, percent, unedited, states) of a profile: its reads, their share of all reads of the
    summary, those that are unedited, and the number of its indels, `-` among them."""
    total = summary.groupBy(*KEY).agg(F.sum("reads").alias("total"))
    none = F.when(F.col("indel") == "-", F.col("reads")).otherwise(0)
    edited = F.count(F.when(F.col("indel") != "-", F.lit(1)))
    got = profile.groupBy(*KEY).agg(F.sum("reads").alias("accepted"), F.sum(none).alias("unedited"), (edited + 1).alias("states"))
    got = total.join(got, KEY, "left")
    zero = lambda c, x: F.coalesce(c, F.lit(x)).cast("long").alias(c)
    accepted = F.coalesce("accepted", F.lit(0))
    return got.select(*KEY, zero("accepted", 0), (accepted * 100.0 / F.col("total")).alias("percent"), zero("unedited", 0), zero("states", 1))


def controlled_profile(summary: DataFrame, wild: DataFrame, times: float = 3.0, least_percent: float = 10.0, drop_long: bool = False) -> DataFrame:
    """accepted_profile() against a wild-type summary (oligo_id, indel, oligo_indel, reads).

    An indel that the wild type has counts only where a row's share of all reads exceeds `times` the wild type's share.
    Oligos of which the wild type accepts less than `least_percent` of the reads, or has none, give nothing.
    """
    wild = wild.withColumn("sample", F.lit("wild"))
    shares = wild.groupBy("oligo_id", "indel").agg(F.sum("reads").alias("w"))
    shares = shares.withColumn("wild_share", F.col("w") / F.sum("w").over(Window.partitionBy("oligo_id"))).drop("w")
    good = _kept(wild, False).groupBy("oligo_id").agg((F.sum("reads") * 100.0 / F.max("_total")).alias("percent"))
    good = good.filter(F.col("percent") >= least_percent).select("oligo_id")
    rows = _kept(summary, drop_long).join(good, "oligo_id", "left_semi").join(shares, ["oligo_id", "indel"], "left")
    free = F.col("wild_share").isNull() | (F.col("indel") == "-")
    enough = F.col("reads") / F.col("_total") > F.col("wild_share") * times
    return rows.filter(free | enough).groupBy(*KEY, "indel").agg(F.sum("reads").alias("reads"))


def merged_profile(profile: DataFrame, by: str = "library") -> DataFrame:
    """Profiles of several samples added up by a column."""
    return profile.groupBy(by, "oligo_id", "indel").agg(F.sum("reads").alias("reads"))


def profile_counts(profile: DataFrame) -> DataFrame:
    """Share of all and of mutated reads, with the rank: unedited first, then by reads and name, falling."""
    w = Window.partitionBy(*KEY)
    edited = F.sum(F.when(F.col("indel") != "-", F.col("reads")).otherwise(0)).over(w)
    order = w.orderBy((F.col("indel") != "-").cast("int"), F.desc("reads"), F.desc("indel"))
    return profile.select(
        *KEY, "indel", "reads",
        (F.col("reads") * 100.0 / F.sum("reads").over(w)).alias("percent"),
        F.when(edited == 0, 100.0).otherwise(F.col("reads") * 100.0 / edited).alias("percent_of_edited"),
        F.row_number().over(order).alias("place"),
    )


def size_counts(profile: DataFrame, filled: int = 0) -> DataFrame:
    """Reads by kind and net size of the edit; with `filled`, sizes 1 to filled of both kinds have a row in any case."""
    edits = ix.with_parts(profile.filter("indel <> '-'"), "indel", itype=ix.itype("indel"), size=ix.net_size("indel"))
    edits = edits.select(*KEY, "itype", "size", "reads")
    if filled:
        every = F.explode(F.array(*(F.struct(F.lit(t).alias("itype"), F.lit(k).alias("size")) for t in "DI" for k in range(1, filled + 1)))).alias("x")
        none = profile.select(*KEY).distinct().select(*KEY, every).select(*KEY, "x.itype", "x.size", F.lit(0).cast("long").alias("reads"))
        edits = edits.unionByName(none)
    return edits.groupBy(*KEY, "itype", "size").agg(F.sum("reads").alias("reads"))


def in_frame(profile: DataFrame) -> DataFrame:
    """Reads in and out of frame and the percentage in frame; null where no read is edited."""
    edits = ix.with_parts(profile.filter("indel <> '-'"), "indel", _keeps=F.pmod(ix.net_size("indel"), F.lit(3)) == 0)
    got = edits.groupBy(*KEY).agg(
        F.sum(F.when(F.col("_keeps"), F.col("reads")).otherwise(0)).alias("in_frame"), F.sum(F.when(F.col("_keeps"), 0).otherwise(F.col("reads"))).alias("out_frame")
    )
    return got.withColumn("percent", F.col("in_frame") * 100.0 / (F.col("in_frame") + F.col("out_frame")))


def above(profile: DataFrame, size: int = 30) -> DataFrame:
    """Percentage of edited reads that are deletions of a net size above `size`."""
    edits = ix.with_parts(profile.filter("indel <> '-'"), "indel", _long=(ix.itype("indel") == "D") & (ix.net_size("indel") > size))
    return edits.groupBy(*KEY).agg((F.sum(F.when(F.col("_long"), F.col("reads")).otherwise(0)) * 100.0 / F.sum("reads")).alias("percent_above"))


def class_profile(profile: DataFrame) -> DataFrame:
    """Edited reads by class."""
    return profile.filter("indel <> '-'").groupBy(*KEY, ix.head("indel").alias("indel")).agg(F.sum("reads").alias("reads"))


def ranked(profile: DataFrame) -> DataFrame:
    """Edits with their rank by reads and name, falling."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("reads"), F.desc("indel"))
    return profile.filter("indel <> '-'").withColumn("place", F.row_number().over(order))


def top_n(profile: DataFrame, n: int) -> DataFrame:
    return ranked(profile).filter(F.col("place") <= n)


def highest_indel(profile: DataFrame) -> DataFrame:
    """The most frequent edit, or `-`."""
    best = F.max(F.when(F.col("indel") != "-", F.struct("reads", "indel")))
    return profile.groupBy(*KEY).agg(best.alias("b")).select(*KEY, F.coalesce("b.indel", F.lit("-")).alias("indel"))


def union_of_tops(profile: DataFrame, n: int = 20, lines: int = 10) -> DataFrame:
    """The edits that are among the n most frequent states of any sample, by oligo in the order of their mean percentage
    over all its samples (missing: 0), at most `lines`: (oligo_id, indel, mean_percent, place)."""
    counts = profile_counts(profile)
    top = counts.filter(F.col("place") <= n).select("oligo_id", "indel").distinct()
    samples = profile.groupBy("oligo_id").agg(F.count_distinct("sample").alias("_n"))
    sums = counts.join(top, ["oligo_id", "indel"], "left_semi").groupBy("oligo_id", "indel").agg(F.sum("percent_of_edited").alias("_s"))
    mean = sums.join(samples, "oligo_id").select("oligo_id", "indel", (F.col("_s") / F.col("_n")).alias("mean_percent"))
    order = Window.partitionBy("oligo_id").orderBy(F.desc("mean_percent"), F.desc("indel"))
    return mean.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= lines)


def side_by_side(profile: DataFrame, a: str, b: str, lines: int = 50) -> DataFrame:
    """The states of two samples of one oligo by rank, with their reads and share of edited reads, up to the shorter list
    and `lines`; `more` of each are left."""
    counts = profile_counts(profile).withColumn("n", F.count("*").over(Window.partitionBy(*KEY)))
    named = lambda s, x: counts.filter(F.col("sample") == s).select("oligo_id", "place", *(F.col(c).alias(f"{c}_{x}") for c in ("indel", "reads", "percent_of_edited", "n")))
    both = named(a, "a").join(named(b, "b"), ["oligo_id", "place"]).filter(F.col("place") <= lines)
    shown = F.least(F.lit(lines), "n_a", "n_b")
    return both.withColumn("more_a", F.col("n_a") - shown).withColumn("more_b", F.col("n_b") - shown).drop("n_a", "n_b")


def representative_reads(mapped: DataFrame) -> DataFrame:
    """One read of each indel from (sample, oligo_id, indel, oligo_indel, muts, seq, line_no).

    The last read that is clean throughout, else the first of a clean template, else the first.
    """
    clean = (F.col("oligo_indel") == "-") & (F.col("muts") == "-")
    rank = F.when(clean, 2).when(F.col("oligo_indel") == "-", 1).otherwise(0)
    order = F.struct(rank, F.when(clean, F.col("line_no")).otherwise(-F.col("line_no")))
    return mapped.groupBy(*KEY, "indel").agg(F.max_by("seq", order).alias("seq"))

