"""Reports over several samples or libraries: chosen samples in order, old against new, measured against predicted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutscape.functions import indel as ix
from cutscape.operators import divergence as dv
from cutscape.operators import profile as pr
from cutscape.operators.samples import average_rank, numbered, shuffled


def _patterns(flags: DataFrame, n: int) -> list[tuple[str, int]]:
    """(pattern, rows) of rows (oligo_id, k), k from 0 to n - 1: which of the k an oligo has, as a text of 0 and 1. There are
    as many patterns as combinations that occur; a report has few samples."""
    own = F.collect_set("k")
    marks = F.concat(*(F.when(F.array_contains(own, k), "1").otherwise("0") for k in range(n)))
    got = flags.groupBy("oligo_id").agg(marks.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("rows"))
    return [(r["pattern"], r["rows"]) for r in got.collect()]


def _kept_in_order(patterns: list[tuple[str, int]], n: int, share: float, given: bool = False) -> list[int]:
    """The k that count, in order: the first one, and each whose rows are no fewer than `share` of those that all before have.
    given: the patterns have one mark more, without which an oligo is not common."""
    kept: list[int] = []
    for k in range(n):
        must = [*kept, n] if given else kept
        common = sum(rows for p, rows in patterns if all(p[j] == "1" for j in must)) if must else 0
        if not k or sum(rows for p, rows in patterns if p[k] == "1") >= share * common:
            kept.append(k)
    return kept


def common_guides_in_order(totals: DataFrame, order: list[str], least: int, guides: DataFrame | None = None, share: float = 0.2) -> tuple[DataFrame, list[str]]:
    """(oligo_id) with more than `least` reads in every sample that counts, and the samples that were left out.

    Samples count in their order; one, other than the first, that has fewer guides than `share` of those still common is
    left out. One pass counts the oligos by the samples that they are in; that decides. totals: (sample, oligo_id, reads).
    """
    number = F.create_map(*(F.lit(x) for k, name in enumerate(order) for x in (name, k)))
    enough = totals.filter((F.col("reads") > least) & F.col("sample").isin(order)).select("oligo_id", number[F.col("sample")].alias("k")).distinct()
    told, own, n = enough, None, len(order)
    if guides is not None:  # one flag more: whether the guide is one of those given
        own = guides.select("oligo_id").distinct()
        told = enough.unionByName(own.select("oligo_id", F.lit(n).alias("k")))
    patterns = _patterns(told, n + (own is not None))
    kept = _kept_in_order(patterns, n, share, own is not None)
    some = enough.filter(F.col("k").isin(kept)).groupBy("oligo_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(kept)).select("oligo_id")
    return some if own is None else some.join(own, "oligo_id", "left_semi"), [name for k, name in enumerate(order) if k not in kept]


def common_pairs_in_order(reports: DataFrame, order: list[tuple[str, str]], value: str, least: int = 20, share: float = 0.75) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(oligo_id, `a$b` for each pair of samples that counts) of pairwise reports (a, b, oligo_id, edited_a, edited_b, value),
    for oligos with more than `least` edited reads on both sides in all of them; pairs come in order, and one with fewer
    rows than `share` of those still common is left out. One pass counts the oligos by the pairs that they have."""
    names = [f"{a}${b}" for a, b in order]
    number = F.create_map(*(F.lit(x) for k, name in enumerate(names) for x in (name, k)))
    good = reports.filter((F.col("edited_a") > least) & (F.col("edited_b") > least)).withColumn("pair", F.concat_ws("$", "a", "b")).filter(F.col("pair").isin(names))
    kept = _kept_in_order(_patterns(good.select("oligo_id", number[F.col("pair")].alias("k")), len(names)), len(names), share)
    wide = good.groupBy("oligo_id").pivot("pair", [names[k] for k in kept]).agg(F.first(value))
    return wide.na.drop(subset=[names[k] for k in kept]), [order[k] for k in range(len(order)) if k not in kept]


def common_samples(results: DataFrame) -> DataFrame:
    """Samples that every result (result, sample) has."""
    n = results.select("result").distinct().agg(F.count("*").alias("n"))
    by = results.select("result", "sample").distinct().groupBy("sample").agg(F.count("*").alias("k"))
    return by.join(F.broadcast(n), F.col("k") == F.col("n")).select("sample")  # n is one row


def missing_features(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Features (feature) of a stored model that are not computed; must be empty."""
    return stored.select("feature").distinct().join(computed.select("feature").distinct(), "feature", "left_anti")


def sample_stats(summary: DataFrame, profile: DataFrame, counted: Column) -> DataFrame:
    """(sample, oligo_id, accepted, percent, unedited, states, entropy, entropy_all) in one grouped pass over the profile; the
    entropy is that of edits that count, the other one of all edits."""
    w, edit = Window.partitionBy(*pr.KEY), F.col("indel") != "-"
    rows = profile.withColumn("_all", F.when(edit, F.col("reads"))).withColumn("_some", F.when(edit & counted, F.col("reads")))
    rows = rows.select("*", *(F.sum(c).over(w).alias(f"{c}_sum") for c in ("_all", "_some")))
    h = lambda c: F.coalesce(F.sum(-F.col(c) / F.col(f"{c}_sum") * F.log2(F.col(c) / F.col(f"{c}_sum"))), F.lit(0.0))
    got = rows.groupBy(*pr.KEY).agg(
        F.sum("reads").alias("accepted"), F.sum(F.when(edit, 0).otherwise(F.col("reads"))).alias("unedited"), (F.count("_all") + 1).alias("states"),
        h("_some").alias("entropy"), h("_all").alias("entropy_all"),
    )
    total = summary.groupBy(*pr.KEY).agg(F.sum("reads").alias("total"))
    zero = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    percent = (F.coalesce("accepted", F.lit(0)) * 100.0 / F.col("total")).alias("percent")
    return total.join(got, pr.KEY, "left").select(*pr.KEY, zero("accepted", 0), percent, zero("unedited", 0), zero("states", 1), zero("entropy", 0.0), zero("entropy_all", 0.0))


def full_pairwise(summary: DataFrame, profile: DataFrame, pairs: DataFrame, large_insertions: bool = False) -> DataFrame:
    """One row for each oligo and pair of samples (a, b): reads, states, unedited reads, percentages accepted, divergence with
    and without unedited reads, first difference and common edits of the tops with their shares, entropies, overlap.

    Divergences and tops leave names that begin with `I1` out, unless `large_insertions`; the entropy is given with and
    without them. Divergences are null where no counted indel is left; tops are -1 where a side has no edit. One grouped
    pass over the samples' profiles and one over the pairs'.
    """
    keys = ["a", "b", "oligo_id"]
    counted = F.lit(True) if large_insertions else ~ix.large_insertion_name("indel")
    stats = sample_stats(summary, profile, counted)

    def side(s: str) -> DataFrame:
        named = [F.col(c).alias(f"{c}_{s}") for c in ("accepted", "percent", "unedited", "states", "entropy", "entropy_all")]
        return stats.join(F.broadcast(pairs), stats["sample"] == pairs[s]).select(*keys, *named)

    both = dv.full_pairs(profile.filter(counted), pairs)
    out = side("a").join(side("b"), keys).join(both, keys, "left")
    none = {"first_difference": 0, "overlap": 0.0, **{c: -1 for c in both.columns if c.startswith("common")}, **{c: -1.0 for c in both.columns if c.startswith("percent")}}
    return out.na.fill(none)


def _pairs_of(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(a, b, oligo_id, indel, p, q) of two libraries' profiles (library, oligo_id, indel, reads) by an id both share."""
    pairs = rows.sparkSession.createDataFrame([(left, right)], "a string, b string")
    return dv.paired(rows.withColumnRenamed("library", "sample"), pairs)


def mean_within(profile: DataFrame, value: str = "symmetric_kl") -> DataFrame:
    """Mean divergence over all pairs of samples of each library and oligo; profile: (library, sample, oligo_id, indel, reads)."""
    samples = profile.select("library", "sample").distinct()
    other = samples.select("library", F.col("sample").alias("b"))
    pairs = samples.withColumnRenamed("sample", "a").join(other, "library").filter("a < b").select("a", "b")  # a dimension
    got = dv.kl(dv.paired(profile.select("sample", "oligo_id", "indel", "reads"), pairs))
    of = samples.select(F.col("sample").alias("a"), "library")
    return got.join(F.broadcast(of), "a").groupBy("library", "oligo_id").agg(F.avg(value).alias(value))


def old_new(profile: DataFrame, pairs: DataFrame, least: int = 100, seeds: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Divergences between libraries for pairs of ids (old_id, new_id), plain and by class, next to those of pairs that a
    shuffle puts together: (old_id, new_id, edited_old, edited_new, in_frame_old, in_frame_new, kl, class_kl, within_old,
    within_new, and for each seed the other pair's ids and kl).

    profile: (library 'old' or 'new', sample, oligo_id, indel, reads). Pairs with fewer than `least` edited reads on a side
    don't count. The shuffle orders the pairs by a hash; the pair at a place meets the one at the same place of the plain
    order, by number and without a sort of all in one task for more than the ids.
    """
    profile = profile.persist()  # read by each comparison below
    named = pairs.select(F.col("old_id").alias("key"), "old_id", "new_id")
    of = F.when(F.col("library") == "old", F.col("old_id")).otherwise(F.col("new_id"))
    rows = profile.groupBy("library", "oligo_id", "indel").agg(F.sum("reads").alias("reads"))
    mine = named.withColumn("library", F.explode(F.array(F.lit("old"), F.lit("new")))).withColumn("oligo_id", of)
    own = rows.join(mine, ["library", "oligo_id"]).select("library", F.col("key").alias("oligo_id"), "indel", "reads")
    edited = own.filter("indel <> '-'").groupBy("oligo_id").pivot("library", ["old", "new"]).agg(F.sum("reads")).na.fill(0)
    good = edited.filter((F.col("old") >= least) & (F.col("new") >= least)).select("oligo_id", F.col("old").alias("edited_old"), F.col("new").alias("edited_new"))
    own, good = own.join(good.select("oligo_id"), "oligo_id", "left_semi").persist(), good.persist()
    frame = pr.in_frame(own.withColumnRenamed("library", "sample")).groupBy("oligo_id").pivot("sample", ["old", "new"]).agg(F.first("percent"))
    classes = pr.class_profile(own.withColumnRenamed("library", "sample")).withColumnRenamed("sample", "library")
    within = mean_within(profile).join(mine, ["library", "oligo_id"]).groupBy("key").pivot("library", ["old", "new"]).agg(F.first("symmetric_kl"))
    out = good.join(frame.select("oligo_id", F.col("old").alias("in_frame_old"), F.col("new").alias("in_frame_new")), "oligo_id", "left")
    out = out.join(dv.kl(_pairs_of(own, "old", "new")).select("oligo_id", F.col("symmetric_kl").alias("kl")), "oligo_id", "left")
    out = out.join(dv.kl(_pairs_of(classes, "old", "new")).select("oligo_id", F.col("symmetric_kl").alias("class_kl")), "oligo_id", "left")
    out = out.join(within.select(F.col("key").alias("oligo_id"), F.col("old").alias("within_old"), F.col("new").alias("within_new")), "oligo_id", "left")
    for seed in seeds:
        plain = numbered(good.select("oligo_id"), ["oligo_id"], "place")
        mixed = shuffled(good.select(F.col("oligo_id").alias(f"other_{seed}")), f"other_{seed}", seed)
        met = plain.join(mixed, "place").drop("place")
        by = met.select(F.col("oligo_id").alias("_for"), F.col(f"other_{seed}").alias("oligo_id"))
        new = own.filter("library = 'new'").join(by, "oligo_id").select("library", F.col("_for").alias("oligo_id"), "indel", "reads")
        both = own.filter("library = 'old'").unionByName(new)
        out = out.join(met, "oligo_id", "left").join(dv.kl(_pairs_of(both, "old", "new")).select("oligo_id", F.col("symmetric_kl").alias(f"other_kl_{seed}")), "oligo_id", "left")
    return out.join(named, F.col("oligo_id") == F.col("key")).drop("key", "oligo_id")


def measured_and_predicted(measured: DataFrame, predicted: DataFrame) -> DataFrame:
    """(oligo_id, edited, in_frame, predicted_in_frame, kl) of profiles (oligo_id, indel, reads), the predicted ones as shares."""
    rows = lambda df, s: df.select(F.lit(s).alias("sample"), "oligo_id", "indel", F.col("reads").cast("double").alias("reads"))
    both = rows(measured, "measured").unionByName(rows(predicted, "predicted"))
    pairs = measured.sparkSession.createDataFrame([("measured", "predicted")], "a string, b string")
    frame = pr.in_frame(both).groupBy("oligo_id").pivot("sample", ["measured", "predicted"]).agg(F.first("percent"))
    edited = measured.filter("indel <> '-'").groupBy("oligo_id").agg(F.sum("reads").alias("edited"))
    got = dv.kl(dv.paired(both, pairs)).select("oligo_id", F.col("symmetric_kl").alias("kl"))
    frame = frame.select("oligo_id", F.col("measured").alias("in_frame"), F.col("predicted").alias("predicted_in_frame"))
    return edited.join(frame, "oligo_id").join(got, "oligo_id", "left")


def by_thresholds(rows: DataFrame, x: str, y: str, reads: str, thresholds: tuple[int, ...] = (20, 50, 100, 200, 500, 1000)) -> DataFrame:
    """Pearson and Spearman correlations of rows with more reads than each threshold."""
    told = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col(reads) > F.col("threshold"))
    told = told.withColumn("_x", average_rank(x, ["threshold"])).withColumn("_y", average_rank(y, ["threshold"]))
    return told.groupBy("threshold").agg(F.corr(x, y).alias("pearson"), F.corr("_x", "_y").alias("spearman"), F.count("*").alias("n"))


def mean_lines(lines: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """Mean of the lines (x0, y0, x1, y1) of each group, and its value at some places: (by, x0, y0, x1, y1, values)."""
    mean = lines.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("x0", "y0", "x1", "y1")))
    slope = F.when(F.col("x1") == F.col("x0"), 0.0).otherwise((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    value = lambda x: F.col("y0") + (x - F.col("x0")) * slope
    return mean.withColumn("values", F.array(*(value(F.lit(float(x))) for x in at)))


def endogenous(measured: DataFrame, ours: DataFrame, matches: DataFrame, least_log: float = 2.0, most_long: float = 50.0) -> DataFrame:
    """(guide, edited, log_reads, above, kl, in_frame, our_in_frame) of endogenous profiles (guide, indel, reads) against the
    sum of our profiles (oligo_id, indel, reads) of the matching oligos (guide, oligo_id).

    above: percentage of edited reads that are deletions of more than 30; in-frame percentages only for guides with more
    than 10^least_log edited reads of ours and fewer than `most_long` percent of such deletions.
    """
    own = ours.join(matches, "oligo_id").groupBy("guide", "indel").agg(F.sum("reads").alias("reads"))
    rows = lambda df, s: df.select(F.lit(s).alias("sample"), F.col("guide").alias("oligo_id"), "indel", "reads")
    both = rows(measured, "endogenous").unionByName(rows(own, "synthetic"))
    pairs = measured.sparkSession.createDataFrame([("endogenous", "synthetic")], "a string, b string")
    edited = own.filter("indel <> '-'").groupBy(F.col("guide").alias("oligo_id")).agg(F.sum("reads").alias("edited"))
    frame = pr.in_frame(both).groupBy("oligo_id").pivot("sample", ["endogenous", "synthetic"]).agg(F.first("percent"))
    long = pr.above(both.filter("sample = 'endogenous'")).select("oligo_id", F.col("percent_above").alias("above"))
    out = edited.withColumn("log_reads", F.log10(F.col("edited") + 0.5)).join(long, "oligo_id").join(frame, "oligo_id")
    out = out.join(dv.kl(dv.paired(both, pairs)).select("oligo_id", F.col("symmetric_kl").alias("kl")), "oligo_id", "left")
    told: Column = (F.col("log_reads") > least_log) & (F.col("above") < most_long)
    return out.select(
        F.col("oligo_id").alias("guide"), "edited", "log_reads", "above", "kl",
        F.when(told, F.col("endogenous")).alias("in_frame"), F.when(told, F.col("synthetic")).alias("our_in_frame"),
    )


def runs_to_use(runs: DataFrame, cell: str = "K562", first: str = "d11", else_: str = "48hr", control: str = "WT") -> DataFrame:
    """(location, runs, control_runs): the runs (location, cell, time, run) at the preferred time point, else at the other."""
    of = lambda t: F.array_sort(F.collect_list(F.when(F.col("time") == t, F.col("run"))))
    got = runs.filter(F.col("cell") == cell).groupBy("location").agg(of(first).alias("x"), of(else_).alias("y"), of(control).alias("control_runs"))
    return got.select("location", F.when(F.size("x") > 0, F.col("x")).otherwise(F.col("y")).alias("runs"), "control_runs")


def top_templates(reads: DataFrame, spacers: DataFrame) -> DataFrame:
    """(location, seq, reads, pam_idx, direction): the most common perfect read of each location (location, seq), the larger
    one of several, with the PAM that its spacer (location, spacer) gives: a spacer that ends with GG lies forward, one that
    begins with CC in reverse. Null where the spacer doesn't stand in the read or says both or neither.
    """
    counts = reads.groupBy("location", "seq").agg(F.count("*").alias("n"))
    best = counts.groupBy("location").agg(F.max(F.struct("n", "seq")).alias("b")).select("location", F.col("b.seq").alias("seq"), F.col("b.n").alias("reads"))
    told = best.join(spacers, "location").withColumn("_at", F.instr("seq", F.col("spacer")) - 1)
    ends, begins = F.col("spacer").endswith("GG"), F.col("spacer").startswith("CC")
    way = F.when(F.col("_at") < 0, None).when(begins & ~ends, "REVERSE").when(ends & ~begins, "FORWARD")
    return told.select("location", "seq", "reads", F.when(way == "REVERSE", F.col("_at") + 3).when(way == "FORWARD", F.col("_at") + 20).alias("pam_idx"), way.alias("direction"))
