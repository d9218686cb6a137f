"""Divergences between profiles of one oligo: pairs (pair, oligo_id, indel, p, q) in one aggregation, no driver loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutscape.functions import indel as ix
from cutscape.operators import profile as pr

MISSING = 0.5  # count of an indel that the other profile alone has


def paired(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, oligo_id, indel, p, q): the two samples' reads side by side, null where one lacks the indel.

    pairs: (a, b) of sample names, a small dimension. Only oligos that both samples have. The profile is read once: each row
    meets the pairs that its sample is in, and is shuffled only if profiles aren't dealt out by oligo (profile.by_oligo) yet.
    """
    sides = pairs.select(F.col("a").alias("sample"), "a", "b").unionByName(pairs.filter("a <> b").select(F.col("b").alias("sample"), "a", "b"))
    of = lambda side: F.when(F.col("sample") == F.col(side), F.col("reads"))
    met = profile.select("sample", "oligo_id", "indel", "reads").join(F.broadcast(sides), "sample")
    both = met.select("a", "b", "oligo_id", "indel", of("a").alias("p"), of("b").alias("q")).groupBy("a", "b", "oligo_id", "indel").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    w = Window.partitionBy("a", "b", "oligo_id")
    return both.withColumn("_p", F.count("p").over(w)).withColumn("_q", F.count("q").over(w)).filter("_p > 0 and _q > 0").drop("_p", "_q")


def _sides(pairs: DataFrame, ignore_null: bool) -> DataFrame:
    counted = (F.coalesce("p", F.lit(0)) > 0) | (F.coalesce("q", F.lit(0)) > 0)
    if ignore_null:
        counted = counted & (F.col("indel") != "-")
    w = Window.partitionBy("a", "b", "oligo_id")
    of = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, F.col(c).cast("double")).otherwise(F.lit(MISSING))
    rows = pairs.filter(counted).withColumn("_x", of("p")).withColumn("_y", of("q"))
    return rows.withColumn("_P", F.col("_x") / F.sum("_x").over(w)).withColumn("_Q", F.col("_y") / F.sum("_y").over(w))


def kl(pairs: DataFrame, ignore_null: bool = True) -> DataFrame:
    """(a, b, oligo_id, kl, symmetric_kl) to base 2. Oligos without any counted indel have no row."""
    one = lambda p, q: p * F.log2(p / q)
    p, q = F.col("_P"), F.col("_Q")
    return _sides(pairs, ignore_null).groupBy("a", "b", "oligo_id").agg(
        F.sum(one(p, q)).alias("kl"), (F.sum(one(p, q) + one(q, p)) * 0.5).alias("symmetric_kl")
    )


def overlap(pairs: DataFrame, ignore_null: bool = True) -> DataFrame:
    """Sum of the smaller percentages; 0 where one has no counted read."""
    if ignore_null:
        pairs = pairs.withColumn("p", F.when(F.col("indel") != "-", F.col("p"))).withColumn("q", F.when(F.col("indel") != "-", F.col("q")))
    w = Window.partitionBy("a", "b", "oligo_id")
    shared = F.least(F.col("p") * 100.0 / F.sum("p").over(w), F.col("q") * 100.0 / F.sum("q").over(w))
    shared = F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), shared)
    return pairs.withColumn("_s", shared).groupBy("a", "b", "oligo_id").agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("overlap"))


def entropy(profile: DataFrame, ignore_null: bool = True) -> DataFrame:
    """Shannon entropy to base 2; 0 for a profile without counted reads."""
    counted = F.when((F.col("reads") > 0) & ((F.col("indel") != "-") if ignore_null else F.lit(True)), F.col("reads"))
    rows = profile.withColumn("_c", counted)
    share = F.col("_c") / F.sum("_c").over(Window.partitionBy(*pr.KEY))
    rows = rows.withColumn("_h", -share * F.log2(share))
    return rows.groupBy(*pr.KEY).agg(F.coalesce(F.sum("_h"), F.lit(0.0)).alias("entropy"))


def mean_by_oligo(divergence: DataFrame, value: str) -> DataFrame:
    return divergence.groupBy("oligo_id").agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("pairs"))


def median_matrix(divergence: DataFrame, value: str) -> DataFrame:
    """Median by pair of samples, both ways round."""
    med = divergence.groupBy("a", "b").agg(F.percentile(value, 0.5).alias("median"), F.count("*").alias("oligos"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return med.select(F.explode(ways).alias("_x"), "median", "oligos").select("_x.a", "_x.b", "median", "oligos")


def pairwise_report(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each oligo and pair of samples: divergences, overlap, reads, entropies, in-frame percentages.

    One grouped pass over the paired rows, which hold all of both profiles.
    """
    keys = ["a", "b", "oligo_id"]
    w = Window.partitionBy(*keys)
    edit = F.col("indel") != "-"
    rows = paired(profile, pairs).filter((F.coalesce("p", F.lit(0)) > 0) | (F.coalesce("q", F.lit(0)) > 0))
    rows = rows.withColumn("_keeps", F.pmod(ix.net_size("indel"), F.lit(3)) == 0)
    for c, n in (("p", "a"), ("q", "b")):
        rows = rows.withColumn(f"_{n}", F.when(edit & (F.col(c) > 0), F.col(c)))  # edited reads of the sample
        rows = rows.withColumn(f"_x{n}", F.when(edit, F.coalesce(F.col(f"_{n}").cast("double"), F.lit(MISSING))))
    rows = rows.select("*", *(F.sum(c).over(w).alias(f"{c}_sum") for c in ("_a", "_b", "_xa", "_xb")))
    one = lambda p, q: p * F.log2(p / q)
    p, q = F.col("_xa") / F.col("_xa_sum"), F.col("_xb") / F.col("_xb_sum")
    share = {n: F.col(f"_{n}") / F.col(f"_{n}_sum") for n in "ab"}
    each = []
    for n in "ab":
        each += [F.coalesce(F.sum(F.col(f"_{n}")), F.lit(0)).alias(f"edited_{n}"), F.coalesce(F.sum(-share[n] * F.log2(share[n])), F.lit(0.0)).alias(f"entropy_{n}")]
        each.append((F.sum(F.when(F.col("_keeps"), F.col(f"_{n}")).when(F.col(f"_{n}").isNotNull(), 0)) * 100.0 / F.sum(F.col(f"_{n}"))).alias(f"in_frame_{n}"))
    both = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.least(share["a"], share["b"]) * 100.0)
    out = rows.groupBy(*keys).agg(F.sum(one(p, q)).alias("kl"), (F.sum(one(p, q) + one(q, p)) * 0.5).alias("symmetric_kl"), F.coalesce(F.sum(both), F.lit(0.0)).alias("overlap"), *each)
    return out.select(*keys, "edited_a", "edited_b", "kl", "symmetric_kl", "overlap", "entropy_a", "in_frame_a", "entropy_b", "in_frame_b")


TOPS = (3, 5, 10)


def _placed(rows: DataFrame, w) -> DataFrame:
    """paired() rows with each edit's place on both sides by reads and name, falling (_pa, _pb), and the sides' numbers of edits
    (_na, _nb) and edited reads (_ta, _tb)."""
    for c, n in (("p", "a"), ("q", "b")):
        there = (F.col("indel") != "-") & F.col(c).isNotNull()
        own = F.row_number().over(w.orderBy(F.desc(there), F.desc(c), F.desc("indel")))
        rows = rows.select("*", F.when(there, own).alias(f"_p{n}"), F.sum(there.cast("long")).over(w).alias(f"_n{n}"), F.sum(F.when(there, F.col(c))).over(w).alias(f"_t{n}"))
    return rows


def _top_columns(tops: tuple[int, ...]) -> list[Column]:
    """Aggregates of _placed() rows: first rank that differs (0: none), shares and common edits of the tops, up to the shorter
    list; null where a side has no edit."""
    least = F.least("_na", "_nb")
    some = F.max(least) > 0
    apart = (F.col("_pa") <= least) & ~F.col("_pa").eqNullSafe(F.col("_pb"))
    out = [F.when(some, F.coalesce(F.min(F.when(apart, F.col("_pa"))), F.lit(0))).alias("first_difference")]
    for k in tops:
        for c, n in (("p", "a"), ("q", "b")):
            share = F.when(F.col(f"_p{n}") <= F.least(F.lit(k), least), F.col(c)).otherwise(0) * 100.0 / F.col(f"_t{n}")
            out.append(F.when(some, F.sum(share)).alias(f"percent_{n}_{k}"))
    both = F.greatest("_pa", "_pb")
    both = F.when(F.col("_pa").isNotNull() & F.col("_pb").isNotNull(), both)
    return out + [F.when(some, F.count(F.when(both <= F.least(F.lit(k), least), F.lit(1)))).alias(f"common_{k}") for k in tops]


def compare_tops(profile: DataFrame, pairs: DataFrame, tops: tuple[int, ...] = TOPS) -> DataFrame:
    """For each oligo of two samples (a, b) with edits in both: first rank that differs (0: none), common edits and shares
    of the tops. Ranks are compared up to the shorter list; pairs is a small dimension. One grouped pass over paired()."""
    keys = ["a", "b", "oligo_id"]
    rows = _placed(paired(profile, pairs), Window.partitionBy(*keys))
    return rows.groupBy(*keys).agg(*_top_columns(tops)).filter(F.col("first_difference").isNotNull())


def full_pairs(profile: DataFrame, pairs: DataFrame, tops: tuple[int, ...] = TOPS) -> DataFrame:
    """(a, b, oligo_id, kl_with_null, kl_without_null, overlap, tops) in one grouped pass over paired()."""
    keys = ["a", "b", "oligo_id"]
    w = Window.partitionBy(*keys)
    rows = _placed(paired(profile, pairs), w)
    edit = F.col("indel") != "-"
    counted = (F.coalesce("p", F.lit(0)) > 0) | (F.coalesce("q", F.lit(0)) > 0)
    of = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, F.col(c).cast("double")).otherwise(F.lit(MISSING))
    for name, on in (("all", counted), ("edit", counted & edit)):
        rows = rows.select("*", F.when(on, of("p")).alias(f"_x_{name}"), F.when(on, of("q")).alias(f"_y_{name}"))
        rows = rows.select("*", F.sum(f"_x_{name}").over(w).alias(f"_X_{name}_sum"), F.sum(f"_y_{name}").over(w).alias(f"_Y_{name}_sum"))
    one = lambda p, q: p * F.log2(p / q)
    kls = []
    for name, label in (("all", "kl_with_null"), ("edit", "kl_without_null")):
        p, q = F.col(f"_x_{name}") / F.col(f"_X_{name}_sum"), F.col(f"_y_{name}") / F.col(f"_Y_{name}_sum")
        kls.append((F.sum(one(p, q) + one(q, p)) * 0.5).alias(label))
    shared = F.when(edit & F.col("p").isNotNull() & F.col("q").isNotNull(), F.least(F.col("p") * 100.0 / F.col("_ta"), F.col("q") * 100.0 / F.col("_tb")))
    return rows.groupBy(*keys).agg(*kls, F.coalesce(F.sum(shared), F.lit(0.0)).alias("overlap"), *_top_columns(tops))


def _profile_sums(rows: pd.DataFrame, names: list) -> tuple[list, list[np.ndarray], dict[str, np.ndarray]]:
    """Ids of a block of profiles (id, indel, reads), its tables by profile and indel (reads, log2 of reads, presence), and sums."""
    ids = sorted(set(rows["id"]))
    at, of = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(names)}
    reads = np.zeros((len(ids), len(names)))
    reads[[at[x] for x in rows["id"]], [of[x] for x in rows["indel"]]] = rows["reads"]
    there = reads > 0
    logs = np.log2(np.where(there, reads, 1.0))
    return ids, [reads, logs, there.astype(float)], {"s": reads.sum(1), "n": there.sum(1), "l": logs.sum(1), "e": (reads * logs).sum(1)}


def block_divergence(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(a, b, symmetric_kl) of all pairs of two blocks of profiles (id, indel, reads), by five products of tables.

    A pair's divergence needs sums over the indels that both have; what one of them alone has follows from its own sums.
    """
    names = sorted(set(a["indel"]) | set(b["indel"]))
    (ids, (p, lp, tp), x), (others, (q, lq, tq), y) = _profile_sums(a, names), _profile_sums(b, names)
    common = tp @ tq.T
    h, lh = MISSING, np.log2(MISSING)
    own = {k: v[:, None] for k, v in x.items()}
    total_p, total_q = own["s"] + h * (y["n"] - common), y["s"] + h * (own["n"] - common)
    pp, qq = own["e"] + (y["n"] - common) * h * lh, y["e"] + (own["n"] - common) * h * lh
    pq = p @ lq.T + (own["s"] - p @ tq.T) * lh + h * (y["l"] - tp @ lq.T)
    qp = lp @ q.T + (y["s"] - tp @ q.T) * lh + h * (own["l"] - lp @ tq.T)
    ratio = np.log2(total_q) - np.log2(total_p)
    value = 0.5 * ((pp - pq) / total_p + ratio + (qq - qp) / total_q - ratio)
    i, j = np.indices(value.shape).reshape(2, -1)
    return pd.DataFrame({"a": np.array(ids, object)[i], "b": np.array(others, object)[j], "symmetric_kl": value.reshape(-1)})


def divergence_matrix(left: DataFrame, right: DataFrame, block: int = 64) -> DataFrame:
    """(a, b, symmetric_kl) of every profile of one table (id, indel, reads) with every one of another, edited reads alone.

    Profiles are dealt by hash to blocks of about `block`; each two blocks meet in one group as sparse tables. Profiles without
    edited reads have no row. Join the two ids' places to order the matrix.
    """
    rows = [df.filter("indel <> '-' and reads > 0").groupBy("id", "indel").agg(F.sum("reads").cast("double").alias("reads")) for df in (left, right)]
    n = [max(1, -(-df.select("id").distinct().count() // block)) for df in rows]
    part = lambda k: F.pmod(F.xxhash64("id"), F.lit(n[k])).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(n[k] - 1)))
    x = rows[0].select("*", part(0).alias("x"), every(1).alias("y"))
    y = rows[1].select(*(F.col(c).alias(f"{c}_b") for c in ("id", "indel", "reads")), part(1).alias("y"), every(0).alias("x"))  # own names: both may be of one table

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.rename(columns={f"{c}_b": c for c in ("id", "indel", "reads")})
        return block_divergence(a, b) if len(a) and len(b) else pd.DataFrame({"a": [], "b": [], "symmetric_kl": []}).astype({"a": object, "b": object})

    return x.groupBy("x", "y").cogroup(y.groupBy("x", "y")).applyInPandas(run, "a string, b string, symmetric_kl double")


def rounded(c: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(c)
