"""Repeats with mismatches: targets whose repeat was changed in one copy, next to the target that they were made from."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutscape.functions import indel as ix
from cutscape.functions import sequence as sq
from cutscape.operators.align import aligned, dealt_pairs
from cutscape.operators.targets import runs


REPEAT = T.StructType([T.StructField(c, T.IntegerType()) for c in ("left", "right", "size")])


@F.pandas_udf(REPEAT)
def longest_repeat(seqs: pd.Series) -> pd.DataFrame:
    """struct<left, right, size>: the longest stretch that stands in a sequence twice, at the smallest distance of several,
    the first there; -1, -1, 0 where there is none. Stretches may overlap; the distance leaves two letters at least."""
    out = np.tile(np.array([-1, -1, 0]), (len(seqs), 1))
    same: dict[int, list[int]] = {}
    text = [(s or "").encode() for s in seqs]
    for k, t in enumerate(text):
        same.setdefault(len(t), []).append(k)
    for n, rows in same.items():
        i, j = np.triu_indices(n, 1)
        i, j = i[j - i < n - 1], j[j - i < n - 1]
        order = np.lexsort((i, j - i))  # the nearest first
        i, j = i[order], j[order]
        for at in range(0, len(rows) if len(i) else 0, 64):
            part = np.array(rows[at : at + 64])
            code = np.frombuffer(b"".join(text[k] for k in part), np.uint8).reshape(-1, n)
            length = runs(code[:, :, None] == code[:, None, :])[0][:, i, j]
            best = length.argmax(1)
            size = length[np.arange(len(part)), best]
            out[part] = np.where((size > 0)[:, None], np.stack([i[best], j[best], size], 1), [-1, -1, 0])
    return pd.DataFrame(out, columns=["left", "right", "size"]).astype("int32")


def nearest(changed: DataFrame, originals: DataFrame, group: str = "comment") -> DataFrame:
    """changed (oligo_id, seq, group) with the original of the same group (oligo_id, seq, group, ord) that differs least from
    it, the first one of several: (oligo_id, seq, original_id, original_seq, apart)."""
    o = originals.select(group, F.col("oligo_id").alias("original_id"), F.col("seq").alias("original_seq"), "ord")
    both = changed.join(o, group).withColumn("apart", sq.hamming(F.col("seq"), F.col("original_seq")))
    best = both.groupBy("oligo_id", "seq").agg(F.min(F.struct("apart", "ord", "original_id", "original_seq")).alias("m"))
    return best.select("oligo_id", "seq", "m.original_id", "m.original_seq", "m.apart")


def expected_reads(pairs: DataFrame) -> DataFrame:
    """nearest()'s rows with the original's longest repeat, both copies of it in the changed target, and the reads that its
    deletion makes: of the original, with the left copy, with the right copy, and with each mixture of the copies."""
    own, of = F.col("seq"), F.col("original_seq")
    rows = pairs.withColumn("_r", longest_repeat("original_seq"))
    left, right, n = F.col("_r.left"), F.col("_r.right"), F.col("_r.size")
    cut = lambda s, a, b: sq.part(s, a, b)
    a, b = cut(own, left, left + n), cut(own, right, right + n)
    head, end = cut(own, F.lit(0), left), cut(own, right + n, F.length(own))
    mixed = sq.merged_mismatches(a, b)
    return rows.select(
        "oligo_id", "original_id", sq.hamming(a, b).alias("mismatches"), left.alias("left"), right.alias("right"), cut(of, left, left + n).alias("original_repeat"),
        a.alias("left_copy"), b.alias("right_copy"), F.concat(cut(of, F.lit(0), left), cut(of, right, F.length(of))).alias("original_read"),
        F.concat(cut(own, F.lit(0), left + n), end).alias("left_read"), F.concat(head, cut(own, right, F.length(own))).alias("right_read"),
        F.transform(mixed, lambda m: F.struct(m.alias("repeat"), F.concat(head, m, end).alias("read"))).alias("mixed_reads"),
    )


def counted(changed: DataFrame, originals: DataFrame, targets: DataFrame, profile: DataFrame | Callable, group: str = "comment", reach: int = 4) -> DataFrame:
    """The rows that shares() takes, from changed targets and their originals (see nearest()) in one plan.

    Each changed target meets its nearest original, the reads of the repeat's deletion are made, aligned with the target that
    they belong to (oligo_id, seq, cut_idx, reverse) and so named, and the profile's reads (oligo_id, indel, reads) of these
    names are counted, 0 where there are none. Totals are the edited reads. Targets whose original has no repeat, or whose
    deletion gets no name, are left out.

    profile: a table, or where its rows are many more than the names that are asked for and can be told where they are made,
    what makes of (oligo_id, asked), the names asked for of each target, the reads of these and the totals (oligo_id, total).
    """
    rows = expected_reads(nearest(changed, originals, group)).withColumn("_x", F.explode(F.array(F.lit(0)))).filter("left >= 0").drop("_x")
    kinds = [("original", "original_id", F.col("original_read")), *((k, "oligo_id", F.col(f"{k}_read")) for k in ("left", "right"))]
    kinds += [(f"mixed{k + 1}", "oligo_id", F.get("mixed_reads", F.lit(k))["read"]) for k in (0, 1)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(of).alias("of"), read.alias("read")) for k, of, read in kinds)))
    told = rows.select("oligo_id", each.alias("x")).select("oligo_id", "x.*").filter("read is not null")
    own = told.hint("merge").join(targets.select(F.col("oligo_id").alias("of"), F.col("seq").alias("target"), "cut_idx", "reverse"), "of")
    own = dealt_pairs(own, ["oligo_id"])
    named = own.select("oligo_id", "kind", "of", "reverse", F.explode(F.array(aligned(F.col("target"), F.col("cut_idx"), F.col("reverse"), F.col("read"), reach)["indel"])).alias("indel"))
    if callable(profile):
        named = named.persist()  # asked for, and then counted
        reads, total = profile(named.groupBy(F.col("of").alias("oligo_id")).agg(F.collect_set("indel").alias("asked")))
    else:
        reads, total = profile, profile.filter("indel <> '-'").groupBy("oligo_id").agg(F.sum("reads").alias("total"))
    reads = reads.groupBy(F.col("oligo_id").alias("of"), "indel").agg(F.sum("reads").alias("reads"))
    with_reads = named.join(reads.hint("merge"), ["of", "indel"], "left")
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    n = [F.coalesce(of(k, "reads"), F.lit(0)).alias(f"{k}_reads") for k, *_ in kinds]
    got = with_reads.groupBy("oligo_id").agg(of("original", "indel").alias("indel"), of("original", "reverse").alias("reverse"), *n).filter("indel is not null")
    out = rows.select("oligo_id", "original_id", "left_copy", "right_copy", "original_repeat").join(got.hint("merge"), "oligo_id").join(total.hint("merge"), "oligo_id")
    return out.join(total.select(F.col("oligo_id").alias("original_id"), F.col("total").alias("original_total")).hint("merge"), "original_id").drop("original_id")


def shares(counts: DataFrame) -> DataFrame:
    """Percentages of edited reads of the changed target and of its original, for guides that fit.

    counts: (oligo_id, indel, reverse, original_reads, original_total, left_reads, right_reads, mixed1_reads, mixed2_reads,
    total, left_copy, right_copy, original_repeat). Left and right change places on the reverse strand. Only repeats that
    the original's edit leaves ambiguous count; their distance is what lies between the copies.
    """
    turn = lambda a, b: F.when(F.col("reverse"), F.col(b)).otherwise(F.col(a)) * 100.0 / F.col("total")
    rows = ix.with_parts(counts, "indel", _l=ix.detail("indel", "L"), _r=ix.detail("indel", "R"), size=ix.detail("indel", "C")).filter("size <> 0")
    every = F.col("left_reads") + F.col("right_reads") + F.col("mixed1_reads") + F.col("mixed2_reads")
    return rows.select(
        "oligo_id", "size", (F.col("_r") - F.col("_l") - 2 * F.col("size")).alias("distance"), turn("left_reads", "right_reads").alias("left"), turn("right_reads", "left_reads").alias("right"),
        turn("mixed1_reads", "mixed2_reads").alias("mixed1"), turn("mixed2_reads", "mixed1_reads").alias("mixed2"), (F.col("original_reads") * 100.0 / F.col("original_total")).alias("original"),
        (every * 100.0 / F.col("total")).alias("all"), sq.hamming(F.col("left_copy"), F.col("right_copy")).alias("mismatches"),
        sq.mismatch_pair(F.col("original_repeat"), F.col("left_copy"), F.col("right_copy")).alias("first_mismatch"),
        sq.mismatch_pair(F.col("original_repeat"), F.col("left_copy"), F.col("right_copy"), last=True).alias("last_mismatch"), sq.matched_gc(F.col("left_copy"), F.col("right_copy")).alias("gc"),
    )


def slopes(rows: DataFrame, low: int = 6, high: int = 15) -> DataFrame:
    """Lines through the origin between shares, by number of mismatches, for repeats of low to high letters."""
    some = rows.filter(F.col("size").between(low, high))
    kinds = (("original", "left"), ("original", "right"), ("original", "all"), ("left", "right"))
    slope = [(F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias(f"{y}_by_{x}") for x, y in kinds]
    return some.groupBy("mismatches").agg(*slope, F.count("*").alias("oligos"))
