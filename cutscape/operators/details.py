"""Details of edits and repeats: sequences of dominant edits, the best repeat of each oligo, control templates, library counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutscape.functions import indel as ix
from cutscape.functions import sequence as sq
from cutscape.operators import profile as pr

KEY = pr.KEY


def dominant_details(profile: DataFrame, targets: DataFrame, every: bool = True) -> DataFrame:
    """Of each edit (or only the most frequent one) by oligo: its ends, ambiguity, kind, size and reads, the reads of all
    edits, the repeat that explains a pure deletion and the letters that it took, on the guide's strand.

    targets: (oligo_id, seq, pam_idx, direction). Oligos without an edited read have no row.
    """
    rows = pr.ranked(profile).withColumn("total", F.sum("reads").over(Window.partitionBy(*KEY)))
    rows = rows if every else rows.filter("place = 1")
    rows = ix.with_parts(rows, "indel", p=ix.parsed("indel"))
    seq = lambda a, b: sq.cut_relative(F.col("seq"), F.col("pam_idx"), F.col("direction"), a, b)
    l, r, c = F.col("p.l"), F.col("p.r"), F.col("p.c")
    pure = (F.col("p.itype") == "D") & (F.col("p.i") == 0)
    one, two = seq(l + 1, l + c), seq(r - c, r - 1)
    told = rows.join(targets.select("oligo_id", "seq", "pam_idx", "direction"), "oligo_id")
    return told.select(
        *KEY, "indel", "place", l.alias("left"), r.alias("right"), c.alias("central"), F.col("p.itype").alias("itype"), F.col("p.isize").alias("size"),
        "reads", "total", F.when(pure & (c > 0) & (one == two), one).otherwise("").alias("repeat"), F.when(pure, seq(l + 1, r - 1)).otherwise("").alias("altered"),
    )


def edited_reads(profile: DataFrame) -> DataFrame:
    """(sample, oligo_id, accepted, edited): reads of each profile and those that are edited."""
    return profile.groupBy(*KEY).agg(F.sum("reads").alias("accepted"), F.sum(F.when(F.col("indel") != "-", F.col("reads")).otherwise(0)).alias("edited"))


def repeats_with_best(repeats: DataFrame, targets: DataFrame) -> DataFrame:
    """repeats (oligo_id, left_start, right_start, mh_len, indel, reads) with the share of G and C of the repeat and the
    oligo's repeat with most reads: the first of several by place, none (empty, 0, -1) where no repeat has reads.

    One pass for all lengths: filter or partition by mh_len.
    """
    named = {"top_indel": ("indel", ""), "top_reads": ("reads", 0), "top_len": ("mh_len", -1), "top_left": ("left_start", -1), "top_right": ("right_start", -1)}
    best = repeats.filter("reads > 0").groupBy("oligo_id").agg(
        F.max_by(F.struct(*(c for c, _ in named.values())), F.struct("reads", -F.col("left_start"), -F.col("right_start"))).alias("b")
    )
    told = repeats.hint("merge").join(targets.select("oligo_id", "seq"), "oligo_id").join(best.hint("merge"), "oligo_id", "left")  # repeats are generated rows
    gc = sq.gc_percent(sq.part(F.col("seq"), F.col("left_start"), F.col("left_start") + F.col("mh_len")))
    return told.select(*repeats.columns, gc.alias("gc"), *(F.coalesce(F.col(f"b.{c}"), F.lit(x)).alias(n) for n, (c, x) in named.items()))


def short_inserts(targets: DataFrame, longest: int = 3) -> DataFrame:
    """(oligo_id, ins, indel, left_base, right_base): every insert of 1..longest at the cut with its name, and the letters on
    both sides. targets: (oligo_id, seq, cut_idx)."""
    from cutscape.operators import targets as tg

    s, cut = F.col("seq"), F.col("cut_idx")
    told = targets.select("oligo_id", "seq", "cut_idx", sq.base(s, cut - 1).alias("left_base"), sq.base(s, cut).alias("right_base"))
    return tg.placements(told, 0, longest, more=("left_base", "right_base")).select("oligo_id", "ins", "indel", "left_base", "right_base")


def insert_shares(summary: DataFrame, of_inserts: bool = False, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Mean percentage of insert_summary()'s columns over the oligos, in all edited reads (`total`) or in the inserts of these
    sizes; oligos without such reads don't count. summary: (sample, oligo_id, size, left_repeat, right_repeat, other, total)."""
    cols = ("left_repeat", "right_repeat", "other")
    rows = summary.filter(F.col("size").isin(*sizes))
    own = F.sum(F.col(cols[0]) + F.col(cols[1]) + F.col(cols[2])).over(Window.partitionBy(*KEY))
    rows = rows.withColumn("_of", own if of_inserts else F.col("total").cast("double"))
    return rows.groupBy("sample", "size").agg(*(F.avg(F.when(F.col("_of") > 0, F.col(c) * 100.0 / F.col("_of"))).alias(c) for c in cols))


def null_summary(templates: DataFrame, pams: DataFrame) -> DataFrame:
    """Control templates (oligo_id, variant, reads, percent, seq) with the PAM of each variant (oligo_id, pam_idx, direction)."""
    told = templates.join(pams.select("oligo_id", F.col("pam_idx").alias("_pam"), "direction"), "oligo_id")
    return told.withColumn("pam_idx", ix.moved_pam("variant", F.col("_pam"), F.col("direction"))).drop("_pam")


def corrected(mapped: DataFrame, first: DataFrame) -> DataFrame:
    """Re-mapped reads (read_id, oligo_id, own_oligo, template, indel, muts): a read that left its oligo gets the first
    mapping's (read_id, indel, muts) on the unchanged template."""
    f = first.select("read_id", F.col("indel").alias("_indel"), F.col("muts").alias("_muts"))
    stays = F.coalesce(F.col("oligo_id") == F.col("own_oligo"), F.lit(False))
    pick = lambda a, b: F.when(stays, a).otherwise(b)
    return mapped.join(f, "read_id", "left").select(
        "read_id", F.col("own_oligo").alias("oligo_id"), pick(F.col("template"), F.lit("-")).alias("template"),
        pick(F.col("indel"), F.col("_indel")).alias("indel"), pick(F.col("muts"), F.col("_muts")).alias("muts"),
    )


def oligo_thresholds(mapped: DataFrame, thresholds: tuple[int, ...] = (0, 10, 100, 500, 1000)) -> DataFrame:
    """Reads, oligos, and the oligos with more reads than each threshold, by sample."""
    counts = mapped.groupBy(*KEY).agg(F.count("*").alias("n"))
    above = [F.count(F.when(F.col("n") > t, F.lit(1))).alias(f"above_{t}") for t in thresholds]
    return counts.groupBy("sample").agg(F.sum("n").alias("reads"), F.count("*").alias("oligos"), *above)


def partial_barcodes(targets: DataFrame) -> DataFrame:
    """(head, tail, oligo_id): all of the first ten letters with three of the end, and three of the start with all of the
    last ten; of targets with one key the last one counts."""
    s = F.col("seq")
    first, last = F.substring(s, 1, 10), s.substr(F.length(s) - 9, F.lit(10))
    keys = F.array(F.struct(first.alias("head"), last.substr(F.lit(8), F.lit(3)).alias("tail")), F.struct(F.substring(first, 1, 3).alias("head"), last.alias("tail")))
    rows = targets.select(F.explode(keys).alias("k"), "oligo_id").select("k.head", "k.tail", "oligo_id")
    return rows.groupBy("head", "tail").agg(F.max_by("oligo_id", F.struct(sq.oligo_index(F.col("oligo_id")), "oligo_id")).alias("oligo_id"))


def guide_sets(details: DataFrame, library: str = "Both") -> DataFrame:
    """(part, oligo_id) of the nine overlapping sets of oligos by their details (oligo_id, guide, target, pam_idx, direction,
    comments, old): first what the comments say, then whether the guide fits, then repeats of four letters across the cut."""
    rows = details if library == "Both" else details.filter(F.col("old") == F.lit(library == "Old"))
    says = lambda x: F.coalesce(F.col("comments").contains(x), F.lit(False))
    cut = F.when(F.col("direction") == "FORWARD", F.col("pam_idx") - 3).otherwise(F.col("pam_idx") + 3)
    target = F.col("target")
    left, last = sq.part(target, F.lit(0), cut), F.length(target) - 4  # words that begin before the last four letters
    has = F.exists(F.when(cut < last, F.sequence(cut, last - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.instr(left, F.substring(target, i + 1, F.lit(4))) > 0)
    pam, fits = says("PAM"), sq.guide_matches(F.col("guide"), target)
    mismatch = ~pam & (says("mismatch") | ~fits)
    plain = ~pam & ~says("mismatch") & fits
    real = plain & says("Guide")
    flags = {
        "All": F.lit(True), "PAM": pam, "Mismatch": mismatch, "With MH>3": plain & has, "No MH>3": plain & ~has, "Real Guides": real,
        "Non-Targeting": plain & ~real, "Non-Targeting with MH>3": plain & ~real & has, "Non-Targeting no MH>3": plain & ~real & ~has,
    }
    named = F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))
    return rows.select(F.explode(F.filter(named, lambda x: x.isNotNull())).alias("part"), F.regexp_replace("oligo_id", "_", "").alias("oligo_id"))


def mappable(edits: DataFrame, targets: DataFrame, name: str = "indel") -> DataFrame:
    """edits (oligo_id, read, ...) with the name that the mapper gives the read on its own target (oligo_id, seq, cut_idx,
    reverse); `Unmappable` where no barcode window of the read is near the target's or the score is too low."""
    from cutscape.operators.align import aligned
    from cutscape.operators.targets import WINDOWS, barcode

    told = edits.join(targets.select("oligo_id", "seq", "cut_idx", "reverse"), "oligo_id")
    near = F.lit(False)
    for w in WINDOWS:
        a, b = barcode(F.col("read"), w), barcode(F.col("seq"), w)
        near = near | ((F.length(a) == F.length(b)) & (F.length(a) > 0) & (sq.hamming(a, b) <= 1))
    told = told.withColumn("_a", aligned(F.col("seq"), F.col("cut_idx"), F.col("reverse"), F.col("read")))
    good = near & (F.col("_a.score") > F.floor(F.length("read") * 0.8))
    return told.select(*edits.columns, F.when(good, F.col("_a.indel")).otherwise("Unmappable").alias(name))


def smallest(edits: DataFrame) -> DataFrame:
    """The smallest edit of each oligo, by size and name."""
    rows = ix.with_parts(edits, "indel", _size=ix.isize("indel"))
    return rows.groupBy("oligo_id").agg(F.min(F.struct("_size", "indel")).alias("m")).select("oligo_id", F.col("m.indel").alias("indel"), F.col("m._size").alias("size"))


def padded_read(read: Column, indel: Column, pam: Column) -> Column:
    """struct<text, new, shared>: a read with the letters that a deletion took left blank, and the places (from 0) of
    inserted letters and of letters that are ambiguous."""
    at = pam - 3 + ix.detail(indel, "L") + 1
    c, n, kind = ix.detail(indel, "C"), ix.isize(indel), ix.itype(indel)
    span = lambda a, k: F.when(k > 0, F.sequence(a, a + k - 1)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    text = F.concat(sq.part(read, F.lit(0), at + c), F.repeat(F.lit(" "), n), sq.part(read, at + c, F.length(read)))
    return F.struct(
        F.when(kind == "D", text).otherwise(read).alias("text"), F.when(kind == "I", span(at + c, n)).otherwise(none).alias("new"),
        F.when(kind.isin("D", "I"), span(at, c)).otherwise(none).alias("shared"),
    )
