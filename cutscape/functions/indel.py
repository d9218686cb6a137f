"""The indel identifier as Column expressions: head, cut-relative details, mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grammar of details and mutations.
DETAILS = r"([CLRDI]+)(-?\d+)"
MUTS = r"([MNDSI]+)(-?\d+)(\[[ATGC]+\])?"
#: Synthesis indels are allowed outside this span and up to these sizes.
GUIDE_LEFT, GUIDE_RIGHT, MOST_MUTS, MOST_GAP = -20, 6, 5, 2


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def head(indel: str | Column) -> Column:
    """Class: the part before the first underscore."""
    return F.substring_index(_col(indel), "_", 1)


def itype(indel: str | Column) -> Column:
    return F.substring(_col(indel), 1, 1)


def isize(indel: str | Column) -> Column:
    """Size of the head; 0 for an unedited one."""
    h = head(indel)
    return F.when(h.startswith("-"), 0).otherwise(h.substr(F.lit(2), F.length(h)).cast("int"))


def _second(indel: Column) -> Column:
    return F.coalesce(F.get(F.split(indel, "_"), 1), F.lit(""))


def detail(indel: str | Column, letter: str) -> Column:
    """The last value of a letter in the details; 0 for absent I, D and C, null for absent L and R."""
    text = _second(_col(indel))
    value = F.regexp_extract(text, rf".*(?<![CLRDI]){letter}(-?\d+)", 1).try_cast("int")
    return F.when(text.contains(letter), F.coalesce(value, F.lit(0))).otherwise(0) if letter in "IDC" else value


def muts(indel: str | Column) -> Column:
    """Mutations as array<struct<op, val, nt>>: after the details, or after the head of an unedited read."""
    toks = F.split(_col(indel), "_")
    given = (F.size(toks) > 2) | ((F.get(toks, 0) == "-") & (F.size(toks) > 1))
    text = F.when(given, F.element_at(toks, -1)).otherwise(F.lit(""))
    return F.transform(
        F.regexp_extract_all(text, F.lit(MUTS), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, MUTS, 1).alias("op"),
            F.regexp_extract(m, MUTS, 2).cast("int").alias("val"),
            F.regexp_replace(F.regexp_extract(m, MUTS, 3), r"[\[\]]", "").alias("nt"),
        ),
    )


def parsed(indel: str | Column) -> Column:
    """struct<itype, isize, l, r, c, i, d, muts>."""
    named = [detail(indel, x).alias(x.lower()) for x in "LRCID"]
    return F.struct(itype(indel).alias("itype"), isize(indel).alias("isize"), *named, muts(indel).alias("muts"))


def net_size(indel: str | Column) -> Column:
    """Size of the edit less what it inserts or deletes on the side."""
    return isize(indel) - detail(indel, "I") - detail(indel, "D")


def in_cut_span(indel: str | Column) -> Column:
    """Whether the edit reaches the cut: not entirely right of 5 or left of -5. Unedited reads do."""
    away = (detail(indel, "L") > 5) | (detail(indel, "R") < -5)
    return (itype(indel) == "-") | ~away


def allowed_oligo_indel(indel: str | Column) -> Column:
    """Whether a synthesis variant leaves guide and PAM alone."""
    m = muts(indel)
    point = F.filter(m, lambda x: ~x["op"].isin("N", "I", "D"))
    gaps = F.filter(m, lambda x: x["op"].isin("I", "D"))
    bad_point = F.exists(point, lambda x: (x["val"] > GUIDE_LEFT) & (x["val"] < GUIDE_RIGHT)) | (F.size(point) > MOST_MUTS)
    bad_gap = F.exists(gaps, lambda x: x["val"] > MOST_GAP)
    inside = (detail(indel, "L") < GUIDE_RIGHT) & (detail(indel, "R") > GUIDE_LEFT)
    bad_head = (itype(indel) != "-") & ((isize(indel) > MOST_GAP) | inside)
    return ~(bad_point | bad_gap | bad_head)


def outside_seed(indel: str | Column) -> Column:
    """Whether an edit stays outside seed and PAM."""
    left, right = detail(indel, "L"), detail(indel, "R")
    hit = (itype(indel) != "-") & (((left > -15) & (left < 6)) | ((right > -14) & (right < 7)))
    point = F.exists(
        muts(indel),
        lambda x: x["op"].isin("M", "S") & (x["val"] > -14) & (x["val"] < 7) & ~((x["op"] == "M") & (x["val"] == 0)),
    )
    return ~(hit | point)


def read_length(indel: str | Column, oligo_indel: str | Column, full: int = 79) -> Column:
    """Length of the read that shows the two indels on a template of the usual length."""
    change = F.lit(0)
    for x in (indel, oligo_indel):
        sign = F.when(itype(x) == "I", 1).when(itype(x) == "D", -1).otherwise(0)
        change = change + sign * isize(x)
        change = change + F.aggregate(
            muts(x), F.lit(0), lambda n, m: n + F.when(m["op"] == "I", m["val"]).when(m["op"] == "D", -m["val"]).otherwise(0)
        )
    return F.lit(full) + change


def detectable(indel: str | Column, length: Column, pam: Column, direction: Column) -> Column:
    """Whether both ends of an edit lie on a target of a length; null for unedited reads."""
    back = direction == "REVERSE"
    left, right = F.when(back, length - pam - 3).otherwise(pam - 3), F.when(back, pam - 3).otherwise(length - pam - 3)
    return (F.abs(detail(indel, "L")) < left) & (detail(indel, "R") < right)


def moved_pam(indel: str | Column, pam: Column, direction: Column) -> Column:
    """Place of the PAM on a template with a synthesis variant: variants upstream of it move it.

    The edit of the head comes first, then each small gap, in order; a gap's size stands in the entry before its place.
    """
    back = direction == "REVERSE"
    left, right, c = detail(indel, "L"), detail(indel, "R"), detail(indel, "C")
    start = F.when(back, pam + 2 - (right - 1) + c).otherwise(pam - 3 + (left + 1) + c)
    gone = F.when(itype(indel) == "D", isize(indel) - detail(indel, "I")).otherwise(detail(indel, "D") - isize(indel))
    first = F.when((itype(indel) != "-") & (start < pam), F.greatest(pam - gone, start)).otherwise(pam)

    def step(s: Column, m: Column) -> Column:
        size = F.when(m["op"] == "D", m["val"]).when(m["op"] == "I", -m["val"]).otherwise(s["size"])
        at = F.when(back, s["pam"] + 2 - m["val"]).otherwise(s["pam"] - 3 + m["val"])
        moves = (m["op"] == "S") & (at < s["pam"])
        return F.struct(F.when(moves, s["pam"] - s["size"]).otherwise(s["pam"]).cast("int").alias("pam"), size.cast("int").alias("size"))

    begin = F.struct(first.cast("int").alias("pam"), F.lit(0).alias("size"))
    return F.aggregate(muts(indel), begin, step, lambda s: s["pam"])


def large_insertion_name(indel: str | Column) -> Column:
    """Whether a name begins with `I1` (sizes 1, 10 to 19, ...)."""
    return _col(indel).startswith("I1")


def with_parts(df: DataFrame, column: str, **made: Column) -> DataFrame:
    """df with columns made of an identifier, in place; rows without one go. Sum rows up first, as identifiers repeat."""
    return df.filter(F.col(column).isNotNull()).withColumns(made)
