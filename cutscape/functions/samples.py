"""Sample names as Column expressions: a name holds study date, cell line, coverage, virus batch and day post infection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a name can hold; of several that it holds the last one counts.
COVERAGES = ("1600x", "800x", "500x", "1600X")
CELL_LINES = ("K562", "RPE1", "CAS9", "eCAS9", "WT", "TREX2", "2A_TREX2", "HAP1", "E14TG2A", "CHO", "BOB", "SIM")
MONTHS = ("may", "dec")
VIRUSES = ("12NA", "12NB", "7A", "7B", "6OA", "6OB", "12OA", "12OB")
#: Fixed value: a sample whose name states the wrong day.
MISNAMED = "K562_800x_7A_DPI7_may"


def last_of(name: Column, held: tuple[str, ...]) -> Column:
    """The last of the strings that the name holds, or an empty one."""
    return F.coalesce(*(F.when(name.contains(x), x) for x in reversed(held)), F.lit(""))


def parsed(sample: Column) -> Column:
    """struct<cell_line, dpi, virus, coverage, date, month, name>, which also orders samples."""
    wrong = sample.contains(MISNAMED)
    name = F.when(wrong, F.concat(sample.substr(F.lit(1), F.length(sample) - 8), F.lit("DPI16_may"))).otherwise(sample)
    toks = F.when(name.contains("_"), F.split(name, "_")).otherwise(F.split(name, "-"))
    day = F.try_element_at(F.filter(toks, lambda t: t.contains("DPI")), F.lit(1))
    dpi = F.coalesce(F.regexp_replace(day, "^.*?DPI", "").try_cast("int"), F.lit(0))
    cell = last_of(name, CELL_LINES)
    cell = F.when(cell == "CAS9", "K562").when(cell == "2A_TREX2", "TREX2_2A").when(cell == "WT", " WT").otherwise(cell)
    month = F.coalesce(*(F.when(name.contains(x), f"{i}{x}") for i, x in reversed(list(enumerate(MONTHS)))), F.lit(""))
    return F.struct(
        cell.alias("cell_line"), dpi.alias("dpi"), last_of(name, VIRUSES).alias("virus"), last_of(name, COVERAGES).alias("coverage"),
        F.coalesce(F.get(toks, F.lit(1)), F.lit("")).alias("date"), month.alias("month"), sample.alias("name"),
    )


def is_old(sample: Column) -> Column:
    """Whether a sample is of the old library."""
    last = F.substring_index(sample, "/", -1)
    return (last.contains("O") & ~last.contains("BOB") & ~last.contains("CHO")) | last.contains("Old") | last.contains("old")


def is_null(sample: Column) -> Column:
    """Whether a sample is a control: plasmids or wild type."""
    return sample.contains("NULL") | sample.contains("WT")


def wild_type(sample: Column) -> Column:
    """The wild-type sample that controls a sample."""
    return F.when(is_old(sample), "ST_Feb_2018/data/WT_12OA_DPI7").otherwise("ST_Feb_2018/data/WT_12NA_DPI7")


def plasmid_control(sample: Column) -> Column:
    return F.when(is_old(sample), "ST_April_2017/data/NULL_Old").otherwise("ST_April_2017/data/NULL_New")


def library(sample: Column) -> Column:
    """Which targets a sample was made with."""
    return F.when(sample.contains("BOTH"), "both").when(is_old(sample), "old").otherwise("new")


def label(path: Column) -> Column:
    """Study and sample of a folder study/data/sample."""
    bits = F.split(path, "/")
    return F.concat(F.element_at(bits, -3), F.lit("_"), F.element_at(bits, -1))


def short_label(label: Column) -> Column:
    return F.array_join(F.slice(F.split(label, "_"), 4, 99), " ")


def simple_name(sample: Column, with_day: bool = False) -> Column:
    """Cell line and replicate for display."""
    p = parsed(sample)
    cell = F.when(p["cell_line"] == "BOB", "Human iPSC").when(p["cell_line"].contains("E14"), "Mouse ESC").otherwise(p["cell_line"])
    replicate = F.when(sample.contains("K562_1600x"), "D").when(sample.contains("_CAS9"), "C").when(p["virus"].contains("A"), "A").otherwise("B")
    out = F.concat(cell, F.lit(" Rep "), replicate)
    return F.concat(out, F.lit(" DPI "), p["dpi"].cast("string")) if with_day else out


def selectors(include_controls: bool = False) -> dict[str, Callable[[Column], Column]]:
    """Named choices of samples."""
    has = lambda s, *xs: F.forall(F.array(*map(F.lit, xs)), lambda x: F.contains(s, x))

    def good(s: Column) -> Column:
        spoilt = (
            has(s, "RPE", "7A") | (has(s, "RPE") & ~has(s, "dec")) | has(s, "DPI16") | has(s, MISNAMED) | has(s, "DPI7", "K562", "1600", "7B")
            | has(s, "CAS9", "1600", "DPI3") | has(s, "WT", "DPI20") | has(s, "2A_TREX", "12NB", "DPI3")
        )
        return ~spoilt if include_controls else ~spoilt & ~is_null(s)

    cell = lambda s: parsed(s)["cell_line"]
    week = lambda s: parsed(s)["dpi"] == 7
    new = lambda s: ~is_old(s) & good(s)
    lines = lambda s: new(s) & week(s) & ~has(s, "2A_TREX")
    k562 = lambda s: lines(s) & (cell(s) == "K562")
    return {
        "DPI7": lines,
        "K562 New": k562,
        "Old Scaffold": lambda s: is_old(s) & good(s),
        "K562_All_TP": lambda s: new(s) & (cell(s) == "K562"),
        "New Scaffold": new,
        "K562 TREX": lambda s: k562(s) | ((cell(s) == "TREX2") & week(s) & good(s)),
        "All": good,
        "Concat New": lambda s: has(s, "data_", "N"),
        "Concat Old": lambda s: has(s, "data_", "O"),
    }


def pair_from_name(file: Column) -> Column:
    """struct<a, b> of a file A_vs_B.txt; nulls for other names."""
    at = F.instr(file, "_vs_")
    a, b = file.substr(F.lit(1), at - 1), F.regexp_replace(file.substr(at + 4, F.length(file)), ".{4}$", "")
    return F.struct(F.when(at > 0, a).alias("a"), F.when(at > 0, b).alias("b"))
