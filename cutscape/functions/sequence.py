"""DNA sequences and identifiers as Column expressions. Positions are 0-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ATGC"


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ATGC", "TACG"))


def base(seq: Column, i: Column) -> Column:
    return F.substring(seq, i + 1, F.lit(1))


def part(seq: Column, start: Column, end: Column) -> Column:
    """Characters start..end-1."""
    return F.substring(seq, start + 1, F.greatest(end - start, F.lit(0)))


def gc_percent(seq: Column) -> Column:
    return 100.0 * F.length(F.regexp_replace(seq, "[^GC]", "")) / F.length(seq)


def hamming(a: Column, b: Column) -> Column:
    """Mismatches over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))


def longest_run(a: Column, b: Column) -> Column:
    """struct<run, end> of the longest run of equal characters in aligned strings, the first of several: its length and the
    place of its last character; -1 and -1 where no character agrees."""
    n = F.least(F.length(a), F.length(b))
    apart = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1))))
    before = F.concat(F.array(F.lit(-1)), apart)
    runs = F.zip_with(F.slice(before, 1, F.size(apart)), apart, lambda x, y: F.struct((y - x - 1).alias("run"), (-y).alias("end")))
    best = F.array_max(runs)
    return F.when((n > 0) & (best["run"] > 0), F.struct(best["run"].alias("run"), (-best["end"] - 1).alias("end"))).otherwise(
        F.struct(F.lit(-1).alias("run"), F.lit(-1).alias("end"))
    )


def has_repeat_across(seq: Column, cut: Column, n: int) -> Column:
    """Whether some n characters right of the cut also stand left of it."""
    left, right = part(seq, F.lit(0), cut), part(seq, cut, F.length(seq))
    return F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(right) - n + 1, F.lit(1))),
        lambda i: (F.length(F.substring(right, i, F.lit(n))) == n) & (F.instr(left, F.substring(right, i, F.lit(n))) > 0),
    )


def is_sequence(seq: Column) -> Column:
    return F.coalesce(seq.rlike("^[ACGT]+$"), F.lit(False))


def target_error(seq: Column, pam: Column) -> Column:
    """Why a target can't be predicted, or null."""
    return (
        F.when(~is_sequence(seq), "letters other than ATGC")
        .when(F.length(seq) < 20, "shorter than 20")
        .when((pam < 13) | (pam > F.length(seq) - 7), "PAM too near an end")
        .when(part(seq, pam + 1, pam + 3) != "GG", "no NGG PAM")
    )


def trimmed_target(seq: Column, pam: Column, keep: int = 50) -> Column:
    """struct<seq, trim>: at most `keep` characters each side of the PAM, and how many went at the left."""
    left = F.greatest(pam - keep, F.lit(0))
    return F.struct(part(seq, left, F.least(pam + keep, F.length(seq))).alias("seq"), left.alias("trim"))


def short_id(oligo: Column) -> Column:
    return F.substring_index(oligo, "_", 1)


def oligo_index(oligo: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(oligo, "_", ""), "^Oligo", "").cast("int")


def bucket_label(index: Column) -> Column:
    """Folder of 1000 and file of 50 oligos."""
    low = F.floor(index / 50) * 50
    return F.concat(F.lit("Oligos_"), F.floor(index / 1000).cast("string"), F.lit("/Oligos_"), low.cast("string"), F.lit("-"), (low + 49).cast("string"))


def crispr_line(line: Column) -> Column:
    """struct<gene, chrom, pos, strand, locus> of `@@@GENE_chrN_pos_strand ...`."""
    bits = F.split(F.regexp_replace(F.substring_index(line, " ", 1), "^@@@", ""), "_")
    chrom, pos, strand = F.regexp_replace(F.get(bits, 1), "^chr", ""), F.get(bits, 2).cast("long"), F.get(bits, 3)
    start, end = F.when(strand == "-", pos - 5).otherwise(pos - 16), F.when(strand == "-", pos + 17).otherwise(pos + 6)
    locus = F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.struct(F.get(bits, 0).alias("gene"), chrom.alias("chrom"), pos.alias("pos"), strand.alias("strand"), locus.alias("locus"))


def cut_relative(seq: Column, pam: Column, direction: Column, left: Column, right: Column) -> Column:
    """Characters left..right counted from the cut, on the strand of the guide."""
    back = direction == "REVERSE"
    strand, at = F.when(back, revcomp(seq)).otherwise(seq), F.when(back, F.length(seq) - pam).otherwise(pam)
    return part(strand, at - 3 + left, at - 3 + right + 1)


def guide_matches(guide: Column, target: Column) -> Column:
    """Whether the guide without its first letter stands in the target or its reverse complement."""
    bare = guide.substr(F.lit(2), F.length(guide))
    return (F.instr(target, bare) > 0) | (F.instr(revcomp(target), bare) > 0)


def mismatch_pair(original: Column, left: Column, right: Column, last: bool = False) -> Column:
    """First (or last) differing letters `X-Y` of an original repeat and its changed copy; empty if there are none."""
    changed = F.when(left != original, left).otherwise(right)
    n = F.least(F.length(original), F.length(changed))
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(original, i, F.lit(1)) != F.substring(changed, i, F.lit(1)))
    i = F.try_element_at(at, F.lit(-1 if last else 1))
    return F.coalesce(F.concat(F.substring(original, i, F.lit(1)), F.lit("-"), F.substring(changed, i, F.lit(1))), F.lit(""))


def matched_gc(left: Column, right: Column) -> Column:
    """Places at which both copies have the same G or C."""
    n = F.least(F.length(left), F.length(right))
    same = lambda i: (F.substring(left, i, F.lit(1)) == F.substring(right, i, F.lit(1))) & F.substring(left, i, F.lit(1)).isin("G", "C")
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), same))).otherwise(0)


def merged_mismatches(a: Column, b: Column) -> Column:
    """Every mixture of two aligned strings of one length, without the strings themselves, in the order of their making."""
    n = F.length(a)

    def step(made: Column, i: Column) -> Column:
        x, y = F.substring(a, i, F.lit(1)), F.substring(b, i, F.lit(1))
        with_x = F.transform(made, lambda m: F.concat(m, x))
        return F.when(x == y, with_x).otherwise(F.concat(with_x, F.transform(made, lambda m: F.concat(m, y))))

    made = F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit("")), step)
    return F.when(a == b, F.array().cast("array<string>")).otherwise(F.filter(made, lambda m: (m != a) & (m != b)))


def trimmed_read(read: Column, template: Column) -> Column:
    """The stretch of a read from the template's first 20 letters to its last 20; empty if either is not found.

    Exact ends first; else ten letters of an end, at which the twenty may differ in two: where these stand first, or else at the
    first of their other places that fits.
    """
    n = F.length(template)
    head, tail = F.substring(template, F.lit(1), F.lit(20)), template.substr(F.greatest(n - 19, F.lit(1)), F.lit(20))
    find = lambda x: F.coalesce(F.instr(read, x), F.lit(0)) - 1
    near = lambda at, end: (at >= 0) & (hamming(end, F.substring(read, at + 1, F.lit(20))) <= 2)

    def place(end: Column, *tries: tuple[Column, int]) -> Column:
        """tries: ten letters, and where in the end they stand."""
        found = F.when(find(end) >= 0, find(end))
        for word, at in tries:
            found = found.when(near(find(word) - at, end), find(word) - at)
        every = F.sequence(F.lit(0), F.greatest(F.length(read) - 10, F.lit(0)))
        fits = lambda word, at: lambda p: (F.substring(read, p + 1, F.lit(10)) == word) & near(p - at, end)
        others = [F.get(F.filter(every, fits(word, at)), F.lit(0)) - at for word, at in tries]
        return found.otherwise(F.coalesce(*others, F.lit(-1)))

    ten = lambda start: template.substr(start, F.lit(10))
    start = place(head, (ten(F.lit(1)), 0), (ten(F.lit(11)), 10))
    stop = place(tail, (ten(n - 9), 10), (ten(n - 19), 0))
    return F.when((start >= 0) & (stop >= 0), part(read, start, stop + 20)).otherwise("")


def is_integer(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*[+-]?\d+\s*$"), F.lit(False))


def file_stem(path: Column) -> Column:
    """Name of a file without folder and `.txt`."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.txt$", "")


def log10_reads(reads: Column) -> Column:
    return F.log10(reads + F.lit(0.5))
