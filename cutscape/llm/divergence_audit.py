"""Audit of how far sources of one language diverge in their terms, by a frequent-pattern tree of term rows.

Shares are whole numbers: p = 1 + floor(SCALE * (count + 1) / (N + V)) of the V terms that a language keeps, N the count of a
source's terms. Two shares diverge by f(p, q) = floor((p - q)^2 / q). A pair of sources is the sum of f over all kept terms,
taken apart exactly, with p0 and q0 the shares of terms that do not occur:

    V * f(p0, q0)  +  sum over a's terms of f(p, q0) - f(p0, q0)  +  the same over b's terms of f(p0, q) - f(p0, q0)
    +  sum over terms of both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

The first sums come from counts of terms by share and source. The last one, the pair corrections, comes from the tree: a
kept term is a row of its sources' shares, sources in the order of their terms, zeros left out; equal rows are one row with a
multiplicity. Rows are range-sorted, so rows with a common beginning stand together and share the nodes of a path; each
node gives its correction with each of its ancestors once, times the terms that pass through it. A path that a border of
two batches cuts is two nodes, whose multiplicities add up to the same. Terms are counted in the tasks first, in tables of
a bounded number of entries; no source and no language meets in one task, but for a row for each of its sources.

Null texts, languages and sources are ''. Repeated rows count each, ids play no part. A source without terms has pairs, but
no term rows; a language without kept terms has pairs of value 0. An empty table gives no rows; other columns are not
looked at. Numbers are exact: products of counts are decimals, sums of the tree are kept in three parts of 21 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutscape.llm.common import joined_evenly, written

#: A to Z in lower case, other ASCII characters a space: what is left are runs of [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F].
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SCALE, LEAST, TOP = 1_000_000_000, 3, 200
#: Entries that a task counts before it gives them away.
HELD = 400_000
LIMB = 21


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, documents): partial counts of terms and of the documents that have them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def told() -> Iterator[pd.DataFrame]:
            for (of, by), (n, has) in held.items():
                every = list(n)
                for at in range(0, len(every), 100_000):
                    terms = every[at : at + 100_000]
                    yield pd.DataFrame({"lang": [of] * len(terms), "source": [by] * len(terms), "term": [t.decode("utf-8", "replace") for t in terms], "n": [n[t] for t in terms], "documents": [has[t] for t in terms]})

        for batch in batches:
            for of, by, line in zip(batch["lang"], batch["source"], batch["text"]):
                if not line:
                    continue
                n, has = held.setdefault((of, by), (Counter(), Counter()))
                before = len(n)
                terms = line.translate(TERM_BYTES).split()
                n.update(terms)
                has.update(set(terms))
                size += len(n) - before
                if size >= HELD:
                    yield from told()
                    held, size = {}, 0
        yield from told()

    rows = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).cast("binary").alias("text"))
    return rows.mapInPandas(count, "lang string, source string, term string, n bigint, documents bigint")


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count; counts are decimals here, so that their products don't overflow. 1 where nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    total = wide(n) + wide(v)
    return F.when(total > 0, F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), total)).otherwise(0) + 1


def apart(p: Column, q: Column) -> Column:
    """f(p, q); shares are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tree_corrections(rows: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> dict[tuple[int, int], int]:
    """{(a, b): sum} of the pair corrections of sorted rows, padded to one width: items of source, p, p0, `lengths` items a row."""
    n, depth = len(rows), rows.shape[1]
    levels = np.arange(depth)
    same = np.zeros((n, depth), bool)  # whether the row shares its node of this depth with the row before
    if n > 1:
        alike = (rows[1:] == rows[:-1]).all(2) & (levels < np.minimum(lengths[1:], lengths[:-1])[:, None])
        same[1:] = np.logical_and.accumulate(alike, 1)
    found: dict[tuple[int, int], int] = {}
    for d in range(1, depth):
        has = np.flatnonzero(lengths > d)
        if not len(has):
            break
        first = np.flatnonzero(~same[has, d])
        through = np.add.reduceat(times[has], first)  # terms that pass through each node
        nodes = rows[has[first]]
        b, q, q0 = nodes[:, d].T
        for e in range(d):
            a, p, p0 = nodes[:, e].T
            for x, y, value in ((a, b, _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)), (b, a, _f(q, p) - _f(q, p0) - _f(q0, p) + _f(q0, p0))):
                order = np.lexsort((y, x))
                x, y, value, m = x[order], y[order], value[order], through[order]
                cuts = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
                parts = [np.add.reduceat((value >> (LIMB * i) if i == 2 else value >> (LIMB * i) & ((1 << LIMB) - 1)) * m, cuts) for i in range(3)]
                for key in zip(x[cuts].tolist(), y[cuts].tolist(), *(z.tolist() for z in parts)):
                    found[key[:2]] = found.get(key[:2], 0) + key[2] + (key[3] << LIMB) + (key[4] << 2 * LIMB)
    return found


def pair_corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) of rows (lang, row, times), a row being source number, p and p0 of each item, one after the other."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, int] = {}
        for batch in batches:
            of = batch["lang"].to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                lines = batch["row"].iloc[x:y]
                lengths = lines.map(len).to_numpy() // 3
                padded = np.full((y - x, int(lengths.max()), 3), -1, np.int64)
                padded[np.arange(padded.shape[1]) < lengths[:, None]] = np.concatenate(lines.to_numpy()).reshape(-1, 3)
                padded[..., 1:][padded[..., 1:] < 0] = 1
                for (a, b), value in tree_corrections(padded, lengths, batch["times"].to_numpy()[x:y]).items():
                    found[of[x], a, b] = found.get((of[x], a, b), 0) + value
        keys = list(found)
        yield pd.DataFrame({"lang": [k[0] for k in keys], "a": [k[1] for k in keys], "b": [k[2] for k in keys], "value": [str(found[k]) for k in keys]})

    # Rows of two items and more have pairs; the multiplicity is taken before the sort, so no row stands twice.
    parts = rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row").mapInPandas(walk, "lang string, a bigint, b bigint, value string")
    return parts.select("lang", "a", "b", F.col("value").cast("decimal(38,0)").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows of every other source of the language, by falling divergence, and
    `term` rows of the `top` terms that a source has more of than its language."""
    at = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    by_term = term_counts(docs).repartition("lang", "term")  # both sums use it
    counts = by_term.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = written(kept.filter(F.col("documents") >= least).drop("documents"), "terms")

    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("v"))
    own = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"), F.count("*").alias("terms"))
    groups = at.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = groups.select("lang", "source", *map(zero, ("n", "terms", "lang_n", "v")))
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("terms"), "source")).cast("long")
    groups = groups.select("*", number.alias("no"), share(F.lit(0).cast("long"), F.col("n"), F.col("v")).alias("p0"))
    groups = written(groups, "groups")

    entries = kept.select("lang", "term", "total", F.explode("by").alias("x")).select("lang", "term", "total", F.col("x.source").alias("source"), F.col("x.n").alias("c"))
    many = groups.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    entries = joined_evenly(written(entries, "entries"), groups.filter("terms > 0"), ["lang", "source"], "terms", many)
    entries = entries.withColumn("p", share(F.col("c"), F.col("n"), F.col("v")))
    entries = written(entries.withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v"))).select("lang", "source", "term", "no", "p", "p0", "q"), "shares")

    telling = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    telling = telling.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)

    lines = entries.groupBy("lang", "term").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "p", "p0"))), lambda x: F.array(x["no"], x["p"], x["p0"]))).alias("row"))
    lines = lines.filter(F.size("row") > 3).groupBy("lang", "row").agg(F.count("*").alias("times"))
    both = pair_corrections(written(lines, "rows"))

    spread = entries.groupBy("lang", "source", "no", "p", "p0").agg(F.count("*").cast("decimal(20,0)").alias("times"))
    other = groups.select("lang", F.col("no").alias("other"), F.col("p0").alias("q0"))
    alone = spread.join(other, "lang").filter("no <> other")
    p, p0, q0 = map(F.col, ("p", "p0", "q0"))
    gives, takes = apart(p, q0) - apart(p0, q0), apart(q0, p) - apart(q0, p0)
    sums = alone.groupBy("lang", "no", "other").agg(F.sum(F.col("times") * gives).alias("gives"), F.sum(F.col("times") * takes).alias("takes"))
    wide = lambda c: F.col(c).cast("decimal(38,0)").alias("value")
    sums = sums.select("lang", F.col("no").alias("a"), F.col("other").alias("b"), wide("gives")).unionByName(sums.select("lang", F.col("other").alias("a"), F.col("no").alias("b"), wide("takes")))
    sums = sums.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    named = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("b"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", F.col("no").alias("a"), "p0", "v").join(named, "lang").filter("a <> b")
    base = F.col("v").cast("decimal(20,0)") * apart(p0, q0)
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", (base + F.coalesce("value", F.lit(0))).cast("long"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(place))
    return pairs.unionByName(telling)
