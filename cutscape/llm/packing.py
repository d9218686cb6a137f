"""Best-fit packing of documents into token sequences of one length, in bulk-synchronous rounds.

A document's ids, with an end id, are cut into pieces of at most `capacity` tokens (only longer documents are cut). The
pieces are range-sorted by falling length and numbered. Sequences are rows with a gap; as many as the tokens fill are
there from the start. A round is best-fit decreasing for the pieces of the upper half of the lengths that are left:

1. Gaps are range-sorted by size, each with its place among those of its size.
2. A sweep from large to small gives each piece its successor, the smallest gap that holds it and that no longer piece
   took. Pieces and gaps of one size are interchangeable, so the sweep needs counts by size alone (at most `capacity` of
   them): gaps pile up, pieces take from the top, and the height of the pile after each size is the state.
3. Conflicts are resolved by rank. A gap's rank among its size is its height in the pile; the piece that takes it is the
   first one, going down in length, at which the pile falls below that height, and its rank follows from the height too.
   So each executor finds the pieces of its own gaps, without a join. A gap with room for k of the longest pieces of the
   round has k places in the pile.
4. Gaps are updated in place. If the longest pieces find no gap, sequences are opened: as many as their tokens fill,
   after `TRIES` times as many as surely hold them.

The driver keeps counts by size and a row for each partition of the range sort, no pieces and no gaps. Pieces meet their
sequences at the end, in one join on their number. Rounds halve the lengths or fill the gaps: 12 on the check's tables.

A null or empty text is the end id alone. Equal rows are packed one by one; equal lengths are in the order of id, piece
and checksum. An empty table gives no sequences. Other columns are not carried on, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutscape.llm.common import with_row_number, written
from cutscape.llm.tokens import encoder


#: Lengths up to this are of one round; openings by tokens before those that surely hold all.
SHORT, TRIES = 64, 6
#: Places in the pile that a task looks up at a time.
PLACES = 1 << 20


@dataclass
class Sweep:
    """A round over counts by size: `gaps` with `places` each (arrays by size), `left` pieces by length."""

    low: int
    top: int
    places: np.ndarray
    height: np.ndarray
    full: np.ndarray
    placed: np.ndarray

    @staticmethod
    def over(gaps: np.ndarray, left: np.ndarray) -> Sweep:
        size = np.arange(len(gaps))
        top = int(np.flatnonzero(left)[-1])
        low = top // 2 if top > SHORT else 0
        places = np.where(size > low, np.maximum(1, size // top), 0)
        taken = np.where((size > low) & (size <= top), left, 0)
        change = (gaps * places - taken)[::-1].cumsum()  # from large to small; the pile never falls below 0
        height = (change - np.minimum(np.minimum.accumulate(change), 0))[::-1]
        full = np.append(height[1:], 0) + gaps * places
        return Sweep(low, top, places, height, full, np.minimum(taken, full))

    def taken_by(self, gap: int, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in ranks, length, rank among the round's pieces of that length) of what gaps of one size take."""
        n = int(self.places[gap])
        if not n:
            return
        above = int(self.height[gap + 1]) if gap + 1 < len(self.height) else 0
        start = min(gap, self.top)
        lowest = np.minimum.accumulate(self.height[self.low + 1 : start + 1][::-1])
        step = max(1, PLACES // n)
        for a in range(0, len(ranks), step):
            level = (above + ranks[a : a + step, None] * n + np.arange(1, n + 1)).reshape(-1)
            down = np.searchsorted(-lowest, 1 - level, side="left")
            hit = np.flatnonzero(down < len(lowest))
            length = start - down[hit]
            yield a + hit // n, length, self.full[length] - level[hit]


def opened(sweep: Sweep, left: np.ndarray, capacity: int, tries: int) -> int:
    """Number of sequences to open for the round's pieces."""
    of = np.arange(len(left))
    some = np.where((of > sweep.low) & (of <= sweep.top), left, 0)
    surely, at_least = -(-int(some.sum()) // (capacity // sweep.top)), -(-int((some * of).sum()) // capacity)
    return surely if tries > TRIES or surely <= 1.02 * at_least + 1 else at_least


def range_sorted(gaps: DataFrame) -> DataFrame:
    """Gaps in the order of their size, written; _at has the partition and the place in it."""
    dealt = gaps.repartitionByRange("gap", "sequence_id").sortWithinPartitions("gap", "sequence_id")
    return written(dealt.withColumn("_at", F.monotonically_increasing_id()), "gaps")


def matched(gaps: DataFrame, sweep: Sweep, first: np.ndarray, keys: np.ndarray, bases: np.ndarray, capacity: int) -> DataFrame:
    """range_sorted() gaps after the round, with the numbers of the pieces that they took and their offsets.

    first: number of the first free piece of each length. keys and bases: of each partition's sizes, the key
    (partition, size) and what to add to a row's place in the partition for its rank among the gaps of that size.
    """
    shared = gaps.sparkSession.sparkContext.broadcast((sweep, first, keys, bases))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep, first, keys, bases = shared.value
        for batch in batches:
            gap, at = batch["gap"].to_numpy().astype(np.int64), batch["_at"].to_numpy()
            key = (at >> 33) * (capacity + 1) + gap
            rank = (at & ((1 << 33) - 1)) + bases[np.searchsorted(keys, key)]
            rows, sizes, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size in np.unique(gap).tolist():
                own = np.flatnonzero(gap == size)
                for of, length, k in sweep.taken_by(size, rank[own]):
                    rows.append(own[of])
                    sizes.append(length)
                    numbers.append(first[length] + k)
            row, length, number = map(np.concatenate, (rows, sizes, numbers))
            order = np.argsort(row, kind="stable")
            row, length, number = row[order], length[order], number[order]
            ends = np.cumsum(length)
            cuts = np.searchsorted(row, np.arange(len(gap) + 1))
            used = np.concatenate(([0], ends))[cuts]
            offset = (capacity - gap)[row] + ends - length - used[row]
            cut = lambda x: [x[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            yield pd.DataFrame({"sequence_id": batch["sequence_id"], "gap": (gap - np.diff(used)).astype(np.int32), "numbers": cut(number), "offsets": cut(offset)})

    return gaps.mapInPandas(take, "sequence_id bigint, gap int, numbers array<bigint>, offsets array<bigint>")


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document; with `ids` also the ids (unsigned 32-bit, binary)."""
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer)
        for batch in batches:
            rows = []
            for key, content in zip(batch["_id"], batch["_t"]):
                line = e.encode(content) + end
                for i, at in enumerate(range(0, len(line), 4 * capacity)):
                    part = line[at : at + 4 * capacity]
                    rows.append((key, i, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
            yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    schema = f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    cut = docs.select(F.col(id).alias("_id"), F.col(text).cast("binary").alias("_t")).mapInPandas(cut_up, schema)
    return cut if ids else cut.drop("ids")


def packed(cut: DataFrame, capacity: int) -> DataFrame:
    """pieces()'s rows with sequence_id and offset."""
    cut = written(cut, "pieces")
    spark, size = cut.sparkSession, np.arange(capacity + 1)
    ranked = with_row_number(cut.withColumn("_fall", -F.col("length")), ["_fall", "_id", "piece", "ids_crc32"]).select(*cut.columns, "row_no")
    left = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        left[r["length"]] = r["n"]
    first = left.sum() - left.cumsum()  # longer pieces stand before
    there = max(int(left[capacity // 2 + 1 :].sum()), -(-int((left * size).sum()) // capacity))
    none = F.array().cast("array<bigint>")

    def empty(a: int, b: int) -> DataFrame:
        return spark.range(a, b).select(F.col("id").alias("sequence_id"), F.lit(capacity).alias("gap"), none.alias("numbers"), none.alias("offsets"))

    gaps, rounds, tries = empty(0, there), [], 0
    while left.any():
        gaps = range_sorted(gaps)
        rounds.append(gaps)
        found = gaps.groupBy(F.shiftright("_at", 33).alias("p"), "gap").agg(F.count("*").alias("n")).collect()
        found = np.array(sorted(tuple(r) for r in found), np.int64).reshape(-1, 3)  # ranges of sizes: a row for each size and partition at most
        part, of, n = found.T
        sweep = Sweep.over(np.bincount(of, n, capacity + 1).astype(np.int64), left)
        if sweep.placed[sweep.top]:
            begins = np.concatenate(([0], n.cumsum()[:-1]))
            in_part = begins - begins[np.searchsorted(part, part)]  # place of the size's first row in its partition
            in_size = begins - begins[np.searchsorted(of, of)] if len(of) else begins  # sizes rise with the partitions
            gaps = matched(gaps, sweep, first, part * (capacity + 1) + of, in_size - in_part, capacity)
            left, first = left - sweep.placed, first + sweep.placed
        else:
            more = opened(sweep, left, capacity, tries)
            gaps, there, tries = gaps.select("sequence_id", "gap", none.alias("numbers"), none.alias("offsets")).unionByName(empty(there, there + more)), there + more, tries + 1
    rounds.append(gaps)
    took = [g.filter("size(numbers) > 0").select("sequence_id", F.explode(F.arrays_zip("numbers", "offsets")).alias("x")) for g in rounds]
    placed = took[0]
    for more in took[1:]:
        placed = placed.unionByName(more)
    placed = placed.select(F.col("x.numbers").alias("row_no"), "sequence_id", F.col("x.offsets").alias("offset"))
    return ranked.join(placed, "row_no").drop("row_no").select(*cut.columns, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from packed()'s rows with ids; a group is one sequence, so at most `capacity` tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda line, p: F.concat(line, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
