"""Vector bin packing of training examples: sequences under limits on tokens, segments and loss-bearing tokens at once.

An example is a list of texts, each learned from (its tokens bear loss) or not; for documents it is one learned text. Its
ids, with an end id, may be cut anywhere. A task packs its own rows, so nothing is shuffled: it holds a pool of at most `pool`
examples and fills one sequence at a time by the dot-product heuristic. Of the examples that fit as a whole, the one is
placed whose demand has the largest dot product with the room left, each dimension scaled by its limit and weighted by
the pool's mean demand. If none fits as a whole, the one with the largest product is cut to fill the sequence.

A sequence is done when it is full. One that a limit or the end of the rows closes earlier is cut back to a power of two of
tokens, which needs no padding, and what stands beyond goes back to the pool; so there is no padding at all, and a sequence
cuts two examples at most. Examples of more than the limit fill sequences of their own first.

Sequence ids are the partition's number and a count. A repeated task gives its rows anew, whole, whatever their order.
Memory: the pool's ids, at most `pool` times the tokens' limit, and one example. A null or empty text has no ids, so the end id alone is
left; repeated rows are packed one by one; null ids are kept; an empty table gives no rows; other columns aren't carried on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutscape.llm.tokens import byte_encoder


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens, segments (pieces of examples), tokens that bear loss."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are at least 1")


@dataclass
class Piece:
    """ids[start:] of an example, up to `length`; `learned` has the loss-bearing ids before each of the example's ids (None: all bear loss)."""

    id: object
    ids: np.ndarray
    learned: np.ndarray | None
    start: int
    length: int

    def loss(self, n: int | None = None) -> int:
        n = self.length if n is None else n
        return n if self.learned is None else int(self.learned[self.start + n] - self.learned[self.start])

    def most(self, tokens: int, loss: int) -> int:
        """How many of its first ids have room."""
        n = min(self.length, tokens)
        if self.learned is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.learned[self.start : self.start + n + 1], self.learned[self.start] + loss, side="right")) - 1)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.id, self.ids, self.learned, self.start, n), Piece(self.id, self.ids, self.learned, self.start + n, self.length - n)


class Pool:
    """Waiting pieces with their demands as rows of an array."""

    def __init__(self, limits: Limits, size: int) -> None:
        self.limits, self.room = limits, np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pieces: list[Piece] = []
        self.need = np.zeros((size + limits.segments + 2, 3))

    def add(self, piece: Piece) -> None:
        n = len(self.pieces)
        if n == len(self.need):
            self.need = np.concatenate((self.need, np.zeros_like(self.need)))
        self.need[n] = piece.length, 1, piece.loss()
        self.pieces.append(piece)

    def take(self, k: int) -> Piece:
        piece, last = self.pieces[k], self.pieces.pop()
        if k < len(self.pieces):
            self.pieces[k], self.need[k] = last, self.need[len(self.pieces)]
        return piece

    def sequence(self) -> list[Piece]:
        """The pieces of one sequence, taken out of the pool."""
        left, chosen = self.room.copy(), []
        weight = self.need[: len(self.pieces)].mean(0) / self.room**2  # both vectors are scaled by the limits
        while self.pieces and left[0] >= 1 and left[1] >= 1:
            need = self.need[: len(self.pieces)]
            score = need @ (weight * left / self.room)
            fits = (need <= left).all(1)
            if fits.any():
                piece = self.take(int(np.where(fits, score, -1.0).argmax()))
            else:
                k = int(score.argmax())
                n = self.pieces[k].most(int(left[0]), int(left[2]))
                if not n:  # no room for loss; another one may begin without
                    n, k = max((p.most(int(left[0]), int(left[2])), k) for k, p in enumerate(self.pieces))
                    if not n:
                        break
                piece, rest = self.take(k).cut(n)
                self.add(rest)
            chosen.append(piece)
            left -= (piece.length, 1, piece.loss())
        total = sum(p.length for p in chosen)
        if total < self.limits.tokens:
            beyond = total - (1 << (total.bit_length() - 1))
            while beyond:
                piece = chosen.pop()
                if piece.length > beyond:
                    piece, rest = piece.cut(piece.length - beyond)
                    chosen.append(piece)
                    piece = rest
                self.add(piece)
                beyond -= piece.length
        return chosen


def documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, texts, learned) of documents: one learned text each."""
    return docs.select(F.col(id).alias("_id"), F.array(F.col(text)).alias("texts"), F.array(F.lit(True)).alias("learned"))


def conversations(turns: DataFrame, id: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """(_id, texts, learned) of turns (id, turn, role, text); the turns of one role are learned from. Null roles aren't."""
    line = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    whole = turns.groupBy(F.col(id).alias("_id")).agg(line.alias("x"))
    return whole.select("_id", F.transform("x", lambda t: t["text"]).alias("texts"), F.transform("x", lambda t: F.coalesce(t["role"] == learn, F.lit(False))).alias("learned"))


def packed(examples: DataFrame, tokenizer: str, limits: Limits, end_id: int, pool: int = 1024, ids: bool = False) -> DataFrame:
    """(_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset) of each piece of (_id, texts, learned);
    with `ids` also its ids (unsigned 32-bit, binary). The end id bears loss as the last text does."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, waiting, first, rows = byte_encoder(tokenizer), Pool(limits, pool), TaskContext.get().partitionId() << 33, []

        def put(chosen: list[Piece]) -> None:
            nonlocal first
            offset = 0
            for p in chosen:
                line = p.ids[p.start : p.start + p.length].tobytes()
                rows.append((p.id, p.start, p.length, zlib.crc32(line), len(p.ids), p.loss(), first, offset, line if ids else None))
                offset += p.length
            first += 1

        def told() -> pd.DataFrame:
            nonlocal rows
            out, rows = pd.DataFrame(rows, columns=["_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset", "ids"]), []
            return out

        for batch in batches:
            for key, texts, learned in zip(batch["_id"], batch["texts"], batch["learned"]):
                lines = [e.encode(t) for t in texts] + [end]
                whole = np.frombuffer(b"".join(lines), "<u4")
                sums = None
                if not all(learned):
                    flags = [*learned, learned[-1] if len(learned) else True]
                    sums = np.concatenate(([0], np.cumsum(np.repeat(flags, [len(x) // 4 for x in lines])))).astype(np.int32)
                piece = Piece(None if pd.isna(key) else key, whole, sums, 0, len(whole))
                while piece.length and (n := piece.most(limits.tokens, limits.loss)) < piece.length:
                    part, piece = piece.cut(n)
                    if n == limits.tokens:
                        put([part])
                    else:
                        waiting.add(part)
                waiting.add(piece)
                while len(waiting.pieces) >= pool:
                    put(waiting.sequence())
                if len(rows) >= 4096:
                    yield told()
        while waiting.pieces:
            put(waiting.sequence())
            if len(rows) >= 4096:
                yield told()
        yield told()

    kind = examples.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    rows = examples.select("_id", "texts", "learned").mapInPandas(run, schema)
    return rows if ids else rows.drop("ids")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, segments, ids) from packed()'s rows with ids; a group is one sequence, so within the limits."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda line, p: F.concat(line, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.count("*").alias("segments"), whole.alias("ids"))
