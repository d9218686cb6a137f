"""Scores and counts of all candidate edits of targets, by bit masks of their features.

A placement's features of a group are the bits of a number, so those of an edit are the OR of its placements, which stand next
to each other. Deletions of one name have one size, so a pair of a group with DelSize is the group's mask with weights of its
own for each class of sizes; in pairs with DelLoc the mask is that of the placements in one bin, which are neighbours too.
Sums of weights come from tables by 12 bits of a mask; counts are histograms of the same 12 bits. The tables of 0/1 that
`model.Features` holds say the same, and a test holds both equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from cutscape.operators import model as md
from cutscape.operators import targets as tg

#: Targets that a task works on at a time; bits of a mask that are looked up at once.
STACK, BITS = 64, 12
LEFTS, RIGHTS = len(md.LEFT_BINS) + 2, len(md.RIGHT_BINS) + 2
#: Masks and the features of their bits: letters at the left and the right end, agreements, differences, repeats, place of the ends.
MASKS = {
    "near": ("RelSeq", [2 * k for k in range(24)] + [2 * k + 1 for k in range(24)]),
    "same": ("SeqMatch", [2 * k for k in range(36)]),
    "other": ("SeqMatch", [2 * k + 1 for k in range(36)]),
    "repeat": ("MH", list(range(len(md.LABELS["MH"])))),
    "place": ("DelLoc", list(range(LEFTS + RIGHTS))),
}
_SIZES = np.arange(128)
_KINDS, CLASS_OF = np.unique(md.size_features(_SIZES, np.zeros(128, int))[1], axis=0, return_inverse=True)
CLASS_OF = CLASS_OF.reshape(-1)
#: DelSize features of each class of sizes.
KINDS = _KINDS.astype(float)
_NIBBLE = np.where(md._CODE >= 0, 1 << np.maximum(md._CODE, 0), 0).astype(np.int64)


def _binned(x: np.ndarray, bins: tuple) -> np.ndarray:
    return sum(((x >= a) & (x <= b)) * (i + 1) for i, (a, b) in enumerate(bins)) - 1


def _repeat_bits(side: str, kind: str) -> np.ndarray:
    """The bit of a repeat of 0 to 15 letters."""
    at = [md._MH.get(f"{side}_{kind}MH{a}-{b}", -1) for a, b in md.MH_BINS] + [-1]
    return np.array([1 << at[k] if n and at[k] >= 0 else 0 for n, k in enumerate(_binned(np.arange(16), md.MH_BINS))], np.int64)


_REPEATS = {(s, k): _repeat_bits(s, k) for s in "LR" for k in ("", "MM1_")}


def chunks(width: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each part of a mask."""
    return [(a, min(BITS, width - a)) for a in range(0, width, BITS)]


@lru_cache(16)
def bit_table(width: int) -> np.ndarray:
    return (np.arange(1 << width)[:, None] >> np.arange(width) & 1).astype(float)


def block(theta: np.ndarray, a: str, b: str) -> np.ndarray:
    """Weights of a pair of groups, of all places at which the pair stands."""
    at, shape = md.layout()[1], (len(md.LABELS[a]), len(md.LABELS[b]))
    return sum((theta[at[k, x, y] : at[k, x, y] + shape[0] * shape[1]].reshape(shape) for k, (x, y) in enumerate(md.PAIRS) if (x, y) == (a, b)), np.zeros(shape))


class Weights:
    """Tables of sums of weights."""

    def __init__(self, theta: np.ndarray) -> None:
        at = md.layout()[1]
        self.own = {g: theta[at[g,] : at[g,] + len(md.LABELS[g])] for g in md.ORDER}
        self.by_size: dict[str, list[np.ndarray]] = {}
        for name, (g, of) in MASKS.items():
            pair = block(theta, "DelSize", g).T if g == "DelLoc" else block(theta, g, "DelSize")
            self.by_size[name] = self.tables((self.own[g] + KINDS @ pair.T)[:, of])
        none = lambda w: np.concatenate([w.T, np.zeros((1, len(w)))])  # noqa: E731  the last bin is none at all
        self.by_place = {name: self.tables(none(block(theta, MASKS[name][0], "DelLoc"))[:, MASKS[name][1]]) for name in ("near", "repeat")}
        self.sizes = KINDS @ self.own["DelSize"]
        self.around = {g: self.own[g][:, None] + block(theta, g, "DelSize") @ KINDS.T for g in ("CutSeq", "CutMatch")}
        wide = lambda w: np.concatenate([w, np.zeros((len(w), 1))], 1)
        self.new = np.array([[1, 0, 0], [1, 1, 0], [1, 0, 1]])  # InsSize of an insert of more than 2 letters, of 1, of 2
        self.around_new = block(theta, "CutSeq", "InsSize") @ self.new.T
        self.around_repeat = {g: wide(block(theta, g, "InsRpt")) for g in ("CutSeq", "CutMatch")}
        self.insert = np.zeros((21, 5))
        self.insert[:20] = self.own["InsSeq"][:, None] + wide(block(theta, "InsSeq", "InsRpt"))

    @staticmethod
    def tables(weights: np.ndarray) -> list[np.ndarray]:
        """Of each part of a mask the sum of the weights of each value, one kind of weights after the other."""
        return [np.concatenate([bit_table(k) @ w[a : a + k] for w in weights]) for a, k in chunks(weights.shape[1])]


@lru_cache(8)
def _weights_of(theta: bytes) -> Weights:
    return Weights(np.frombuffer(theta))


def weights_of(theta: np.ndarray) -> Weights:
    """Tables of weights, made once in a process."""
    return _weights_of(np.ascontiguousarray(theta, float).tobytes())


def looked_up(tables: list[np.ndarray], kind: np.ndarray, mask: np.ndarray, width: int) -> np.ndarray:
    total = 0.0
    for table, (a, k) in zip(tables, chunks(width)):
        total = total + table[(kind << k) + (mask >> a & (1 << k) - 1)]
    return total


@dataclass
class Masks:
    """Features of a stack's edits: deletions (masks of each edit, its class of sizes and target; for both ends the edits'
    stretches of one bin), then insertions."""

    edits: tg.Edits
    deletes: np.ndarray
    owner: np.ndarray
    size: np.ndarray
    of: dict[str, np.ndarray]
    stretches: list[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]
    around: dict[str, np.ndarray]
    new: Inserted

    def scores(self, w: Weights) -> np.ndarray:
        """Sum of the weights of each edit's features."""
        cut = sum(self.around[g] @ w.around[g] for g in self.around) + w.sizes
        part = cut[self.owner, self.size]
        for name, mask in self.of.items():
            part = part + looked_up(w.by_size[name], self.size, mask, len(MASKS[name][1]))
        for first, bin_, masks in self.stretches:
            got = sum(looked_up(w.by_place[name], bin_, mask, len(MASKS[name][1])) for name, mask in masks.items())
            part = part + (np.add.reduceat(got, first) if len(first) else 0.0)
        z = np.empty(len(self.deletes))
        z[self.deletes] = part
        z[~self.deletes] = self.new.scores(w, self.around)
        return z


@dataclass
class Inserted:
    """Insertions of a stack: of each placement its insert (20: a longer one) and kind of repeat (4: none); of each edit its first
    placement, target, size (0: more than 2) and the kinds that its placements have."""

    insert: np.ndarray
    repeat: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    size: np.ndarray
    kinds: np.ndarray

    def scores(self, w: Weights, around: dict[str, np.ndarray]) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0)
        z = np.add.reduceat(w.insert[self.insert, self.repeat], self.first)
        cut = sum(around[g] @ w.own[g] for g in around)
        z += cut[self.owner] + (w.new @ w.own["InsSize"])[self.size] + w.own["InsLoc"][0] + (around["CutSeq"] @ w.around_new)[self.owner, self.size]
        both = sum(around[g] @ w.around_repeat[g] for g in around) + np.append(w.own["InsRpt"], 0.0)
        return z + (both[self.owner] * self.kinds).sum(1)


@lru_cache(64)
def _geometry(n: int, whole: int, cut: int, by: int, deletion: int) -> dict[str, np.ndarray]:
    """What the deletions of targets have alike: ends in the whole sequence, bins, agreements that can be looked at."""
    left, right = tg.deletion_places(n, cut, deletion)
    l, r = left - cut, right - cut
    at_left = np.where(l < -30, LEFTS - 2, np.where(l >= 0, LEFTS - 1, _binned(l, md.LEFT_BINS)))
    at_right = np.where(r < 0, RIGHTS - 2, np.where(r > 30, RIGHTS - 1, _binned(r, md.RIGHT_BINS)))
    none = LEFTS + RIGHTS  # some places are in no bin
    at_left, at_right = np.where(at_left < 0, none, at_left), np.where(at_right < 0, none, LEFTS + at_right)
    place = ((1 << at_left) | (1 << at_right)) & (1 << none) - 1
    left, right = left + by, right + by
    fits = sum((((left + o > 0) & (right + p < whole)).astype(np.int64) << (6 * i + j) for i, o in enumerate(md.END_SPAN) for j, p in enumerate(md.END_SPAN)), 0 * left)
    return {"left": left, "right": right, "at_left": at_left, "at_right": at_right, "place": place, "fits": fits, "class": CLASS_OF[np.minimum(right - left - 1, 127)]}


def masks_of(code: np.ndarray, cut: int, seq: np.ndarray, by: int, limits: tuple[int, int, int]) -> Masks:
    """Features of all candidate edits of targets of one length and cut site. code: the letters that edits are made on; seq: the
    whole sequences, all of one length, in which the edits' letters begin at `by`."""
    deletion, insert, reach = limits
    e = tg.edits(code, cut, *limits)
    many, whole = seq.shape
    g = _geometry(code.shape[1], whole, cut, by, deletion)
    left, right, some, at = g["left"], g["right"], len(g["left"]), cut + by
    width = some + len(tg.inserts(1)) * (insert > 0) + sum(len(tg.inserts(k)) for k in range(2, insert + 1))
    fresh = np.zeros(many * width, bool)
    fresh[e.starts] = True
    fresh = fresh.reshape(many, width)
    edge = 4
    padded = np.zeros((many, whole + 2 * edge), np.uint8)
    padded[:, edge : edge + whole] = seq
    letter = md._CODE[padded]
    near = {o: letter[:, edge + at + o] for o in md.CUT_SPAN}
    pairs = [(o, p) for o in md.MATCH_SPAN for p in range(md.MATCH_SPAN[0], o)]
    hot = lambda x: (x[..., None] == np.arange(4)).reshape(len(x), -1).astype(float)
    around = {"CutSeq": hot(np.stack([near[o] for o in md.CUT_SPAN], 1)), "CutMatch": hot(np.stack([np.where(near[o] == near[p], near[o], -1) for o, p in pairs], 1))}
    new = fresh[:, :some].reshape(-1)
    starts = np.flatnonzero(new)
    owner, size, of, stretches = starts // max(some, 1), np.zeros(0, int), {name: np.zeros(0, np.int64) for name in MASKS}, []
    if some:
        size = g["class"][starts % some]
        mask = {"place": np.broadcast_to(g["place"], (many, some)).reshape(-1)}
        a, b, c, d = left.min(), left.max() + 1, right.min(), right.max() + 1
        bits = _NIBBLE[padded]
        of_left = sum(bits[:, edge + a + 1 + o : edge + b + 1 + o] << 4 * i for i, o in enumerate(md.END_SPAN))
        of_right = sum(bits[:, edge + c + o : edge + d + o] << 4 * i for i, o in enumerate(md.END_SPAN))
        mask["near"] = (of_left[:, left - a] | of_right[:, right - c] << 24).reshape(-1)
        x = letter[:, edge + a + 1 + md.END_SPAN[0] : edge + b + 1 + md.END_SPAN[-1], None]
        row = sum((x == letter[:, None, edge + c + p : edge + d + p]).astype(np.int64) << j for j, p in enumerate(md.END_SPAN))
        grid = sum(row[:, i : i + b - a] << 6 * i for i in range(len(md.END_SPAN)))
        same = grid.reshape(many, -1)[:, (left - a) * (d - c) + right - c] & g["fits"]
        mask["same"], mask["other"] = same.reshape(-1), (g["fits"] & ~same).reshape(-1)
        mask["repeat"] = _repeats(seq, left, right, deletion).reshape(-1)
        of = {name: np.bitwise_or.reduceat(x, starts) for name, x in mask.items()}
        for end in ("at_left", "at_right"):
            bin_ = g[end]
            parts = fresh[:, :some].copy()
            parts[:, 1:] |= bin_[1:] != bin_[:-1]
            begin = np.flatnonzero(parts.reshape(-1))
            stretches.append((np.searchsorted(begin, starts), bin_[begin % some], {name: np.bitwise_or.reduceat(mask[name], begin) for name in ("near", "repeat")}))
    return Masks(e, e.ins[e.starts] < 0, owner, size, of, stretches, around, _inserted(e, fresh[:, some:], some, width, near[-1], insert))


def _repeats(seq: np.ndarray, left: np.ndarray, right: np.ndarray, deletion: int) -> np.ndarray:
    """Masks of the repeats that deletions leave: the letters up to the first place that differs, and to the second one."""
    many, whole = seq.shape
    reach = md.MH_BINS[-1][1]
    low, high = max(0, left.min() - reach - 1), min(whole - 1, left.max() + reach + 2)
    last, first = (x.reshape(many, -1) for x in tg.breaks(seq, low, high, deletion))
    size, out, rows = right - left - 1, np.zeros((many, len(left)), np.int64), np.arange(many)[:, None]
    for side, table, begin, way in (("L", last, left, -1), ("R", first, left + 1, 1)):
        at = np.minimum(begin, high) - low
        one = np.where(begin <= high, table[:, at * deletion + size - 1], way * tg.FAR).astype(np.int64)
        there = (one + way >= low) & (one + way <= high)
        two = np.where(there, table[rows, (np.where(there, one + way, low) - low) * deletion + size - 1], way * tg.FAR)
        one, two = way * (one - begin), way * (two - begin)
        one[one > reach] = 0
        two[(two > reach) | (two <= one + 1) | (one == 0)] = 0
        out |= _REPEATS[side, ""][one] | _REPEATS[side, "MM1_"][two]
    return np.where(out == 0, 1 << len(md.LABELS["MH"]) - 1, out)


def _inserted(e: tg.Edits, fresh: np.ndarray, some: int, width: int, before: np.ndarray, insert: int) -> Inserted:
    every = [x for k in range(1, insert + 1) for x in tg.inserts(k)]
    made = e.ins.reshape(-1, max(width, 1))[:, some:].reshape(-1)
    first = np.flatnonzero(fresh.reshape(-1))
    owner = first // max(width - some, 1)
    long = np.array([len(x) for x in every] + [0])[made]
    one = np.array([md.NT.find(x[0]) if len(set(x)) == 1 else -2 for x in every] + [-2])[made]
    repeats = one == np.repeat(before, width - some)
    repeat = np.where(long < 3, 2 * long - 2 + ~repeats, 4)
    kinds = np.zeros((len(first), 5))
    if len(first):
        kinds[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(made)))), repeat] = 1
    size = np.where(long < 3, long, 0)[first]
    return Inserted(np.array([md._INSERTS.get(x, 20) for x in every] + [20])[made], repeat, first, owner, size, kinds)


class Counts:
    """Numbers of edits that have each feature, of several stacks; or sums of numbers that the edits are given (kind float)."""

    def __init__(self, kind: type = np.int64) -> None:
        self.kind, kinds = kind, len(KINDS)
        hist = lambda n, width: [np.zeros(n << k, kind) for _, k in chunks(width)]
        self.by_size = {name: hist(kinds, len(of)) for name, (_, of) in MASKS.items()}
        self.by_place = {name: hist(LEFTS + RIGHTS + 1, len(MASKS[name][1])) for name in ("near", "repeat")}
        self.sizes = np.zeros(kinds)
        self.around = {g: np.zeros((len(md.LABELS[g]), kinds)) for g in ("CutSeq", "CutMatch")}
        self.around_new = {g: np.zeros((len(md.LABELS[g]), 3)) for g in self.around}
        self.around_repeat = {g: np.zeros((len(md.LABELS[g]), 5)) for g in self.around}
        self.insert, self.new, self.repeat = np.zeros((21, 5)), np.zeros(3), np.zeros(5)

    def add(self, m: Masks, given: np.ndarray | None = None) -> None:
        """given: a number for each edit; 1 if there are none."""
        many, kinds, new = len(m.around["CutSeq"]), len(KINDS), m.new
        mine, own_new = (None, None) if given is None else (given[m.deletes], given[~m.deletes])
        spread = lambda x, first, n: None if x is None else np.repeat(x, np.diff(np.append(first, n)))
        for name, mask in m.of.items():
            self._add(self.by_size[name], m.size, mask, len(MASKS[name][1]), mine)
        for first, bin_, masks in m.stretches:
            part = spread(mine, first, len(bin_))
            for name, mask in masks.items():
                self._add(self.by_place[name], bin_, mask, len(MASKS[name][1]), part)
        own = np.bincount(m.owner * kinds + m.size, mine, minlength=many * kinds).reshape(many, kinds)
        self.sizes += own.sum(0)
        made = np.bincount(new.owner * 3 + new.size, own_new, minlength=many * 3).reshape(many, 3)
        told = np.zeros((many, 5))
        np.add.at(told, new.owner, new.kinds if own_new is None else new.kinds * own_new[:, None])
        for g, x in m.around.items():
            self.around[g] += x.T @ own
            self.around_new[g] += x.T @ made
            self.around_repeat[g] += x.T @ told
        self.insert += np.bincount(new.insert * 5 + new.repeat, spread(own_new, new.first, len(new.insert)), minlength=105).reshape(21, 5)
        self.new += made.sum(0)
        self.repeat += told.sum(0)

    @staticmethod
    def _add(hists: list[np.ndarray], kind: np.ndarray, mask: np.ndarray, width: int, given: np.ndarray | None) -> None:
        for hist, (a, k) in zip(hists, chunks(width)):
            hist += np.bincount((kind << k) + (mask >> a & (1 << k) - 1), given, minlength=len(hist))

    @staticmethod
    def _bits(hists: list[np.ndarray], width: int) -> np.ndarray:
        """Counts of each bit of a mask, by kind."""
        return np.concatenate([hist.reshape(-1, 1 << k) @ bit_table(k) for hist, (_, k) in zip(hists, chunks(width))], 1)

    def total(self) -> np.ndarray:
        """In the order of layout()."""
        at, total = md.layout()[1], np.zeros(len(md.layout()[0]))

        def put(x: np.ndarray, a: str, b: str | None = None) -> None:
            places = [at[a,]] if b is None else [at[k, p, q] for k, (p, q) in enumerate(md.PAIRS) if (p, q) == (a, b)]
            for start in places:
                total[start : start + x.size] += x.reshape(-1)

        by_size = {g: np.zeros((len(KINDS), len(md.LABELS[g]))) for g, _ in MASKS.values()}
        for name, (g, of) in MASKS.items():
            by_size[g][:, of] += self._bits(self.by_size[name], len(of))
        for g, x in by_size.items():
            put(x.sum(0), g)
            put(KINDS.T @ x, "DelSize", g) if g == "DelLoc" else put(x.T @ KINDS, g, "DelSize")
        for name, hists in self.by_place.items():
            g, of = MASKS[name]
            x = np.zeros((len(md.LABELS[g]), LEFTS + RIGHTS))
            x[of] = self._bits(hists, len(of))[:-1].T
            put(x, g, "DelLoc")
        put(self.sizes @ KINDS, "DelSize")
        new = np.array([[1, 0, 0], [1, 1, 0], [1, 0, 1]])
        for g in self.around:
            put(self.around[g].sum(1) + self.around_new[g].sum(1), g)
            put(self.around[g] @ KINDS, g, "DelSize")
            put(self.around_new[g] @ new, g, "InsSize")
            put(self.around_repeat[g][:, :4], g, "InsRpt")
        put(self.new @ new, "InsSize")
        put(self.repeat[:4], "InsRpt")
        put(self.insert[:20].sum(1), "InsSeq")
        put(self.insert[:20, :4], "InsSeq", "InsRpt")
        put(np.array([self.new.sum(), 0, 0, 0, 0]), "InsLoc")
        return total.astype(self.kind)


def target_masks(batch: pa.RecordBatch, deletion: int, insert: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, Masks]]:
    """Of stacks of a batch (seq, cut_idx, and if the edits are made on a part of the sequence: whole, trim): rows, letters that the
    edits are made on, and masks. Features see the whole sequence."""
    whole = batch["whole"].to_pylist() if "whole" in batch.schema.names else None
    trim = batch["trim"].to_pylist() if whole else None
    for rows, code, cut in tg.stacks(batch["seq"].to_pylist(), batch["cut_idx"].to_pylist(), STACK):
        if not whole:
            yield rows, code, masks_of(code, cut, code, 0, (deletion, insert, reach))
            continue
        same: dict[tuple[int, int], list[int]] = {}
        for k, i in enumerate(rows.tolist()):
            same.setdefault((len(whole[i]), trim[i]), []).append(k)
        for (n, by), part in same.items():
            seq = np.frombuffer(b"".join(whole[i].encode("latin-1", "replace") for i in rows[part].tolist()), np.uint8).reshape(-1, n)
            yield rows[part], code[part], masks_of(code[part], cut, seq, by, (deletion, insert, reach))
