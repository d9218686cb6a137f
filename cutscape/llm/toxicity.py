"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words ([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased) and their beginnings of 4 to
8 characters, each marked as present and, from the second on, as repeated; each term is hashed to one of `BUCKETS`
buckets. The score is the logistic function of w0 + sum w_i + sum_{i<j} <v_i, v_j> over the buckets of a text, so that
two terms together can weigh more (an insult and a group) or less than one by one.

Learning: at most `rows` labelled rows, those of the least hash of their id (a documented bound; the labels' table is
counted and thinned in Spark), give counts by bucket and label, added up in Spark by slices of the buckets. Buckets
whose signed root of the likelihood ratio is at least `least` away from chance are kept, all of them unless `terms` sets
a bound. The machine is fitted to the sample's kept buckets, a matrix bounded by `rows` and `BUCKETS`, by AdaGrad.

The screen sees terms one by one, so terms that tell something only together have a screen of their own. Of the `often`
words that most rows of the rarer label have, texts with each two are counted by label, in Spark as well (a table of `often` x
`often` for each label and task). Two words matter if the one, b, is not kept and tells another thing where the other, a,
stands than where it doesn't: the roots of b's table in the texts with a and in those without differ by `apart` standard
deviations. Both words are kept then, and the machine learns their product. Beginnings and repeats are not paired.

Null and empty texts have no terms; their score is that of w0 alone. Rows are scored one by one, whole. Labels that are
null or without a document teach nothing; of repeated labels of one id the largest counts, of several documents of one id
that of the least hash of its text teaches. Without any label of either kind every score is the smoothed share of the
other one. scored() replaces a column of the name that it is given; other columns stay as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutscape.llm.common import WORD_BYTES, written

BUCKETS, SLICES = 1 << 18, 64
#: Most labelled rows that teach.
ROWS = 20_000
#: Words whose pairs are counted.
OFTEN = 1024
#: Words whose terms a task remembers: with and without a choice of buckets (then a word's terms take a kilobyte).
KEPT_WORDS, ALL_WORDS = 200_000, 30_000


def bucket(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) % BUCKETS


def word_terms(word: bytes) -> list[bytes]:
    """The word and its beginnings."""
    text = word.decode()
    return [b"w " + word, *(b"p " + text[:n].encode() for n in range(4, 9) if len(text) >= n)]


class Terms:
    """Buckets of texts; words are looked up in a bounded memory. With `kept` only these buckets, by their place in it."""

    def __init__(self, kept: np.ndarray | None = None) -> None:
        self.kept = None if kept is None else {int(b): i for i, b in enumerate(kept)}
        self.known: dict[bytes, tuple] = {}
        self.most = ALL_WORDS if kept is None else KEPT_WORDS

    def _learn(self, word: bytes) -> tuple:
        """(bucket, what to report if present, what to report if repeated; -1 for nothing) of each term that matters."""
        found = []
        for term in word_terms(word):
            one, two = bucket(term), bucket(b"2 " + term)
            a, b = (one, two) if self.kept is None else (self.kept.get(one, -1), self.kept.get(two, -1))
            if a >= 0 or b >= 0:
                found.append((one, a, b))
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[word] = out = tuple(found)
        return out

    def of(self, text: bytes | None) -> list[int]:
        """Distinct, in order."""
        seen: set[int] = set()
        found: set[int] = set()
        get = self.known.get
        for word, n in Counter((text or b"").translate(WORD_BYTES).split()).items():
            terms = get(word)
            for one, a, b in self._learn(word) if terms is None else terms:
                if a >= 0:
                    found.add(a)
                if b >= 0 and (n > 1 or one in seen):
                    found.add(b)
                seen.add(one)
        return sorted(found)


@dataclass
class Machine:
    """A fitted factorization machine over the kept buckets."""

    kept: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        x = Rows(rows, len(self.w))
        return 1.0 / (1.0 + np.exp(-np.clip(x.margins(self.w0, self.w, self.v)[0], -30, 30)))


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sum over each row of values by column."""
        return np.bincount(self.row, weights=values[self.col], minlength=self.n)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Sum over each column of values by row."""
        return np.bincount(self.col, weights=values[self.row], minlength=self.width)

    def margins(self, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([self.summed(v[:, f]) for f in range(v.shape[1])], 1)
        squares = self.summed((v**2).sum(1))
        return w0 + self.summed(w) + 0.5 * ((sums**2).sum(1) - squares), sums


def fit(rows: list[list[int]], labels: np.ndarray, kept: np.ndarray, factors: int = 4, steps: int = 150, rate: float = 0.1, decay: float = 1e-4, weight: float = 3.0, seed: int = 1) -> Machine:
    """AdaGrad over all rows on the logistic loss with weight decay; `weight` is how much a positive row counts."""
    x, y, k = Rows(rows, len(kept)), labels.astype(float), len(kept)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    w0, w, v = float(np.log(share / (1 - share))), np.zeros(k), np.random.default_rng(seed).normal(0, 0.01, (k, factors))
    if not k or y.min(initial=1) == y.max(initial=0):
        return Machine(kept, w0, w, v)
    g0, gw, gv = 1e-8, np.full(k, 1e-8), np.full((k, factors), 1e-8)
    scale = np.where(y > 0, weight, 1.0) / np.sqrt(len(y))
    for _ in range(steps):
        d0, dw, dv = gradient(x, y, scale, w0, w, v, decay)
        g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
        w0, w, v = w0 - rate * d0 / np.sqrt(g0), w - rate * dw / np.sqrt(gw), v - 0.3 * rate * dv / np.sqrt(gv)
    return Machine(kept, w0, w, v)


def gradient(x: Rows, y: np.ndarray, scale: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the rows' logistic losses times `scale`, plus half of decay * (|w|^2 + |v|^2), by w0, w and v."""
    margin, sums = x.margins(w0, w, v)
    miss = (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - y) * scale
    own = x.spread(miss)
    dv = np.stack([x.spread(miss * sums[:, f]) for f in range(v.shape[1])], 1) - own[:, None] * v + decay * v
    return float(miss.sum()), own + decay * w, dv


def signed_root(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Signed root of the likelihood ratio of each bucket's counts against independence of the label."""
    pos, neg = pos.astype(float), neg.astype(float)
    both, n = pos + neg, max(n_pos + n_neg, 1)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    g = part(pos, both * n_pos / n) + part(neg, both * n_neg / n)
    g += part(n_pos - pos, (n - both) * n_pos / n) + part(n_neg - neg, (n - both) * n_neg / n)
    return np.sign(pos * n_neg - neg * n_pos) * np.sqrt(np.maximum(2 * g, 0))


def telling_pairs(both: np.ndarray, sizes: np.ndarray, known: np.ndarray, apart: float) -> np.ndarray:
    """Places of the words of pairs that tell more than their words.

    both: by label (0, 1), the rows that have each two words, a word's own rows in the diagonal; sizes: rows by label;
    known: whether a word is kept anyway.
    """
    own = np.diagonal(both, axis1=1, axis2=2)  # label, word
    with_a = [signed_root(both[1][i], both[0][i], own[1, i], own[0, i]) for i in range(len(known))]
    without = [signed_root(own[1] - both[1][i], own[0] - both[0][i], sizes[1] - own[1, i], sizes[0] - own[0, i]) for i in range(len(known))]
    differs = np.abs(np.array(with_a) - np.array(without)).reshape(len(known), -1) / np.sqrt(2) >= apart  # a by row, b by column
    np.fill_diagonal(differs, False)
    differs &= ~known[None, :]
    return np.flatnonzero(differs.any(0) | differs.any(1))


def learn(
    docs: DataFrame, labels: DataFrame, rows: int = ROWS, terms: int | None = None, least: float = 4.0, id: str = "doc_id", text: str = "text",
    label: str = "toxic", often: int = OFTEN, apart: float = 6.0,
) -> Machine:
    """Fits a machine to labels (id, label) of documents."""
    told = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull())
    told = told.groupBy(F.col(id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    n = told.count()
    if n > rows:  # the hash is even, so this share is about `rows`; the limit makes it a bound
        told = told.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * rows / n)).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    body = docs.select(F.col(id).alias("_id"), F.col(text).cast("binary").alias("_t"))
    found = body.join(F.broadcast(told), "_id")  # `rows` labels at most are broadcast
    one = found.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_t"), "_t", "_y")).alias("x"))  # a document for each
    sample = written(one.select("x._y", "x._t"), "labelled")
    width = BUCKETS // SLICES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, known, any_row = np.zeros((2, BUCKETS), np.int32), Terms(), False
        for batch in batches:
            for y, t in zip(batch["_y"], batch["_t"]):
                counts[int(y > 0), known.of(t)] += 1
                any_row = True
        if any_row:
            parts = counts.reshape(2, SLICES, width).transpose(1, 0, 2)
            yield pd.DataFrame({"slice": np.arange(SLICES, dtype=np.int32), "counts": [p.tobytes() for p in parts]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in part["counts"])
        return pd.DataFrame({"slice": [part["slice"].iloc[0]], "counts": [total.tobytes()]})

    shape = "slice int, counts binary"
    summed = sample.mapInPandas(count, shape).groupBy("slice").applyInPandas(add, shape).collect()  # a fixed table of counts
    by_label = {r["_y"]: r["n"] for r in sample.groupBy((F.col("_y") > 0).cast("int").alias("_y")).agg(F.count("*").alias("n")).collect()}
    counts = np.zeros((SLICES, 2, width), np.int64)
    for r in summed:
        counts[r["slice"]] = np.frombuffer(r["counts"], np.int64).reshape(2, width)
    neg, pos = counts.transpose(1, 0, 2).reshape(2, BUCKETS)
    root = signed_root(pos, neg, by_label.get(1, 0), by_label.get(0, 0))
    kept = np.lexsort((np.arange(BUCKETS), -np.abs(root)))[:terms]
    kept = kept[np.abs(root[kept]) >= least]

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for y, t in zip(batch["_y"], batch["_t"]):
                found[int(y > 0)].update(set((t or b"").translate(WORD_BYTES).split()))
        yield pd.DataFrame([(w, int(n0), int(found[1][w])) for w, n0 in ((w, found[0][w]) for w in found[0] | found[1])], columns=["word", "clean", "toxic"])

    rarer = "toxic" if by_label.get(1, 0) <= by_label.get(0, 0) else "clean"
    words = sample.mapInPandas(present, "word binary, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    words = [bytes(r["word"]) for r in words.orderBy(F.desc(rarer), F.desc(F.col("clean") + F.col("toxic")), "word").limit(often).collect()]  # `often` words at most
    place = {w: i for i, w in enumerate(words)}

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, any_row = np.zeros((2, len(words), len(words)), np.float32), False
        for batch in batches:
            for y in (0, 1):
                texts = [t for t, z in zip(batch["_t"], batch["_y"]) if int(z > 0) == y]
                for at in range(0, len(texts), 512):
                    part = texts[at : at + 512]
                    x = np.zeros((len(part), len(words)), np.float32)
                    for i, t in enumerate(part):
                        x[i, [place[w] for w in set((t or b"").translate(WORD_BYTES).split()) if w in place]] = 1
                    tables[y] += x.T @ x
                    any_row = True
        if any_row:
            yield pd.DataFrame({"row": np.arange(len(words), dtype=np.int32), "counts": [tables[:, i].astype("<i4").tobytes() for i in range(len(words))]})

    def add_rows(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i4").astype(np.int64) for c in part["counts"])
        return pd.DataFrame({"row": [part["row"].iloc[0]], "counts": [total.astype("<i4").tobytes()]})

    if words and len(by_label) == 2:
        both = np.zeros((2, len(words), len(words)), np.int64)
        shape = "row int, counts binary"
        for r in sample.mapInPandas(together, shape).groupBy("row").applyInPandas(add_rows, shape).collect():  # a fixed table of counts
            both[:, r["row"]] = np.frombuffer(r["counts"], "<i4").reshape(2, -1)
        buckets = np.array([bucket(b"w " + w) for w in words])
        chosen = telling_pairs(both, np.array([by_label.get(0, 0), by_label.get(1, 0)]), np.isin(buckets, kept), apart)
        kept = np.union1d(kept, buckets[chosen])
    kept = np.sort(kept)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Terms(kept)
        for batch in batches:
            yield pd.DataFrame({"y": (batch["_y"] > 0).astype("int32"), "x": [known.of(t) for t in batch["_t"]]})

    got = sample.mapInPandas(features, "y int, x array<int>").orderBy("y", "x").collect()  # `rows` rows at most
    return fit([r["x"] for r in got], np.array([r["y"] for r in got]), kept)


def scored(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = shared.value
        known = Terms(machine.kept)
        for batch in batches:
            yield pd.Series(machine.scores([known.of(t) for t in batch]))

    return docs.withColumn(name, score(F.col(text).cast("binary")))


def held_out(id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3; such labels must not teach."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
