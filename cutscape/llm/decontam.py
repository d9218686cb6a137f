"""Benchmark decontamination by a generalised suffix automaton.

The items' words ([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased) build one automaton over words. Each
document's words stream through it; the state gives the longest match that ends at the word. Where a match is as long
as a window (`window` words, or the whole item if that has fewer), the window's words are hit.

Null and empty texts have no words: such items match nothing, such documents are clean. Rows are treated one by one.
Items with equal texts are both reported; repeated items count once. The items are dealt by hash into blocks of about
`block_bytes` of text and written to the shared folder; a task reads its block there, and a Python worker builds its
automaton once. A single item is never cut, so a block can be as large as the largest item.

Documents are read once, whatever the number of blocks. With one block its automaton sees them. With more, a table of a
byte for each slot of window hashes (at most `TAG_BYTES`, made in Spark by slices) tells which block's windows a document
may have; it can name a block too many, never one too few. Only documents that it names a block for go to
automata, each to its blocks, dealt out by block and document, and their hits are merged. The driver holds the table and the
number of blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutscape.llm.common import WORD_BYTES, filesystem, shared_path, spare, written

#: About the bytes of item texts in one automaton, which takes some 150 times as much memory in its worker.
BLOCK_BYTES = 4 << 20
#: Most bytes of the table of window hashes; slices in which it is added up; the tag of slots that several blocks have.
TAG_BYTES, TAG_SLICES, MANY = 1 << 26, 64, 255


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over words; states know which items' windows they end."""

    def __init__(self, items: Iterable[tuple[object, bytes | None]], window: int = 10) -> None:
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        lines = [(key, [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]) for key, text in items]
        for _, line in lines:
            last = 0
            for c in line:
                last = self._extend(last, c)
        #: Items of the full window that ends in a state, and of whole short items: state -> {length: items}.
        self.full: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for key, line in lines:
            state = 0
            for i, c in enumerate(line):
                state = self.next[state][c]
                if i + 1 >= window:
                    state = self.cut_to(state, window)
                    self.full.setdefault(state, set()).add(key)
            if 0 < len(line) < window:
                self.short.setdefault(state, {}).setdefault(len(line), set()).add(key)
        self.least = min([window] + [n for by in self.short.values() for n in by])
        #: The nearest state from here on along the links that has a short item, or -1.
        self.near_short = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.near_short[v] = v if v in self.short else self.near_short[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, c, known)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def cut_to(self, state: int, n: int) -> int:
        """The state of the last n words of a match of at least n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Merged [start, end) word spans that are hit, the items whose windows occur, the longest match."""
        known = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).astype(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        items: set = set()
        longest = 0
        for a, b in edge.reshape(-1, 2).tolist():  # no match reaches over a word that no item has
            if b - a < self.least:
                continue
            state = size = 0
            for i, c in enumerate(known[a:b].tolist(), a):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if c in self.next[state]:
                    state, size = self.next[state][c], size + 1
                longest = max(longest, size)
                hit = 0
                if size >= self.window:
                    hit = self.window
                    items |= self.full[self.cut_to(state, self.window)]
                v = self.near_short[state]
                while v > 0:
                    for n, keys in self.short[v].items():
                        if n <= size:
                            hit = max(hit, n)
                            items |= keys
                    v = self.near_short[self.link[v]]
                if hit:
                    start = i + 1 - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items, longest


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Blocks:
    """The items of a benchmark, written by block to the shared folder."""

    def __init__(self, benchmark: DataFrame, item: str, item_text: str, window: int, block_bytes: int) -> None:
        items = benchmark.select(F.col(item).alias("_i"), F.col(item_text).cast("binary").alias("_t")).filter("_t is not null").distinct()
        total = items.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
        self.n, self.window = -(-total // block_bytes) or 1, window
        self.kind = benchmark.schema[item].dataType.simpleString()
        self.folder = shared_path(benchmark.sparkSession, "items")
        dealt = items.withColumn("_block", F.pmod(F.xxhash64("_i", "_t"), F.lit(self.n)))
        dealt.repartition("_block").write.partitionBy("_block").parquet(self.folder)

    def automaton(self, k: int) -> Automaton:
        """Of a block; a worker keeps the last one."""
        key = (self.folder, k)
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            where, path = filesystem(self.folder)
            files = where.get_file_info(fs.FileSelector(f"{path}/_block={k}", allow_not_found=True))
            parts = [pq.read_table(f.path, filesystem=where, columns=["_i", "_t"]) for f in files if f.path.endswith(".parquet")]
            rows = [row for t in parts for row in zip(t["_i"].to_pylist(), t["_t"].to_pylist())]
            _AUTOMATA[key] = Automaton(sorted(rows, key=lambda r: (str(r[0]), r[1])), self.window)
        return _AUTOMATA[key]


_AUTOMATA: dict[tuple[str, int], Automaton] = {}


def window_hashes(words: list[bytes], longest: int) -> list[np.ndarray]:
    """Hashes of all stretches of 1, 2, ... `longest` words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out, sums, power = [], np.zeros(len(words), np.uint64), np.uint64(1)
    for n in range(1, longest + 1):
        m = max(len(words) - n + 1, 0)
        sums = sums[:m] + h[n - 1 :] * power
        power = power * np.uint64(0x9E3779B97F4A7C15)
        x = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        out.append(x ^ (x >> np.uint64(32)))
    return out


def tag_table(blocks: Blocks, items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """For each slot of window hashes 0 (no window), the block's number + 1, or MANY; and the lengths of windows."""
    window, size = blocks.window, 1 << 16
    words = items.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    while size < min(TAG_BYTES, 2 * words):
        size *= 2
    width = size // TAG_SLICES

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, tag, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], set()
            for text, block in zip(batch["_t"], batch["_block"]):
                line = words_of(text)
                n = min(window, len(line))
                if n:
                    h = window_hashes(line, n)[-1]
                    at.append((h % np.uint64(size)).astype(np.int64))
                    tag.append(np.full(len(h), block + 1 if block + 1 < MANY else MANY, np.uint8))
                    seen.add(n)
            at, tag = np.concatenate(at), np.concatenate(tag)
            for k in range(TAG_SLICES):
                own = at // width == k
                if own.any():
                    yield pd.DataFrame({"slice": [k], "at": [(at[own] % width).astype("<u4").tobytes()], "tag": [tag[own].tobytes()], "lengths": [sorted(seen)]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        low, high = np.full(width, MANY, np.uint8), np.zeros(width, np.uint8)
        for at, tag in zip(part["at"], part["tag"]):
            at, tag = np.frombuffer(at, "<u4"), np.frombuffer(tag, np.uint8)
            np.minimum.at(low, at, tag)
            np.maximum.at(high, at, tag)
        return pd.DataFrame({"slice": [part["slice"].iloc[0]], "tags": [np.where(high == 0, 0, np.where(low == high, low, MANY)).astype(np.uint8).tobytes()], "lengths": [sorted({n for x in part["lengths"] for n in x})]})

    table, lengths = np.zeros((TAG_SLICES, width), np.uint8), set()
    parts = items.mapInPandas(slots, "slice int, at binary, tag binary, lengths array<int>")
    for r in parts.groupBy("slice").applyInPandas(add, "slice int, tags binary, lengths array<int>").collect():  # a fixed table
        table[r["slice"]] = np.frombuffer(r["tags"], np.uint8)
        lengths |= set(r["lengths"])
    return table.reshape(-1), sorted(lengths)


def _found(docs: DataFrame, blocks: Blocks, id: str, text: str) -> tuple[DataFrame, bool]:
    """(_id, _sha, n_words, spans, items, longest) over all blocks, and whether it has a row for each document.

    It does with one block. With more, documents of one id and text have one row, to be joined back by both.
    """
    kind, item_kind = docs.schema[id].dataType.simpleString(), blocks.kind
    spans_kind = "array<struct<start:bigint,end:bigint>>"
    narrow = docs.select(F.col(id).alias("_id"), F.col(text).cast("binary").alias("_t"))

    def told(automaton: Automaton, key, content: bytes | None) -> tuple:
        words = words_of(content)
        spans, found, longest = automaton.scan(words)
        digest = hashlib.sha256(content or b"").digest()
        return key, digest, len(words), [{"start": a, "end": b} for a, b in spans], sorted(found), longest if spans else 0

    columns = ["_id", "_sha", "n_words", "spans", "items", "longest"]
    schema = f"_id {kind}, _sha binary, n_words bigint, spans {spans_kind}, items array<{item_kind}>, longest bigint"
    if blocks.n == 1:

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = blocks.automaton(0)
            for batch in batches:
                yield pd.DataFrame([told(automaton, *row) for row in zip(batch["_id"], batch["_t"])], columns=columns)

        return narrow.mapInPandas(scan, schema), True

    shared = docs.sparkSession.sparkContext.broadcast(tag_table(blocks, docs.sparkSession.read.parquet(blocks.folder)))
    every = list(range(blocks.n))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tags, lengths = shared.value
        for batch in batches:
            rows = []
            for key, content in zip(batch["_id"], batch["_t"]):
                words = words_of(content)
                h = window_hashes(words, max(lengths, default=0))
                met = np.unique(np.concatenate([np.zeros(0, np.uint8), *(tags[(h[n - 1] % np.uint64(len(tags))).astype(np.int64)] for n in lengths)]))
                of = every if MANY in met else [int(t) - 1 for t in met if t]
                rows.append((key, hashlib.sha256(content or b"").digest(), len(words), of, content if of else None))
            yield pd.DataFrame(rows, columns=["_id", "_sha", "n_words", "blocks", "_t"])

    seen = written(narrow.mapInPandas(named, f"_id {kind}, _sha binary, n_words bigint, blocks array<int>, _t binary"), "named").dropDuplicates(["_id", "_sha"])
    visits = seen.filter("size(blocks) > 0").select("_id", "_t", F.explode("blocks").alias("_block"))
    dealt = visits.repartition("_block", F.pmod(F.xxhash64("_id", "_t"), F.lit(64))).sortWithinPartitions("_block")

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([told(blocks.automaton(int(k)), key, t) for key, t, k in zip(batch["_id"], batch["_t"], batch["_block"])], columns=columns)

    @F.pandas_udf(spans_kind)
    def union(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: [{"start": a, "end": b} for a, b in merged((x["start"], x["end"]) for x in xs)])

    hits = dealt.mapInPandas(visit, schema).groupBy("_id", "_sha").agg(  # a row for each block
        union(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"),
    )
    both = seen.select("_id", "_sha", "n_words").alias("s").join(hits.alias("h"), F.expr("s._id <=> h._id and s._sha = h._sha"), "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return both.select("s._id", "s._sha", "n_words", none("spans", spans_kind), none("items", f"array<{item_kind}>"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest")), False


def text_digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256))


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, n_words, spans array<struct<start, end>> of hit words, items array of ids, longest) for every document.

    longest is the longest match, in words, of a document with hits, else 0.
    """
    hits, for_each = _found(docs, Blocks(benchmark, item, item_text, window, block_bytes), id, text)
    if for_each:
        return hits.drop("_sha").withColumnRenamed("_id", id)
    own = docs.select(F.col(id).alias("_id"), text_digest(text).alias("_sha"))
    joined = own.alias("o").join(hits.alias("h"), F.expr("o._id <=> h._id and o._sha = h._sha"))
    return joined.select(F.col("o._id").alias(id), "n_words", "spans", "items", "longest")


def hit_words(spans: str = "spans"):
    """Number of hit words."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def without_hits(
    docs: DataFrame, benchmark: DataFrame, most_coverage: float = 0.5, window: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Documents (doc_id, text, n_chars and others) without what they share with the benchmark.

    The hit words go, with what stands between two of them; a document of which more than `most_coverage` of the words
    is hit goes altogether. Clean documents stay as they are, null texts too, and so do columns besides. Repeated rows are
    judged alike. Both are judged once, on the whole text and the hits of all blocks, so the number of blocks changes no
    row. An empty table on either side changes nothing.
    """
    strings = [c for c, kind in docs.dtypes if kind == "string"]

    def left_over(batch: pd.DataFrame, done: list[str | bool | None]) -> pd.DataFrame:
        keep = [d is not None for d in done]
        out = batch[keep].astype({c: object for c in strings})  # plain columns: Arrow takes no filtered chunks
        left = [d for d in done if d is not None]
        out["text"] = pd.Series([t if d is True else d for t, d in zip(out["text"], left)], out.index, object)
        out["n_chars"] = [n if d is True else len(d) for n, d in zip(out["n_chars"], left)]
        return out

    blocks = Blocks(benchmark, "item_id", "text", window, block_bytes)
    if blocks.n == 1:

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = blocks.automaton(0)
            for batch in batches:
                yield left_over(batch, [cleaned(t, automaton.scan(words_of((t or "").encode()))[0], most_coverage) for t in batch["text"]])

        return docs.mapInPandas(scan, docs.schema)

    hits = _found(docs, blocks, "doc_id", "text")[0]
    passing = [spare(docs, f"_hit_{x}") for x in ("id", "sha", "spans")]
    hits = hits.filter("size(spans) > 0").select(*(F.col(c).alias(n) for c, n in zip(("_id", "_sha", "spans"), passing)))
    same = F.col("doc_id").eqNullSafe(F.col(passing[0])) & (text_digest("text") == F.col(passing[1]))
    marked = docs.join(hits, same, "left").select(*docs.columns, passing[2])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[] if s is None else [(x["start"], x["end"]) for x in s] for s in batch.pop(passing[2])]
            yield left_over(batch, [cleaned(t, s, most_coverage) for t, s in zip(batch["text"], spans)])

    return marked.mapInPandas(cut, docs.schema)


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cleaned(text: str | None, spans: list[tuple[int, int]], most_coverage: float) -> str | bool | None:
    """True: clean. None: to be dropped. Else the text without the hit spans."""
    if not spans:
        return True
    content = (text or "").encode()
    places = [m.span() for m in _WORD.finditer(content.lower())]
    if sum(b - a for a, b in spans) > most_coverage * len(places):
        return None
    out, at = [], 0
    for a, b in spans:
        out.append(content[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, content[at:]]).decode()
