"""Jaccard self-join on word n-grams by vertical partitioning, and its connected components.

Texts are words [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a document's set is its distinct shingles of `n` words, with
fewer words the whole sequence, without words nothing. Two documents link when the common shingles are at least
`percent` of the union. Shingles are 64-bit hashes, and documents with equal sets are one class.

1. A candidate filter that loses nothing. In any global order of shingles, two sets that link have l shingles in common
   within the first (size - least overlap + l) of each. These prefixes, here in the order of the hash, are counted by
   ranges of the hash; only classes with enough repeated shingles go on. What a task finds repeated among its own
   documents is settled there, so a shingle that very many documents share arrives once for each task, not once for
   each document.
2. The global order of what is left: by a count sketch of its shingles (a fixed table summed over all of them), rare
   ones first, then by hash. A linking pair has one of its first (size - least overlap + 1) shingles in common.
3. Pairs without squares. All members of a shingle's group are first compared with one member (stars); what links is
   one component, whose members need no comparison with each other. Then pairs of different components are listed, and
   of these only such as can link if the group's shingle is their first common one (for one group it is), in groups of
   which at most `LISTED` members are outside the largest component: so a group gives a bounded number of pairs for each
   member. Members of other groups (pages of one template) are told apart by parts: two sets that link differ in at most
   d shingles, so if all shingles are dealt by hash to enough parts, some of them are the same in both; only sets with
   equal parts are compared (see part_keys). No link between components is lost.
4. Verification by vertical partitioning: the global order of step 2 is cut into fragments of equal load, the overlap
   of a pair is counted in each fragment on its own, and the counts are summed for each pair.

Null and empty texts have an empty set and link with nothing; they are their own component. Equal texts with words are
in one component. Rows that repeat an id are documents of their own with that id. An empty table gives no rows. Other
columns are not carried on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutscape.llm.common import SPACE_BYTES, components, joined_evenly, written

#: Fragments of the order in which the overlap of a pair is counted.
FRAGMENTS = 4
#: Members outside the largest component of a group whose pairs are listed by the group's shingle.
LISTED = 2048
#: Counters of the sketch that orders shingles.
COUNTERS, SLICES = 1 << 20, 64
#: Shingles that a task holds before it sends them on; bytes of text that are hashed at a time.
HELD, BLOCK = 600_000, 1 << 18
#: Rows of prefixes or parts that a task gives away at a time.
ROWS = 1 << 18
#: Most bits of the filter that marks candidate classes.
FILTER_BITS = 1 << 26
#: The owner that stands for several.
MANY = (1 << 48) - 1
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([1], np.full(n, 0x100000001B3))).astype(np.uint64), dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], n: int = 5) -> list[np.ndarray]:
    """The ordered distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    block, size = [], 0
    for t in texts:
        block.append(t or b"")
        size += len(block[-1]) + 1
        if size >= BLOCK:
            out += _block_sets(block, n)
            block, size = [], 0
    return out + _block_sets(block, n) if block else out


def _block_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    line = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(SPACE_BYTES), np.uint8)
    inside = line != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [none] * len(texts)
    length = ends - starts
    at = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    power = powers(int(length.max()))
    words = np.add.reduceat((line[at].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(at)) - np.repeat(first, length)], first)
    words = mixed(words + length.astype(np.uint64) * np.uint64(ODD[-1]))
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts - 1, side="right")
    count = np.bincount(of, minlength=len(texts))
    factors = powers(n - 1) * np.uint64(ODD[0]) | np.uint64(1)
    full = max(0, len(words) - n + 1)
    summed = np.zeros(full, np.uint64)
    for k in range(n):
        summed += words[k : k + full] * factors[k]
    shingles = mixed(summed + np.uint64(ODD[1]))
    begin = np.cumsum(count) - count
    sets = []
    for a, c in zip(begin.tolist(), count.tolist()):
        if c >= n:
            s = np.sort(shingles[a : a + c - n + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif c:
            sets.append(mixed((words[a : a + c] * factors[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(ODD[2 + c % 4])))
        else:
            sets.append(none)
    return sets


def class_of(shingles: np.ndarray) -> int:
    """The class of a set: a 64-bit hash of it, signed; 0 for the empty set."""
    h = xxhash.xxh3_64_intdigest(shingles.tobytes()) if len(shingles) else 0
    return h - (1 << 64) if h >= 1 << 63 else h


def least_overlap(size, percent: int):
    """Of a set with any set that links with it: common >= percent of the union >= percent of its size."""
    return -(-size * percent // 100)


def six_bytes(x: np.ndarray, high: bool) -> bytes:
    cols = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(cols[:, 2:] if high else cols[:, :6]).tobytes()


def from_six(content: bytes) -> np.ndarray:
    cols = np.zeros((len(content) // 6, 8), np.uint8)
    cols[:, :6] = np.frombuffer(content, np.uint8).reshape(-1, 6)
    return cols.view("<u8").reshape(-1)


def narrow(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("_t"))


def set_digests(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """(_id, text_hash, n_shingles, class) of every row."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["_t"], n)
            yield pd.DataFrame({"_id": batch["_id"], "text_hash": batch["text_hash"], "n_shingles": [len(s) for s in sets], "class": [class_of(s) for s in sets]})

    return narrow(docs, id, text).mapInPandas(digest, f"_id {docs.schema[id].dataType.simpleString()}, text_hash bigint, n_shingles bigint, class bigint")


def repeated_counts(docs: DataFrame, text: str, percent: int, n: int) -> DataFrame:
    """(key, found): for each class (its low 48 bits) at least the number of prefix shingles that other classes have too."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (4 * partitions - 1).bit_length())

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for s in shingle_sets(batch["_t"], n):
                if len(s):
                    total = len(s)
                    prefix = s[: total - least_overlap(total, percent) + max(1, total // 5)]
                    key = class_of(s) & MANY
                    if key not in held:
                        held[key] = prefix
                        size += len(prefix)
            if size >= HELD:
                yield packed(held)
                held, size = {}, 0
        if held:
            yield packed(held)

    def packed(held: dict[int, np.ndarray]) -> pd.DataFrame:
        sizes = [len(p) for p in held.values()]
        tokens = np.concatenate(list(held.values())) >> np.uint64(16)
        owners = np.repeat(np.array(list(held), np.uint64), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        times = np.diff(np.concatenate((starts, [len(tokens)])))
        again = np.repeat(times > 1, times)
        mine, found = np.unique(owners[again], return_counts=True)
        tokens, owners = tokens[starts], np.where(times > 1, np.uint64(MANY), owners[starts])
        cuts = np.searchsorted(tokens, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(48 - bits))
        rows = [
            (f, six_bytes(tokens[a:b], False), six_bytes(owners[a:b], False), b"")
            for f, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a
        ]
        if len(mine):
            rows.append((int(mine[0]) % (1 << bits), b"", six_bytes(mine, False), found.astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["fragment", "tokens", "owners", "found"])

    def count(part: pd.DataFrame) -> pd.DataFrame:
        sent = part["tokens"].map(len) > 0
        settled = part[~sent]
        keys = [from_six(b"".join(settled["owners"]))]
        found = [np.frombuffer(b"".join(settled["found"]), "<u4").astype(np.int64)]
        tokens, owners = from_six(b"".join(part["tokens"][sent])), from_six(b"".join(part["owners"][sent]))
        if len(tokens):
            order = np.lexsort((owners, tokens))
            tokens, owners = tokens[order], owners[order]
            new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
            fresh = new | np.concatenate(([True], owners[1:] != owners[:-1]))
            tokens, owners, new = tokens[fresh], owners[fresh], new[fresh]
            starts = np.flatnonzero(new)
            times = np.diff(np.concatenate((starts, [len(tokens)])))
            many = np.maximum.reduceat(owners, starts) == MANY
            own = owners[np.repeat((times > 1) | many, times) & (owners != MANY)]
            k, c = np.unique(own, return_counts=True)
            keys.append(k)
            found.append(c)
        return pd.DataFrame({"key": np.concatenate(keys).astype(np.int64), "found": np.concatenate(found)})

    sent = docs.select(F.col(text).cast("binary").alias("_t")).mapInPandas(send, "fragment int, tokens binary, owners binary, found binary")
    counted = sent.groupBy("fragment").applyInPandas(count, "key bigint, found bigint")
    return counted.groupBy("key").agg(F.sum("found").alias("found"))


def candidate_sets(docs: DataFrame, digests: DataFrame, text: str, percent: int, n: int) -> DataFrame:
    """(class, n, set) of every class that may link: sets as ordered 64-bit hashes, binary."""
    sizes = digests.filter("n_shingles > 0").groupBy("class").agg(F.first("n_shingles").alias("n"))
    key = F.col("class").bitwiseAND(F.lit(MANY))
    partner = F.ceil(F.col("n") * percent / 100)  # the least partner has this size, and its l
    enough = F.col("found") >= F.greatest(F.lit(1), F.floor(partner / 5))
    some = sizes.withColumn("key", key).join(repeated_counts(docs, text, percent, n), "key").filter(enough).select("class")
    some = written(some, "candidates")
    total = some.count()
    bits = max(16, min(FILTER_BITS.bit_length() - 1, (64 * total).bit_length()))
    place = F.col("class").bitwiseAND(F.lit((1 << bits) - 1))  # a class is an even hash
    filled = some.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    marks = np.zeros((1 << bits) // 8, np.uint8)  # a filter of at most FILTER_BITS; false marks cost only time
    for r in filled.collect():
        marks[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in shingle_sets(batch["_t"], n):
                c = class_of(s)
                at = c & ((1 << bits) - 1)
                if len(s) and shared.value[at >> 3] >> (at & 7) & 1:
                    rows.append((c, len(s), s.tobytes()))
            yield pd.DataFrame(rows, columns=["class", "n", "set"])

    body = docs.select(F.col(text).cast("binary").alias("_t"))
    return written(body.mapInPandas(sets, "class bigint, n bigint, set binary").dropDuplicates(["class"]), "sets")


@dataclass
class Order:
    """The global order of shingles: by the count of their cell in the sketch, then by hash."""

    counts: np.ndarray
    levels: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Order:
        levels, cells = np.unique(counts, return_counts=True)
        return Order(counts, levels, np.concatenate(([0], np.cumsum(levels * cells))).astype(float))

    def times(self, tokens: np.ndarray) -> np.ndarray:
        return self.counts[(tokens % np.uint64(COUNTERS)).astype(np.int64)]

    def fragments(self, tokens: np.ndarray, n: int) -> np.ndarray:
        """Fragment of each shingle: the order cut into n stretches of about as many occurrences each."""
        level = np.searchsorted(self.levels, self.times(tokens))
        place = self.before[level] + (self.before[level + 1] - self.before[level]) * (tokens.astype(float) / 2.0**64)
        return np.minimum((place * (n / max(self.before[-1], 1.0))).astype(np.int64), n - 1)


def shingle_order(sets: DataFrame) -> Order:
    width = COUNTERS // SLICES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch["set"]), np.uint64)
            counts += np.bincount((tokens % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        if counts.any():
            yield pd.DataFrame({"slice": np.arange(SLICES, dtype=np.int32), "counts": [c.astype("<i8").tobytes() for c in counts.reshape(SLICES, width)]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [part["slice"].iloc[0]], "counts": [sum(np.frombuffer(c, "<i8") for c in part["counts"]).tobytes()]})

    shape = "slice int, counts binary"
    table = np.zeros((SLICES, width), np.int64)
    for r in sets.select("set").mapInPandas(count, shape).groupBy("slice").applyInPandas(add, shape).collect():  # a fixed table
        table[r["slice"]] = np.frombuffer(r["counts"], "<i8")
    return Order.of(table.reshape(-1))


def in_pieces(lines: Iterator[np.ndarray], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Tables (columns by rows) as frames of at most `ROWS` rows, or those of one set, whatever the number of sets of a batch."""
    rows, held = [], 0
    for line in lines:
        if held and held + line.shape[1] > ROWS:
            yield pd.DataFrame(np.concatenate(rows, 1).T, columns=columns)
            rows, held = [], 0
        rows.append(line)
        held += line.shape[1]
    if held:
        yield pd.DataFrame(np.concatenate(rows, 1).T, columns=columns)


def ordered_prefixes(sets: DataFrame, percent: int, order: Broadcast) -> DataFrame:
    """(token, class, n, r) of the repeated shingles among the first (size - least overlap + 1) of each set, rare ones first.

    r is the number of the set's shingles from this one on, the most that it can have in common with a set of which this
    is the first common shingle.
    """

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lines() -> Iterator[np.ndarray]:
            for batch in batches:
                for key, n, content in zip(batch["class"], batch["n"], batch["set"]):
                    tokens = np.frombuffer(content, np.uint64)
                    times = order.value.times(tokens)
                    first = np.lexsort((tokens, times))[: n - least_overlap(n, percent) + 1]
                    at = np.flatnonzero(times[first] > 1)
                    yield np.stack([tokens[first[at]].view(np.int64), np.full(len(at), key), np.full(len(at), n), n - at])

        yield from in_pieces(lines(), ["token", "class", "n", "r"])

    return written(sets.mapInPandas(prefixes, "token bigint, class bigint, n bigint, r bigint"), "prefixes")


def bands(percent: int) -> np.ndarray:
    """Least size of each band of sizes; sets that link are of one band or of neighbouring ones."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(least[-1] * 100 // percent + 1)
    return np.array(least)


def part_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(token, class, n, r, side) of parts of each set; two sets that link have a token in common, on sides that pair.

    Two sets that link, of bands i and j, differ in at most d shingles. Shingles are dealt by hash to groups, some more
    than a quarter of d, so that a few groups of two such sets differ in three shingles at most; a group is dealt to six
    parts, so that three parts of it are the same. Each three parts make a token, by pair of bands: side 2 is for sets of
    one band, 0 and 1 for the smaller and the larger of two. Tokens of empty parts are left out, unless a set has so many
    that no other group need be the same.
    """
    least = bands(percent)
    threes = np.array([[i in c for i in range(6)] for c in combinations(range(6), 3)], np.uint64)

    def tokens_of(h: np.ndarray, i: int, j: int) -> np.ndarray:
        d = int(least[i + 1] + least[j + 1] - 2) * (100 - percent) // (100 + percent)
        spare = 2 + d // 48
        groups = d // 4 + 1 + spare
        cell = ((h % np.uint64(groups)) * np.uint64(6) + (h >> np.uint64(32)) % np.uint64(6)).astype(np.int64)
        sums = np.zeros(groups * 6, np.uint64)
        np.add.at(sums, cell, mixed(h + np.uint64(ODD[4])))
        full = (np.bincount(cell, minlength=groups * 6).reshape(groups, 1, 6) * threes[None].astype(np.int64)).sum(2) > 0
        named = mixed(sums + np.arange(groups * 6, dtype=np.uint64) * np.uint64(ODD[5])).reshape(groups, 6)
        found = (named[:, None, :] * threes[None]).sum(2, dtype=np.uint64) + np.arange(len(threes), dtype=np.uint64) * np.uint64(ODD[6])
        pair = np.array([i * 1000 + j], np.uint64) * np.uint64(ODD[3])
        return mixed((found if (~full).any(1).sum() > spare else found[full]).reshape(-1) + pair).view(np.int64)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lines() -> Iterator[np.ndarray]:
            for batch in batches:
                for key, n, content in zip(batch["class"], batch["n"], batch["set"]):
                    h = mixed(np.frombuffer(content, np.uint64) + np.uint64(ODD[3]))
                    i = int(np.searchsorted(least, n, side="right")) - 1
                    for x, y, side in ((i, i, 2), (i, i + 1, 0), (i - 1, i, 1)):
                        if x >= 0:
                            t = tokens_of(h, x, y)
                            yield np.stack([t, *(np.full(len(t), v) for v in (key, n, n, side))])

        yield from in_pieces(lines(), ["token", "class", "n", "r", "side"])

    return sets.mapInPandas(parts, "token bigint, class bigint, n bigint, r bigint, side bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, order: Broadcast, fragments: int = FRAGMENTS) -> DataFrame:
    """The pairs (a, b) that link: overlaps are counted by fragments of the order and summed."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, n, content in zip(batch["class"], batch["n"], batch["set"]):
                tokens = np.frombuffer(content, np.uint64)
                of = order.value.fragments(tokens, fragments)
                rows += [(key, n, f, tokens[of == f].tobytes()) for f in range(fragments)]
            yield pd.DataFrame(rows, columns=["class", "n", "fragment", "part"])

    @F.pandas_udf("bigint")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = []
        for x, y in zip(a, b):
            both = np.sort(np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))))
            sizes.append(int((both[1:] == both[:-1]).sum()))
        return pd.Series(sizes, dtype="int64")

    parts = sets.mapInPandas(cut_up, "class bigint, n bigint, fragment int, part binary")
    left = pairs.join(parts.select(F.col("class").alias("a"), F.col("n").alias("na"), "fragment", F.col("part").alias("x")), "a")
    both = left.join(parts.select(F.col("class").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("y")), ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", overlap("x", "y").alias("o"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return summed.filter(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def linked_roots(sets: DataFrame, percent: int, stars: int = 2) -> DataFrame:
    """(class, root) of every class that links with another."""
    order = sets.sparkSession.sparkContext.broadcast(shingle_order(sets))
    prefixes = ordered_prefixes(sets, percent, order)
    links = tried = roots = None

    def fits(na: Column, ra: Column, nb: Column, rb: Column) -> Column:
        """Whether sets of these sizes can link if their first common shingle has ra and rb shingles from it on."""
        most = F.least(ra, rb)
        return 100 * most >= percent * (na + nb - most)

    def by_component(members: DataFrame) -> DataFrame:
        if roots is None:
            return members.withColumn("c", F.col("class"))
        return members.join(roots, "class", "left").withColumn("c", F.coalesce("root", "class")).drop("root")

    def groups_of(members: DataFrame) -> DataFrame:
        """(token, most, others) of groups of several components: the largest one, and the members outside it."""
        by = members.groupBy("token", "c").agg(F.count("*").alias("k"), F.min("side").alias("low"), F.max("side").alias("high"))
        groups = by.groupBy("token").agg(F.max(F.struct("k", "c")).alias("m"), F.sum("k").alias("k"), F.min("low").alias("low"), F.max("high").alias("high"))
        groups = groups.filter("low <> high or low = 2")
        return groups.select("token", F.col("m.c").alias("most"), (F.col("k") - F.col("m.k")).alias("others")).filter("others > 0")

    def listed(members: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs of different components that can link; each has a member outside the group's largest component."""
        mixed_groups = members.join(groups, "token")
        named = lambda rows, x: rows.select("token", F.col("class").alias(x), *(F.col(c).alias(c + x) for c in ("n", "r", "c", "side")))
        pairs = named(mixed_groups.filter("c <> most"), "a").join(named(mixed_groups, "b"), "token")
        pairs = pairs.filter("ca <> cb and (sidea = 2 and sideb = 2 or sidea + sideb = 1)")
        return pairs.filter(fits(*map(F.col, ("na", "ra", "nb", "rb")))).select("a", "b")

    def compare(pairs: DataFrame, what: str) -> None:
        nonlocal links, tried, roots
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"pairs-{what}")
        found = written(verified(pairs, sets, percent, order), f"links-{what}")
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        roots = written(components(links).select(F.col("node").alias("class"), "root"), f"roots-{what}")

    for k in range(stars):  # the first hubs are those with the fewest rare shingles: they link with most others
        pick = F.struct(F.col("n") - F.col("r") if k == 0 else F.xxhash64("class", F.lit(k)), "class", "n", "r", "c")
        members = by_component(prefixes).groupBy("token", "c").agg(F.min(pick).alias("m")).select("token", "m")
        hubs = members.groupBy("token").agg(F.min("m").alias("h"), F.count("*").alias("k")).filter("k > 1").drop("k")
        rays = members.join(hubs, "token").filter((F.col("m.c") != F.col("h.c")) & fits(F.col("m.n"), F.col("m.n"), F.col("h.n"), F.col("h.n")))
        compare(rays.select(F.col("m.class").alias("a"), F.col("h.class").alias("b")), f"star{k}")
    placed = by_component(prefixes.withColumn("side", F.lit(2).cast("long")))
    groups = written(groups_of(placed), "groups")
    rest = listed(placed, groups.filter(F.col("others") <= LISTED))
    wide = groups.filter(F.col("others") > LISTED)
    if not wide.isEmpty():
        some = sets.join(placed.join(wide, "token", "left_semi").select("class").distinct(), "class", "left_semi")
        parts = written(by_component(part_keys(some, percent)), "parts")
        rest = rest.unionByName(listed(parts, groups_of(parts)))
    compare(rest, "rest")
    return roots


def near_components(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, text_hash, group) of every row; component_id is the smallest id reachable by links, its
    own included, text_hash (xxhash64) tells rows of one id apart, and group is one number for each component, null for an
    empty set.
    """
    digests = written(set_digests(docs, id, text, n), "digests").withColumn("class", F.when(F.col("n_shingles") > 0, F.col("class")))
    sets = candidate_sets(docs, digests, text, percent, n)
    least = digests.filter("n_shingles > 0").groupBy("class").agg(F.min("_id").alias("own"), F.count("*").alias("rows"))
    roots = linked_roots(sets, percent)
    named = roots.join(least, "class").groupBy("root").agg(F.min("own").alias("low"))
    classes = least.join(roots.join(named, "root").select("class", "root", "low"), "class", "left")
    classes = classes.select("class", F.coalesce("low", "own").alias("component_id"), F.coalesce("root", "class").alias("group"), "rows")
    told = joined_evenly(digests, written(classes, "classes"), ["class"], "rows", digests.count())
    return told.select(F.col("_id").alias(id), "n_shingles", F.coalesce("component_id", "_id").alias("component_id"), "text_hash", "group")
