"""Document fingerprints by threshold-scaled sketches, with DataFrame functions only.

A text's words (stretches without the white space [\\x20\\x09-\\x0D], A-Z in lower case) make shingles of five words; with
fewer words the whole sequence is the one shingle. The sketch keeps every shingle hash below a fixed fraction 1/`scale`
of the hash range, so sketches of any two texts keep the same hashes: they merge by union, and the share of one sketch
that the other holds estimates containment however unequal the lengths. Where no hash is below the fraction, the least
one stands in, so that only a text without words has an empty sketch. A stand-in goes in a merge as soon as the other
sketch has a hash below the fraction, so merged() is always the sketch of the union of the shingles.

Null texts are empty. Equal texts have equal sketches. Two empty sketches are alike (1), an empty and another are not
(0). In next_documents() rows that repeat an id with another text stand side by side (by hash of the text); exact
repeats count as one document there, and each gives its own row. An empty table gives no rows. Other columns are not
carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutscape.llm.common import with_row_number

SCALE = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """df with the sketch of a text column: an ordered array of distinct hashes."""
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    df = df.withColumn("_w", words).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    five = F.transform(F.sequence(F.lit(0), F.size("_h") - 5), lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(5))))
    whole = F.array(F.xxhash64(F.concat_ws(" ", "_w")))
    shingles = F.when(F.size("_h") >= 5, five).when(F.size("_h") > 0, whole).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_s", shingles).withColumn("_k", below("_s", scale))
    kept = F.when((F.size("_k") == 0) & (F.size("_s") > 0), F.array(F.array_min("_s"))).otherwise(F.col("_k"))
    return df.withColumn(name, F.array_sort(F.array_distinct(kept))).drop("_w", "_h", "_s", "_k")


def below(hashes: str | Column, scale: int = SCALE) -> Column:
    """The hashes in the kept fraction of their range."""
    last = -(1 << 63) + (1 << 64) // scale - 1
    return F.filter(hashes, lambda h: h <= last)


def merged(a: str | Column, b: str | Column, scale: int = SCALE) -> Column:
    """Sketch of the union of two texts' shingles, from sketches of one scale."""
    both = F.array_sort(F.array_union(a, b))
    return F.when((F.size(below(both, scale)) > 0) | (F.size(both) == 0), below(both, scale)).otherwise(F.slice(both, 1, 1))


def jaccard(a: str, b: str) -> Column:
    """Estimated share of common shingles in the union, 0 to 1."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def containment(a: str, b: str, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1.

    Null where it can't be told: a has a stand-in only, and b is no such sketch. An empty a is contained in all.
    """
    told = (F.size(below(a, scale)) > 0) | (F.size(below(b, scale)) == 0)
    share = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(F.size(a) == 0, 1.0).when(F.size(b) == 0, 0.0).when(told, share)


def as_text(sketch: str) -> Column:
    """The hashes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _hash, _n, next_id, next_hash) of every distinct row: the next one in descending order, the first after the last.

    Only ids, hashes and lengths are moved; neighbours meet by their global row numbers.
    """
    rows = docs.select(F.col(id).alias("_id"), F.xxhash64(text).alias("_hash"), F.length(text).alias("_n")).distinct()
    numbered = with_row_number(rows, ["_id", "_hash"])
    n = numbered.count()
    ahead = numbered.select(
        F.col("_id").alias("next_id"), F.col("_hash").alias("next_hash"), F.pmod(F.col("row_no") + 1, F.lit(max(n, 1))).alias("row_no")
    )
    return numbered.join(ahead, "row_no").drop("row_no")


def edited_pairs(docs: DataFrame, id: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """(id, text, edited, sketch, edited_sketch, next_sketch) of every document.

    The edited text is the text with its last half replaced by as much of the next document's beginning. Texts are
    shuffled once, by id; the next document's beginning and sketch once more.
    """
    body = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    pairs = next_documents(body, "_id", "_text")
    ahead = body.join(
        pairs.select(F.col("_id").alias("for_id"), F.col("_hash").alias("for_hash"), "_n", F.col("next_id"), F.col("next_hash")),
        F.col("_id").eqNullSafe(F.col("next_id")) & (F.col("_hash") == F.col("next_hash")),
    )
    ahead = with_sketch(ahead, "_text", "next_sketch", scale).select(
        "for_id", "for_hash", F.col("_text").substr(F.lit(1), F.floor(F.col("_n") / 2).cast("int")).alias("_head"), "next_sketch"
    )
    if body.count() != pairs.count():  # exact repeats: one neighbour is enough
        ahead = ahead.dropDuplicates(["for_id", "for_hash"])
    both = body.join(ahead, F.col("_id").eqNullSafe(F.col("for_id")) & (F.col("_hash") == F.col("for_hash")))
    n = F.length("_text")
    both = both.withColumn("edited", F.concat(F.col("_text").substr(F.lit(1), n - F.floor(n / 2).cast("int")), "_head"))
    both = with_sketch(with_sketch(both, "_text", "sketch", scale), "edited", "edited_sketch", scale)
    return both.select(F.col("_id").alias(id), F.col("_text").alias(text), "edited", "sketch", "edited_sketch", "next_sketch")
