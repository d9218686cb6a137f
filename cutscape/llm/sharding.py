"""Sharding by a Feistel permutation with cycle walking.

Rows get gapless global numbers (by slices of a hash of the id, in a slice by id). A keyed Feistel network permutes a rectangle of a * b >= n
numbers; a result of n or more is permuted again until it falls below n (cycle walking), which makes it a permutation
of 0..n-1. Row p of the shuffled order goes to shard p mod shards, slot p div shards: shard and slot of any row number
can be computed alone, shards differ by one row at most, slots are gapless.

Law `rows`: counts at most one apart. Rows with equal ids are told apart by size and checksum, and where these are
equal too they are alike in any order. A null text has size 16 and checksum 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutscape.llm.common import with_number

PRIME = (1 << 31) - 1


def round_keys(seed: int, rounds: int = 8) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, from a multiplicative sequence modulo a prime."""
    keys, x = [], seed % (PRIME - 1) + 1
    for _ in range(rounds):
        x = x * 48271 % PRIME
        y = x * 48271 % PRIME
        keys.append((x, y))
        x = y
    return keys


def permute(numbers: np.ndarray, n: int, seed: int = 17, rounds: int = 8) -> np.ndarray:
    """The places of row numbers 0..n-1 in the shuffled order."""
    a = max(1, int(np.ceil(np.sqrt(n))))
    b = max(1, -(-n // a))
    keys = round_keys(seed, rounds)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // b, x % b  # left < a, right < b
        for i, (mul, add) in enumerate(keys):
            f = (right if i % 2 == 0 else left) % PRIME
            f = (f * mul + add) % PRIME
            f = (f * f + mul) % PRIME
            f = (f * mul + add) % PRIME
            if i % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        return left * b + right

    out = once(np.asarray(numbers, np.int64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out


def sharded(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """(id, size, text_crc32, row_no, place, shard, slot) for every row."""
    content = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    narrow = docs.select(
        F.col(id).alias("_id"), (F.octet_length(content) + 16).cast("long").alias("size"), F.crc32(content).alias("text_crc32")
    )
    numbered = with_number(narrow, [], ["_id", "size", "text_crc32"])
    n = docs.count()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = permute(batch["row_no"].to_numpy(), n, seed)
            yield batch.assign(place=at, shard=(at % shards).astype("int32"), slot=at // shards)

    kind = docs.schema[id].dataType.simpleString()
    schema = f"_id {kind}, size bigint, text_crc32 bigint, row_no bigint, place bigint, shard int, slot bigint"
    cols = ["_id", "size", "text_crc32", "row_no"]
    return numbered.select(cols).mapInPandas(place, schema).withColumnRenamed("_id", id)
