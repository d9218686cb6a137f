"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length code.

A file holds consecutive documents in the order of their ids. Its ids are ranked by their frequency in the file (ties by
id); a rank takes 1 to 4 bytes, the fewest that hold it. The lengths stand apart in control bytes, four to a byte, so
a reader finds every place by a table lookup over control bytes and a running sum, without branches.

Layout, little-endian: magic `CTOK1\\0\\0\\0`; numbers of documents, ids, table entries, code bytes (4 x u64); the table
of ids by rank (u32); the documents' keys (i64, null as the least number); their numbers of ids (u32); control bytes
(ceil(ids / 4)); code bytes; CRC-32 of all that stands before (u32).

Documents are dealt by range of their id and sorted; each partition writes files of at most `file_ids` ids (or one
document) under a name of its own try, so a repeated task leaves no half file, and the returned rows name the files that
count. These rows stay a table: a task that reads gets its files' names from it, the driver only their number.
Ids are integers; null comes first. A null or empty text is the end id alone. Rows with equal ids stand side by side. An empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cutscape.llm.common import filesystem, written
from cutscape.llm.tokens import encoder

MAGIC = b"CTOK1\0\0\0"
#: Most ids of a file.
FILE_IDS = 2_000_000
#: The key that stands for null.
NULL = -(1 << 63)
#: Lengths of the four codes of a control byte.
LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], 1).astype(np.uint8)


def encoded(ids: np.ndarray, per_doc: np.ndarray, keys: np.ndarray) -> bytes:
    """One file from the ids of consecutive documents, the number of ids of each, and their keys."""
    n = len(ids)
    counts = np.bincount(ids) if n else np.zeros(0, np.int64)
    table = np.lexsort((np.arange(len(counts)), -counts))[: np.count_nonzero(counts)].astype("<u4")
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[table] = np.arange(len(table), dtype=np.uint32)
    ranks = rank_of[ids] if n else np.zeros(0, np.uint32)
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    ends = np.cumsum(size, dtype=np.int64)
    data = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    starts = ends - size
    for k in range(int(size.max()) if n else 0):
        longer = size > k
        data[starts[longer] + k] = (ranks[longer] >> np.uint32(8 * k)).astype(np.uint8)
    head = MAGIC + struct.pack("<4Q", len(per_doc), n, len(table), len(data))
    body = head + table.tobytes() + keys.astype("<i8").tobytes() + per_doc.astype("<u4").tobytes() + control.astype(np.uint8).tobytes() + data.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decoded(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids (u32), the documents' numbers of ids and their keys; raises ValueError if the file is damaged."""
    if content[:8] != MAGIC or len(content) < 44:
        raise ValueError("not a token file")
    docs, n, entries, code_bytes = struct.unpack_from("<4Q", content, 8)
    if len(content) != 44 + 4 * entries + 12 * docs + -(-n // 4) + code_bytes:
        raise ValueError("token file of a wrong length")
    if zlib.crc32(memoryview(content)[:-4]) != struct.unpack("<I", content[-4:])[0]:
        raise ValueError("token file with a wrong checksum")
    at = 40
    table = np.frombuffer(content, "<u4", entries, at)
    keys = np.frombuffer(content, "<i8", docs, at := at + 4 * entries)
    per_doc = np.frombuffer(content, "<u4", docs, at := at + 8 * docs)
    control = np.frombuffer(content, np.uint8, -(-n // 4), at := at + 4 * docs)
    data = np.frombuffer(content, np.uint8, code_bytes, at + len(control))
    size = LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(size, dtype=np.int64) - size
    ranks = data[starts].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        longer = np.flatnonzero(size > k)
        ranks[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return (table[ranks] if n else ranks), per_doc, keys


def put(folder: str, name: str, content: bytes) -> str:
    """Writes a file in one step: under a passing name, then renamed. Returns its URI."""
    where, path = filesystem(folder)
    where.create_dir(path, recursive=True)
    passing = f"{path}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(passing) as out:
        out.write(content)
    where.move(passing, f"{path}/{name}")
    return f"{folder}/{name}"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files; returns (file, documents, ids, first_doc, first_token), the first ones over all files."""
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, attempt = encoder(tokenizer), uuid.uuid4().hex
        lines: list[bytes] = []
        keys: list = []
        held = n_files = 0

        def flush() -> pd.DataFrame:
            nonlocal lines, keys, held, n_files
            per_doc = np.array([len(x) // 4 for x in lines], np.uint32)
            content = encoded(np.frombuffer(b"".join(lines), "<u4"), per_doc, np.array(keys, np.int64))
            name = put(folder, f"{attempt}-{n_files:05d}.ctok", content)
            row = pd.DataFrame({"file": [name], "part": [n_files], "documents": [len(lines)], "ids": [held]})
            lines, keys, held, n_files = [], [], 0, n_files + 1
            return row

        for batch in batches:
            for key, content in zip(batch["_id"], batch["_t"]):
                line = e.encode(content) + end
                if lines and held + len(line) // 4 > file_ids:
                    yield flush()
                lines.append(line)
                keys.append(NULL if pd.isna(key) else int(key))
                held += len(line) // 4
        if lines:
            yield flush()

    dealt = docs.select(F.col(id).alias("_id"), F.col(text).cast("binary").alias("_t")).repartitionByRange("_id")
    files = dealt.sortWithinPartitions("_id").mapInPandas(write, "file string, part int, documents bigint, ids bigint")
    listed = written(files.withColumn("partition", F.spark_partition_id()), "token-files")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = listed.groupBy("partition").agg(F.sum("documents").alias("d"), F.sum("ids").alias("i"))
    whole = earlier(Window.orderBy("partition"))  # a row for each partition
    sums = sums.select("partition", F.coalesce(F.sum("d").over(whole), F.lit(0)).alias("d"), F.coalesce(F.sum("i").over(whole), F.lit(0)).alias("i"))
    before = earlier(Window.partitionBy("partition").orderBy("part"))
    return listed.join(F.broadcast(sums), "partition").select(
        "file", "documents", "ids",
        (F.col("d") + F.coalesce(F.sum("documents").over(before), F.lit(0))).alias("first_doc"),
        (F.col("i") + F.coalesce(F.sum("ids").over(before), F.lit(0))).alias("first_token"),
    )


def read_each(files: DataFrame, read: Callable, schema: T.StructType) -> DataFrame:
    """The rows that read(contents and other columns, as rows) gives of each of the files (file, ...).

    As many tasks as files, up to 100,000; each opens its own.
    """

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                where, path = filesystem(row.file)
                with where.open_input_stream(path, compression=None) as f:
                    content = f.read()
                yield read(content, row)

    n = files.count()
    return files.repartition(max(1, min(n, 100_000))).mapInPandas(opened, schema)


def read_tokens(spark: SparkSession, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(id, doc_no, start, n_tokens, ids_crc32) of every document of the files, doc_no counting in their order."""
    schema = T.StructType.fromDDL("id bigint, doc_no bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")

    def read(content: bytes, row) -> pd.DataFrame:
        ids, per_doc, keys = decoded(content)
        ends = np.cumsum(per_doc, dtype=np.int64)
        starts = ends - per_doc
        whole = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        parts = [whole[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
        return pd.DataFrame({
            "id": pd.Series(keys, dtype="Int64").mask(keys == NULL), "doc_no": row.first_doc + np.arange(len(per_doc)), "start": row.first_token + starts, "n_tokens": per_doc.astype(np.int64),
            "ids_crc32": [zlib.crc32(p) for p in parts], "ids": [bytes(p) for p in parts] if with_ids else None,
        })

    rows = read_each(files.select("file", "first_doc", "first_token"), read, schema)
    return rows if with_ids else rows.drop("ids")
