"""The pipeline against a brute-force version of its stages."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cutscape.llm import decontam, toxicity

from test_llm_operators import brute_components, brute_hits, reference_ids

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "packing"]
    (_, tox), (_, near), (_, decon), (_, pack) = pipeline.STAGES
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter(~toxicity.held_out())
    scores = {r.doc_id: r._s for r in toxicity.scored(docs, toxicity.learn(docs, labels), name="_s").collect()}
    kept = tox(spark, docs, SMALL)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, s in scores.items() if s < 0.7}

    rows = [tuple(r) for r in kept.collect()]
    told = {d for (d, _, c), n in brute_components(rows).items() if d == c}
    one = near(spark, kept, SMALL)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(told)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in one.collect()}
    clean = decon(spark, one, SMALL)
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns
    for d, r in before.items():
        n, hit, _ = brute_hits(r.text, items)
        assert (d not in after) == (hit > 0.5 * n)
        if not hit:
            assert after[d] == r
        elif d in after:
            assert len(after[d].text) < len(r.text)

    packed = pack(spark, clean, SMALL).collect()
    ids = dict(zip(after, reference_ids([r.text for r in after.values()])))
    got = {(r.doc_id, r.piece): r for r in packed}
    for d, line in ids.items():
        whole = np.array([*line, 1], "<u4")
        for k, a in enumerate(range(0, len(whole), 4096)):
            assert got.pop((d, k)).ids_crc32 == zlib.crc32(whole[a : a + 4096].tobytes())
    assert not got
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096 and len(used) <= 1.02 * sum(used.values()) / 4096 + 2


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeated_ids_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w59", "other")
    rows = [(1, text), (1, text), (1, near), (1, text.upper()), (1, "other text of its own that is long enough to have shingles"), (2, text + " tail"), (None, text + " end"), (None, "alone"), (None, None), (4, ""), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, df, SMALL).collect()), key=str)
    group = [t for t in (text, near, text.upper()) if (1, t) in got]
    assert len(group) == 1
    assert got == sorted([(1, group[0]), (1, rows[4][1]), (None, "alone"), (None, None), (4, ""), (4, "")], key=str)
    assert decontam.without_hits(df, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == len(rows)
    assert df.filter(F.lit(False)).transform(lambda d: pipeline.pack(spark, d, SMALL)).count() == 0


def test_stages_on_odd_tables(spark):
    """Clashing names, very long and empty texts, repeated rows; empty tables."""
    names = ("_score", "text_hash", "_hash", "_one", "_gone_id", "_gone_hash", "_hit_id", "_hit_sha", "_hit_spans", "_id", "_t", "score", "size", "class", "group", "numbers", "row_no", "spans")
    long = " ".join(f"v{i % 9973}" for i in range(60_000))
    rows = [(1, "a plain text of some words", "en", "s", 5), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, long, "en", "s", 9), (5, long + " tail", "en", "s", 9), (1, "a plain text of some words", "en", "s", 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names})
    for name, stage in pipeline.STAGES[:3]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns
        got = out.collect()
        assert all(r[c] == f"{c} {r.doc_id}" for r in got for c in names), name
        assert sorted(r.doc_id for r in got) == ([1, 2, 3, 4] if name == "ngram_jaccard" else [1, 1, 2, 3, 4, 5]), name
        assert stage(spark, df.limit(0), SMALL).count() == 0
    packed = pipeline.pack(spark, df, SMALL).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5} and sum(r.doc_id == 1 for r in packed) == 2


def test_run_is_the_stages(spark):
    """run() on the small tables against plain versions of all stages, one after the other."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter(~toxicity.held_out())
    clean = {r.doc_id for r in toxicity.scored(docs, toxicity.learn(docs, labels), name="_s").collect() if r._s < pipeline.TOXIC}
    rows = [tuple(r) for r in docs.collect() if r.doc_id in clean]
    kept = {d for (d, _, c), _ in brute_components(rows).items() if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    told = {}
    for d, t, *_ in rows:
        if d in kept:
            n, hit, _ = brute_hits(t, items)
            if hit <= 0.5 * n:
                told[d] = None if hit else t
    got = {}
    for r in pipeline.run(spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(told)
    whole = [d for d, t in told.items() if t is not None]
    for d, ids in zip(whole, reference_ids([told[d] for d in whole])):
        parts = sorted(got[d], key=lambda r: r.piece)
        assert sum(r.length for r in parts) == len(ids) + 1
        assert parts[0].ids_crc32 == zlib.crc32(np.array([*ids, 1], "<u4")[:4096].tobytes())
    used = {}
    for r in (r for rs in got.values() for r in rs):
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
