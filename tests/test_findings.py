"""Faults that only showed on larger tables or odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from cutscape.operators import mapping, samples
from cutscape.operators import targets as tg


def test_places_have_no_gaps(spark):
    """Counts and places come from the same ranges of the order, however often Spark makes the rows."""
    rows = spark.range(0, 20000, numPartitions=7).select("id", (F.xxhash64("id") % 900).alias("x"), F.struct((F.col("id") % 3).alias("a")).alias("s"))
    got = samples.numbered(rows, ["s", "x", "id"], "place", 1).toPandas()
    want = sorted((s["a"], x, i) for i, x, s in zip(got["id"], got["x"], got["s"]))
    got["key"] = [(s["a"], x, i) for i, x, s in zip(got["id"], got["x"], got["s"])]
    assert list(got.sort_values("place")["key"]) == want
    assert sorted(got["place"]) == list(range(1, 20001))


def test_whole_reads_are_told_as_the_aligner_tells_them(spark):
    """Reads that are a target but for the gap, near the ends too, on both strands; and pairs without equal ones."""
    from tests.test_mapping import TARGET, brute, hits, random_targets

    rng = random.Random(5)
    targets = random_targets(rng, 30)
    targets[3] = ("o3", targets[2][1], *targets[2][2:])
    reads = [t[:a] + t[b:] for _, t, *_ in targets for a in (3, 36, 40, 44) for b in (a, a + 2, a + 9, a + 30)] + [t[:4] + "N" + t[5:40] + t[46:] for _, t, *_ in targets[:6]]
    t, r = spark.createDataFrame(targets, TARGET), spark.createDataFrame([(q,) for q in reads], "seq string")
    want = {q: x for q, x in brute(reads, targets).items()}
    got = hits(mapping.whole_hits(r, t))
    assert len(got) > 200 and got == {q: x for q, x in want.items() if x[1] == 2 * len(q)}
    known = hits(mapping.best_pairs(mapping.known_pairs(r.distinct(), t)))
    assert any("N" in q for q in known) and all(want[q] == x for q, x in known.items())
    pairs = tg.barcode_candidates(r, t)
    old = tg.indexed_candidates(r, tg.barcode_keys(t))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, old.collect()))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # of the reads; none of the pairs


def test_features_stay_where_they_are_made(spark):
    """Neither training rows nor size counts shuffle features, and a small file of targets is not one task."""
    from cutscape.operators import model

    rng = random.Random(6)
    t = spark.createDataFrame([(f"o{k}", "".join(rng.choice("ATGC") for _ in range(79)), 53) for k in range(600)], "oligo_id string, seq string, cut_idx int").coalesce(1)
    assert tg.deletions(t).rdd.getNumPartitions() == tg.insertions(t).rdd.getNumPartitions() == 3
    few = t.limit(4)
    rows = model.features_of_targets(few).cache()
    reads = rows.select("oligo_id", "indel", F.pmod(F.hash("oligo_id", "indel"), F.lit(9)).alias("reads")).filter("reads > 3 and oligo_id <> 'o1'")
    key = lambda x: (x["oligo_id"], x["indel"])
    a, b = (sorted(d.collect(), key=key) for d in (model.observed(rows, reads), model.observed_of_targets(few, reads)))
    assert [(*key(x), x["features"]) for x in a] == [(*key(x), x["features"]) for x in b]
    assert max(abs(x["y"] - y["y"]) for x, y in zip(a, b)) < 1e-12
    label = dict(enumerate(model.layout()[0]))
    sizes = {*model.LABELS["InsSize"], *model.LABELS["DelSize"]}
    want = {}
    for x in a:
        for f in x["features"]:
            if label[f] in sizes:
                want[x["oligo_id"], label[f]] = want.get((x["oligo_id"], label[f]), 0) + 1
    assert {(x.oligo_id, x.label): x.indels for x in model.size_counts(few).collect()} == want


def test_masks_say_what_the_tables_of_features_say(spark):
    """Scores and counts by masks, of odd letters, short sequences and edits on a part of the target too."""
    import numpy as np
    import pyarrow as pa

    from cutscape.operators import masks, model

    rng, theta = random.Random(8), np.random.default_rng(1).normal(size=len(model.layout()[0]))
    for n, alphabet, limits in ((79, "ATGC", (30, 2, 4)), (79, "AC", (30, 2, 4)), (30, "ATGCN", (12, 1, 2)), (9, "ATX", (30, 2, 4)), (79, "A", (0, 2, 4))):
        whole = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(5)]
        cuts = [rng.randrange(2, n - 1) for _ in whole]
        trims = [rng.randrange(0, c) for c in cuts]
        part = {"seq": [w[t:] for w, t in zip(whole, trims)], "cut_idx": [c - t for c, t in zip(cuts, trims)], "whole": whole, "trim": trims}
        for columns in ({"seq": whole, "cut_idx": cuts}, part):
            batch = pa.RecordBatch.from_pydict(columns)
            got, want, counts, total = {}, {}, masks.Counts(), np.zeros(len(theta), np.int64)
            for rows, _, m in masks.target_masks(batch, *limits):
                counts.add(m)
                got |= zip(zip(rows[m.edits.owner].tolist(), m.edits.names), m.scores(masks.weights_of(theta)))
            for rows, _, e, found in model.target_features(batch, *limits):
                total += found.counts()
                want |= zip(zip(rows[e.owner].tolist(), e.names), found.scores(theta))
            assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
            assert (counts.total() == total).all()


def test_predictions_are_summed_up_where_they_are_made(spark):
    """A row for each target leaves the tasks; targets that nothing was measured of are not predicted."""
    from conftest import SMALL

    from cutscape.operators import model
    from cutscape.plans import base, catalog, prediction

    t = base.targets(spark, SMALL).limit(40)
    want = {r.oligo_id: r.in_frame for r in model.predicted_in_frame(model.predicted(t, prediction.weights())).collect()}
    got = {r.oligo_id: r.in_frame for r in model.in_frame_of_targets(t, prediction.weights()).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
    every = model.predicted_targets(t, prediction.weights()).groupBy("oligo_id").agg(F.count("*").alias("n"), F.first("in_frame").alias("f"))
    want = {r.oligo_id: (r.n, round(r.f, 9)) for r in every.collect()}
    assert {r.oligo_id: (r.n, round(r.in_frame, 9)) for r in model.states_of_targets(t, prediction.weights()).collect()} == want
    plan = catalog.queries()["predicted_report"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_identifiers_are_parsed_once_they_are_summed_up(spark):
    """No identifier is parsed below the first sum of the reads."""
    from conftest import SMALL

    from cutscape.plans import profiles

    plan = profiles.accepted(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" in plan and "regexp" not in plan[plan.rindex("Aggregate") :]


def test_only_reads_that_are_asked_for_leave_the_tasks(spark):
    """The reads of a repeat's deletion are told where the edits are made; the changed targets are made once."""
    from conftest import SMALL

    from cutscape.operators import mismatch
    from cutscape.plans import reports

    made, originals, both, reads = reports._mismatch_rows(spark, SMALL)
    every = tg.candidates(both).select("oligo_id", "indel", F.pmod(F.hash("oligo_id", "indel"), F.lit(50)).cast("long").alias("reads"))
    got, want = (mismatch.counted(made, originals, both, x) for x in (reads, every))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "places" not in plan and "InMemoryRelation" in plan


def test_equal_reads_count_as_many(spark):
    """Rows of one id and sequence are several reads, a template that is given twice is one."""
    from cutscape.operators import endogenous

    rng = random.Random(9)
    seq = "".join(rng.choice("ATGC") for _ in range(57)) + "GG" + "".join(rng.choice("ATGC") for _ in range(20))
    templates = spark.createDataFrame([("o", seq, 56, "FORWARD")], "oligo_id string, seq string, pam_idx int, direction string")
    shape = "oligo_id string, read_id string, seq string"
    control = spark.createDataFrame([("o", f"c{k}", seq) for k in range(4)], shape)
    edited = spark.createDataFrame([("o", "r", seq[:50] + seq[56:])] * 3 + [("o", "r", seq[:48] + seq[60:]), ("o", "s", seq[:50] + seq[56:])], shape)
    got = endogenous.endogenous_summary(control, edited, templates).collect()
    assert sorted(r.reads for r in got) == [1, 4]
    again = endogenous.endogenous_summary(control, edited, templates.union(templates)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_reads_that_are_there_meet_no_target(spark):
    """Only the numbers of reads are compared; the sequences are made of those that are missing."""
    from conftest import SMALL

    from cutscape.plans import catalog

    plan = catalog.queries()["missing_reads"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Inner") < plan.index("LeftAnti") and "Aggregate" not in plan  # numbers are not shuffled to tell equal ones


def test_placements_stay_where_they_are_made(spark):
    """The number of placements and the first one leave the tasks, not all of them; odd targets give what candidates() gives."""
    from conftest import SMALL

    from cutscape.plans import catalog

    rng = random.Random(10)
    rows = [(f"o{k}", "".join(rng.choice(a) for _ in range(n)), c) for k, (a, n, c) in enumerate([("ATGC", 79, 53), ("A", 79, 53), ("ATGCN", 30, 12), ("AC", 9, 4), ("AT", 5, 0)])]
    t = spark.createDataFrame([*rows, ("none", None, 5)], "oligo_id string, seq string, cut_idx int")
    want = tg.candidates(t).select("oligo_id", "indel", "n", F.col("places")[0]["l"], F.col("places")[0]["r"])
    got = sorted(map(tuple, tg.first_placements(t).collect()))
    assert len(got) > 500 and got == sorted(map(tuple, want.collect()))
    plan = catalog.queries()["gen_indels"](spark, SMALL)._jdf.queryExecution().analyzed().toString()
    assert "places" not in plan
    assert [tg.tasks_for(n) for n in (0, 256, 257, 20_000, 120_000, 1_200_000)] == [1, 1, 2, 79, 256, 1172]


@pytest.mark.parametrize("name", ["symmetric_kl", "median_matrix", "overlap", "pairwise_report", "mean_pair_kl"])
def test_compared_profiles_are_dealt_out_by_oligo(spark, name):
    """Reads are read and shuffled once, by a number of tasks that follows theirs, not by the bytes of the shuffle."""
    from conftest import SMALL

    from cutscape.plans import catalog

    plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("REPARTITION_BY_NUM") == 1
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(a" in x and "indel" in x]  # profiles aren't shuffled again


def test_tasks_follow_the_reads():
    from cutscape.operators import profile

    assert [profile.tasks_for(n) for n in (0, 25_000, 600_000, 36_000_000, 216_000_000, 1_000_000_000)] == [1, 1, 24, 200, 200, 500]


def test_pairs_of_one_sample_and_repeated_pairs(spark):
    """Each row meets the pairs that its sample is in once, both sides of a pair of one sample too."""
    from cutscape.operators import divergence as dv

    p = spark.createDataFrame([("a", "o", "-", 5), ("a", "o", "D1_L-1R1", 3), ("b", "o", "D1_L-1R1", 2), ("b", "o", "I1_L-1R0", 1), ("a", "p", "-", 1)], "sample string, oligo_id string, indel string, reads bigint")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", None), ("b", "c")], "a string, b string")
    got = sorted(dv.paired(p, pairs).collect(), key=repr)
    ab = [("a", "b", "o", "-", 5, None), ("a", "b", "o", "D1_L-1R1", 3, 2), ("a", "b", "o", "I1_L-1R0", None, 1)]
    assert sorted(map(tuple, got), key=repr) == sorted([*ab, ("a", "a", "o", "-", 5, 5), ("a", "a", "o", "D1_L-1R1", 3, 3), ("a", "a", "p", "-", 1, 1)], key=repr)
    twice = dv.paired(p, pairs.filter("b = 'b'").unionByName(pairs.filter("b = 'b'")))
    assert sorted(map(tuple, twice.collect()), key=repr) == sorted([(*x[:4], *(v and 2 * v for v in x[4:])) for x in ab], key=repr)


@pytest.mark.parametrize("name,sums", [("overlap", 3), ("symmetric_kl", 3), ("median_matrix", 4), ("top_indels", 3), ("pairwise_report", 3), ("mean_pair_kl", 4)])
def test_compared_profiles_are_summed_once(spark, name, sums):
    """Accepted rows are summed to profiles by paired() alone; a task doesn't hold each sample's profile beside them."""
    from conftest import SMALL

    from cutscape.plans import catalog

    plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == sums


def test_accepted_rows_are_paired_as_profiles_are(spark):
    """An indel of several templates is one row of a pair; rows that aren't accepted are in neither."""
    from cutscape.operators import divergence as dv
    from cutscape.operators import profile

    rows = [("a", "-", "-", 4), ("a", "-", "-_M-25", 2), ("a", "D1_L-1R1", "-", 3), ("a", "D1_L-1R1", "-_M-25", 5), ("a", "D1_L-1R1", "D1_L-3R-1", 7), ("b", "D1_L-1R1", "-", 1), ("b", "D2_L6R9", "-", 9), ("b", "-", "-", None)]
    summary = spark.createDataFrame([(s, "o", i, t, n) for s, i, t, n in rows], "sample string, oligo_id string, indel string, oligo_indel string, reads bigint")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "a string, b string")
    got, want = (sorted(map(tuple, dv.paired(f(summary), pairs).collect()), key=repr) for f in (profile.accepted_rows, profile.accepted_profile))
    ab, aa = [("a", "b", "o", "-", 6, None), ("a", "b", "o", "D1_L-1R1", 8, 1)], [("a", "a", "o", "-", 6, 6), ("a", "a", "o", "D1_L-1R1", 8, 8)]
    assert got == want == sorted(ab + aa, key=repr)
