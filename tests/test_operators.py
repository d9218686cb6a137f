"""Small facts about alignment, candidates, microhomologies, profiles, the model and the readers."""

import random

import numpy as np
from pyspark.sql import functions as F

from cutscape.functions import indel as ix
from cutscape.operators import divergence as dv
from cutscape.operators import mapping, model, samples
from cutscape.operators import profile as pr
from cutscape.operators import targets as tg
from cutscape.operators.align import align
from cutscape.sources import readers, writers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_fourteen_candidates(spark):
    t = frame(spark, [("o", "AGCTGCGC", 4)], "oligo_id string, seq string, cut_idx int")
    got = {r.indel for r in tg.candidates(t, deletion=5, insert=1, reach=1).collect()}
    assert got == set("D1_L-1R1 D1_L-2R0 D2_L-1C1R3 D2_L-2R1 D2_L-3R0 D3_L-1R3 D3_L-4C2R2 D4_L-2R3 D4_L-3R2 D4_L-4R1 D5_L-4C1R3 I1_L-1C1R1 I1_L-1R0 I1_L-2C1R0".split())


def test_microhomologies(spark):
    t = frame(spark, [("o", "AATCATGCTCTATGCGAGAC", 8)], "oligo_id string, seq string, cut_idx int")
    got = {(r.left_start, r.right_start, r.mh_len, r.indel) for r in tg.microhomology_indels(t, reach=1).collect()}
    assert got == {(1, 11, 2, "D10_L-8C2R5"), (2, 8, 2, "D6_L-7C2R2"), (4, 11, 4, "D7_L-5C4R7"), (7, 9, 2, "D2_L-2C2R3")}


def test_alignment_agrees_with_closed_form(spark):
    rng, rows = random.Random(5), []
    for k in range(120):
        seq = "".join(rng.choice("ATGC" if k % 2 else "AT") for _ in range(44))
        left, right = rng.randint(14, 20), rng.randint(21, 27)
        rows.append((k, seq, 21, left, right))
    df = frame(spark, rows, "k int, seq string, cut int, l int, r int")
    named = {r.k: r.name for r in df.select("k", tg.deletion_name(F.col("seq"), F.col("cut"), F.col("l"), F.col("r")).alias("name")).collect()}
    for k, seq, cut, left, right in rows:
        if right - left > 1:
            score, indel, muts = align(seq, cut, False, seq[: left + 1] + seq[right:], 4)
            assert (indel, muts) == (named[k], "-"), (seq, left, right)


def test_alignment_mismatches_and_small_gaps():
    t = "ACTAGCTATCAATCGATCGATCGTAGCGAC"
    assert align(t, 10, False, t, 3) == (60, "-", "-")
    assert align(t, 10, False, t[:10] + "G" + t[11:], 3)[:2] == (57, "-") or align(t, 10, False, t[:10] + "G" + t[11:], 3)[1] == "-"
    assert align(t, 10, False, "T" * 20, 3)[1] is None
    assert align(t, 10, True, t[:-1], 3)[2].startswith("D1S")


def test_unedited_pair_has_no_divergence(spark):
    p = frame(spark, [("a", "o", "-", 5), ("b", "o", "-", 7)], "sample string, oligo_id string, indel string, reads long")
    pairs = dv.paired(p, frame(spark, [("a", "b")], "a string, b string"))
    assert dv.kl(pairs).count() == 0 and dv.overlap(pairs).first()["overlap"] == 0.0
    assert dv.entropy(p).filter("entropy <> 0").count() == 0


def test_kl_by_hand(spark):
    p = frame(spark, [("a", "o", "D1_L-1R1", 3), ("a", "o", "I1_L-1R0", 1), ("b", "o", "D1_L-1R1", 2)], "sample string, oligo_id string, indel string, reads long")
    got = dv.kl(dv.paired(p, frame(spark, [("a", "b")], "a string, b string"))).first()
    x, y = np.array([3, 1.0]) / 4, np.array([2, 0.5]) / 2.5
    assert abs(got["kl"] - (x * np.log2(x / y)).sum()) < 1e-9
    assert abs(got["symmetric_kl"] - ((x * np.log2(x / y)).sum() + (y * np.log2(y / x)).sum()) / 2) < 1e-9


def test_wild_type_is_per_row(spark):
    s = "sample string, oligo_id string, indel string, oligo_indel string, reads long"
    rows = [("a", "o", "D1_L-1R1", "-", 1), ("a", "o", "D1_L-1R1", "-_M-25", 60), ("a", "o", "-", "-", 39)]
    wild = [("w", "o", "D1_L-1R1", "-", 10), ("w", "o", "-", "-", 90)]
    got = pr.controlled_profile(frame(spark, rows, s), frame(spark, wild, s).drop("sample")).collect()
    assert {(r.indel, r.reads) for r in got} == {("D1_L-1R1", 60), ("-", 39)}


def test_parse_details_and_mutations(spark):
    df = frame(spark, [("I18_L-13D12C3R0",), ("D9_L-5I1R5_M3N-5[A]",), ("-",), ("-_D1S4",)], "x string")
    got = [r.p for r in df.select(ix.parsed("x").alias("p")).collect()]
    assert (got[0].isize, got[0].l, got[0].d, got[0].c, got[0].r) == (18, -13, 12, 3, 0)
    assert got[1].i == 1 and [(m.op, m.val, m.nt) for m in got[1].muts] == [("M", 3, ""), ("N", -5, "A")]
    assert got[2].isize == 0 and got[2].l is None and got[2].muts == []
    assert [(m.op, m.val) for m in got[3].muts] == [("D", 1), ("S", 4)]


def test_mapping_finds_edit_and_ties(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ATGC") for _ in range(79)) for _ in range(4)] + [None]
    seqs[4] = seqs[0]
    t = frame(spark, [(f"o{i}", s, 53, False) for i, s in enumerate(seqs)], "oligo_id string, seq string, cut_idx int, reverse boolean")
    reads = frame(spark, [(1, seqs[1][:50] + seqs[1][55:]), (2, seqs[0]), (3, "ACGT" * 15)], "read_id long, seq string")
    got = {r.read_id: r.hits for r in mapping.map_reads(reads, t).collect()}
    assert [h.oligo_id for h in got[1]] == ["o1"] and got[1][0].indel.startswith("D5")
    assert [h.oligo_id for h in got[2]] == ["o0", "o4"] and got[3] is None
    one = mapping.unique_hits(mapping.map_reads(reads, t))
    assert [r.read_id for r in one.collect()] == [1]
    null = mapping.null_templates(one, t)
    assert null.filter("oligo_id = 'o1'").agg(F.sum("reads")).first()[0] == 6


def test_resolution_is_reproducible(spark):
    rows = [(r, "o", f"-_M{20 + k}", p, "D1_L-1R1") for r in range(300) for k, p in enumerate((70.0, 30.0))]
    df = frame(spark, rows, "read_id long, oligo_id string, variant string, percent double, indel string")
    a, b = (sorted((r.read_id, r.variant) for r in mapping.resolved(df).collect()) for _ in range(2))
    assert a == b and len(a) == 300 and 150 < sum(v == "-_M20" for _, v in a) < 260


def test_weighted_pick_is_one_per_key(spark):
    df = frame(spark, [(k, i, float(i + 1)) for k in range(50) for i in range(4)], "k long, i int, w double")
    assert samples.weighted_pick(df, ["k"], "w", ["i"]).groupBy("k").count().filter("count <> 1").count() == 0


def test_features_and_gradient(spark):
    names, _ = model.layout()
    assert len(names) == 3633 and sum(len(model.LABELS[g]) for g in model.ORDER) == 273
    rng = random.Random(1)
    t = frame(spark, [(f"o{i}", "".join(rng.choice("ATGC") for _ in range(40)), 20) for i in range(2)], "oligo_id string, seq string, cut_idx int")
    rows = model.candidate_features(tg.candidates(t, deletion=4, insert=1), t)
    reads = rows.select("oligo_id", "indel", (F.pmod(F.xxhash64("oligo_id", "indel"), F.lit(9))).alias("reads"))
    rows = model.observed(rows, reads).cache()
    theta = np.random.default_rng(0).normal(0, 0.1, len(names))
    loss, grad = model.loss_and_gradient(rows, theta)
    for i in np.argsort(-np.abs(grad))[:2]:
        e = np.zeros(len(names))
        e[i] = 1e-4
        up, down = model.loss_and_gradient(rows, theta + e)[0], model.loss_and_gradient(rows, theta - e)[0]
        assert abs((up - down) / 2e-4 - grad[i]) < 1e-5
    trained = model.train(rows, steps=4)
    assert model.loss_and_gradient(rows, trained)[0] < model.loss_and_gradient(rows, np.zeros(len(names)))[0]
    p = model.softmax(model.score(rows, trained))
    assert abs(p.filter("oligo_id = 'o0'").agg(F.sum("reads")).first()[0] - 1000) < 1e-6


def test_readers(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@a x\nACGT\n+\n@@@@\n@b\nTTTT\n+\nIIII\n")
    assert [(r.read_id, r.seq, r.qual) for r in readers.fastq(spark, str(tmp_path / "r.fastq")).orderBy("read_id").collect()] == [("a", "ACGT", "@@@@"), ("b", "TTTT", "IIII")]
    (tmp_path / "t.fa").write_text(">O1_G 10 FORWARD\nACGTACGTACGTACGT\nACGT\n>O2:D1_L1R3:7.5 1 REVERSE\nACGTACGTACGTACGTACGT\n")
    got = {r.oligo_id: r for r in readers.expected_targets(spark, str(tmp_path / "t.fa")).collect()}
    assert got["O1_G"].seq == "ACGT" * 5 and got["O1_G"].cut_idx == 7 and not got["O1_G"].reverse
    assert got["O2"].cut_idx == 4 and got["O2"].reverse and got["O2"].percent == 7.5
    (tmp_path / "s.txt").write_text("@@@O1 extra\nD1_L-1R1\t-\t3\n-\t-\t2\n@@@O2\n-\t-\t1\n")
    assert sorted((r.oligo_id, r.indel, r.reads) for r in readers.summaries(spark, str(tmp_path / "s.txt")).collect()) == [("O1", "-", 2), ("O1", "D1_L-1R1", 3), ("O2", "-", 1)]
    (tmp_path / "m.txt").write_text("@@@hash\nr1 d\tO1,O2\tD1_L-1R1,-\t-,-\nr2\tNone\t-\t-\n")
    m = {r.description: r.oligo_ids for r in readers.mappings(spark, str(tmp_path / "m.txt")).collect()}
    assert m == {"r1 d": ["O1", "O2"], "r2": None}
    (tmp_path / "w.txt").write_text("ACGT:\n\t12\n\t7\nTTTT:\n")
    assert {r.seq: r.wge_ids for r in readers.analyser_report(spark, str(tmp_path / "w.txt")).collect()} == {"ACGT": [12, 7], "TTTT": []}


def test_summary_text_round_trip(spark, tmp_path):
    s = frame(spark, [("O1", "-", "-", 2), ("O1", "D1_L-1R1", "-", 3), ("O2", "I1_L-1R0", "-_M22", 4)], "oligo_id string, indel string, oligo_indel string, reads long")
    writers.summary_text(s, str(tmp_path / "out"))
    back = readers.summaries(spark, str(tmp_path / "out")).drop("file")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s.collect()))
