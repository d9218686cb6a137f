"""Readers and writers by round trips, sample names, sequence functions, re-mapping, streams: small facts."""

import random

from pyspark.sql import functions as F

from cutscape.functions import indel as ix
from cutscape.functions import samples as sm
from cutscape.functions import sequence as sq
from cutscape.operators import details, mapping, mismatch, reports
from cutscape.operators import profile as pr
from cutscape.operators import targets as tg
from cutscape.sources import readers, writers
from cutscape.streaming import ingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_sequence_functions(spark):
    df = frame(spark, [("GATTACA", "GCTTACA"), ("AAAA", "TTTT"), ("", "A"), ("AATAA", "AACAA")], "a string, b string")
    got = df.select(sq.longest_run(F.col("a"), F.col("b")).alias("r"), sq.merged_mismatches(F.col("a"), F.col("b")).alias("m"))
    assert [(r.r.run, r.r.end) for r in got.collect()] == [(5, 6), (-1, -1), (-1, -1), (2, 1)]
    two = frame(spark, [("ACGT", "AGGA")], "a string, b string").select(sq.merged_mismatches(F.col("a"), F.col("b")).alias("m")).first().m
    assert set(two) == {"ACGA", "AGGT"}
    cut = frame(spark, [("AACCGGTTAACC", 6, "FORWARD"), ("AACCGGTTAACC", 6, "REVERSE")], "s string, p int, d string")
    assert [r.x for r in cut.select(sq.cut_relative(F.col("s"), F.col("p"), F.col("d"), F.lit(-1), F.lit(1)).alias("x")).collect()] == ["CCG", "TTA"]
    assert frame(spark, [("a/b.txt",)], "f string").select(sq.file_stem(F.col("f")).alias("x")).first().x == "b"


def test_longest_repeat_by_hand(spark):
    rng = random.Random(2)
    seqs = ["", "A", "AC", "AAAA", "ACGTACG", *("".join(rng.choice("ACGT") for _ in range(rng.randint(3, 25))) for _ in range(30))]
    got = frame(spark, list(enumerate(seqs)), "i int, s string").withColumn("r", mismatch.longest_repeat("s")).collect()
    for r in got:
        n = len(r.s)
        best = max(((k, d, -i) for d in range(1, n - 1) for i in range(n - d) for k in range(1, n - d - i + 1) if r.s[i : i + k] == r.s[i + d : i + d + k]), key=lambda x: (x[0], -x[1], x[2]), default=(0, 0, 1))
        assert (r.r.left, r.r.right, r.r["size"]) == (-best[2], -best[2] + best[1], best[0])


def test_nearest_and_expected_reads(spark):
    rng = random.Random(4)
    a, b = ("".join(rng.choice("ACGT") for _ in range(30)) for _ in range(2))
    rep = "GATTACAGATCC"
    original = a[:10] + rep + b[:5] + rep + a[20:]
    changed = original[:12] + "G" + original[13:]
    o = frame(spark, [("o1", original, "x", 0), ("o2", original[::-1], "x", 1)], "oligo_id string, seq string, comment string, ord int")
    c = frame(spark, [("c1", changed, "x")], "oligo_id string, seq string, comment string")
    r = mismatch.expected_reads(mismatch.nearest(c, o)).first()
    assert (r.original_id, r.mismatches, r.original_repeat) == ("o1", 1, rep) and r.left == 10 and r.right == 27
    assert r.left_read == changed[:22] + changed[39:] and r.right_read == changed[:10] + changed[27:] and r.mixed_reads == []


def test_sample_names(spark):
    names = ["ST_Feb_2018_CAS9_12NA_1600X_DPI7", "ST_June_2017_K562_800x_LV7A_DPI7", "ST_April_2017_K562_800x_7A_DPI7_may", "NULL_Old", "a-b"]
    got = {r.sample: r for r in readers.sample_names(frame(spark, [(n,) for n in names], "sample string")).collect()}
    assert (got[names[0]].cell_line, got[names[0]].dpi, got[names[0]].virus, got[names[0]].coverage) == ("K562", 7, "12NA", "1600X")
    assert (got[names[1]].virus, got[names[1]].date) == ("7A", "June") and (got[names[2]].dpi, got[names[2]].month) == (16, "0may")
    assert got["a-b"].dpi == 0 and got["a-b"].date == "b"
    p = frame(spark, [("A_vs_B.txt",), ("nothing",)], "f string").select(sm.pair_from_name(F.col("f")).alias("p")).collect()
    assert [(r.p.a, r.p.b) for r in p] == [("A", "B"), (None, None)]
    dirs = readers.sample_dirs(frame(spark, [(f"x/data/{n}",) for n in ("K562_7A_DPI7", "K562_6OA_DPI7", "NULL_New", "other")], "path string"))
    assert [r.path for r in dirs.orderBy("ord").collect()] == ["x/data/NULL_New", "x/data/K562_6OA_DPI7", "x/data/K562_7A_DPI7"]
    label = frame(spark, [("top/ST_Feb_2018/data/K562_x",)], "p string").select(sm.label(F.col("p")).alias("l"), sm.short_label(sm.label(F.col("p"))).alias("s")).first()
    assert (label.l, label.s) == ("ST_Feb_2018_K562_x", "K562 x")


def test_more_readers(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    sam = put("x.sam", "@HD\nr1\t0\tchr1\t1000\t9\t5M\t*\t0\t0\tACGTA\tIIIII\nr2\t0\tchr1\t9000\t9\t2M1D3M\t*\t0\t0\tACGTA\tIIIII\nshort\t1\n")
    rows = readers.sam(spark, sam)
    assert rows.count() == 2 and [r.name for r in readers.near_locus(rows, "chr1", 1500).collect()] == ["r1"] and [r.name for r in readers.perfect(rows).collect()] == ["r1"]
    assert [(r.oligo_id, r.pam_idx) for r in readers.pam_table(spark, put("p.txt", "O1\t60\tFORWARD\n")).collect()] == [("O1", 40)]
    w = put("w.txt", "0 10\n-10 0\n\n")
    assert [(r.start, r.end) for r in readers.barcode_windows(spark, w).orderBy("window").collect()] == [(0, 10), (-10, 0)]
    n = put("n.txt", "@@@O1 x\nACGT\tD1_L-1R1\t40\tFORWARD\t12.5\n")
    assert [(r.oligo_id, r.pam_idx, r.percent) for r in readers.null_summaries(spark, n).collect()] == [("O1", 40, 12.5)]
    assert [r.id for r in readers.section_ids(spark, n).collect()] == ["O1 x"] and readers.section_count(spark, n).first().n == 1
    d = put("d.csv", "ID\tGuide\tTarget\tPAM Location\tPAM Direction\tComments\tOld\nO_1\tG\tT\t9\tFORWARD\tc\tTrue\nO_1\tG\tT\t8\tFORWARD\tlast\tFalse\n")
    r = readers.oligo_details(spark, d).first()
    assert (r.pam_idx, r.comments, r.old) == (8, "last", False)
    on = put("m.txt", "Old New\nO1 N1\nO2 matchlessA\n")
    assert [(r.old_id, r.new_id) for r in readers.old_new_ids(spark, on).collect()] == [("O1", "N1")]
    f = put("f.fa", ">O1.r1\nAC\n>O1.r2\nAC\n>O2.r3\nAC\n")
    assert {(r.oligo_id, r.n) for r in readers.mapped_ids(spark, f).collect()} == {("O1", 2), ("O2", 1)}
    s = put("s.txt", "Library_Name_s\tRun_s\nx_chr1:1-2_K562_d11\tR1\nx_chr1:1-2_K562_d11_R2\tR2\n")
    assert {(r.location, r.cell, r.time, r.run) for r in readers.sequencing_runs(spark, s).collect()} == {("chr1:1-2", "K562", "d11", "R1"), ("chr1:1-2", "K562", "d11", "R2")}
    assert [(r.farm, r.original) for r in readers.file_map(spark, put("fm.txt", "a b\n")).collect()] == [("b", "a")]
    t = readers.template(spark, put("t.fa", ">Site1_X 30 FORWARD\nACGTACGT\n")).first()
    assert (t.oligo_id, t.pam_idx, t.direction, t.seq) == ("Site1", 30, "FORWARD", "ACGTACGT")
    q = readers.fastq_of_guide(spark, put("q.fastq", "@a.1\nAC\n+\nII\n@b\nAC\n+\nII\n"), "G1")
    assert {r.read_id for r in q.collect()} == {"a.1", "G1.b"}
    lines = frame(spark, [(0, "@@@G_chr1_100_+ ACGT 50.0"), (1, "@@@G_chr2_100_+ ACGT 50.0")], "line_no int, value string")
    assert readers.guide_info(lines, "G_chr2_100_+").first().chrom == "2"


def test_writers_round_trip(spark, tmp_path):
    t = frame(spark, [("O1", "AATCATGCTCTATGCGAGACAATCATGCTC", 15)], "oligo_id string, seq string, cut_idx int")
    mh = tg.microhomology_indels(t)
    writers.repeat_text(mh, str(tmp_path / "mh"))
    back = readers.repeat_deletions(spark, str(tmp_path / "mh"))
    assert sorted(map(tuple, back.collect())) == sorted((r.oligo_id, r.left_start, r.right_start, r.mh_len, r.indel) for r in mh.collect())
    ins = details.short_inserts(t)
    writers.insert_table(ins, str(tmp_path / "ins"))
    (tmp_path / "wide.txt").write_text("head line\n" + "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "ins")).collect()))
    again = readers.insert_details(spark, str(tmp_path / "wide.txt"))
    assert sorted(map(tuple, again.collect())) == sorted((r.oligo_id, r.ins, r.indel, r.left_base, r.right_base) for r in ins.collect())
    m = frame(spark, [("r1 d", [("O1", "D1_L-1R1", "-"), ("O2", "-", "M3")]), ("r2", None)], "description string, hits array<struct<oligo_id:string,indel:string,muts:string>>")
    writers.mapping_text(m, str(tmp_path / "map"))
    assert {r.description: (r.oligo_ids, r.muts) for r in readers.mappings(spark, str(tmp_path / "map")).collect() if r.oligo_ids} == {"r1 d": (["O1", "O2"], ["-", "M3"])}
    writers.by_bucket(frame(spark, [("Oligo1234", 1), ("Oligo7", 2)], "oligo_id string, n int"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).filter("bucket = 1").count() == 1
    writers.append_unseen(frame(spark, [("Oligo7", 5, 0), ("Oligo8", 6, 0)], "oligo_id string, n int, bucket int"), str(tmp_path / "b"), "oligo_id")
    (tmp_path / "a.txt").write_text("x\ty\n1\t2\n")
    (tmp_path / "c.txt").write_text("x\ty\n3\t4\n")
    writers.combined(spark, [str(tmp_path / "a.txt"), str(tmp_path / "c.txt")], str(tmp_path / "all"))
    assert {(r.x, r.source_file) for r in spark.read.parquet(str(tmp_path / "all")).collect()} == {("1", "a.txt"), ("3", "c.txt")}
    writers.fasta_of(frame(spark, [("O1 x", "AC"), ("O2 y", "GT")], "description string, seq string"), frame(spark, [("O2",)], "oligo_id string"), str(tmp_path / "fa"))
    assert [(r.id, r.seq) for r in readers.fasta(spark, str(tmp_path / "fa")).collect()] == [("O2", "GT")]
    writers.candidate_text(tg.candidates(t, 2, 1), str(tmp_path / "cand"))
    assert spark.read.text(str(tmp_path / "cand")).filter("value like 'D1%'").count() > 0


def test_remapping(spark):
    rng = random.Random(7)
    seqs = ["".join(rng.choice("ATGC") for _ in range(79)) for _ in range(3)]
    t = frame(spark, [(f"o{i}", s, 53, False) for i, s in enumerate(seqs)], "oligo_id string, seq string, cut_idx int, reverse boolean")
    spoilt = list(seqs[1])
    for k in (1, 6, 11, 66, 71, 76, 3, 8, 13, 68, 73, 78):
        spoilt[k] = "A" if spoilt[k] != "A" else "C"
    reads = frame(spark, [("".join(spoilt),), (seqs[2],)], "seq string")
    got = {r.seq: ([h.oligo_id for h in r.hits], r.by_barcode) for r in mapping.map_with_fallback(reads, t).collect()}
    assert got == {"".join(spoilt): (["o1"], False), seqs[2]: (["o2"], True)}
    templates = t.withColumn("template", F.lit("-")).unionByName(t.withColumn("template", F.lit("D1_L10R12")).withColumn("seq", F.concat(F.substring("seq", 1, 64), F.expr("substring(seq, 66)"))))
    own = mapping.map_within(frame(spark, [("o2", seqs[2][:64] + seqs[2][65:])], "oligo_id string, seq string"), templates).first()
    assert [h.template for h in own.hits] == ["D1_L10R12"]
    edits = frame(spark, [("o0", seqs[0][:50] + seqs[0][54:]), ("o0", "ACGT" * 12)], "oligo_id string, read string")
    assert {r.indel[:2] for r in details.mappable(edits, t).collect()} == {"D4", "Un"}
    first = frame(spark, [("r1", "D1_L-1R1", "-")], "read_id string, indel string, muts string")
    m = frame(spark, [("r1", "o1", "o2", "t", "I1_L-1R0", "M3"), ("r2", "o1", "o1", "t", "-", "-")], "read_id string, oligo_id string, own_oligo string, template string, indel string, muts string")
    assert {(r.read_id, r.oligo_id, r.template, r.indel) for r in details.corrected(m, first).collect()} == {("r1", "o2", "-", "D1_L-1R1"), ("r2", "o1", "t", "-")}


def test_lengths_and_representatives(spark):
    df = frame(spark, [("D3_L-2R2", "-"), ("I2_L-1R0", "D1_L10R12_I1S20"), ("-", "-_D2S30")], "a string, b string")
    assert [r.n for r in df.select(ix.read_length("a", "b").alias("n")).collect()] == [76, 81, 77]
    rows = [("s", "o", "D1_L-1R1", "x", "-", "first", 1), ("s", "o", "D1_L-1R1", "-", "M3", "second", 2), ("s", "o", "D1_L-1R1", "-", "-", "third", 3), ("s", "o", "D1_L-1R1", "-", "-", "last", 4), ("s", "o", "I1_L-1R0", "x", "-", "only", 5)]
    m = frame(spark, rows, "sample string, oligo_id string, indel string, oligo_indel string, muts string, seq string, line_no int")
    assert {(r.indel, r.seq) for r in pr.representative_reads(m).collect()} == {("D1_L-1R1", "last"), ("I1_L-1R0", "only")}
    pad = frame(spark, [("ACGTACGT", "D2_L-2C1R2", 5), ("ACGTACGT", "I1_L-1R0", 5)], "s string, i string, p int").select(details.padded_read(F.col("s"), F.col("i"), F.col("p")).alias("x")).collect()
    assert pad[0].x.text == "AC  GTACGT" and pad[0].x.shared == [1] and pad[1].x.new == [2]


def test_profile_rows(spark):
    s = frame(spark, [("a", "o", "D1_L-1R1", "-", 3), ("a", "p", "D2_L6R9", "-", 4)], "sample string, oligo_id string, indel string, oligo_indel string, reads long")
    p = pr.with_unedited(pr.accepted_profile(s), s)
    assert {(r.oligo_id, r.indel, r.reads) for r in p.collect()} == {("o", "D1_L-1R1", 3), ("o", "-", 0), ("p", "-", 0)}
    assert {(r.oligo_id, r.accepted, r.states) for r in pr.acceptance(s, pr.accepted_profile(s)).collect()} == {("o", 3, 2), ("p", 0, 1)}
    filled = pr.size_counts(pr.accepted_profile(s), filled=20)
    assert filled.count() == 40 and filled.agg(F.sum("reads")).first()[0] == 3
    wild = frame(spark, [("x", "-", "-", 9)], "oligo_id string, indel string, oligo_indel string, reads long")
    assert pr.controlled_profile(s, wild).count() == 0


def test_pairs_in_order(spark):
    rows = [("A", "B", f"o{i}", 30, 30, 1.0) for i in range(10)] + [("A", "C", f"o{i}", 30, 30, 2.0) for i in range(3)] + [("B", "C", f"o{i}", 30, 30, 3.0) for i in range(9)]
    df = frame(spark, rows, "a string, b string, oligo_id string, edited_a long, edited_b long, kl double")
    wide, out = reports.common_pairs_in_order(df, [("A", "B"), ("A", "C"), ("B", "C")], "kl")
    assert out == [("A", "C")] and wide.count() == 9 and set(wide.columns) == {"oligo_id", "A$B", "B$C"}
    names = frame(spark, [("r", "s1"), ("r", "s2"), ("q", "s2")], "result string, sample string")
    assert [r.sample for r in reports.common_samples(names).collect()] == ["s2"]
    lines = frame(spark, [("g", 0.0, 1.0, 2.0, 5.0), ("g", 0.0, 3.0, 2.0, 7.0)], "k string, x0 double, y0 double, x1 double, y1 double")
    assert reports.mean_lines(lines, ["k"], [1.0]).first()["values"] == [4.0]
    f = frame(spark, [("x",), ("y",)], "feature string")
    assert [r.feature for r in reports.missing_features(f, f.filter("feature = 'x'")).collect()] == ["y"]


def test_stream_counts(spark, tmp_path):
    rows = frame(spark, [("s", "o", "-", "-"), ("s", "o", "-", "-"), ("s", "o", "D1_L-1R1", "-")], "sample string, oligo_id string, indel string, oligo_indel string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.indel, r.reads) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("-", 2), ("D1_L-1R1", 1)}
    assert ingest.running_counts(rows).count() == 2
