"""Readers in blocks, streams, training, matrices, the mismatch chain, and functions that no query holds against SQL."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutscape.functions import samples as sm
from cutscape.functions import sequence as sq
from cutscape.operators import details, mismatch, model, samples
from cutscape.operators import divergence as dv
from cutscape.operators import targets as tg
from cutscape.operators.align import align
from cutscape.sources import readers, writers
from cutscape.streaming import ingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# files in blocks


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 100 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_in_blocks(spark, tmp_path, small_blocks, end):
    rng = random.Random(1)
    want = set()
    for name in ("a", "b"):
        records = [(f"r{k}", "".join(rng.choice("ACGT") for _ in range(rng.randint(5, 90))), f"r{k} x/{name}") for k in range(40)]
        (tmp_path / f"{name}.fastq").write_text(end.join(f"@{d}{end}{s}{end}+{end}{'I' * len(s)}" for _, s, d in records) + end, newline="")
        want |= {(f"{name}.fastq", i, d, s, "I" * len(s)) for i, s, d in records}
    got = readers.fastq(spark, f"{tmp_path}/*.fastq")
    assert {(r.file.rsplit("/", 1)[1], r.read_id, r.description, r.seq, r.qual) for r in got.collect()} == want
    lines = readers.numbered_lines(spark, f"{tmp_path}/a.fastq")
    assert lines.rdd.getNumPartitions() > 10 or lines.select("block").distinct().count() > 10
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(160))


def test_sections_go_on_over_blocks(spark, tmp_path, small_blocks):
    lines, want, at = [], [], None
    rng = random.Random(2)
    for k in range(300):
        if k % 57 == 0:
            at = f"Oligo{k}"
            lines.append(f"@@@{at} rest")
        lines.append(f"D{k}_L-1R{k}\t-\t{rng.randint(1, 9)}")
        want.append((at, lines[-1].split("\t")[0], int(lines[-1].split("\t")[2])))
    (tmp_path / "s.txt").write_text("\n".join(lines) + "\n")
    got = readers.summaries(spark, str(tmp_path / "s.txt")).collect()
    assert sorted((r.oligo_id, r.indel, r.reads) for r in got) == sorted(want)


def test_malformed_report_raises(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("ACGT:\n  12\n  7\nTTTT:\n")
    assert {(r.seq, tuple(r.wge_ids)) for r in readers.analyser_report(spark, str(tmp_path / "ok.txt")).collect()} == {("ACGT", (12, 7)), ("TTTT", ())}
    for text in ("ACGT:\n  twelve\n", "  12\nACGT:\n"):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(Exception, match="malformed"):
            readers.analyser_report(spark, str(tmp_path / "bad.txt")).collect()


def test_small_readers(spark, tmp_path):
    summary = frame(spark, [("o", "-", "-", 3), ("o", "D1_L-1R1", "-", 4), ("o", "-", "-_M3", 2)], "oligo_id string, indel string, oligo_indel string, reads long")
    assert {(r.oligo_indel, r.reads) for r in readers.null_profile(summary).collect()} == {("-", 3), ("-_M3", 2)}
    assert {(r.oligo_indel, r.reads) for r in readers.null_profile(summary, False).collect()} == {("-", 7), ("-_M3", 2)}
    (tmp_path / "n.txt").write_text("@@@o1\nACGT\t-\t30\tFORWARD\t60.0\nACGG\t-\t20\tREVERSE\t10.0\nACG\tD1_L1R3\t29\tFORWARD\t30.0\n@@@o2\nAC\t-\t7\tREVERSE\t1.0\n")
    null = readers.null_summaries(spark, str(tmp_path / "n.txt"))
    assert {tuple(r) for r in readers.unchanged_pam(null).collect()} == {("o1", 30, False), ("o2", 7, True)}
    (tmp_path / "v.txt").write_text("Old Oligo Id\tNew Oligo Id\tx\nOligo1\tOligo2\t3\n")
    assert [tuple(r) for r in readers.validation_pairs(spark, str(tmp_path / "v.txt")).collect()] == [("Oligo1", "Oligo2")]
    (tmp_path / "sp.txt").write_text("Spacer \tGenomic location of spacer (hg19)\tSpacer sequence\n 3\tchr1:5\tACGT\n")
    assert [tuple(r) for r in readers.spacers(spark, str(tmp_path / "sp.txt"), "Site_").collect()] == [("Site_3", "chr1:5", "ACGT")]
    t = frame(spark, [("Oligo1_x", "A" * 20 + "ACGT" * 5, 20)], "oligo_id string, seq string, cut_idx int")
    inserts = details.short_inserts(t)
    for name in ("p", "q"):
        folder = tmp_path / name
        writers.insert_table(inserts, str(folder))
        part = next(folder.glob("part-*.csv"))
        (tmp_path / f"{name}.txt").write_text("title\n" + part.read_text())
    assert [tuple(r) for r in readers.insert_bases(spark, [str(tmp_path / "p.txt"), str(tmp_path / "q.txt")]).collect()] == [("Oligo1", "A", "A")]


def test_small_writers(spark, tmp_path):
    read = lambda name: sorted(r.value for r in spark.read.text(str(tmp_path / name)).collect())
    profile = frame(spark, [("Oligo7", "-", 1000.0, "AAAA", 50.0), ("Oligo7", "D1_L-1R1", 600.0, "AAA", 50.0), ("Oligo7", "I1_L-1R0", 0.4, "AAAAA", 50.0)], "oligo_id string, indel string, reads double, seq string, in_frame double")
    writers.predicted_reads(profile, str(tmp_path / "r"))
    assert read("r") == sorted(["@@@Oligo7", "0\tAAAA\t-", "1\tAAA\tD1_L-1R1"])
    writers.profiles_by_oligo(profile, str(tmp_path / "b"), least=1.0)
    assert {(r.indel, r.bucket) for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {("-", 0), ("D1_L-1R1", 0)}
    writers.repeats_by_length(frame(spark, [("o", 2), ("p", 3), ("q", 3)], "oligo_id string, mh_len int"), str(tmp_path / "m"))
    assert spark.read.parquet(f"{tmp_path}/m/mh_len=3").count() == 2
    writers.sequences_text(frame(spark, [("ACG",), ("TTT",)], "seq string"), str(tmp_path / "s"))
    assert read("s") == ["ACG", "TTT"]
    writers.dealt_files(spark.range(100), 4, str(tmp_path / "d"))
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "d").glob("part-*.parquet")]
    assert len(sizes) == 4 and sum(sizes) == 100 and max(sizes) - min(sizes) <= 4
    t = frame(spark, [("Oligo5", "ACGTACGTACGT", 6), ("Oligo1500", "AAAACCCCGGGG", 6)], "oligo_id string, seq string, cut_idx int")
    writers.candidate_text(tg.candidates(t, 2, 1).withColumn("seq", F.lit("READ")), str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").glob("bucket=*")) == ["bucket=0", "bucket=1"]
    lines = [r.value for r in spark.read.text(f"{tmp_path}/c/bucket=0").collect()]
    assert lines[0] == "@@@Oligo5" and all(x.split("\t")[3] == "READ" for x in lines[1:]) and any(x.startswith("I1_L-1R0\t") for x in lines)
    hits = "hits array<struct<oligo_id:string,indel:string,muts:string>>"
    writers.mapping_text(frame(spark, [("r1", [("a", "-", "-"), ("b", "-", "M1")], 0.5, 2, True), ("r2", None, 0.1, 3, False)], f"description string, {hits}, seconds double, checked int, by_barcode boolean"), str(tmp_path / "t"))
    assert read("t") == sorted(["@@@", "r1\ta,b\t-,-\t-,M1\t0.5\t2\t1", "r2\tNone\t\t\t0.1\t3\t0"])


def test_small_functions(spark):
    names = frame(spark, [("ST_June_2017_K562_800x_LV7A_DPI7",), ("ST_Feb_2018_K562_800x_12OA_DPI7",)], "s string")
    assert [r.c for r in names.select(sm.plasmid_control(F.col("s")).alias("c")).collect()] == ["ST_April_2017/data/NULL_New", "ST_April_2017/data/NULL_Old"]
    assert frame(spark, [("Oligo5_AC_GT",)], "o string").select(sq.short_id(F.col("o"))).first()[0] == "Oligo5"
    placed = samples.numbered(spark.range(50).withColumn("k", F.pmod(F.col("id") * 7, F.lit(50))), ["k"], "place")
    assert [(r.k, r.place) for r in placed.orderBy("k").collect()] == [(k, k) for k in range(50)]
    assert [r.place for r in samples.stride(placed, "place", 4, 9).orderBy("place").collect()] == [4, 13, 22, 31, 40, 49]
    told = frame(spark, [("s", "o1", 1, 10.0, 20.0, 10, 100), ("s", "o2", 1, 0.0, 0.0, 5, 50), ("s", "o3", 1, 0.0, 0.0, 0, 0)], "sample string, oligo_id string, size int, left_repeat double, right_repeat double, other int, total int")
    assert tuple(details.insert_shares(told).first())[2:] == (5.0, 10.0, 10.0)
    assert tuple(details.insert_shares(told, of_inserts=True).first())[2:] == (12.5, 25.0, 62.5)
    templates = frame(spark, [("o", "-", 5, 90.0, "ACGT"), ("o", "D2_L-30R-27", 5, 10.0, "AC")], "oligo_id string, variant string, reads long, percent double, seq string")
    pams = frame(spark, [("o", 56, "FORWARD")], "oligo_id string, pam_idx int, direction string")
    assert {(r.variant, r.pam_idx) for r in details.null_summary(templates, pams).collect()} == {("-", 56), ("D2_L-30R-27", 54)}


# streams


def test_stream_maps_each_read_once(spark, tmp_path):
    """Repeated ids within and between batches, and a restart after a batch that was not finished, give the batch result."""
    rng = random.Random(3)
    targets = [(f"o{k}", "".join(rng.choice("ACGT") for _ in range(79)), 53, False) for k in range(20)]
    t = frame(spark, targets, "oligo_id string, seq string, cut_idx int, reverse boolean")
    spark.sql("drop table if exists stream_index_test")
    index = tg.store_barcode_index(t, "stream_index_test", buckets=4)
    schema = "read_id string, seq string, time timestamp"
    reads = [(f"r{k}", (s := targets[k % 20][1])[: 50 - k % 4] + s[53 + k % 5 :], k) for k in range(60)]
    rows = lambda some: frame(spark, some, "read_id string, seq string, k int").selectExpr("read_id", "seq", "timestamp_seconds(1700000000 + k) as time")
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    stream = lambda: ingest.map_stream(spark.readStream.schema(schema).parquet(source), t, index, out, log)
    rows(reads[:30] + reads[:10]).write.mode("append").parquet(source)
    stream().awaitTermination(120)
    rows(reads[20:45]).write.mode("append").parquet(source)
    stream().awaitTermination(120)
    import shutil

    last = max((tmp_path / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver had died before the batch was told done
    shutil.rmtree(last.parent / f".{last.name}.crc", ignore_errors=True)
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    rows(reads[40:]).write.mode("append").parquet(source)
    stream().awaitTermination(120)
    from cutscape.operators import mapping

    told = lambda df: sorted((r.read_id, r.score, str(r.hits)) for r in df.select("read_id", "score", "hits").collect())
    assert told(spark.read.parquet(out)) == told(mapping.map_reads(rows(reads).select("read_id", "seq"), t))
    spark.sql("drop table stream_index_test")


# training


def test_all_folds_learn_together(spark):
    rng = random.Random(1)
    t = frame(spark, [(f"o{i}", "".join(rng.choice("ATGC") for _ in range(30)), 15) for i in range(6)], "oligo_id string, seq string, cut_idx int")
    rows = model.features_of_targets(t, 3, 1)
    rows = model.observed(rows, rows.select("oligo_id", "indel", F.pmod(F.hash("oligo_id", "indel"), F.lit(9)).alias("reads"))).cache()
    theta = np.random.default_rng(0).normal(0, 0.2, len(model.layout()[0]))
    lines = defaultdict(list)
    for r in rows.collect():
        lines[r.oligo_id].append((r.features, r.y))
    loss, grad = 0.0, np.zeros(len(theta))
    for told in lines.values():
        z = np.array([theta[f].sum() for f, _ in told])
        p, y = np.exp(z) / np.exp(z).sum(), np.array([y for _, y in told])
        loss += (y * np.log(y / p)).sum()
        for (f, _), d in zip(told, p - y):
            np.add.at(grad, f, d)
    decays = model.penalties(0.01, 0.01)
    got = model.loss_and_gradient(rows, theta)
    assert math.isclose(got[0], loss / len(lines) + decays @ theta**2, rel_tol=1e-9) and np.allclose(got[1], grad / len(lines) + 2 * decays * theta)
    both = model.cross_validated(rows, steps=3)
    for k, fold in enumerate(both):
        own = rows.filter(model.fold_of("oligo_id", 2) != k)
        assert np.allclose(model.train(own, steps=3), fold["theta"])
    packed = model.blocks(rows)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 or "InMemory" in plan
    assert np.array_equal(model.seeded_start(4), model.seeded_start(4)) and abs(model.seeded_start(4).std() - 1) < 0.1


def test_descent_finds_the_minimum():
    scale = np.array([1.0, 30.0, 400.0])
    f = lambda x: (float((scale * (x - 2) ** 2).sum()), 2 * scale * (x - 2))
    assert np.allclose(model.minimise(f, np.zeros(3), steps=60), 2, atol=1e-3)


# matrices


def test_matrix_equals_pairs(spark):
    rng = random.Random(6)
    rows = [(f"p{i}", rng.choice(["-", "I1_L-1R0", *(f"D{k}_L-{k}R1" for k in range(1, 9))]), rng.randint(0, 30)) for i in range(9) for _ in range(rng.randint(0, 12))] + [("none", "-", 5), ("zero", "D1_L-1R1", 0)]
    df = frame(spark, rows, "id string, indel string, reads long")
    got = {(r.a, r.b): r.symmetric_kl for r in dv.divergence_matrix(df, df, block=3).collect()}
    profiles = defaultdict(Counter)
    for i, x, n in rows:
        if x != "-" and n:
            profiles[i][x] += n
    assert set(got) == {(a, b) for a in profiles for b in profiles}
    for (a, b), value in got.items():
        names = set(profiles[a]) | set(profiles[b])
        x, y = (np.array([profiles[s].get(n, 0.5) for n in sorted(names)], float) for s in (a, b))
        x, y = x / x.sum(), y / y.sum()
        assert math.isclose(value, 0.5 * (x * np.log2(x / y) + y * np.log2(y / x)).sum(), abs_tol=1e-9)


# repeats with mismatches


def test_mismatch_chain(spark):
    """Counts of the chain against the aligner, pair by pair, and its slopes against sums."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    originals, changed, targets = [], [], []
    for k in range(12):
        rep = letters(9)
        seq = letters(27) + rep + letters(6) + rep + letters(28)
        copy = list(seq)
        for at in rng.sample(range(28, 35), 1 + k % 2):
            copy[at] = {"A": "C", "C": "A", "G": "T", "T": "G"}[copy[at]]
        for name, s in ((f"o{k}", seq), (f"c{k}", "".join(copy))):
            targets.append((name, s, 39, k % 3 == 0))
        originals.append((f"o{k}", seq, f"g{k}", 0))
        changed.append((f"c{k}", "".join(copy), f"g{k}"))
    c = frame(spark, changed, "oligo_id string, seq string, comment string")
    o = frame(spark, originals, "oligo_id string, seq string, comment string, ord int")
    t = frame(spark, targets, "oligo_id string, seq string, cut_idx int, reverse boolean")
    place = {n: (s, cut, rev) for n, s, cut, rev in targets}
    pairs = {r.oligo_id: r for r in mismatch.expected_reads(mismatch.nearest(c, o)).collect()}
    profile, want = Counter(), {}
    for name, r in pairs.items():
        reads = {"original": (r.original_id, r.original_read), "left": (name, r.left_read), "right": (name, r.right_read)}
        reads |= {f"mixed{i + 1}": (name, m.read) for i, m in enumerate(r.mixed_reads[:2])}
        want[name] = {k: (of, align(*place[of], q)[1]) for k, (of, q) in reads.items()}
        for of, indel in want[name].values():
            profile[of, indel] += rng.randint(1, 40)
        profile[name, "D1_L-1R1"] += 100
        profile[r.original_id, "-"] += 70
    rows = frame(spark, [(*k, n) for k, n in profile.items()], "oligo_id string, indel string, reads long")
    got = mismatch.counted(c, o, t, rows).cache()
    edited = Counter()
    for (of, indel), n in profile.items():
        edited[of] += n * (indel != "-")
    assert {r.oligo_id for r in got.collect()} == set(pairs)
    for r in got.collect():
        for k in ("original", "left", "right", "mixed1", "mixed2"):
            assert r[f"{k}_reads"] == (profile[want[r.oligo_id][k]] if k in want[r.oligo_id] else 0)
        assert (r.indel, r.total, r.original_total) == (want[r.oligo_id]["original"][1], edited[r.oligo_id], edited[pairs[r.oligo_id].original_id])
    shares = mismatch.shares(got).collect()
    slopes = {r.mismatches: r for r in mismatch.slopes(mismatch.shares(got)).collect()}
    assert slopes and sum(r.oligos for r in slopes.values()) == sum(6 <= r["size"] <= 15 for r in shares)
    for n, r in slopes.items():
        some = [x for x in shares if x.mismatches == n and 6 <= x["size"] <= 15]
        assert math.isclose(r.left_by_original, sum(x.original * x.left for x in some) / sum(x.original**2 for x in some))
