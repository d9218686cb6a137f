"""Mapping: the stored barcode index, and comparison with all targets, against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest

from cutscape.operators import align, mapping
from cutscape.operators import targets as tg

TARGET = "oligo_id string, seq string, cut_idx int, reverse boolean"


def random_targets(rng, n, flank=""):
    return [(f"o{k}", "".join(rng.choice("ATGC") for _ in range(79 - len(flank))) + flank, 40 + k % 5, bool(k % 2)) for k in range(n)]


def noisy(rng, t, changes):
    q = list(t[: 38 - rng.randint(0, 5)] + t[42 + rng.randint(0, 8) :])
    for _ in range(changes):
        k = rng.randrange(len(q))
        q[k] = rng.choice(["", *"ATGC"])
    return "".join(q)


def brute(reads, targets):
    """{read: (hits, score)} by alignment with every target."""
    out = {}
    for q in set(reads):
        told = [(*align.align(t, cut, rev, q), o) for o, t, cut, rev in targets]
        best = max(s for s, *_ in told)
        if best > int(0.8 * len(q)):
            out[q] = (sorted((o, i, m) for s, i, m, o in told if s == best), best)
    return out


def hits(df):
    return {r.seq: (sorted((h.oligo_id, h.indel, h.muts) for h in r.hits), r.score) for r in df.collect()}


@pytest.mark.parametrize("flank", ["", "GTTCAGAGCTATGCTGGAAACAGCATAGC"])
def test_all_targets_are_compared(spark, flank):
    """Reads with so many changes that no word of twelve letters is left, and targets that share a flank."""
    rng = random.Random(21)
    targets = random_targets(rng, 60, flank) + [("n1", "N" * 6 + "ACGT" * 18 + "A", 40, False), ("twin", "", 40, False)]
    targets[5] = ("o5", targets[4][1], *targets[4][2:])  # two targets of one sequence tie
    reads = [noisy(rng, rng.choice(targets[:60])[1], c) for c in (0, 1, 4, 8, 12, 16, 20) for _ in range(5)] + [targets[4][1][:60], "ACGT" * 12, "TTTTT", "A"]
    t = spark.createDataFrame(targets, TARGET)
    r = spark.createDataFrame([(q,) for q in reads] + [(None,), ("",)], "seq string").na.drop()
    want = brute([q for q in reads], [x for x in targets if x[1]])
    assert 10 < len(want) < len(reads)
    assert hits(mapping.map_exhaustively(r, t, block=16, group=7)) == want
    assert hits(mapping.map_exhaustively(r, t)) == want


def test_bound_of_scores():
    """No pair scores more than its words allow."""
    rng = random.Random(4)
    pairs = [(t, noisy(rng, t, rng.randint(0, 30))) for _, t, *_ in random_targets(rng, 150)] + [(t, "".join(rng.choice("ATGC") for _ in range(rng.randint(3, 79)))) for _, t, *_ in random_targets(rng, 50)]
    scores = align.best_scores([t for t, _ in pairs], [40] * len(pairs), [q for _, q in pairs])
    for (t, q), s in zip(pairs, scores):
        own = set(mapping._words(t).tolist())
        common = np.array([sum(w in own for w in mapping._words(q).tolist())])
        assert s <= mapping.most_score(len(q), common)[0]
    assert mapping.most_score(75, np.arange(71)).max() == 150 and mapping.most_score(75, np.array([0, 5, 10])).max() < 125


def test_few_are_aligned(monkeypatch):
    """A read that matches one target well is aligned with few others."""
    rng, seen = random.Random(2), []
    targets = random_targets(rng, 400)
    monkeypatch.setattr(mapping, "best_scores", lambda t, c, q, reach, plainly=align.best_scores: (seen.append(len(q)), plainly(t, c, q, reach))[1])
    frame = pd.DataFrame(targets, columns=["oligo_id", "target", "cut_idx", "reverse"])
    read = noisy(rng, targets[7][1], 1)
    score = int(align.best_scores([targets[7][1]], [targets[7][2]], [read])[0])
    x, y, s = mapping.compare_all([read], [score], frame, 4)
    assert (x, y, s) == ([0], [7], [score]) and seen[-1] < 5


def test_stored_index(spark):
    rng = random.Random(5)
    targets = random_targets(rng, 50) + [("short", "ACGTACG", 3, False), ("odd", "ACGTNACGTRACGT" * 5, 30, False)]
    reads = [noisy(rng, rng.choice(targets[:50])[1], 2) for _ in range(60)] + ["ACGTACG", "", targets[-1][1]]
    t, r = spark.createDataFrame(targets, TARGET), spark.createDataFrame([(q,) for q in reads], "seq string")

    def windows(s):
        return [s[0:10], s[5:15], s[-15:-5], s[-10:]] if len(s) >= 15 else None

    want = set()
    for q in set(reads):
        for o, s, *_ in targets:
            a, b = windows(q), windows(s)
            if a and b and any(len(x) == len(y) and sum(m != n for m, n in zip(x, y)) <= 1 and all(n in "ACGT" for m, n in zip(y, x) if m != n) for x, y in zip(a, b)):
                want.add((q, o))
    made = {(x.seq, x.oligo_id) for x in tg.barcode_candidates(r, t).collect()}
    assert {x for x in made if len(x[0]) >= 15 and x[1] != "short"} == want
    spark.sql("drop table if exists barcode_index_test")
    index = tg.store_barcode_index(t, "barcode_index_test", buckets=4)
    found = tg.indexed_candidates(r, index)
    assert {(x.seq, x.oligo_id) for x in found.collect()} == made
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("SortMergeJoin") :]
    assert "Broadcast" not in plan and "Bucketed: true" in scan or "bucket" in scan.lower()
    assert hits(mapping.map_sequences(r.filter("length(seq) > 20"), t, index=index)) == hits(mapping.map_sequences(r.filter("length(seq) > 20"), t))
    spark.sql("drop table barcode_index_test")


def test_windows_of_a_file(spark):
    """Other windows, as a file of barcode places gives them."""
    t = spark.createDataFrame([("a", "ACGTACGTAAAAATTTTTGGGGGCCCCC", 12, False)], TARGET)
    r = spark.createDataFrame([("ACGTACGTCCCCCCCCCCCCCCCCCCCCCCCCCC",), ("TTTTTTTTACGTACGTTTTT",)], "seq string")
    assert [x.seq[:8] for x in tg.barcode_candidates(r, t, ((0, 8),)).collect()] == ["ACGTACGT"]
    assert tg.barcode_candidates(r, t, ((-5, 0),)).count() == 1
