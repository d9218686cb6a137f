"""Plans: what is made of targets is never broadcast, and tasks follow the number of targets."""

import re

import pytest
from conftest import SMALL

from cutscape.operators import model
from cutscape.operators import targets as tg
from cutscape.plans import base, catalog, prediction

GENERATED = re.compile(r"MapInArrow|MapInPandas|FlatMapGroups|FlatMapCoGroups|Generate ")


def broadcasts_of_generated(df):
    """Lines of a plan that stand below a broadcast and make rows."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(re.match(r"[ :+|\\-]*", x)[0])
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                found += [below] if GENERATED.search(below) else []
    return found


@pytest.mark.parametrize(
    "name",
    ["predict_profile", "predict_in_frame", "predicted_states", "features_sizes", "feature_counts", "observed_shares", "gen_indels", "find_mh", "mh_frequencies", "repeats_with_best",
     "barcode_candidates", "map_reads", "exptargets", "mapped_with_fallback", "mismatch_slopes", "gc_boxes", "predict_few_weights"],
)
def test_generated_rows_are_not_broadcast(spark, name):
    assert broadcasts_of_generated(catalog.queries()[name](spark, SMALL)) == []


def test_tasks_follow_the_targets(spark):
    t = base.targets(spark, SMALL)
    many = t.unionByName(t).unionByName(t).unionByName(t)
    n = many.count()
    assert tg.candidates(many).rdd.getNumPartitions() == -(-n // 256) > 1
    assert model.scores_of_targets(many, prediction.weights()).rdd.getNumPartitions() == -(-n // 256)


def test_profiles_are_read_once(spark):
    for name in ("entropy", "profile_counts", "highest_indel"):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
    full = catalog.queries()["full_pairwise"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert full.count("FileScan") <= 10


@pytest.mark.parametrize(("name", "times"), [("map_reads", 1), ("exptargets", 1), ("endogenous_profiles", 2)])
def test_pairs_are_aligned_once(spark, name, times):
    """The filter on the score stays above the aligner; control templates are made once."""
    plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == times
