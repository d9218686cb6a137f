"""Profiles of endogenous sites: a control's reads make the templates that the edited reads are mapped to, for all guides at once.

One dataflow keyed by guide: control reads are aligned with the guide's template, their frequent variants become templates, edited
reads are cut to the template's ends and mapped to all templates of their guide, ties are drawn, and a summary is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutscape.functions import indel as ix
from cutscape.functions import sequence as sq
from cutscape.operators import mapping
from cutscape.sources.readers import cut_index


def _with_cut(templates: DataFrame) -> DataFrame:
    cut = cut_index(F.length("seq"), F.col("pam_idx"), F.col("direction"))
    return templates.withColumn("cut_idx", cut).withColumn("reverse", F.col("direction") != "FORWARD")


def control_templates(control: DataFrame, templates: DataFrame, least_percent: float = 0.5, reach: int = 4) -> DataFrame:
    """(oligo_id, template, seq, cut_idx, reverse, percent): the unchanged template and the variants that control reads
    (oligo_id, read_id, seq) of templates (oligo_id, seq, pam_idx, direction) show often enough, of any length, each with its own
    place of the PAM. Control reads that don't map are left out."""
    t = _with_cut(templates)
    hits = mapping.map_within(control, t.withColumn("template", F.lit("-")), reach)
    told = control.join(hits, ["oligo_id", "seq"]).select("oligo_id", "read_id", "seq", F.col("hits")[0]["indel"].alias("indel"), F.col("hits")[0]["muts"].alias("muts"))
    found = mapping.expanded_targets(mapping.null_templates(told, t), least_percent, None)
    moved = found.join(t.select("oligo_id", F.col("pam_idx").alias("_pam"), "direction"), "oligo_id")
    moved = moved.withColumn("pam_idx", ix.moved_pam("variant", F.col("_pam"), F.col("direction")))
    return _with_cut(moved).select("oligo_id", F.col("variant").alias("template"), "seq", "cut_idx", "reverse", "percent")


def endogenous_summary(control: DataFrame, edited: DataFrame, templates: DataFrame, least_percent: float = 0.5, reach: int = 4, seed: int = 0) -> DataFrame:
    """(oligo_id, indel, oligo_indel, reads) of edited reads (oligo_id, read_id, seq), by control_templates().

    Reads in which the template's ends aren't found, or that map to no template, are not counted. Null reads neither. Each row
    is a read: rows of one id and sequence make the same choice and count as many, and rows of one id that differ are
    drawn apart. A template that is given twice is one.
    """
    templates = templates.distinct()
    null = control_templates(control, templates, least_percent, reach)
    own = edited.join(templates.select("oligo_id", F.col("seq").alias("_template")), "oligo_id")
    own = own.select("oligo_id", "read_id", sq.trimmed_read(F.col("seq"), F.col("_template")).alias("seq")).filter(F.length("seq") > 0)
    own = own.groupBy("oligo_id", "read_id", "seq").agg(F.count("*").alias("n"))
    hits = mapping.map_within(own, null, reach, ("percent",))
    ties = own.join(hits.select("oligo_id", "seq", F.explode("hits").alias("h")), ["oligo_id", "seq"])
    ties = ties.select("oligo_id", "read_id", "seq", "n", F.col("h.template").alias("variant"), F.col("h.indel").alias("indel"), "h.percent")
    chosen = mapping.resolved(ties.withColumn("read_id", F.concat_ws("/", "oligo_id", "read_id")), seed, ("oligo_id", "read_id", "seq"))
    return chosen.groupBy("oligo_id", "indel", F.col("variant").alias("oligo_indel")).agg(F.sum("n").alias("reads"))
