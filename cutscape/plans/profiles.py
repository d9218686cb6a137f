"""Queries over profiles, with DuckDB's version of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutscape.functions import indel as ix
from cutscape.operators import divergence as dv
from cutscape.operators import profile as pr
from cutscape.plans import base

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Parse of an identifier in DuckDB: head size, details, and the tests that a row must pass.
PARSE = r"""{base},
parsed as (
  select *, substr(indel, 1, 1) as it, split_part(indel, '_', 2) as det,
    case when indel like '-%' then 0 else cast(substr(split_part(indel, '_', 1), 2) as integer) end as sz,
    substr(oligo_indel, 1, 1) as oit, split_part(oligo_indel, '_', 2) as odet,
    case when oligo_indel like '-%' then 0 else cast(substr(split_part(oligo_indel, '_', 1), 2) as integer) end as osz,
    case when split_part(oligo_indel, '_', 3) <> '' then split_part(oligo_indel, '_', 3) when oligo_indel like '-\_%' escape '\' then split_part(oligo_indel, '_', 2) else '' end as om
  from summary
), fields as (
  select *, try_cast(regexp_extract(det, 'L(-?\d+)', 1) as integer) as l, try_cast(regexp_extract(det, 'R(-?\d+)', 1) as integer) as r,
    coalesce(try_cast(regexp_extract(det, 'C(-?\d+)', 1) as integer), 0) as c, coalesce(try_cast(regexp_extract(det, 'I(-?\d+)', 1) as integer), 0) as i,
    coalesce(try_cast(regexp_extract(det, 'D(-?\d+)', 1) as integer), 0) as d,
    try_cast(regexp_extract(odet, 'L(-?\d+)', 1) as integer) as ol, try_cast(regexp_extract(odet, 'R(-?\d+)', 1) as integer) as orr,
    list_transform(regexp_extract_all(om, '[MS]-?\d+'), lambda x: cast(substr(x, 2) as integer)) as points,
    list_transform(regexp_extract_all(om, '[ID]-?\d+'), lambda x: cast(substr(x, 2) as integer)) as gaps
  from parsed
), ok as (
  select *, (it = '-' or not (l > 5 or r < -5)) as spans,
    not (len(list_filter(points, lambda x: x > -20 and x < 6)) > 0 or len(points) > 5 or len(list_filter(gaps, lambda x: x > 2)) > 0
      or (oit <> '-' and (osz > 2 or (ol < 6 and orr > -20)))) as allowed
  from fields
)""".replace("{base}", "with " + base.SUMMARY_SQL)
PROFILE = PARSE + ", profile as (select sample, oligo_id, indel, cast(sum(reads) as bigint) as reads from ok where spans and allowed group by all)"


def dealt_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of all samples, dealt out by oligo; the number of reads is told by the file's footers."""
    return pr.indel_counts(pr.by_oligo(base.mapped(spark, sf_dir), base.table(spark, sf_dir, "lineitem").count()))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all samples, dealt out by oligo."""
    return pr.accepted_profile(dealt_out(spark, sf_dir))


def to_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paired() sums up to the profiles of accepted(), so that a task doesn't hold them twice."""
    return pr.accepted_rows(dealt_out(spark, sf_dir))


@query(PARSE + " select sample, oligo_id, indel, oligo_indel, reads, it as itype, sz as isize, l, r, c, i, d, split_part(indel, '_', 1) as class, sz - i - d as net_size, spans, allowed, cast(len(points) as integer) as n_points, cast(len(gaps) as integer) as n_gaps from ok")
def parse_indel(spark, sf_dir):
    s = base.summary(spark, sf_dir)
    p = ix.parsed("indel")
    return s.withColumn("p", p).select(
        "sample", "oligo_id", "indel", "oligo_indel", "reads", *(F.col(f"p.{x}") for x in ("itype", "isize", "l", "r", "c", "i", "d")),
        ix.head("indel").alias("class"), ix.net_size("indel").alias("net_size"), ix.in_cut_span("indel").alias("spans"), ix.allowed_oligo_indel("oligo_indel").alias("allowed"),
        F.size(F.filter(ix.muts("oligo_indel"), lambda m: m["op"].isin("M", "S"))).alias("n_points"), F.size(F.filter(ix.muts("oligo_indel"), lambda m: m["op"].isin("I", "D"))).alias("n_gaps"),
    )


@query("with " + base.SUMMARY_SQL + " select * from summary")
def indel_counts(spark, sf_dir):
    return base.summary(spark, sf_dir)


@query(PROFILE + " select * from profile")
def profile_basic(spark, sf_dir):
    return accepted(spark, sf_dir)


@query(PARSE + " select sample, oligo_id, indel, cast(sum(reads) as bigint) as reads from ok where spans and allowed and (it = '-' or sz <= 30) group by all")
def profile_without_long(spark, sf_dir):
    return pr.accepted_profile(base.summary(spark, sf_dir), drop_long=True)


@query(PARSE + """, wild as (select oligo_id, indel, sum(reads) as w from ok where sample = 'R' group by all),
shares as (select *, w / sum(w) over (partition by oligo_id) as share from wild),
acc as (select oligo_id, coalesce(sum(reads) filter (spans and allowed), 0) * 100.0 / sum(reads) as pct from ok where sample = 'R' group by all),
rows as (select *, sum(reads) over (partition by sample, oligo_id) as total from ok where sample <> 'R')
select sample, rows.oligo_id, rows.indel, cast(sum(reads) as bigint) as reads from rows left join shares using (oligo_id, indel) join acc using (oligo_id)
where spans and allowed and pct >= 10 and (share is null or rows.indel = '-' or reads / total > share * 1.02) group by all""")
def profile_wt(spark, sf_dir):
    s = base.summary(spark, sf_dir)
    return pr.controlled_profile(s.filter("sample <> 'R'"), s.filter("sample = 'R'").drop("sample"), times=1.02)


@query(PROFILE + """ select sample, oligo_id, indel, reads, round(reads * 100.0 / sum(reads) over w, 6) as percent,
round(case when sum(reads) filter (indel <> '-') over w is null then 100.0 else reads * 100.0 / sum(reads) filter (indel <> '-') over w end, 6) as percent_of_edited,
cast(row_number() over (partition by sample, oligo_id order by (indel <> '-')::int, reads desc, indel desc) as integer) as place
from profile window w as (partition by sample, oligo_id)""")
def profile_counts(spark, sf_dir):
    got = pr.profile_counts(accepted(spark, sf_dir))
    return got.withColumn("percent", F.round("percent", 6)).withColumn("percent_of_edited", F.round("percent_of_edited", 6))


@query(PROFILE + " select case when sample in ('A', 'N') then 'new' else 'old' end as library, oligo_id, indel, cast(sum(reads) as bigint) as reads from profile group by all")
def merged_profile(spark, sf_dir):
    library = F.when(F.col("sample").isin("A", "N"), "new").otherwise("old")
    return pr.merged_profile(accepted(spark, sf_dir).withColumn("library", library))


@query(PROFILE + " select oligo_id, indel, cast(sum(reads) as bigint) as reads from profile where sample in ('A', 'N') group by all")
def combine_profiles(spark, sf_dir):
    p = accepted(spark, sf_dir)
    both = p.filter("sample = 'A'").unionByName(p.filter("sample = 'N'"))
    return both.groupBy("oligo_id", "indel").agg(F.sum("reads").alias("reads"))


@query(PROFILE + " select sample, oligo_id, coalesce(arg_max(indel, (reads, indel)) filter (indel <> '-'), '-') as indel from profile group by all")
def highest_indel(spark, sf_dir):
    return pr.highest_indel(accepted(spark, sf_dir))


RANKED = PROFILE + ", ranked as (select *, cast(row_number() over (partition by sample, oligo_id order by reads desc, indel desc) as integer) as place from profile where indel <> '-')"


@query(RANKED + " select * from ranked where place <= 10")
def limit_profile(spark, sf_dir):
    return pr.top_n(accepted(spark, sf_dir), 10)


@query(RANKED + """, t as (select *, sum(reads) over (partition by sample, oligo_id) as total, count(*) over (partition by sample, oligo_id) as n from ranked),
x as (select * from t where sample = 'A'), y as (select * from t where sample = 'N'),
p as (select oligo_id, coalesce(min(place) filter (x.indel <> y.indel), 0) as first_difference, """ + ", ".join(
    f"round(sum(case when place <= {k} then {s}.reads else 0 end * 100.0 / {s}.total), 6) as percent_{s}_{k}" for k in (3, 5, 10) for s in "xy") + """
  from x join y using (oligo_id, place) group by 1),
c as (select x.oligo_id, """ + ", ".join(f"count(*) filter (greatest(x.place, y.place) <= least({k}, x.n, y.n)) as common_{k}" for k in (3, 5, 10)) + """
  from x join y using (oligo_id, indel) group by 1)
select p.*, """ + ", ".join(f"coalesce(common_{k}, 0) as common_{k}" for k in (3, 5, 10)) + " from p left join c using (oligo_id)")
def top_indels(spark, sf_dir):
    got = dv.compare_tops(to_pair(spark, sf_dir), spark.sql("select 'A' as a, 'N' as b")).drop("a", "b")
    named = {c: c.replace("_a_", "_x_").replace("_b_", "_y_") for c in got.columns}
    return got.select(*(F.round(c, 6).alias(n) if c.startswith("percent") else F.col(c) for c, n in named.items()))


def pairs(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values ('A', 'N'), ('A', 'R'), ('N', 'R') as t(a, b)")


PAIRED = PROFILE + """, pairs(a, b) as (values ('A', 'N'), ('A', 'R'), ('N', 'R')),
both as (
  select pairs.a, pairs.b, coalesce(x.oligo_id, y.oligo_id) as oligo_id, coalesce(x.indel, y.indel) as indel, x.reads as p, y.reads as q
  from pairs, lateral (select * from profile where sample = pairs.a) x full join (select * from profile) y on false where false
), u as (
  select a, b, oligo_id, indel, sum(p) as p, sum(q) as q from (
    select a, b, oligo_id, indel, reads as p, null as q from pairs join profile on sample = a union all
    select a, b, oligo_id, indel, null, reads from pairs join profile on sample = b) group by all
), paired as (select * from u qualify count(p) over (partition by a, b, oligo_id) > 0 and count(q) over (partition by a, b, oligo_id) > 0)"""
PAIRED = PAIRED.replace(PAIRED[PAIRED.index("both as ("):PAIRED.index("u as (")], "")
KL = PAIRED + """, s as (select *, coalesce(p, 0.5)::double as x, coalesce(q, 0.5)::double as y from {paired} where indel <> '-'),
n as (select *, x / sum(x) over w as pp, y / sum(y) over w as qq from s window w as (partition by a, b, oligo_id)),
kl as (select a, b, oligo_id, sum(pp * log2(pp / qq)) as kl, 0.5 * sum(pp * log2(pp / qq) + qq * log2(qq / pp)) as symmetric_kl from n group by all)"""


@query(KL.replace("{paired}", "paired") + " select a, b, oligo_id, round(kl, 6) as kl, round(symmetric_kl, 6) as symmetric_kl from kl")
def symmetric_kl(spark, sf_dir):
    return dv.kl(dv.paired(to_pair(spark, sf_dir), pairs(spark))).select("a", "b", "oligo_id", dv.rounded("kl"), dv.rounded("symmetric_kl"))


def _class(source: str) -> str:
    sql = PROFILE.replace(", profile as (", ", whole as (") + source
    return sql + PAIRED[len(PROFILE):] + KL[len(PAIRED):].replace("{paired}", "paired") + " select a, b, oligo_id, round(symmetric_kl, 6) as symmetric_kl from kl"


@query(_class(", profile as (select sample, oligo_id, split_part(indel, '_', 1) as indel, cast(sum(reads) as bigint) as reads from whole where indel <> '-' group by all)"))
def class_kl(spark, sf_dir):
    classes = pr.class_profile(accepted(spark, sf_dir))
    return dv.kl(dv.paired(classes, pairs(spark))).select("a", "b", "oligo_id", dv.rounded("symmetric_kl"))


@query(_class(", profile as (select sample, oligo_id, split_part(indel, '_', 1) as indel, cast(sum(reads) as bigint) as reads from (select * from whole where indel <> '-' qualify row_number() over (partition by sample, oligo_id order by reads desc, indel desc) <= 10) group by all)"))
def topn_class_kl(spark, sf_dir):
    classes = pr.class_profile(pr.top_n(accepted(spark, sf_dir), 10).drop("place"))
    return dv.kl(dv.paired(classes, pairs(spark))).select("a", "b", "oligo_id", dv.rounded("symmetric_kl"))


@query(PAIRED + """ select a, b, oligo_id, round(coalesce(sum(s), 0), 6) as overlap from (select a, b, oligo_id,
 case when indel <> '-' and p is not null and q is not null then least(p * 100.0 / sum(p) filter (indel <> '-') over w, q * 100.0 / sum(q) filter (indel <> '-') over w) end as s
 from paired window w as (partition by a, b, oligo_id)) group by all""")
def overlap(spark, sf_dir):
    return dv.overlap(dv.paired(to_pair(spark, sf_dir), pairs(spark))).select("a", "b", "oligo_id", dv.rounded("overlap"))


@query(PROFILE + """ select sample, oligo_id, round(coalesce(sum(-s * log2(s)), 0), 6) as entropy from (select sample, oligo_id,
 case when indel <> '-' then reads / sum(reads) filter (indel <> '-') over (partition by sample, oligo_id) end as s from profile) group by all""")
def entropy(spark, sf_dir):
    return dv.entropy(accepted(spark, sf_dir)).select("sample", "oligo_id", dv.rounded("entropy"))


@query(KL.replace("{paired}", "paired") + " select oligo_id, round(avg(symmetric_kl), 6) as mean_symmetric_kl, count(*) as pairs from kl group by 1")
def mean_pair_kl(spark, sf_dir):
    got = dv.mean_by_oligo(dv.kl(dv.paired(to_pair(spark, sf_dir), pairs(spark))), "symmetric_kl")
    return got.select("oligo_id", dv.rounded("mean_symmetric_kl"), "pairs")


@query(KL.replace("{paired}", "paired") + ", m as (select a, b, round(quantile_cont(symmetric_kl, 0.5), 6) as median, count(*) as oligos from kl group by all) select * from m union all select b, a, median, oligos from m")
def median_matrix(spark, sf_dir):
    got = dv.median_matrix(dv.kl(dv.paired(to_pair(spark, sf_dir), pairs(spark))), "symmetric_kl")
    return got.select("a", "b", dv.rounded("median"), "oligos")


FRAME = PROFILE + """, sized as (select *, case when indel like '-%' then 0 else cast(substr(split_part(indel, '_', 1), 2) as integer) end
 - coalesce(try_cast(regexp_extract(split_part(indel, '_', 2), 'I(-?\\d+)', 1) as integer), 0) - coalesce(try_cast(regexp_extract(split_part(indel, '_', 2), 'D(-?\\d+)', 1) as integer), 0) as net
 from profile where indel <> '-')""".replace("\\\\", "\\")


@query(FRAME + " select sample, oligo_id, cast(coalesce(sum(reads) filter (net % 3 = 0), 0) as bigint) as in_frame, cast(coalesce(sum(reads) filter (net % 3 <> 0), 0) as bigint) as out_frame, round(coalesce(sum(reads) filter (net % 3 = 0), 0) * 100.0 / sum(reads), 6) as percent from sized group by all")
def in_frame(spark, sf_dir):
    return pr.in_frame(accepted(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(FRAME + " select sample, oligo_id, substr(indel, 1, 1) as itype, net as size, cast(sum(reads) as bigint) as reads from sized group by all")
def size_histogram(spark, sf_dir):
    return pr.size_counts(accepted(spark, sf_dir))


@query(FRAME + " select sample, oligo_id, round(coalesce(sum(reads) filter (net > 30 and indel like 'D%'), 0) * 100.0 / sum(reads), 6) as percent_above from sized group by all")
def above30(spark, sf_dir):
    return pr.above(accepted(spark, sf_dir)).select("sample", "oligo_id", dv.rounded("percent_above"))


@query(KL.replace("{paired}", "paired") + FRAME[len(PROFILE):] + """, fr as (select sample, oligo_id, coalesce(sum(reads) filter (net % 3 = 0), 0) * 100.0 / sum(reads) as percent from sized group by all),
h as (select sample, oligo_id, coalesce(sum(-s * log2(s)), 0) as entropy from (select sample, oligo_id, case when indel <> '-' then reads / sum(reads) filter (indel <> '-') over (partition by sample, oligo_id) end as s from profile) group by all),
ov as (select a, b, oligo_id, coalesce(sum(s), 0) as overlap from (select a, b, oligo_id,
 case when indel <> '-' and p is not null and q is not null then least(p * 100.0 / sum(p) filter (indel <> '-') over w, q * 100.0 / sum(q) filter (indel <> '-') over w) end as s
 from paired window w as (partition by a, b, oligo_id)) group by all),
rd as (select a, b, oligo_id, cast(coalesce(sum(p) filter (indel <> '-'), 0) as bigint) as edited_a, cast(coalesce(sum(q) filter (indel <> '-'), 0) as bigint) as edited_b from paired group by all)
select rd.*, round(kl, 6) as kl, round(symmetric_kl, 6) as symmetric_kl, round(overlap, 6) as overlap, round(ha.entropy, 6) as entropy_a, round(hb.entropy, 6) as entropy_b, round(fa.percent, 6) as in_frame_a, round(fb.percent, 6) as in_frame_b
from rd left join kl using (a, b, oligo_id) left join ov using (a, b, oligo_id)
left join h ha on ha.sample = a and ha.oligo_id = rd.oligo_id left join h hb on hb.sample = b and hb.oligo_id = rd.oligo_id
left join fr fa on fa.sample = a and fa.oligo_id = rd.oligo_id left join fr fb on fb.sample = b and fb.oligo_id = rd.oligo_id""")
def pairwise_report(spark, sf_dir):
    got = dv.pairwise_report(to_pair(spark, sf_dir), pairs(spark))
    keep = ("a", "b", "oligo_id", "edited_a", "edited_b")
    return got.select(*(F.col(c) if c in keep else dv.rounded(c) for c in got.columns))
