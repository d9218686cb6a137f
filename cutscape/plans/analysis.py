"""Queries over several samples, statistics, categories and loci."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutscape.functions import indel as ix
from cutscape.functions import sequence as sq
from cutscape.operators import loci, samples
from cutscape.operators import targets as tg
from cutscape.plans import base
from cutscape.plans import profiles as pf

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PROFILE, accepted = pf.PROFILE, pf.accepted


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *keep):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


_WIDE = " select oligo_id, indel, {cols}, cast({total} as bigint) as reads_sum from profile group by all"
_OUT = ", ".join(f"cast(coalesce(sum(reads) filter (sample = '{s}'), 0) as bigint) as reads_{s}" for s in "ANR")


@query(PROFILE + _WIDE.format(cols=_OUT, total="sum(reads)"))
def merge_samples_outer(spark, sf_dir):
    return samples.side_by_side(accepted(spark, sf_dir), ["oligo_id", "indel"], "reads", list("ANR"))


@query(PROFILE + _WIDE.format(cols=_OUT, total="sum(reads)") + " having count(distinct sample) = 3")
def merge_samples_inner(spark, sf_dir):
    return samples.side_by_side(accepted(spark, sf_dir), ["oligo_id", "indel"], "reads", list("ANR"), inner=True)


@query(PROFILE + ", t as (select sample, oligo_id, sum(reads) filter (indel <> '-') as reads from profile group by all) select oligo_id from t where reads > 60 group by 1 having count(distinct sample) = 3")
def common_guides(spark, sf_dir):
    totals = accepted(spark, sf_dir).filter("indel <> '-'").groupBy("sample", "oligo_id").agg(F.sum("reads").alias("reads"))
    return samples.common_guides(totals, 60, 3)


@query("with " + base.TARGETS_SQL + """ select 'old' as part, oligo_id from targets where p_size <= 25 union all select 'new', oligo_id from targets where p_size > 25
 union all select 'gc rich', oligo_id from targets where length(regexp_replace(seq, '[^GC]', '', 'g')) >= 40 union all select 'brand 1', oligo_id from targets where p_brand like 'Brand#1%'""")
def partition_guides(spark, sf_dir):
    flags = {"old": F.col("p_size") <= 25, "new": F.col("p_size") > 25, "gc rich": F.length(F.regexp_replace("seq", "[^GC]", "")) >= 40, "brand 1": F.col("p_brand").startswith("Brand#1")}
    return samples.partitions(base.targets(spark, sf_dir), flags).select("part", "oligo_id")


FIELDS = PROFILE + r""", f as (select *, substr(indel, 1, 1) as it, case when indel like '-%' then 0 else cast(substr(split_part(indel, '_', 1), 2) as integer) end as sz,
 coalesce(try_cast(regexp_extract(split_part(indel, '_', 2), 'C(-?\d+)', 1) as integer), 0) as c, coalesce(try_cast(regexp_extract(split_part(indel, '_', 2), 'I(-?\d+)', 1) as integer), 0) + coalesce(try_cast(regexp_extract(split_part(indel, '_', 2), 'D(-?\d+)', 1) as integer), 0) > 0 as mixed
 from profile where indel <> '-')"""
_CAT = {"i1": "it = 'I' and not mixed and sz = 1", "i_more": "it = 'I' and not mixed and sz > 1", "d1": "it = 'D' and not mixed and sz = 1", "d2": "it = 'D' and not mixed and sz = 2",
        "d_repeat": "it = 'D' and not mixed and sz > 2 and c > 0", "d_plain": "it = 'D' and not mixed and sz > 2 and c = 0", "mixed": "mixed"}
CATS = ", ".join(f"cast(coalesce(sum(reads) filter ({x}), 0) as bigint) as {k}" for k, x in _CAT.items())


def _categories(spark, sf_dir):
    mixed = (ix.detail("indel", "I") + ix.detail("indel", "D")) > 0
    p = ix.with_parts(accepted(spark, sf_dir).filter("indel <> '-'"), "indel", kind=ix.itype("indel"), size=ix.isize("indel"), shift=ix.detail("indel", "C"), mixed=mixed)
    return samples.categories(p, *map(F.col, ("kind", "size", "shift", "mixed")))


@query(FIELDS + f" select sample, oligo_id, cast(sum(reads) as bigint) as total, {CATS} from f group by all")
def pie_categories(spark, sf_dir):
    return _categories(spark, sf_dir)


@query(FIELDS + f", g as (select sample, oligo_id, sum(reads) as total, {CATS} from f group by all) select sample, " + ", ".join(f"round(avg(100.0 * {k} / total), 6) as {k}" for k in _CAT) + ", quantile_cont(total, 0.5) as median_total from g group by 1")
def pie_means(spark, sf_dir):
    """Mean percentage of each category over the oligos of a sample, and the median of the totals."""
    got = _categories(spark, sf_dir).groupBy("sample")
    return rounded(got.agg(*(F.avg(100.0 * F.col(k) / F.col("total")).alias(k) for k in _CAT), F.percentile("total", 0.5).alias("median_total")))


_ARGMAX = "array_position([{0}], greatest({0}))".format(", ".join(_CAT))


@query(FIELDS + f", g as (select sample, oligo_id, {CATS} from f group by all) select sample, oligo_id, [{', '.join(map(repr, _CAT))}][list_position([{', '.join(_CAT)}], greatest({', '.join(_CAT)}))] as kind from g")
def mci_type(spark, sf_dir):
    """The first category that holds the most reads."""
    cats = F.array(*map(F.col, _CAT))
    at = F.array_position(cats, F.array_max(cats)).cast("int")
    return _categories(spark, sf_dir).select("sample", "oligo_id", F.element_at(F.array(*map(F.lit, _CAT)), at).alias("kind"))


@query(PROFILE + """, m as (select *, max(reads) over (partition by sample, oligo_id) as top from profile where indel <> '-'), o as (select sample, oligo_id, string_agg(indel, '' order by indel) as indel from m where reads = top group by all),
b as (select oligo_id, count(distinct indel) as d, count(*) as n, min(indel) as indel from o group by 1) select case when d = 1 and n = 3 then substr(indel, 1, 1) else 'inconsistent' end as kind, count(*) as oligos from b group by 1""")
def mci_consistency(spark, sf_dir):
    return samples.consistency(accepted(spark, sf_dir), F.substring("indel", 1, 1), 3)


XY = PROFILE + ", t as (select sample, oligo_id, cast(sum(reads) as double) as y, cast(count(*) as double) as x from profile where indel <> '-' group by all)"


def _xy(spark, sf_dir):
    return accepted(spark, sf_dir).filter("indel <> '-'").groupBy("sample", "oligo_id").agg(F.sum("reads").cast("double").alias("y"), F.count("*").cast("double").alias("x"))


@query(XY + " select sample, round(corr(x, y), 6) as pearson, count(*) as n from t group by 1")
def pearson(spark, sf_dir):
    return rounded(samples.pearson(_xy(spark, sf_dir), "x", "y", ["sample"]))


@query(XY + """, r as (select sample, rank() over (partition by sample order by x) + (count(*) over (partition by sample, x) - 1) / 2.0 as rx, rank() over (partition by sample order by y) + (count(*) over (partition by sample, y) - 1) / 2.0 as ry from t)
select sample, round(corr(rx, ry), 6) as spearman, count(*) as n from r group by 1""")
def spearman(spark, sf_dir):
    return rounded(samples.spearman(_xy(spark, sf_dir), "x", "y", ["sample"]))


@query(XY + " select sample, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(corr(x, y), 6) as r, round(sum(x * y) / sum(x * x), 6) as slope_origin, count(*) as n from t group by 1")
def regressions(spark, sf_dir):
    return rounded(samples.regression(_xy(spark, sf_dir), "x", "y", ["sample"]))


@query(FIELDS + """, t as (select sample, sz, oligo_id, 100.0 * sum(reads) / sum(sum(reads)) over (partition by sample, oligo_id) as pct from f where it = 'D' group by sample, sz, oligo_id)
select sample, sz as size, round(quantile_cont(pct, 0.25), 6) as q1, round(quantile_cont(pct, 0.5), 6) as median, round(quantile_cont(pct, 0.75), 6) as q3, count(*) as n from t group by all having count(*) > 20""")
def size_boxes(spark, sf_dir):
    """Percentage of the deleted reads by deletion size, where more than 20 oligos have it."""
    from pyspark.sql.window import Window

    d = accepted(spark, sf_dir).filter("indel like 'D%'").groupBy("sample", ix.isize("indel").alias("size"), "oligo_id").agg(F.sum("reads").alias("k"))
    d = d.withColumn("pct", 100.0 * F.col("k") / F.sum("k").over(Window.partitionBy("sample", "oligo_id")))
    return rounded(samples.boxes(d, "pct", ["sample", "size"], 20))


@query("select cast(case when l_extendedprice < 0 then 0 when l_extendedprice >= 100000 then 21 else floor(l_extendedprice / 5000) + 1 end as bigint) as bin, count(*) as n from lineitem group by 1")
def histogram(spark, sf_dir):
    return samples.histogram(base.table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 100000.0, 20)


INS_OK = "with " + base.TARGETS_SQL


@query(PROFILE.replace("with summary", "with " + base.TARGETS_SQL + ", summary") + """, b(x) as (values ('A'), ('T'), ('G'), ('C')),
e as (select x as ins from b union all select p.x || q.x from b p, b q union all select p.x || q.x || s.x from b p, b q, b s),
d as (select oligo_id, ins, 'I' || length(ins) || '_L-1R0' as indel, substr(seq, 53, 1) as lb, substr(seq, 54, 1) as rb from targets, e),
r as (select oligo_id, indel, sum(reads) as reads from profile group by all),
j as (select d.*, coalesce(reads, 0) as reads, ins = repeat(lb, length(ins)) as lr, ins = repeat(rb, length(ins)) as rr from d left join r using (oligo_id, indel))
select oligo_id, cast(length(ins) as integer) as size, round(coalesce(sum(case when lr and rr then 0.5 else 1.0 end * reads) filter (lr), 0)::double, 6) as left_repeat, round(coalesce(sum(case when lr and rr then 0.5 else 1.0 end * reads) filter (rr), 0)::double, 6) as right_repeat,
 cast(coalesce(sum(reads) filter (not lr and not rr), 0) as bigint) as other from j group by all""")
def insert_summary(spark, sf_dir):
    t = base.targets(spark, sf_dir)
    every = F.array(*(F.lit(x) for n in (1, 2, 3) for x in tg.inserts(n)))
    s = F.col("seq")
    d = t.select("oligo_id", F.explode(every).alias("ins"), sq.base(s, F.lit(52)).alias("left_base"), sq.base(s, F.lit(53)).alias("right_base"))
    d = d.withColumn("indel", F.concat(F.lit("I"), F.length("ins").cast("string"), F.lit("_L-1R0")))
    reads = accepted(spark, sf_dir).groupBy("oligo_id", "indel").agg(F.sum("reads").alias("reads"))
    return rounded(samples.insert_summary(reads, d))


@query("with " + base.TARGETS_SQL + PROFILE.replace("with summary", ", summary") + ", r as (select oligo_id, sum(reads) as reads from profile where indel like 'I1\\_%' escape '\\' group by 1), a as (select oligo_id, sum(reads) as total from profile group by 1) select substr(seq, 53, 1) as nt, round(avg(100.0 * coalesce(reads, 0) / total), 6) as percent, count(*) as oligos from targets join a using (oligo_id) left join r using (oligo_id) group by 1".replace("\\\\", "\\"))
def nt_means(spark, sf_dir):
    """Mean percentage of single-base insertions by the base left of the cut."""
    p = accepted(spark, sf_dir)
    sums = p.groupBy("oligo_id").agg(F.sum("reads").alias("total"), F.coalesce(F.sum(F.when(ix.head("indel") == "I1", F.col("reads"))), F.lit(0)).alias("k"))
    got = base.targets(spark, sf_dir).join(sums, "oligo_id").groupBy(F.substring("seq", 53, 1).alias("nt"))
    return rounded(got.agg(F.avg(100.0 * F.col("k") / F.col("total")).alias("percent"), F.count("*").alias("oligos")))


LOCI = "with l as (select o_orderkey as id, 'chr' || (o_custkey % 5) as chrom, o_orderkey * 3 as start, o_orderkey * 3 + 20 + o_orderkey % 3 as stop from orders), k as (select p_partkey as ord, 'chr' || (p_partkey % 5) as chrom, p_partkey * 13 as start, p_partkey * 13 + 20 as stop from part)"


@query(LOCI + """, h as (select l.id, arg_min(k.start, k.ord) as ks, arg_min(k.stop, k.ord) as ke from l join k on l.chrom = k.chrom and abs(l.start - k.start) <= 1 and abs(l.stop - k.stop) <= 1 group by 1)
select l.id, l.chrom, coalesce(ks, l.start) as start, coalesce(ke, l.stop) as "end" from l left join h using (id)""")
def nearby_loci(spark, sf_dir):
    found = base.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "'chr' || (o_custkey % 5) as chrom", "o_orderkey * 3 as start", "o_orderkey * 3 + 20 + o_orderkey % 3 as end")
    known = base.table(spark, sf_dir, "part").selectExpr("p_partkey as ord", "'chr' || (p_partkey % 5) as chrom", "p_partkey * 13 as start", "p_partkey * 13 + 20 as end")
    return loci.nearby(found, known)


@query("""with g as (select c_custkey as g, c_custkey * 100 as pos, case when c_custkey % 2 = 0 then '+' else '-' end as strand from customer),
h as (select o_custkey as g, o_orderkey as ord, o_orderkey * 7 as wge_id, o_custkey * 100 + case o_orderkey % 4 when 0 then 16 when 1 then -16 when 2 then 40 else 70 end as start, case when o_orderkey % 3 = 0 then '+' else '-' end as strand from orders),
n as (select g, count(*) as n from h group by 1), r as (select *, row_number() over (partition by g order by ord) as k from h),
m as (select r.g, min(r.k) as k from r join g using (g) where r.strand = g.strand and case when g.strand = '+' then abs(r.start - pos) = 16 else abs(r.start - pos) <= 50 end group by 1)
select 'Oligo' || g.g as oligo_id, r.wge_id from g left join n using (g) left join m using (g)
left join r on r.g = g.g and r.k = case when n.n = 1 then 1 when n.n = 2 then case when g.strand = '-' then 1 else 2 end when n.n > 2 then m.k end""")
def wge_choice(spark, sf_dir):
    guides = base.table(spark, sf_dir, "customer").selectExpr("'Oligo' || cast(c_custkey as string) as oligo_id", "c_custkey * 100 as pos", "case when c_custkey % 2 = 0 then '+' else '-' end as strand")
    hits = base.table(spark, sf_dir, "orders").selectExpr("'Oligo' || cast(o_custkey as string) as oligo_id", "o_orderkey as ord", "o_orderkey * 7 as wge_id", "o_custkey * 100 + case o_orderkey % 4 when 0 then 16 when 1 then -16 when 2 then 40 else 70 end as start", "case when o_orderkey % 3 = 0 then '+' else '-' end as strand")
    return loci.chosen_ids(guides, hits)


@query("with n as (select o_custkey as wge_id, o_orderkey as arrival from orders) select wge_id, min(arrival) as arrival from n where wge_id not in (select c_custkey from customer where c_custkey % 3 = 0) group by 1")
def wge_upsert(spark, sf_dir):
    new = base.table(spark, sf_dir, "orders").selectExpr("o_custkey as wge_id", "o_orderkey as arrival")
    there = base.table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey as wge_id")
    return loci.upserted(there, new, "wge_id", "arrival")


@query("""select o_orderkey, 'GENE' || (o_custkey % 50) as gene, cast(o_custkey % 22 + 1 as varchar) as chrom, o_orderkey * 10 as pos, case when o_orderkey % 2 = 0 then '+' else '-' end as strand,
 (o_custkey % 22 + 1) || ':' || case when o_orderkey % 2 = 0 then (o_orderkey * 10 - 16) || '-' || (o_orderkey * 10 + 6) else (o_orderkey * 10 - 5) || '-' || (o_orderkey * 10 + 17) end as locus from orders""")
def crispr_line(spark, sf_dir):
    line = "concat('@@@GENE', o_custkey % 50, '_chr', o_custkey % 22 + 1, '_', o_orderkey * 10, '_', case when o_orderkey % 2 = 0 then '+' else '-' end, ' ACGT 50.0')"
    got = base.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{line} as line").withColumn("c", sq.crispr_line(F.col("line")))
    return got.select("o_orderkey", "c.*")


@query(PROFILE + """, t as (select *, sum(reads) over (partition by sample, oligo_id) as total, sum(reads) over (partition by sample, oligo_id order by indel rows unbounded preceding) as r from profile),
d as (select *, cast('0x' || substr(md5(sample || '/' || oligo_id || '/0'), 1, 7) as bigint) / 268435456.0 * total as d from t)
select sample, oligo_id, indel, reads from d where r > d and r - reads <= d""")
def weighted_choice(spark, sf_dir):
    return samples.weighted_pick(accepted(spark, sf_dir), ["sample", "oligo_id"], "reads", ["indel"])


@query("with " + base.TARGETS_SQL + " select oligo_id, row_number() over (order by md5(oligo_id || '/0'), oligo_id) - 1 as place from targets")
def seeded_shuffle(spark, sf_dir):
    return samples.shuffled(base.targets(spark, sf_dir).select("oligo_id"), "oligo_id")
