"""Queries over targets, candidate edits, microhomologies, barcodes and mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutscape.functions import indel as ix
from cutscape.functions import sequence as sq
from cutscape.operators import endogenous as en
from cutscape.operators import mapping as mp
from cutscape.operators import targets as tg
from cutscape.plans import base
from cutscape.plans import profiles as pf

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WITH = "with " + base.TARGETS_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(WITH + """ select oligo_id, reverse(translate(seq, 'ATGC', 'TACG')) as revcomp, round(100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / 79, 6) as gc,
 len(list_filter(range(1, length(substr(seq, 54)) - 2), lambda i: contains(substr(seq, 1, 53), substr(substr(seq, 54), i::int, 4)))) > 0 as has_mh4,
 len(list_filter(range(1, 21), lambda i: substr(seq, i::int, 1) <> substr(seq, (i + 20)::int, 1))) as mismatches,
 case when regexp_full_match(seq, '[ACGT]+') then null else 'letters other than ATGC' end as error,
 substr(seq, 27, 53) as trimmed, 26 as trim_left, 'Oligos_' || (cast(substr(oligo_id, 6) as int) // 1000) || '/Oligos_' || (cast(substr(oligo_id, 6) as int) // 50 * 50) || '-' || (cast(substr(oligo_id, 6) as int) // 50 * 50 + 49) as bucket
 from targets""")
def target_properties(spark, sf_dir):
    t = base.targets(spark, sf_dir)
    s, pam = F.col("seq"), F.col("pam_idx")
    trimmed = sq.trimmed_target(s, pam, 30)
    return t.select(
        "oligo_id", sq.revcomp(s).alias("revcomp"), F.round(sq.gc_percent(s), 6).alias("gc"), sq.has_repeat_across(s, F.col("cut_idx"), 4).alias("has_mh4"),
        sq.hamming(F.substring(s, F.lit(1), F.lit(20)), F.substring(s, F.lit(21), F.lit(20))).cast("long").alias("mismatches"),
        sq.target_error(s, pam).alias("error"), trimmed["seq"].alias("trimmed"), trimmed["trim"].alias("trim_left"), sq.bucket_label(sq.oligo_index(F.col("oligo_id"))).alias("bucket"),
    )


def _name(size: str, text: str, kind: str, a: str, b: str, source: str) -> str:
    """Names in DuckDB from caps ca and cb; a and b compare letters of text at step k."""
    steps = lambda cap, x: f"case when {cap} <= 0 then 0 else coalesce(list_min(list_filter(range(0, {cap}), lambda k: {x})), {cap}) end"
    return f"""shifts as (select *, {steps('ca', a)} as a, {steps('cb', b)} as b from {source}),
named as (select oligo_id, l, r, ins, '{kind}' || {size} || '_L' || (l - a - cut_idx) || case when a + b > 0 then 'C' || (a + b) else '' end || 'R' || (r + b - cut_idx) as indel from shifts)"""


_S = lambda at, text="seq": f"substr({text}, ({at} + 1)::int, 1)"
DELETIONS = """, caps as (select *, least(l, r - (cut_idx - 5)) as ca, least(cut_idx + 3 - l, 79 - 1 - r) as cb from (
  select oligo_id, seq, cut_idx, l::int as l, r::int as r, '' as ins from targets, (select unnest(range(22, 53)) as l), (select unnest(range(53, 79)) as r) where r - l - 1 between 1 and 30)), """ + _name(
    "(r - l - 1)", "seq", "D", f"{_S('l - k')} <> {_S('r - 1 - k')}", f"{_S('l + 1 + k')} <> {_S('r + k')}", "caps")
INSERTIONS = """, bases(x) as (values ('A'), ('T'), ('G'), ('C')), every as (select x as ins from bases union all select p.x || q.x from bases p, bases q),
caps as (select oligo_id, seq, cut_idx, 52 as l, 53 as r, ins, substr(seq, 1, 53) || ins || substr(seq, 54) as rd, least(52, 5) as ca, least(cut_idx + 3 - 52, 79 - 1 - 53) as cb from targets, every), """ + _name(
    "length(ins)", "rd", "I", f"{_S('l - k', 'rd')} <> {_S('l - k + length(ins)', 'rd')}", f"{_S('r + k', 'rd')} <> {_S('r + k + length(ins)', 'rd')}", "caps")


@query(WITH + DELETIONS + " select * from named")
def gen_deletions(spark, sf_dir):
    return tg.deletions(base.targets(spark, sf_dir))


@query(WITH + INSERTIONS + " select * from named")
def gen_insertions(spark, sf_dir):
    return tg.insertions(base.targets(spark, sf_dir))


@query(WITH + DELETIONS.replace("named as", "dels as").replace("shifts", "shifts1").replace("caps", "caps1") + INSERTIONS + """, every_edit as (select * from dels union all select * from named)
select oligo_id, indel, count(*) as n, arg_min(l, (l, r, length(ins), ins)) as first_left, arg_min(r, (l, r, length(ins), ins)) as first_right from every_edit group by all""")
def gen_indels(spark, sf_dir):
    return tg.first_placements(base.targets(spark, sf_dir)).select("oligo_id", "indel", "n", F.col("l").alias("first_left"), F.col("r").alias("first_right"))


MH = """, ij as (select oligo_id, seq, cut_idx, i::int as i, j::int as j from targets, (select unnest(range(0, 56)) as i), (select unnest(range(49, 79)) as j) where j > i),
mh0 as (select *, coalesce(list_min(list_filter(range(0, 79 - j), lambda k: substr(seq, (i + k + 1)::int, 1) <> substr(seq, (j + k + 1)::int, 1))), 79 - j)::int as mh_len from ij where substr(seq, i + 1, 1) = substr(seq, j + 1, 1)),
mh as (select oligo_id, seq, cut_idx, i as left_start, j as right_start, mh_len from mh0 where mh_len > 1 and not (i > 0 and j - 1 >= greatest(i, 49) and substr(seq, i, 1) = substr(seq, j, 1)))"""


@query(WITH + MH + " select oligo_id, left_start, right_start, mh_len from mh")
def find_mh(spark, sf_dir):
    return tg.microhomologies(base.targets(spark, sf_dir))


MH_INDELS = WITH + MH + """, caps as (select *, left_start - 1 as l, right_start as r, '' as ins, least(left_start - 1, right_start - (cut_idx - 5)) as ca, least(cut_idx + 3 - (left_start - 1), 78 - right_start) as cb from mh),
shifts as (select *, case when ca <= 0 then 0 else coalesce(list_min(list_filter(range(0, ca), lambda k: substr(seq, (l - k + 1)::int, 1) <> substr(seq, (r - k)::int, 1))), ca) end as a,
 case when cb <= 0 then 0 else coalesce(list_min(list_filter(range(0, cb), lambda k: substr(seq, (l + k + 2)::int, 1) <> substr(seq, (r + k + 1)::int, 1))), cb) end as b from caps),
mhi as (select oligo_id, left_start, right_start, mh_len, 'D' || (r - l - 1) || '_L' || (l - a - cut_idx) || case when a + b > 0 then 'C' || (a + b) else '' end || 'R' || (r + b - cut_idx) as indel from shifts)"""


@query(MH_INDELS + " select * from mhi")
def mh_indels(spark, sf_dir):
    return tg.microhomology_indels(base.targets(spark, sf_dir))


@query(MH_INDELS + pf.PROFILE.replace("with summary", ", summary") + """, reads as (select oligo_id, indel, sum(reads) as reads from profile group by all)
select mhi.oligo_id, left_start, right_start, mh_len, mhi.indel, cast(coalesce(reads, 0) as bigint) as reads from mhi join (select distinct oligo_id from profile) using (oligo_id) left join reads using (oligo_id, indel)""")
def mh_frequencies(spark, sf_dir):
    """Expected deletions of the targets with a profile, zero where none was read."""
    reads = pf.accepted(spark, sf_dir).groupBy("oligo_id", "indel").agg(F.sum("reads").alias("reads"))
    found = tg.microhomology_indels(base.targets(spark, sf_dir).join(reads.select("oligo_id").distinct(), "oligo_id", "left_semi"))
    return found.hint("merge").join(reads, ["oligo_id", "indel"], "left").withColumn("reads", F.coalesce("reads", F.lit(0)).cast("long"))


@query(MH_INDELS + """ select oligo_id, arg_max(indel, (mh_len, -left_start, -right_start)) as top_indel, max(mh_len) as top_len, count(*) as n from mhi group by 1""")
def mh_top_per_oligo(spark, sf_dir):
    found = tg.microhomology_indels(base.targets(spark, sf_dir))
    order = F.struct("mh_len", -F.col("left_start"), -F.col("right_start"))
    return found.groupBy("oligo_id").agg(F.max_by("indel", order).alias("top_indel"), F.max("mh_len").alias("top_len"), F.count("*").alias("n"))


#: Reads: the target of a part without a stretch around the cut that the line's numbers fix.
READ_SQL = "substr(seq, 1, 53 - l_linenumber) || substr(seq, 54 + cast(l_quantity as int) % 5)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "'Oligo' || cast(l_partkey as varchar(20)) as true_id", "l_orderkey * 8 + l_linenumber as read_id")


def reads(spark: SparkSession, sf_dir: str, some: DataFrame | None = None) -> DataFrame:
    """Reads of all lines(), or of some of them."""
    told = (lines(spark, sf_dir) if some is None else some).join(base.targets(spark, sf_dir).select(F.col("oligo_id").alias("true_id"), "seq"), "true_id")
    return told.selectExpr("read_id", "true_id", f"{READ_SQL} as seq")


@query(WITH + f""", rd as (select distinct {READ_SQL} as seq from lineitem join targets on oligo_id = 'Oligo' || cast(l_partkey as varchar)),
win(w, a, b) as (values (0, 0, 10), (1, 5, 15), (2, -15, -5), (3, -10, 0)),
keys as (select oligo_id, w, case when a >= 0 then substr(seq, a + 1, 10) else substr(seq, 79 + a + 1, 10) end as bc from targets, win),
chg as (select oligo_id, w, bc as key from keys union select oligo_id, w, substr(bc, 1, p::int - 1) || x || substr(bc, p::int + 1) from keys, (select unnest(range(1, 11)) as p), (values ('A'), ('T'), ('G'), ('C')) v(x)),
pr as (select seq, w, case when a >= 0 then substr(seq, a + 1, 10) else substr(seq, length(seq) + a + 1, 10) end as key from rd, win)
select distinct seq, oligo_id from pr join chg using (w, key)""")
def barcode_candidates(spark, sf_dir):
    return tg.barcode_candidates(reads(spark, sf_dir), base.targets(spark, sf_dir))


@query(WITH + f" select l_orderkey * 8 + l_linenumber as read_id, seq2 as seq from (select l_orderkey, l_linenumber, {READ_SQL} as seq2 from lineitem join targets on oligo_id = 'Oligo' || cast(l_partkey as varchar)) where l_linenumber > 5")
def missing_reads(spark, sf_dir):
    """Reads that an earlier append doesn't have yet."""
    every = lines(spark, sf_dir)
    there = base.table(spark, sf_dir, "lineitem").filter("l_linenumber <= 5").selectExpr("l_orderkey * 8 + l_linenumber as read_id")
    return reads(spark, sf_dir, every.join(there, "read_id", "left_anti")).select("read_id", "seq")


def oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.targets(spark, sf_dir).withColumn("reverse", F.lit(False))


#: Names of the reads' deletions in DuckDB, by the closed form: (read_id, oligo_id, read, l, r, indel, shift, left_end, size).
NAMED_READS = f""", lines as (select l_orderkey * 8 + l_linenumber as read_id, oligo_id, seq, cut_idx, 52 - l_linenumber as l, 53 + cast(l_quantity as int) % 5 as r, {READ_SQL} as read, l_suppkey as supplier from lineitem join targets on oligo_id = 'Oligo' || cast(l_partkey as varchar)),
caps as (select distinct oligo_id, seq, cut_idx, l, r, '' as ins, least(l, r - (cut_idx - 5)) as ca, least(cut_idx + 3 - l, 79 - 1 - r) as cb from lines), """ + _name(
    "(r - l - 1)", "seq", "D", f"{_S('l - k')} <> {_S('r - 1 - k')}", f"{_S('l + 1 + k')} <> {_S('r + k')}", "caps") + """,
told as (select lines.*, named.indel, a + b as shift, lines.l - a - lines.cut_idx as left_end, lines.r - lines.l - 1 as size from lines join named on named.oligo_id = lines.oligo_id and named.l = lines.l and named.r = lines.r
  join shifts on shifts.oligo_id = lines.oligo_id and shifts.l = lines.l and shifts.r = lines.r)"""


@query(WITH + NAMED_READS + " select distinct read as seq, oligo_id as oligo_ids, indel as indels, '-' as muts, cast(2 * length(read) as int) as score from told")
def map_reads(spark, sf_dir):
    mapped = mp.map_sequences(reads(spark, sf_dir), oriented(spark, sf_dir))
    return mapped.select("seq", F.concat_ws(",", F.transform("hits", lambda h: h["oligo_id"])).alias("oligo_ids"), F.concat_ws(",", F.transform("hits", lambda h: h["indel"])).alias("indels"), F.concat_ws(",", F.transform("hits", lambda h: h["muts"])).alias("muts"), "score")


@query(WITH + NAMED_READS + """, counted as (
  select oligo_id, indel as variant, count(*) as reads, arg_min(read, read_id) as seq, min(size) as size, min(53 + (left_end + 1) + shift) as start from told group by all
  union all select oligo_id, '-', 5, seq, 0, 56 from targets
), shared as (select *, reads * 100.0 / sum(reads) over (partition by oligo_id) as percent from counted)
select oligo_id, variant, cast(reads as bigint) as reads, round(percent, 6) as percent, seq, cast(case when variant <> '-' and start < 56 then greatest(56 - size, start) else 56 end as int) as pam_idx
from shared where percent >= 0.5 and length(seq) <= 120""")
def exptargets(spark, sf_dir):
    """Templates of each target from control reads, with the place of the PAM on each."""
    t = oriented(spark, sf_dir)
    hits = mp.unique_hits(mp.counted_hits(reads(spark, sf_dir).select("read_id", "seq"), t))
    found = mp.expanded_targets(mp.null_templates(hits, t)).join(t.select("oligo_id", F.col("pam_idx").alias("_pam")), "oligo_id")
    return found.select("oligo_id", "variant", "reads", F.round("percent", 6).alias("percent"), "seq", ix.moved_pam("variant", F.col("_pam"), F.lit("FORWARD")).alias("pam_idx"))


#: Every third supplier's reads have the fifth letter of their template changed to its complement.
_CHANGED = "translate(substr({0}, 5, 1), 'ACGT', 'TGCA')"
_SNP = f"substr({{0}}, 1, 4) || {_CHANGED} || substr({{0}}, 6)"


@query(WITH + NAMED_READS + """, snps as (select distinct 'Oligo' || cast(l_partkey as varchar) as oligo_id from lineitem where l_linenumber <= 3 and l_suppkey % 3 = 0),
own as (select told.*, supplier % 3 = 0 and oligo_id in (from snps) as changed from told)
select oligo_id, indel, case when changed then '-_M-49' else '-' end as oligo_indel, count(*) as reads from own group by all""")
def endogenous_profiles(spark, sf_dir):
    """Summaries of every target: control reads with and without a changed letter make the templates of reads with a deletion."""
    name = "concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as read_id"
    lines = base.table(spark, sf_dir, "lineitem").selectExpr(name, "l_linenumber", "l_suppkey", "cast(l_quantity as int) as q", "'Oligo' || l_partkey as oligo_id")
    rows = lines.join(base.targets(spark, sf_dir).select("oligo_id", "seq"), "oligo_id")
    whole = F.when(F.col("l_suppkey") % 3 == 0, F.expr(_SNP.format("seq"))).otherwise(F.col("seq"))
    control = rows.filter("l_linenumber <= 3").select("oligo_id", "read_id", whole.alias("seq"))
    cut = rows.withColumn("seq", whole).selectExpr("oligo_id", "read_id", "'AC' || substr(seq, 1, 53 - l_linenumber) || substr(seq, 54 + q % 5) || 'GT' as seq")
    templates = base.targets(spark, sf_dir).select("oligo_id", "seq", "pam_idx", F.lit("FORWARD").alias("direction"))
    return en.endogenous_summary(control, cut, templates)


#: Templates of reads in DuckDB, and the rank of each as a choice.
_TIES = """with k as (select l_orderkey * 8 + l_linenumber as read_id, unnest(range(0, 1 + l_linenumber % 4)) as t, l_linenumber as n, cast(l_quantity as int) as q, l_suppkey as s from lineitem),
ties as (select read_id, 'Oligo' || s as oligo_id, case t when 0 then '-' when 1 then 'D1_L-3R-1' when 2 then 'I2_L-20R-19' else '-_M10' end as variant, cast((q * (t + 3)) % 17 + 1 as double) as percent, case when q % 7 = 0 and t = 1 then '-' else 'D' || (q % 9 + 1) || '_L-2R8' end as indel from k),
ranked as (select *, case when indel = '-' then 0 when variant = 'D1_L-3R-1' then 2 else 1 end as rank from ties), least_ as (select * from ranked qualify rank = min(rank) over (partition by read_id)),
sums as (select *, row_number() over w as n, sum(percent) over (partition by read_id order by percent desc, oligo_id, variant, indel rows unbounded preceding) as run, sum(percent) over (partition by read_id) as total from least_ window w as (partition by read_id order by percent desc, oligo_id, variant, indel)),
drawn as (select *, cast(('0x' || substr(md5(read_id || '/0'), 1, 7)) as bigint) / 268435456.0 as d from sums)
select read_id, oligo_id, variant, indel from drawn where case when rank = 0 then n = 1 else run / total > d and run / total - percent / total <= d end"""


@query(_TIES)
def resolved_templates(spark, sf_dir):
    """One template for each read of several that fit: an unedited read first, then those outside seed and PAM, by a draw."""
    rows = base.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber as read_id", "explode(sequence(0, l_linenumber % 4)) as t", "cast(l_quantity as int) as q", "l_suppkey as s")
    ties = rows.selectExpr(
        "read_id", "'Oligo' || s as oligo_id", "case t when 0 then '-' when 1 then 'D1_L-3R-1' when 2 then 'I2_L-20R-19' else '-_M10' end as variant",
        "cast((q * (t + 3)) % 17 + 1 as double) as percent", "case when q % 7 = 0 and t = 1 then '-' else 'D' || (q % 9 + 1) || '_L-2R8' end as indel",
    )
    return mp.resolved(ties).select("read_id", "oligo_id", "variant", "indel")
