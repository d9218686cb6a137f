"""Domain tables derived from the star-schema tables by scalar SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Q, N, T = "cast(l_quantity as int)", "l_linenumber", "cast(round(l_tax * 100) as int)"
#: Edit sizes follow from left end, right start and ambiguity, as in a named deletion or insertion.
INS_SIZE, INS_LEFT = f"({N} % 3 + 1)", f"(-({Q} % 3) - 1)"
DEL_LEFT, DEL_RIGHT, DEL_SHIFT = f"(-{N} - ({Q} % 3))", f"({N} % 4 + {Q} % 7 + 4)", f"({Q} % 4)"
TEXT = "cast({} as varchar(20))"


def _t(x: str) -> str:
    return TEXT.format(x)


INDEL = f"""case when {Q} % 5 = 0 then '-'
 when {Q} = 49 then 'D2_L6R9'
 when {Q} = 48 then 'D' || {_t(f'({DEL_RIGHT} + 40)')} || '_L-41R' || {_t(DEL_RIGHT)}
 when {Q} % 5 = 1 then 'I' || {_t(INS_SIZE)} || '_L' || {_t(INS_LEFT)} || case when {Q} % 2 = 1 then 'C1' else '' end || 'R' || {_t(f'({INS_LEFT} + 1 + {Q} % 2)')}
 when {Q} = 47 then 'I4_L-3D2R0'
 else 'D' || {_t(f'({DEL_RIGHT} - {DEL_LEFT} - 1 - {DEL_SHIFT})')} || '_L' || {_t(DEL_LEFT)} || case when {DEL_SHIFT} > 0 then 'C' || {_t(DEL_SHIFT)} else '' end || 'R' || {_t(DEL_RIGHT)}
 end"""
OLIGO_INDEL = f"""case when {T} <= 5 then '-' when {T} = 6 then '-_M-25' when {T} = 7 and {N} < 4 then '-_M2' when {T} = 7 then 'D1_L10R12'
 when {N} % 2 = 0 then '-_N3[A]D1S20' else 'D1_L-3R-1_M22' end"""
READ = ["l_returnflag as sample", f"'Oligo' || {_t('l_suppkey')} as oligo_id", f"{INDEL} as indel", f"{OLIGO_INDEL} as oligo_indel"]
#: Summary of one row for each sample, oligo, indel and synthesis variant, for DuckDB.
SUMMARY_SQL = f"summary as (select sample, oligo_id, indel, oligo_indel, count(*) as reads from (select {', '.join(READ)} from lineitem) group by all)"
#: Accepted rows are not repeated here: oracles filter on their own parse of the identifier.

SALTED = "translate(md5('{}' || cast(p_partkey as varchar(20))), '0123456789abcdef', 'ATGCATGCATGCATGC')"
RAW = " || ".join(SALTED.format(s) for s in "abc")
SEQ = f"substr({RAW}, 1, 57) || 'GG' || substr({RAW}, 60, 20)"
TARGET = [f"'Oligo' || {_t('p_partkey')} as oligo_id", f"{SEQ} as seq", "56 as pam_idx", "53 as cut_idx", "p_brand", "p_size"]
TARGETS_SQL = f"targets as (select {', '.join(TARGET)} from part)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped reads: one for each lineitem row."""
    return table(spark, sf_dir, "lineitem").selectExpr(*READ)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cutscape.operators.profile import indel_counts

    return indel_counts(mapped(spark, sf_dir))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """79-mers with a PAM, one for each part."""
    return table(spark, sf_dir, "part").selectExpr(*TARGET)
