"""Genome loci and guide ids: small ranges as equi-joins, choices among hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearby(loci: DataFrame, known: DataFrame, reach: int = 1) -> DataFrame:
    """loci (id, chrom, start, end) with the first known locus (ord, chrom, start, end) within `reach` of both ends.

    The range becomes an equi-join on each start in reach. Without one a locus is its own.
    """
    spread = loci.withColumn("near", F.explode(F.sequence(F.col("start") - reach, F.col("start") + reach)))
    k = known.select("ord", F.col("chrom").alias("k_chrom"), F.col("start").alias("k_start"), F.col("end").alias("k_end"))
    hit = spread.join(k, (F.col("chrom") == F.col("k_chrom")) & (F.col("near") == F.col("k_start")) & (F.abs(F.col("end") - F.col("k_end")) <= reach))
    best = hit.groupBy("id").agg(F.min(F.struct("ord", "k_start", "k_end")).alias("b"))
    return loci.join(best, "id", "left").select("id", "chrom", F.coalesce("b.k_start", "start").alias("start"), F.coalesce("b.k_end", "end").alias("end"))


def chosen_ids(guides: DataFrame, hits: DataFrame) -> DataFrame:
    """(oligo_id, wge_id): one id for each guide (oligo_id, pos, strand) of its hits (oligo_id, ord, wge_id, start, strand).

    One hit: that. Two: the first for `-`, the second for `+`. More: the first on the same strand whose distance is 16
    (`+`) or at most 50 (`-`). None: null.

    A guide's hits are aggregated, not gathered. Hits come in the order of ord and wge_id.
    """
    h = hits.select("oligo_id", F.struct("ord", "wge_id").alias("_hit"), F.col("start").alias("_start"), F.col("strand").alias("_strand"))
    apart = F.abs(F.col("_start") - F.col("pos"))
    fits = (F.col("_strand") == F.col("strand")) & F.when(F.col("strand") == "+", apart == 16).otherwise(apart <= 50)
    found = guides.select("oligo_id", "pos", "strand").distinct().join(h, "oligo_id").groupBy("oligo_id", "pos", "strand").agg(
        F.count("*").alias("_n"), F.min("_hit").alias("_first"), F.max("_hit").alias("_last"), F.min(F.when(fits, F.col("_hit"))).alias("_near")
    )
    of_two = F.when(F.col("strand") == "-", F.col("_first")).otherwise(F.col("_last"))
    chosen = F.when(F.col("_n") == 1, F.col("_first")).when(F.col("_n") == 2, of_two).otherwise(F.col("_near"))["wge_id"]
    told = found.select(*(F.col(c).alias(f"_{c}") for c in ("oligo_id", "pos", "strand")), chosen.alias("wge_id"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("oligo_id", "pos", "strand")]
    return guides.select("oligo_id", "pos", "strand").join(told, same, "left").select("oligo_id", "wge_id")


def upserted(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose key is not there yet, the first of each key in the order of arrival."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
    return first.join(existing.select(key), key, "left_anti")
