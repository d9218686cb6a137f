"""Writers: Parquet tables by bucket, and the text exports that other programs read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutscape.functions.sequence import oligo_index


def by_bucket(rows: DataFrame, path: str, oligo: str = "oligo_id", mode: str = "overwrite") -> None:
    """Parquet, partitioned by thousands of oligos, so one oligo's rows are found by their path."""
    rows.withColumn("bucket", F.floor(oligo_index(F.col(oligo)) / 1000).cast("int")).write.partitionBy("bucket").mode(mode).parquet(path)


def summary_text(summary: DataFrame, path: str) -> None:
    """Sectioned text of (oligo_id, indel, oligo_indel, reads): unedited first, then by reads and name, falling.

    Sections are whole lines made by aggregation, so a section never crosses files.
    """
    total = summary.groupBy("oligo_id", "indel").agg(F.sum("reads").alias("t"))
    order = F.struct((F.col("indel") == "-").cast("int"), "t", "indel", "reads", "oligo_indel")
    rows = summary.join(total, ["oligo_id", "indel"]).groupBy("oligo_id").agg(F.sort_array(F.collect_list(order), asc=False).alias("r"))
    lines = F.transform("r", lambda x: F.concat_ws("\t", x["indel"], x["oligo_indel"], x["reads"].cast("string")))
    rows.select(F.concat(F.lit("@@@"), "oligo_id", F.lit("\n"), F.array_join(lines, "\n")).alias("value")).write.text(path)


def predicted_text(profile: DataFrame, path: str) -> None:
    """Sectioned text of predicted (oligo_id, indel, reads[, in_frame]): unedited first, then by falling counts, up to the
    first count below one half, rounded half to even. Sections carry the percentage in frame if there is one."""
    head = F.concat(F.lit("@@@"), "oligo_id")
    if "in_frame" in profile.columns:
        head = F.concat(head, F.lit("\t"), F.format_string("%.3f", "in_frame"))
    shown = F.transform("r", lambda x: F.concat(x["indel"], F.lit("\t-\t"), F.bround(x["reads"], 0).cast("long").cast("string")))
    _predicted(profile).select(F.concat_ws("\n", head, F.array_join(shown, "\n")).alias("value")).write.text(path)


def predicted_reads(profile: DataFrame, path: str) -> None:
    """Sectioned text of predicted_targets()' reads: number, read, edit, in the order and up to the limit of predicted_text()."""
    shown = F.transform("r", lambda x, i: F.concat_ws("\t", i.cast("string"), x["seq"], x["indel"]))
    _predicted(profile).select(F.concat_ws("\n", F.concat(F.lit("@@@"), "oligo_id"), F.array_join(shown, "\n")).alias("value")).write.text(path)


def _predicted(profile: DataFrame) -> DataFrame:
    """(oligo_id, in_frame, r): rows of at least one half in order; none where the unedited row is below."""
    cols = [c for c in ("seq",) if c in profile.columns]
    frame = [F.max("in_frame").alias("in_frame")] if "in_frame" in profile.columns else []
    row = F.struct((F.col("indel") == "-").cast("int").alias("first"), "reads", "indel", *cols)
    got = profile.groupBy("oligo_id").agg(F.sort_array(F.collect_list(row), asc=False).alias("r"), *frame)
    kept = F.when(F.col("r")[0]["reads"] >= 0.5, F.filter("r", lambda x: x["reads"] >= 0.5)).otherwise(F.slice("r", 1, 0))
    return got.withColumn("r", kept)


def profiles_by_oligo(profile: DataFrame, path: str, least: float = 1.0) -> None:
    """Predictions of at least `least` as Parquet by bucket of oligos."""
    by_bucket(profile.filter(F.col("reads") >= least), path)


def mapping_text(mapped: DataFrame, path: str, header: str = "@@@") -> None:
    """Mapped reads (description, hits array<struct<oligo_id, indel, muts>>) as tab-separated text; ties are joined by commas,
    unmapped reads are None. Columns seconds, checked (number of targets compared) and by_barcode follow where there are such.
    A header line stands in a file of its own."""
    part = lambda c: F.coalesce(F.array_join(F.transform("hits", lambda h: h[c]), ","), F.lit("None" if c == "oligo_id" else ""))
    more = [F.coalesce(F.col(c).cast("int" if c == "by_barcode" else "string").cast("string"), F.lit("")) for c in ("seconds", "checked", "by_barcode") if c in mapped.columns]
    rows = mapped.select(F.concat_ws("\t", "description", part("oligo_id"), part("indel"), part("muts"), *more).alias("value"))
    mapped.sparkSession.createDataFrame([(header,)], "value string").unionByName(rows).write.text(path)


def candidate_text(candidates: DataFrame, path: str) -> None:
    """Candidate edits (oligo_id, indel, n, places[, seq]) as sectioned text, by thousands of oligos (other ids: -1): name, number, list of (left,
    right, insert), and the read that shows the edit if there is one. Sections are whole, as in summary_text()."""
    place = lambda p: F.concat(F.lit("("), p["l"].cast("string"), F.lit(","), p["r"].cast("string"), F.when(p["ins"] != "", F.concat(F.lit(",'"), p["ins"], F.lit("'"))).otherwise(""), F.lit(")"))
    read = [F.col("seq")] if "seq" in candidates.columns else []
    line = F.concat_ws("\t", "indel", F.col("n").cast("string"), F.concat(F.lit("["), F.array_join(F.transform("places", place), ","), F.lit("]")), *read)
    rows = candidates.groupBy("oligo_id").agg(F.array_sort(F.collect_list(line)).alias("r"))
    number = F.regexp_extract("oligo_id", r"^Oligo_?(\d+)", 1).try_cast("int")
    bucket = F.coalesce(F.floor(number / 1000).cast("int"), F.lit(-1)).alias("bucket")
    rows.select(bucket, F.concat(F.lit("@@@"), "oligo_id", F.lit("\n"), F.array_join("r", "\n")).alias("value")).write.partitionBy("bucket").text(path)


def repeat_text(repeats: DataFrame, path: str) -> None:
    """Repeats (oligo_id, left_start, right_start, mh_len, indel) as lines `id, l:r:n lists, names` with a comma at the end."""
    one = F.struct("left_start", "right_start", "mh_len", "indel")
    rows = repeats.groupBy("oligo_id").agg(F.sort_array(F.collect_list(one)).alias("r"))
    where = F.transform("r", lambda x: F.concat(F.concat_ws(":", x["left_start"].cast("string"), x["right_start"].cast("string"), x["mh_len"].cast("string")), F.lit(",")))
    what = F.transform("r", lambda x: F.concat(x["indel"], F.lit(",")))
    rows.select(F.concat_ws("\t", "oligo_id", F.array_join(where, ""), F.array_join(what, "")).alias("value")).write.text(path)


def repeats_by_length(repeats: DataFrame, path: str) -> None:
    """Parquet, partitioned by the length of the repeat: one pass for all lengths."""
    repeats.write.partitionBy("mh_len").mode("overwrite").parquet(path)


def insert_table(inserts: DataFrame, path: str, longest: int = 3) -> None:
    """short_inserts() as a wide table, a column for each insert and the two letters beside the cut."""
    from cutscape.operators.targets import inserts as every

    names = [x for n in range(1, longest + 1) for x in every(n)]
    wide = inserts.groupBy("oligo_id", "left_base", "right_base").pivot("ins", names).agg(F.first("indel"))
    cols = [F.col("oligo_id").alias("Oligo Id"), *(F.col(x).alias(f"I1_{x}") for x in names), F.col("left_base").alias("Repeat Nucleotide Left"), F.col("right_base").alias("Repeat Nucleotide Right")]
    wide.select(*cols).write.csv(path, sep="\t", header=True)


def weights_text(names: list[str], theta, guides: list[str], path: str, spark: SparkSession) -> None:
    """Weights (bounded by the layout) as one text file: the training guides, then feature and value."""
    body = "\n".join([",".join(guides), *(f"{x}\t{float(v)!r}" for x, v in zip(names, theta))])
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(path)


def combined(spark: SparkSession, paths: list[str], out: str) -> None:
    """Tables of one header in several files or folders as one Parquet table, with the file that a row came from."""
    rows = spark.read.csv(paths, sep="\t", header=True).withColumn("source_file", F.substring_index("_metadata.file_path", "/", -1))
    rows.write.mode("overwrite").parquet(out)


def fasta_of(targets: DataFrame, ids: DataFrame, path: str) -> None:
    """The targets (description, seq) whose id (oligo_id) is asked for, as FASTA."""
    rows = targets.withColumn("oligo_id", F.substring_index("description", " ", 1)).join(ids.select("oligo_id").distinct(), "oligo_id", "left_semi")
    rows.select(F.concat(F.lit(">"), "description", F.lit("\n"), "seq").alias("value")).write.text(path)


def sequences_text(guides: DataFrame, path: str) -> None:
    """The guides' sequences (seq), one a line."""
    guides.select(F.col("seq").alias("value")).write.text(path)


def dealt_files(rows: DataFrame, n: int, path: str) -> None:
    """Rows dealt out evenly to n Parquet files."""
    rows.repartition(n).write.mode("overwrite").parquet(path)


def append_unseen(new: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the Parquet table doesn't have yet."""
    there = new.sparkSession.read.parquet(path).select(key).distinct()
    new.dropDuplicates([key]).join(there, key, "left_anti").write.mode("append").parquet(path)
