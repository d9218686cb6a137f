"""Readers of the text formats: reads, targets, sectioned tables, alignments, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutscape.functions.samples import parsed


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, value): lines with their number in the file, and where the block begins that they were read in.

    A file is read in as many tasks as Spark cuts it into blocks. A block's lines follow one another in its task, so a line's
    number is its place there plus the lines of the file's blocks before, which a second scan counts; a row for each block is
    joined back. A line that a cut goes through belongs to the block that it begins in. Compressed files are one block.
    """
    where = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "block"))]
    rows = spark.read.text(path).select(*where, "value", F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("file", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(starts, ["file", "block"]).select("file", "block", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line_no"), "value")


def filled_down(rows: DataFrame, mark: Column, name: str) -> DataFrame:
    """numbered_lines() with the last mark that is not null up to each line of its file. A block is filled by itself; of a file's
    blocks only their last marks meet."""
    rows = rows.withColumn("_mark", mark)
    own = F.last("_mark", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.filter("_mark is not null").groupBy("file", "block").agg(F.max_by("_mark", "line_no").alias("_last"))
    blocks = rows.select("file", "block").distinct().join(last, ["file", "block"], "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    told = rows.withColumn("_own", own).join(blocks, ["file", "block"])
    return told.withColumn(name, F.coalesce("_own", "_before")).drop("_mark", "_own", "_before")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, read_id, description, seq, qual) of four-line records."""
    rows = numbered_lines(spark, path)
    at = rows.groupBy("file", F.floor(F.col("line_no") / 4).alias("record"))
    line = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value")))
    got = at.agg(line(0).alias("head"), line(1).alias("seq"), line(3).alias("qual"))
    head = F.regexp_replace("head", "^[@>]", "")
    return got.select("file", F.substring_index(head, " ", 1).alias("read_id"), head.alias("description"), "seq", "qual")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq); a sequence may stand on several lines."""
    rows = spark.read.text(path, lineSep=">").filter("trim(value) <> ''")
    head = F.trim(F.substring_index("value", "\n", 1))
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    return rows.select(F.substring_index(head, " ", 1).alias("id"), head.alias("description"), body.alias("seq"))


def cut_index(length: Column, pam: Column, direction: Column) -> Column:
    """Cut site of a PAM: three before it (two after it in reverse), at least 4 from either end."""
    cut = F.when(direction == "FORWARD", pam - 3).otherwise(pam + 2)
    return F.greatest(F.lit(4), F.least(length - 5, cut))


def expected_targets(spark: SparkSession, path: str) -> DataFrame:
    """(oligo_id, seq, pam_idx, cut_idx, reverse, variant, percent) of `>id[:variant:percent] pam direction` records."""
    bits = F.split("description", r"\s+")
    rows = fasta(spark, path).select(F.split(bits[0], ":").alias("name"), bits[1].cast("int").alias("pam_idx"), bits[2].alias("direction"), F.regexp_replace("seq", "[^ATGCN].*$", "").alias("seq"))
    return rows.select(
        F.col("name")[0].alias("oligo_id"), "seq", "pam_idx", cut_index(F.length("seq"), F.col("pam_idx"), F.col("direction")).alias("cut_idx"),
        (F.col("direction") != "FORWARD").alias("reverse"), F.get("name", F.lit(1)).alias("variant"), F.get("name", F.lit(2)).cast("double").alias("percent"),
    )


def sectioned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a tab-separated file whose `@@@key ...` lines start sections: (file, line_no, section, columns)."""
    rows = numbered_lines(spark, path).filter("value <> ''")
    mark = F.col("value").startswith("@@@")
    key = F.when(mark, F.regexp_extract("value", r"^@@@(\S*)", 1))
    filled = filled_down(rows, key, "section").filter(~mark)
    bits = F.split("value", "\t")
    return filled.select("file", "line_no", "section", *(F.get(bits, k).alias(c) for k, c in enumerate(columns)))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, oligo_id, indel, oligo_indel, reads)."""
    got = sectioned(spark, path, ["indel", "oligo_indel", "reads"])
    return got.select("file", F.col("section").alias("oligo_id"), "indel", "oligo_indel", F.col("reads").cast("long").alias("reads"))


def mappings(spark: SparkSession, path: str) -> DataFrame:
    """(description, oligo_ids, indels, muts) of a mapping file; unmapped reads have null ids."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("@@@")).select(F.split("value", "\t").alias("b"))
    part = lambda k: F.split(F.col("b")[k], ",")
    ids = F.when((F.col("b")[1] != "None") & (F.col("b")[1] != ""), part(1))
    return rows.select(F.col("b")[0].alias("description"), ids.alias("oligo_ids"), part(2).alias("indels"), part(3).alias("muts"))


def pam_table(spark: SparkSession, path: str, shift: int = 20) -> DataFrame:
    """(oligo_id, pam_idx, direction) of a table without header, shifted."""
    rows = spark.read.csv(path, sep="\t", schema="oligo_id string, pam_idx int, direction string")
    return rows.withColumn("pam_idx", F.col("pam_idx") - shift)


def result_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header; all columns are strings until they are cast."""
    return spark.read.csv(path, sep="\t", header=True)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """(name, chrom, pos, cigar, seq, qual) of alignment lines with 11 fields or more."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("b")).filter(F.size("b") >= 11)
    named = {"name": 0, "chrom": 2, "pos": 3, "cigar": 5, "seq": 9, "qual": 10}
    return rows.select(*((F.col("b")[k].cast("int") if n == "pos" else F.col("b")[k]).alias(n) for n, k in named.items()))


def near_locus(reads: DataFrame, chrom: str, middle: int, reach: int = 2000, most_n: float = 0.5) -> DataFrame:
    """Reads of one locus whose sequence is known for the most part."""
    unknown = F.length(F.regexp_replace("seq", "[^N]", "")) / F.length("seq")
    return reads.filter((F.col("chrom") == chrom) & (F.abs(F.col("pos") - middle) <= reach) & (F.length("seq") > 0) & (unknown <= most_n))


def perfect(reads: DataFrame) -> DataFrame:
    """Reads that align without a gap."""
    return reads.filter(F.col("cigar").rlike(r"^\d+M$"))


def weights(spark: SparkSession, path: str) -> DataFrame:
    """(ord, feature, value) of a weights file; its first line names the training guides."""
    rows = numbered_lines(spark, path).filter("line_no > 0 and value <> ''")
    return rows.select((F.col("line_no") - 1).alias("ord"), F.substring_index("value", "\t", 1).alias("feature"), F.substring_index("value", "\t", -1).cast("double").alias("value"))


def analyser_report(spark: SparkSession, path: str) -> DataFrame:
    """(seq, wge_ids) of `SEQ:` lines followed by indented ids. A line that is neither raises, and so does an id before the
    first sequence."""
    rows = numbered_lines(spark, path).filter("trim(value) <> ''")
    name = F.when(F.col("value").endswith(":"), F.regexp_replace("value", ":$", ""))
    filled = filled_down(rows, name, "seq").withColumn("id", F.expr("try_cast(trim(value) as bigint)"))
    wrong = F.col("seq").isNull() | (F.col("id").isNull() & ~F.col("value").endswith(":"))
    filled = filled.withColumn("seq", F.when(wrong, F.raise_error(F.concat(F.lit("malformed line: "), "value"))).otherwise(F.col("seq")))
    ids = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("line_no", "id"))))
    return filled.groupBy("seq").agg(F.transform(ids, lambda x: x["id"]).alias("wge_ids"))


def sample_names(names: DataFrame, name: str = "sample") -> DataFrame:
    """names with the parts of each sample's name: cell_line, dpi, virus, coverage, date, month."""
    p = parsed(F.col(name))
    return names.select("*", *(p[c].alias(c) for c in ("cell_line", "dpi", "virus", "coverage", "date", "month")))


def sample_dirs(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, ord) of data folders (study/data/sample): controls first, then samples of the old and of the new library."""
    name = F.substring_index(path, "/", -1)
    day = name.contains("DPI")
    old = name.contains("Old") | name.contains("6O") | name.contains("12O")
    rank = F.when(name.contains("NULL"), 0).when(day & old, 1).when(day, 2)
    rows = paths.select(F.col(path).alias("path"), rank.alias("_r")).filter("_r is not null")
    return rows.withColumn("ord", F.row_number().over(Window.orderBy("_r", "path"))).drop("_r")  # a list of samples


def barcode_windows(spark: SparkSession, path: str) -> DataFrame:
    """(window, start, end) of a file of pairs; negative ones count from the end."""
    rows = numbered_lines(spark, path).filter("trim(value) <> ''").withColumn("b", F.split(F.trim("value"), r"\s+"))
    return rows.select("line_no", F.col("b")[0].cast("int").alias("start"), F.col("b")[1].cast("int").alias("end")).withColumnRenamed("line_no", "window")


def null_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, oligo_id, seq, variant, pam_idx, direction, percent) of control templates."""
    got = sectioned(spark, path, ["seq", "variant", "pam_idx", "direction", "percent"]).withColumnRenamed("section", "oligo_id")
    return got.withColumn("pam_idx", F.col("pam_idx").cast("int")).withColumn("percent", F.col("percent").cast("double"))


def null_profile(summary: DataFrame, unedited_only: bool = True) -> DataFrame:
    """(oligo_id, oligo_indel, reads): reads of each synthesis variant, of unedited rows only or of all."""
    rows = summary.filter("indel = '-'") if unedited_only else summary
    return rows.groupBy("oligo_id", "oligo_indel").agg(F.sum("reads").alias("reads"))


def unchanged_pam(targets: DataFrame) -> DataFrame:
    """(oligo_id, pam_idx, reverse) of the first unchanged template of each oligo of expected_targets() or null_summaries(): by
    the column line_no, or where there is none by the least PAM."""
    rows = targets.filter("variant = '-'")
    rows = rows.withColumn("reverse", F.col("direction") != "FORWARD") if "reverse" not in rows.columns else rows
    order = [c for c in ("file", "line_no") if c in rows.columns]
    return rows.groupBy("oligo_id").agg(F.min(F.struct(*order, "pam_idx", "reverse")).alias("m")).select("oligo_id", "m.pam_idx", "m.reverse")


def section_ids(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, id): what stands behind `@@@`, the whole line."""
    rows = numbered_lines(spark, path).filter(F.col("value").startswith("@@@"))
    return rows.select("file", "line_no", F.substring("value", 4, 1 << 20).alias("id"))


def section_count(spark: SparkSession, path: str) -> DataFrame:
    """(file, n): number of sections of each file."""
    return section_ids(spark, path).groupBy("file").agg(F.count("*").alias("n"))


def mapped_ids(spark: SparkSession, path: str) -> DataFrame:
    """(oligo_id, n) of a file of mapped reads, whose names begin with the oligo's id and a dot."""
    return fasta(spark, path).groupBy(F.substring_index("id", ".", 1).alias("oligo_id")).agg(F.count("*").alias("n"))


def oligo_details(spark: SparkSession, path: str) -> DataFrame:
    """(oligo_id, guide, target, pam_idx, direction, comments, old) of a table with a header; the last row of an id counts."""
    cols = {"ID": "oligo_id", "Guide": "guide", "Target": "target", "PAM Location": "pam_idx", "PAM Direction": "direction", "Comments": "comments", "Old": "old"}
    head, *_ = (r["value"].split("\t") for r in spark.read.text(path).limit(1).collect())
    rows = numbered_lines(spark, path).filter("line_no > 0").select("line_no", F.split("value", "\t").alias("b"))
    got = rows.select("line_no", *(F.get("b", F.lit(head.index(k))).alias(n) if k in head else F.lit(None).cast("string").alias(n) for k, n in cols.items()))
    last = got.groupBy("oligo_id").agg(F.max(F.struct("line_no", *list(cols.values())[1:])).alias("m")).select("oligo_id", *(f"m.{n}" for n in list(cols.values())[1:]))
    return last.withColumn("pam_idx", F.col("pam_idx").cast("int")).withColumn("old", F.lower("old") == "true")


def old_new_ids(spark: SparkSession, path: str) -> DataFrame:
    """(old_id, new_id) of a table of two columns separated by blanks; ids without a match go."""
    rows = spark.read.csv(path, sep=" ", header=True)
    gone = F.col("New").isin("matchlessA", "matchlessC", "matchlessT")
    return rows.filter(~gone).select(F.col("Old").alias("old_id"), F.col("New").alias("new_id"))


def validation_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(old_id, new_id) that a model is validated on."""
    return result_table(spark, path).select(F.col("Old Oligo Id").alias("old_id"), F.col("New Oligo Id").alias("new_id"))


def repeat_deletions(spark: SparkSession, path: str) -> DataFrame:
    """(oligo_id, left, right, mh_len, indel) of lines `id, l:r:n lists, names`, lists with a comma at the end."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("@@@")).select(F.split("value", "\t").alias("b"))
    items = lambda k: F.filter(F.split(F.get("b", F.lit(k)), ","), lambda x: x != "")
    one = rows.select(F.col("b")[0].alias("oligo_id"), F.explode(F.arrays_zip(items(1).alias("mh"), items(2).alias("indel"))).alias("x"))
    part = lambda k: F.split("x.mh", ":")[k].cast("int")
    return one.select("oligo_id", part(0).alias("left"), part(1).alias("right"), part(2).alias("mh_len"), F.col("x.indel").alias("indel"))


def insert_details(spark: SparkSession, path: str) -> DataFrame:
    """(oligo_id, ins, indel, left_base, right_base) of a wide table with a column `I1_x` for each insert x; one line stands
    before its header."""
    rows = numbered_lines(spark, path)
    head = rows.filter("line_no = 1").select("file", F.split("value", "\t").alias("h"))  # a row for each file
    told = rows.filter("line_no > 1 and value <> ''").join(F.broadcast(head), "file").select("h", F.split("value", "\t").alias("b"))
    n = F.size("h")
    pairs = F.arrays_zip(F.slice("h", F.lit(2), n - 3).alias("name"), F.slice("b", F.lit(2), n - 3).alias("indel"))
    wide = told.select(F.col("b")[0].alias("oligo_id"), F.element_at("b", n - 1).alias("left_base"), F.element_at("b", n).alias("right_base"), F.explode(pairs).alias("x"))
    return wide.select("oligo_id", F.substring_index("x.name", "_", -1).alias("ins"), F.col("x.indel").alias("indel"), "left_base", "right_base")


def insert_bases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(oligo_id, left_base, right_base) of the tables of several libraries, with short ids."""
    rows = [insert_details(spark, p) for p in paths]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.select(F.substring_index("oligo_id", "_", 1).alias("oligo_id"), "left_base", "right_base").distinct()


def fastq_of_guide(spark: SparkSession, path: str, guide: str) -> DataFrame:
    """fastq() with ids that begin with the guide and a dot, unless they have a dot already."""
    own = F.when(F.col("read_id").contains("."), F.col("read_id")).otherwise(F.concat(F.lit(guide + "."), "read_id"))
    return fastq(spark, path).withColumn("read_id", own)


def template(spark: SparkSession, path: str) -> DataFrame:
    """(oligo_id, pam_idx, direction, seq) of a template in two lines."""
    bits = F.split("description", r"\s+")
    return fasta(spark, path).select(F.substring_index("id", "_", 1).alias("oligo_id"), bits[1].cast("int").alias("pam_idx"), bits[2].alias("direction"), "seq")


def sequencing_runs(spark: SparkSession, path: str) -> DataFrame:
    """(location, cell, time, run) of a table of sequencing runs: the library's name holds location, cell and time point, the
    latter two one place earlier where a replicate `R...` stands at the end."""
    bits = F.split("Library_Name_s", "_")
    back = F.when(F.element_at(bits, -1).startswith("R"), 1).otherwise(0)
    at = lambda k: F.element_at(bits, F.lit(k) - back)
    return result_table(spark, path).select(bits[1].alias("location"), at(-2).alias("cell"), at(-1).alias("time"), F.col("Run_s").alias("run"))


def spacers(spark: SparkSession, path: str, prefix: str, number: str = "Spacer ", place: str = "Genomic location of spacer (hg19)", seq: str = "Spacer sequence") -> DataFrame:
    """(guide, location, seq) of a table of spacers by number; a guide is the prefix and the number."""
    return result_table(spark, path).select(F.concat(F.lit(prefix), F.trim(F.col(number))).alias("guide"), F.col(place).alias("location"), F.col(seq).alias("seq"))


def file_map(spark: SparkSession, path: str) -> DataFrame:
    """(farm, original) of lines `original farm`."""
    rows = spark.read.text(path).filter("trim(value) <> ''").select(F.split(F.trim("value"), " ").alias("b"))
    return rows.select(F.col("b")[1].alias("farm"), F.col("b")[0].alias("original"))


def batch_targets(spark: SparkSession, path: str) -> DataFrame:
    """(oligo_id, seq, pam_idx) of a table `ID, Target, PAM Index`."""
    return result_table(spark, path).select(F.col("ID").alias("oligo_id"), F.col("Target").alias("seq"), F.col("PAM Index").cast("int").alias("pam_idx"))


def guide_info(lines: DataFrame, oligo: str) -> DataFrame:
    """The first CRISPR line (line_no, value) of an id, taken apart."""
    from cutscape.functions.sequence import crispr_line

    key = F.regexp_replace(F.substring_index("value", " ", 1), "^@@@", "")
    rows = lines.filter(F.col("value").startswith("@@@") & (key == oligo))
    return rows.agg(F.min_by("value", "line_no").alias("value")).filter("value is not null").select(crispr_line(F.col("value")).alias("c")).select("c.*")


def training_guides(spark: SparkSession, path: str) -> DataFrame:
    """(oligo_id) of the guides that a weights file was trained on, its first line."""
    rows = numbered_lines(spark, path).filter("line_no = 0")
    return rows.select(F.explode(F.split("value", ",")).alias("oligo_id"))
