"""Registered queries of this subpackage, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutscape.llm import chat, decontam, divergence_audit, fingerprint, license_scan, merkle, ngram_join, packing, sharding, token_io, toxicity, vector_packing, warc
from cutscape.llm.common import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.license_report(license_scan.license_spans(docs))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "row_no", "place",
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents")).drop("text_hash", "group")


OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(list_slice(w, i, i + 4), ' ') end as g
  from w, lateral (select unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i) where len(w) > 0
), n as (select doc_id, count(*) as n from s group by doc_id),
o as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), l as (
  select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)
), r(doc_id, c) as (
  select doc_id, doc_id from documents union select l.a, r.c from r join l on l.b = r.doc_id
)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.c) as component_id
from documents d join r using (doc_id) left join n using (doc_id) group by d.doc_id
"""


def vocabulary() -> str:
    """Place of the tokenizer's file; only its path goes to the executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_up = packing.pieces(table(spark, sf_dir, "documents"), vocabulary(), capacity=4096, end_id=1)
    return packing.packed(cut_up, 4096).withColumnRenamed("_id", "doc_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    files = token_io.write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=2)
    return token_io.read_tokens(spark, files).withColumnRenamed("id", "doc_id")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows are one layout, the added conversation is another; each is mapped by its own fingerprint."""
    own = spark.sql(
        "select cast(-7 as bigint) conv_id, transform(array('user', 'assistant'), r -> named_struct('role', r, 'content', '</s>[INST] ok [/INST]')) messages"
    )
    turns = chat.canonical(table(spark, sf_dir, "conversations")).unionByName(chat.canonical(own))
    return chat.digest(chat.read_back(chat.formatted(turns)))


OP5_SQL = """
with told as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped as (
  select *, regexp_replace(text, '([<\\[])(\\x{E000}*)(/?s>|/?INST\\])', '\\1' || chr(57344) || '\\2\\3', 'g') as safe from told
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' then length(safe) + 7 else length(safe) + length(role) + 16 end) as bigint) as formatted_chars
from escaped group by conv_id
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.scored(docs.select("doc_id", "text"), machine).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fingerprint.edited_pairs(table(spark, sf_dir, "documents"))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text("sketch").alias("fingerprint"), fingerprint.as_text("edited_sketch").alias("edited_fingerprint"),
        fingerprint.jaccard("sketch", "edited_sketch").alias("near_edited"), fingerprint.jaccard("sketch", "next_sketch").alias("near_next"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    n_hit = decontam.hit_words()
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP8_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') as win
  from iw, lateral (select unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s) where len(w) > 0
), sizes as (select distinct n from windows),
places as (
  select doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as win
  from dw, sizes, lateral (select unnest(range(1, len(w) - n + 2)) as s) where len(w) >= n
), hits as (select doc_id, s, n, item_id from places join windows using (n, win)),
hit_words as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from hits)) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names
  from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit_words using (doc_id) left join items using (doc_id)
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    read = warc.read_archives(spark, files)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha1(body) as h, min(page_id) over (partition by body) as first from p),
b as (
  select *, list_transform(range(0, 8), lambda i: cast('0x' || substr(h, cast(i * 5 + 1 as integer), 5) as integer)) as v from d
)
select page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from b
"""


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as no from documents),
groups as (select distinct lang, source from d),
t as (
  select lang, source, no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (select lang, term, cast(count(*) as hugeint) as n from t group by lang, term having count(distinct no) >= 3),
langs as (select lang, cast(sum(n) as hugeint) as n, cast(count(*) as hugeint) as v from kept group by lang),
c as (select t.lang, source, term, cast(count(*) as hugeint) as n from t join kept using (lang, term) group by all),
sums as (select lang, source, cast(sum(n) as hugeint) as n from c group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + l.v) as p,
    1 + (1000000000::hugeint * (k.n + 1)) // (l.n + l.v) as q
  from groups g join kept k using (lang) join langs l using (lang) left join sums s using (lang, source) left join c using (lang, source, term)
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // b.p) as bigint) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), every_pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
), every as (
  select * from every_pair union all
  select lang, source, 'term', term, cast((p - q) * (p - q) // q as bigint) from p where n > 0 and p > q
)
select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
from every qualify part = 'pair' or rank <= 200
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    shown = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("source", "doc_id", merkle.leaf("doc_id", "source", "lang", "n_chars", "text").alias("leaf"), merkle.leaf("doc_id", "source", "lang", "n_chars", shown).alias("shown"))
    whole = merkle.manifest(leaves, "source", "doc_id", keep=("shown",))
    told = whole.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("shown"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _up(name: str, start: str) -> str:
    """SQL of the levels of nodes above lists of leaves: (source, k, nodes)."""
    return f"""{name}(source, k, nodes) as (
  {start} union all
  select source, k + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(list_slice(nodes, 3 * i + 1, 3 * i + 3), '')))
  from {name} where len(nodes) > 1
)"""


_SIDES = "array_to_string(list_slice(nodes, ({q} // 3) * 3 + 1, {q}), '') || '|' || array_to_string(list_slice(nodes, {q} + 2, ({q} // 3) * 3 + 3), '')"
OP12_SQL = f"""
with recursive d as (
  select *, replace(text, chr(10), '') as bare, list_reduce(
    list_concat([4294967295::bigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))
  ) & 1 as odd from documents
), l as (
  select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as pos, {{leaf}} as leaf, case when odd = 1 then {{shown}} else leaf end as shown from d
), {_up('up', "select source, 0, list(leaf order by pos) from l group by source")},
subroots as (select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as nth from up where len(nodes) = 1),
{_up('over_all', "select null::varchar, 0, list(subroot order by nth) from subroots")},
own as (
  select l.doc_id, list({_SIDES.format(q='(pos // (3 ** k)::bigint)')} order by k) as path
  from l join up on l.source is not distinct from up.source where len(nodes) > 1 group by l.doc_id
), top as (
  select subroots.source, list({_SIDES.format(q='(nth // (3 ** k)::bigint)')} order by k) as path from subroots, over_all o where len(nodes) > 1 group by subroots.source
), w as (
  select l.*, s.subroot, (select nodes[1] from over_all where len(nodes) = 1) as root, list_concat(coalesce(own.path, []), coalesce(top.path, [])) as path
  from l join subroots s on l.source is not distinct from s.source left join own using (doc_id) left join top on l.source is not distinct from top.source
), f as (
  select *, list_reduce(list_concat([shown], path), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) as folded_root from w
)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) as proof_sha256, folded_root, folded_root = root as verified from f
""".format(
    **{
        name: "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
        for name, text in (("leaf", "text"), ("shown", "bare"))
    }
)


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    examples = vector_packing.documents(table(spark, sf_dir, "documents"))
    placed = vector_packing.packed(examples, public_tokenizers.path("byte_bpe_50k.json"), vector_packing.Limits(tokens=2048), end_id=1)
    return placed.withColumnRenamed("_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_license_scan, op2_sharding, op3_ngram_jaccard, op4_best_fit_packing, op5_chat_formatting, op6_toxicity, op7_fingerprints, op8_decontamination, op9_token_files, op10_warc, op11_divergence_audit, op12_merkle_manifest, op13_vector_packing)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": OP3_SQL, "op5_chat_formatting": OP5_SQL, "op8_decontamination": OP8_SQL, "op10_warc": OP10_SQL, "op11_divergence_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
