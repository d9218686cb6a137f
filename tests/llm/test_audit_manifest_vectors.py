"""Source divergence, Merkle manifest and vector packing on odd rows, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cutscape.llm import divergence_audit, merkle, queries, tokens, vector_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice(["Alpha", "beta", "gámma", "delta2", "Ö", "x-y", "the", "the", "the"])
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (-4, "the the\nTHE", "en", "s1", 3), (-4, "the the\nTHE", "en", "s1", 3), (-4, "other", "en", "s1", None), (7, "\n\n", "de", None, 2), (8, "x" * 3000, "fr", "only", 1)]
    return rows + [(i, " ".join(word() for _ in range(rng.randint(0, 60))) + "\n" * (i % 3), rng.choice(["en", "en", "de"]), rng.choice(["s1", "s1", "s1", "s2", "s3", "é"]), i) for i in range(10, 400)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in ("_key", "_id", "_node", "_pos", "_n", "leaf", "root", "path", "term", "n", "texts", "learned", "value", "rank", "row_no", "p", "start")})


# divergence


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOW))) for _, text, lang, source, _ in rows]
    has, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        count[lang, source].update(terms)
        has[lang].update(set(terms))
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in has[lang].items() if n >= least]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        whole = sum((count[lang, s] for s in sources), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def test_divergence(spark, docs, none, monkeypatch):
    want = brute_audit(corpus())
    assert len(want) > 40
    got = divergence_audit.audit(clashing(docs))
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == want
    assert divergence_audit.audit(none).count() == 0
    monkeypatch.setattr(divergence_audit, "HELD", 3)  # tables of counts that are given away again and again
    assert sorted(map(tuple, divergence_audit.audit(docs, top=2).collect())) == brute_audit(corpus(), top=2)


def test_shared_paths_add_up():
    """The tree's sums are those of every row by itself, whatever the batches; values beyond 64 bits are exact."""
    rng = np.random.default_rng(5)
    rows = sorted({tuple(sorted(rng.choice(6, rng.integers(1, 6), replace=False).tolist())) for _ in range(80)})
    p0 = rng.integers(1, 10, 6)
    lines = sorted([x for s in r for x in (s, int(rng.choice([3, 10**9])), int(p0[s]))] for r in rows for _ in range(3))
    times = rng.integers(1, 10**6, len(lines))
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for line, m in zip(lines, times.tolist()):
        items = list(zip(line[::3], line[1::3], line[2::3]))
        for a, p, z in items:
            for b, q, y in items:
                if a != b:
                    want[a, b] += m * (f(p, q) - f(p, y) - f(z, q) + f(z, y))
    assert max(want.values()) > 2**63
    for cut in (0, 17, len(lines)):
        got = Counter()
        for a, b in ((0, cut), (cut, len(lines))):
            if a < b:
                part = lines[a:b]
                lengths = np.array([len(x) // 3 for x in part])
                padded = np.array([np.pad(np.array(x).reshape(-1, 3), ((0, lengths.max() - len(x) // 3), (0, 0)), constant_values=1) for x in part])
                got.update(divergence_audit.tree_corrections(padded, lengths, times[a:b]))
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """{leaf: [(subroot, root, proof, folded root with another leaf)]}"""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for id, text, lang, source, n in rows:
        groups[source].append(((id is not None, id or 0), h(*map(told, (id, source, lang, n, text)))))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for path, i in zip(paths, at):
                a = i // 3 * 3
                path.append((nodes[a:i], nodes[i + 1 : a + 3]))
            at = [i // 3 for i in at]
            nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        return nodes[0], paths

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: climb([x[1] for x in sorted(groups[s])]) for s in names}
    root, above = climb([own[s][0] for s in names])
    out = []
    for s, top in zip(names, above):
        for (_, leaf), path in zip(sorted(groups[s]), own[s][1]):
            node = "0" * 64
            for a, b in path + top:
                node = h(*a, node, *b)
            out.append((leaf, own[s][0], root, h(*(x for a, b in path + top for x in a + b)), node))
    return sorted(out)


def given(docs):
    leaves = docs.select("source", "doc_id", merkle.leaf("doc_id", "source", "lang", "n_chars", "text").alias("leaf"))
    whole = merkle.manifest(leaves, "source", "doc_id")
    return whole.select("leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), merkle.folded(F.lit("0" * 64), F.col("path")).alias("other"), (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("right"))


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest(docs, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    got = given(clashing(docs)).collect()
    assert all(r["right"] for r in got)
    assert sorted(tuple(r)[:5] for r in got) == brute_manifest(corpus())


def test_manifest_of_few_rows(spark, none):
    assert given(none).count() == 0
    for rows in ([(1, "a\n", "en", "s", 2)], [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1), (3, None, None, None, None)]):
        got = given(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(tuple(r)[:5] for r in got) == brute_manifest(rows)


def test_changes_show(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 4}" if i % 4 else None, i) for i in range(40)]
    changed = [(i, t + "!" if i == 8 else t, *x) for i, t, *x in rows if i != 5] + [(99, "", "", "new", 0)]
    both = []
    for r in (rows, changed):
        df = spark.createDataFrame(r, SCHEMA)
        leaves = df.select("source", "doc_id", merkle.leaf("doc_id", "text").alias("leaf"))
        both.append(merkle.manifest(leaves, "source", "doc_id").cache())
    got = {r["source"]: (r["old"] is None, r["new"] is None) for r in merkle.differing(*both, "source").collect()}
    assert got == {None: (False, False), "s1": (False, False), "new": (True, False)}


# vector packing


def test_byte_encoder():
    t, e, rng = Tokenizer.from_file(BYTES), tokens.byte_encoder(BYTES), random.Random(1)
    letters = ["a", "B", " ", "  ", "\n", " \n", "\t", "'s", "'", "12", "é", " ", "　", "x.", "—", "中", "\x1c", "\x85", "\r\n", "don't", "<|endoftext|>", "́", "\0", "\U00010400", "ᲀ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += ["x" * 30_000, " " * 50_000 + "x", "a b" + " " * 19_000 + "c " * 9000, "\n \t" * 20_000, "é" * 20_001, " ".join(["word"] * 30_000)]
    for s in texts:
        assert np.frombuffer(e.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids
    assert e.encode(None) == e.encode("") == b""


def held(rows, limits, padded_at_most=0):
    """What must hold of any packing; returns the pieces by example."""
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    padding = 0
    for parts in seq.values():
        parts.sort(key=lambda r: r["offset"])
        total = 0
        for r in parts:
            assert r["offset"] == total and r["length"] > 0
            total += r["length"]
        assert total <= limits.tokens and len(parts) <= limits.segments and sum(r["loss_tokens"] for r in parts) <= limits.loss
        padding += 0 if total == limits.tokens or total & (total - 1) == 0 else limits.tokens - total
    assert padding <= padded_at_most
    return by


def test_vector_packing(spark, docs, none):
    limits, t = vector_packing.Limits(512, 8, 400), Tokenizer.from_file(BYTES)
    told = clashing(docs.dropDuplicates(["doc_id"])).cache()
    placed = vector_packing.packed(vector_packing.documents(told), BYTES, limits, end_id=1, pool=16, ids=True).cache()
    by = held(placed.collect(), limits)
    texts = {r["doc_id"]: r["text"] for r in told.collect()}
    assert set(by) == set(texts)
    for key, text in texts.items():
        want, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes(), 0
        for r in sorted(by[key], key=lambda r: r["start"]):
            line = want[4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert (r["start"], r["ids_crc32"], r["doc_tokens"], r["loss_tokens"], bytes(r["ids"])) == (at, zlib.crc32(line), len(want) // 4, r["length"], line)
            at += r["length"]
        assert at == len(want) // 4
    whole = vector_packing.sequences(placed).collect()
    assert sum(r["length"] for r in whole) == sum(len(r["ids"]) // 4 for r in whole) == placed.agg(F.sum("length")).first()[0]
    assert vector_packing.packed(vector_packing.documents(none), BYTES, limits, 1).count() == 0
    repeated = vector_packing.packed(vector_packing.documents(told.unionByName(told)), BYTES, limits, 1)
    assert repeated.agg(F.sum("length")).first()[0] == 2 * placed.agg(F.sum("length")).first()[0]


def test_instruction_data(spark):
    """Only the assistant's tokens bear loss; all three limits hold at once and each binds somewhere."""
    rng = random.Random(9)
    turns = [(c, k, "assistant" if k % 2 else "user", "word " * rng.randint(0, 120)) for c in range(150) for k in range(rng.randint(1, 5))] + [(None, 0, None, None), (999, 0, "assistant", "long " * 4000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    limits = vector_packing.Limits(512, 6, 200)
    rows = vector_packing.packed(vector_packing.conversations(frame), BYTES, limits, end_id=1, pool=64).collect()
    by, t = held(rows, limits), Tokenizer.from_file(BYTES)
    for key in {x[0] for x in turns}:
        own = [x for x in turns if x[0] == key]
        n = [len(t.encode(x[3] or "", add_special_tokens=False).ids) for x in own]
        assert sum(r["length"] for r in by[key]) == sum(n) + 1
        assert sum(r["loss_tokens"] for r in by[key]) == sum(k for k, x in zip(n, own) if x[2] == "assistant") + (own[-1][2] == "assistant")
    seq = defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append(r)
    assert max(sum(r["loss_tokens"] for r in s) for s in seq.values()) == 200 and max(map(len, seq.values())) == 6


def test_few_are_cut(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h " * (i % 40)) for i in range(600)], "doc_id long, text string").coalesce(1)
    rows = vector_packing.packed(vector_packing.documents(docs), BYTES, vector_packing.Limits(), end_id=1).collect()
    held(rows, vector_packing.Limits())
    assert len(rows) <= 600 + 2 * len({r["sequence_id"] for r in rows})


# queries


@pytest.mark.parametrize("name", ["op11_divergence_audit", "op12_merkle_manifest"])
def test_equals_sql(spark, name, tmp_path):
    rows = [r for r in corpus() if r[0] is not None and r[0] != -4]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = c.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[x] for x in rel.columns) for r in df.collect()))) == sorted(map(repr, rel.fetchall()))


def test_tables_are_released(spark):
    from cutscape.llm import common

    common.release(spark)
    df = common.written(spark.range(10), "numbers")
    path = common._MADE[-1]
    where, plain = common.filesystem(path)
    assert df.count() == 10 and where.get_file_info(plain).type.name == "Directory"
    assert common.release(spark) == 1 and where.get_file_info(plain).type.name == "NotFound" and common.release(spark) == 0
