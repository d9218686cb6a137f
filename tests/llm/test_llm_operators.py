"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, against brute force."""

import base64
import bisect
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from cutscape.llm import chat, common, decontam, fingerprint, license_scan, ngram_join, packing, queries, sharding, token_io, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = queries.vocabulary()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gámma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randint(0, 30)) for _ in range(n))


def corpus():
    rng = random.Random(7)
    base = sentence(rng, 120)
    near = base.split()
    near[3], near[90] = "changed", "again"
    texts = [None, "", "   \n", "one two", "One  TWO", base, base, " ".join(near), base + " and a tail", sentence(rng, 30000), sentence(rng, 4), "x" * 5000, "é" * 700, "<|endoftext|> ok", "a</s>[INST]b"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(5, base, "en", "s", len(base))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with the names that operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("_id", "_t", "size", "class", "n", "piece", "row_no", "score", "spans", "fragment", "_hash", "_slice")})


# license scan


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def brute_spans(text, notice):
    """Words at which a notice stands unchanged, and every stretch of words (edits, start, end) within its bound."""
    w, found = words(text), []
    said, k = notice.words, notice.edits
    n = len(said.split())
    exact = [i for i in range(len(w)) if w[i : i + n] == said.split()]
    for i in range(len(w)):
        for j in range(i + 1, len(w) + 1):
            stretch = " ".join(w[i:j])
            if abs(len(stretch) - len(said)) > k or (notice.telling and [x for x in w[i:j] if x.isdigit()] != [x for x in said.split() if x.isdigit()]):
                continue
            e = distance(stretch, said)
            if notice.telling:
                before, after = f" {said} ".split(f" {notice.telling} ")
                cuts = [(" ".join(w[i:p]), " ".join(w[p + 1 : j])) for p in range(i, j) if w[p] == notice.telling]
                e = min([distance(x, before.strip()) + distance(y, after.strip()) for x, y in cuts], default=k + 1)
            if e <= k:
                found.append((e, i, j))
    return exact, found


def test_license_scan(spark, docs, none):
    rng = random.Random(3)
    told = ["Released under the MIT License.", "under teh mit license", "Apache License, Version 2.0 CC BY-NC 4.0 cc by nc", "apache licens version 2", "nothing", None, "under the mit license " * 50]
    for _ in range(60):
        t = list(rng.choice([n.words for n in license_scan.NOTICES]))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("abc xyz")
        told.append(sentence(rng, 5) + " " + "".join(t) + " " + sentence(rng, 5))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in license_scan.license_report(license_scan.license_spans(clashing(df))).collect()}
    for i, t in enumerate(told):
        places = sorted(p for n in license_scan.BASE for p in brute_spans(t, n)[0])
        near = {n: brute_spans(t, n)[1] for n in license_scan.NOTICES}
        may = {n.label for n, found in near.items() if found}
        rivals = lambda n, m: any(o != n and x <= m[0] and a < m[2] and m[1] < b for o, found in near.items() for x, a, b in found)  # noqa: B023, E731
        must = {n.label for n, found in near.items() if found and not rivals(n, min(found))}
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words(t)), len(places), places[0] if places else None, places[-1] if places else None)
        labels = set(filter(None, r.labels.split(",")))
        assert must <= labels <= may and set(filter(None, r.base_labels.split(","))) <= labels, t
        assert 0 <= r.score <= 1 and (r.score == 1.0) >= bool(places)
    assert license_scan.license_spans(none).count() == 0 and license_scan.license_spans(docs).count() == docs.count()


def test_licenses_are_told_apart(spark, tmp_path):
    told = {
        "under the bsd license": "", "under the gpl license": "", "under the isc license": "", "under the permit license": "",
        "under the mit license": "mit", "under teh mit licence": "mit", "undr the mit license": "mit", "under a mit licens": "",
        "apache license version 1": "", "apache license version 1 2": "", "apache license version 2": "apache-2", "apache licens verson 2": "apache-2",
        "gnu general public license version 2": "gpl-2", "gnu general public licence version 2": "gpl-2", "gnu general public licence version 3": "gpl-3",
        "gnu genral public license version 3": "gpl-3", "gnu general public license version 1": "", "gnu general public license version 12": "",
        "bsd 2 clause license": "bsd-2", "bsd 3 clause license": "bsd-3", "bsd 3 clause licence": "bsd-3", "bsd 4 clause license": "", "bsd 2 clauses license": "bsd-2",
        "mozila public license": "mpl",
    }
    rows = [(i, f"some words {t} and more") for i, t in enumerate(told)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.labels for r in queries.op1_license_scan(spark, str(tmp_path)).collect()}
    assert {t: got[i] for i, t in enumerate(told)} == told


def test_many_notices_in_one_text():
    finders = [license_scan.Finder(n) for n in license_scan.NOTICES]
    text = b"under teh mit license, " * 20_000 + b"under the mit license " * 20_000
    began = time.process_time()
    n, spans = license_scan.scan_text(text, finders)
    assert time.process_time() - began < 60 and n == 160_000
    assert [s["word"] for s in spans] == list(range(0, 160_000, 4)) and sum(s["base"] for s in spans) == 20_000


# sharding


def test_permutation():
    for n in (1, 2, 3, 10, 997, 5000):
        assert sorted(sharding.permute(np.arange(n), n)) == list(range(n))
    assert list(sharding.permute(np.arange(1000), 1000)) != list(range(1000))


def test_sharding(docs, none):
    rows = sharding.sharded(clashing(docs), 4).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == docs.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    told = Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == told
    again = {(r.doc_id, r.row_no): r.place for r in sharding.sharded(docs.repartition(5), 4).collect()}
    assert again == {(r.doc_id, r.row_no): r.place for r in rows}
    assert sharding.sharded(none, 4).count() == 0


# n-gram join


def brute_components(rows, percent=80):
    sets = []
    for _, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = defaultdict(lambda: 1 << 60)
    for k, r in enumerate(rows):
        low[find(k)] = min(low[find(k)], r[0])
    return Counter((r[0], len(sets[k]), low[find(k)]) for k, r in enumerate(rows))


def near_rows():
    rng = random.Random(11)
    rows = corpus()
    base = sentence(rng, 150).split()
    for k in range(60):  # a group of near copies, some chains among them
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["p", "q", f"u{k}"])
        rows.append((100 + k, " ".join(w), "en", "s", 1))
    shared = sentence(rng, 60)
    rows += [(200 + k, sentence(rng, rng.randint(5, 40)) + " " + shared, "en", "s", 1) for k in range(40)]
    chain = sentence(rng, 100).split()
    for k in range(12):
        chain = chain[2:] + [f"c{k}a", f"c{k}b"]
        rows.append((300 + k, " ".join(chain), "en", "s", 1))
    return rows


def test_ngram_join(spark, none):
    rows = near_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ngram_join.near_components(clashing(df)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert ngram_join.near_components(none).count() == 0


def template_rows(n, rng):
    """Pages of ten of forty shared blocks: every block is on a quarter of them, hardly any two link."""
    blocks = [" ".join(f"b{k}w{j}" for j in range(40)) for k in range(40)]
    rows = [(k, " ".join(blocks[b] for b in sorted(rng.sample(range(40), 10))), "en", "s", 1) for k in range(n)]
    near = rows[5][1].split()
    near[7], near[200] = "x", "y"
    return [*rows, (n, " ".join(near), "en", "s", 1), (n + 1, rows[9][1] + " a tail", "en", "s", 1)]


def test_ngram_join_of_templates(spark, monkeypatch):
    rows = template_rows(150, random.Random(5))
    seen, plainly = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "LISTED", 16)
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: (seen.append(pairs.count()), plainly(pairs, *rest))[1])
    got = ngram_join.near_components(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert sum(seen) < len(rows) ** 2 / 6, seen


def test_parts_lose_no_link(spark):
    rng = np.random.default_rng(3)
    pairs, rows = 0, []
    for k in range(60):  # pairs at and near the limit
        n = int(rng.integers(1, 400))
        tokens = rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)
        own, away = tokens[:n], int(rng.integers(0, max(1, n // 9) + 1))
        other = np.concatenate((own[away:], tokens[n : n + int(rng.integers(0, away + 1))]))
        both = len(own) - away
        if len(other) and 100 * both >= 80 * (len(own) + len(other) - both):
            pairs += 1
            rows += [(2 * k, len(own), np.sort(own).tobytes()), (2 * k + 1, len(other), np.sort(other).tobytes())]
    keys = ngram_join.part_keys(spark.createDataFrame(rows, "class long, n long, set binary"), 80)
    met = keys.withColumn("pair", F.floor(F.col("class") / 2)).groupBy("token", "pair").agg(F.count_distinct("class").alias("n"), F.sum("side").alias("s"))
    met = met.filter("n = 2 and s in (1, 4)")
    assert pairs > 30 and met.select("pair").distinct().count() == pairs


def test_pieces_are_bounded(spark, monkeypatch):
    """Ten thousand pages of one template: no frame of parts has more rows than the bound, and no row is lost."""
    rng, block = random.Random(2), [" ".join(f"b{i}w{j}" for j in range(12)) for i in range(40)]
    pages = [(i, " ".join(rng.sample(block, 10))) for i in range(10_000)]
    sets = [np.unique(s) for s in ngram_join.shingle_sets([t.encode() for _, t in pages])]
    frame = pd.DataFrame({"class": range(len(sets)), "n": list(map(len, sets)), "set": [s.tobytes() for s in sets]})
    seen = []
    monkeypatch.setattr(ngram_join, "in_pieces", lambda lines, columns, plainly=ngram_join.in_pieces: (seen.append(len(f)) or f for f in plainly(lines, columns)))

    class Here:
        """Runs a task here, on one batch."""

        def mapInPandas(self, run, schema):
            self.rows = sum(len(f) for f in run(iter([frame])))
            return self

    whole = ngram_join.part_keys(Here(), 80).rows
    assert whole == sum(seen) > 4 * ngram_join.ROWS and max(seen) <= ngram_join.ROWS


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 140))


# packing


def plain_best_fit(lengths, capacity):
    """Number of sequences of best fit, one piece after the other, longest first."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        n += gap == capacity
        if gap > x:
            bisect.insort(gaps, gap - x)
    return n


def test_sweep_gives_the_smallest_gap():
    rng = random.Random(1)
    for capacity in (7, 200):
        for _ in range(60):
            gaps = sorted(rng.randint(1, capacity) for _ in range(rng.randint(0, 40)))
            left = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 40)))
            table = lambda c: np.array([c.get(k, 0) for k in range(capacity + 1)])
            sweep = packing.Sweep.over(table(Counter(gaps)), table(left))
            pile = [(g, i) for i, g in enumerate(gaps) for _ in range(max(1, g // sweep.top)) if g > sweep.low]
            told = Counter()
            for length in sorted((x for x in left.elements() if x > sweep.low), reverse=True):  # plainly: a piece after the other
                fit = min((g, -i) for g, i in pile if g >= length)[0] if any(g >= length for g, _ in pile) else None
                if fit:
                    told[fit, length] += 1
                    pile.remove(max(x for x in pile if x[0] == fit))
            got = Counter()
            for gap in set(gaps):
                ranks = np.arange(gaps.count(gap))
                for of, length, number in sweep.taken_by(gap, ranks):
                    assert (number >= 0).all() and (number < sweep.placed[length]).all()
                    got.update((gap, n) for n in length.tolist())
            assert got == told


def test_packing_of_many_lengths(spark):
    rng = np.random.default_rng(2)
    for capacity, lengths in ((64, rng.integers(1, 65, 400)), (64, np.full(300, 22)), (512, np.ones(2000, int)), (512, rng.choice([170, 120, 3], 900)), (9, np.array([9, 1]))):
        rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
        placed = packing.packed(spark.createDataFrame(rows, "_id long, piece int, start long, length long, ids_crc32 long").repartition(3), capacity).collect()
        by = defaultdict(list)
        for r in placed:
            by[r.sequence_id].append((r.offset, r.length))
        assert sorted(r._id for r in placed) == list(range(len(lengths)))
        for parts in by.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert len(by) <= 1.01 * plain_best_fit(lengths.tolist(), capacity) + 1


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing(spark, docs, none):
    cut = packing.pieces(clashing(docs), TOKENIZER, 512, 1, ids=True)
    rows = packing.packed(cut, 512).collect()
    expected = Counter()
    for (i, *_), ids in zip(corpus(), reference_ids([r[1] for r in corpus()])):
        line = np.array([*ids, 1], "<u4")
        for k, a in enumerate(range(0, len(line), 512)):
            expected[i, k, a, len(line[a : a + 512]), zlib.crc32(line[a : a + 512].tobytes())] += 1
    assert Counter((r._id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 512
    whole = packing.sequences(packing.packed(packing.pieces(docs, TOKENIZER, 512, 1, ids=True), 512)).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole) and sum(r.length for r in whole) == sum(r.length for r in rows)
    assert packing.packed(packing.pieces(none, TOKENIZER, 512, 1), 512).count() == 0


# chat


def test_layouts_and_round_trip(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "<s>a</s>", "[INST]", "<s>", "</s> [", "", None, "x <", "é\n[/INST]"]
    rows = [(1, k, "assistant" if k % 2 else "user\nx", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(3))
    read = chat.read_back(chat.formatted(chat.canonical(df))).first()
    assert [(t.role, t.text, t.loss) for t in read.turns] == [(r[2], r[3] or "", r[2] == "assistant") for r in rows]
    for schema, row in (
        ("conv_id long, prompt string, response string", (1, "q", "a")),
        ("conv_id long, instruction string, input string, output string", (1, "q", "", "a")),
        ("conv_id long, messages array<struct<role:string,content:string>>", (1, [("user", "q"), ("assistant", "a")])),
        ("conv_id long, conversations array<struct<from:string,value:string>>", (1, [("human", "q"), ("gpt", "a")])),
        ("conv_id long, question string, answer string, extra int", (1, "q", "a", 5)),
    ):
        turns = chat.canonical(spark.createDataFrame([row], schema)).first().turns
        assert [(t.role, t.text) for t in turns] == [("user", "q"), ("assistant", "a")]
    for schema in ("conv_id long, other string", "conv_id long, prompt string, response string, question string, answer string"):
        with pytest.raises(ValueError):
            chat.canonical(spark.createDataFrame([(1, *["x"] * (schema.count(",")))], schema))
    assert chat.digest(chat.read_back(chat.formatted(chat.canonical(df.limit(0))))).count() == 0


def test_chat_of_odd_rows(spark, tmp_path):
    long = "<s>x" * 100_000
    rows = [(None, 0, "user", "a"), (None, 0, "user", "b"), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, None, None), (2, 0, "assistant", long)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op5_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    told = {None: [("user", "a"), ("user", "b")], 1: [("", ""), ("user", "same"), ("user", "same")], 2: [("assistant", long)], -7: [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]}
    assert {i: (r.n_turns, r.turns_sha256) for i, r in got.items()} == {i: (len(t), sha(t)) for i, t in told.items()}
    assert got[2].loss_chars == len(long) and got[-7].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


# toxicity


def test_toxicity(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        y = int(i % 5 == 0)
        t = sentence(rng, 40) + (f" {rng.choice(['idiot', 'scum', 'trash'])} {sentence(rng, 5)} lowei{rng.randint(0, 99)}" if y else "")
        rows.append((i, t))
        labels.append((i, y))
    rows += [(1000, None), (1001, ""), (1002, "idiot " * 20000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (99999, 1), (0, 1)], "doc_id long, toxic int")
    machine = toxicity.learn(clashing(d), lab.filter(~toxicity.held_out()))
    got = {r.doc_id: r.score for r in toxicity.scored(d, machine).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.5
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, y in held]) > 0.95
    few = toxicity.learn(d, lab, rows=50)
    assert len(few.kept) <= 2048
    nothing = toxicity.learn(none.select("doc_id", "text"), lab)
    assert toxicity.scored(d, nothing).agg(F.count_distinct("score")).first()[0] == 1


def test_pairs_matter():
    rows, y = [], []
    for k in range(400):
        a, b = k % 2, k // 2 % 2
        rows.append([x for x, on in ((0, a), (1, b)) if on])
        y.append(int(a and b))
    m = toxicity.fit(rows, np.array(y), np.arange(2), steps=400)
    s = m.scores([[], [0], [1], [0, 1]])
    assert s[3] > 0.7 > max(s[:3])


@pytest.mark.parametrize("toxic_where", [lambda a, b: a and b, lambda a, b: a == b, lambda a, b: a != b])
def test_pairs_are_learned(spark, toxic_where):
    """Two words that tell only together, through the screen: among 400 other words, in all of 3,000 texts."""
    rng, rows, labels = random.Random(11), [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randint(0, 400)}" for _ in range(30)] + ["alpha"] * a + ["beta"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic_where(a, b))))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.learn(d, lab.filter(~toxicity.held_out()))
    held = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.scored(d, machine).collect() if r.doc_id in held}
    assert np.mean([got[i] for i, y in held.items() if y]) > 0.9
    assert np.mean([got[i] for i, y in held.items() if not y]) < 0.02


def test_margins_and_gradient():
    rng = np.random.default_rng(5)
    k, n = 9, 30
    rows = [sorted(rng.choice(k, rng.integers(0, 6), replace=False).tolist()) for _ in range(n)]
    y, scale = rng.integers(0, 2, n).astype(float), rng.random(n)
    w0, w, v = 0.3, rng.normal(size=k), rng.normal(size=(k, 3))
    x = toxicity.Rows(rows, k)
    plain = lambda w0, w, v: np.array([w0 + sum(w[i] for i in r) + sum(v[i] @ v[j] for i in r for j in r if i < j) for r in rows])
    assert np.allclose(x.margins(w0, w, v)[0], plain(w0, w, v))
    assert np.allclose(toxicity.Machine(np.arange(k), w0, w, v).scores(rows), 1 / (1 + np.exp(-plain(w0, w, v))))

    def loss(w0, w, v):
        m = plain(w0, w, v)
        return (scale * (np.log1p(np.exp(m)) - y * m)).sum() + 0.05 * ((w**2).sum() + (v**2).sum())

    d0, dw, dv = toxicity.gradient(x, y, scale, w0, w, v, 0.1)
    e = 1e-5
    assert abs((loss(w0 + e, w, v) - loss(w0 - e, w, v)) / (2 * e) - d0) < 1e-6
    for i in range(k):
        up = np.eye(k)[i] * e
        assert abs((loss(w0, w + up, v) - loss(w0, w - up, v)) / (2 * e) - dw[i]) < 1e-6
        for f in range(3):
            step = np.outer(up, np.eye(3)[f])
            assert abs((loss(w0, w, v + step) - loss(w0, w, v - step)) / (2 * e) - dv[i, f]) < 1e-6


def test_one_document_teaches_for_a_label(spark, monkeypatch):
    d = spark.createDataFrame([(i % 3, f"text number {i} of many") for i in range(300)], "doc_id long, text string")
    lab = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels, kept, plainly=toxicity.fit: (seen.append(len(rows)), plainly(rows, labels, kept))[1])
    toxicity.learn(d, lab)
    assert seen == [3]


def test_all_telling_terms_are_kept(spark):
    telling = [f"{j:04d}q" for j in range(1500)]  # each also has its beginning of four characters, and that of five
    rows = [(i, " ".join(telling) if i % 2 else f"plain text {i}") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    machine = toxicity.learn(d, lab)
    kept = set(machine.kept.tolist())
    assert all(toxicity.bucket(t) in kept for w in telling for t in toxicity.word_terms(w.encode()))
    assert len(toxicity.learn(d, lab, terms=100).kept) == 100


# fingerprints


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, docs, none):
    both = fingerprint.edited_pairs(clashing(docs), scale=1)
    got = both.select("doc_id", "text", "edited", fingerprint.jaccard("sketch", "edited_sketch").alias("e"), fingerprint.jaccard("sketch", "next_sketch").alias("x"), fingerprint.as_text("sketch").alias("f")).collect()
    assert len(got) == docs.count()
    order = sorted({(i, t or "") for i, t, *_ in corpus()}, reverse=True)
    after = {a: b[1] for a, b in zip(order, order[1:] + order[:1])}
    by_text = {}
    for r in got:
        t, nxt = r.text, after[r.doc_id, r.text]
        h = len(t) // 2
        assert r.edited == t[: len(t) - h] + nxt[:h]
        for value, other in ((r.e, r.edited), (r.x, nxt)):
            a, b = shingles(t), shingles(other)
            assert abs(value - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
        assert by_text.setdefault(t, r.f) == r.f
    thin = fingerprint.with_sketch(docs, "text", "k", 8).select("text", F.size("k").alias("n")).collect()
    assert all((r.n == 0) == (not shingles(r.text)) for r in thin)
    long = [r.n for r in thin if r.text and len(r.text) > 100000][0]
    assert 0.8 < long * 8 / 29996 < 1.2
    assert fingerprint.edited_pairs(none).count() == 0


def test_sketches_at_the_kept_scale(spark):
    rng = random.Random(21)
    texts = [sentence(rng, n) for n in (0, 1, 4, 5, 5, 6, 7, 8, 9, 12, 30, 60, 300)] + ["\n", "a b c d e f"]
    last = -(1 << 63) + (1 << 64) // fingerprint.SCALE - 1
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    full = {r.i: set(r.s) for r in fingerprint.with_sketch(df, "t", "s", 1).collect()}
    sketch = lambda hashes: sorted(h for h in hashes if h <= last) or sorted(hashes)[:1]
    two = fingerprint.with_sketch(df, "t", "s").drop("t")
    assert {r.i: r.s for r in two.collect()} == {i: sketch(h) for i, h in full.items()}
    pairs = two.join(two.select(F.col("i").alias("j"), F.col("s").alias("u")))
    for r in pairs.select("i", "j", fingerprint.merged("s", "u").alias("m"), fingerprint.containment("s", "u").alias("c"), fingerprint.jaccard("s", "u").alias("x")).collect():
        a, b = set(sketch(full[r.i])), set(sketch(full[r.j]))
        assert r.m == sketch(full[r.i] | full[r.j])
        assert abs(r.x - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
        stands_in = bool(a) and min(a) > last
        assert r.c == (1.0 if not a else 0.0 if not b else None if stands_in and min(b) <= last else len(a & b) / len(a))


def test_fingerprint_query(spark, tmp_path):
    rows = [(i, t) for i, t, *_ in corpus()] + [(None, "no id at all in this row"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_fingerprints(spark, str(tmp_path)).collect()
    distinct = sorted({(i is not None, i or 0, t or "") for i, t in rows}, reverse=True)
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    after = {(x[1] if x[0] else None, x[2]): y[2] for x, y in zip(distinct, distinct[1:] + distinct[:1])}
    ids = Counter(x[:2] for x in distinct)
    for (i, t), n in Counter(rows).items():
        if ids[i is not None, i or 0] == 1:  # texts of one id stand in the order of their hash
            t = t or ""
            edited = (t[: len(t) - len(t) // 2] + after[i, t][: len(t) // 2]).encode()
            assert sum(r.doc_id == i and r.edited_sha256 == hashlib.sha256(edited).hexdigest() for r in got) == n or ids[max(0, 1), i] > 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = defaultdict(set)
    for r, in [(r,) for r in got]:
        same[r.doc_id].add(r.fingerprint)
    assert same[5] == same[6]


# decontamination


def brute_hits(text, items, window=10):
    w = words(text)
    hit, found = set(), set()
    for key, t in items:
        iw = words(t)
        n = min(window, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(key)
    return len(w), len(hit), found


def test_decontamination(spark, none):
    rng = random.Random(9)
    vocabulary = "a b c d".split()
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for k in range(12)] + [(50, None), (51, ""), (52, "one more item of exactly ten words here now yes"), (53, "short item"), (3, "short item")]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, "x SHORT, item y"), (102, "one more item of exactly ten words here now no"), (103, "pre one more item of exactly ten words here now yes post " * 3)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 20, 100):
        got = {r.doc_id: r for r in decontam.benchmark_hits(clashing(d), b, block_bytes=block_bytes).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            r = got[i]
            assert (r.n_words, sum(s.end - s.start for s in r.spans), set(r["items"])) == brute_hits(t, items)
    assert decontam.benchmark_hits(none, b).count() == 0
    assert decontam.benchmark_hits(d, b.limit(0)).filter("size(spans) > 0").count() == 0


def test_documents_are_named_for_their_blocks(spark, monkeypatch):
    """More blocks than tags have numbers: the hits are those of one block, and documents are read once."""
    monkeypatch.setattr(decontam, "MANY", 4)
    rng = random.Random(12)
    items = [(k, " ".join(f"v{rng.randint(0, 40)}" for _ in range(rng.randint(1, 25)))) for k in range(40)]
    rows = [(i, " ".join([sentence(rng, rng.randint(0, 30)), *(rng.choice(items)[1] for _ in range(i % 3)), sentence(rng, 5)])) for i in range(80)] + [(None, items[3][1]), (5, items[4][1])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    told = lambda n: sorted(map(str, decontam.benchmark_hits(d, b, block_bytes=n).collect()))
    assert told(1 << 20) == told(60)
    blocks = decontam.Blocks(b, "item_id", "text", 10, 60)
    assert blocks.n > 20
    tags, lengths = decontam.tag_table(blocks, spark.read.parquet(blocks.folder))
    for _, t in items:
        w = [x.encode() for x in words(t)]
        n = min(10, len(w))
        assert n in lengths and all(tags[decontam.window_hashes(w, n)[-1] % np.uint64(len(tags))])


def test_clean_documents_stay(spark):
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    passage = "One, two three four five six seven eight nine TEN eleven"
    long = "before " * 40 + passage + " after" * 40
    d = spark.createDataFrame([(1, "clean", "en", "s", 5), (2, passage, "en", "s", 1), (3, long, "en", "s", 1), (4, None, "en", "s", 0)], SCHEMA)
    got = {r.doc_id: r for r in decontam.without_hits(d, b).collect()}
    assert set(got) == {1, 3, 4} and got[1].text == "clean" and got[4].text is None
    assert passage not in got[3].text and got[3].text.startswith("before") and got[3].n_chars == len(got[3].text)


def test_blocks_change_no_row(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(6)]
    b = spark.createDataFrame(items, "item_id long, text string")
    own = " ".join(f"own{j}" for j in range(16))
    text = {1: f"{items[0][1]} {items[1][1]} {own}", 2: f"{own} {items[2][1]} {own}", 3: own, 4: None, 5: ""}  # 60 % hit, 27 % hit, clean
    for n, (a, c) in enumerate([(a, c) for a in range(6) for c in range(6) if a != c]):
        half = items[c][1].split()
        text[10 + n] = f"{own} {items[a][1]} {items[c][1]}"  # 60 %, by two items
        text[50 + n] = f"{own} {own} {' '.join(half[:6])} {items[a][1]} {' '.join(half[6:])}"  # a cut makes a window of another item
    rows = [(i, t, "en", "s", len(t or "")) for i, t in text.items()] + [(3, items[3][1], "en", "s", 1), (None, f"{own} {items[4][1]}", "en", "s", 1), (None, own, "en", "s", 1)]
    d = spark.createDataFrame([*rows, rows[1]], SCHEMA)
    one = sorted(map(tuple, decontam.without_hits(d, b).collect()), key=str)
    assert one == sorted(map(tuple, decontam.without_hits(d, b, block_bytes=100).collect()), key=str)
    kept = {r[0] for r in one}
    assert 1 not in kept and not any(10 + n in kept for n in range(30)) and all(50 + n in kept for n in range(30))
    assert sum(r[0] == 2 for r in one) == 2 and sum(r[0] is None for r in one) == 2 and sum(r[0] == 3 for r in one) == 1


# token files


def test_token_files(spark, docs, none, tmp_path):
    files = token_io.write_tokens(clashing(docs), str(tmp_path / "t"), TOKENIZER, 2, file_ids=3000)
    assert files.count() > 1
    rows = sorted(token_io.read_tokens(spark, files, with_ids=True).collect(), key=lambda r: r.doc_no)
    assert [r.id for r in rows] == sorted(i for i, *_ in corpus())
    told, at = defaultdict(Counter), 0
    for (i, *_), ids in zip(corpus(), reference_ids([r[1] for r in corpus()])):
        told[i][np.array([*ids, 2], "<u4").tobytes()] += 1
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        told[r.id][bytes(r.ids)] -= 1
        at += r.n_tokens
    assert not any(any(c.values()) for c in told.values())
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    back = token_io.read_tokens(spark, token_io.write_tokens(odd, str(tmp_path / "o"), TOKENIZER, 2)).collect()
    assert sorted((r.id is not None, r.n_tokens) for r in back) == [(False, 1), (False, 3), (True, 3)]
    assert token_io.read_tokens(spark, token_io.write_tokens(none, str(tmp_path / "n"), TOKENIZER, 2)).count() == 0


def test_token_codec_and_damage():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 400, 5000), rng.integers(0, 200_000, 70_000)]).astype(np.uint32)
    per = np.array([0, 5000, 1, 69_999])
    content = token_io.encoded(ids, per, np.array([1, 2, token_io.NULL, 4]))
    back, sizes, keys = token_io.decoded(content)
    assert (back == ids).all() and (sizes == per).all() and keys[2] == token_io.NULL
    assert token_io.decoded(token_io.encoded(ids[:0], per[:0], per[:0]))[0].size == 0
    for bad in (content[:-1], b"x" + content[1:], content[:99] + bytes([content[99] ^ 1]) + content[100:]):
        with pytest.raises(ValueError):
            token_io.decoded(bad)


# WARC


def test_warc(spark, tmp_path):
    pages = [(3, "http://a b/\r\n", "same"), (1, None, "same"), (2, "http://c", None), (9, "u", ""), (5, "http://é", "é" * 100_000), (6, "http://d", "only"), (3, "again", "same"), (None, "n", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("_id", F.lit(1)).withColumn("_first", F.lit(2)).repartition(3)
    files = warc.write_archives(df, str(tmp_path / "w"), file_bytes=1000)
    got = warc.read_archives(spark, files, with_payload=True).collect()
    low = {"same": 1, "": 2, "é" * 100_000: 5, "only": 6}
    told = Counter()
    for p, _, h in pages:
        body = (h or "").encode()
        first = low[h or ""]
        told[p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if p == first else "revisit", None if p == first else first] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == told
    assert {bytes(r.payload) for r in got if r.page_id == 5} == {("é" * 100_000).encode()}
    least = warc.read_archives(spark, warc.write_archives(df, str(tmp_path / "l"), least_bytes=5)).filter("record_type = 'revisit'")
    assert least.count() == 0
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), str(tmp_path / "n"))).count() == 0


def test_hot_keys_are_dealt_out(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 5 == 0 else f"k{i % 97}") for i in range(4000)], "i long, k string")
    right = left.filter("k is not null").groupBy("k").agg(F.min("i").alias("low"), F.count("*").alias("n"))
    both = common.joined_evenly(left, right, ["k"], "n", 4000)
    low = {r.k: r.low for r in right.collect()}
    assert {(r.i, r.k, r.low) for r in both.collect()} == {(r.i, r.k, low.get(r.k)) for r in left.collect()} and both.count() == 4000
    assert common.joined_evenly(left.limit(0), right, ["k"], "n", 0).count() == 0


def test_warc_damage():
    records = [warc.record(k, f"http://x/{k}", b"p%d" % k * 50, None if k else None) for k in range(30)]
    content = warc.archive(records)
    assert list(warc.frames(content)) == records
    with pytest.raises(ValueError):
        list(warc.frames(content[:-3]))
    with pytest.raises(ValueError):
        list(warc.frames(content[:9]))
    good = records[1]
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"p1p1", b"p2p1", 1), good.replace(b"WARC-Date", b"WARC-Dote"), good[:-1], good + b"x"):
        with pytest.raises(ValueError):
            warc.parsed(bad)
