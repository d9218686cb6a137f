"""License scan: fuzzy search for short license notices.

A notice of L characters that may differ by k edits is cut into k + 1 pieces. Whatever lies within k edits of the
notice holds one piece unchanged (pigeonhole), so the pieces' exact places are the only candidates. Around each, the
regex library's bounded-error matching finds the nearest stretch of whole words and counts its edits.

Some words tell one license from another (mit, the version, the number of clauses). They must stand unchanged in a match,
without further numbers; the edits are for the rest. Where matches overlap, one with fewer edits wins, of whatever notice;
exact places all stay.

Texts are read as words ([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased) joined by single spaces. A
null or empty text has no words and no spans. Rows are treated one by one, so repeated rows give repeated results;
other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutscape.llm.common import WORD_BYTES


@dataclass(frozen=True)
class Notice:
    """Words of a notice in lower case, its label, the most edits (characters) that a match may have, and the word that has none."""

    words: str
    label: str
    edits: int
    base: bool = False
    telling: str = ""


#: The phrases that must be found, with their labels.
BASE = (
    Notice("under the mit license", "mit", 3, True, "mit"),
    Notice("apache license version 2", "apache-2", 3, True, "2"),
    Notice("cc by nc", "cc-by-nc", 0, True),
)
#: Further notices.
MORE = (
    Notice("gnu general public license version 3", "gpl-3", 3, telling="3"),
    Notice("gnu general public license version 2", "gpl-2", 3, telling="2"),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("bsd 3 clause license", "bsd-3", 1, telling="3"),
    Notice("bsd 2 clause license", "bsd-2", 1, telling="2"),
    Notice("all rights reserved", "all-rights-reserved", 2),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 3),
    Notice("creative commons attribution sharealike", "cc-by-sa", 3),
    Notice("released into the public domain", "public-domain", 3),
)
NOTICES = BASE + MORE

SPANS = "array<struct<label:string,notice:string,base:boolean,word:bigint,n_words:int,edits:int,likeness:double,text:string>>"


class Finder:
    """One notice, compiled: its pieces with their offsets and the pattern that verifies a candidate."""

    def __init__(self, notice: Notice) -> None:
        self.notice, self.phrase = notice, notice.words.encode()
        n, k = len(self.phrase), notice.edits
        ends = [n * i // (k + 1) for i in range(k + 2)]
        self.seeds = [(self.phrase[a:b], a) for a, b in zip(ends, ends[1:])]
        self.exact = b" " + self.phrase + b" "
        parts = regex.split(rb"(?<= |^)" + regex.escape(notice.telling.encode()) + rb"(?= |$)", self.phrase) if notice.telling else [self.phrase]
        fuzzy = [rb"(?:" + regex.escape(p) + rb"){e<=%d}" % k if p else b"" for p in parts]
        told = rb"(?<= )" + regex.escape(notice.telling.encode()) + rb"(?= )"
        self.pattern = regex.compile(rb"(?b)(?<= )" + told.join(fuzzy) + rb"(?= )") if k else None
        self.numbers = self.numbers_of(self.phrase) if notice.telling else None

    @staticmethod
    def numbers_of(phrase: bytes) -> list[bytes]:
        return [w for w in phrase.split() if w.isdigit()]

    def found(self, line: bytes) -> set[tuple[int, int, int]]:
        """(edits, start, end) in a line that begins and ends with a space: every exact place, and the best stretch around each other seed."""
        n, k, found, tried = len(self.phrase), self.notice.edits, set(), set()
        for seed, offset in self.seeds:
            at = line.find(seed)
            while at >= 0:
                start = at - offset
                if start not in tried:
                    tried.add(start)
                    if start > 0 and line[start - 1 : start + n + 1] == self.exact:
                        found.add((0, start, start + n))
                    elif self.pattern:
                        m = self.pattern.search(line, max(0, start - k - 1), min(len(line), start + n + k + 1))
                        if m and sum(m.fuzzy_counts) <= k and self.numbers in (None, self.numbers_of(m[0])):
                            found.add((sum(m.fuzzy_counts), m.start(), m.end()))
                at = line.find(seed, at + 1)
        return found


def scan_text(text: bytes | None, finders: list[Finder]) -> tuple[int, list[dict]]:
    """Number of words, and the spans in the order of their place. The time grows with the text and its candidates."""
    words = (text or b"").translate(WORD_BYTES).split()
    line = b" " + b" ".join(words) + b" "
    matches = sorted((e, a, b, i) for i, f in enumerate(finders) for e, a, b in f.found(line))
    taken, kept = bytearray(len(line) if matches else 0), []
    for e, a, b, i in matches:
        if not e or 1 not in taken[a:b]:
            kept.append((a, finders[i].notice.words, b, e, i))
            taken[a:b] = b"\1" * (b - a)
    spans, at, word = [], 0, -1
    for a, said, b, e, i in sorted(kept):
        at, word = a, word + line.count(b" ", at, a)
        notice = finders[i].notice
        spans.append(
            {
                "label": notice.label, "notice": said, "base": notice.base and e == 0, "word": word, "n_words": line.count(b" ", a, b) + 1,
                "edits": e, "likeness": 1.0 - e / len(said.encode()), "text": line[a:b].decode(errors="replace"),
            }
        )
    return len(words), spans


def license_spans(docs: DataFrame, text: str = "text", id: str = "doc_id", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(id, n_words, spans) for every row; spans is an empty array where nothing is found."""
    kind = docs.schema[id].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finders = [Finder(n) for n in notices]
        for batch in batches:
            found = [scan_text(t, finders) for t in batch["_t"]]
            yield pd.DataFrame({id: batch["_id"], "n_words": [n for n, _ in found], "spans": [s for _, s in found]})

    narrow = docs.select(F.col(id).alias("_id"), F.col(text).cast("binary").alias("_t"))
    return narrow.mapInPandas(scan, f"`{id}` {kind}, n_words bigint, spans {SPANS}")


def license_report(spans: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts and labels of each row of license_spans()."""
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda s: s["label"]))), ",")
    places = F.transform(base, lambda s: s["word"])
    return spans.select(
        id,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["likeness"])), F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
