"""Chat formatting by schema fingerprints, with DataFrame functions only.

A table's nested field paths are hashed; the hash selects a declarative mapping (SQL expressions) that turns its rows
into canonical turns: conv_id and an array of (role, text). The turns become one string with marks around each turn.

Template: an assistant's turn is `<s>text</s>` and carries the loss mask between its marks; any other turn is
`[INST] role` + newline + `text [/INST]`, the role in URL encoding. Inside texts every mark `<s>`, `</s>`, `[INST]`,
`[/INST]` gets U+E000 after its first character, one more where some stand there already, so no mark occurs inside a
text, and taking one out gives the text back.

Null texts and roles are empty strings. Turns are in the order of turn, role, text (null turns first); repeated rows
are repeated turns; rows without a conversation id form one conversation of null id. Columns besides those mapped are
not carried on, whatever their names. A conversation is one row of the output, so its turns meet in one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STUFFING = "\ue000"
#: A mark, with the stuffing that stands in it; and one with stuffing to be taken out.
MARKED = f"([<\\[])({STUFFING}*)(/?s>|/?INST\\])"
STUFFED = f"([<\\[]){STUFFING}({STUFFING}*)(/?s>|/?INST\\])"


def field_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths; [] stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return set().union(*(field_paths(f.dataType, f"{at}.{f.name.lower()}".lstrip(".")) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


_ONE = "named_struct('role', {role}, 'text', coalesce({text}, ''))"


def _turns(*pairs: tuple[str, str]) -> str:
    return "filter(array(" + ", ".join(_ONE.format(role=f"'{r}'", text=t) for r, t in pairs) + "), x -> x.text <> '' or x.role <> 'system')"


_ROLE = "case lower({0}) when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' else coalesce({0}, '') end"

#: Layouts: the paths that make one (besides conv_id), and the expression of its turns. `rows` is gathered by conversation first.
LAYOUTS: list[tuple[str, set[str], str]] = [
    ("rows", {"turn", "role", "text"}, ""),
    ("messages", {"messages[].role", "messages[].content"}, "transform(messages, m -> named_struct('role', " + _ROLE.format("m.role") + ", 'text', coalesce(m.content, '')))"),
    ("shares", {"conversations[].from", "conversations[].value"}, "transform(conversations, m -> named_struct('role', " + _ROLE.format("m.`from`") + ", 'text', coalesce(m.value, '')))"),
    ("instruction", {"instruction", "input", "output"}, _turns(("user", "concat_ws('\\n', instruction, nullif(input, ''))"), ("assistant", "output"))),
    ("instruction without input", {"instruction", "output"}, _turns(("user", "instruction"), ("assistant", "output"))),
    ("prompt", {"prompt", "response"}, _turns(("user", "prompt"), ("assistant", "response"))),
    ("prompt and completion", {"prompt", "completion"}, _turns(("user", "prompt"), ("assistant", "completion"))),
    ("system, prompt", {"system", "prompt", "response"}, _turns(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    ("question", {"question", "answer"}, _turns(("user", "question"), ("assistant", "answer"))),
]
MAPPINGS = {fingerprint(paths | {"conv_id"}): (name, turns) for name, paths, turns in LAYOUTS}


def canonical(df: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) of a table in any known layout; other top-level columns are ignored.

    The fingerprint of all paths is looked up; if it is unknown, that of the one layout whose paths are all there and
    that is no part of another such layout. Where several are, or none, it raises: no text is lost without a word.
    """
    paths = field_paths(df.schema)
    found = MAPPINGS.get(fingerprint(paths))
    if found is None:
        fits = [p | {"conv_id"} for _, p, _ in LAYOUTS if p | {"conv_id"} <= paths]
        fits = [p for p in fits if not any(p < other for other in fits)]
        if len(fits) != 1:
            raise ValueError(f"{'unknown' if not fits else 'ambiguous'} layout {fingerprint(paths)}: {sorted(paths)}")
        found = MAPPINGS[fingerprint(fits[0])]
    name, turns = found
    if name != "rows":
        return df.select("conv_id", F.expr(turns).alias("turns"))
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, f"$1{STUFFING}$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, STUFFED, "$1$2$3")


def formatted(turns: DataFrame) -> DataFrame:
    """canonical()'s rows as (conv_id, formatted)."""

    def one(t: Column) -> Column:
        asked = F.concat(F.lit("[INST] "), F.url_encode(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(" [/INST]"))
        return F.when(t["role"] == "assistant", F.concat(F.lit("<s>"), escaped(t["text"]), F.lit("</s>"))).otherwise(asked)

    return turns.select("conv_id", F.array_join(F.transform("turns", one), "").alias("formatted"))


def read_back(lines: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text, loss>>) from formatted()'s rows alone."""
    pieces = F.filter(F.split("formatted", r"(?<=</s>)|(?<= \[/INST\])", -1), lambda p: p != "")

    def one(p: Column) -> Column:
        line = F.instr(p, "\n")
        said = p.startswith("<s>")
        asked = p.substr(line + 1, F.length(p) - line - F.length(F.lit(" [/INST]")))
        return F.struct(
            F.when(said, "assistant").otherwise(F.url_decode(p.substr(F.lit(8), line - 8))).alias("role"),
            unescaped(F.when(said, p.substr(F.lit(4), F.length(p) - 7)).otherwise(asked)).alias("text"),
            said.alias("loss"),
        )

    return lines.select("conv_id", "formatted", F.transform(pieces, one).alias("turns"))


def digest(read: DataFrame) -> DataFrame:
    """Counts and checksums of read_back()'s rows."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
