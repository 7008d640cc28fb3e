"""Chat formatting: schema fingerprints select how a record's layout becomes canonical turns.

A fingerprint is the hash of the sorted nested field paths of a record (or of a table's schema), of those that some
layout names. Each known layout is a declarative mapping from such paths to turns. A fingerprint selects the layout whose
paths are all there, the one with the most paths if several are (the earlier of equals); each new fingerprint is
resolved once and kept. So neither further fields nor fields of other layouts hide a layout. The turns are written in one template, with control strings inside texts escaped reversibly, next to the spans
of the assistant's texts, which are the loss mask.

Defined cases: null roles and texts are empty; turns with a null or equal number keep the order of number (null
first), role, text; a conversation with a null id is one conversation; a record that is no JSON object, or
of no known layout, is one user turn with the record's text, under the layout OTHER, so that it can be counted (layout_counts)
and isn't lost; a null record gives no turns and a null layout; an empty list of messages is a layout without turns;
texts that are lists of parts are their texts, one a line; an empty table gives no rows. Rows of one conversation meet in one task, in sorted order, as the output
is one string for each; the rows are streamed through, never held for more than one conversation.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Set
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """turns: (role, text path) for fixed turns. each: (list path, role field, text field). rows: (conversation, number, role, text) columns."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None

    def paths(self) -> frozenset[str]:
        if self.rows:
            return frozenset(self.rows)
        if self.each:
            at, role, text = self.each
            return frozenset([*(p for _, p in self.turns), f"{at}[].{role}", f"{at}[].{text}"])
        return frozenset(p for _, p in self.turns)


#: Known layouts.
LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", each=("messages", "role", "content")),
    Layout("messages of parts", each=("messages", "role", "content[].text")),
    Layout("system and messages", turns=(("system", "system"),), each=("messages", "role", "content")),
    Layout("system and messages of parts", turns=(("system", "system"),), each=("messages", "role", "content[].text")),
    Layout("from and value", each=("conversations", "from", "value")),
    Layout("system, from and value", turns=(("system", "system"),), each=("conversations", "from", "value")),
    Layout("prompt and completion", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", turns=(("user", "question"), ("assistant", "answer"))),
    Layout("system, question and answer", turns=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
    Layout("system, prompt and completion", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("system, prompt and response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction and output", turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction, input and output", turns=(("user", "instruction"), ("user+", "input"), ("assistant", "output"))),
    Layout("system, instruction and output", turns=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("system, instruction, input and output", turns=(("system", "system"), ("user", "instruction"), ("user+", "input"), ("assistant", "output"))),
    Layout("nested prompt", turns=(("user", "prompt.text"), ("assistant", "completion.text"))),
)
#: Names that layouts give to roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


NAMED = frozenset().union(*(x.paths() for x in LAYOUTS))
EMPTY = frozenset(p[: i + 2] for p in NAMED for i in range(len(p)) if p.startswith("[]", i))
#: The layout of records that no other fits; it has no mapping.
OTHER = "other"
#: Fingerprints met so far, and the layout that each selects.
BY_FINGERPRINT: dict[tuple[str, bool], Layout | None] = {}


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a parsed record or of a Spark schema; list levels end in []."""
    if isinstance(value, T.StructType):
        return set().union(*(field_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in value), set())
    if isinstance(value, T.ArrayType):
        return field_paths(value.elementType, f"{at}[]")
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()), set())
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def _holds(paths: Set[str], wanted: str) -> bool:
    """Whether the path is there, or an empty list on the way to it."""
    steps = [i for i in range(len(wanted)) if wanted.startswith("[]", i)]
    return wanted in paths or any(wanted[: i + 2] in paths for i in steps)


def layout_of(value, rows: bool = False) -> Layout | None:
    """The layout that the fingerprint of a record or schema selects, of those for tables of turn rows or of the others."""
    paths = {p for p in field_paths(value) if p in NAMED or p in EMPTY}
    key = fingerprint(paths), rows
    if key not in BY_FINGERPRINT:
        fit = [x for x in LAYOUTS if bool(x.rows) == rows and all(_holds(paths, p) for p in x.paths())]
        BY_FINGERPRINT[key] = max(fit, key=lambda x: len(x.paths()), default=None)
    return BY_FINGERPRINT[key]


def _at(record: dict, path: str) -> str:
    for k, step in enumerate(steps := path.split(".")):
        if step.endswith("[]"):
            parts = record.get(step[:-2]) if isinstance(record, dict) else None
            return "\n".join(_at(x, ".".join(steps[k + 1 :])) for x in parts or []) if isinstance(parts, list) else "" if parts is None else str(parts)
        record = record.get(step) if isinstance(record, dict) else None
    return "" if record is None else str(record)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """Canonical (role, text) turns. A role that ends in + continues the turn before it, unless it is empty."""
    out: list[tuple[str, str]] = []
    for role, path in layout.turns:
        text = _at(record, path)
        if not role.endswith("+"):
            out.append((role, text))
        elif text:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{text}")
    if layout.each:
        at, role, text = layout.each
        out += [(ROLES.get(r := _at(x, role), r), _at(x, text)) for x in record[at] or []]
    return out


def escape(text: str) -> str:
    """No result holds "<|": a backslash goes before the bar, after any that are there."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The formatted text, and the loss mask as a flat list of span starts and ends in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        parts += [head, body, f"{END}\n"]
        if role == "assistant":
            spans += [at + len(head), at + len(head) + len(body)]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that render wrote."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_turn_rows(rows: DataFrame) -> DataFrame:
    """conv_id, layout, formatted, loss_spans for a table with one row for each turn."""
    layout = layout_of(rows.schema, rows=True)
    if layout is None:
        raise ValueError(f"no layout of turn rows has the fields of {rows.columns}")
    store.ship(rows.sparkSession)
    names = ("conv", "number", "role", "text")
    df = rows.select(*(F.col(c).alias(n) for c, n in zip(layout.rows, names, strict=True)))
    df = df.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text")})
    df = df.repartition("conv").sortWithinPartitions(*names)
    schema = T.StructType([T.StructField("conv_id", df.schema["conv"].dataType), T.StructField("layout", T.StringType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.LongType()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns, done, kind, size = None, [], [], None, 0

        def out() -> pa.RecordBatch:
            ids, texts, spans = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([layout.name] * len(done), pa.string()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if turns and conv != held:
                    done.append((held, *render(turns)))
                    size += len(done[-1][1])
                    turns = []
                held = conv
                turns.append((role, text))
                if size > 4 << 20:
                    yield out()
                    done, size = [], 0
        if turns:
            done.append((held, *render(turns)))
        if done:
            yield out()

    return df.mapInArrow(write, schema)


def format_records(records: DataFrame, column: str = "record", key: str = "id") -> DataFrame:
    """key, layout, formatted, loss_spans for a table with a JSON record of any known layout in each row.

    Null records get a null layout and an empty text; other texts than JSON objects of a known layout are one user turn under the layout OTHER.
    """
    store.ship(records.sparkSession)
    df = records.select(F.col(key).alias("id"), F.col(column).alias("record"))
    schema = T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("layout", T.StringType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.LongType()))])

    def one(record: str | None) -> tuple[str | None, str, list[int]]:
        try:
            value = json.loads(record or "null")
        except ValueError:
            value = None
        layout = layout_of(value) if isinstance(value, dict) else None
        if layout is None:
            return (None, "", []) if record is None else (OTHER, *render([("user", record)]))
        return (layout.name, *render(turns_of(value, layout)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x) for x in batch.column(1).to_pylist()]
            names, texts, spans = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=schema.names)

    return df.mapInArrow(write, schema)


def layout_counts(formatted: DataFrame) -> DataFrame:
    """layout, n: how many records each layout was found for; null for null records."""
    return formatted.groupBy("layout").agg(F.count("*").alias("n"))


def digest(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What a reader finds in the output: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    store.ship(formatted.sparkSession)
    df = formatted.select(F.col(key).alias("key"), "formatted", "loss_spans")
    names = (key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (df.schema["key"].dataType, T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType())
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def one(text: str, spans: list[int]) -> tuple:
        turns = parse(text)
        loss = "".join(unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True))
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array(c) for c in zip(*found, strict=True)] if found else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return df.mapInArrow(read, schema)
