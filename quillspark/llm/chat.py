"""Chat formatting: layouts told apart by the hash of their nested field paths, mapped declaratively to turns.

A record is any JSON-like value. Its fingerprint is a hash of the set of paths to its leaves (list positions
left out). Each known layout names the paths of its turns; the fingerprint of a record selects the layout, once
per distinct fingerprint and not once per record. Records of no known layout fail loudly.

The template writes `<|role|>` NEWLINE text `<|end|>` NEWLINE per turn. Inside texts `<`, any number n of
backslashes and `|` become the same with n + 1 backslashes, so control strings cannot occur in a text and the
step back is exact; in roles `%`, `|`, `<`, `>` and line ends are written as %XX. The loss mask is a list of code point spans, one per assistant text.

Null text is empty; null roles are empty; a row without a conv_id is a conversation of its own; turns are ordered by
turn, then role, then text, nulls first, so ties have an order; repeated rows are repeated turns. Texts may be of any
length. A conversation is formatted as a whole, as its template is one text. An empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
#: What foreign layouts call the roles; rows by turn (layout `turns`) keep theirs as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: name -> (paths that it needs, how it becomes turns). `each`: a list of messages with role and text fields;
#: `fields`: one turn per field, in order, where the field is there and not empty; `join` adds a second field.
LAYOUTS: dict[str, dict] = {
    "messages": {"each": "messages", "role": "role", "text": "content", "roles": ROLES},
    "turns": {"each": "turns", "role": "role", "text": "text", "roles": {}},
    "conversations": {"each": "conversations", "role": "from", "text": "value", "roles": ROLES},
    "instruction": {"fields": [("system", "system", None), ("user", "instruction", "input"), ("assistant", "output", None)]},
    "instruction_response": {"fields": [("system", "system", None), ("user", "instruction", "context"), ("assistant", "response", None)]},
    "prompt_completion": {"fields": [("user", "prompt", None), ("assistant", "completion", None)]},
    "prompt_response": {"fields": [("system", "system", None), ("user", "prompt", None), ("assistant", "response", None)]},
    "question": {"fields": [("user", "question", None), ("assistant", "answer", None)]},
}


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def paths(value: Any, at: str = "") -> set[str]:
    """Paths to the leaves of a nested value; an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}") for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(value: Any) -> str:
    return hashlib.sha256("\n".join(sorted(paths(value))).encode()).hexdigest()[:16]


def layout_of(found: set[str]) -> str:
    """The first layout all of whose needed paths are there."""
    for name, how in LAYOUTS.items():
        if "each" in how:
            need = {f".{how['each']}[].{how['role']}", f".{how['each']}[].{how['text']}"}
            if need <= found or f".{how['each']}" in found:
                return name
        elif {f".{f}" for r, f, _ in how["fields"] if r != "system"} <= found:
            return name
    raise ValueError(f"no layout has the paths {sorted(found)}")


class Canonical:
    """Turns of records, with the layout looked up by fingerprint."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def turns(self, record: dict) -> list[tuple[str, str]]:
        key = fingerprint(record)
        if key not in self.known:
            self.known[key] = layout_of(paths(record))
        how = LAYOUTS[self.known[key]]
        if "each" in how:
            return [(how["roles"].get(r := m.get(how["role"]) or "", r), m.get(how["text"]) or "") for m in record[how["each"]] or []]
        out = []
        for role, field, more in how["fields"]:
            if role != "system" or record.get(field):
                extra = record.get(more) if more else None
                out.append((role, (record.get(field) or "") + (f"\n\n{extra}" if extra else "")))
        return out


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (begin, end) of the text that counts for the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape_role(role)}|>\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}<|end|>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if formatted[at : at + 2] != "<|" or (close := formatted.find("|>\n", at)) < 0 or (end := formatted.find("<|end|>\n", close + 3)) < 0:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(formatted[at + 2 : close]), unescape(formatted[close + 3 : end])))
        at = end + 8
    return out


def escape_role(role: str) -> str:
    """Roles are free text too: what could end the tag is written as %XX."""
    return re.sub(r"[%|<>\n]", lambda m: f"%{ord(m[0]):02X}", role)


def unescape_role(role: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), role)


SCHEMA = "conv_id long, formatted string, spans array<struct<begin:long,end:long>>"


def format_records(records: DataFrame, *, id_column: str = "conv_id", json_column: str = "record") -> DataFrame:
    """Formatted text and loss spans of JSON records of any known layout: a narrow job."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        canon = Canonical()
        for key, record in rows:
            text, spans = render(canon.turns(json.loads(record)) if record else [])
            yield key, text, [{"begin": a, "end": b} for a, b in spans]

    return map_rows(records.select(F.col(id_column).cast("long").alias("conv_id"), json_column), run, SCHEMA)


def records_of_rows(rows: DataFrame) -> DataFrame:
    """Rows by turn as one JSON record (layout `turns`) per conversation: the only shuffle."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.col("conv_id").cast("long")
    # rows without an id have nothing in common
    alone = F.when(key.isNull(), F.monotonically_increasing_id())
    grouped = rows.select(key.alias("conv_id"), alone.alias("alone"), turn.alias("turn")).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.to_json(F.struct("turns")).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted output says: turns, their digest, and the text under the loss mask."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, text, spans in rows:
            turns = parse(text)
            loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
            yield key, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)

    return map_rows(formatted.select("conv_id", "formatted", "spans"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
