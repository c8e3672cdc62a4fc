"""Documents to typed records.

A macro's scope is its document, so a document is parsed where it lies: one narrow pass, no shuffle and no join.
The long table of fields is the canonical form; entries, strings and errors are views of the same record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import casing, grammar, latex, names
from ..functions.modes import BUILT_IN, MONTHS, mode_of
from ..options import Options
from ..schema import CHUNK, DOCUMENT, FIELD_ROW


STEP = 256
NONE: list[str] = []  # never added to


class Failed(ValueError):
    """An error of a document in FAILFAST mode."""


def resolve(parts: tuple, strings: dict[str, str], month: bool) -> tuple[list[tuple[str, bool]], list[str]]:
    """(text, is it an unresolved macro) of each part, and the unresolved names."""
    if len(parts) == 1 and parts[0][0] != "ref":
        return [(parts[0][1], False)], NONE
    out, missing = [], []
    for kind, text in parts:
        if kind != "ref":
            out.append((text, False))
        elif (found := strings.get(text.upper(), BUILT_IN.get(text.upper()))) is not None:
            out.append((found, False))
        elif text.lower() in MONTHS:
            out.append((MONTHS[text.lower()] if month else text, False))
        else:
            out.append((text, True))
            missing.append(text)
    return out, missing


def strip_redundant(value: str) -> str:
    """A value that is one brace group as a whole, without that pair."""
    trimmed = value.strip()
    return trimmed[1:-1] if names.braced(trimmed) and not trimmed.startswith("{\\") else value


def field_value(name: str, mode: str, parts: list[tuple[str, bool]], options: Options) -> tuple:
    """(value, list, people) by mode; all None when empty."""
    raw, policy = parts[0][0] if len(parts) == 1 else "".join(t for t, _ in parts), options.unsupported
    if mode == "verbatim":
        return raw.strip() or None, None, None
    if mode == "creatorlist":
        people = []
        for text, macro in [(raw, False)] if not any(m for _, m in parts) else parts:
            for one in [text] if macro else names.split_list(re.sub(r"^\s*and\s|\sand\s*$", " ", text)):
                people.append(names.person(one, policy, macro))
        return None, None, [p for p in people if p] or None
    if mode == "literallist":
        return None, names.literal_list(raw, policy) or None, None
    if mode == "title":
        pieces = []
        single = len(parts) == 1
        for n, (text, macro) in enumerate(parts):
            some = latex.decode(strip_redundant(text) if single else text, policy)
            pieces += [p._replace(group=p.group and p.group + 1000 * n, macro=macro) for p in some] if n or macro else some
        pieces = latex.collapse(pieces)
        text = "".join(p.text for p in pieces)
        if options.sentencecase != "off" and text:
            text = casing.sentence_case(pieces, guess=options.sentencecase == "on+guess", protection=options.caseprotection, quoted=options.preservequoted)
        return text or None, None, None
    text = latex.to_text(raw, policy)
    if name == "month":
        text = MONTHS.get(text.lower(), text)
    return text or None, None, None


class Field(NamedTuple):
    pos: int
    name: str
    mode: str
    value: str | None
    items: list[str] | None
    people: list[dict] | None


class Entry(NamedTuple):
    type: str
    key: str
    raw: str
    fields: dict[str, Field]


@dataclass
class Record:
    """What one document says."""

    comments: list[str] = field(default_factory=list)
    preamble: list[str] = field(default_factory=list)
    strings: dict[str, str] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)
    jabref: list[str] = field(default_factory=list)
    fatal: str | None = None
    entries: list[Entry] = field(default_factory=list)


def read(text: str, options: Options) -> Record:
    out, wanted = Record(), options.fields

    def fail(missing: list[str]) -> None:
        for name in missing:
            message = f'Unresolved @string reference "{name}"'
            if options.mode == "FAILFAST":
                raise Failed(message)
            out.errors.append((message, ""))

    for chunk in grammar.chunks(text):
        if chunk.kind == "comment":
            (out.jabref if chunk.raw.lstrip().startswith("jabref-") else out.comments).append(chunk.raw)
        elif chunk.kind == "preamble":
            out.preamble.append(chunk.raw)
        elif chunk.kind == "string":
            for name, parts in chunk.fields:
                found, missing = resolve(parts, out.strings, False)
                out.strings[name.upper()] = "".join(t for t, _ in found)
                fail(missing)
        else:
            fields: dict[str, Field] = {}
            for pos, (name, parts) in enumerate(chunk.fields):
                if wanted and name not in wanted and not (options.inherit and name == "crossref"):
                    continue
                mode = mode_of(name)
                found, missing = resolve(parts, out.strings, name == "month")
                if missing:
                    fail(missing)
                try:
                    value = field_value(name, mode, found, options)
                except latex.Unsupported as e:
                    if options.mode == "FAILFAST":
                        raise Failed(f"{e}\n{chunk.raw}") from e
                    out.fatal = out.fatal or f"{e}\n{chunk.raw}"
                    continue
                if value != (None, None, None):
                    fields[name] = Field(pos, name, mode, *value)
            out.entries.append(Entry(chunk.type, chunk.key, chunk.raw, fields))
    if out.fatal:  # the message stands for the whole document
        out.entries = []
    return with_inherited(out, options) if options.inherit else out


def with_inherited(record: Record, options: Options) -> Record:
    """Fields that an entry lacks, from the entry that its crossref names, and from that one's parent; the first of a key counts."""
    by_key: dict[str, Entry] = {}
    for e in record.entries:
        by_key.setdefault(e.key.lower(), e)

    def complete(e: Entry) -> Entry:
        fields, at, seen = dict(e.fields), e, {id(e)}
        if "crossref" not in e.fields:
            return e
        while (link := at.fields.get("crossref")) and link.value and (at := by_key.get(link.value.lower())) and id(at) not in seen:
            seen.add(id(at))
            for name, f in at.fields.items():
                if name != "crossref":
                    fields.setdefault(name, f)
        if options.fields and "crossref" not in options.fields:
            fields.pop("crossref", None)
        return e._replace(fields=fields)

    return replace(record, entries=[complete(e) for e in record.entries])


def parse_text(text: str, options: Options | None = None) -> dict:
    """The record of one document."""
    r = read(text, options or Options())
    people = lambda found: found and [{k: p.get(k) for k in names.PERSON_KEYS} for p in found]
    entries_ = [
        {"ord": n, "type": e.type, "key": e.key, "input": e.raw, "fields": [{"pos": f.pos, "name": f.name, "mode": f.mode, "value": f.value, "list": f.items, "people": people(f.people)} for f in e.fields.values()]}
        for n, e in enumerate(r.entries)
    ]
    return {"comments": r.comments, "preamble": r.preamble, "strings": r.strings, "errors": [{"error": e, "input": i} for e, i in r.errors], "jabref": r.jabref, "fatal": r.fatal, "entries": entries_}


def _mapped(docs: DataFrame, schema: str, rows_of: Callable[[str, str], Iterable[tuple]]) -> DataFrame:
    """rows_of(doc_id, text) of every document, as Arrow columns, about 4 MB of text at a time; of a batch read, STEP rows at a time are Python's."""
    target = to_arrow_schema(_parse_datatype_string(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held, size = [], 0
            for some in (whole.slice(at, STEP) for at in range(0, whole.num_rows, STEP)):
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    held += rows_of(doc_id, text or "")
                    size += len(text or "")
                    if size > 4 << 20:
                        if held:
                            yield batch(held)
                        held, size = [], 0
            if held:
                yield batch(held)
            del whole, held

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, schema)


def parse_bibtex(docs: DataFrame, options: Options | None = None, columns: Iterable[str] = (), **more) -> DataFrame:
    """One record per document (columns doc_id, text): comments, preamble, strings, errors, jabref, fatal, entries; or what `columns` names of them."""
    options, whole = Options.merged(more, options), _parse_datatype_string(DOCUMENT)
    asked = tuple(columns) or tuple(whole.names[1:])
    schema = StructType([whole[n] for n in ("doc_id", *asked)]).simpleString()
    if not {"entries", "errors", "fatal"} & {*asked} and options.mode == "PERMISSIVE":
        options = replace(options, fields=("",), inherit=False)  # fields say nothing of what is asked

    def rows(doc_id, text):
        if "entries" in asked:
            r = parse_text(text, options)
        else:
            r = vars(read(text, options))
            r["errors"] = [{"error": e, "input": i} for e, i in r["errors"]]
        return [(doc_id, *(list(r[c].items()) if c == "strings" else r[c] for c in asked))]

    return _mapped(docs, schema, rows)


def field_table(docs: DataFrame, options: Options | None = None, **more) -> DataFrame:
    """The canonical long form straight from the texts: one row per field of each entry, as `fields` has them."""
    options = Options.merged(more, options)

    def rows(doc_id, text):
        return [(doc_id, n, e.type, e.key, *f) for n, e in enumerate(read(text, options).entries) for f in e.fields.values()]

    return _mapped(docs, FIELD_ROW, rows)


def entry_values(docs: DataFrame, names_: Iterable[str], options: Options | None = None, **more) -> DataFrame:
    """One row per entry: doc_id, ord, type, key and a column for each named text field; no other field is decoded."""
    named = tuple(n.lower() for n in names_)
    options = replace(Options.merged(more, options), fields=named or ("",))

    def rows(doc_id, text):
        return [(doc_id, n, e.type, e.key, *(e.fields[k].value if k in e.fields else None for k in named)) for n, e in enumerate(read(text, options).entries)]

    return _mapped(docs, ", ".join(["doc_id string, ord int, type string, key string", *(f"`{n}` string" for n in named)]), rows)


def chunk_table(docs: DataFrame) -> DataFrame:
    """The grammar level alone: one row per chunk, with its raw fields."""

    def rows(doc_id, text):
        for i, c in enumerate(grammar.chunks(text)):
            raw_fields = [{"pos": p, "name": n, "parts": [{"kind": k, "text": t} for k, t in parts]} for p, (n, parts) in enumerate(c.fields)]
            yield doc_id, i, c.kind, c.type, c.key, c.raw, raw_fields

    return _mapped(docs, CHUNK, rows)


def entries(parsed: DataFrame) -> DataFrame:
    """One row per entry, with maps of text, list, name fields and modes."""
    e = parsed.select("doc_id", F.explode("entries").alias("e"))
    of = lambda column: F.map_from_entries(F.transform(F.filter("e.fields", lambda f: f[column].isNotNull()), lambda f: F.struct(f["name"], f[column])))
    return e.select("doc_id", "e.ord", "e.type", "e.key", "e.input", of("value").alias("text_fields"), of("list").alias("list_fields"), of("people").alias("name_fields"), of("mode").alias("mode"))


def fields(parsed: DataFrame) -> DataFrame:
    """One row per field of each entry: the canonical long form."""
    e = parsed.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.ord", "e.type", "e.key", F.explode("e.fields").alias("f"))
    return e.select("doc_id", "ord", "type", "key", "f.pos", "f.name", "f.mode", "f.value", "f.list", "f.people")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.posexplode("errors").alias("seq", "e")).select("doc_id", "seq", "e.error", "e.input")


def strings(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.explode("strings").alias("name", "value"))


def entries_as_json(parsed: DataFrame) -> DataFrame:
    """One JSON value per document, keys sorted at every depth; entries have maps of fields and modes, as goldens do."""
    sorted_map = lambda pairs: F.map_from_entries(F.array_sort(pairs))
    people = lambda f: F.to_json(F.transform(f["people"], lambda p: F.struct(*[p[k].alias(k) for k in sorted(names.PERSON_KEYS)])))
    said = lambda f: F.coalesce(f["value"], F.to_json(f["list"]), people(f))
    fields_ = lambda e: sorted_map(F.transform(e["fields"], lambda f: F.struct(f["name"], said(f))))
    modes = lambda e: sorted_map(F.transform(e["fields"], lambda f: F.struct(f["name"], f["mode"])))
    one = lambda e: F.struct(fields_(e).alias("fields"), e["input"].alias("input"), e["key"].alias("key"), modes(e).alias("mode"), e["type"].alias("type"))
    whole = F.struct("comments", F.transform("entries", one).alias("entries"), "errors", "fatal", "jabref", "preamble", sorted_map(F.map_entries("strings")).alias("strings"))
    return parsed.select(F.to_json(whole).alias("value"))


def pivot_fields(long: DataFrame, names_: list[str]) -> DataFrame:
    """One row per entry with a column per text field; the names are known, so no pass looks for them."""
    return long.groupBy("doc_id", "ord", "type", "key").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names_])
