"""Documents to chunks: entries, macros, preambles and comments, with their raw fields."""

from __future__ import annotations

import re
from typing import NamedTuple

HEAD = re.compile(r"@[ \t]*([A-Za-z_][\w-]*)[ \t\r\n]*([{(])?")
NAME = re.compile(r"[^\s={}(),#\"]+")
SPACES, SPACES_COMMAS, KEY_END, LATER_ENTRY = re.compile(r"\s*"), re.compile(r"[\s,]*"), re.compile(r'[,={"]'), re.compile(r"\n[ \t]*@")
#: Where a scan has to look: what a backslash escapes is stepped over.
BRACES, QUOTES, ROUND, COMMAS = (re.compile(r"\\.|" + c, re.S) for c in ("[{}]", '[{}"]', '[{")]', "[{,]"))
COMMENT_LINES = re.compile(r"(?:[ \t]*\r?\n[ \t]*%[^\n]*)+")
#: A brace group of up to six levels in one match; deeper ones are counted.
LEVEL = r"\{(?:[^{}\\]++|\\.)*+\}"
for _ in range(5):
    LEVEL = r"\{(?:[^{}\\]++|\\.|" + LEVEL + r")*+\}"
GROUP = re.compile(LEVEL, re.S)
#: What most entries in braces consist of: a key, fields of one part each, the end. All else goes the long way.
KEY, BODY_END = re.compile(r"([^,={}\"\\]*+),"), re.compile(r"[\s,]*+\}")
FIELD = re.compile(r"[\s,]*+([^\s={}(),#\"\\]++)\s*+=\s*+(?:(" + LEVEL + r")|\"([^\"{}\\]*+)\"|([^\s={}(),#\"\\]++))\s*+(?=[,}])", re.S)


class Chunk(NamedTuple):
    kind: str  # entry, string, preamble, comment
    raw: str
    type: str = ""
    key: str = ""
    fields: tuple = ()  # (name, ((part kind, text), ...)) in order


def skip(s: str, at: int, end: int, pattern: re.Pattern = SPACES) -> int:
    return pattern.match(s, at, end).end() if at < end else at


def group_end(s: str, at: int, end: int) -> int:
    """Where the brace group that begins at `at` ends, or -1. Backslash-escaped braces do not count."""
    if whole := GROUP.match(s, at, end):
        return whole.end() - 1
    depth = 0
    for m in BRACES.finditer(s, at, end):
        c = s[m.start()]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return m.start()
    return -1


def quote_end(s: str, at: int, end: int) -> int:
    """Where the quoted string that begins at `at` ends, or -1; quotes inside braces or after a backslash are text."""
    depth = 0
    for m in QUOTES.finditer(s, at + 1, end):
        c = s[m.start()]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        elif c == '"' and depth <= 0:
            return m.start()
    return -1


def body_end(s: str, at: int, opened: str) -> int:
    """Where the entry's body that begins after `opened` ends, or -1."""
    end = len(s)
    if opened == "{":
        return group_end(s, at - 1, end)
    while m := ROUND.search(s, at, end):
        at, c = m.end(), s[m.start()]
        if c == ")":
            return m.start()
        if c == "{":
            at = group_end(s, m.start(), end) + 1
            if not at:
                return -1
        elif c == '"' and (q := quote_end(s, m.start(), end)) > 0:
            at = q + 1
    return -1


def value_parts(s: str, at: int, end: int) -> tuple[tuple[tuple[str, str], ...], int]:
    """Parts joined by # and where they end."""
    parts = []
    while True:
        at = skip(s, at, end)
        if at >= end:
            break
        c = s[at]
        if c == "{":
            to = group_end(s, at, end)
            to = end if to < 0 else to
            parts.append(("brace", s[at + 1 : to]))
            at = to + 1
        elif c == '"':
            to = quote_end(s, at, end)
            to = end if to < 0 else to
            parts.append(("quote", s[at + 1 : to]))
            at = to + 1
        elif m := NAME.match(s, at, end):
            parts.append(("number" if m[0].isdigit() else "ref", m[0]))
            at = m.end()
        else:
            break
        at = skip(s, at, end)
        if at < end and s[at] == "#":
            at += 1
            continue
        break
    return tuple(parts), at


def past_value(s: str, at: int, end: int) -> int:
    """The next comma outside groups, or the end; a backslash says nothing here."""
    while m := COMMAS.search(s, at, end):
        c = s[m.start()]
        if c == ",":
            return m.start()
        if c == "\\":
            at = m.start() + 1
            continue
        to = group_end(s, m.start(), end)
        at = (to if to > 0 else m.start()) + 1
    return end


def body_fields(s: str, at: int, end: int) -> tuple:
    out = []
    while (at := skip(s, at, end, SPACES_COMMAS)) < end:
        m = NAME.match(s, at, end)
        eq = skip(s, m.end(), end) if m else end
        if m and eq < end and s[eq] == "=":  # else not a field: go on after the next comma outside groups
            parts, at = value_parts(s, eq + 1, end)
            out.append((m[0].lower(), parts))
        at = past_value(s, at, end)
    return tuple(out)


def plain_body(s: str, at: int) -> tuple[str, tuple, int] | None:
    """Key, fields and end of a body in braces that has a key and only fields of one part; None for any other."""
    m = KEY.match(s, at)
    if not m:
        return None
    key, at, out = m[1].strip(), m.end() - 1, []
    while m := FIELD.match(s, at):
        name, group, quote, bare = m.groups()
        part = ("brace", group[1:-1]) if group is not None else ("quote", quote) if quote is not None else ("number" if bare.isdigit() else "ref", bare)
        out.append((name.lower(), (part,)))
        at = m.end()
    m = BODY_END.match(s, at)
    return (key, tuple(out), m.end() - 1) if m else None


def chunks(s: str) -> list[Chunk]:
    """All chunks of a document in order; text between them is skipped."""
    out, at = [], 0
    while m := HEAD.search(s, at):
        kind = m[1].lower()
        begin, opened = m.start(), m[2]
        if kind == "comment":
            if opened:
                end = body_end(s, m.end(), opened)
                end = len(s) if end < 0 else end
                out.append(Chunk("comment", s[m.end() : end]))
                at = end + 1
            else:
                end = s.find("\n", begin)
                end = len(s) if end < 0 else end
                out.append(Chunk("comment", s[m.end(1) : end].lstrip(" \t").rstrip("\r")))
                at = end
            continue
        if not opened:
            at = m.end(1)
            continue
        if opened == "{" and kind != "string" and kind != "preamble" and (plain := plain_body(s, m.end())):
            key, fields, end = plain
            raw, at = s[begin : end + 1], end + 1
            if tail := COMMENT_LINES.match(s, at):
                raw += tail[0]
                at = tail.end()
            out.append(Chunk("entry", raw, kind, key, fields))
            continue
        end = body_end(s, m.end(), opened)
        if end < 0:  # nothing closes it: it ends before the next line that begins with @, if there is one
            later = LATER_ENTRY.search(s, m.end())
            end = later.start() if later else len(s)
        raw = s[begin : end + 1]
        at = end + 1
        if kind == "string":
            out.append(Chunk("string", raw, fields=body_fields(s, m.end(), end)))
        elif kind == "preamble":
            out.append(Chunk("preamble", s[m.end() : end]))
        else:
            if tail := COMMENT_LINES.match(s, at):
                raw += tail[0]
                at = tail.end()
            mark = KEY_END.search(s, m.end(), end)
            comma = mark.start() if mark else end
            if comma < end and s[comma] == "=":
                key, rest = "", m.end()
            else:
                comma = comma if comma < end and s[comma] == "," else s.find(",", m.end(), end)
                comma = end if comma < 0 else comma
                key, rest = s[m.end() : comma].strip(), comma
            out.append(Chunk("entry", raw, kind, key, body_fields(s, rest, end)))
    return out
