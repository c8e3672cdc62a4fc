"""Person names and literal lists."""

from __future__ import annotations

import re

from .latex import closing, split_top, to_text

AND = re.compile(r"(?i)(?<=[ \t\r\n~])and(?=[ \t\r\n])")
COMMA, BLANK = re.compile(","), re.compile(r"[ \t\r\n~]+")
PERSON_KEYS = ("name", "firstName", "lastName", "prefix", "suffix", "initial")
KEYED = {"family": "lastName", "given": "firstName", "given-i": "initial", "prefix": "prefix", "suffix": "suffix"}


def split_list(value: str) -> list[str]:
    return [p.strip(" \t\r\n") for p in split_top(value, AND) if p.strip(" \t\r\n")]


def braced(value: str) -> bool:
    return value.startswith("{") and closing(value, 0) == len(value) - 1


def lower_start(word: str, unsupported: str) -> bool:
    letters = [c for c in to_text(word, unsupported) if c.isalpha()]
    return bool(letters) and letters[0].islower() and not word.startswith("{")


def person(raw: str, unsupported: str = "error", macro: bool = False) -> dict[str, str]:
    """One person: braced or macro names stay whole; key=value, `Last, First`, `Last, Suffix, First` and `First Last` are split."""
    text = lambda s: to_text(s, unsupported).strip()
    raw = raw.strip(" \t\r\n")
    if macro or braced(raw) and not raw.startswith("{\\"):
        return {"name": text(raw)}
    parts = [p.strip() for p in split_top(raw, COMMA)]
    if all(re.match(r"[a-z-]+\s*=", p) for p in parts) and parts[0].split("=")[0].strip() in KEYED:
        keyed = (p.split("=", 1) for p in parts)
        return {KEYED[k.strip()]: text(v) for k, v in keyed if k.strip() in KEYED}
    if len(parts) == 1:
        words = [w for w in split_top(raw, BLANK) if w]
        if len(words) == 1:
            return {"lastName": text(words[0])}
        cut = len(words) - 1
        while cut > 0 and lower_start(words[cut - 1], unsupported):
            cut -= 1
        out = {"firstName": text(" ".join(words[:cut])), "prefix": text(" ".join(words[cut:-1])), "lastName": text(words[-1])}
    else:
        words = [w for w in split_top(parts[0], BLANK) if w]
        cut = 0
        while cut < len(words) - 1 and lower_start(words[cut], unsupported):
            cut += 1
        last = parts[0] if not cut else " ".join(words[cut:])
        out = {"lastName": text(last), "prefix": text(" ".join(words[:cut])), "firstName": text(parts[-1] if len(parts) < 4 else ", ".join(parts[2:]))}
        if len(parts) > 2:
            out["suffix"] = text(parts[1])
    return {k: v for k, v in out.items() if v}


def literal_list(value: str, unsupported: str = "error") -> list[str]:
    return [x for x in (to_text(p, unsupported) for p in split_list(value)) if x]
