"""Sentence case with protected groups."""

from __future__ import annotations

import re
from functools import lru_cache

from .latex import Piece

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A word with its hyphens, digits and soft hyphens, as one.
COMPOUND = re.compile(r"[^\W_](?:[^\W_]|[-'’\u00ad](?=[^\W_]))*")
#: Words that stand in lower case in either style, so they say nothing of it.
SMALL = frozenset("a an the and or but nor for of on in to at by with from as into onto over under via per vs than that upon about between through during without within toward towards against among is it its".split())
#: A capital after one of these stays: a colon and white space, or a full stop after a digit.
RESTART = re.compile(r":\s|[0-9]\.\s")
LETTER = re.compile(r"[^\W\d_]")
SPAN = ('<span class="nocase">', "</span>")


def looks_sentence_cased(text: str) -> bool:
    """At least as many words in lower case as with a capital, articles, prepositions and the like aside."""
    starts = [w[0] for w in COMPOUND.findall(text) if w.lower() not in SMALL]
    return sum(c.islower() for c in starts) >= sum(c.isupper() for c in starts)


@lru_cache(1 << 14)
def cased(word: str, first: bool, after_colon: bool) -> str:
    if first:
        return word
    if word == "A":
        return "a"
    if after_colon or word == word.upper() or not word[0].isupper() or word[1:] != word[1:].lower():
        return word
    return word.lower()


def sentence_case(pieces: list[Piece], *, guess: bool = True, protection: str = "as-needed", quoted: bool = False) -> str:
    """The text of a title's pieces in sentence case; protected groups keep theirs and are marked as asked."""
    texts = [p for p in pieces if not p.tag]
    plain = "".join([p.text for p in texts])
    keep = guess and looks_sentence_cased(plain)
    # one string of all text, with what may change marked; tags are put back where they were
    free = bytearray().join([(b"\0" if p.group or p.macro else b"\1") * len(p.text) for p in texts])
    if quoted:
        for m in re.finditer(r"“[^”]*”?", plain):
            free[m.start() : m.end()] = bytes(m.end() - m.start())
    chars, last = list(plain), -1
    for m in () if keep else WORD.finditer(plain):
        start, end = m.span()
        if last >= 0 and (old := plain[start:end]) != (word := cased(old, False, False)) and free.find(0, start, end) < 0:
            if start - last > 1 and RESTART.search(plain, last, start):
                word = cased(old, False, True)
            chars[start] = word[: len(word) - (end - start - 1)]  # only the first letter changes, which may become two
        last = end
    whole = "".join(chars)
    chars = whole if len(whole) == len(plain) else chars
    out, at, i = [], 0, 0
    while i < len(pieces):
        p = pieces[i]
        if not (p.group or p.macro):
            if p.tag:
                out.append(p.text)
            else:
                out += chars[at : at + len(p.text)] if chars is not whole else (whole[at : at + len(p.text)],)
                at += len(p.text)
            i += 1
            continue
        if p.tag and not p.group:
            out.append(p.text)
            i += 1
            continue
        j = i
        while j < len(pieces) and (pieces[j].group, pieces[j].macro) == (p.group, p.macro):
            j += 1
        inside, text = [], ""
        for q in pieces[i:j]:
            if q.tag:
                inside.append(q.text)
            else:
                part = "".join(chars[at : at + len(q.text)])
                at += len(q.text)
                inside.append(part)
                text += part
        marked = "".join(inside)
        if text.strip() and (protection == "strict" or protection == "as-needed" and p.group and LETTER.search(text) and text == text.lower()):
            marked = marked.join(SPAN)
        out.append(marked)
        i = j
    return "".join(out)


def title_case_pieces(value: str) -> list[Piece]:
    return [Piece(value, 0)]


def to_sentence_case(title: str, *, guess: bool = True) -> str:
    """Sentence case of plain text."""
    return sentence_case(title_case_pieces(title), guess=guess, protection="off")
