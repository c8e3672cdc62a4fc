"""LaTeX to text and light HTML.

A value becomes a list of pieces. A piece is text or a tag, knows the brace group that protects it (0: none)
and whether an unresolved macro stands behind it; names, lists and casing work on pieces, so brace depth is found
once. A group protects unless it begins with a command or is a command's argument.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .grammar import GROUP

ACCENTS = {"`": "̀", "'": "́", "^": "̂", "~": "̃", "=": "̄", "u": "̆", ".": "̇", '"': "̈", "r": "̊", "ocirc": "̊", "H": "̋", "v": "̌", "d": "̣", "c": "̧", "k": "̨", "b": "̱", "t": "͡"}
SYMBOLS = {
    "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "dj": "đ", "DJ": "Đ", "ng": "ŋ", "NG": "Ŋ",
    "textbackslash": "\\", "backslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "textbar": "|", "textless": "<", "textgreater": ">", "textquotedbl": '"', "textquotesingle": "'", "textunderscore": "_", "textbraceleft": "{", "textbraceright": "}",
    "textendash": "–", "textemdash": "—", "textellipsis": "…", "dots": "…", "ldots": "…", "cdots": "⋯", "copyright": "©", "textcopyright": "©", "textregistered": "®", "texttrademark": "™", "pounds": "£", "textsterling": "£", "euro": "€", "texteuro": "€", "S": "§", "P": "¶", "dag": "†", "ddag": "‡", "textdegree": "°", "degree": "°", "textbullet": "•", "textquoteleft": "‘", "textquoteright": "’", "textquotedblleft": "“", "textquotedblright": "”", "guillemotleft": "«", "guillemotright": "»", "textexclamdown": "¡", "textquestiondown": "¿",
    "LaTeX": "LaTeX", "TeX": "TeX", "BibTeX": "BibTeX", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω", "times": "×", "pm": "±", "cdot": "·", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "infty": "∞", "sim": "∼", "approx": "≈", "rightarrow": "→", "to": "→", "leftarrow": "←", "langle": "⟨", "rangle": "⟩", "in": "∈", "subset": "⊂", "cup": "∪", "cap": "∩", "sum": "∑", "prod": "∏", "int": "∫", "sqrt": "√", "partial": "∂", "nabla": "∇", "forall": "∀", "exists": "∃", "star": "⋆", "ast": "∗", "circ": "∘", "odot": "⊙", "prime": "′", "ell": "ℓ", "hbar": "ħ", "Re": "ℜ", "mid": "∣",
}
IGNORED = frozenset("/ rm normalfont textnormal textrm mbox hbox selectlanguage bf newblock noopsort relax protect upshape mdseries sf textsf textup ensuremath mathrm mathit mathbf mathsf mathcal text left right displaystyle limits nolimits bibstring hskip vskip small footnotesize scriptsize tiny large Large @".split())
SPACES = {" ": " ", ",": " ", ";": " ", ":": " ", "!": "", "quad": " ", "qquad": " ", "space": " ", "\n": " ", "\t": " ", "enspace": " ", "thinspace": " ", "hspace": ""}
SWITCHES = {"em": "i", "it": "i", "sl": "i", "itshape": "i", "slshape": "i", "sc": "sc", "scshape": "sc", "tt": "code", "ttfamily": "code", "bfseries": "b"}
WRAPPERS = {"emph": "i", "textit": "i", "textsl": "i", "textbf": "b", "textsc": "sc", "texttt": "code", "textsubscript": "sub", "textsuperscript": "sup", "underline": "u", "mkbibemph": "i", "mkbibitalic": "i", "mkbibbold": "b"}
TAGS = {"i": ("<i>", "</i>"), "b": ("<b>", "</b>"), "u": ("<u>", "</u>"), "sc": ('<span style="font-variant:small-caps;">', "</span>"), "code": ("<code>", "</code>"), "sub": ("<sub>", "</sub>"), "sup": ("<sup>", "</sup>"), "quotation": ("<blockquote>", "</blockquote>"), "quote": ("<blockquote>", "</blockquote>"), "itemize": ("<ul>", "</ul>"), "enumerate": ("<ol>", "</ol>")}
LINE_END = re.compile(r"%[ \t]*\r?\n[ \t]*")
COMMAND = re.compile(r"[a-zA-Z]+\*?|.", re.S)
#: What text without a command may hold that still reads differently; runs of what never does; white space.
SPECIAL, PLAIN, BLANKS = re.compile(r"[\\{}$~]|--|``|''|[?!]`|%[ \t]*\r?\n"), re.compile(r"[^\\{}$~\-`'?!_^%]*"), re.compile(r"[\t\r\n][ \t\r\n]*| [ \t\r\n]+")
LIGATURES = {"---": "—", "--": "–", "``": "“", "''": "”", "?`": "¿", "!`": "¡"}
LIGATURE = re.compile("|".join(re.escape(x) for x in sorted(LIGATURES, key=len, reverse=True)))
#: What reads the same wherever it stands, then what may not: text of the former alone needs no pieces.
TOKEN = re.compile(
    r"\\[&%$#_{}]|\{\}|\{\\(?:[\"'`^~=.][A-Za-z]|c c|ss)\}|\\text(?:backslash|asciitilde|asciicircum)\{\}|\{(?![\s\\])|\}|~|" + LIGATURE.pattern + r"|(?P<other>\{[\s\\]|[\\$]|%[ \t]*\r?\n)"
)
MARKED = re.compile(r"[\\{}$~]|%[ \t]*\r?\n")
SWITCH, NO_BRACES = re.compile(r"\s*\\([a-zA-Z]+)(?![a-zA-Z])\s*"), re.compile(r"[\\{}]")


class Unsupported(ValueError):
    """A command that is not known."""


class Piece(NamedTuple):
    text: str
    group: int  # number of the outermost protecting group, 0 outside any
    tag: bool = False
    macro: bool = False


_ends: dict[str, re.Pattern] = {}


def closing(text: str, at: int, begin: str = "{", end: str = "}") -> int:
    """Where the group that begins at `at` ends; the end of the text if nothing closes it."""
    if begin == "{" and (whole := GROUP.match(text, at)):
        return whole.end() - 1
    pattern = _ends.get(begin + end) or _ends.setdefault(begin + end, re.compile(rf"\\.|[{re.escape(begin + end)}]", re.S))
    depth = 0
    for m in pattern.finditer(text, at):
        c = text[m.start()]
        if c == begin:
            depth += 1
        elif c == end:
            depth -= 1
            if not depth:
                return m.start()
    return len(text)


class Decoder:
    def __init__(self, unsupported: str = "error"):
        self.unsupported, self.runs, self.groups = unsupported, [], 0

    def emit(self, text: str, group: int, tag: bool = False) -> None:
        """Text of one group that follows on itself is one piece."""
        if text:
            if not tag and self.runs and self.runs[-1][1] == group and not self.runs[-1][2]:
                self.runs[-1][0].append(text)
            else:
                self.runs.append(([text], group, tag))

    def pieces(self) -> list[Piece]:
        return [Piece(parts[0] if len(parts) == 1 else "".join(parts), group, tag) for parts, group, tag in self.runs]

    def argument(self, s: str, at: int) -> tuple[str, int]:
        """The argument after a command: a group or one letter or command."""
        while at < len(s) and s[at].isspace():
            at += 1
        if at >= len(s):
            return "", at
        if s[at] == "{":
            end = closing(s, at)
            return s[at + 1 : end], end + 1
        if s[at] == "\\" and at + 1 < len(s):
            m = COMMAND.match(s, at + 1)
            return s[at : m.end()], m.end()
        return s[at], at + 1

    def plain(self, s: str) -> str:
        inner = Decoder(self.unsupported)
        inner.run(s, 0, False)
        return "".join(p.text for p in inner.pieces())

    def command(self, s: str, at: int, group: int, math: bool) -> int:
        m = COMMAND.match(s, at + 1)
        if not m:
            return at + 1
        name, at = m[0], m.end()
        if name[0].isalpha():
            while at < len(s) and s[at] in " \t\r\n":  # a word command takes the white space after it
                at += 1
        bare = name.rstrip("*")
        if name in ACCENTS and not (math and name in "=.'"):
            arg, at = self.argument(s, at)
            letter = self.plain(arg)
            self.emit(letter[:1] + ACCENTS[name] + letter[1:] if letter else "", group)
        elif name in "&%$#_{}" or name in "'\"<>|[]()":
            self.emit("" if name in "()[]" else name, group)
        elif name == "-":
            self.emit("\u00ad", group)
        elif name == "\\":
            self.emit(" " if not (s[at : at + 1] == "{") else "", group)
        elif name in SPACES:
            if name == "hspace":
                _, at = self.argument(s, at)
            self.emit(SPACES[name], group)
        elif bare in SYMBOLS:
            if s[at : at + 2] == "{}":
                at += 2
            self.emit(SYMBOLS[bare], group)
        elif bare in WRAPPERS:
            arg, at = self.argument(s, at)
            opened, closed = TAGS[WRAPPERS[bare]]
            self.emit(opened, group, True)
            self.run(arg, group, math)
            self.emit(closed, group, True)
        elif bare == "url":
            arg, at = self.argument(s, at)
            self.emit(f'<a href="{arg}">{arg}</a>', group, True)
        elif bare == "href":
            to, at = self.argument(s, at)
            arg, at = self.argument(s, at)
            self.emit(f'<a href="{to}">', group, True)
            self.groups += not group
            self.run(arg, group or self.groups, math)
            self.emit("</a>", group, True)
        elif bare in ("mkbibquote", "enquote"):
            arg, at = self.argument(s, at)
            self.emit("“", group)
            self.run(arg, group, math)
            self.emit("”", group)
        elif bare == "verb" and at < len(s):
            end = s.find(s[at], at + 1)
            end = len(s) if end < 0 else end
            self.emit(s[at + 1 : end], group)
            at = end + 1
        elif bare in ("begin", "end"):
            arg, at = self.argument(s, at)
            if arg in TAGS:
                self.emit(TAGS[arg][bare == "end"], group, True)
                while at < len(s) and s[at] in " \t\r\n":
                    at += 1
        elif bare in ("par", "item"):
            self.emit("<p>" if bare == "par" else "<li>", group, True)
        elif bare in ("section", "subsection", "cite", "citep", "citet", "ref", "label", "footnote"):
            arg, at = self.argument(s, at)
            opened = {"section": "h1", "subsection": "h2"}.get(bare)
            if opened:
                self.emit(f"<{opened}>", group, True)
            self.run(arg, group, math)
            if opened:
                self.emit(f"</{opened}>", group, True)
        elif bare in IGNORED:
            pass
        elif self.unsupported == "error":
            raise Unsupported(f"unsupported macro (\\{name})")
        elif self.unsupported == "keep":
            self.emit("\\" + name, group)
        return at

    def run(self, s: str, group: int, math: bool) -> None:
        at, n = 0, len(s)
        while at < n:
            if (end := PLAIN.match(s, at).end()) > at:
                self.emit(s[at:end], group)
                if (at := end) == n:
                    break
            c = s[at]
            if c == "\\":
                at = self.command(s, at, group, math)
            elif c == "{":
                end = closing(s, at)
                self.braces(s[at + 1 : end], group, math)
                at = end + 1
            elif c == "}":
                at += 1
            elif c == "$":
                double = s[at : at + 2] == "$$"
                end = s.find("$", at + 1 + double)
                if end < 0:
                    self.emit("$", group)
                    at += 1
                else:
                    self.groups += not group
                    self.run(s[at + 1 + double : end], group or self.groups, True)
                    at = end + 1 + double
            elif c == "%" and (m := LINE_END.match(s, at)):
                if self.runs and not self.runs[-1][2]:
                    self.runs[-1][0][:] = ["".join(self.runs[-1][0]).rstrip(" \t")]
                at = m.end()
            elif c == "~":
                self.emit(" ", group)
                at += 1
            elif math and c in "_^":
                arg, at = self.argument(s, at + 1)
                opened, closed = TAGS["sub" if c == "_" else "sup"]
                self.emit(opened, group, True)
                self.run(arg, group, math)
                self.emit(closed, group, True)
            else:
                m = LIGATURE.match(s, at) if c in "-`'?!" else None
                if m and not (math and c == "-"):
                    self.emit(LIGATURES[m[0]], group)
                    at = m.end()
                else:
                    end = PLAIN.match(s, at + 1).end()
                    self.emit(s[at:end], group)
                    at = end

    def braces(self, inner: str, group: int, math: bool) -> None:
        m = SWITCH.match(inner)
        if m and m[1] in SWITCHES:
            opened, closed = TAGS[SWITCHES[m[1]]]
            self.emit(opened, group, True)
            self.run(inner[m.end() :], group, math)
            self.emit(closed, group, True)
        elif inner.startswith("\\") and not inner.startswith(("\\&", "\\_", "\\%", "\\#", "\\$", "\\textbackslash", "\\backslash")):
            self.run(inner, group, math)
        elif inner:
            self.groups += not group
            self.run(inner, group or self.groups, math)


def decode(value: str, unsupported: str = "error") -> list[Piece]:
    if not SPECIAL.search(value):
        return [Piece(value, 0)] if value else []
    if not MARKED.search(value):  # dashes and quotes alone
        return [Piece(LIGATURE.sub(lambda m: LIGATURES[m[0]], value), 0)]
    decoder = Decoder(unsupported)
    decoder.run(value, 0, False)
    return decoder.pieces()


class Said(dict):
    """What a token reads as, decoded once."""

    def __missing__(self, token: str) -> str:
        if TOKEN.fullmatch(token)["other"]:
            raise KeyError(token)
        self[token] = said = "".join(p.text for p in decode(token))
        return said


SAID = Said()


def direct(value: str) -> str | None:
    """The decoded text where all that is special in it are tokens of their own, before white space is collapsed; else None."""
    try:
        return TOKEN.sub(lambda m: SAID[m[0]], value)
    except KeyError:
        return None


def collapse(pieces: list[Piece]) -> list[Piece]:
    """White space runs (space, tab, line ends) as one space over piece borders, none at the ends."""
    out: list[Piece] = []
    spaced = True
    for p in pieces:
        if p.tag:
            if p.text in ("</blockquote>",) and out and not out[-1].tag:
                out[-1] = out[-1]._replace(text=out[-1].text.rstrip(" "))
            out.append(p)
            spaced = p.text in ("<blockquote>", "</blockquote>", "<p>")
            continue
        text = BLANKS.sub(" ", p.text)
        if spaced and text.startswith(" "):
            text = text[1:]
        if text:
            out.append(p if text == p.text else Piece(text, p.group, False, p.macro))
            spaced = text.endswith(" ")
    for i in range(len(out) - 1, -1, -1):
        if out[i].tag:
            break
        text = out[i].text.rstrip(" ")
        if text != out[i].text:
            out[i] = out[i]._replace(text=text)
        if text:
            break
    return [p for p in out if p.text]


def to_text(value: str, unsupported: str = "error") -> str:
    if not SPECIAL.search(value):
        return BLANKS.sub(" ", value).strip(" ")
    if (text := direct(value)) is not None:
        return BLANKS.sub(" ", text).strip(" ")
    return "".join(p.text for p in collapse(decode(value, unsupported)))


def split_top(value: str, pattern: re.Pattern) -> list[str]:
    """Split where the pattern matches outside braces."""
    if not NO_BRACES.search(value):
        cuts = [0, *(x for m in pattern.finditer(value) for x in m.span()), len(value)]
        return [value[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    masked, depth, at = [], 0, 0
    while at < len(value):
        c = value[at]
        if c == "\\" and at + 1 < len(value):
            masked.append(value[at : at + 2] if not depth else "\0\0")
            at += 2
            continue
        depth += (c == "{") - (c == "}")
        masked.append(c if depth <= 0 and c != "}" else "\0")
        at += 1
    out, last = [], 0
    for m in pattern.finditer("".join(masked)):
        out.append(value[last : m.start()])
        last = m.end()
    return [*out, value[last:]]
