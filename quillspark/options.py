"""Options of a parse; frozen, so that what a task captures cannot change under it."""

from __future__ import annotations

from dataclasses import dataclass, replace

SENTENCE_CASE = ("on+guess", "on", "off")
PROTECTION = ("as-needed", "strict", "off")


@dataclass(frozen=True)
class Options:
    sentencecase: str = "on+guess"
    caseprotection: str = "as-needed"
    preservequoted: bool = False
    #: A LaTeX command that is not known: `error` makes the document fatal, `keep` leaves it, `drop` removes it.
    unsupported: str = "error"
    #: PERMISSIVE keeps what can be parsed and lists errors; FAILFAST raises on the first one.
    mode: str = "PERMISSIVE"
    #: Fields that an entry lacks come from the entry of its document that its crossref names.
    inherit: bool = False
    #: Only these fields are decoded; all where empty.
    fields: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for value, allowed in ((self.sentencecase, SENTENCE_CASE), (self.caseprotection, PROTECTION), (self.unsupported, ("error", "keep", "drop")), (self.mode, ("PERMISSIVE", "FAILFAST"))):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")

    @classmethod
    def merged(cls, options: dict | None = None, defaults: "Options | None" = None) -> "Options":
        """Defaults with the caller's options over them."""
        return replace(defaults or cls(), **(options or {}))


MATRIX = [Options(s, p, q) for s in SENTENCE_CASE for p in PROTECTION for q in (False, True)]
