"""Tables as BibTeX text, in Spark: the inverse of a parse, so that queries run the real engine on real rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with their LaTeX form and what a decoder makes of it (base letter and combining mark).
ACCENTED = {c: (f"{{\\{mark}{base}}}", base + joined) for mark, joined, letters in (('"', "̈", "äa öo üu ÄA ÖO ÜU ëe"), ("'", "́", "ée áa óo úu ÉE ÁA"), ("`", "̀", "èe àa ùu ÈE ÀA"), ("^", "̂", "êe âa ôo ûu ÊE"), ("~", "̃", "ñn ÑN ãa")) for c, base in letters.split()} | {"\u00e7": ("{\\c c}", "c\u0327"), "\u00df": ("{\\ss}", "\u00df")}


def escaped(column: Column) -> Column:
    """Text as a braced value holds it: specials after a backslash, and {} inside what would join to a dash or quote."""
    out = F.regexp_replace(column, r"([\\{}~^])", "\u0001$1")
    for raw, to in (("\u0001\\", "\\textbackslash{}"), ("\u0001{", "\\{"), ("\u0001}", "\\}"), ("\u0001~", "\\textasciitilde{}"), ("\u0001^", "\\textasciicircum{}")):
        out = F.replace(out, F.lit(raw), F.lit(to))
    return F.regexp_replace(F.regexp_replace(out, r"([&%$#_])", r"\\$1"), r"([-'`?!])", "$1{}")


def accented(column: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1][0])), ACCENTED.items(), column)


def braced(column: Column) -> Column:
    return F.concat(F.lit("{"), column, F.lit("}"))


def entry(kind: str, key: Column, fields: dict[str, Column], *, round_brackets: bool = False, before: Column | None = None) -> Column:
    """One entry; a field's column is its value as written (braces and all)."""
    opened, closed = ("(", ")") if round_brackets else ("{", "}")
    parts = [x for name, value in fields.items() for x in (F.lit(f",\n  {name} = "), F.coalesce(value, F.lit("{}")))]
    whole = F.concat(F.lit(f"@{kind}{opened}"), key, *parts, F.lit(f"\n{closed}\n"))
    return F.concat(before, whole) if before is not None else whole


def documents(rows: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    return rows.select(doc_id.cast("string").alias("doc_id"), text.alias("text"))
