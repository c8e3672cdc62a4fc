"""Every query of the bibliographic engine with the SQL it is held against.

Tables are rendered as BibTeX in Spark and parsed by the engine; the SQL takes what should come out from the
tables themselves, so a fault of the engine shows as a mismatch. All queries run over whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import abbrev, parse
from ..options import MATRIX, Options
from ..sources.files import read_ordered_csv, read_text, read_titles, sentence_cased, write_golden, write_ordered_csv
from ..sources.tables import dealt
from .render import ACCENTED, accented, braced, documents, entry, escaped
from .shared import folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
OFF = Options(sentencecase="off")
COLLAPSED = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(read(spark, sf_dir, name))


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def fields_of(docs: DataFrame, options: Options = OFF) -> DataFrame:
    return parse.field_table(docs, options)


def values(docs: DataFrame, names: dict[str, str], options: Options = OFF) -> DataFrame:
    """citekey, type and the named fields of each entry, which stand alone in their documents: no shuffle."""
    found = parse.entry_values(docs, names, options)
    return found.select(F.col("key").alias("citekey"), "type", *[F.col(n).alias(a) for n, a in names.items()])


PART_SQL = "SELECT 'p' || p_partkey::VARCHAR AS citekey, 'misc' AS type, trim(p_name) AS title, p_size::VARCHAR AS number FROM part"


def part_docs(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    text = entry("MISC", key("p", "p_partkey"), {"Title": braced(escaped(F.col("p_name"))), "number": F.col("p_size").cast("string")}, **how)
    return documents(table(spark, sf_dir, "part"), F.col("p_partkey"), text)


@query(PART_SQL)
def parse_part(spark, sf_dir):
    return values(part_docs(spark, sf_dir), {"title": "title", "number": "number"})


@query(PART_SQL)
def paren_entries(spark, sf_dir):
    return values(part_docs(spark, sf_dir, round_brackets=True), {"title": "title", "number": "number"})


@query("SELECT 'p' || p_partkey::VARCHAR AS citekey, 'misc' AS type, trim(p_name) || ' / ' || trim(p_brand) AS title, 'x' || p_size::VARCHAR AS number FROM part")
def quoted_values(spark, sf_dir):
    title = F.concat(F.lit('"'), escaped(F.col("p_name")), F.lit(' / " # "'), escaped(F.col("p_brand")), F.lit('"'))
    number = F.concat(F.lit("{x} # "), F.col("p_size").cast("string"))
    return values(documents(table(spark, sf_dir, "part"), F.col("p_partkey"), entry("misc", key("p", "p_partkey"), {"title": title, "number": number})), {"title": "title", "number": "number"})


@query(
    "SELECT p_partkey::VARCHAR AS doc_id, 'brand' AS name, 'literal' AS mode, p_brand AS value FROM part WHERE p_size % 3 <> 0"
    " UNION ALL SELECT p_partkey::VARCHAR, 'note', 'richtext', p_type FROM part UNION ALL SELECT p_partkey::VARCHAR, 'x-size+an', 'literal', p_size::VARCHAR FROM part WHERE p_size % 2 = 0"
)
def fields_long(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    fields = {"brand": braced(F.when(F.col("p_size") % 3 != 0, escaped(F.col("p_brand"))).otherwise("")), "NOTE": braced(escaped(F.col("p_type"))), "X-size+an": F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise('""')}
    return fields_of(documents(rows, F.col("p_partkey"), entry("misc", key("p", "p_partkey"), fields))).select("doc_id", "name", "mode", "value")


def nation_docs(spark: SparkSession, sf_dir: str, some: Column) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    macro = F.when(some, F.concat(F.lit("@String{Reg-"), F.col("n_regionkey").cast("string"), F.lit(" = {"), escaped(F.col("r_name")), F.lit("}}\n"))).otherwise("")
    place = F.concat(F.lit("{"), escaped(F.col("n_name")), F.lit(", } # REG-"), F.col("n_regionkey").cast("string"))
    return documents(joined, F.col("n_nationkey"), entry("misc", key("n", "n_nationkey"), {"place": place}, before=macro))


@query("SELECT 'n' || n_nationkey::VARCHAR AS citekey, n_name || ', ' || r_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def string_macros(spark, sf_dir):
    return values(nation_docs(spark, sf_dir, F.lit(True)), {"place": "place"}).drop("type")


@query("SELECT n_nationkey::VARCHAR AS doc_id, 'Unresolved @string reference \"REG-' || n_regionkey::VARCHAR || '\"' AS error, '' AS input FROM nation WHERE n_regionkey % 2 = 1")
def unresolved(spark, sf_dir):
    return parse.errors(parse.parse_bibtex(nation_docs(spark, sf_dir, F.col("n_regionkey") % 2 == 0), OFF)).select("doc_id", "error", "input")


@query("SELECT n_nationkey::VARCHAR AS doc_id, 'REG-' || n_regionkey::VARCHAR AS name, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def string_table(spark, sf_dir):
    return parse.strings(parse.parse_bibtex(nation_docs(spark, sf_dir, F.lit(True)), OFF))


@query("SELECT 'o' || o_orderkey::VARCHAR AS citekey, extract(month FROM o_orderdate)::VARCHAR AS month FROM orders")
def months(spark, sf_dir):
    date = F.col("o_orderdate")
    form = F.when(F.col("o_orderkey") % 3 == 0, F.lower(F.date_format(date, "MMM"))).when(F.col("o_orderkey") % 3 == 1, braced(F.date_format(date, "MMMM"))).otherwise(F.concat(F.lit('"'), F.upper(F.date_format(date, "MMM")), F.lit('"')))
    return values(documents(table(spark, sf_dir, "orders"), F.col("o_orderkey"), entry("article", key("o", "o_orderkey"), {"month": form})), {"month": "month"}).drop("type")


@query(
    "SELECT 'c' || c_custkey::VARCHAR AS citekey, 0 AS nth, 'Ann ' || c_mktsegment AS first_name, NULL::VARCHAR AS prefix, 'Cust' || c_custkey::VARCHAR AS last_name, NULL::VARCHAR AS suffix, NULL::VARCHAR AS literal FROM customer"
    " UNION ALL SELECT 'c' || c_custkey::VARCHAR, 1, 'Bo', 'van der', 'Nat' || c_nationkey::VARCHAR, NULL, NULL FROM customer"
    " UNION ALL SELECT 'c' || c_custkey::VARCHAR, 2, 'Cy', 'de', 'Key' || c_custkey::VARCHAR, 'Jr.', NULL FROM customer"
    " UNION ALL SELECT 'c' || c_custkey::VARCHAR, 3, NULL, NULL, NULL, NULL, c_mktsegment || ' and Sons' FROM customer"
    " UNION ALL SELECT 'c' || c_custkey::VARCHAR, 4, NULL, NULL, 'Solo' || c_custkey::VARCHAR, NULL, NULL FROM customer"
)
def authors(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    k, n, m = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    people = F.concat(F.lit("{Cust"), k, F.lit(", Ann "), m, F.lit(" and Bo van der Nat"), n, F.lit("\n and de Key"), k, F.lit(", Jr., Cy and {"), m, F.lit(" and Sons} and Solo"), k, F.lit("}"))
    long = fields_of(documents(rows, F.col("c_custkey"), entry("book", key("c", "c_custkey"), {"author": people})))
    p = long.select(F.col("key").alias("citekey"), F.posexplode("people").alias("nth", "p"))
    return p.select("citekey", "nth", F.col("p.firstName").alias("first_name"), F.col("p.prefix").alias("prefix"), F.col("p.lastName").alias("last_name"), F.col("p.suffix").alias("suffix"), F.col("p.name").alias("literal"))


@query(
    "SELECT s_suppkey::VARCHAR AS doc_id, 0 AS nth, 'House ' || s_suppkey::VARCHAR AS item FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 1, 'Nation ' || s_nationkey::VARCHAR FROM supplier"
    " UNION ALL SELECT s_suppkey::VARCHAR, 2, 'Left and Right' FROM supplier"
)
def publisher_list(spark, sf_dir):
    made = F.concat(F.lit("{House "), F.col("s_suppkey").cast("string"), F.lit(" and Nation "), F.col("s_nationkey").cast("string"), F.lit(" and {Left and Right}}"))
    long = fields_of(documents(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), entry("book", key("s", "s_suppkey"), {"publisher": made})))
    return long.select("doc_id", F.posexplode("list").alias("nth", "item"))


@query("SELECT 'l' || l_orderkey::VARCHAR || '.' || l_linenumber::VARCHAR AS citekey, l_partkey::VARCHAR || '–' || l_suppkey::VARCHAR AS pages FROM lineitem")
def pages_dash(spark, sf_dir):
    name = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    pages = F.concat(F.lit("{"), F.col("l_partkey").cast("string"), F.lit("--"), F.col("l_suppkey").cast("string"), F.lit("}"))
    return values(documents(table(spark, sf_dir, "lineitem"), name, entry("article", name, {"pages": pages})), {"pages": "pages"}).drop("type")


@query(f"SELECT doc_id::VARCHAR AS doc_id, {COLLAPSED.format('text')} AS value FROM documents WHERE {COLLAPSED.format('text')} <> ''")
def latex_escape(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return fields_of(documents(rows, F.col("doc_id"), entry("misc", key("d", "doc_id"), {"howpublished": braced(escaped(F.col("text")))}))).select("doc_id", "value")


@query("SELECT doc_id::VARCHAR AS doc_id, " + reduce(lambda s, kv: f"replace({s}, '{kv[0]}', '{kv[1][1]}')", ACCENTED.items(), COLLAPSED.format("text")) + f" AS value FROM documents WHERE {COLLAPSED.format('text')} <> ''")
def accents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return fields_of(documents(rows, F.col("doc_id"), entry("misc", key("d", "doc_id"), {"howpublished": braced(accented(escaped(F.col("text"))))}))).select("doc_id", "value")


@query("SELECT page_id::VARCHAR AS doc_id, url AS value FROM pages")
def verbatim_url(spark, sf_dir):
    return fields_of(documents(table(spark, sf_dir, "pages"), F.col("page_id"), entry("online", key("g", "page_id"), {"url": braced(F.col("url"))}))).select("doc_id", "value")


@query("SELECT page_id::VARCHAR AS doc_id, 'see <a href=\"' || url || '\">' || url || '</a> or <a href=\"' || url || '\">this <i>page</i></a>' AS value FROM pages")
def links(spark, sf_dir):
    note = F.concat(F.lit("{see \\url{"), F.col("url"), F.lit("} or \\href{"), F.col("url"), F.lit("}{this \\emph{page}}}"))
    return fields_of(documents(table(spark, sf_dir, "pages"), F.col("page_id"), entry("online", key("g", "page_id"), {"note": note}))).select("doc_id", "value")


def order_titles(spark: SparkSession, sf_dir: str, title: Column, options: Options) -> DataFrame:
    k = F.col("o_orderkey")
    docs = documents(table(spark, sf_dir, "orders"), k, entry("article", k.cast("string"), {"title": title}))
    return parse.entry_values(docs, ("title",), options).select("doc_id", "title")


@query(
    "SELECT o_orderkey::VARCHAR AS doc_id, 'Report on priority ' || lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) || ': The status of NASA order ' || o_orderkey::VARCHAR || ' – a ' || 'follow-up by <i>kept</i> Iota' AS title FROM orders"
)
def sentence_case(spark, sf_dir):
    word = F.initcap(F.regexp_replace("o_orderpriority", "[^A-Za-z]", ""))
    title = F.concat(F.lit("{Report on Priority "), word, F.lit(": The Status of NASA Order "), F.col("o_orderkey").cast("string"), F.lit(" -- A Follow-Up by {\\em Kept} {Iota}}"))
    return order_titles(spark, sf_dir, title, Options(sentencecase="on"))


@query(
    "SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Measured values from the Berlin order ' ELSE 'Measured values from the berlin order ' END || o_orderkey::VARCHAR AS title FROM orders"
)
def guess_case(spark, sf_dir):
    title = F.when(F.col("o_orderkey") % 2 == 0, "{Measured values from the Berlin order ").otherwise("{Measured Values from the Berlin Order ")
    return order_titles(spark, sf_dir, F.concat(title, F.col("o_orderkey").cast("string"), F.lit("}")), Options())


def protection_sql(n: str) -> str:
    span = lambda x: f"<span class=\"nocase\">{x}</span>"
    rows = [
        ("strict", f"'Study of {span('Gamma')} and {span('iota')} in set ' || {n}"),
        ("as-needed", f"'Study of Gamma and {span('iota')} in set ' || {n}"),
        ("off", f"'Study of Gamma and iota in set ' || {n}"),
    ]
    return " UNION ALL ".join(f"SELECT s_suppkey::VARCHAR AS citekey, '{k}' AS protection, {v} AS title FROM supplier" for k, v in rows)


@query(protection_sql("s_suppkey::VARCHAR"))
def case_protection(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    title = F.concat(F.lit("{Study of {Gamma} and {iota} in Set "), F.col("s_suppkey").cast("string"), F.lit("}"))
    docs = documents(rows, F.col("s_suppkey"), entry("article", F.col("s_suppkey").cast("string"), {"title": title}))
    each = [values(docs, {"title": "title"}, Options(sentencecase="on", caseprotection=p)).select("citekey", F.lit(p).alias("protection"), "title") for p in ("strict", "as-needed", "off")]
    return reduce(DataFrame.unionByName, each)


@query(
    "SELECT s_suppkey::VARCHAR AS citekey, FALSE AS preserve, 'On “quoted words” of ' || s_suppkey::VARCHAR AS title FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, TRUE, 'On “Quoted Words” of ' || s_suppkey::VARCHAR FROM supplier"
)
def preserve_quoted(spark, sf_dir):
    title = F.concat(F.lit("{On ``Quoted Words'' of "), F.col("s_suppkey").cast("string"), F.lit("}"))
    docs = documents(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), entry("article", F.col("s_suppkey").cast("string"), {"title": title}))
    each = [values(docs, {"title": "title"}, Options(sentencecase="on", preservequoted=p)).select("citekey", F.lit(p).alias("preserve"), "title") for p in (False, True)]
    return reduce(DataFrame.unionByName, each)


@query("SELECT p_partkey AS id, 'The item ' || p_size::VARCHAR || ' of USA: New parts' AS title FROM part")
def title_function(spark, sf_dir):
    title = F.concat(F.lit("The Item "), F.col("p_size").cast("string"), F.lit(" of USA: New Parts"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), sentence_cased(title, guess=False).alias("title"))


def mixed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    k, status = F.col("o_orderkey").cast("string"), F.lower("o_orderstatus")
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.concat(F.lit("@comment about "), k, F.lit("\n@Comment{\nsome {more} }\n@preamble{ \"\\\\def\\\\x{"), k, F.lit("}\" }\n@TYPE_"), status, F.lit("{ k:"), k, F.lit(" , year = 1990, ,\n total = {"), total, F.lit("},,}\n% tail\n"))
    return documents(rows, F.col("o_orderkey"), text)


@query(
    "SELECT o_orderkey::VARCHAR AS doc_id, 0 AS ord, 'comment' AS kind, '' AS key FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 1, 'comment', '' FROM orders"
    " UNION ALL SELECT o_orderkey::VARCHAR, 2, 'preamble', '' FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 3, 'entry', 'k:' || o_orderkey::VARCHAR FROM orders"
)
def chunk_kinds(spark, sf_dir):
    return parse.chunk_table(mixed_docs(spark, sf_dir)).select("doc_id", "ord", "kind", "key")


@query("SELECT o_orderkey::VARCHAR AS doc_id, 'about ' || o_orderkey::VARCHAR AS line, ' \"\\\\def\\\\x{' || o_orderkey::VARCHAR || '}\" ' AS preamble FROM orders")
def comments_preambles(spark, sf_dir):
    return parse.parse_bibtex(mixed_docs(spark, sf_dir), OFF, ("comments", "preamble")).select("doc_id", F.element_at("comments", 1).alias("line"), F.element_at("preamble", 1).alias("preamble"))


@query("SELECT 'type_' || lower(o_orderstatus) AS type, count(*) AS n FROM orders GROUP BY 1")
def type_counts(spark, sf_dir):
    return parse.entry_values(mixed_docs(spark, sf_dir), ()).groupBy("type").agg(F.count("*").alias("n"))


@query(
    "SELECT 'brand' AS name, count(*) AS n, count(DISTINCT p_brand) AS n_values FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT 'note', count(*), count(DISTINCT p_type) FROM part"
    " UNION ALL SELECT 'x-size+an', count(*), count(DISTINCT p_size) FROM part WHERE p_size % 2 = 0"
)
def field_freq(spark, sf_dir):
    return fields_long(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query(
    "WITH r AS (SELECT p_type AS abbr, p_name || '.' AS whole, 't' || (p_size % 3)::VARCHAR AS src, (p_size % 3) * 1000000000 + p_partkey AS o FROM part WHERE p_size % 7 <> 0 AND p_brand <> 'Brand#11'),"
    " g AS (SELECT abbr, arg_max(whole, o) AS w, arg_max(src, o) AS s, min(o) AS first FROM r GROUP BY abbr) SELECT abbr, w AS \"full\", s AS source, first // 1000000000 AS load_ord, first % 1000000000 AS row_ord FROM g"
)
def abbrev_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") % 7 != 0, F.concat("p_name", F.lit("."))).otherwise("").alias("full"),
        F.when(F.col("p_brand") == "Brand#11", F.concat(F.lit("#"), "p_type")).otherwise(F.col("p_type")).alias("abbr"),
        F.concat(F.lit("t"), (F.col("p_size") % 3).cast("string")).alias("source"), (F.col("p_size") % 3).alias("load_ord"), F.col("p_partkey").alias("row_ord"),
    )
    return abbrev.merge(rows).select("abbr", "full", "source", F.col("pos.load_ord").cast("long").alias("load_ord"), F.col("pos.row_ord").cast("long").alias("row_ord"))


@query(
    "SELECT 'J. Res. ' || n_name || '.' AS abbr, n_name AS full, 'unabbr-amendments.csv' AS source FROM nation UNION ALL SELECT 'J Res ' || n_name, n_name, 'unabbr-amendments.csv' FROM nation"
    " UNION ALL SELECT 'B. ' || r_name, r_name, 'base.csv' FROM region"
)
def abbrev_amendments(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = nation.select(F.col("n_name").alias("full"), F.concat(F.lit("J. Res. "), "n_name", F.lit(".")).alias("abbr"), F.lit("unabbr-amendments.csv").alias("source"), F.lit(1).alias("load_ord"), F.col("n_nationkey").cast("long").alias("row_ord"))
    b = region.select(F.col("r_name").alias("full"), F.concat(F.lit("B. "), "r_name").alias("abbr"), F.lit("base.csv").alias("source"), F.lit(0).alias("load_ord"), F.col("r_regionkey").cast("long").alias("row_ord"))
    return abbrev.merge(a.unionByName(b)).select("abbr", "full", "source")


@query(
    "SELECT 'o' || o_orderkey::VARCHAR AS citekey, 'note' AS name, c_mktsegment AS value FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'o' || o_orderkey::VARCHAR, 'year', o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey"
)
def crossref_lookup(spark, sf_dir):
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    rows = dealt(orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "o_custkey", "o_orderstatus", "c_mktsegment"), orders)
    parent = entry("book", key("C", "o_custkey"), {"note": braced(F.col("c_mktsegment")), "year": F.lit("{9}")})
    text = F.concat(entry("inbook", key("o", "o_orderkey"), {"crossref": braced(key("c", "o_custkey")), "year": braced(F.col("o_orderstatus"))}), parent)
    long = fields_of(documents(rows, F.col("o_orderkey"), text), Options(sentencecase="off", inherit=True))
    return long.where("type = 'inbook' AND name <> 'crossref'").select(F.col("key").alias("citekey"), "name", "value")


@query("SELECT s_suppkey::VARCHAR AS doc_id, 'unsupported macro (\\nosuch)' AS fatal FROM supplier WHERE s_nationkey % 2 = 0")
def fatal_documents(spark, sf_dir):
    note = F.when(F.col("s_nationkey") % 2 == 0, "{a \\nosuch b}").otherwise("{fine}")
    docs = documents(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), entry("misc", key("s", "s_suppkey"), {"note": note}))
    return parse.parse_bibtex(docs, OFF).where("fatal is not null").select("doc_id", F.substring_index("fatal", "\n", 1).alias("fatal"))


def supplier_docs(spark: SparkSession, sf_dir: str, fields: dict[str, Column], kind: str = "misc") -> DataFrame:
    return documents(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), entry(kind, key("s", "s_suppkey"), fields))


def text_of(n: str, *parts: str) -> Column:
    """Text around a number, as a braced value."""
    return F.concat(F.lit("{" + parts[0]), F.col(n).cast("string"), F.lit((parts[1] if len(parts) > 1 else "") + "}"))


@query("SELECT p_partkey::VARCHAR AS doc_id, '' AS citekey, trim(p_name) AS title, p_size::VARCHAR AS number FROM part UNION ALL SELECT p_partkey::VARCHAR, '', NULL, NULL FROM part WHERE p_size % 2 = 0")
def missing_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    text = F.concat(F.lit("@misc{title = {"), escaped(F.col("p_name")), F.lit("}, number="), F.col("p_size").cast("string"), F.lit("}\n"), F.when(F.col("p_size") % 2 == 0, "@foo{}\n").otherwise(""))
    return parse.entry_values(documents(rows, F.col("p_partkey"), text), ("title", "number"), OFF).select("doc_id", F.col("key").alias("citekey"), "title", "number")


@query("SELECT p_partkey::VARCHAR AS doc_id, '@misc{p' || p_partkey::VARCHAR || ',' || chr(10) || '  number = ' || p_size::VARCHAR || chr(10) || '}' AS input FROM part")
def raw_input(spark, sf_dir):
    docs = documents(table(spark, sf_dir, "part"), F.col("p_partkey"), F.concat(F.lit("text before\n"), entry("misc", key("p", "p_partkey"), {"number": F.col("p_size").cast("string")}), F.lit("and after")))
    return parse.parse_bibtex(docs, OFF).select("doc_id", F.explode("entries.input").alias("input"))


@query("SELECT 's' || s_suppkey::VARCHAR AS citekey, 'No.' || chr(160) || s_suppkey::VARCHAR || chr(160) || 'of' || chr(160) || 'all' AS place FROM supplier")
def ties(spark, sf_dir):
    return values(supplier_docs(spark, sf_dir, {"place": text_of("s_suppkey", "No.~", "~of~all")}), {"place": "place"}, OFF).drop("type")


@query(
    "SELECT 's' || s_suppkey::VARCHAR AS citekey, '<span style=\"font-variant:small-caps;\">Caps ' || s_suppkey::VARCHAR || '</span> and <code>type ' || s_suppkey::VARCHAR || '</code>' AS caps, 'shelf ful ' || s_suppkey::VARCHAR || ' roman' AS plain FROM supplier"
)
def small_caps_code_ignored(spark, sf_dir):
    n = F.col("s_suppkey").cast("string")
    caps = F.concat(F.lit("{{\\sc Caps "), n, F.lit("} and {\\tt type "), n, F.lit("}}"))
    return values(supplier_docs(spark, sf_dir, {"caps": caps, "plain": F.concat(F.lit("{shelf\\/ ful "), n, F.lit(" {\\rm roman}}"))}), {"caps": "caps", "plain": "plain"}, OFF).drop("type")


@query("SELECT s_suppkey::VARCHAR AS doc_id, 'one<p>two<blockquote>said ' || s_suppkey::VARCHAR || '</blockquote>' AS note, 'set \\ ' || s_suppkey::VARCHAR || ' of <span class=\"nocase\">x<sub>k</sub></span>' AS title FROM supplier")
def blocks_and_math(spark, sf_dir):
    n = F.col("s_suppkey").cast("string")
    note = F.concat(F.lit("{one\\par two\\begin{quotation}said "), n, F.lit("\\end{quotation}}"))
    docs = supplier_docs(spark, sf_dir, {"note": note, "title": F.concat(F.lit("{set $\\backslash$ "), n, F.lit(" of $x_k$}"))})
    return parse.entry_values(docs, ("note", "title"), Options(sentencecase="on")).select("doc_id", "note", "title")


@query(
    "SELECT s_suppkey::VARCHAR AS doc_id, 'Cust' || s_nationkey::VARCHAR AS last_name, 'jo ann' AS first_name, 'J' AS initial, 'von' AS prefix FROM supplier"
    " UNION ALL SELECT s_suppkey::VARCHAR, 'McDONALD', 'dwayne', NULL, NULL FROM supplier"
)
def keyed_names(spark, sf_dir):
    people = text_of("s_nationkey", "family=Cust", ", given=jo ann, given-i={J}, prefix=von and McDONALD, dwayne")
    long = fields_of(supplier_docs(spark, sf_dir, {"author": people}), Options(sentencecase="on"))
    return long.select("doc_id", F.explode("people").alias("p")).select("doc_id", F.col("p.lastName").alias("last_name"), F.col("p.firstName").alias("first_name"), F.col("p.initial").alias("initial"), F.col("p.prefix").alias("prefix"))


@query("SELECT s_suppkey::VARCHAR AS doc_id, 'The old vs. new way ' || s_suppkey::VARCHAR AS title, 'The concepts of risk ' || s_suppkey::VARCHAR AS booktitle FROM supplier")
def abbreviations_and_double_braces(spark, sf_dir):
    docs = supplier_docs(spark, sf_dir, {"title": text_of("s_suppkey", "The Old vs. New Way "), "booktitle": braced(text_of("s_suppkey", "The Concepts of Risk "))})
    return parse.entry_values(docs, ("title", "booktitle"), Options(sentencecase="on")).select("doc_id", "title", "booktitle")


@query("SELECT 'p' || p_partkey::VARCHAR AS citekey, p_size::VARCHAR AS number FROM part")
def fail_fast(spark, sf_dir):
    return values(part_docs(spark, sf_dir), {"number": "number"}, Options(sentencecase="off", mode="FAILFAST")).drop("type")


def matrix_sql() -> str:
    span = lambda x: f"<span class=\"nocase\">{x}</span>"
    rows = []
    for o in MATRIX:
        iota, gamma = (span("iota") if o.caseprotection != "off" else "iota"), (span("Gamma") if o.caseprotection == "strict" else "Gamma")
        title = f"The {iota} and {gamma} of {'“Some Words”' if o.preservequoted else '“some words”'} in set" if o.sentencecase != "off" else "The iota and Gamma of “Some Words” in Set"
        rows.append(f"SELECT s_suppkey::VARCHAR AS doc_id, '{o.sentencecase} {o.caseprotection} {str(o.preservequoted).lower()}' AS options, '{title} ' || s_suppkey::VARCHAR AS title FROM supplier")
    return " UNION ALL ".join(rows)


@query(matrix_sql())
def option_matrix(spark, sf_dir):
    docs = supplier_docs(spark, sf_dir, {"title": text_of("s_suppkey", "The {iota} and {Gamma} of ``Some Words'' in Set ")})
    each = [parse.entry_values(docs, ("title",), o).select("doc_id", F.lit(f"{o.sentencecase} {o.caseprotection} {str(o.preservequoted).lower()}").alias("options"), "title") for o in MATRIX]
    return reduce(DataFrame.unionByName, each)


@query("SELECT 'n' || n_nationkey::VARCHAR AS citekey, n_name AS place, n_regionkey::VARCHAR AS number FROM nation")
def text_files(spark, sf_dir):
    """One file per nation, written and read as files are."""
    path = folder(spark, "bib")
    nation = table(spark, sf_dir, "nation")
    text = entry("misc", key("n", "n_nationkey"), {"place": braced(escaped(F.col("n_name"))), "number": F.col("n_regionkey").cast("string")})
    nation.select(text.alias("value"), F.col("n_nationkey").alias("n")).write.partitionBy("n").text(path)
    return values(read_text(spark, f"{path}/*/*.txt"), {"place": "place", "number": "number"}).drop("type")


@query("SELECT 'The New Item ' || p_partkey::VARCHAR || ' of USA' AS title, 'The new item ' || p_partkey::VARCHAR || ' of USA' AS sentence FROM part")
def json_titles(spark, sf_dir):
    path = folder(spark, "json")
    title = F.concat(F.lit("The New Item "), F.col("p_partkey").cast("string"), F.lit(" of USA"))
    grouped = table(spark, sf_dir, "part").groupBy(F.pmod(F.xxhash64("p_partkey"), F.lit(200)).alias("n")).agg(F.collect_list(F.struct(title.alias("title"))).alias("items"))
    grouped.select(F.to_json(F.struct("items")).alias("value"), "n").write.partitionBy("n").text(path)
    return read_titles(spark, f"{path}/*/*.txt")


@query(
    "WITH r AS (SELECT 'N. ' || n_name AS abbr, n_name AS whole, 0 AS f, n_nationkey AS o FROM nation UNION ALL SELECT 'N. ' || n_name, n_name || ' \"new\"', 1, 100 + n_nationkey FROM nation WHERE n_nationkey % 2 = 0"
    " UNION ALL SELECT 'R. ' || r_name, r_name, 1, 200 + r_regionkey FROM region)"
    " SELECT abbr, arg_max(whole, o) AS \"full\", CASE max(f) WHEN 0 THEN 'base.csv' ELSE 'more.csv' END AS source, row_number() OVER (ORDER BY min(o)) - 1 AS nth FROM r GROUP BY abbr"
)
def csv_files(spark, sf_dir):
    """Two ordered tables in files, merged and written, and the written rows in the order of the files and their lines."""
    nation, region, path = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), folder(spark, "csv")
    base = nation.select(F.col("n_name"), F.concat(F.lit("N. "), "n_name"), F.lit("more columns"), F.col("n_nationkey").alias("o"))
    renamed = nation.where("n_nationkey % 2 = 0").select(F.concat("n_name", F.lit(' "new"')), F.concat(F.lit("N. "), "n_name"), F.lit(""), F.col("n_nationkey").alias("o"))
    more = renamed.union(region.select("r_name", F.concat(F.lit("R. "), "r_name"), F.lit(""), F.col("r_regionkey") + 100))
    for name, rows in (("base.csv", base), ("more.csv", more)):
        rows.coalesce(1).sortWithinPartitions("o").drop("o").write.csv(f"{path}/{name}", sep=";", escape='"', quoteAll=True)
    merged = abbrev.merge(read_ordered_csv(spark, [f"{path}/base.csv", f"{path}/more.csv"]))
    write_ordered_csv(merged, f"{path}/out")
    back = spark.read.csv(f"{path}/out", sep=";", escape='"', schema="abbr string, full string, source string")
    # files are named in order, and lines are numbered in order in each
    place = back.select("abbr", "full", "source", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    return place.select("abbr", "full", "source", (F.row_number().over(Window.orderBy("file", "line")) - 1).cast("long").alias("nth"))


@query("SELECT s_suppkey::VARCHAR AS doc_id, 'jabref-meta: selector_' || s_nationkey::VARCHAR || ':a;' AS meta, 'no jabref ' || s_suppkey::VARCHAR AS comment FROM supplier")
def jabref_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("@comment{jabref-meta: selector_"), F.col("s_nationkey").cast("string"), F.lit(":a;}\n@comment{no jabref "), F.col("s_suppkey").cast("string"), F.lit("}\n"))
    return parse.parse_bibtex(documents(rows, F.col("s_suppkey"), text), OFF).select("doc_id", F.element_at("jabref", 1).alias("meta"), F.element_at("comments", 1).alias("comment"))


@query("SELECT s_suppkey::VARCHAR AS doc_id, 'Journal of the ACM' AS journal, 'a < ' || s_suppkey::VARCHAR || ' & b > \"c\"' AS howpublished FROM supplier")
def built_in_macros_and_no_escapes(spark, sf_dir):
    docs = supplier_docs(spark, sf_dir, {"journal": F.lit("jacm"), "howpublished": text_of("s_suppkey", "a < ", ' \\& b > "c"')})
    return parse.entry_values(docs, ("journal", "howpublished"), OFF).select("doc_id", "journal", "howpublished")


@query(
    "SELECT s_suppkey::VARCHAR AS doc_id, 'keep' AS unsupported, 'a \\nosuch' || s_suppkey::VARCHAR AS note FROM supplier"
    " UNION ALL SELECT s_suppkey::VARCHAR, 'drop', 'a ' || s_suppkey::VARCHAR FROM supplier"
)
def unsupported_policies(spark, sf_dir):
    docs = supplier_docs(spark, sf_dir, {"note": text_of("s_suppkey", "a \\nosuch ")})
    each = [parse.entry_values(docs, ("note",), Options(sentencecase="off", unsupported=u)).select("doc_id", F.lit(u).alias("unsupported"), "note") for u in ("keep", "drop")]
    return reduce(DataFrame.unionByName, each)


@query(
    "SELECT 'n' || n_nationkey::VARCHAR AS citekey, '{\"number\":\"' || n_regionkey::VARCHAR || '\",\"place\":\"' || n_name || '\"}' AS fields, '{\"number\":\"literal\",\"place\":\"literal\"}' AS mode,"
    " 'comments entries errors jabref preamble strings' AS names FROM nation"
)
def golden_lines(spark, sf_dir):
    """Written as goldens are, and read back."""
    path, nation = folder(spark, "golden"), table(spark, sf_dir, "nation")
    text = entry("misc", key("n", "n_nationkey"), {"place": braced(escaped(F.col("n_name"))), "number": F.col("n_regionkey").cast("string")})
    write_golden(parse.parse_bibtex(documents(nation, F.col("n_nationkey"), text), OFF), path)
    said = lambda at: F.get_json_object("value", f"$.entries[0].{at}").alias("citekey" if at == "key" else at)
    return spark.read.text(path).select(said("key"), said("fields"), said("mode"), F.array_join(F.json_object_keys("value"), " ").alias("names"))
