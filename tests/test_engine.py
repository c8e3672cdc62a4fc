import pytest

from quillspark import api
from quillspark.functions import casing, latex, names
from quillspark.functions.grammar import chunks
from quillspark.operators.parse import Failed, parse_text
from quillspark.options import MATRIX, Options

OFF = Options(sentencecase="off")


def fields(text, options=OFF):
    record = parse_text(text, options)
    return [{f["name"]: f["value"] or f["list"] or [{k: v for k, v in p.items() if v} for p in f["people"]] for f in e["fields"]} for e in record["entries"]]


def test_grammar():
    text = '''free text @comment to the end \n@comment{a {b}}@PREAMBLE{ "x" }
    @String(tla = "The Long {"}Abbrev")
    @Article( Key:1 , a = 1990, , b = "q {"} z" # tla # {w}, C-d+e:f = {x{y}z},, )
    % note 1
      % note 2
    @foo{}
    @book(x=unknown)'''
    record = parse_text(text, OFF)
    assert record["comments"] == ["to the end ", "a {b}"] and record["preamble"] == [' "x" ']
    first, second, third = record["entries"]
    assert (first["type"], first["key"]) == ("article", "Key:1") and first["input"].endswith("% note 2")
    assert {f["name"]: f["value"] for f in first["fields"]} == {"a": "1990", "b": 'q " zThe Long "Abbrevw', "c-d+e:f": "xyz"}
    assert (second["type"], second["key"], second["fields"]) == ("foo", "", []) and third["key"] == ""
    assert [e["error"] for e in record["errors"]] == ['Unresolved @string reference "unknown"'] and record["strings"] == {"TLA": 'The Long {"}Abbrev'}


def test_unclosed_entry_and_braces():
    got = [c for c in chunks("@a{x, t = {open\n@b{y, u = {fine}}") if c.kind == "entry"]
    assert got[-1].key == "y" or len(got) == 1
    assert chunks("") == [] and chunks("no entries @ here") == []


def test_latex():
    assert latex.to_text(r"M\"{o}ller \& \'e \v{c} {\ss} \ae") == "Möller & é č ß æ"
    assert latex.to_text("a--b---c ``q'' x~y") == "a–b—c “q” x y"
    assert latex.to_text(r"{\em it} \emph{b} {\sc C} \texttt{t} $x_2^{3}$") == '<i>it</i> <i>b</i> <span style="font-variant:small-caps;">C</span> <code>t</code> x<sub>2</sub><sup>3</sup>'
    assert latex.to_text(r"\textbackslash{}x \{y\} \url{a_b} \href{u~v}{w}") == '\\x {y} <a href="a_b">a_b</a> <a href="u~v">w</a>'
    assert latex.to_text("note 1\n\\par\nnote 2") == "note 1 <p>note 2" and latex.to_text("  a\n\tb ") == "a b"
    with pytest.raises(latex.Unsupported):
        latex.to_text(r"\nosuch x")
    assert latex.to_text(r"a \nosuch b", "drop") == "a b" and latex.to_text(r"a \nosuch b", "keep") == "a \\nosuchb"


def test_names():
    split = lambda s: [names.person(p) for p in names.split_list(s)]
    assert split("Ann Lee and van der Berg, Bo and Cy de Witt and {The A and B Group} and Plato and King, Jr., Martin Luther") == [
        {"firstName": "Ann", "lastName": "Lee"}, {"prefix": "van der", "lastName": "Berg", "firstName": "Bo"}, {"firstName": "Cy", "prefix": "de", "lastName": "Witt"}, {"name": "The A and B Group"}, {"lastName": "Plato"}, {"lastName": "King", "suffix": "Jr.", "firstName": "Martin Luther"},
    ]
    assert split("family=Doe, given=Jo Ann, given-i={J}") == [{"lastName": "Doe", "firstName": "Jo Ann", "initial": "J"}]
    assert names.literal_list("Bolt and {Mills and Sons}") == ["Bolt", "Mills and Sons"]
    assert fields("@a{k, author = ME # { and Bo Li}}")[0]["author"] == [{"name": "ME"}, {"firstName": "Bo", "lastName": "Li"}]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("The Big Rate-Distortion Book: A View of {NATO} -- The End", "The big rate-distortion book: a view of NATO – the end"), ("Part 1. The Rest; More Vs. Less", "Part 1. The rest; more vs. less"), ("{Whole Value Braced}", "Whole value braced"), ("A {\\em Marked} Word", "A <i>marked</i> word")],
)
def test_sentence_case(raw, want):
    assert fields(f"@a{{k, title = {{{raw}}}}}", Options(sentencecase="on"))[0]["title"] == want
    assert fields(f"@a{{k, journal = {{{raw}}}}}")[0]["journal"] == latex.to_text(raw)


def test_options():
    assert len(MATRIX) == 18 == len(set(MATRIX))
    title = "@a{k, title = {The {iota} and {Gamma} of ``Some Words''}}"
    got = {(o.sentencecase, o.caseprotection, o.preservequoted): fields(title, o)[0]["title"] for o in MATRIX}
    assert len({v for k, v in got.items() if k[0] == "off"}) == 1
    assert got["on", "strict", False] == 'The <span class="nocase">iota</span> and <span class="nocase">Gamma</span> of “some words”'
    assert got["on", "off", True] == "The iota and Gamma of “Some Words”" and got["on", "as-needed", False] == 'The <span class="nocase">iota</span> and Gamma of “some words”'
    assert casing.to_sentence_case("Already cased title with many lower words") == "Already cased title with many lower words"
    with pytest.raises(ValueError):
        Options(sentencecase="maybe")
    with pytest.raises(Failed):
        parse_text("@a{k, x = nope}", Options(mode="FAILFAST"))
    assert Options.merged({"mode": "FAILFAST"}, OFF) == Options(sentencecase="off", mode="FAILFAST")


def test_months_and_empty_values():
    assert fields('@a{k, month = jan, x = {}, y = ""}\n@a{k, month = {Sept summer}}\n@a{k, month = "DEC", z = JACM}') == [{"month": "1"}, {"month": "Sept summer"}, {"month": "12", "z": "Journal of the ACM"}]


def test_views(spark):
    docs = spark.createDataFrame([("a", "@string{s={S}}@book{k, title={T}, author={A B}, publisher={P}, note=s, x=y}"), ("b", None), ("c", ""), ("d", "@b{c1, crossref={P1}, year={1}}@b{p1, year={2}, note={n}}")], "doc_id string, text string")
    parsed = api.parse_bibtex(docs, sentencecase="off")
    e = api.entries(parsed).where("doc_id = 'a'").first()
    assert e.text_fields == {"title": "T", "note": "S", "x": "y"} and e.list_fields == {"publisher": ["P"]} and e.name_fields["author"][0].lastName == "B" and e["mode"]["x"] == "literal"
    assert parsed.count() == 4 and api.errors(parsed).count() == 1 and api.strings(parsed).first().value == "S"
    long = api.field_table(docs, sentencecase="off", inherit=True).where("key = 'c1'").select("name", "value").collect()
    assert {tuple(r) for r in long} == {("crossref", "P1"), ("year", "1"), ("note", "n")}
    same = lambda df: sorted(map(str, df.select("doc_id", "ord", "key", "pos", "name", "mode", "value", "list", "people").collect()))
    assert same(api.fields(parsed)) == same(api.field_table(docs, sentencecase="off"))
    wide = {r.key: r.title for r in api.entry_values(docs, ["Title"], sentencecase="off").collect()}
    assert wide == {"k": "T", "c1": None, "p1": None}
    assert api.pivot_fields(api.fields(parsed), ["title", "note"]).where("key = 'k'").first().title == "T"
    assert api.chunk_table(docs).where("doc_id = 'a'").count() == 2
    only = api.fields(api.parse_bibtex(docs, fields=("note",)))
    assert {r.name for r in only.collect()} == {"note"}


def test_crossref_chains():
    text = "@a{c, crossref={M}, x={1}}@a{m, crossref={p}, y={2}}@a{p, x={0}, y={3}, note={n}}@a{q, crossref={q}}@a{r, crossref={s}}@a{s, crossref={r}, z={4}}@a{P, note={second}}"
    got = {e["key"]: {f["name"]: f["value"] for f in e["fields"] if f["name"] != "crossref"} for e in parse_text(text, Options(sentencecase="off", inherit=True))["entries"]}
    assert got == {"c": {"x": "1", "y": "2", "note": "n"}, "m": {"y": "2", "x": "0", "note": "n"}, "p": {"x": "0", "y": "3", "note": "n"}, "q": {}, "r": {"z": "4"}, "s": {"z": "4"}, "P": {"note": "second"}}
    only = parse_text(text, Options(inherit=True, fields=("note",)))["entries"][0]["fields"]
    assert [f["name"] for f in only] == ["note"]


def test_a_fatal_document_is_its_message(spark):
    docs = spark.createDataFrame([("a", "@a{k, x={y}}@a{l, note={\\nosuch}}"), ("b", "@a{k, x={y}}")], "doc_id string, text string")
    assert [r.doc_id for r in api.field_table(docs).collect()] == ["b"]
    parsed = api.parse_bibtex(docs).orderBy("doc_id").collect()
    assert parsed[0].fatal == "unsupported macro (\\nosuch)\n@a{l, note={\\nosuch}}" and parsed[0].entries == [] and parsed[1].fatal is None


def test_goldens_as_text(spark, tmp_path):
    docs = spark.createDataFrame([("a", "@string{z={Z}}@book{k, title={T}, author={B, A}, publisher={P and Q}}")], "doc_id string, text string")
    api.write_golden(api.parse_bibtex(docs, sentencecase="off"), str(tmp_path / "g"))
    import json

    (line,) = [x for f in (tmp_path / "g").glob("part-*") for x in f.read_text().splitlines()]
    said = json.loads(line)
    assert list(said) == sorted(said) and said["strings"] == {"Z": "Z"}
    (e,) = said["entries"]
    assert list(e["fields"]) == ["author", "publisher", "title"] == list(e["mode"]) and json.loads(e["fields"]["author"]) == [{"firstName": "A", "lastName": "B"}]


def test_short_rows_are_errors(spark, tmp_path):
    for n, bad in enumerate(("only one column\n", "a;b\n\nc;d\n", "a;b\n ")):
        (tmp_path / f"{n}.csv").write_text("x;y\n" + bad)
        with pytest.raises(Exception, match="of two columns"):
            api.read_ordered_csv(spark, [str(tmp_path / f"{n}.csv")]).collect()
    (tmp_path / "fine.csv").write_text('"two\n\nlines";b;c;d\n;\n')
    assert [(r.full, r.abbr) for r in api.read_ordered_csv(spark, [str(tmp_path / "fine.csv")]).collect()] == [("two\n\nlines", "b"), ("", "")]


def test_source_packs_files(spark, tmp_path, monkeypatch):
    from quillspark.sources import files

    for n in range(7):
        (tmp_path / f"{n}.bib").write_text(f"@a{{k{n}, x={{{n}}}}}")
    (tmp_path / "_SUCCESS").write_text("")
    monkeypatch.setattr(files, "PACK_FILES", 3)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        parts = files.BibtexReader({"path": path}).partitions()
        assert [len(p.value) for p in parts] == [3, 3, 1]
        rows = [r for p in parts for r in files.BibtexReader({"path": path}).read(p)]
        assert [r[7] for r in rows] == [str(n) for n in range(7)]
    assert files.packs([("a", 20 << 20), ("b", 20 << 20), ("c", 1)]) == [["a"], ["b", "c"]]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bib").write_text("@book{k, title={The Old Book of Things}}")
    (tmp_path / "in" / "b.biblatex").write_text("@book(k2, title={X}, note={n})")
    docs = api.read_text(spark, str(tmp_path / "in"))
    assert api.fields(api.parse_bibtex(docs)).count() == 3
    api.register(spark)
    got = spark.read.format("bibtex").option("fields", "title").option("sentencecase", "off").load(str(tmp_path / "in")).collect()
    assert {r.value for r in got} == {"The Old Book of Things", "X"}
    (tmp_path / "t.json").write_text('{"items": [{"title": "The Great New Thing"}, {"title": null}]}')
    assert [r.sentence for r in api.read_titles(spark, str(tmp_path / "t.json")).collect()] == ["The great new thing", None]
    q = api.stream_fields(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("streamed").count() == 3


def test_abbreviations(spark, tmp_path):
    (tmp_path / "one.csv").write_text('Journal A;J. A.\nNo;#c\n;x\n"Say ""hi""";S. H.;more\nJournal B;J. B.\n')
    (tmp_path / "unabbr-amendments.csv").write_text("Journal B2;J. B.\nJournal C;J. C.\n")
    merged = api.merge_abbreviations(api.read_ordered_csv(spark, [str(tmp_path / "one.csv"), str(tmp_path / "unabbr-amendments.csv")]))
    api.write_ordered_csv(merged, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["J. A.;Journal A;one.csv", 'S. H.;"Say ""hi""";one.csv', "J. B.;Journal B2;unabbr-amendments.csv", "J B;Journal B2;unabbr-amendments.csv", "J. C.;Journal C;unabbr-amendments.csv", "J C;Journal C;unabbr-amendments.csv"]
