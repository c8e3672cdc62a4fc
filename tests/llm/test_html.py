import html
import re

from quillspark.llm import html as pages_op
from quillspark.llm import queries


def test_query_equals_brute_force(spark, sf_dir):
    want = {}
    for r in queries.table(spark, sf_dir, "pages").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inside))
        want[r.page_id] = "\n".join(p for p in parts if p)
    got = queries.op3_html(spark, sf_dir).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_structure():
    page = """<!doctype html><html><head><title>T</title><style>a{}</style></head><body class="home"><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><aside><p>More</p></aside>
    <article class="post"><header><h1>Head &amp; line</h1></header><p>One<b>two</b>&nbsp;&lt;three&gt;
    <script>var x="<p>no</p>";</script>four<p>Five<br>six<div class="ad">Buy</div><form><p>Name</p></form><table><tr><td>cell</td></tr></table>
    <section id="comments"><p>First!</p></section><footer>Tags</footer></article><p>after</p><footer>&copy; us</footer></body></html>"""
    assert pages_op.main_text(page) == "Head & line\nOnetwo <three> four\nFive six\ncell"


def test_without_article_neighbours_decide():
    body = "The people of the town were in the square and they had to go with all of it as it was said to them by the old man. " * 2
    page = f"<body><div><a href=x>one</a> <a href=y>two</a></div><div><p>{body}</p><p>Short one.</p><p>{body}</p></div><div><a href=z>three</a></div><p>x</p><div>© 2020</div></body>"
    assert pages_op.main_text(page) == "\n".join([body.strip(), "Short one.", body.strip()])


def test_second_pass():
    assert pages_op.second_pass([0, 1, 0, 0, -1, 0], [0] * 6) == [1, 1, 1, -1, -1, -1] and pages_op.second_pass([0, 0], [0, 0]) == [-1, -1]
    # three open blocks between two of one label; a tie; an article's borders are text, and end what is outside
    assert pages_op.second_pass([-1, 0, 0, 0, -1, 0, 1], [0] * 7) == [-1, -1, -1, -1, -1, 1, 1]
    assert pages_op.second_pass([-1, 0, 0, 0, -1], [0, 1, 1, 2, 0]) == [-1, 1, 1, 1, -1] and pages_op.second_pass([0, 1, 0], [0, 1, 0]) == [-1, 1, -1]


def test_awkward_rows(spark):
    rows = [(1, "u", None, 0), (2, None, "", 1), (None, "u", "<p", 2), (3, "u", "<article><p>" + "x " * 100_000 + "</article>", 3), (3, "u", "<article><p>" + "x " * 100_000 + "</article>", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = {(r.page_id, r.n_chars) for r in pages_op.extract(df).collect()}
    assert got == {(1, 0), (2, 0), (None, 0), (3, 199_999)} and pages_op.extract(df.limit(0)).count() == 0


def test_only_closed_elements_are_left_out():
    body = "<article><p>Body one.</p></article>"
    for before in ('<svg class="i"/>', "<svg-icon name=x></svg-icon>", "<video-js></video-js>", "<button-x></button-x>", "<button>", '<select class="share">', "<iframe src='x'/>", "<script-x></script-x>", "<style-guide></style-guide>", "<button>a<button>b</button>"):
        assert pages_op.main_text(before + body) == "Body one."
    page = "<article><p>One <svg><svg/><svg><text>no</text></svg><text>no</text></svg>two <button>no</button><object>no<object>no</object>no</object>three <svg/>four <script>'<button>'</script>five</p><style>no"
    assert pages_op.main_text(page) == "One two three four five"


BODY = "The people of the town were in the square and they had to go with all of it as it was said to them by the old man."
LONG = f"{BODY} {BODY}"


def test_density_and_neighbours_decide(spark, sf_dir):
    """On the given pages the first pass decides by density and length, and the second does the rest."""
    said = [(first, second) for r in queries.table(spark, sf_dir, "pages").collect() for _, first, second in pages_op.labelled(r.html)]
    assert 0.4 < said.count((1, 1)) / len(said) < 0.9 and said.count((0, 1)) / len(said) > 0.1


def test_first_pass_of_pages_without_article():
    page = f"""<body><div class="top"><a href=/>Home</a> <a href=/n>News of the day and of the week</a></div><h1>Title here</h1><p>By somebody</p>
    <p>{LONG}</p><p>Short.</p><ul><li>{BODY}</li><li>one</li></ul><p>{LONG}</p><p>{"<a href=/x>A link of some words</a> " * 9}</p>
    <p>Odd end</p><p>&copy; 2020 The Site</p></body>"""
    found = {b.text[:8]: (first, second) for b, first, second in pages_op.labelled(page)}
    assert found == {"Home New": (-1, -1), "Title he": (0, -1), "By someb": (0, 1), BODY[:8]: (1, 1), "Short.": (0, 1), "one": (0, 1), "A link o": (-1, -1), "Odd end": (0, -1), "© 2020 T": (-1, -1)}


def test_length_counts_where_stop_words_are_unknown():
    odd = "zxqw vbnm " * 40
    assert pages_op.main_text(f"<body><div><a href=/>up</a></div><p>{odd}</p><p>kort</p></body>") == f"{odd.strip()}\nkort"


def test_what_wrappers_say():
    article = f"<article><h1 class='article-header'>Head</h1><p>{LONG}</p><section id='discussion'><h2>Discussion</h2><p>Mild.</p></section></article>"
    text = f"Head\n{LONG}\nDiscussion\nMild."
    for wrapper in ('div class="layout has-sidebar"', "div class='with-nav no-ads'", 'div id="page-with-header"', 'form id="aspnetForm"', "div data-class='sidebar'", "div aria-hidden=id=ad"):
        assert pages_op.main_text(f"<body><{wrapper}>{article}</{wrapper.split()[0]}></body>") == text
    for out in ('div class="sidebar"', 'div class="site-footer wide"', "section id='comments-area'", 'div class="post-comments"', "ul class=main-menu", 'div class="cookie-notice"', "div role=banner", "div class='ad-slot'", "aside", "form", "div id=left_sidebar"):
        noise = f"<{out}><p>{LONG}</p></{out.split()[0]}>"
        assert pages_op.main_text(f"<body>{noise}{article}{noise}</body>") == text
        assert pages_op.main_text(f"<body><article>{noise}<p>{LONG}</p>{noise}<p>End.</p></article></body>") == f"{LONG}\nEnd."


def test_a_teaser_is_not_the_article():
    page = f"<body><article><p>{BODY}</p></article><div><p>{LONG}</p><p>Between.</p><p>{LONG}</p></div></body>"
    assert pages_op.main_text(page) == "\n".join([BODY, LONG, "Between.", LONG])


def test_links_inside_an_article_stay():
    page = f"<body><nav><a href=/>x</a></nav><article><p>{LONG}</p><p><a href=/y>{BODY}</a></p><p>{LONG}</p></article><p>{BODY}</p></body>"
    assert pages_op.main_text(page) == f"{LONG}\n{BODY}\n{LONG}"
