import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from molspark.llm import dom, html_extract
from molspark.llm.common import read_table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy &amp; save</div>{body}
<aside class="sidebar"><p>Related things of many words in the sidebar</p></aside><form><p>Sign up</p><button>Go</button></form>
<section id="comments"><p>First! This is a reader comment of some length.</p></section><footer>&copy; me</footer></body></html>"""

PROSE = "The first paragraph is long enough to look like an article, with many words and no links at all in it."
WANTED = f"Head {PROSE} Second & last «one» bold text ends."
INNER = f"<h2>Head</h2><p>{PROSE}<p>Second &amp; last\n  &laquo;one&raquo; <b>bo</b>ld<br>text ends.</p>"


@pytest.fixture(scope="module")
def potentials(spark):
    return html_extract.fit(read_table(spark, "/root/testdata/sf0.001", "pages"))


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{INNER}</article>",
        f"<main><article>{INNER}<aside>not this</aside><div class='share'>Tweet</div></article></main>",
        f"<main>{INNER}<nav>more</nav></main>",
        f"<article>{INNER}<div class='advert'><p>Buy now</p></div><script>x()</script><!-- no --></article>",
        f"<article><div><div>{INNER}</div></div><section class='comments'><article><p>I disagree with this</p></article></section></article>",
        f"<div role='main'>{INNER}</div>",
        f"<div class='post-body'>{INNER}</div>",
    ],
)
def test_article_without_the_rest(potentials, body):
    assert html_extract.main_text(PAGE.format(body=body), potentials) == WANTED


def test_prose_without_any_mark(potentials):
    text = html_extract.main_text(PAGE.format(body=f"<div><p>{PROSE}</p><p>{PROSE}</p></div>"), potentials)
    assert text == f"{PROSE} {PROSE}"


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='has-sidebar'><p>{PROSE}</p></body>",
        f"<body class='search'><main id=search><p>{PROSE}</p></main></body>",
        f"<nav>Home</nav><article class='post has-sidebar'><p>{PROSE}</p></article>",
        f"<nav>Home</nav><form><div><p>{PROSE}</p></div></form>",
        f"<form><nav>Home</nav><article><p>{PROSE}</p></article></form>",
        f"<article><p>{PROSE}</p><form>Your mail <button>Go</button></form></article><form>Search</form>",
        f"<article><p>{PROSE}</p></article><article class='comment'><p>I disagree</p></article>",
    ],
)
def test_frames_and_forms(potentials, page):
    assert html_extract.main_text(page, potentials) == PROSE


def test_doubtful_words_are_decided_by_what_stands_below(potentials):
    work = f"<article><p>{PROSE}</p><section id='related-work'><h2>Related work</h2><p>{PROSE}</p><p>{PROSE}</p></section></article>"
    assert html_extract.main_text(work, potentials) == f"{PROSE} Related work {PROSE} {PROSE}"
    links = "".join(f"<li><a href=/{i}>A page called {i}</a></li>" for i in range(5))
    more = f"<article><p>{PROSE}</p><section class='related'><ul>{links}</ul></section></article>"
    assert html_extract.main_text(more, potentials) == PROSE


def test_formula_is_text(potentials):
    assert html_extract.main_text(f"<article><p>{PROSE} <math><mi>x</mi></math></p></article>", potentials) == f"{PROSE} x"


@pytest.mark.parametrize("odd", ["<![ foo", "<![>", "<![foo[bar]]>", "<![if IE]>", "<!x", "<![CDATA[a]]>", "<!DOCTYPE [", "<?x", "<!-", "<![CDATA["])
def test_odd_declarations_are_comments(potentials, odd):
    assert html_extract.main_text(f"<article><p>{PROSE}</p></article>{odd}", potentials) == PROSE
    dom.parse(f"{odd}<p>then</p>")


@given(st.text("<>![]-/?&;=\"' abcdCATD#x", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(markup):
    dom.parse(markup)


def test_broken_markup(potentials):
    assert html_extract.main_text("<article><p>one<p>two</b></i> three<div>four", potentials) == "one two three four"
    assert html_extract.main_text("<article><p>cut &am", potentials) == "cut &am"
    assert html_extract.main_text("", potentials) == ""
    deep = "<article>" + "<div>" * 5000 + PROSE + "</div>" * 5000
    assert html_extract.main_text(deep, potentials) == PROSE


def test_marginals_equal_enumeration(potentials):
    page = dom.parse("<body><div><p>some words here</p><a href=x>link</a></div><p>more words</p></body>")
    kind, told = html_extract.kinds(page, set()), html_extract.features(page)
    n = len(kind)
    total, yes = 0.0, [0.0] * n
    for code in range(1 << n):
        label = [code >> i & 1 for i in range(n)]
        if label[0]:
            continue
        weight = 1.0
        for i in range(n):
            for value in told[i]:
                weight *= potentials.node["unmarked", value][label[i]]
            if i:
                weight *= potentials.edge["unmarked", kind[i]][label[page.parents[i]]][label[i]]
        total += weight
        for i in range(n):
            yes[i] += weight * label[i]
    got = html_extract.marginals(page, potentials)
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(got, yes, strict=True))


def test_table(spark, potentials):
    rows = [(1, "u", PAGE.format(body=f"<article>{INNER}</article>"), "clash"), (2, None, None, None), (2, None, None, None), (3, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in html_extract.extract(pages, potentials).collect())
    assert got == [(1, WANTED), (2, ""), (2, ""), (3, "")]
    empty = pages.limit(0)
    assert html_extract.extract(empty, html_extract.fit(empty)).count() == 0
