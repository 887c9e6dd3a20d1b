from html.parser import HTMLParser

import pytest

from feedloom.llm import html_extraction

from .conftest import SF

LONG = "A paragraph of the story, long enough to count, with commas, and an end that everyone can see."
OTHER = "Another paragraph follows, which says more about the same matter, slowly, and in many words."
JUNK = '<nav><a href="/">Home</a><a href="/x">More</a></nav>'


class Inside(HTMLParser):
    """Text inside of ``article`` elements, blocks apart: an independent reading of simple pages."""

    def __init__(self):
        super().__init__()
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out += [" "] if tag != "b" else []

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.out += [" "] if tag != "b" else []

    def handle_data(self, data):
        self.out += [data] if self.depth else []


def test_query_gives_the_articles_of_all_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_extraction.op12_scored_article_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        parser = Inside()
        parser.feed(pages[r["page_id"]]["html"])
        parser.close()
        assert r["text"] == " ".join("".join(parser.out).split())
        assert (r["url"], r["n_chars"]) == (pages[r["page_id"]]["url"], len(r["text"]))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body>{JUNK}<div class=content><p>{LONG}</p><p>Short.</p></div><div id=sidebar><p>{OTHER}</p></div></body>", f"{LONG} Short."),
        # no article element, nested blocks, text after a nested block
        (f"<div id=wrap><div class='entry-content'>{LONG}<div>Inner part.</div>{OTHER}</div></div><footer>{LONG}</footer>", f"{LONG} Inner part. {OTHER}"),
        # siblings: a second part beside the best, the heading before it
        (f"<body><h1>Title</h1><div><p>{LONG}</p><p>{OTHER}</p></div><div class=advert>{LONG}</div><div><p>{OTHER}</p></div></body>", f"Title {LONG} {OTHER} {OTHER}"),
        # comments, forms, notices and menus inside of the article
        (
            f"<article><header><h1>Head</h1><p>By me</p></header><p>{LONG}</p><form>Send <input></form><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul>"
            f"<div role=alert>{OTHER}</div><section id=comments><article class=comment><p>{OTHER}</p></article></section></article>",
            f"Head {LONG}",
        ),
        # a list that is text stays; scripts, styles, comments and markup go
        (f"<article><p>{LONG}<script>x = '</p><p>no</p>'</script></p><ul><li>first<li>second <a href=x>link</a></ul><!-- <p>{OTHER}</p> --><style>p</style></article>", f"{LONG} first second link"),
        # unclosed tags, references with and without their end, blocks and inline parts
        ("<article><p><b>Caf&eacute;&nbsp;&amp</b>s &lt;p&gt; &#x41;&#66<p>a<i>b</i>c<br>d", "Café &s <p> AB abc d"),
        # a page within a form, a wrapper with a telling name around the article
        (f"<form id=aspnet><div class='page with-sidebar'><p>{LONG}</p><p>{OTHER}</p></div></form>", f"{LONG} {OTHER}"),
        (f"<div class='sidebar-page'><article class='post category-promo'><h2 id=comments>Comments on it</h2><p>{LONG}</p></article></div>", f"Comments on it {LONG}"),
        # sections of one article, of different length
        (f"<main><section><p>{LONG}</p><p>{OTHER}</p></section><section><p>tiny</p></section>{JUNK}</main><aside>{LONG}</aside>", f"{LONG} {OTHER} tiny"),
        (f"<head><title>T</title><body><a href='a>b' title=\"{OTHER}\">x</a><p>{LONG}", f"x {LONG}"),
        ("just text, no markup", "just text, no markup"),
        (f"<body>{JUNK}</body>", ""),
        ("<p", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_layouts(page, want):
    assert html_extraction.main_text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep", '<a "' * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<p><a href=x>" * 20_000 + "end", "<!--" * 20_000, "<table><tr><td>" * 20_000 + "cell"])
def test_hostile_pages_are_read_in_linear_time(page):
    assert html_extraction.main_text(page) in ("deep", "", "end", "cell")


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "u", "old", 9), (1, None, "u", "old", 9), (None, "<p>some text</p>", None, "old", 9), (2, "", "u", "old", 9), (3, f"<p>{'word ' * 100_000}</p>", "u", "old", 9)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string, n_chars long")
    got = sorted(map(tuple, html_extraction.extract(pages).select("page_id", "url", "text", "n_chars").collect()), key=repr)
    long = " ".join(["word"] * 100_000)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "some text", 9), (2, "u", "", 0), (3, "u", long, len(long))], key=repr)
    assert html_extraction.extract(pages.limit(0)).collect() == []
