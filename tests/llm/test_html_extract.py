"""Main text of small pages."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quire.llm.html_extract import extract, extract_pages

LONG = "The cat was on the mat and it is a story of the house that is here for you and me to read in the evening."

RUSSIAN = "В доме на краю города жил человек, и он не знал, что в тот же день на него и на его дом упадёт снег, и что он не выйдет на улицу."
CHINESE = "他在城市的边上有一个小小的房子,那是他父亲的房子,也是他的祖父的房子,他在这里住了很多年,他的朋友们都说他是一个好人,他的猫也是一只好猫,他们在一起的日子是很好的日子。"


class Plain(HTMLParser):
    """Article text by the standard library's parser, for pages without menus inside their article."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("article", "h1", "p", "div", "li"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("article", "h1", "p", "div", "li"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and self.blocks:
            self.blocks[-1] += data


def test_against_the_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    for r in pages.collect():
        parser = Plain()
        parser.feed(r.html)
        parser.close()
        assert got[r.page_id] == "\n\n".join(filter(None, (" ".join(b.split()) for b in parser.blocks)))


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>" + LONG, LONG),
        (f"<nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>A  b\n c<p><b>Zz%%% qq###<br>x</b></article><footer>f</footer>", "T & U\n\nA b c\n\nZz%%% qq### x"),
        (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><ul class='share'><li>x</ul><p>End.</article><aside>{LONG}</aside>", f"{LONG}\n\nEnd."),
        (f"<div id='top-nav'>{LONG}</div><div><p>Short.</p><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div><form>{LONG}</form>", f"Short.\n\n{LONG}"),
        (f"<article><p>{LONG} <script>var t='</p>';</script><style>p{{}}</style><!-- no </article> -->tail &am &copy;</p>", f"{LONG} tail &am ©"),
        (f"<p><a href=x>{LONG}</a></p><p>{LONG}</p>", LONG),
        ("<article><p>Hi <span hidden>no</span>there</p></article>", "Hi there"),
        (f"<body class='has-sidebar'><main><p>{LONG}</p></main>", LONG),
        ("<p>12<p>34", ""),
        ("<article><p>a<b>c", "ac"),
        ("<article><p title='a>b'>x</p><", "x\n\n<"),
        (f"<article><p>{LONG}</p><p>See <a href=x>{LONG}</a></p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>{LONG}</p>", f"{LONG}\n\nSee {LONG}\n\n{LONG}"),
        (f"<article><p>{LONG}</p><ul><li>Bread<li><a href=x>Butter</a><li>Milk</ul></article>", f"{LONG}\n\nBread\n\nButter\n\nMilk"),
        *((f"<article><p>{LONG}</p><{tag}><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}") for tag in ("svg", "noscript", "template", "video", "object")),
        *((f"<article><p>{LONG}</p><{tag}><g>no</g></{tag}><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}") for tag in ("svg", "noscript", "template", "video", "object")),
        (f"<ul><li><a>Раз</a><li><a>Два</a></ul><p>{RUSSIAN}</p><p>{RUSSIAN}</p><div class=footer>{RUSSIAN}</div>", f"{RUSSIAN}\n\n{RUSSIAN}"),
        (f"<ul><li><a>一</a><li><a>二</a></ul><p>{CHINESE}</p>", CHINESE),
        (f"<main><p>{LONG}</p><p>{LONG}</p><article>Read more</article><p>{LONG}</p></main>", f"{LONG}\n\n{LONG}\n\nRead more\n\n{LONG}"),
        (f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><article>A teaser</article>", "\n\n".join([LONG] * 3 + ["A teaser"])),
    ],
)
def test_extract(page, text):
    assert extract(page) == text


SOURCES = ["Smith, A history of the northern harbours", "Jones, Boats and those who build them", "Miller, Letters from the coast, volume two"]


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<p>{RUSSIAN}</p><p>{RUSSIAN}</p><p>{LONG}</p><p>{RUSSIAN}</p>", "\n\n".join([RUSSIAN, RUSSIAN, LONG, RUSSIAN])),
        *((f"<{tag} class='post category-social tag-ads'><p>{LONG}</p><p>{LONG}</p></{tag}>", f"{LONG}\n\n{LONG}") for tag in ("article", "div")),
        *((f"<{tag} class='post related'><p>{LONG}</p></{tag}><p>Short.</p>", f"{LONG}\n\nShort." if tag == "div" else LONG) for tag in ("article", "div")),
        ("<html><body><p>Closed today.</p></body></html>", "Closed today."),
        ("<p>Bugün hava çok güzel.</p>", "Bugün hava çok güzel."),
        (f"<p>{LONG}</p><table><tr><td>H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn<td>12 34</table><p>{LONG}</p>", f"{LONG}\n\nH He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn\n\n12 34\n\n{LONG}"),
        (f"<article><p>{LONG}</p><ul>{''.join(f'<li><a href=x>{s}</a>' for s in SOURCES)}</ul></article>", "\n\n".join([LONG, *SOURCES])),
        (f"<article><p>{LONG}</p><h2 class='related-work'>Related work</h2><p>{LONG}</p></article>", f"{LONG}\n\nRelated work\n\n{LONG}"),
        (f"<div class='ad'>{LONG} {LONG}</div><div><p>Short text.</p></div>", "Short text."),
        (f"<p>{LONG}</p><div class='comments'>{''.join(f'<article><p>{LONG}</p></article>' for _ in range(5))}</div>", LONG),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article>", LONG),
    ],
)
def test_nothing_else_is_dropped(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_rules_find_what_the_article_tag_marks(spark, sf):
    """The pages of the tables with their articles turned into plain boxes give the same texts."""
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", "<(/?)article\\b", "<$1div"))
    told = [{r.page_id: r.text for r in extract_pages(p).collect()} for p in (pages, plain)]
    assert told[0] == told[1] and len(told[0]) >= 50


def test_frames(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "t"), (1, "u", "<article><p>x</p></article>", "t"), (None, None, None, None), (2, "v", "<p>" + LONG * 3000, "t")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 1, len(LONG) * 3000] and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
