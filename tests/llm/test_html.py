"""Main text against a plain reading of the page tree, marks on any element, and broken or very deep pages."""

import os
import re
import time
from html.parser import HTMLParser

import pytest

from bookflow.llm import html

SF = "/root/testdata/sf0.01/pages.parquet"
BLOCKS = "h1 h2 h3 h4 h5 h6 p li div section article table tr td th ul ol dl dt dd blockquote figure figcaption pre header footer nav aside form".split()


class Article(HTMLParser):
    """Blocks of the first article element, boilerplate elements left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = self.skipped = 0
        self.blocks, self.parts = [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.blocks += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        names = (dict(attrs).get("class") or "").split()
        if tag in ("script", "style", "nav", "aside", "form", "footer", "header", "button") or {"ad", "comments", "share", "notice"} & set(names):
            self.skipped += 1
        elif self.skipped and tag not in html.VOID:
            self.skipped += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        if self.skipped:
            self.skipped -= 1
        elif tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.skipped:
            self.parts.append(data)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet(SF)
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    n = 0
    for r in pages.collect():
        page = r["html"] or ""
        if page.count("<article") != 1:
            continue
        plain = Article()
        plain.feed(page)
        plain.flush()
        assert got[r["page_id"]] == "\n".join(plain.blocks), r["page_id"]
        n += 1
    assert n > 100 and len(got) == pages.count()


def main(page):
    blocks = html.blocks_of(page)
    return html.main_text(blocks, html.vote(blocks)[0])


PROSE = "<p>" + "Some words of the article that go on for a while. " * 5 + "</p>"
TEXT = ("Some words of the article that go on for a while. " * 5).strip()


@pytest.mark.parametrize("gone", [
    "<p class=notice>gone</p>", "<p class='top advert'>gone", "<p hidden>gone", "<span style='display: none'>gone <span>too</span></span>", "<button>gone</button>", "<dialog open>gone<p>too</p></dialog>",
    "<menu><li>gone</menu>", "<label>gone</label>", "<form><p>gone</p></form>", "<div class=site-header>gone</div>", "<div id=related-posts><p>gone</p></div>", "<ul class=comment-list><li>gone</ul>",
])
def test_marked_elements_are_left_out(gone):
    assert main(f"<body><article>{PROSE}{gone}<p>The end.</p></article></body>") == f"{TEXT}\nThe end."


@pytest.mark.parametrize(("kept", "text"), [
    ("<p><a href=/x>A linked paragraph</a></p>", "A linked paragraph"), ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "So x=1 holds"),
    ("<div class=related-work><p>Others did this.</p></div>", "Others did this."), ("<section class='section-header'>A part</section>", "A part"), ('<p title="5" tall">Stray</p>', "Stray"),
    ("<p class=it's>Stray</p>", "Stray"), ("<p data-class=ad>Named</p>", "Named"), ("<p title='a > b'>Greater</p>", "Greater"), ("a <b>b</b>c &lt;d&gt; &#233;", "a bc <d> é"),
])
def test_article_text_is_kept(kept, text):
    assert main(f"<body><nav>Menu</nav><article>{PROSE}{kept}</article></body>") == f"{TEXT}\n{text}"


def test_ends_of_pages():
    for end in ("<!-- no end", "<!-- a > b", "<script>var x", "<script>if (a > b) x", "<style>p > a {"):
        assert main(f"<body><article>{PROSE}</article>{end}") == TEXT


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep" + "</div>" * 100_000 + PROSE, "<div><p>x" * 30_000, "<b><i>" * 50_000 + "x", "<p a=\"" * 20_000, "</div>" * 100_000, "<" * 100_000, "<span hidden>" * 50_000 + "x"])
def test_deep_and_broken_pages_take_linear_time(page):
    began = time.time()
    blocks = html.blocks_of(page)
    html.vote(blocks)
    assert time.time() - began < 15


def test_mixed_hosts_and_marks(spark):
    """Pages with an article keep to it though flat pages make the body win as well; class paths alone, without article elements, are told too."""
    para = lambda k: f"<p>Paragraph {k} of the text that is long enough to be the main part of a page about its subject.</p>"
    body = "".join(map(para, range(4)))
    side = "<div class='tips'><p>Tip: try the other pages of this site as well, they are good.</p></div>"
    mixed = [(k, "http://mixed.example/a", f"<html><body><article>{body}</article>{side}</body></html>") for k in range(3)] + [(3, "http://mixed.example/flat", f"<html><body>{body}</body></html>")]
    by_class = [(10 + k, "http://classes.example/x", f"<html><body><div class='top'><p>Welcome to our site.</p></div><div class='story s{k}'><h1>Title {k}</h1>{body}</div>{side}</body></html>") for k in range(6)]
    marked = "<div class='ad-hoc-networks'><p>Ad hoc networks are kept.</p></div>" + "".join(f"<div {m}><p>Boilerplate {i} here.</p></div>" for i, m in enumerate(
        ("class='ad'", "class='ad-slot'", "class='ads top'", "role='alert'", "aria-hidden='true'", "class='adsbygoogle'", "class='social-media'", "class='sharethis'", "class='signup'", "class='commentlist'")))
    marked += "<video><p>No video here.</p></video>"
    pages = [*mixed, *by_class, (20, "http://marks.example/", f"<html><body><article>{body}{marked}</article></body></html>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    plain = "\n".join(re.sub("<[^>]+>", "", para(k)) for k in range(4))
    assert [got[k] for k in range(4)] == [plain] * 4
    assert [got[10 + k] for k in range(6)] == [f"Title {k}\n{plain}" for k in range(6)]
    assert got[20] == plain + "\nAd hoc networks are kept."
