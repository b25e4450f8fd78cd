import random

import pytest

from quillmark.llm import html_extraction as h

P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."

PAGES = {
    "frame": (f'<html><head><title>T</title></head><body><header class="site-header"><a href=/>Home</a> Site</header><nav><ul><li><a href=x>A</a></li></ul></nav><main><article><h1>Title</h1><p>{P}</p><aside class="related"><p>{P}</p></aside><p>Short.</p><ul><li>One</li><li>Two</li></ul></article><section id="comments"><p>{P}</p></section></main><footer>F</footer></body></html>', f"Title {P} Short. One Two"),
    "divs": (f'<body><div id="header">Site</div><div class="menu"><a href=1>a</a></div><div id="cookie-notice">{P}<button>OK</button></div><div class="content"><h1>Title</h1><div>{P}</div><div class="ad">{P}</div><div>tail</div></div><div class="sidebar">{P}</div><form><label>Name</label></form><div class="comments"><p>{P}</p></div></body>', f"Title {P} tail"),
    "no names": (f"<table><tr><td><a href=1>Home</a><a href=2>News</a></td></tr></table><h1>Heading</h1><p>{P}<p>{P} b<div><a href=a>p1</a> | <a href=b>p2</a></div>", f"Heading {P} {P} b"),
    "inline": ("<article><p>foo<b>bar</b>baz\n\t <i>q</i>.</p><p>1 &lt; 2 &eacute;&nbsp;x</p><noscript>n</noscript><script>var x='<p>no</p>';</script><!-- c --></article>", "foobarbaz q. 1 < 2 é x"),
    "hidden": (f'<article><p>{P}</p><div style="display: none">x</div><div hidden>y</div></article><div role="dialog">{P}</div>', P),
    "cut off": (f"<article><p>{P}</p><p>end &am", f"{P} end &am"),
    "cut tag": (f"<article><p>{P}</p><p>end <a hre", f"{P} end"),
    "no text": ("<nav><a href=1>x</a></nav>", ""),
    "empty": ("", ""),
    "null": (None, ""),
    "plain": ("just text without tags", "just text without tags"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert h.main_text(page) == want


def cost(labels, score, smooth):
    return sum(max(x, 0) if not on else max(-x, 0) for x, on in zip(score, labels, strict=True)) + sum(w for (a, b), w in smooth.items() if labels[a] != labels[b])


def test_cut_is_a_minimum():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        score = [rng.randint(-20, 20) / 10 for _ in range(n)]
        smooth = {(a, b): rng.randint(0, 20) / 10 for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        least = min(cost([m >> i & 1 == 1 for i in range(n)], score, smooth) for m in range(1 << n))
        assert abs(cost(h.minimum_cut(score, smooth), score, smooth) - least) < 1e-6


def test_given_pages_give_their_articles(spark, small):
    import html
    import re

    from quillmark.llm.queries import op8_html_extraction

    found = {r.page_id: r for r in op8_html_extraction(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[a-z/][^>]*(?:>|\Z)", " ", inside)).split())
        assert (found[r.page_id].text, found[r.page_id].n_chars) == (want, len(want))


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>" + "long text " * 50_000), (3, "u", "")]
    df = spark.createDataFrame(rows + rows, "page_id long, url string, html string").selectExpr("*", "7 AS text", "8 AS n_chars")
    found = h.extract(df).collect()
    assert len(found) == 6 and {r.n_chars for r in found if r.page_id is None} == {499_999}
    assert {r.text for r in found if r.page_id in (1, 3)} == {""}
    assert h.extract(df.limit(0)).count() == 0


def test_deep_and_broken_pages_end():
    assert h.main_text("<div>" * 3000 + P) == P
    assert h.main_text("<" * 5000).count("<") >= 0
    assert P in h.main_text("</p></b></div>" * 500 + f"<p>{P}")


def test_quotes_formulas_and_names_inside_an_article():
    page = f"<article><p title=it's>{P}</p><p>I don't know <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p><p data-x=\"a>b\" class='social-issues'>One.</p><div class=notice-period>Two.</div><ul><li><a href=r>Ref</a></li></ul>"
    out = "<div class='share-box'>no</div><section class='reader-comments'><p>no no.</p></section><div class=ad>" + P + "</div></article><p>" + P + "</p>"
    assert h.main_text(page + out) == f"{P} I don't know x=2. One. Two. Ref"
    assert h.main_text(f"<article><p title='open>{P}</p><p>Two.</p></article>") == f"{P} Two."


def test_wide_quotes_end_soon():
    assert h.main_text("<a b='" * 20_000).count("x") == 0
    assert h.main_text("<p x=\"" + "'>" * 50_000 + f"\"></p><p>{P}</p>") == P


def test_deep_page_with_text_at_each_level():
    texts = [f"This is the text of level {k}, which is long enough." for k in range(10_000)]
    assert h.main_text("<main>" + "".join(f"<div>{x}" for x in texts)) == " ".join(texts)


def naive_blocks(page):
    """(text, innermost block-level tag, all tags around) by the standard library's parser, for well-formed pages."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.parts, self.out = [], [], []

        def flush(self):
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.out.append((text, [t for t in self.stack if t not in h.INLINE]))

        def handle_starttag(self, tag, attrs):
            if tag not in h.INLINE:
                self.flush()
            if tag not in h.VOID:
                self.stack.append(tag)

        def handle_endtag(self, tag):
            if tag not in h.INLINE:
                self.flush()
            self.stack.pop()

        def handle_data(self, data):
            if not any(t in h.DROPPED for t in self.stack):
                self.parts.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.flush()
    return reader.out


def generated(rng, depth=0):
    if depth == 4 or rng.random() < 0.2:
        return rng.choice(["word ", "two words. ", "a &amp; b", "<b>bold</b>", "<a href='x'>link</a>", P])
    tag = rng.choice(["div", "section", "p", "nav", "article", "aside", "ul", "footer", "main", "h2", "script", "span"])
    inside = "" if tag == "script" else "".join(generated(rng, depth + 1 if tag not in ("p", "h2", "span") else 4) for _ in range(rng.randint(0, 3)))
    name = rng.choice(["", " class=\"ad\"", " id='content'", " class=x title=\"a>b\""])
    return f"<{tag}{name}>{inside}</{tag}>"


def test_whole_pages_equal_brute_force():
    """Blocks by another parser; labels by all cuts of small pages."""
    rng, small = random.Random(5), 0
    for _ in range(400):
        page = generated(rng)
        own = h.parse(page)
        around = lambda e: [*around(own.parent[e]), own.tag[e]] if e else []
        assert [(b.text, around(b.element)) for b in own.blocks] == naive_blocks(page)
        score, smooth = h.graph(own)
        if own.blocks and len(score) <= 12:
            small += 1
            n, kept = len(score), h.minimum_cut(score, smooth, len(own.blocks))
            of = lambda m: cost([m >> i & 1 == 1 for i in range(n)], score, smooth)
            least = min(map(of, range(1 << n)))
            fits = [m for m in range(1 << n) if [m >> i & 1 == 1 for i in range(len(kept))] == kept]
            assert min(map(of, fits)) < least + 0.01
    assert small > 100


def test_the_cut_decides_labels():
    import pyarrow.parquet as pq

    changed = 0
    for row in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        own = h.parse(row["html"])
        kept = h.minimum_cut(*h.graph(own), len(own.blocks))
        changed += sum((c > 0) != k for c, k in zip(h.block_costs(own), kept, strict=True))
    assert changed > 0


def test_weights_are_those_of_the_training_pages():
    from tests.llm.html_training import labelled

    found = h.fit_costs(*labelled("/root/testdata/sf0.01"))
    assert all((a > 0) == (b > 0) for a, b in zip(found, h.WEIGHTS, strict=True))


TEASER = "A short teaser that tells what the other story is about."
REMARK = "I don't agree with this at all, the author has missed the most important point of the debate."
NAV, FOOT = "<nav><a href=1>Home</a><a href=2>News</a></nav>", "<footer>© Example</footer>"

#: What stands before and after the article, and how the article itself is marked: none of it is in the training pages.
TEMPLATES = {
    "teasers in articles": (NAV + "<article>", "</article><section><h2>Read more</h2>" + f"<article><h3><a href=1>Other</a></h3><p>{TEASER}</p></article>" * 3 + "</section>" + FOOT),
    "remarks in articles": (NAV + "<main><article>", f"</article><section id=discussion><h2>12 replies</h2><article><p>{REMARK}</p></article><article><p>{REMARK} {REMARK}</p></article></section></main>"),
    "remarks without a name": (NAV + "<article>", f"</article><section><h2>Replies</h2><article><p>{REMARK}</p></article></section>" + FOOT),
    "articles in a sidebar": (f"<aside class=related><article><p>{TEASER} {TEASER} {TEASER}</p></article></aside><article>", "</article>" + FOOT),
    "call without an article": ("<div><a href=1>Home</a> <a href=2>News</a></div><div>", "</div><div>Sign up for our newsletter and get the best stories in your inbox every week.</div>"),
    "names of boxes": ("<div class=top-bar><a href=1>Home</a></div><div class=story>", f"</div><div class=share-box>Share</div><div class='reader-comments'><p>{REMARK}</p></div>"),
    "table": ("<table><tr><td><a href=1>Home</a> | <a href=2>News</a></td></tr><tr><td>", "</td></tr><tr><td>© Example <a href=3>Imprint</a></td></tr></table>"),
}


def test_words_of_templates_that_training_never_saw(small):
    """Precision and recall of words over the given articles in other surroundings."""
    import re
    from collections import Counter

    import pyarrow.parquet as pq

    articles = [re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1] for r in pq.read_table(f"{small}/pages.parquet").to_pylist()]
    for name, (before, after) in TEMPLATES.items():
        both = found = wanted = 0
        for article in articles:
            want = Counter(h.main_text(f"<article>{article}</article>").split())
            got = Counter(h.main_text(f"<html><body>{before}{article}{after}</body></html>").split())
            both, found, wanted = both + (want & got).total(), found + got.total(), wanted + want.total()
        print(name, len(articles), round(both / found, 4), round(both / wanted, 4))
        assert both > 0.97 * found and both > 0.97 * wanted, name


def test_articles_compete_by_their_prose():
    main = f"<article><h1>Title</h1><p>{P}</p><p>{P}</p></article>"
    assert h.main_text(f"<article><p>{TEASER}</p></article><div>{main}</div>") == f"Title {P} {P}"
    # parts of one article are siblings of like length; a link's text is no prose
    assert h.main_text(f"<main><article><p>{P}</p></article><article><p>{P} x</p></article></main>") == f"{P} {P} x"
    assert h.main_text(f"<div><article><a href=1>{P} {P} {P}</a></article></div>{main}") == f"Title {P} {P}"
    assert h.main_text("<article></article><article></article>") == ""


def test_names_only_doubt_paragraphs_of_an_article():
    page = f"<article><p>{P}</p><p class=comment>{P}</p><p>{P}</p><p class=share>Share</p><p class=ad>{P}</p><div class=comment><p>{REMARK}</p></div></article>"
    assert h.main_text(page) == f"{P} {P} {P}"
