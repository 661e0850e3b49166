from html.parser import HTMLParser
from itertools import product

import pytest

from stratalens.llm import html_tree as H, queries as Q


@pytest.fixture(scope="module")
def model():
    return H.fit(H.labelled_pages())


def test_messages_equal_enumeration(model):
    page = H.labelled_pages(1, 5)[0]
    nodes = H.parse("<body><div><p>One two.</p><nav><li>x</li></nav></div><article><h1>T</h1><p>Long text here.</p></article></body>")
    texts = [H._tidy(x) for x in nodes]
    import math

    total, on = 0.0, [0.0] * len(nodes)
    for ys in product((0, 1), repeat=len(nodes) - 1):
        ys = (0, *ys)
        w = 1.0
        for i in range(1, len(nodes)):
            z = model.bias + sum(model.weights.get(f, 0.0) for f in H.evidence(nodes[i], texts[i]))
            p = 1 / (1 + math.exp(-z))
            w *= (p if ys[i] else 1 - p) * model.pair[H.kind(nodes[i])][ys[nodes[i].parent]][ys[i]]
        total += w
        for i, y in enumerate(ys):
            on[i] += w * y
    assert model.marginals(nodes, texts) == pytest.approx([x / total for x in on], abs=1e-9)
    assert page.count("data-y")


def test_unseen_labelled_pages(model):
    good = bad = missed = 0
    for page in H.labelled_pages(150, 77):
        nodes = H.parse(page)
        texts = [H._tidy(x) for x in nodes]
        for x, t, p in zip(nodes, texts, model.marginals(nodes, texts)):
            if t and x.y is not None:
                good += len(t) * (p > 0.5 and x.y == 1)
                bad += len(t) * (p > 0.5 and x.y == 0)
                missed += len(t) * (p <= 0.5 and x.y == 1)
    assert good / (good + bad) > 0.97 and good / (good + missed) > 0.97


def test_page_like_the_tables(model):
    page = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">The</a></li><li><a href="/b">and</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div><article><h1>Head &amp; line</h1><p><b>First\n  one.<br><p>Second &eacute; para.</p><p>Third<br>line.</p></article><footer>&copy; host &middot; Words here.</footer>'
    assert model.extract(page) == "Head & line First one. Second é para. Third line."


def test_edges(spark, model, tmp_path):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>" * 3000 + "x"), (4, "u", "just text"), (5, "u", "<a <b> <!-- <p>lost"), (6, "u", "<article>" + "<p>Some words here.</p>" * 20_000), (6, "u", "<article><p>1 &lt; 2 and 3 > 2.</p></article>")]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Q.op5_html_extraction(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.n_chars): r.text for r in got}
    assert by[1, 0] == by[2, 0] == ""
    assert by[4, 9] == "just text"
    assert (6, 20_000 * 17 - 1) in by and "1 < 2 and 3 > 2." in by.values()


def said(page):
    return [t for x in H.parse(page) if (t := H._tidy(x))]


def test_hidden_elements_end_in_the_tree(model):
    # </head> may be left out, and </header> does not end it
    page = "<html><head><title>t</title><meta charset=x><body><header><p>Top</header><article><h1>Head line</h1><p>First long sentence here.<p>Second one, as long.</article>"
    assert said(page) == ["Top", "Head line", "First long sentence here.", "Second one, as long."]
    assert "First long sentence here. Second one, as long." in model.extract(page)
    assert said("<head><title>t</title><p>Body without its tags.") == ["Body without its tags."]
    # an end tag's name is whole
    assert said("<p>a<script>x = '</scripts>' </script >b") == ["ab"] and said("<title>t</titles><p>no</title><p>b") == ["b"]
    # a slash ends svg and math, and only them; a value without quotes may end in one
    assert said("<p>a<svg width='1'/>b<math/>c<svg class=x/>d</svg>e") == ["abce"]
    assert said("<div>a<video/>b</div><p>c") == ["a", "c"]
    # inside svg and math, and what ends them
    assert said("<p>a<svg><title/><path/><text>x</text><style/></svg>b") == ["ab"]
    assert said("<div><svg><path d='M0'></div><p>b") == ["b"] and said("<svg><g><circle><p>b") == ["b"]
    assert said("<svg><foreignObject><p>x</p><script>'</svg>'</script></foreignObject><p>b") == ["b"]
    # without end tags they end with their block
    for tag in "object audio video canvas select template".split():
        assert said(f"<div><p>a<{tag} x=1>gone</div><p>b") == ["a", "b"], tag
        assert said(f"<div>a<{tag}><div>x</div>gone</{tag}>b</div>") == ["ab"], tag
    assert said("<select><option>x<input><p>b") == said("<select><option>x<select><p>b") == ["b"]
    assert said("<table><tr><td>a<template><tr><td>x</template>b<td>c") == ["ab", "c"]


def test_many_children_equal_enumeration(model):
    """30 alike children: their joint sum by counts instead of all 2^30 labellings."""
    import math

    nodes = H.parse("<article>" + "<p>Some words here, and more of them.</p>" * 30 + "</article>")
    texts = [H._tidy(x) for x in nodes]
    z = lambda i: model.bias + sum(model.weights.get(f, 0.0) for f in H.evidence(nodes[i], texts[i]))
    local = lambda i, y: 1 / (1 + math.exp(-z(i) if y else z(i)))
    top, low = model.pair[H.kind(nodes[1])], model.pair[H.kind(nodes[2])]
    total, on, kid = 0.0, 0.0, 0.0
    for y in (0, 1):
        for k in range(31):
            w = top[0][y] * local(1, y) * math.comb(30, k) * (low[y][1] * local(2, 1)) ** k * (low[y][0] * local(2, 0)) ** (30 - k)
            total, on, kid = total + w, on + w * y, kid + w * k / 30
    got = model.marginals(nodes, texts)
    assert got[1] == pytest.approx(on / total, abs=1e-9) and got[2] == pytest.approx(kid / total, abs=1e-9) and got[31] == pytest.approx(got[2])


def test_hostile_markup_takes_linear_time():
    import time

    shapes = ["<a ", "<span><p>x</p>", '<a ">" ', "<!x", "<p><object><span>", "<span><input>", "<select><b>", "</b", "<![CDATA[", "<i><li>", "&#9", "<table><tr><td><font>"]
    for shape in shapes:
        took = []
        for n in (20_000, 80_000):
            page = "<object>" * (shape == "<span><input>") + shape * n + '"' * (shape[-2:] == '" ')
            began = time.process_time()
            H.parse(page)
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 0.2, (shape, took)
    began = time.process_time()
    H.parse("<div " + "a" * 1_000_000 + "> &#" + "9" * 1_000_000 + ";x")
    assert time.process_time() - began < 3


def test_bare_text(model):
    assert model.extract("just text") == "just text"
    assert model.extract("<body>First sentence of it.<br>Second sentence here.<nav><a href=x>Home</a></nav></body>") == "First sentence of it. Second sentence here."
    assert said("a &#00000000065; &#999999999999; b") == ["a A \ufffd b"]


class Article(HTMLParser):
    """Text inside ``article`` but for scripts and styles, read by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.raw = 0
        self.out = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.raw += tag in ("script", "style")
        self.out.append(" " * (tag not in H.INLINE or tag in H.VOID))

    def handle_endtag(self, tag):
        self.out.append(" " * (tag not in H.INLINE))
        self.inside -= tag == "article"
        self.raw -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.out.append(data)


def test_pages_of_the_tables_against_the_standard_parser(spark):
    got = Q.op5_html_extraction(spark, "/root/testdata/sf0.01").collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(got) == len(html) == 250
    for r in got:
        p = Article()
        p.feed(html[r.page_id])
        assert r.text == " ".join("".join(p.out).split())


def test_hidden_parts_and_long_names():
    m = H.fit(H.labelled_pages())
    p = "<p>This is a paragraph of the article with enough words to count as content, surely.</p>"
    text = p[3:-4]
    for gone in ("<div hidden>{}</div>", "<div hidden=''>{}</div>", "<section aria-hidden=true>{}</section>", "<div style='visibility: hidden'>{}</div>", "<div class=adsbygoogle>{}</div>", "<ol class=commentlist><li>{}</li></ol>", "<div class=sponsoredbox>{}</div>"):
        assert m.extract(f"<article>{p}{gone.format('Nobody of the readers sees these words, or nobody should.')}{p}</article>") == f"{text} {text}", gone
    assert m.extract(f"<article>{p}<p>Some text <span class=ad>Buy now!</span> and <i hidden>not this</i> more of it, as it goes on.</p></article>") == f"{text} Some text and more of it, as it goes on."
    assert m.extract(f'<article>{p}<p class="more">And there is more to say about it in this paragraph.</p></article>') == f"{text} And there is more to say about it in this paragraph."


def test_no_pages(spark):
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
