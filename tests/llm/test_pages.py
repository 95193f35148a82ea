"""Main text against pages whose article is known."""

import html
import re

import duckdb
from awkward import LONG


def known(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", article)
    return " ".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split())))


def pages():
    return [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' order by page_id").fetchall()]


def test_articles_and_masked_articles():
    from reflexgrid.llm.pages import fit

    every = pages()
    model = fit(every[:100])
    for page in every[100:]:
        assert model.extract(page) == known(page)
        assert model.extract(page.replace("<article>", "<div>").replace("</article>", "</div>")) == known(page)


def test_other_layouts_and_broken_pages():
    from reflexgrid.llm.pages import Model, fit

    story = "<h1>Title here</h1><p>First paragraph of the story, with some length. And another, too.<p>Last &amp; final&nbsp;one<b>bold</b>end.</p>"
    want = "Title here First paragraph of the story, with some length. And another, too. Last & final oneboldend."
    around = '<header>Site <a href=/>home</a></header><div class="cookie-notice">We use cookies. Accept them.</div>{}<section id="comments"><p>Great post, I liked it. Thanks!</p></section><footer>(c) me</footer>'
    for model in (Model(), fit(pages()[:60])):
        for tag in ("main", "article", "div"):
            assert model.extract(around.format(f"<{tag}>{story}<aside>Related: <a>x</a></aside><form>Sign up <input></form></{tag}>")) == want
        assert model.extract("") == "" and model.extract("<p") == "" and model.extract("<script>var x = '<p>no</p>';</script>") == ""
        assert model.extract("<div>" * 5000 + "deep text. here, it is.") == "deep text. here, it is."
        assert model.extract("<p>" + LONG) == LONG


def test_sum_product_against_all_states():
    from itertools import product
    from math import exp

    from reflexgrid.llm.pages import Model, features, parse

    nodes = parse("<div><p>Some text, here. And more.</p><ul><li><a>x</a></ul></div><p>last")
    model = Model()
    own = [sum(model.weights.get(f, 0.0) for f in features(n)) for n in nodes]
    total, yes = 0.0, [0.0] * len(nodes)
    for state in product((0, 1), repeat=len(nodes)):
        w = exp(sum(o * s for o, s in zip(own, state, strict=True)) + sum(model.table[state[n.parent]][s] for n, s in zip(nodes[1:], state[1:], strict=True)))
        total += w
        for i, s in enumerate(state):
            yes[i] += w * s
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(nodes), yes, strict=True))


def test_pages_table(spark):
    from pyspark.sql import functions as F

    from reflexgrid.llm.pages import main_text, train

    rows = [(1, "u", "<article><p>One text, long enough to be read. Yes.</p></article>"), (1, "u", "<article><p>One text, long enough to be read. Yes.</p></article>"), (2, None, None), (None, "u", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("key", "text", "n_chars", "keep_url")})
    out = main_text(df, train(df)).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in out) == [(0, "u", "", 0), (1, "u", "One text, long enough to be read. Yes.", 38), (1, "u", "One text, long enough to be read. Yes.", 38), (2, "", "", 0)]
    assert main_text(df.where("false"), train(df.where("false"))).count() == 0


def test_wrapper_names_say_nothing_of_the_article():
    from reflexgrid.llm.pages import fit

    model = fit(pages()[:100])
    body = "".join(f"<p>Paragraph {i} tells a good deal about the matter, and it goes on with several sentences. It is long enough to be read. So it goes on for a while, with commas, and ends here.</p>" for i in range(5))
    text = " ".join(re.findall(r"<p>(.*?)</p>", body))
    nav = '<div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></div>'
    remarks = '<div class="comments"><article class="comment"><p>I do not agree with this at all, says a reader.</p></article><article><p>Nor do I.</p></article></div>'
    for name in ("has-sidebar", "comments-open", "page-header", "layout with-sidebar", ""):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
            assert model.extract(f'<html><body class="{name}">{nav}{inner}</body></html>') == text
            assert model.extract(f'<html><body><div class="{name}"><div>{nav}{inner}</div></div></body></html>') == text
        assert model.extract(f'<html><body class="{name}">{nav}<article>{body}</article>{remarks}</body></html>') == text
