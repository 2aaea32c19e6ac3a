import html
import re
import time

import pytest

from nephos.llm import webpages
from nephos.llm.common import table


def test_held_out_layouts():
    model = webpages.train()
    pages = webpages.made_pages(120, seed=4321)
    marks = [a == b.label for p in pages for a, b in zip(model.decode(p), p, strict=True)]
    assert sum(marks) / len(marks) > 0.985


def test_pages_of_the_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    whole = {r["page_id"]: r["html"] for r in pages.collect()}
    right = 0
    for r in webpages.digest(pages).collect():
        inner = re.sub(r"</?(p|br|h1)\b[^>]*>", " ", re.search(r"<article>(.*)</article>", whole[r["page_id"]], re.S).group(1))
        right += r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert r["n_chars"] == len(r["text"])
    assert right >= 0.98 * len(whole)


def test_viterbi_is_the_best_path():
    model = webpages.fit(webpages.made_pages(40))
    for page in webpages.made_pages(12, seed=9):
        page = page[:9]
        s = model.scores(page)

        def total(path, s=s):
            return sum(x for x, y in zip(s, path, strict=True) if y) + sum(model.step[a][b] for a, b in zip(path, path[1:], strict=False))

        paths = [[m >> i & 1 for i in range(len(page))] for m in range(1 << len(page))]
        assert abs(total(model.decode(page)) - max(map(total, paths))) < 1e-9


def test_edges(spark):
    model = webpages.train()
    rows = [(1, None), (2, ""), (3, "plain"), (4, "<script>var x='<p>no</p>'"), (5, "<!-- open"), (6, "<" * 3000), (7, "<p a='" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' AS url", "'old' AS text")
    got = {r["page_id"]: r["text"] for r in webpages.extract(df, model).collect()}
    assert got[1] == got[2] == got[4] == got[5] == "" and len(got) == 7
    assert webpages.extract(df.where("page_id > 99"), model).count() == 0


@pytest.mark.parametrize("tag", ["<svg-icon name=x></svg-icon>", "<title-bar></title-bar>", "<template-card>", '<svg width="1" d="a>b"/>', "<svg/>", "<svg />"])
def test_markup_like_raw_elements(tag):
    found = webpages.blocks(f"<article>{tag}<p>Main text.</p></article><p>More.</p>")
    assert [b.text for b in found] == ["Main text.", "More."]
    assert [b.text for b in webpages.blocks("<svg width=1><path d=1/><p>no</p></svg><script>x</script><p>yes</p>")] == ["yes"]


def test_hostile_pages_take_linear_time():
    model = webpages.train()
    deep = "<div>x" * 100_000
    pages = ["<p " * 1_700_000, deep, "<b>" * 50_000 + "<li>a</li>" * 50_000, "<!<!" * 100_000, '<svg "' * 100_000 + ">", "</x>" * 99_999 + "<i>" * 99_999 + "</q>" * 99_999]
    pages += ["".join(f"<x{i} class=c{i}>t" for i in range(30_000)), "<p a='" * 100_000 + ">", "&lt;" * 200_000]
    began = time.process_time()
    for page in pages:
        webpages.main_text(page, model)
    assert time.process_time() - began < 60


def test_ends_of_pages_and_references():
    def texts(page):
        return [b.text for b in webpages.blocks(page)]

    assert texts("<p>a<!-- b > c") == texts("a <!-- b") == ["a"]
    assert texts("x<script>a>b") == ["x"] and texts("x<script>a>b</script>y") == ["x", "y"]
    assert texts("&am<b>p;</b> &amp;lt; &#65;&nbsp;b") == ["&amp; &lt; A b"]
    assert texts("a < b <c") == ["a < b <c"] and texts("<p>a</p> 1 > 0 <b") == ["a", "1 > 0 <b"]


@pytest.mark.parametrize(("start", "end"), [("<article>", "</article>"), ("<div>", "</div>"), ("", ""), ('<section class="main">', "</section>")])
def test_pages_of_the_table_in_other_containers(spark, sf_dir, start, end):
    """Trained without the table, by made pages alone, whatever holds the article."""
    model = webpages.train()
    pages = [r["html"] for r in table(spark, sf_dir, "pages").collect()]
    right = 0
    for page in pages:
        inner = re.sub(r"</?(p|br|h1)\b[^>]*>", " ", re.search(r"<article>(.*)</article>", page, re.S).group(1))
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        right += webpages.main_text(page.replace("<article>", start).replace("</article>", end), model) == want
    assert right >= 0.95 * len(pages)
