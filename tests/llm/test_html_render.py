import html
import time

import pytest

from lodestone.llm import html_render as hr
from lodestone.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("a  b\n c", "a b c"),
        ("<title>t</title><p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b</ul>", "- a\n- b"),
        ("<ol start=9><li>a<li>b<ul><li>c</ul></ol>d", "9. a\n10. b\n    - c\n\nd"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
        ("<table><caption>k</caption><tbody><tr><th>a<td>b</table>x", "k\na  b\n\nx"),
        ("<table><tr><td>a<p>b<td>c</table>", "a  c\n\nb"),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", "a     b\nc  d  e"),
        ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"),
        ("<p hidden>a</p><p style='DISPLAY : none'>b</p><span style='visibility:hidden'>c</span>d", "d"),
        ("<script>var a='</p>';</script><style>p{}</style><noscript>n</noscript>x", "x"),
        ("<textarea>a <b></textarea>", "a <b>"),
        ("&lt;b&gt; &amp; &eacute;&#233;&copy", "<b> & éé©"),
        ("<!-- x --><!doctype html><?php x ?>a<!-- open", "a"),
        ("</p></div>a</b><b>b", "ab"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("<blockquote>a<p>b</blockquote>c", "  a\n\n  b\n\nc"),
        ("a<span>b</span> <b>c</b>", "ab c"),
        ("<input type=hidden value=x><select><option>a<option>b</select>", "a\nb"),
        ("<p>a <", "a <"),
        ("<p>a <b", "a"),
        ("<a title='>'>x</a>", "x"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ],
)
def test_rendering(page, text):
    assert hr.render_page(page) == text


def test_hard_pages_end_soon():
    began = time.time()
    for page in (
        "<div>" * 20000 + "x", "<table><tr><td>" * 300 + "x", "<" * 50000, "<a b='" * 10000, "a<!--" * 10000,
        "<p>" * 20000, "<li>" * 20000, "<b" * 20000, "&" * 50000, "<ul>" * 5000 + "<li>x",
    ):
        hr.render_page(page)
    assert time.time() - began < 30


def test_query(spark):
    rows = QUERIES["op3_html_rendering"](spark, FOLDER).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert {r["page_id"] for r in rows} == set(pages)
    for r in rows:
        assert "track(" not in r["text"] and "margin:0" not in r["text"] and "<p" not in r["text"]
        title = pages[r["page_id"]].split("<h1>")[1].split("</h1>")[0]
        assert " ".join(html.unescape(title).split()) in r["text"]


def test_odd_rows(spark):
    pages = spark.createDataFrame(
        [(None, None, "x"), (1, "<p>a", "y"), (1, "<p>a", "y")], "page_id long, html string, text string"
    )
    got = sorted((r["page_id"] or 0, r["text"]) for r in hr.render_pages(pages).collect())
    assert got == [(0, ""), (1, "a"), (1, "a")]
    assert hr.render_pages(pages.limit(0)).count() == 0


def test_what_stands_in_no_cell_goes_before_the_table():
    def lines(page):
        return [x for x in hr.render_page(page).split("\n") if x]

    assert lines("<table><tr><td>a</td>stray<td>b</table>") == ["stray", "a  b"]
    assert lines("<p>x</p><table>Note<tr><td>a</table>end") == ["x", "Note", "a", "end"]
    assert lines("<table><tbody><b>one <i>two</i></b><tr><td>a</td><div>three</div><td>b</table>") == [
        "one two", "three", "a  b",
    ]
    assert lines("<table><colgroup><col>lost<tr><td>a</table>") == ["lost", "a"]
    assert lines("<table><tr><td><table>in<tr><td>x</table></table>") == ["in", "x"]
    assert lines("<table> <tr> <form><td>a</td></form> </tr> </table>") == ["a"]
    assert lines("<table><tr><td>a<table><tr><td>b</table>c</table>") == ["a", "b", "c"]


def test_cells_of_several_rows_keep_columns():
    def table(inner):
        return [x for x in hr.render_page(f"<table>{inner}</table>").split("\n") if x]

    assert table("<tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>d<td>e") == ["aa  b", "    c", "d   e"]
    assert table("<tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e") == ["a  b    c", "d       e"]
    assert table("<tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e") == ["a  b", "   c", "d  e"]
