import html
import random
import re
import time

import pytest

from logsift.llm.html_text import Grid, render, with_visible_text

CASES = [
    ("", ""),
    ("plain", "plain"),
    ("<p>a<p>b<br>c<div>d</div>e", "a\n\nb\nc\n\nd\ne"),
    ("<h1>T</h1><div>x</div><div>y</div>", "T\n\nx\ny"),
    ("<ul><li>one<li>two<ul><li>x<li>y</ul><li>three</ul><p>z", "- one\n- two\n  - x\n  - y\n- three\n\nz"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<ol reversed start=2><li>a<li>b</ol>", "2. a\n1. b"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<blockquote><p>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<table><caption>cap</caption><tr><th>Name<th>N<tr><td>alpha<td>1</table>after", "cap\nName   N\nalpha  1\n\nafter"),
    ("<table><tr><td>a<td>b<td>c<tr><td rowspan=2>r<td>1<td>x<tr><td>2<td>y</table>", "a  b  c\nr  1  x\n   2  y"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>1<td>2<td>3</table>", "wide cell  z\n1  2       3"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table>loose<tr><td><table><tr><td>in<td>ner</table><td>o</table>", "loose\n\nin  ner  o"),
    ("a &amp; b &lt;c&gt; &copy 5 < 6 <!-- no --> ok", "a & b <c> © 5 < 6 ok"),
    ("<div hidden>no</div><div style='display: none'>no<p>no</div>y", "y"),
    ("<span style='visibility:hidden'>no<i style='visibility:visible'>yes</i></span>", "yes"),
    ("<pre>\n a\n  b\n\nc</pre>d", " a\n  b\n\nc\n\nd"),
    ("<details><summary>s</summary>no<p>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<head><title>t</title><style>p{}</style></head><body>x<script>if(a<b){'</p>'}</script>y", "xy"),
    ("<b>x<p>y</b>z</p>w", "x\n\nyz\n\nw"),
    ("a</p>b", "a\n\nb"),
    ("<p title='a>b'>x</p><a title=it's>y</a>", "x\n\ny"),
    ("x<input type=submit value=Go><input type=hidden value=no>", "xGo"),
    ("a<br><br>b", "a\n\nb"),
    ("  a \n b\t<b> c</b>d ", "a b cd"),
    ("x<![CDATA[y]]>z<?php no ?>w", "xzw"),
    ("end<p class='", "end"),
    ("a\0b&nbsp;&nbsp;c", "ab  c".replace("  ", "  ")),
]


@pytest.mark.parametrize("markup,text", CASES)
def test_layout(markup, text):
    assert render(markup) == text


def test_time_grows_in_proportion():
    for bad in ("<div>", "<ul><li>", "<table><tr><td>", "<p><b>", "<", "<a b='", "&", "<!--", "<i></section>"):
        began = time.process_time()
        assert isinstance(render("<section>" + bad * 8000 + "tail"), str)
        assert time.process_time() - began < 5, bad


def test_no_text_is_lost_at_any_depth():
    assert render("<div>" * 2000 + "x" + "<p>y" * 100).split() == ["x"] + ["y"] * 100


def visible_words(markup):
    """Words by plain removal: good for pages without hidden parts other than head, script and style."""
    markup = re.sub(r"(?is)<!--.*?(-->|$)|<(script|style|title)\b.*?(</\2>|$)", "", markup)
    markup = re.sub(r"<[^>]*$", "", markup)
    markup = re.sub(r"(?i)</?(a|b|i|em|span)\b[^>]*>", "", markup)
    return html.unescape(re.sub(r"<[^>]*>", " ", markup)).split()


def test_query_holds_every_visible_word(spark, sf_mid):
    from logsift.llm.queries import op1_html_layout
    got = {r.page_id: r for r in op1_html_layout(spark, sf_mid).collect()}
    pages = spark.read.parquet(f"{sf_mid}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert [w for w in r.text.split() if w != "-"] == [w for w in visible_words(p.html) if w != "-"], p.page_id
        assert r.n_chars == len(r.text) and r.n_lines == (r.text.count("\n") + 1 if r.text else 0)


def test_frames(spark):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (2, None, None), (None, "", "y"), (3, "<p>" + "w " * 200_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r.page_id or 0, len(r.text)) for r in with_visible_text(pages).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 399_999)]
    assert with_visible_text(pages.limit(0)).count() == 0


def test_formulas_and_drawings_show_their_text():
    page = ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> b</p><svg><title>t</title><defs><text>d</text>"
            "</defs>loose<path d='M0'/><text>one</text><text>two</text></svg><p>end")
    assert render(page).split() == ["a", "x=2", "b", "one", "two", "end"]
    assert render("<svg><text/><path>gone<p>seen") == "seen"


def test_hidden_elements_and_lists_stay_whole_at_any_depth():
    deep = "<b>" * 700
    assert render(deep + "<div hidden><i>no</i>no</div><ol><li>one<li>two</ol>") == "1. one\n2. two"
    assert render("<ul><li>x" * 2000).count("- x") == 2000
    assert render("<b><div>" + "<span>" * 20_000 + "</b>" * 20_000 + "x") == "x"


def laid_out(table):
    """Cell places by the plain rule: each cell takes the next column that no cell from above or before holds."""
    held, out = set(), []
    for r, row in enumerate(table):
        at, cells = 0, []
        for text, across, down in row:
            while (r, at) in held:
                at += 1
            cells.append((at, across, text))
            held |= {(r + i, c) for i in range(1, down) for c in range(at, at + across)}
            at += across
        out.append(cells)
    return out


def test_cells_stand_in_their_columns():
    """Random tables with spans both ways, against the plain rule: equal columns start at equal places, and later
    columns never before earlier ones end."""
    rnd = random.Random(8)
    for _ in range(300):
        table = [[("w" * rnd.randint(1, 90), rnd.choice((1, 1, 1, 2, 5)), rnd.choice((1, 1, 2, 4))) for _ in range(rnd.randint(0, 6))]
                 for _ in range(rnd.randint(1, 7))]
        grid = Grid()
        for row in table:
            grid.row()
            for text, across, down in row:
                grid.cell([text], across, down)
            grid.end_row()
        want = laid_out(table)
        assert [[(at, across, lines[0]) for at, across, lines in row] for row in grid.rows] == want
        start = grid.aligned()
        lines = iter(grid.lines())
        for row in want:
            if not row:
                continue
            line = next(lines)
            assert line.split() == [text for _, _, text in row]
            reach = 0
            for at, _, text in row:
                assert start[at] >= reach and line[start[at]:].startswith(text)
                reach = start[at] + len(text) + 2


def test_wide_columns_are_aligned():
    text = render("<table><tr><td>" + "x" * 300 + "<td>b<td>c<tr><td>1<td>2<td>3</table>")
    first, second = text.split("\n")
    assert second.index("2") == first.index("b") == 302 and second.index("3") == first.index("c")


def test_spans_cost_in_proportion():
    """100 KB of wide and deep spans, of deep ones that end in different rows, and output that alignment must not blow up."""
    for cell in ("<tr><td colspan=1000 rowspan=60000>x", "<td rowspan=9999>x", "<tr><td colspan=999>x<td rowspan=7>y"):
        began = time.perf_counter()
        assert "x" in render("<table>" + cell * (100_000 // len(cell)) + "</table>")
        assert time.perf_counter() - began < 2
    deep = "".join(f"<td rowspan={9000 - i}>" for i in range(2_000)) + "<tr><td>z" * 6_000
    began = time.perf_counter()
    text = render("<table><tr>" + deep + "</table>")
    assert text.count("z") == 6_000 and time.perf_counter() - began < 6
    wide = "<table><tr><td>" + "x" * 50_000 + "<td>y" + "<tr><td>1<td>2" * 5_000 + "</table>"
    assert len(render(wide)) < 50 * len(wide)


def test_values_of_inputs_are_shown():
    assert render("<input value=seen> <input type=text value=too><input type=password value=no><input type=hidden value=no>"
                  "<input type=checkbox value=no>") == "seen too"
