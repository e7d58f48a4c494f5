"""Worked examples and properties of the core operators, and all SQL checks at the smallest scale."""

import glob
import os

import pytest
from hypothesis import given, settings, strategies as st

from foliant.functions import plain, text as T
from foliant.operators import assembly, layout, pages, tables
from foliant.sources import diagnostics
from foliant.plans import catalogue
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_parse_layout(spark):
    raw = spark.createDataFrame([(1, "Title: 12,30,880,72 ; junk ; Table :-5, 6,7 ,8"), (2, None), (3, "")], "page_id bigint, raw string")
    got = [tuple(r) for r in layout.parse_layout(raw).orderBy("elem_idx").collect()]
    assert got == [(1, 0, "Title", 12.0, 30.0, 880.0, 72.0), (1, 1, "Table", -5.0, 6.0, 7.0, 8.0)]


def test_resize(spark):
    p = spark.createDataFrame([(1, 1754, 1240), (2, 0, 10)], "page_id bigint, height int, width int")
    assert [tuple(r) for r in layout.resized(p).orderBy("page_id").collect()] == [(1, 1216, 832, 988), (2, None, None, None)]


def test_cells_to_html(spark):
    raw = "<ched>year<ched>sales<nl><fcel>2024<fcel>1,204<nl><fcel>a &lt; b<lcel><nl>"
    t = spark.createDataFrame([(1, 0, raw)], "page_id bigint, elem_idx int, raw string")
    assert tables.to_html(t).first().html == '<table><tr><th>year</th><th>sales</th></tr><tr><td>2024</td><td>1,204</td></tr><tr><td colspan="2">a &lt; b</td></tr></table>'


@pytest.mark.parametrize("raw,reason", [("", "empty"), ("<fcel>a", "no_grid"), ("<fcel>a<nl>", "too_few_cells"), ("<fcel>a<fcel>b<nl><fcel>c<fcel>d<nl><fcel>e<fcel>f<nl>", ""), ("<fcel>a<fcel>b<fcel>c<nl>" * 3 + "<fcel>d", "truncated"), ("<lcel><lcel><nl><lcel><lcel><nl>", "no_html_cells")])
def test_validate(spark, raw, reason):
    t = spark.createDataFrame([(1, 0, raw)], "page_id bigint, elem_idx int, raw string")
    assert tables.validate(t).first().reason == reason


cell = st.text("abc ", max_size=4).map(lambda s: " ".join(s.split()))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(cell, min_size=2, max_size=2), min_size=1, max_size=4))
def test_similarity_of_itself(rows):
    h = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    assert tables.similarity(h, h) == 1.0
    assert tables.html_to_tokens(h).count("<nl>") == len(rows)


def test_html_to_tokens_spans():
    h = '<table><tr><th rowspan="2">a</th><td colspan="2">b</td></tr><tr><td>c<br>d</td><td></td></tr></table>'
    assert tables.html_to_tokens(h) == "<ched>a<fcel>b<lcel><nl><ucel><fcel>c d<ecel><nl>"
    assert tables.html_to_tokens("text") is None
    assert tables.similarity("", "") == 1.0 and tables.similarity("", h) == 0.0


def test_formula(spark):
    rows = [("$$ {a} + \\left( b \\right) $$", "a+(b)"), ("(9) \\quad x", "x"), ("\\leftarrow", "arrow"), (None, "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    assert [r.k for r in df.select(T.formula_key(F.col("t")).alias("k")).collect()] == [r[1] for r in rows]


def test_scores(spark):
    s = "page_id bigint, elem_idx int, label string, x0 double, y0 double, x1 double, y1 double"
    gold = spark.createDataFrame([(1, 0, "Text", 0.0, 0.0, 10.0, 10.0), (1, 1, "Text", 0.0, 20.0, 10.0, 30.0)], s)
    pred = spark.createDataFrame([(1, 0, "Text", 0.0, 20.0, 10.0, 30.0), (1, 1, "Text", 0.0, 0.0, 10.0, 10.0)], s)
    r = layout.layout_scores(pred, gold).first()
    assert (r.matched, r.precision, r.recall, r.f1, r.order_tau) == (2, 1.0, 1.0, 1.0, -1.0)


def test_bands_cover_the_page(spark):
    e = spark.createDataFrame([(1, 0.0, 200.0), (1, 100.0, 400.0), (2, None, None)], "page_id bigint, y0 double, y1 double")
    assert sorted(tuple(r) for r in layout.bands(e).collect()) == [(1, 400.0, 1000.0), (2, 0.0, 1000.0)]


def test_gap_fill(spark):
    m = spark.createDataFrame([(1, 0, 0), (1, 1, None), (1, 2, 2), (1, 3, None), (1, 4, 9)], "page_id bigint, pos int, idx int")
    assert [r.idx for r in assembly.gap_fill(m).orderBy("pos").collect()] == [0, 1, 2, None, 9]


ELEMENT = "page_id bigint, elem_idx int, label string, x0 double, y0 double, x1 double, y1 double, text string"


def test_empty_tables(spark):
    e = spark.createDataFrame([], ELEMENT)
    t = spark.createDataFrame([], "page_id bigint, elem_idx int, label string, raw string")
    parts = pages.page_parts(e, t)
    assert pages.assembled(parts).count() == 0 and layout.column_bands(e).count() == 0 and pages.merged_pages(parts).count() == 0
    assert tables.to_html(t).count() == 0 and tables.cells(t).count() == 0


@pytest.mark.parametrize("raw,html", [("", "<table></table>"), (None, "<table></table>"), ("<ched>연도<ched>매출<nl><fcel>2024<fcel>1,204<nl>", "<table><tr><th>연도</th><th>매출</th></tr><tr><td>2024</td><td>1,204</td></tr></table>"), ("<fcel>a&nbsp;&#39;&eacute;<fcel>b<nl><ucel><lcel><nl>", '<table><tr><td rowspan="2">a\xa0&#x27;é</td><td>b</td></tr><tr></tr></table>'.replace("<tr></tr>", ""))])
def test_html_of(raw, html):
    assert tables.html_of(raw) == html


def test_ragged_looping_table_stays_small():
    assert len(tables.grid_of("<fcel>a<nl>" * 5000 + "<fcel>b" * 3000)) == 5001


@pytest.mark.parametrize(
    "html,rows",
    [("<table><thead><tr><td>a</td></tr></thead><tr><td colspan='x'>b</td><th rowspan=2>c<p>d</p></th></tr></table>", [[(1, 1, "a", True)], [(1, 1, "b", False), (2, 1, "c d", True)]]),
     ("<table><tr><td>a<table><tr><td>b</td></tr></table>c</td></tr></table>", [[(1, 1, "abc", False)]]), ("<table><tr><td>a &lt; b</td><td>c", []), ("", []), (None, []), ("<table><tr><td>a</td></tr></table><table><tr><td>b</td></tr></table>", [[(1, 1, "a", False)], [(1, 1, "b", False)]])],
)
def test_parsed_rows(html, rows):
    assert tables.parsed_rows(html) == rows


def test_every_kind_of_space(spark):
    t = "\n\u3000# *A*\u00a0b \t\u2003C\u3000\n"
    r = spark.createDataFrame([(t,)], "t string").select(T.strip(F.col("t")).alias("s"), T.squash(F.col("t")).alias("q"), T.collapse(F.col("t")).alias("c"), T.plain_key(F.col("t")).alias("k"), T.block_key(F.col("t")).alias("b")).first()
    assert (r.s, r.q, r.c, r.k, r.b) == (t.strip(), plain.squash(t), " ".join(t.split()), "abc", "abc") and plain.plain_key(t) == "abc"


line = st.sampled_from(["a", "", " \u3000", "<table>", "<tr>", "</table>", "x <TABLE> y", "b c"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(line, max_size=8).map("\n".join), min_size=1, max_size=6))
def test_page_blocks(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r.b for r in df.select(T.page_blocks(F.col("t")).alias("b")).collect()] == [plain.page_blocks(t) for t in texts]


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_edit_share_of_any_script(spark):
    pairs = [("한국어 글", "한국 글"), ("é", "e"), ("a\u3000b", "a b"), ("", ""), (None, "x"), ("абв", "")]
    got = [r.n for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(T.edit_share(F.col("a"), F.col("b")).alias("n")).collect()]
    clean = [(" ".join((a or "").split()), " ".join((b or "").split())) for a, b in pairs]
    assert got == pytest.approx([brute_distance(a, b) / max(len(a), len(b), 1) for a, b in clean])


@pytest.mark.parametrize("key,most,found", [("abcdef", 0, True), ("abXdef", 0, False), ("abXdef", 1, True), ("abdef", 1, True), ("abccdef", 1, True), ("aXcdXf", 1, False), ("aXcdXf", 2, True)])
def test_within(key, most, found):
    assert assembly.within("xxabcdefyy", key, most) is found


def page(els, md, **more):
    made = [pages.Element(i, label, box, text) for i, (label, box, text) in enumerate(els)]
    return pages.Page(made, md, **more)


GRID = "<fcel>alpha<fcel>beta<nl><fcel>gamma<fcel>delta<nl>"
BROKEN = "<fcel>a<fcel>b<fcel>c<nl>" * 3 + "<fcel>d"
BOX = (100, 100, 900, 300)


def test_merge_into_page():
    html = tables.html_of(GRID)
    p = page([("Page-header", BOX, "Harbour Journal"), ("Table", BOX, GRID), ("Text", BOX, "Body text of the page")], "Harbour Journal\n\nFirst words\n\n| x | y |\n\ngamma\n\n12")
    md, n = pages.merge_into_page(p)
    assert md == f"First words\n\n{html}" and (n["furniture"], n["by_block"], n["cell_blocks"]) == (2, 1, 1)
    md, n = pages.merge_into_page(p, place="append", fill=True)
    assert md == f"First words\n\n| x | y |\n\n{html}\n\nBody text of the page" and n["body_filled"] == 1
    prose = page([("Table", BOX, GRID)], "alpha beta gamma delta\n\nOther words here")
    assert pages.merge_into_page(prose, place="anchor")[0] == f"{html}\n\nOther words here"
    twice = page([("Table", BOX, GRID)], "alpha beta gamma delta!\n\nalpha beta gamma delta?")
    md, n = pages.merge_into_page(twice, place="anchor")
    assert n["abstained"] == 1 and md.endswith(html)
    low = page([("Table", (0, 480, 1000, 700), GRID)], "one and more\n\ntwo and more")
    assert pages.merge_into_page(low, place="append", by_position=True)[0] == f"one and more\n\n{html}\n\ntwo and more"
    tiny = page([("Table", (0, 0, 2, 2), GRID)], "one")
    assert pages.merge_into_page(tiny) [1]["tiny"] == 1
    assert pages.merge_into_page(page([], None))[0] == ""


def test_merge_into_elements():
    p = page([("Table", BOX, GRID), ("Table", (100, 300, 900, 500), BROKEN)], "New words that nobody read\n\n| a | b |")
    els, n = pages.merge_into_elements(p)
    assert [(e.label, e.how) for e in els] == [("Text", "band_filled"), ("Table", ""), ("Table_html", "table_replaced")]
    assert els[2].text == "| a | b |" and (n["bad"], n["replaced"], n["reason truncated"], n["bands"], n["bands_filled"]) == (1, 1, 1, 2, 1)


def test_match_blocks():
    els = page([("Title", BOX, "A title of some length"), ("Text", BOX, "something quite unread"), ("Page-footer", BOX, "12"), ("Text", BOX, "the last of the words on this page")], "").elements
    blocks = ["# A title of some length", "zzzz yyyy xxxx wwww", "the last of the words on this page"]
    assert pages.match_blocks(blocks, els) == [0, None, 3]  # two elements lie between, one block
    del els[2]
    assert pages.match_blocks(blocks, els) == [0, 1, 2]


def test_run_isolates_errors(spark, monkeypatch):
    e = spark.createDataFrame([(1, 0, "Title", 0.0, 0.0, 9.0, 9.0, ""), (1, 0, "Title", 0.0, 0.0, 9.0, 9.0, ""), (2, 0, "Text", None, None, None, None, "words")], ELEMENT)
    md = spark.createDataFrame([(1, "one"), (3, "whole page")], "page_id bigint, md string")
    parts = pages.page_parts(e, None, md)
    got = {r.page_id: r.md for r in pages.run(parts, "coarse-to-fine").collect()}
    assert got == {1: "# ", 2: "words", 3: "whole page"}
    assert {r.page_id: (r.md, r.error is None) for r in pages.run(parts, "page", wrong=1).collect()}[1] == ("one", True)
    bad = pages.run(parts, "hybrid", wrong=1).filter("error is not null").collect()
    assert {r.page_id for r in bad} == {1, 2} and all(r.md == "" for r in bad)
    from pyspark.sql import Observation

    seen = Observation("pages")
    out = pages.run(parts, "hybrid").observe(seen, F.count("*").alias("n"), F.count("error").alias("errors"))
    out.count()
    assert seen.get == {"n": 3, "errors": 0}
    with pytest.raises(ValueError):
        pages.run(parts, "other")


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "# A\n\nb"), ("b", "")], "name string, value string")
    diagnostics.write_files(rows, "name", "value", str(tmp_path / "md"))
    assert {(r.name, r.value) for r in diagnostics.read_files(spark, str(tmp_path / "md")).collect()} >= {("a", "# A\n\nb")}
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "x.png").write_bytes(b"1")
    (tmp_path / "images" / "x.txt").write_bytes(b"1")
    assert [r.length for r in diagnostics.images(spark, str(tmp_path / "images")).collect()] == [1]
    names = spark.createDataFrame([("/a/b.c.png",), ("d",)], "p string")
    assert [r.s for r in names.select(diagnostics.stem(F.col("p")).alias("s")).collect()] == ["b.c", "d"]


def test_edge_lines(spark):
    md = "Summary\n2025. 1. 31. 기준\n| 17\nBody text that is longer than a label should ever be\n<table>\n12\n</table>\n" + "x y z.\n" * 9 + "12/34\nXVII"
    df = spark.createDataFrame([(1, md), (2, None), (3, "")], "page_id bigint, md string")
    assert [r.line for r in assembly.edge_lines(df).orderBy("pos").collect()] == ["Summary", "2025. 1. 31. 기준", "| 17", "12/34", "XVII"]
    kept = {r.page_id: r.md for r in assembly.without_edge_lines(df).collect()}
    assert kept[1].startswith("Body text") and "12\n</table>" in kept[1]


def test_shards_follow_the_paths(spark):
    p = spark.createDataFrame([(1, "a/b/x"), (2, "a/b-c/y"), (3, "a/b/z")], "page_id bigint, path string")
    assert {r.page_id: r.shard for r in assembly.sharded(p, 3).collect()} == {1: 1, 2: 0, 3: 2}


def test_bootstrap(spark):
    s = spark.range(400).select(F.col("id").alias("page_id"), (F.col("id") % 2).cast("double").alias("score"))
    r = assembly.bootstrap(s).first()
    assert r.mean == 0.5 and 0.44 < r.low < 0.46 and 0.54 < r.high < 0.56 and r.accept


def test_confusions(spark):
    p = spark.createDataFrame([("tbe rnap", "the map"), ("tbe", "the"), (None, "x"), ("a", "a")], "read string, meant string")
    assert {(r.wrong, r.right): r.n for r in assembly.confusions(p).collect()} == {("b", "h"): 2, ("rn", "m"): 1}


def test_css_and_crops(spark):
    from foliant.functions import boxes

    b = spark.createDataFrame([(10.0, 20.0, 110.0, 220.0)], "x0 double, y0 double, x1 double, y1 double")
    assert b.select(boxes.css(F.struct("x0", "y0", "x1", "y1")).alias("c")).first().c == "left:1.0%;top:2.0%;width:10.0%;height:20.0%"


def _norm(v):
    return "None" if v is None else f"{float(v):.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        q = p + "/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{q}')")
    df = catalogue.queries()[name](spark, SF)
    r = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(_norm(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())
    assert sorted(tuple(_norm(row[c]) for c in sorted(names)) for row in df.collect()) == want


def test_stream_takes_each_element_once(spark, tmp_path):
    from foliant.streaming.ingest import ingest

    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    rows = "select 1L page_id, {i} elem_idx, 'a' text, timestamp'2024-01-0{i} 00:00:00' arrived_at"
    for k in (1, 2, 1):
        spark.sql(rows.format(i=k)).coalesce(1).write.mode("append").parquet(src)
        ingest(spark, src, spark.read.parquet(src).schema, out, at)
    assert sorted(r.elem_idx for r in spark.read.parquet(out).collect()) == [1, 2]
