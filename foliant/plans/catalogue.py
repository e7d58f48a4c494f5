"""The registered queries of the core operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from foliant.functions import text as T
from foliant.operators import assembly, layout, pages, tables
from foliant.sources import diagnostics
from foliant.sources.tables import elements, table

_SPARK: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _SPARK[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _el(s: SparkSession, d: str) -> DataFrame:
    """Elements, the first delivery of each."""
    return elements(s, d).select("page_id", "elem_idx", "label", *(F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")), "text", "from_band", "volume_id")


def _tr(s: SparkSession, d: str) -> DataFrame:
    """Traces, one for each element; a trace delivered twice is the same."""
    rest = ("label", "raw", "html", "stop")
    return table(s, d, "layout").groupBy("page_id", "elem_idx").agg(F.min(F.struct(*rest)).alias("r")).select("page_id", "elem_idx", "r.*")


def _tables(s: SparkSession, d: str) -> DataFrame:
    return _tr(s, d).filter("label = 'Table'")


def _grid(s: SparkSession, d: str) -> DataFrame:
    return tables.cells(_tables(s, d))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_image").select("page_id", "width", "height")


def _kept(s: SparkSession, d: str) -> DataFrame:
    """Elements of the first pass over a page, before bands were read again."""
    return _el(s, d).filter("not coalesce(from_band, false)")


def _md(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("md"))


# White space and trimming as DuckDB writes them; Spark's come from the text functions.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _squash(c: str) -> str:
    return f"regexp_replace({c}, '{WS}+', '', 'g')"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def _plain(c: str) -> str:
    return f"lower({_squash(f"regexp_replace({c}, '^[#>*|:{WS[1:-1]}-]+|[*_`]+', '', 'g')")})"


def _block(c: str) -> str:
    return f"lower({_squash(f"regexp_replace({c}, '[#*`>|-]', '', 'g')")})"


def _share(short: str, long: str) -> str:
    """The share of the 3-grams of one key in another."""
    g = f"list_distinct(list_transform(range(1, greatest(length({short}) - 1, 1)), lambda i: {short}[i:i+2]))"
    return f"CASE WHEN length({short}) < 3 THEN CASE WHEN length({short}) > 0 AND contains({long}, {short}) THEN 1.0 ELSE 0.0 END ELSE len(list_filter({g}, lambda x: contains({long}, x)))::DOUBLE / len({g}) END"


EL = "el AS (SELECT DISTINCT page_id, elem_idx, label, box.x0 AS x0, box.y0 AS y0, box.x1 AS x1, box.y1 AS y1, text, from_band, volume_id FROM page_element)"
TR = "tr AS (SELECT DISTINCT page_id, elem_idx, label, raw, html, stop FROM layout)"
RE4 = r"(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)"
PL = rf"""seg AS (SELECT page_id, unnest(string_split(raw, ';')) AS seg, generate_subscripts(string_split(raw, ';'), 1) AS pos FROM layout_string WHERE raw IS NOT NULL),
pl AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS elem_idx,
 trim(regexp_replace(trim(regexp_extract(seg, '(?s)^(.*?){RE4}', 1), E' \t\n\r'), ':+$', ''), E' \t\n\r') AS label,
 CAST(regexp_extract(seg, '{RE4}', 1) AS DOUBLE) AS x0, CAST(regexp_extract(seg, '{RE4}', 2) AS DOUBLE) AS y0,
 CAST(regexp_extract(seg, '{RE4}', 3) AS DOUBLE) AS x1, CAST(regexp_extract(seg, '{RE4}', 4) AS DOUBLE) AS y1
 FROM seg WHERE regexp_matches(seg, '{RE4}'))"""


@_query(f"WITH {PL} SELECT * FROM pl")
def parse_layout(s, d):
    """Boxes of layout strings."""
    return layout.parse_layout(table(s, d, "layout_string"))


@_query(f"WITH {PL} SELECT page_id, elem_idx, label, x0/1000*width AS x0, y0/1000*height AS y0, x1/1000*width AS x1, y1/1000*height AS y1 FROM pl JOIN page_image USING (page_id)")
def parse_detections_px(s, d):
    """Boxes of layout strings in pixels."""
    return layout.in_pixels(layout.parse_layout(table(s, d, "layout_string")), table(s, d, "page_image"))


@_query(f"""WITH {EL}, j AS (SELECT page_id, elem_idx, CASE label WHEN 'Table' THEN 'table' WHEN 'Formula' THEN 'formula' WHEN 'Picture' THEN NULL ELSE 'text' END AS task,
 greatest(0, CAST(trunc(x0/1000*width) AS INT)-2) AS px0, greatest(0, CAST(trunc(y0/1000*height) AS INT)-2) AS py0, least(width, CAST(trunc(x1/1000*width) AS INT)+2) AS px1, least(height, CAST(trunc(y1/1000*height) AS INT)+2) AS py1
 FROM el JOIN page_image USING (page_id) WHERE x0 IS NOT NULL)
SELECT *, CASE task WHEN 'table' THEN 4096 ELSE 2048 END AS budget FROM j WHERE px1-px0 >= 8 AND py1-py0 >= 8 AND task IS NOT NULL""")
def crop_jobs(s, d):
    """Crops to read, with task and budget."""
    return layout.crop_jobs(_el(s, d), table(s, d, "page_image"))


@_query("""WITH a AS (SELECT page_id, width AS w, height AS h, CAST(round_even(width/32.0, 0)*32 AS BIGINT) AS w0, CAST(round_even(height/32.0, 0)*32 AS BIGINT) AS h0 FROM page_image),
b AS (SELECT *, sqrt(CAST(h AS DOUBLE)*w/1048576.0) AS dn, sqrt(65536.0/(CAST(h AS DOUBLE)*w)) AS up FROM a),
c AS (SELECT page_id, CAST(greatest(32, CASE WHEN h0*w0 > 1048576 THEN floor(h/dn/32)*32 WHEN h0*w0 < 65536 THEN ceil(h*up/32)*32 ELSE h0 END) AS INT) AS rh,
 CAST(greatest(32, CASE WHEN h0*w0 > 1048576 THEN floor(w/dn/32)*32 WHEN h0*w0 < 65536 THEN ceil(w*up/32)*32 ELSE w0 END) AS INT) AS rw FROM b)
SELECT page_id, rh, rw, CAST(rh*rw//1024 AS INT) AS image_tokens FROM c""")
def smart_resize(s, d):
    """Size and tokens at which each page is read."""
    return layout.resized(table(s, d, "page_image"))


_GAPS = """SELECT {k}, cur AS b0, y0 AS b1 FROM (SELECT {k}, y0, greatest({top}, coalesce(max(y1) OVER (PARTITION BY {k} ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {top})) AS cur FROM sp WHERE y0 IS NOT NULL) WHERE y0 - cur >= {least}
UNION ALL SELECT {k}, greatest({top}, coalesce(max(y1), {top})) AS b0, {bottom} AS b1 FROM sp GROUP BY {k} HAVING {bottom} - greatest({top}, coalesce(max(y1), {top})) >= {least}"""


@_query(f"WITH {EL}, sp AS (SELECT page_id, floor(y0) AS y0, floor(y1) AS y1 FROM el) " + _GAPS.format(k="page_id", top="0.0::DOUBLE", bottom="1000.0::DOUBLE", least=80))
def uncovered_bands(s, d):
    """Bands of a page that no element covers."""
    return layout.bands(_el(s, d))


COLS = """n AS (SELECT page_id, count(*) FILTER (WHERE x1-x0 < 600 AND (x0+x1)/2 < 500) AS nl, count(*) FILTER (WHERE x1-x0 < 600 AND (x0+x1)/2 >= 500) AS nr,
 max(x1) FILTER (WHERE x1-x0 < 600 AND (x0+x1)/2 < 500) AS lx, min(x0) FILTER (WHERE x1-x0 < 600 AND (x0+x1)/2 >= 500) AS rx FROM el GROUP BY page_id),
m AS (SELECT page_id, CASE WHEN nl < 2 OR nr < 2 THEN NULL WHEN rx > lx THEN (lx+rx)/2 ELSE 500.0 END AS mid FROM n),
co AS (SELECT page_id, 0 AS col_idx, 0.0::DOUBLE AS cx0, coalesce(mid, 1000.0)::DOUBLE AS cx1 FROM m UNION ALL SELECT page_id, 1, mid::DOUBLE, 1000.0::DOUBLE FROM m WHERE mid IS NOT NULL)"""


@_query(f"WITH {EL}, {COLS} SELECT * FROM co")
def column_spans(s, d):
    """Columns of every page."""
    return layout.column_spans(_el(s, d))


@_query(f"WITH {EL}, {COLS}, sp AS (SELECT co.page_id, col_idx, y0, y1 FROM co JOIN el ON el.page_id = co.page_id AND (x1-x0 >= 600 OR (x0+x1)/2 BETWEEN cx0 AND cx1) UNION ALL SELECT page_id, col_idx, NULL, NULL FROM co) " + _GAPS.format(k="page_id, col_idx", top="60.0::DOUBLE", bottom="940.0::DOUBLE", least=60))
def column_bands(s, d):
    """What each column leaves uncovered."""
    return layout.column_bands(_el(s, d))


@_query(f"""WITH {EL}, {COLS}, o AS (SELECT * FROM el WHERE NOT coalesce(from_band, false)), w AS (SELECT * FROM el WHERE from_band),
n2 AS (SELECT page_id, count(*) FILTER (WHERE x1-x0 < 600 AND (x0+x1)/2 < 500) AS nl, count(*) FILTER (WHERE x1-x0 < 600 AND (x0+x1)/2 >= 500) AS nr, max(x1) FILTER (WHERE x1-x0 < 600 AND (x0+x1)/2 < 500) AS lx, min(x0) FILTER (WHERE x1-x0 < 600 AND (x0+x1)/2 >= 500) AS rx FROM o GROUP BY page_id),
m2 AS (SELECT page_id, CASE WHEN nl < 2 OR nr < 2 THEN NULL WHEN rx > lx THEN (lx+rx)/2 ELSE 500.0 END AS mid FROM n2),
oc AS (SELECT o.page_id, elem_idx, y0, CASE WHEN mid IS NULL OR (x0+x1)/2 <= mid THEN 0 ELSE 1 END AS c FROM o JOIN m2 USING (page_id) WHERE x0 IS NOT NULL),
wc AS (SELECT w.page_id, elem_idx, y0, CASE WHEN mid IS NULL OR (x0+x1)/2 <= mid THEN 0 ELSE 1 END AS c FROM w JOIN m2 USING (page_id) WHERE x0 IS NOT NULL)
SELECT wc.page_id, wc.elem_idx AS new_idx, coalesce(min(oc.elem_idx) FILTER (WHERE oc.c > wc.c OR (oc.c = wc.c AND oc.y0 > wc.y0)), -1) AS anchor FROM wc LEFT JOIN oc USING (page_id) GROUP BY 1, 2""")
def reading_order_insert(s, d):
    """Where boxes found in bands are read."""
    e = _el(s, d)
    return layout.insert_anchors(e.filter("not coalesce(from_band, false)"), e.filter("from_band"))


@_query(f"""WITH {EL}, {PL}, j AS (SELECT p.page_id, p.label, p.elem_idx AS pi, g.elem_idx AS gi,
 greatest(0, least(p.x1,g.x1)-greatest(p.x0,g.x0))*greatest(0, least(p.y1,g.y1)-greatest(p.y0,g.y0)) AS i, greatest(0,p.x1-p.x0)*greatest(0,p.y1-p.y0) AS a, greatest(0,g.x1-g.x0)*greatest(0,g.y1-g.y0) AS b
 FROM pl p JOIN el g ON p.page_id = g.page_id AND p.label = g.label WHERE g.x0 IS NOT NULL)
SELECT page_id, label, pi, gi, round(i/(a+b-i), 9) AS iou FROM j WHERE i > 0 AND round(i/(a+b-i), 9) >= 0.5""")
def iou_candidates(s, d):
    """Detected and recorded boxes that overlap by half."""
    return layout.candidates(layout.parse_layout(table(s, d, "layout_string")), _el(s, d))


@_query()
def layout_prf(s, d):
    """Precision, recall, F1 and reading order of every page."""
    return layout.layout_scores(layout.parse_layout(table(s, d, "layout_string")), _el(s, d))


CELLS = r"""ln AS (SELECT page_id, elem_idx, unnest(string_split(raw, '<nl>')) AS line, generate_subscripts(string_split(raw, '<nl>'), 1) - 1 AS "row" FROM tr WHERE label = 'Table'),
pt AS (SELECT page_id, elem_idx, "row", string_split_regex(line, '<(fcel|ched|ecel|lcel|ucel|xcel)>') AS t, regexp_extract_all(line, '<(fcel|ched|ecel|lcel|ucel|xcel)>', 1) AS k FROM ln),
ce AS (SELECT page_id, elem_idx, "row", unnest(k) AS kd, unnest(t[2:]) AS tx, generate_subscripts(k, 1) - 1 AS col FROM pt WHERE len(k) > 0),
cells AS (SELECT page_id, elem_idx, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, kd[1:1] AS kind, CASE WHEN kd IN ('fcel','ched') THEN trim(replace(replace(replace(replace(replace(tx, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&')) ELSE '' END AS text FROM ce)"""


@_query(f"WITH {TR}, {CELLS} SELECT * FROM cells")
def otsl_cells(s, d):
    """Cells of cell-token strings."""
    return _grid(s, d)


SPANS = """sz AS (SELECT page_id, elem_idx, max(col)+1 AS width, max("row")+1 AS height FROM cells GROUP BY 1, 2),
fu AS (SELECT page_id, elem_idx, width, height, unnest(range(height)) AS "row" FROM sz), fv AS (SELECT page_id, elem_idx, width, height, "row", unnest(range(width)) AS col FROM fu),
g AS (SELECT fv.*, coalesce(c.kind, 'e') AS kind, coalesce(c.text, '') AS text FROM fv LEFT JOIN cells c USING (page_id, elem_idx, "row", col)),
gs AS (SELECT *, coalesce(min(CASE WHEN kind NOT IN ('l','x') THEN col END) OVER (PARTITION BY page_id, elem_idx, "row" ORDER BY col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), width) AS sc,
 coalesce(min(CASE WHEN kind NOT IN ('u','x') THEN "row" END) OVER (PARTITION BY page_id, elem_idx, col ORDER BY "row" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), height) AS sr FROM g),
sp AS (SELECT page_id, elem_idx, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, kind, text, CAST(sr-"row" AS INT) AS rowspan, CAST(sc-col AS INT) AS colspan FROM gs WHERE kind NOT IN ('l','u','x'))"""


@_query(f"WITH {TR}, {CELLS}, {SPANS} SELECT * FROM sp")
def otsl_spans(s, d):
    """Origin cells with their spans."""
    return tables.spans(_tables(s, d))


HTML = """hc AS (SELECT page_id, elem_idx, "row", string_agg('<' || CASE kind WHEN 'c' THEN 'th' ELSE 'td' END || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END || CASE WHEN colspan > 1 THEN ' colspan="' || colspan || '"' ELSE '' END || '>' ||
 replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</' || CASE kind WHEN 'c' THEN 'th' ELSE 'td' END || '>', '' ORDER BY col) AS r FROM sp GROUP BY 1, 2, 3),
ht AS (SELECT page_id, elem_idx, '<table>' || string_agg('<tr>' || r || '</tr>', '' ORDER BY "row") || '</table>' AS html FROM hc GROUP BY 1, 2)"""


@_query(f"WITH {TR}, {CELLS}, {SPANS}, {HTML} SELECT * FROM ht")
def otsl_to_html(s, d):
    """HTML of cell-token strings."""
    return tables.to_html(_tables(s, d))


VAL = r"""va AS (SELECT page_id, elem_idx, raw, CASE WHEN trim(string_split(raw, '<nl>')[-1]) = '' THEN string_split(raw, '<nl>')[:-2] ELSE string_split(raw, '<nl>') END AS r FROM tr WHERE label = 'Table'),
vb AS (SELECT *, list_transform(r, lambda x: len(regexp_extract_all(x, '<(?:fcel|ched|ecel|lcel|ucel|xcel)>'))) AS n FROM va),
vc AS (SELECT *, coalesce(list_sum(n), 0) AS total, n[:-2] AS body, n[-1] AS last FROM vb),
vd AS (SELECT *, list_sort(list_transform(list_distinct(body), lambda v: {'c': -len(list_filter(body, lambda y: y = v)), 'v': v}))[1] AS best FROM vc),
ve AS (SELECT page_id, elem_idx, CASE WHEN trim(coalesce(raw, '')) = '' THEN 'empty' WHEN NOT contains(raw, '<nl>') AND len(regexp_extract_all(raw, '<(?:fcel|ched)>')) < 4 THEN 'no_grid' WHEN len(r) = 0 THEN 'no_rows' WHEN total < 4 THEN 'too_few_cells'
 WHEN len(n) >= 3 AND best.v > 0 AND last < best.v * 0.5 THEN 'truncated' WHEN len(n) >= 3 AND -best.c < 0.6 * len(body) THEN 'row_len_inconsistent' WHEN len(regexp_extract_all(raw, '<(?:fcel|ched|ecel)>')) = 0 THEN 'no_html_cells' ELSE '' END AS reason FROM vd)"""


@_query(f"WITH {TR}, {VAL} SELECT page_id, elem_idx, reason = '' AS ok, reason, reason IN ('truncated','row_len_inconsistent','no_html_cells','empty') AS hard FROM ve")
def validate_tables(s, d):
    """Whether recorded tables are sound."""
    return tables.validate(_tables(s, d))


@_query(f"WITH {TR}, {VAL} SELECT reason, count(*) AS tables FROM ve GROUP BY 1")
def failure_histogram(s, d):
    """Tables by the reason of their failure."""
    return validate_tables(s, d).groupBy("reason").agg(F.count("*").alias("tables"))


@_query()
def html_to_otsl(s, d):
    """Cell-token strings of HTML tables."""
    return tables.tokens_of(_tr(s, d).filter("html is not null"))


@_query()
def teds(s, d):
    """Similarity of the stored HTML with the HTML of the cell tokens."""
    gold = otsl_to_html(s, d).withColumnRenamed("html", "gold")
    return tables.table_similarity(_tr(s, d).filter("html is not null").select("page_id", "elem_idx", F.col("html").alias("pred")).join(gold, ["page_id", "elem_idx"]))


@_query(r"""SELECT doc_id AS page_id, CAST(generate_subscripts(b, 1) - 1 AS INT) AS block_idx, unnest(b) AS block FROM (SELECT doc_id, list_filter(list_transform(string_split(text, E'\n\n'), lambda x: trim(x)), lambda x: length(x) > 0) AS b FROM documents)""")
def md_blocks(s, d):
    """Blocks of texts."""
    return _md(s, d).select("page_id", F.posexplode(T.blocks(F.col("md"))).alias("block_idx", "block"))


@_query(r"""WITH b AS (SELECT doc_id AS page_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) - 1 AS pos FROM documents)
SELECT page_id, CAST(pos AS INT) AS pos FROM b WHERE regexp_matches(trim(line), '^[\s\-–—|]*(?:[0-9]{1,4}|[ivxlcIVXLC]{1,6}|-\s*\d+\s*-)[\s\-–—|]*$')""")
def page_numbers(s, d):
    """Lines that are page numbers."""
    return _md(s, d).select("page_id", F.posexplode(F.split("md", "\n")).alias("pos", "line")).filter(T.is_page_number(F.col("line"))).select("page_id", "pos")


@_query(f"SELECT doc_id, md5({_plain('text')}) AS key FROM documents")
def norm_text(s, d):
    """Comparison keys of all texts."""
    return table(s, d, "documents").select("doc_id", F.md5(T.plain_key(F.col("text"))).alias("key"))


@_query(f"SELECT doc_id, md5({_squash('text')}) AS squashed, md5({_block('text')}) AS block, md5({_block("regexp_replace(text, '<[^>]+>', '', 'g')")}) AS bare FROM documents")
def text_keys(s, d):
    """The other keys of all texts: without white space, of blocks, and of blocks without tags."""
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", F.md5(T.squash(t)).alias("squashed"), F.md5(T.block_key(t)).alias("block"), F.md5(T.bare_key(t)).alias("bare"))


@_query(r"SELECT doc_id, regexp_matches(text, '<table|\|\s*[^|\n]+\s*\||<fcel>|<ched>') AS tabular FROM documents")
def table_hint(s, d):
    """Texts that look like a table."""
    return table(s, d, "documents").select("doc_id", T.looks_like_table(F.col("text")).alias("tabular"))


_UNBRACE = "regexp_replace({}, '\\{{([^{{}}]*)\\}}', '\\1', 'g')"


def _formula() -> str:
    t = r"regexp_replace(u, '^\s*\(\s*\d+[a-z]?\s*\)\s*(?:\\quad|\\qquad|~)?\s*', '')"
    for x, y in (("\\lbrack", "["), ("\\rbrack", "]"), ("\\left", ""), ("\\right", "")):
        t = f"replace({t}, '{x}', '{y}')"
    t = f"regexp_replace({t}, '(\\\\begin\\{{(?:array|tabular)\\}})\\s*\\{{[lcr|@{{}}\\s.]*\\}}', '\\1', 'g')"
    for _ in range(8):
        t = _UNBRACE.format(t)
    return _squash(t)


@_query(f"""WITH {TR}, a AS (SELECT page_id, elem_idx, {_strip('raw')} AS t FROM tr WHERE label = 'Formula'),
b AS (SELECT page_id, elem_idx, CASE WHEN t LIKE '$$%' AND t LIKE '%$$' AND length(t) > 4 THEN {_strip('t[3:length(t)-2]')} WHEN t LIKE '$%' AND t LIKE '%$' AND length(t) > 2 THEN {_strip('t[2:length(t)-1]')} ELSE t END AS u FROM a)
SELECT page_id, elem_idx, {_formula()} AS formula FROM b""")
def latex_canonical(s, d):
    """One form of every formula."""
    return _tr(s, d).filter("label = 'Formula'").select("page_id", "elem_idx", T.formula_key(F.col("raw")).alias("formula"))


@_query(f"WITH f AS ({_SQL['latex_canonical']}), g AS (SELECT page_id, formula, count(*) AS n FROM f GROUP BY 1, 2) SELECT page_id, CAST(sum(n) AS BIGINT) AS formulas, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS matched FROM g GROUP BY 1")
def formula_match(s, d):
    """Formulas of a page that are the same but for their writing, by the form they share."""
    f = latex_canonical(s, d).groupBy("page_id", "formula").agg(F.count("*").alias("n"))
    return f.groupBy("page_id").agg(F.sum("n").alias("formulas"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("matched"))


@_query()
def ned_pairs(s, d):
    """Edit distance of element texts and their traces."""
    j = _el(s, d).filter("text is not null").join(_tr(s, d).select("page_id", "elem_idx", "raw"), ["page_id", "elem_idx"])
    return j.select("page_id", "elem_idx", T.edit_share(F.col("text"), F.col("raw")).alias("ned"))


@_query(f"""WITH {EL}, {TR}, p AS (SELECT el.page_id, el.elem_idx, {_plain('el.text')} AS a, {_plain('tr.raw')} AS b FROM el JOIN tr USING (page_id, elem_idx) WHERE el.text IS NOT NULL)
SELECT page_id, elem_idx, {_share('a', 'b')} AS share FROM p""")
def overlap_ratio(s, d):
    """How much of an element's text its trace has, by 3-grams."""
    j = _el(s, d).filter("text is not null").join(_tr(s, d).select("page_id", "elem_idx", "raw"), ["page_id", "elem_idx"])
    j = j.select("page_id", "elem_idx", T.plain_key(F.col("text")).alias("a"), T.plain_key(F.col("raw")).alias("b"))
    return j.select("page_id", "elem_idx", T.overlap(F.col("a"), F.col("b")).alias("share"))


MD = """rd AS (SELECT el.page_id, el.elem_idx, el.label, trim(coalesce(el.text, t.raw, ''), E' \\n\\t\\r') AS text FROM el LEFT JOIN (SELECT page_id, elem_idx, min(raw) AS raw FROM tr GROUP BY 1, 2) t USING (page_id, elem_idx)),
mp AS (SELECT page_id, elem_idx, CASE label WHEN 'Picture' THEN '![Picture]()' WHEN 'Table' THEN coalesce(html, '') WHEN 'Formula' THEN E'$$\\n' || text || E'\\n$$' WHEN 'Caption' THEN '*' || text || '*' WHEN 'Title' THEN '# ' || text
 WHEN 'Section-header' THEN '## ' || text WHEN 'List-item' THEN '- ' || text ELSE text END AS part FROM rd LEFT JOIN ht USING (page_id, elem_idx) WHERE label NOT IN ('Page-header', 'Page-footer')),
md AS (SELECT page_id, string_agg(part, E'\\n\\n' ORDER BY elem_idx, part) AS md FROM mp WHERE trim(part) <> '' GROUP BY 1)"""


@_query(f"WITH {EL}, {TR}, {CELLS}, {SPANS}, {HTML}, {MD} SELECT * FROM md")
def to_markdown(s, d):
    """Every page as Markdown (flagship)."""
    return pages.assembled(pages.page_parts(_el(s, d), _tr(s, d)))


@_query(f"""WITH {EL}, k AS (SELECT page_id, elem_idx, label IN ('Page-header', 'Page-footer') AS hf, {_plain("coalesce(text, '')")} AS k FROM el),
j AS (SELECT b.page_id, b.elem_idx, h.k AS h, b.k AS b FROM k b JOIN k h ON b.page_id = h.page_id AND NOT b.hf AND length(b.k) > 0 AND h.hf AND length(h.k) >= 4)
SELECT page_id, elem_idx, bool_or(length(b) <= 1.6 * length(h) AND (contains(b, h) OR {_share('h', 'b')} >= 0.6)) AS furniture FROM j GROUP BY 1, 2""")
def furniture(s, d):
    """Elements of the body beside a header or footer, and whether they repeat it."""
    return assembly.furniture_overlap(_el(s, d))


@_query()
def body_fill(s, d):
    """What the body of each page has that its first Markdown lacks."""
    return pages.filled_bodies(pages.page_parts(_el(s, d), None, _first_md(s, d)))


def _first_md(s: SparkSession, d: str) -> DataFrame:
    """A reading of whole pages: the Markdown of the elements of the first pass."""
    return pages.assembled(pages.page_parts(_kept(s, d), _tr(s, d)))


FIRST = MD.replace("FROM el LEFT JOIN", "FROM el0 el LEFT JOIN")
KEPT = "el0 AS (SELECT * FROM el WHERE NOT coalesce(from_band, false))"


@_query(f"""WITH {EL}, {TR}, {CELLS}, {SPANS}, {HTML}, {MD}, {VAL}, bad AS (SELECT page_id, elem_idx, row_number() OVER (PARTITION BY page_id ORDER BY elem_idx) AS k FROM ve WHERE reason IN ('truncated','row_len_inconsistent','no_html_cells','empty')),
bl AS (SELECT page_id, unnest(string_split(md, E'\\n\\n')) AS b, generate_subscripts(string_split(md, E'\\n\\n'), 1) - 1 AS block_idx FROM md),
tb AS (SELECT page_id, block_idx, row_number() OVER (PARTITION BY page_id ORDER BY block_idx) AS k FROM bl WHERE regexp_matches(b, '<table|\\|\\s*[^|\\n]+\\s*\\||<fcel>|<ched>'))
SELECT bad.page_id, elem_idx, CAST(block_idx AS INT) AS block_idx FROM bad LEFT JOIN tb USING (page_id, k)""")
def table_ranks(s, d):
    """Unsound tables and the table blocks that replace them."""
    return assembly.table_ranks(_el(s, d), _tr(s, d), to_markdown(s, d))


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = _el(s, d).filter("text is not null").select("page_id", F.col("text").alias("block")).distinct()
    b = _tr(s, d).filter("label not in ('Table', 'Formula')").select("page_id", F.col("raw").alias("block")).distinct()
    return a, b


SIDES = f"""a AS (SELECT DISTINCT page_id, text AS block, {_block('text')} AS k FROM el WHERE text IS NOT NULL),
b AS (SELECT DISTINCT page_id, raw AS block, {_block('raw')} AS k FROM tr WHERE label NOT IN ('Table', 'Formula'))"""


@_query(f"WITH {EL}, {TR}, {SIDES} SELECT page_id, block FROM a WHERE length(k) > 12 AND NOT EXISTS (SELECT 1 FROM b WHERE b.page_id = a.page_id AND b.k = a.k)")
def block_diff(s, d):
    """Texts of elements that no trace of their page has."""
    return assembly.only_in_first(*_sides(s, d))


@_query(f"WITH {EL}, {TR}, {SIDES} SELECT page_id, block FROM b WHERE length(k) > 12 AND NOT EXISTS (SELECT 1 FROM a WHERE b.page_id = a.page_id AND b.k = a.k)")
def block_diff_back(s, d):
    """Texts of traces that no element of their page has."""
    a, b = _sides(s, d)
    return assembly.only_in_first(b, a)


@_query(f"""WITH {EL}, {TR}, {SIDES}, g AS (SELECT page_id, k, sum(x) AS a, sum(y) AS b FROM (SELECT page_id, k, 1 AS x, 0 AS y FROM a UNION ALL SELECT page_id, k, 0, 1 FROM b) GROUP BY 1, 2)
SELECT page_id, CAST(sum(a) AS BIGINT) AS first, CAST(sum(b) AS BIGINT) AS second, CAST(sum(CASE WHEN b > 0 THEN a ELSE 0 END) AS BIGINT) AS "both" FROM g GROUP BY 1""")
def block_counts(s, d):
    """Blocks of both readings of each page."""
    return assembly.block_counts(*_sides(s, d))


@_query(f"""WITH {EL}, {TR}, m AS (SELECT e.page_id, e.elem_idx AS pos, CASE WHEN t.elem_idx IS NULL THEN NULL ELSE e.elem_idx END AS idx FROM (SELECT DISTINCT page_id, elem_idx FROM el) e LEFT JOIN (SELECT DISTINCT page_id, elem_idx FROM tr) t USING (page_id, elem_idx)),
w AS (SELECT *, max(idx) OVER a AS prev, min(idx) OVER z AS nxt, count(idx) OVER a AS run FROM m WINDOW a AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT *, count(*) OVER (PARTITION BY page_id, run, idx IS NULL) AS n, row_number() OVER (PARTITION BY page_id, run, idx IS NULL ORDER BY pos) AS k FROM w)
SELECT page_id, pos, CAST(CASE WHEN idx IS NULL AND nxt - prev - 1 = n THEN prev + k ELSE idx END AS INT) AS idx FROM v""")
def match_gap_fill(s, d):
    """Elements without a trace, filled where they fit between their neighbours."""
    t = _tr(s, d).select("page_id", "elem_idx").distinct().withColumn("idx", F.col("elem_idx"))
    return assembly.gap_fill(_el(s, d).select("page_id", "elem_idx").distinct().join(t, ["page_id", "elem_idx"], "left").select("page_id", F.col("elem_idx").alias("pos"), "idx"))


@_query("SELECT page_id FROM page_image WHERE page_id NOT IN (SELECT page_id FROM layout)")
def resume_pending(s, d):
    """Pages without a recorded trace."""
    return assembly.pending(table(s, d, "page_image").select("page_id"), table(s, d, "layout"))


@_query("SELECT page_id, CAST((row_number() OVER (ORDER BY path) - 1) % 7 AS INT) AS shard FROM page_image")
def shard_pages(s, d):
    """Pages dealt to seven shards by path."""
    return assembly.sharded(table(s, d, "page_image"), 7)


@_query("SELECT DISTINCT page_id, elem_idx, md5(raw)[1:12] AS md5, CAST(length(raw) AS INT) AS chars, rtrim(raw) LIKE '%<nl>' AS ends_row FROM layout")
def trace_capture(s, d):
    """What a run keeps of each reading."""
    return assembly.trace_facts(table(s, d, "layout"))


@_query("SELECT page_id, elem_idx, raw_md5 FROM (SELECT DISTINCT page_id, elem_idx, raw_md5, raw FROM layout) WHERE raw_md5 <> md5(raw)[1:12]")
def trace_mismatch(s, d):
    """Traces whose stored hash is not that of their text."""
    return table(s, d, "layout").filter(F.col("raw_md5") != F.substring(F.md5("raw"), 1, 12)).select("page_id", "elem_idx", "raw_md5").distinct()


JOBS = """jb AS (SELECT page_id, elem_idx FROM (SELECT page_id, elem_idx, label, greatest(0, CAST(trunc(x0/1000*width) AS INT)-2) AS a, greatest(0, CAST(trunc(y0/1000*height) AS INT)-2) AS b, least(width, CAST(trunc(x1/1000*width) AS INT)+2) AS c, least(height, CAST(trunc(y1/1000*height) AS INT)+2) AS d
 FROM el JOIN page_image USING (page_id) WHERE x0 IS NOT NULL) WHERE c-a >= 8 AND d-b >= 8 AND label <> 'Picture')"""


@_query(f"WITH {EL}, {TR}, {JOBS} SELECT page_id, elem_idx, coalesce(raw, '') AS text, coalesce(stop, '') AS stop, raw IS NULL AS error FROM jb LEFT JOIN tr USING (page_id, elem_idx)")
def replay(s, d):
    """Readings of all crop jobs from the recorded traces."""
    return assembly.replay(crop_jobs(s, d), _tr(s, d))


@_query("""WITH t AS (SELECT DISTINCT page_id, elem_idx, raw FROM layout), p AS (SELECT t.*, unnest(range(1, 33)) AS p FROM t)
SELECT page_id, elem_idx, CAST(min(p) AS INT) AS period FROM p WHERE length(raw) >= p*8 AND right(raw, p*8) = repeat(right(raw, p), 8) GROUP BY 1, 2""")
def cycle_detect(s, d):
    """Readings that end in eight copies of a short period."""
    return table(s, d, "layout").select("page_id", "elem_idx", "raw").distinct().select("page_id", "elem_idx", T.cycle_period(F.col("raw")).alias("period")).filter("period is not null")


@_query(r"""WITH l AS (SELECT doc_id AS page_id, list_filter(string_split(text, E'\n'), lambda x: trim(x) <> '') AS ls FROM documents), u AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos, len(ls) AS n FROM l)
SELECT page_id, CAST(pos AS INT) AS pos, line FROM u WHERE (pos < 6 OR pos >= n - 6) AND NOT contains(line, '|') AND regexp_matches(trim(line), '^[\s\-–—|]*(?:[0-9]{1,4}|[ivxlcIVXLC]{1,6}|-\s*\d+\s*-)[\s\-–—|]*$')""")
def edge_line_filter(s, d):
    """Page numbers among the outer lines of texts."""
    return assembly.edge_lines(_md(s, d), numbers_only=True).select("page_id", "pos", "line")


@_query(f"WITH {TR}, {CELLS} SELECT page_id, elem_idx, \"row\", CAST(coalesce(min(CASE WHEN regexp_matches(text, '^[0-9][0-9.,%\\s]*$') THEN col END), count(*)) AS INT) AS headers FROM cells GROUP BY 1, 2, 3")
def header_promotion(s, d):
    """Leading heading cells of every table row."""
    return assembly.leading_headers(_grid(s, d))


@_query(f"""WITH t AS (SELECT {_squash('text')} AS t FROM documents), h AS (SELECT case_id, EXISTS (SELECT 1 FROM t WHERE contains(t, {_squash('c.text')})) AS found FROM benchmark_case c WHERE type <> 'table')
SELECT case_id FROM h WHERE found""")
def presence_exact(s, d):
    """Cases that stand, white space apart, in some document as they are."""
    cases = table(s, d, "benchmark_case").filter("type <> 'table'").withColumn("max_diffs", F.lit(0))
    return assembly.present_cases(table(s, d, "documents"), cases)


TC = f"""k AS (SELECT page_id, elem_idx, "row", col, {_squash('text')} AS k FROM cells),
cs AS (SELECT case_id, {_squash('text')} AS k, {_squash("coalesce(left_heading, '')")} AS l, {_squash("coalesce(top_heading, '')")} AS t FROM benchmark_case WHERE type = 'table'),
hit AS (SELECT case_id, k.page_id, k.elem_idx, k."row", k.col, l, t FROM k JOIN cs USING (k)),
one AS (SELECT case_id, (l = '' OR EXISTS (SELECT 1 FROM k WHERE k.page_id = hit.page_id AND k.elem_idx = hit.elem_idx AND k."row" = hit."row" AND k.col < hit.col AND k.k = hit.l))
 AND (t = '' OR EXISTS (SELECT 1 FROM k WHERE k.page_id = hit.page_id AND k.elem_idx = hit.elem_idx AND k.col = hit.col AND k."row" < hit."row" AND k.k = hit.t)) AS related FROM hit),
tc AS (SELECT cs.case_id, count(one.case_id) > 0 AS cell, coalesce(bool_or(related), false) AS related FROM cs LEFT JOIN one USING (case_id) GROUP BY 1)"""


@_query(f"WITH {TR}, {CELLS}, {TC} SELECT * FROM tc")
def table_tests(s, d):
    """Cells of held-out tables, and whether they stand in some table under their headings."""
    return assembly.table_cases(_grid(s, d), table(s, d, "benchmark_case").filter("type = 'table'"))


@_query(f"WITH {TR}, {CELLS}, {TC} SELECT CASE WHEN related THEN 'passed' WHEN cell THEN 'relation' ELSE 'no cell' END AS failure, count(*) AS cases FROM tc GROUP BY 1")
def failure_types(s, d):
    """Tests of tables by how they fail."""
    t = table_tests(s, d)
    return t.groupBy(F.when(F.col("related"), "passed").when(F.col("cell"), "relation").otherwise("no cell").alias("failure")).agg(F.count("*").alias("cases"))


@_query()
def presence_tests(s, d):
    """Tests of all three kinds, with their tolerance: passed if present, absent, or related in a table."""
    cases = table(s, d, "benchmark_case")
    found = assembly.present_cases(table(s, d, "documents"), cases.filter("type <> 'table'")).withColumn("found", F.lit(True))
    related = table_tests(s, d).filter("related").select("case_id").withColumn("related", F.lit(True))
    j = cases.join(found, "case_id", "left").join(related, "case_id", "left")
    passed = F.when(F.col("type") == "table", F.col("related").isNotNull()).when(F.col("type") == "absent", F.col("found").isNull()).otherwise(F.col("found").isNotNull())
    return j.groupBy("axis", "type").agg(F.count("*").alias("cases"), F.count_if(passed).alias("passed"))


@_query("SELECT source, sum(n_chars) AS chars, sum(n_chars)::DOUBLE / (SELECT sum(n_chars) FROM documents) AS share FROM documents GROUP BY 1")
def token_share(s, d):
    """Shares of the sources by characters, not by records."""
    g = table(s, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    all_ = F.sum("chars").over(W.partitionBy(F.lit(0)))  # over a row for each source
    return g.select("source", "chars", (F.col("chars") / all_).alias("share"))


@_query(f"WITH {TR} SELECT tag, count(*) AS tags FROM (SELECT unnest(regexp_extract_all(raw, '<(fcel|ched|ecel|lcel|ucel|xcel|nl)>', 1)) AS tag FROM tr WHERE label = 'Table') GROUP BY 1")
def tag_counts(s, d):
    """Cell tokens by kind."""
    t = _tr(s, d).filter("label = 'Table'").select(F.explode(F.regexp_extract_all("raw", F.lit("<(fcel|ched|ecel|lcel|ucel|xcel|nl)>"), F.lit(1))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("tags"))


def _page_text(s: SparkSession, d: str) -> DataFrame:
    """A reading of whole pages: the texts of the elements of the first pass, furniture included."""
    return _kept(s, d).filter("text is not null").groupBy("page_id").agg(assembly.ordered("text").alias("md"))


def _merge(s: SparkSession, d: str, md: DataFrame) -> DataFrame:
    return pages.page_parts(_el(s, d), _tr(s, d), md, _sizes(s, d))


# One merge in SQL: blocks less furniture, usable tables by height, the k-th in place of the k-th table block.
MERGE = f"""sz0 AS (SELECT page_id, width AS w, height AS h FROM page_image), el1 AS (SELECT el.*, coalesce(w, 1400) AS w, coalesce(h, 1980) AS h FROM el LEFT JOIN sz0 USING (page_id)),
ok AS (SELECT page_id, elem_idx, reason FROM ve), us AS (SELECT el1.page_id, el1.elem_idx, ht.html, row_number() OVER (PARTITION BY el1.page_id ORDER BY coalesce(y0, 0), el1.elem_idx) AS k FROM el1 JOIN ok USING (page_id, elem_idx) JOIN ht USING (page_id, elem_idx)
 WHERE el1.label = 'Table' AND coalesce(x1-x0, 0)/1000*w >= 8 AND coalesce(y1-y0, 0)/1000*h >= 8 AND reason IN ('', 'truncated', 'row_len_inconsistent', 'no_html_cells')),
bq AS (SELECT page_id, list_filter(list_transform(string_split_regex(md, '\\n[ \\t]*\\n'), lambda x: {_strip('x')}), lambda x: length(x) > 0) AS bs FROM pt0),
bk AS (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS pos, len(bs) AS n FROM bq),
hd AS (SELECT page_id, {_plain("coalesce(text, '')")} AS h FROM el WHERE label IN ('Page-header', 'Page-footer')),
fb AS (SELECT bk.*, {_plain('b')} AS k FROM bk),
kb AS (SELECT page_id, pos, b FROM fb WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.page_id = fb.page_id AND length(h) >= 4 AND length(k) > 0 AND length(k) <= 1.6 * length(h) AND (contains(k, h) OR {_share('h', 'k')} >= 0.6))
 AND NOT (pos IN (1, n) AND regexp_matches(b, '^[\\s\\-–—|]*(?:[0-9]{{1,4}}|[ivxlcIVXLC]{{1,6}}|-\\s*\\d+\\s*-)[\\s\\-–—|]*$'))),
tq AS (SELECT kb.*, CASE WHEN {{place}} AND regexp_matches(b, '<table|\\|\\s*[^|\\n]+\\s*\\||<fcel>|<ched>') THEN row_number() OVER (PARTITION BY page_id, regexp_matches(b, '<table|\\|\\s*[^|\\n]+\\s*\\||<fcel>|<ched>') ORDER BY pos) END AS k FROM kb),
al AS (SELECT coalesce(tq.page_id, us.page_id) AS page_id, pos, us.k AS uk, coalesce(html, b) AS part, html IS NOT NULL AS made FROM tq FULL JOIN us ON tq.page_id = us.page_id AND tq.k = us.k),
ct AS (SELECT page_id, {_squash("string_agg(regexp_replace(html, '<[^>]+>', ' ', 'g'), ' ' ORDER BY k)")} AS cells FROM us GROUP BY 1),
dr AS (SELECT al.*, {_squash("regexp_replace(part, '<[^>]+>', ' ', 'g')")} AS sq FROM al), fi AS (SELECT dr.* FROM dr LEFT JOIN ct USING (page_id) WHERE made OR cells IS NULL OR part IN (SELECT html FROM us WHERE us.page_id = dr.page_id) OR NOT (length(sq) BETWEEN 1 AND 60 AND contains(cells, sq)))
SELECT page_id, string_agg(part, E'\\n\\n' ORDER BY pos IS NULL, pos, uk) AS md, CAST(count(*) FILTER (WHERE made AND pos IS NOT NULL) AS INT) AS by_block, CAST(count(*) FILTER (WHERE made AND pos IS NULL) AS INT) AS appended FROM fi GROUP BY 1"""
TEXT = "pt0 AS (SELECT page_id, string_agg(text, E'\\n\\n' ORDER BY elem_idx) AS md FROM el WHERE text IS NOT NULL AND NOT coalesce(from_band, false) GROUP BY 1)"


@_query(f"WITH {EL}, {TR}, {CELLS}, {SPANS}, {HTML}, {VAL}, {TEXT}, " + MERGE.replace("{place}", "false"))
def merge_page_append(s, d):
    """Texts of pages with their tables at the end."""
    return pages.merged_pages(_merge(s, d, _page_text(s, d)), place="append").filter("md <> ''").select("page_id", "md", "by_block", "appended")


@_query(f"WITH {EL}, {KEPT}, {TR}, {CELLS}, {SPANS}, {HTML}, {FIRST}, pt0 AS (SELECT * FROM md), {VAL}, " + MERGE.replace("{place}", "true"))
def merge_page_replace(s, d):
    """Texts of pages with their tables in place of table blocks."""
    return pages.merged_pages(_merge(s, d, _first_md(s, d)), place="replace").filter("md <> ''").select("page_id", "md", "by_block", "appended")


@_query()
def merge_page_anchor(s, d):
    """Texts of pages with their tables in place of table blocks and of prose that holds their cells, and the counters."""
    return pages.merged_pages(_merge(s, d, _page_text(s, d)), place="anchor", by_position=True, fill=True)


@_query()
def merge_hybrid(s, d):
    """Elements with tables and text of their page's reading."""
    return pages.merged_elements(pages.page_parts(_kept(s, d), _tr(s, d), _page_text(s, d), _sizes(s, d)))


@_query()
def merge_hybrid_bands(s, d):
    """What merging into elements does on each page, counted."""
    return pages.merge_report(pages.page_parts(_kept(s, d), _tr(s, d), to_markdown(s, d), _sizes(s, d)))


@_query()
def match_to_elements(s, d):
    """The blocks of pages and their elements."""
    return pages.matched_blocks(pages.page_parts(_el(s, d), _tr(s, d), _first_md(s, d)))


def _run(mode: str):
    return lambda s, d: pages.run(_merge(s, d, _page_text(s, d)), mode)


_query(f"WITH {EL}, {TR}, {TEXT} SELECT page_id, coalesce(md, '') AS md, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT page_id FROM el UNION SELECT page_id FROM page_image UNION SELECT page_id FROM tr) LEFT JOIN pt0 USING (page_id)")(_named := _run("page"))
_SPARK["run_page"], _SQL["run_page"] = _SPARK.pop("<lambda>"), _SQL.pop("<lambda>")
_ALL = "ap AS (SELECT DISTINCT page_id FROM el UNION SELECT page_id FROM page_image UNION SELECT page_id FROM tr)"
_SQL["run_coarse_to_fine"] = f"WITH {EL}, {TR}, {CELLS}, {SPANS}, {HTML}, {MD}, {TEXT}, {_ALL} SELECT page_id, CASE WHEN page_id IN (SELECT page_id FROM el) THEN coalesce(md.md, '') ELSE coalesce(pt0.md, '') END AS md, CAST(NULL AS VARCHAR) AS error FROM ap LEFT JOIN md USING (page_id) LEFT JOIN pt0 USING (page_id)"
_steps, _last = MERGE.replace("{place}", "true").rsplit("\nSELECT", 1)
_SQL["run_hybrid_page"] = f"WITH {EL}, {TR}, {CELLS}, {SPANS}, {HTML}, {VAL}, {TEXT}, {_steps}, mg AS (SELECT{_last}), {_ALL} SELECT page_id, coalesce(mg.md, '') AS md, CAST(NULL AS VARCHAR) AS error FROM ap LEFT JOIN mg USING (page_id)"
_SPARK |= {"run_coarse_to_fine": _run("coarse-to-fine"), "run_hybrid": _run("hybrid"), "run_hybrid_page": _run("hybrid-page")}


@_query(f"WITH {EL} SELECT page_id, elem_idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY elem_idx) - 1 AS INT) AS n FROM el WHERE text IS NOT NULL")
def renumber_elements(s, d):
    """Elements with a text, numbered anew."""
    return assembly.renumbered(_el(s, d).filter("text is not null"))


@_query(f"WITH {EL} SELECT volume_id, count(DISTINCT page_id) AS pages, count(*) AS elements FROM el GROUP BY 1")
def page_totals(s, d):
    """Pages and elements of each volume."""
    return _el(s, d).groupBy("volume_id").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("elements"))


@_query(f"""WITH {EL}, {TR} SELECT page_id, elem_idx, CASE el.label WHEN 'Table' THEN coalesce(t.html, '') WHEN 'Formula' THEN '<div class="formula">$$ ' || x || ' $$</div>' WHEN 'Picture' THEN '<div class="pic"></div>' WHEN 'Title' THEN '<h1>' || x || '</h1>'
 WHEN 'Section-header' THEN '<h2>' || x || '</h2>' WHEN 'List-item' THEN '<p>• ' || x || '</p>' WHEN 'Caption' THEN '<p><em>' || x || '</em></p>' ELSE '<p>' || x || '</p>' END AS html
 FROM (SELECT el.*, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS x FROM el) el LEFT JOIN tr t USING (page_id, elem_idx)""")
def element_html(s, d):
    """Readings of elements as HTML."""
    j = _el(s, d).join(_tr(s, d).select("page_id", "elem_idx", "html"), ["page_id", "elem_idx"], "left")
    return j.select("page_id", "elem_idx", T.element_html(F.col("label"), F.col("text"), F.col("html")).alias("html"))


@_query(f"""WITH {EL}, x AS (SELECT page_id, elem_idx, text AS t, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS e FROM el WHERE text IS NOT NULL)
SELECT page_id, elem_idx, CASE WHEN ltrim(t) LIKE '<table%' THEN t WHEN t LIKE '## %' THEN '<h2>' || e[4:] || '</h2>' WHEN t LIKE '# %' THEN '<h1>' || e[3:] || '</h1>' WHEN t LIKE '$$%' THEN '<pre class="formula">' || e || '</pre>'
 WHEN t LIKE '*%' AND t LIKE '%*' THEN '<p><em>' || regexp_replace(e, '^\\*+|\\*+$', '', 'g') || '</em></p>' ELSE '<p>' || e || '</p>' END AS html FROM x""")
def block_html(s, d):
    """Texts of elements, as blocks of Markdown, as HTML."""
    return _el(s, d).filter("text is not null").select("page_id", "elem_idx", T.block_html(F.col("text")).alias("html"))


@_query(f"""WITH {EL}, j AS (SELECT page_id, elem_idx, label, width, height, greatest(0, CAST(trunc(x0/1000*width) AS INT)-2) AS a, greatest(0, CAST(trunc(y0/1000*height) AS INT)-2) AS b, least(width, CAST(trunc(x1/1000*width) AS INT)+2) AS c, least(height, CAST(trunc(y1/1000*height) AS INT)+2) AS d FROM el JOIN page_image USING (page_id) WHERE x0 IS NOT NULL),
t AS (SELECT page_id, elem_idx, CASE label WHEN 'Table' THEN 'table' WHEN 'Formula' THEN 'formula' WHEN 'Picture' THEN NULL ELSE 'text' END AS task, CASE WHEN label = 'Table' THEN greatest(0, CAST(trunc(a - 1.5*(c-a)*0.02::DOUBLE) AS INT)) ELSE a END AS px0, CASE WHEN label = 'Table' THEN greatest(0, CAST(trunc(b - 1.5*(d-b)*0.02::DOUBLE) AS INT)) ELSE b END AS py0,
 CASE WHEN label = 'Table' THEN least(width, CAST(trunc(c + (c-a)*0.02::DOUBLE) AS INT)) ELSE c END AS px1, CASE WHEN label = 'Table' THEN least(height, CAST(trunc(d + (d-b)*0.02::DOUBLE) AS INT)) ELSE d END AS py1 FROM j)
SELECT *, CASE task WHEN 'table' THEN 4096 ELSE 2048 END AS budget, CASE task WHEN 'table' THEN 64 ELSE 0 END AS stop_on_cycle, CASE task WHEN 'table' THEN 4 ELSE 8 END AS cycle_repeats FROM t WHERE px1-px0 >= 8 AND py1-py0 >= 8 AND task IS NOT NULL""")
def crop_jobs_guarded(s, d):
    """Crops to read, tables widened, with the guards against loops."""
    return layout.guarded(layout.crop_jobs(_el(s, d), table(s, d, "page_image"), table_pad=0.02), table_stop_on_cycle=64, table_repeats=4)


@_query(f"""WITH {EL}, t AS (SELECT page_id, elem_idx, CASE label WHEN 'Table' THEN 'table' WHEN 'Formula' THEN 'formula' ELSE 'text' END AS task FROM el WHERE label <> 'Picture')
SELECT page_id, elem_idx, task, CAST(floor((row_number() OVER (PARTITION BY page_id, task ORDER BY elem_idx) - 1) / 8) AS INT) AS batch FROM t""")
def prompt_batches(s, d):
    """Elements to read, by task, eight to a batch."""
    return layout.batches(_el(s, d).filter("label <> 'Picture'").withColumn("task", layout.task_of(F.col("label"))))


@_query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 2097152 ELSE 1048576 END AS most, '<|im_start|>user' || chr(10) || '<|vision_start|>' || repeat('<|image_pad|>', 3) || '<|vision_end|>' || CASE WHEN page_id % 2 = 0 THEN 'Layout Detection' ELSE 'Read the text' END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM page_image""")
def page_prompts(s, d):
    """The prompt of each page, of detection for one half and of reading for the other, and its budget of pixels."""
    what = F.when(F.col("page_id") % 2 == 0, "Layout Detection").otherwise("Read the text")
    return table(s, d, "page_image").select("page_id", layout.pixel_budget(what, 2097152).alias("most"), layout.chat_prompt(what, F.lit(3)).alias("prompt"))


@_query(f"""WITH {EL}, {COLS}, sp AS (SELECT co.page_id, col_idx, y0, y1 FROM co JOIN el ON el.page_id = co.page_id AND (x1-x0 >= 600 OR (x0+x1)/2 BETWEEN cx0 AND cx1) UNION ALL SELECT page_id, col_idx, NULL, NULL FROM co), {PL}, ba AS ({_GAPS.format(k="page_id, col_idx", top="60.0::DOUBLE", bottom="940.0::DOUBLE", least=60)}),
p AS (SELECT page_id, col_idx, cx0, cx1, b0, b1, width AS w, height AS h, greatest(0, CAST(trunc(cx0/1000*width) AS INT)-4) AS px0, greatest(0, CAST(trunc(b0/1000*height) AS INT)-4) AS py0, least(width, CAST(trunc(cx1/1000*width) AS INT)+4) AS px1, least(height, CAST(trunc(b1/1000*height) AS INT)+4) AS py1 FROM ba JOIN co USING (page_id, col_idx) JOIN page_image USING (page_id)),
q AS (SELECT p.*, (SELECT min(x0) FROM el WHERE el.page_id = p.page_id AND x1-x0 < 600 AND label NOT IN ('Page-header', 'Page-footer') AND (x0+x1)/2 BETWEEN p.cx0 AND p.cx1) AS k0, (SELECT max(x1) FROM el WHERE el.page_id = p.page_id AND x1-x0 < 600 AND label NOT IN ('Page-header', 'Page-footer') AND (x0+x1)/2 BETWEEN p.cx0 AND p.cx1) AS k1 FROM p WHERE px1-px0 >= 40 AND py1-py0 >= 40),
r AS (SELECT q.page_id, col_idx, b0, elem_idx AS pos, label, cx0, cx1, b1, k0, k1, px0::DOUBLE/w*1000 + x0*((px1-px0)::DOUBLE/w) AS x0, py0::DOUBLE/h*1000 + y0*((py1-py0)::DOUBLE/h) AS y0, px0::DOUBLE/w*1000 + x1*((px1-px0)::DOUBLE/w) AS x1, py0::DOUBLE/h*1000 + y1*((py1-py0)::DOUBLE/h) AS y1 FROM q JOIN pl USING (page_id)),
t AS (SELECT *, (y1-y0)*0.01::DOUBLE+3 AS my, (x1-x0)*0.02::DOUBLE+4 AS mx, label IN ('Table','Picture','Formula') AS own FROM r WHERE x1-x0 >= 5 AND y1-y0 >= 5),
u AS (SELECT page_id, col_idx, b0, pos, label, CASE WHEN own THEN greatest(cx0, x0-mx) WHEN k0 IS NULL THEN cx0 ELSE greatest(cx0, k0-6) END AS x0, greatest(b0, y0-my) AS y0, CASE WHEN own THEN least(cx1, x1+mx) WHEN k1 IS NULL THEN cx1 ELSE least(cx1, k1+6) END AS x1, least(b1, y1+my) AS y1 FROM t)
SELECT page_id, col_idx, b0, pos, label, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM u WHERE NOT EXISTS (SELECT 1 FROM el e WHERE e.page_id = u.page_id AND e.x0 IS NOT NULL AND least(e.x1,u.x1) > greatest(e.x0,u.x0) AND least(e.y1,u.y1) > greatest(e.y0,u.y0)
 AND (least(e.x1,u.x1)-greatest(e.x0,u.x0))*(least(e.y1,u.y1)-greatest(e.y0,u.y0)) / greatest(1e-6, (e.x1-e.x0)*(e.y1-e.y0)+(u.x1-u.x0)*(u.y1-u.y0)-(least(e.x1,u.x1)-greatest(e.x0,u.x0))*(least(e.y1,u.y1)-greatest(e.y0,u.y0))) > 0.3)""")
def relayout_dedup(s, d):
    """Boxes detected anew in uncovered bands (here as the page's own detection, on the band's scale) that are new."""
    e = _el(s, d)
    bands = layout.column_bands(e).join(layout.column_spans(e), ["page_id", "col_idx"])
    found = layout.parse_layout(table(s, d, "layout_string")).withColumnRenamed("elem_idx", "pos")
    detected = bands.select("page_id", "col_idx", "b0").join(found, "page_id")
    r = layout.relayout(bands, e, table(s, d, "page_image"), detected)
    return r.select("page_id", "col_idx", "b0", "pos", "label", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


PRF = f"""cd AS (SELECT page_id, pi, gi, row_number() OVER (PARTITION BY page_id ORDER BY pi, iou DESC, gi DESC) AS k FROM io),
g(page_id, k, ps, gs) AS (SELECT DISTINCT page_id, 0::BIGINT, []::INT[], []::INT[] FROM cd UNION ALL SELECT g.page_id, cd.k, CASE WHEN list_contains(ps, cd.pi) OR list_contains(gs, cd.gi) THEN ps ELSE list_append(ps, cd.pi) END,
 CASE WHEN list_contains(ps, cd.pi) OR list_contains(gs, cd.gi) THEN gs ELSE list_append(gs, cd.gi) END FROM g JOIN cd ON cd.page_id = g.page_id AND cd.k = g.k + 1),
mt AS (SELECT page_id, arg_max(gs, k) AS gs FROM g GROUP BY 1), ms AS (SELECT page_id, len(gs) AS matched, list_sum(list_transform(gs, lambda x, i: len(list_filter(gs[i+1:], lambda y: y < x)))) AS swaps FROM mt),
np AS (SELECT page_id, count(*) AS n_pred FROM pl GROUP BY 1), ng AS (SELECT page_id, count(*) AS n_gold FROM el GROUP BY 1),
nn AS (SELECT page_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_gold, 0) AS n_gold, coalesce(matched, 0) AS matched, coalesce(swaps, 0) AS swaps FROM np FULL JOIN ng USING (page_id) LEFT JOIN ms USING (page_id)),
pr AS (SELECT *, CASE WHEN n_pred > 0 THEN matched::DOUBLE/n_pred ELSE 0.0 END AS p, CASE WHEN n_gold > 0 THEN matched::DOUBLE/n_gold ELSE 0.0 END AS r FROM nn)
SELECT page_id, n_pred, n_gold, CAST(matched AS INT) AS matched, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2*p*r/(p+r) ELSE 0.0 END AS f1, CASE WHEN matched > 1 THEN 1 - 4*swaps::DOUBLE/(matched*(matched-1)) ELSE -1.0 END AS order_tau FROM pr"""
IO = """j AS (SELECT p.page_id, p.elem_idx AS pi, g.elem_idx AS gi, greatest(0, least(p.x1,g.x1)-greatest(p.x0,g.x0))*greatest(0, least(p.y1,g.y1)-greatest(p.y0,g.y0)) AS i, greatest(0,p.x1-p.x0)*greatest(0,p.y1-p.y0) AS a, greatest(0,g.x1-g.x0)*greatest(0,g.y1-g.y0) AS b
 FROM pl p JOIN el g ON p.page_id = g.page_id {labels} WHERE g.x0 IS NOT NULL), io AS (SELECT page_id, pi, gi, round(i/(a+b-i), 9) AS iou FROM j WHERE i > 0 AND round(i/(a+b-i), 9) >= {least})"""
_SQL["layout_prf"] = f"WITH RECURSIVE {EL}, {PL}, {IO.format(labels='AND p.label = g.label', least=0.5)}, {PRF}"


@_query(f"WITH RECURSIVE {EL}, {PL}, {IO.format(labels='', least=0.3)}, {PRF}")
def layout_prf_any(s, d):
    """Scores of every page without regard to labels, from an overlap of 0.3."""
    return layout.layout_scores(layout.parse_layout(table(s, d, "layout_string")), _el(s, d), 0.3, labels=False)


@_query()
def text_confusions(s, d):
    """What traces read for what the element's text has."""
    j = _el(s, d).filter("text is not null").join(_tr(s, d).filter("label not in ('Table', 'Formula')").select("page_id", "elem_idx", "raw"), ["page_id", "elem_idx"])
    return assembly.confusions(j.select(F.col("raw").alias("read"), F.col("text").alias("meant")))


@_query(f"""WITH {TR}, g AS (SELECT unnest(regexp_extract_all(raw, '<(fcel|ched|ecel|lcel|ucel|xcel|nl)>', 1)) AS tag FROM tr WHERE label = 'Table'), h AS (SELECT unnest(regexp_extract_all(html, '<(td|th|tr)[ >]', 1)) AS tag FROM tr WHERE label = 'Table' AND html IS NOT NULL)
SELECT tag, count(*) FILTER (WHERE side = 0) AS tokens, count(*) FILTER (WHERE side = 1) AS html FROM (SELECT tag, 0 AS side FROM g UNION ALL SELECT CASE tag WHEN 'tr' THEN 'nl' WHEN 'th' THEN 'ched' ELSE 'fcel' END, 1 FROM h) GROUP BY 1""")
def tag_compare(s, d):
    """Cell tokens of one reading against the tags of the other."""
    t = _tables(s, d)
    a = t.select(F.explode(F.regexp_extract_all("raw", F.lit("<(fcel|ched|ecel|lcel|ucel|xcel|nl)>"), F.lit(1))).alias("tag"), F.lit(0).alias("side"))
    b = t.filter("html is not null").select(F.explode(F.regexp_extract_all("html", F.lit("<(td|th|tr)[ >]"), F.lit(1))).alias("tag"), F.lit(1).alias("side"))
    b = b.withColumn("tag", F.when(F.col("tag") == "tr", "nl").when(F.col("tag") == "th", "ched").otherwise("fcel"))
    return a.unionByName(b).groupBy("tag").agg(F.count_if(F.col("side") == 0).alias("tokens"), F.count_if(F.col("side") == 1).alias("html"))


@_query(f"""WITH {TR}, g AS (SELECT page_id, elem_idx, raw[i:i+7] AS g, i FROM (SELECT page_id, elem_idx, raw, unnest(range(1, length(raw) - 6)) AS i FROM tr)), o AS (SELECT *, row_number() OVER (PARTITION BY page_id, elem_idx, g ORDER BY i) AS n FROM g)
SELECT page_id, elem_idx, CAST(min(i) AS INT) AS place FROM o WHERE n > 1 GROUP BY 1, 2""")
def repeated_gram(s, d):
    """The place where each trace first repeats eight characters."""
    return _tr(s, d).select("page_id", "elem_idx", T.repeated_gram(F.col("raw")).alias("place")).filter("place is not null")


@_query(f"WITH {TR} SELECT page_id, elem_idx, array_to_string(list_filter(string_split_regex(raw, '<[a-z]+>'), lambda c: length({_strip('c')}) >= 2)[1:40], ' ') AS probe FROM tr WHERE label = 'Table'")
def cell_probe(s, d):
    """The first cells of tables as running text."""
    return tables._over_tables(_tables(s, d), "raw", "probe string", lambda raw: [(pages.probe(raw or ""),)])


@_query(r"""WITH s AS (SELECT *, regexp_extract(path, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem FROM page_image) SELECT s.page_id, s.stem, t.stem IS NOT NULL AS has_text FROM s JOIN (SELECT DISTINCT stem FROM s JOIN layout_string l USING (page_id) WHERE raw IS NOT NULL) l USING (stem) LEFT JOIN (SELECT DISTINCT stem FROM s JOIN layout USING (page_id)) t USING (stem)""")
def pair_by_stem(s, d):
    """Page images with their layout and text by file name."""
    i = table(s, d, "page_image").select("page_id", "path")
    named = i.select("page_id", diagnostics.stem(F.col("path")).alias("stem"))
    layouts = named.join(table(s, d, "layout_string").filter("raw is not null"), "page_id").select("stem").distinct()
    texts = named.join(table(s, d, "layout").select("page_id").distinct(), "page_id").select("stem").distinct().withColumn("md", F.lit(True))
    return diagnostics.paired(i, layouts, texts).select("page_id", "stem", F.col("md").isNotNull().alias("has_text"))


@_query(f"WITH {EL}, {TR} SELECT el.page_id, CAST(row_number() OVER (PARTITION BY el.page_id ORDER BY el.elem_idx) - 1 AS INT) AS elem_idx, el.label, el.text, t.raw FROM el LEFT JOIN tr t ON t.page_id = el.page_id AND t.elem_idx = el.elem_idx")
def diagnostics_roundtrip(s, d):
    """Elements and traces written as JSON and read back."""
    t = table(s, d, "layout").dropDuplicates(["page_id", "elem_idx"])
    return diagnostics.read_diagnostics(diagnostics.diagnostics(_el(s, d), t))


@_query()
def result_json(s, d):
    """The result of each page as JSON."""
    return diagnostics.results(_el(s, d), table(s, d, "page_image"))


@_query()
def page_md_blocks(s, d):
    """Blocks of texts in which tables are whole."""
    return _md(s, d).select("page_id", F.posexplode(T.page_blocks(F.col("md"))).alias("block_idx", "block"))


@_query()
def edge_filter(s, d):
    """Texts without the furniture of their outer lines."""
    return assembly.without_edge_lines(_md(s, d))


@_query(f"WITH {TR}, {VAL} SELECT page_id, elem_idx, reason, reason IN ('truncated','row_len_inconsistent','no_html_cells','empty') AS strict, reason IN ('truncated','row_len_inconsistent','no_html_cells','empty','too_few_cells','no_grid','no_rows') AS \"all\" FROM ve")
def replaceable_tables(s, d):
    """Tables that may be replaced, at both levels."""
    v = tables.validate(_tables(s, d))
    return v.select("page_id", "elem_idx", "reason", tables.replaceable(F.col("reason")).alias("strict"), tables.replaceable(F.col("reason"), "all").alias("all"))


@_query()
def bootstrap_ci(s, d):
    """Mean F1 of the layouts with a 95 % interval of 2,000 replicates."""
    return assembly.bootstrap(layout_prf(s, d).select("page_id", F.col("f1").alias("score")))


@_query(f"""WITH {TR}, {VAL}, a AS (SELECT page_id, elem_idx FROM ve WHERE reason = ''), b AS (SELECT DISTINCT page_id, elem_idx FROM tr WHERE html LIKE '%</table>')
SELECT count(*) FILTER (WHERE b.page_id IS NULL) AS lost, count(*) FILTER (WHERE a.page_id IS NULL) AS gained, count(*) FILTER (WHERE a.page_id IS NOT NULL AND b.page_id IS NOT NULL) AS kept FROM a FULL JOIN b USING (page_id, elem_idx)""")
def churn(s, d):
    """Tables sound as tokens against tables complete as HTML."""
    return assembly.churn(validate_tables(s, d).filter("ok"), _tr(s, d).filter("html like '%</table>'"))


@_query("WITH c AS (SELECT source, lang, avg(n_chars) AS m FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) SELECT source, avg(m) AS category_mean FROM c GROUP BY 1")
def category_mean(s, d):
    """Mean length of a source's texts over its labels, each label counting alike."""
    g = table(s, d, "documents").filter("lang is not null").groupBy("source", "lang").agg(F.avg("n_chars").alias("m"))
    return g.groupBy("source").agg(F.avg("m").alias("category_mean"))


@_query("SELECT p.source, count(*) AS pages, count(l.page_id) AS parsed, count(t.page_id) AS traced FROM page_image p LEFT JOIN (SELECT DISTINCT page_id FROM layout_string WHERE raw IS NOT NULL) l USING (page_id) LEFT JOIN (SELECT DISTINCT page_id FROM layout) t ON t.page_id = p.page_id AND l.page_id IS NOT NULL GROUP BY 1")
def survival_funnel(s, d):
    """Pages of each source that have a layout string, and of these a trace."""
    l = table(s, d, "layout_string").filter("raw is not null").select("page_id").distinct().withColumn("l", F.lit(True))
    t = table(s, d, "layout").select("page_id").distinct().withColumn("t", F.lit(True))
    j = table(s, d, "page_image").join(l, "page_id", "left").join(t, "page_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("pages"), F.count("l").alias("parsed"), F.count_if(F.col("l") & F.col("t")).alias("traced"))


def queries() -> dict:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
