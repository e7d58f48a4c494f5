"""Whole pages: assembling, merging two readings, matching blocks, and the run over all pages.

Everything of a page (elements, traces, its reading as a whole, its size) is brought together by one shuffle on
``page_id``; a page is bounded, and what follows works on it in Arrow batches.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.functions import plain as P
from foliant.operators import tables
from foliant.sources.ship import ship

FURNITURE = ("Page-header", "Page-footer")
#: Labels that never fill a page's body.
NO_BODY = ("Table", "Page-header", "Page-footer", "Picture", "Formula")
PARTS = "kind string, elem_idx int, label string, x0 double, y0 double, x1 double, y1 double, text string"


@dataclass
class Element:
    """A layout element; ``box`` is None where it has none, ``how`` says what merging did to it."""

    idx: int
    label: str
    box: tuple[float, float, float, float] | None
    text: str
    how: str = ""


@dataclass
class Page:
    """All of one page; ``md`` is its reading as a whole, None without one."""

    elements: list[Element] = field(default_factory=list)
    md: str | None = None
    width: float = 1400
    height: float = 1980


def page_parts(elements: DataFrame, traces: DataFrame | None = None, pages: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``(page_id, parts)``: a row for each page that occurs anywhere, with all its rows.

    ``elements (page_id, elem_idx, label, x0, y0, x1, y1, text)``, ``traces (page_id, elem_idx, raw)``,
    ``pages (page_id, md)``, ``sizes (page_id, width, height)``. One shuffle.
    """
    none = lambda kind: F.lit(None).cast(kind)
    box = ("x0", "y0", "x1", "y1")
    all_ = elements.select("page_id", F.lit("e").alias("kind"), F.col("elem_idx").cast("int").alias("elem_idx"), "label", *(F.col(c).cast("double").alias(c) for c in box), "text")
    if traces is not None:
        all_ = all_.unionByName(traces.select("page_id", F.lit("t").alias("kind"), F.col("elem_idx").cast("int").alias("elem_idx"), none("string").alias("label"), *(none("double").alias(c) for c in box), F.col("raw").alias("text")))
    if pages is not None:
        all_ = all_.unionByName(pages.select("page_id", F.lit("m").alias("kind"), none("int").alias("elem_idx"), none("string").alias("label"), *(none("double").alias(c) for c in box), F.col("md").alias("text")))
    if sizes is not None:
        all_ = all_.unionByName(sizes.select("page_id", F.lit("s").alias("kind"), none("int").alias("elem_idx"), none("string").alias("label"), none("double").alias("x0"), none("double").alias("y0"), F.col("width").cast("double").alias("x1"), F.col("height").cast("double").alias("y1"), none("string").alias("text")))
    return all_.groupBy(F.col("page_id").cast("bigint").alias("page_id")).agg(F.collect_list(F.struct("kind", "elem_idx", "label", *box, "text")).alias("parts"))


def _page(parts: list[dict]) -> Page:
    page = Page()
    raw: dict[int, str] = {}
    seen: dict[int, Element] = {}
    order = lambda p: (p["kind"], p["elem_idx"] or 0, p["text"] is None, p["text"] or "", p["label"] or "")
    for p in sorted(parts, key=order):
        if p["kind"] == "e" and p["elem_idx"] not in seen:
            box = None if p["x0"] is None else (p["x0"], p["y0"], p["x1"], p["y1"])
            seen[p["elem_idx"]] = Element(p["elem_idx"], p["label"] or "", box, p["text"])
        elif p["kind"] == "t" and p["text"] is not None:
            raw.setdefault(p["elem_idx"], p["text"])
        elif p["kind"] == "m" and p["text"] is not None:
            page.md = p["text"] if page.md is None else page.md
        elif p["kind"] == "s" and p["x1"] and p["y1"]:
            page.width, page.height = p["x1"], p["y1"]
    for e in seen.values():
        if e.text is None:
            e.text = raw.get(e.idx, "")
    page.elements = [seen[i] for i in sorted(seen)]
    return page


def over_pages(parts: DataFrame, schema: str, rows_of: Callable[[Page], list[tuple]]) -> DataFrame:
    """Rows ``(page_id, *schema)`` that ``rows_of`` makes of each page of :func:`page_parts`."""
    names = [x.split() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, row) for i, p in zip(b.column("page_id").to_pylist(), b.column("parts").to_pylist()) for row in rows_of(_page(p))]
            if found:
                values = zip(*(row for _, row in found))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), *(pa.array(list(v), tables._ARROW[kind]) for v, (_, kind) in zip(values, names))], ["page_id", *(n for n, _ in names)])

    ship(parts.sparkSession)
    return parts.mapInArrow(run, f"page_id bigint, {schema}")


# Assembling


def _part(e: Element) -> str:
    t = e.text.strip()
    prefix = {"Title": "# ", "Section-header": "## ", "List-item": "- "}.get(e.label)
    if e.label == "Picture":
        return "![Picture]()"
    if e.label == "Table":
        return tables.html_of(t) if t else ""
    if e.label == "Formula":
        return f"$$\n{t}\n$$"
    if e.label == "Caption":
        return f"*{t}*"
    return prefix + t if prefix else t


def markdown(elements: list[Element]) -> str:
    """Elements in order as Markdown; furniture is left out, tables are HTML. An empty heading keeps its sign."""
    return "\n\n".join(p for p in (_part(e) for e in elements if e.label not in FURNITURE) if p.strip())


# Merging


def without_furniture(md: str, elements: list[Element], least: float = 0.6) -> tuple[list[str], int]:
    """The blocks of a page's text that do not repeat its header or footer and are no page number at its edges."""
    heads = [k for k in (P.plain_key(e.text) for e in elements if e.label in FURNITURE) if len(k) >= 4]
    blocks = P.page_blocks(md)
    kept = []
    for i, b in enumerate(blocks):
        k = P.plain_key(b)
        repeats = any(k and len(k) <= 1.6 * len(h) and (h in k or P.gram_share(h, k) >= least) for h in heads)
        if not repeats and not (i in (0, len(blocks) - 1) and P.is_page_number(b)):
            kept.append(b)
    return kept, len(blocks) - len(kept)


def _tiny(e: Element, page: Page, least: int = 8) -> bool:
    x0, y0, x1, y1 = e.box or (0, 0, 0, 0)
    return (x1 - x0) / 1000 * page.width < least or (y1 - y0) / 1000 * page.height < least


_HARD = ("truncated", "row_len_inconsistent", "otsl_parse_error", "no_html_cells", "empty")


def _replaceable(reason: str, level: str) -> bool:
    return reason in _HARD or level == "all" and reason in ("too_few_cells", "no_grid", "no_rows")


def probe(raw: str, most: int = 40) -> str:
    """The first cells of a table, of two characters at least, as running text."""
    import re

    return " ".join([c for c in re.split("<[a-z]+>", raw) if len(c.strip()) >= 2][:most])


def _anchor(blocks: list[str], open_: list[int], raw: str, least: float, margin: float) -> int | None:
    """The block that alone holds a table's cells as prose, if it does so clearly; of equals the later counts first."""
    key = P.plain_key(probe(raw))
    ranked = sorted(((P.gram_share(P.plain_key(blocks[i]), key), i) for i in open_), reverse=True)
    if ranked and ranked[0][0] >= least and (len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= margin):
        return ranked[0][1]
    return None


COUNTERS = ("tables", "used", "by_block", "by_anchor", "by_position", "appended", "abstained", "furniture", "tiny", "unsound", "cell_blocks", "body_seen", "body_filled", "body_chars")


def merge_into_page(page: Page, place: str = "replace", level: str = "strict", by_position: bool = False, fill: bool = False, overlap: float = 0.55, margin: float = 0.12, drop_furniture: bool = True) -> tuple[str, Counter]:
    """A page's text with the tables of its elements, and counts of what was done.

    Usable tables, from top to bottom, take the place of table blocks (``replace``), or also of the block that
    alone holds their cells (``anchor``), or none (``append``); others go to their relative height (``by_position``)
    or to the end. A table is usable unless it is tiny, blank or too small to tell. Short blocks that repeat cells
    leave the text; with ``fill`` the elements that the text lacks follow at its end.
    """
    n: Counter = Counter()
    blocks, n["furniture"] = without_furniture(page.md or "", page.elements) if drop_furniture else (P.page_blocks(page.md or ""), 0)
    use = []
    for e in (e for e in page.elements if e.label == "Table"):
        n["tables"] += 1
        reason = tables.reason_of(e.text)
        if _tiny(e, page):
            n["tiny"] += 1
        elif reason and not _replaceable(reason, level) or not e.text.strip():
            n["unsound"] += 1
        else:
            use.append(e)
    use.sort(key=lambda e: (e.box or (0, 0))[1])
    out = list(blocks)
    hinted = [P.looks_like_table(b) for b in blocks]
    free = deque(i for i, x in enumerate(hinted) if x and place != "append")
    prose = {i for i, x in enumerate(hinted) if not x}
    between: dict[int, list[str]] = {}
    end = []
    made = set()
    for e in use:
        html = tables.html_of(e.text)
        made.add(html)
        n["used"] += 1
        at = None
        if free:
            at = free.popleft()
            n["by_block"] += 1
        elif place == "anchor":
            at = _anchor(blocks, sorted(prose), e.text, overlap, margin)
            n["abstained" if at is None else "by_anchor"] += 1
            prose.discard(at)
        if at is not None:
            out[at] = html
        elif by_position:
            height = (e.box or (0, 0))[1] / 1000
            between.setdefault(min(len(blocks), max(0, round(height * max(len(blocks), 1)))), []).insert(0, html)
            n["by_position"] += 1
        else:
            end.append(html)
            n["appended"] += 1
    out = [x for i in range(len(out) + 1) for x in (*between.get(i, ()), *out[i : i + 1])] + end
    if use:
        cells = P.squash(" ".join(P.without_tags(tables.html_of(e.text)) for e in use))
        held = [b not in made and 0 < len(k := P.squash(P.without_tags(b))) <= 60 and k in cells for b in out]
        n["cell_blocks"] = sum(held)
        out = [b for b, x in zip(out, held) if not x]
    if fill:
        out += body_of(page.elements, " ".join(b for b in out if b), n)
    return "\n\n".join(b for b in out if b.strip()), n


def body_of(elements: list[Element], text: str, n: Counter) -> list[str]:
    """The elements of the body, in order, that a text and those before them lack; compared without white space."""
    have, out = P.squash(text), []
    for e in elements:
        if e.label in NO_BODY or not e.text.strip():
            continue
        n["body_seen"] += 1
        k = P.squash(e.text)
        if k not in have:
            out.append(e.text)
            have += k
            n["body_filled"] += 1
            n["body_chars"] += len(e.text)
    return out


HYBRID = ("tables", "bad", "tiny", "soft", "replaced", "bands", "bands_filled")


def uncovered(elements: list[Element], least: int = 80) -> list[tuple[int, int]]:
    """Horizontal bands of at least ``least`` that no element covers, from top to bottom."""
    out, reach = [], 0
    for y0, y1 in [*sorted((int(e.box[1]), int(e.box[3])) for e in elements if e.box), (1000, 1000)]:
        if y0 - reach >= least:
            out.append((reach, y0))
        reach = max(reach, y1)
    return out


def merge_into_elements(page: Page, level: str = "strict", known: float = 0.75, fill: bool = True) -> tuple[list[Element], Counter]:
    """A page's elements with tables and text of its reading as a whole, and counts of what was done.

    A table that broke off takes the table block of its own rank, else the first one left; each uncovered band
    takes the first block left that is new to the elements.
    """
    n: Counter = Counter()
    els = [replace(e) for e in page.elements]
    blocks = P.page_blocks(page.md or "")
    hinted = [i for i, b in enumerate(blocks) if P.looks_like_table(b)]
    left = set(hinted)
    for rank, e in enumerate(e for e in els if e.label == "Table"):
        n["tables"] += 1
        reason = tables.reason_of(e.text)
        if not reason:
            continue
        n["bad"] += 1
        n[f"reason {reason}"] += 1
        if _tiny(e, page):
            n["tiny"] += 1
        elif not _replaceable(reason, level):
            n["soft"] += 1
        elif left:
            at = hinted[rank] if rank < len(hinted) and hinted[rank] in left else min(left)
            left.discard(at)
            e.label, e.text, e.how = "Table_html", blocks[at], "table_replaced"
            n["replaced"] += 1
    if not fill:
        return els, n
    whole = P.plain_key(" ".join(e.text for e in page.elements))
    new = deque(b for i, b in enumerate(blocks) if i not in hinted and P.gram_share(P.plain_key(b), whole) < known)
    for y0, _ in uncovered(els):
        n["bands"] += 1
        if new:
            at = next((k for k, e in enumerate(els) if e.box and e.box[1] >= y0), len(els))
            els.insert(at, Element(-1, "Text", (0, y0, 1000, y0), new.popleft(), "band_filled"))
            n["bands_filled"] += 1
    return els, n


# Matching


def match_blocks(blocks: list[str], elements: list[Element], least: float = 0.3, least_short: float = 0.62, short: int = 12) -> list[int | None]:
    """For each block, in order, the position of its element; None for a block that only the page's reading has.

    The unused element that covers a block best, or is covered best, by reading or HTML; furniture and elements of
    another length are none. A run of blocks without a match takes the elements between its neighbours if they are
    as many.
    """
    pool = {i: [P.bare_key(e.text), P.bare_key(tables.html_of(e.text)) if e.label == "Table" else P.bare_key(e.text)] for i, e in enumerate(elements) if e.label not in FURNITURE}
    free, out = set(pool), []
    for b in blocks:
        k = P.bare_key(b)
        best, score = None, 0.0
        for i in sorted(free):
            raw, html = pool[i]
            ref = raw or html
            if ref and k and max(len(ref), len(k)) > 3 * min(len(ref), len(k)) + short:
                continue
            s = max(P.cover(x, y) for x, y in ((raw, k), (k, raw), (html, k), (k, html)))
            if s > score:
                best, score = i, s
        if best is not None and score < (least_short if min(len(pool[best][0]), len(k)) < short else least):
            best = None
        free.discard(best)
        out.append(best)
    at = 0
    while at < len(out):
        if out[at] is not None:
            at += 1
            continue
        to = next((j for j in range(at, len(out)) if out[j] is not None), len(out))
        before = out[at - 1] if at else -1
        after = out[to] if to < len(out) else len(elements)
        gap = [i for i in range(before + 1, after) if i not in out]
        if len(gap) == to - at:
            out[at:to] = gap
        at = to
    return out


# The run


MODES = ("page", "coarse-to-fine", "hybrid", "hybrid-page")


def read_page(page: Page, mode: str, **options) -> str:
    """A page's Markdown in one of the modes; a page without elements is its reading as a whole."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode == "page" or not page.elements:
        return page.md or ""
    if mode == "hybrid-page":
        return merge_into_page(page, **options)[0]
    return markdown(merge_into_elements(page, **options)[0] if mode == "hybrid" else page.elements)


def run(parts: DataFrame, mode: str = "hybrid-page", **options) -> DataFrame:
    """``(page_id, md, error)`` of every page of :func:`page_parts`.

    A page that fails is empty and has the error; the others go on.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")

    def one(page: Page) -> list[tuple]:
        try:
            return [(read_page(page, mode, **options), None)]
        except Exception as e:  # one page's fault is not another's
            return [("", f"{type(e).__name__}: {e}")]

    return over_pages(parts, "md string, error string", one)


def observed(out: DataFrame, name: str = "run") -> DataFrame:
    """The run's result with counts of pages, errors and characters for an ``Observation`` of that name."""
    return out.observe(name, F.count("*").alias("pages"), F.count("error").alias("errors"), F.sum(F.length("md")).alias("chars"))


def merged_pages(parts: DataFrame, **options) -> DataFrame:
    """``(page_id, md, ...)``: :func:`merge_into_page` of every page, with its counters."""

    def one(page: Page) -> list[tuple]:
        md, n = merge_into_page(page, **options)
        return [(md, *(n[c] for c in COUNTERS))]

    return over_pages(parts, "md string, " + ", ".join(f"{c} int" for c in COUNTERS), one)


def merged_elements(parts: DataFrame, **options) -> DataFrame:
    """``(page_id, pos, elem_idx, label, y0, how, text)``: :func:`merge_into_elements` of every page, renumbered."""

    def one(page: Page) -> list[tuple]:
        return [(k, e.idx, e.label, e.box[1] if e.box else None, e.how, e.text) for k, e in enumerate(merge_into_elements(page, **options)[0])]

    return over_pages(parts, "pos int, elem_idx int, label string, y0 double, how string, text string", one)


def merge_report(parts: DataFrame, **options) -> DataFrame:
    """``(page_id, counter, n)``: what :func:`merge_into_elements` counts on every page, reasons included."""
    return over_pages(parts, "counter string, n int", lambda page: sorted((k, v) for k, v in merge_into_elements(page, **options)[1].items() if v))


def matched_blocks(parts: DataFrame) -> DataFrame:
    """``(page_id, block_idx, elem_idx, label)``: the blocks of a page's text and their elements; without one they
    are labelled ``Recovered``."""

    def one(page: Page) -> list[tuple]:
        blocks = [x for x in (b.strip() for b in (page.md or "").split("\n\n")) if x]
        found = match_blocks(blocks, page.elements)
        return [(k, None if i is None else page.elements[i].idx, "Recovered" if i is None else page.elements[i].label) for k, i in enumerate(found)]

    return over_pages(parts, "block_idx int, elem_idx int, label string", one)


def assembled(parts: DataFrame) -> DataFrame:
    """``(page_id, md)``: every page with elements as Markdown, if any of it is left."""
    return over_pages(parts, "md string", lambda page: [(md,)] if page.elements and (md := markdown(page.elements)) else [])


def filled_bodies(parts: DataFrame) -> DataFrame:
    """``(page_id, filled, chars, body)``: the elements of the body that the page's text lacks."""

    def one(page: Page) -> list[tuple]:
        n: Counter = Counter()
        body = "\n\n".join(body_of(page.elements, page.md or "", n))
        return [(n["body_filled"], n["body_chars"], body)] if n["body_seen"] else []

    return over_pages(parts, "filled int, chars int, body string", one)
