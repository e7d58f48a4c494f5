"""Layout operators: parsing, crops, uncovered bands, columns, reading order, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions import boxes, text as T

# Fixed value: the four numbers of a box.
BOX = r"(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)"
# The task of each label; any other label is read as text, pictures are not read.
TASKS = {"Table": "table", "Formula": "formula", "Picture": None}
BUDGETS = {"table": 4096, "formula": 2048, "text": 2048}


def parse_layout(raw: DataFrame) -> DataFrame:
    """``(page_id, elem_idx, label, x0, y0, x1, y1)`` of layout strings ``(page_id, raw)``.

    Segments without four numbers are dropped, the rest numbered in order; null strings have none.
    """
    seg = raw.filter("raw is not null").select("page_id", F.posexplode(F.split("raw", ";")).alias("pos", "seg")).filter(F.col("seg").rlike(BOX))
    n = [F.regexp_extract("seg", BOX, i).cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"), 1)]
    label = T.strip(F.regexp_replace(T.strip(F.regexp_extract("seg", r"(?s)^(.*?)" + BOX, 1)), r":+$", ""))
    idx = (F.row_number().over(W.partitionBy("page_id").orderBy("pos")) - 1).alias("elem_idx")
    return seg.select("page_id", idx, label.alias("label"), *n)


def in_pixels(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """Parsed boxes in pixels of their page."""
    j = parsed.join(pages.select("page_id", "width", "height"), "page_id")
    return j.select("page_id", "elem_idx", "label", *((F.col(c) / 1000 * F.col(s)).alias(c) for c, s in (("x0", "width"), ("y0", "height"), ("x1", "width"), ("y1", "height"))))


def task_of(label: Column) -> Column:
    c = F.when(label == "Table", "table").when(label == "Formula", "formula").when(label == "Picture", F.lit(None))
    return c.otherwise("text")


def crop_jobs(elements: DataFrame, pages: DataFrame, pad: int = 2, least: int = 8, table_pad: float = 0.0) -> DataFrame:
    """Crops to read: pixel boxes of at least ``least`` pixels a side, with task and budget; no pictures.

    Tables are widened by ``table_pad`` of their size, half as much again to the left and the top, where headings are.
    """
    e = elements.filter("x0 is not null").join(pages.select("page_id", "width", "height"), "page_id").withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    task = task_of(F.col("label"))
    out = e.select("page_id", "elem_idx", task.alias("task"), "width", "height", *boxes.padded(F.col("box"), F.col("width"), F.col("height"), pad))
    if table_pad > 0:
        dx, dy, wide = (F.col("px1") - F.col("px0")) * table_pad, (F.col("py1") - F.col("py0")) * table_pad, F.col("task") == "table"
        zero = F.lit(0)
        wider = {
            "px0": F.greatest(zero, (F.col("px0") - 1.5 * dx).cast("int")), "py0": F.greatest(zero, (F.col("py0") - 1.5 * dy).cast("int")),
            "px1": F.least("width", (F.col("px1") + dx).cast("int")), "py1": F.least("height", (F.col("py1") + dy).cast("int")),
        }
        out = out.withColumns({c: F.when(wide, v).otherwise(F.col(c)) for c, v in wider.items()})
    budget = F.when(F.col("task") == "table", BUDGETS["table"]).otherwise(BUDGETS["text"])
    return out.drop("width", "height").filter((F.col("px1") - F.col("px0") >= least) & (F.col("py1") - F.col("py0") >= least) & F.col("task").isNotNull()).withColumn("budget", budget)


def guarded(jobs: DataFrame, stop_on_cycle: int = 0, repeats: int = 8, table_stop_on_cycle: int = -1, table_repeats: int = 0) -> DataFrame:
    """Crop jobs with the guards against loops; those of tables differ if they are set (0 and more, and over 0)."""
    table = F.col("task") == "table"
    guard = F.when(table & F.lit(table_stop_on_cycle >= 0), table_stop_on_cycle).otherwise(stop_on_cycle)
    times = F.when(table & F.lit(table_repeats > 0), table_repeats).otherwise(repeats)
    return jobs.withColumn("stop_on_cycle", guard).withColumn("cycle_repeats", times)


def batches(jobs: DataFrame, size: int = 8) -> DataFrame:
    """``(page_id, elem_idx, task, batch)``: the jobs of a page by task, in order, ``size`` to a batch."""
    by = W.partitionBy("page_id", "task").orderBy("elem_idx")
    return jobs.select("page_id", "elem_idx", "task", F.floor((F.row_number().over(by) - 1) / size).cast("int").alias("batch"))


def pixel_budget(prompt: Column, layout: int, other: int = 1048576) -> Column:
    """The most pixels at which an image is read for a prompt; detection of layouts has its own."""
    return F.when(prompt.startswith("Layout Detection"), layout).otherwise(other)


def chat_prompt(prompt: Column, image_tokens: Column, system: str | None = None) -> Column:
    """A prompt as turns of a chat with the image's places before it."""
    turn = lambda who, what: F.concat(F.lit(f"<|im_start|>{who}\n"), what, F.lit("<|im_end|>\n"))
    image = F.concat(F.lit("<|vision_start|>"), F.repeat(F.lit("<|image_pad|>"), image_tokens), F.lit("<|vision_end|>"))
    user = turn("user", F.concat(image, prompt))
    return F.concat(*([turn("system", F.lit(system))] if system else []), user, F.lit("<|im_start|>assistant\n"))


def resized(pages: DataFrame, factor: int = 32) -> DataFrame:
    """``(page_id, rh, rw, image_tokens)``: the size at which each page is read."""
    h, w = boxes.fit_to_budget(F.col("height"), F.col("width"), factor)
    return pages.select("page_id", h.alias("rh"), w.alias("rw")).withColumn("image_tokens", (F.col("rh") * F.col("rw") / (factor * factor)).cast("int"))


def uncovered(spans: DataFrame, keys: list[str], least: int, top: int, bottom: int) -> DataFrame:
    """Gaps of at least ``least`` between the spans ``(keys, y0, y1)`` in ``top`` to ``bottom``.

    Spans with null ``y0`` only name their group, so that a group without boxes is one gap.
    """
    before = W.partitionBy(*keys).orderBy("y0", "y1").rowsBetween(W.unboundedPreceding, -1)
    s = spans.filter("y0 is not null").withColumn("cur", F.greatest(F.lit(top).cast("double"), F.max("y1").over(before)))
    inner = s.filter(F.col("y0") - F.col("cur") >= least).select(*keys, F.col("cur").alias("b0"), F.col("y0").alias("b1"))
    tail = spans.groupBy(*keys).agg(F.greatest(F.lit(top).cast("double"), F.max("y1")).alias("b0")).filter(F.lit(bottom) - F.col("b0") >= least)
    return inner.unionByName(tail.withColumn("b1", F.lit(bottom).cast("double")))


def bands(elements: DataFrame, least: int = 80) -> DataFrame:
    """``(page_id, b0, b1)``: horizontal bands of a page that no element covers."""
    s = elements.select("page_id", F.floor("y0").cast("double").alias("y0"), F.floor("y1").cast("double").alias("y1"))
    return uncovered(s, ["page_id"], least, 0, 1000)


def relayout(bands: DataFrame, elements: DataFrame, pages: DataFrame, detected: DataFrame, pad: int = 4, least: int = 40, most: float = 0.3) -> DataFrame:
    """``(page_id, col_idx, b0, pos, label, x0, y0, x1, y1)``: boxes detected anew in bands, on their page, without
    those that the page's elements have.

    ``bands (page_id, col_idx, cx0, cx1, b0, b1)``; ``detected (page_id, col_idx, b0, pos, label, x0, y0, x1, y1)`` on
    the scale of the band's crop, which is widened by ``pad`` pixels; crops under ``least`` pixels are not read.
    Lines take the width of the column's other boxes, tables, pictures and formulas their own with a margin.
    """
    p = bands.join(pages.select("page_id", "width", "height"), "page_id")
    edge = boxes.padded(F.struct(F.col("cx0").alias("x0"), F.col("b0").alias("y0"), F.col("cx1").alias("x1"), F.col("b1").alias("y1")), F.col("width"), F.col("height"), pad)
    p = p.select("*", *edge).filter((F.col("px1") - F.col("px0") >= least) & (F.col("py1") - F.col("py0") >= least))
    e = elements.filter("x0 is not null")
    kin = e.filter((F.col("x1") - F.col("x0") < 600) & ~F.col("label").isin("Page-header", "Page-footer")).select("page_id", F.col("x0").alias("kx0"), F.col("x1").alias("kx1"))
    near = (F.col("kx0") + F.col("kx1")) / 2
    inside = F.when(near.between(F.col("cx0"), F.col("cx1")), F.lit(True))
    keys = ["page_id", "col_idx", "b0"]
    width = p.join(kin, "page_id", "left").groupBy(*keys).agg(F.min(F.when(inside, F.col("kx0"))).alias("k0"), F.max(F.when(inside, F.col("kx1"))).alias("k1"))
    j = p.join(width, keys).join(detected, keys)
    sx, sy = (F.col("px1") - F.col("px0")) / F.col("width"), (F.col("py1") - F.col("py0")) / F.col("height")
    ox, oy = F.col("px0") / F.col("width") * 1000, F.col("py0") / F.col("height") * 1000
    j = j.select(*keys, "pos", "label", "cx0", "cx1", "b1", "k0", "k1", (ox + F.col("x0") * sx).alias("x0"), (oy + F.col("y0") * sy).alias("y0"), (ox + F.col("x1") * sx).alias("x1"), (oy + F.col("y1") * sy).alias("y1"))
    j = j.filter((F.col("x1") - F.col("x0") >= 5) & (F.col("y1") - F.col("y0") >= 5))
    my, mx = (F.col("y1") - F.col("y0")) * 0.01 + 3, (F.col("x1") - F.col("x0")) * 0.02 + 4
    own = F.col("label").isin("Table", "Picture", "Formula")
    left = F.when(own, F.greatest("cx0", F.col("x0") - mx)).otherwise(F.coalesce(F.greatest("cx0", F.col("k0") - 6), "cx0"))
    right = F.when(own, F.least("cx1", F.col("x1") + mx)).otherwise(F.when(F.col("k1").isNull(), F.col("cx1")).otherwise(F.least("cx1", F.col("k1") + 6)))
    j = j.select(*keys, "pos", "label", left.alias("x0"), F.greatest("b0", F.col("y0") - my).alias("y0"), right.alias("x1"), F.least("b1", F.col("y1") + my).alias("y1"))
    old = e.select("page_id", F.struct("x0", "y0", "x1", "y1").alias("old"))
    known = j.join(old, "page_id").filter(boxes.strict_iou(F.struct("x0", "y0", "x1", "y1"), F.col("old")) > most).select(*keys, "pos").distinct()
    return j.join(known, [*keys, "pos"], "left_anti")


def column_spans(elements: DataFrame, ratio: float = 0.6) -> DataFrame:
    """``(page_id, col_idx, cx0, cx1)``: one column, or two parted in the middle of the gap between them."""
    e = elements.withColumn("narrow", F.col("x1") - F.col("x0") < ratio * 1000).withColumn("c", (F.col("x0") + F.col("x1")) / 2)
    left, right = F.col("narrow") & (F.col("c") < 500), F.col("narrow") & (F.col("c") >= 500)
    g = e.groupBy("page_id").agg(F.count_if(left).alias("nl"), F.count_if(right).alias("nr"), F.max(F.when(left, F.col("x1"))).alias("lx"), F.min(F.when(right, F.col("x0"))).alias("rx"))
    mid = F.when(F.col("rx") > F.col("lx"), (F.col("lx") + F.col("rx")) / 2).otherwise(500.0)
    edge = F.when((F.col("nl") < 2) | (F.col("nr") < 2), F.array(F.lit(0.0), F.lit(1000.0))).otherwise(F.array(F.lit(0.0), mid, F.lit(1000.0)))
    g = g.select("page_id", edge.alias("e"))
    return g.select("page_id", "e", F.explode(F.sequence(F.lit(0), F.size("e") - 2)).alias("col_idx")).select("page_id", "col_idx", F.col("e")[F.col("col_idx")].alias("cx0"), F.col("e")[F.col("col_idx") + 1].alias("cx1"))


def column_bands(elements: DataFrame, least: int = 60, top: int = 60, bottom: int = 940, ratio: float = 0.6) -> DataFrame:
    """``(page_id, col_idx, b0, b1)``: what each column leaves uncovered; wide elements cover all columns."""
    cols = column_spans(elements, ratio)
    e = elements.select("page_id", "x0", "x1", "y0", "y1")
    c = (F.col("x0") + F.col("x1")) / 2
    inside = (F.col("x1") - F.col("x0") >= ratio * 1000) | c.between(F.col("cx0"), F.col("cx1"))
    covered = cols.join(e, "page_id").filter(inside).select("page_id", "col_idx", "y0", "y1")
    named = cols.select("page_id", "col_idx", F.lit(None).cast("double").alias("y0"), F.lit(None).cast("double").alias("y1"))
    return uncovered(covered.unionByName(named), ["page_id", "col_idx"], least, top, bottom)


def insert_anchors(elements: DataFrame, new: DataFrame) -> DataFrame:
    """``(page_id, new_idx, anchor)``: before which element of the page each new box is read; -1: at the end.

    The first element, in order, that lies in a later column, or further down in the same. Columns come
    from the elements; a new box goes to the first column that holds its centre, else to the last.
    """
    cols = column_spans(elements).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "cx0", "cx1"))).alias("cols"))

    def col_of(df: DataFrame) -> DataFrame:
        c = (F.col("x0") + F.col("x1")) / 2
        hit = F.filter("cols", lambda s: (s.cx0 <= c) & (c <= s.cx1))
        return df.join(cols, "page_id").withColumn("col", F.when(F.size(hit) > 0, hit[0].col_idx).otherwise(F.size("cols") - 1)).drop("cols")

    e = col_of(elements.filter("x0 is not null")).select("page_id", F.col("elem_idx").alias("old_idx"), F.col("col").alias("ecol"), F.col("y0").alias("ey"))
    n = col_of(new.filter("x0 is not null")).select("page_id", F.col("elem_idx").alias("new_idx"), "col", F.col("y0").alias("ny"))
    later = (F.col("ecol") > F.col("col")) | ((F.col("ecol") == F.col("col")) & (F.col("ey") > F.col("ny")))
    return n.join(e, "page_id", "left").groupBy("page_id", "new_idx").agg(F.coalesce(F.min(F.when(later, F.col("old_idx"))), F.lit(-1)).alias("anchor"))


def candidates(pred: DataFrame, gold: DataFrame, least: float = 0.5, labels: bool = True) -> DataFrame:
    """``(page_id, label, pi, gi, iou)``: boxes of one page and label (of any, without ``labels``) that overlap by
    ``least``."""
    if not labels:
        pred, gold = (x.withColumn("label", F.lit("")) for x in (pred, gold))
    p = pred.select("page_id", "label", F.col("elem_idx").alias("pi"), F.struct("x0", "y0", "x1", "y1").alias("p"))
    g = gold.filter("x0 is not null").select("page_id", "label", F.col("elem_idx").alias("gi"), F.struct("x0", "y0", "x1", "y1").alias("g"))
    j = p.join(g, ["page_id", "label"]).withColumn("iou", F.round(boxes.iou(F.col("p"), F.col("g")), 9))
    return j.filter(F.col("iou") >= least).select("page_id", "label", "pi", "gi", "iou")


def layout_scores(pred: DataFrame, gold: DataFrame, least: float = 0.5, labels: bool = True) -> DataFrame:
    """``(page_id, n_pred, n_gold, matched, precision, recall, f1, order_tau)`` of every page of either side.

    Predictions in order take the best unused box of their label; of equal ones the later. Under two
    matches the order has -1.
    """
    c = candidates(pred, gold, least, labels).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pi", (-F.col("iou")).alias("worse"), (-F.col("gi")).alias("g"), "gi"))).alias("c"))
    start = F.array().cast("array<struct<pi:int,gi:int>>")
    took = F.aggregate("c", start, lambda acc, x: F.when(F.exists(acc, lambda m: (m.pi == x.pi) | (m.gi == x.gi)), acc).otherwise(F.concat(acc, F.array(F.struct(x.pi.cast("int").alias("pi"), x.gi.cast("int").alias("gi"))))))
    m = c.select("page_id", took.alias("m"))
    discord = F.aggregate("m", F.lit(0), lambda acc, a: acc + F.size(F.filter("m", lambda b: (b.pi > a.pi) & (b.gi < a.gi))))
    m = m.select("page_id", F.size("m").alias("matched"), discord.alias("swaps"))
    n = pred.groupBy("page_id").agg(F.count("*").alias("n_pred")).join(gold.groupBy("page_id").agg(F.count("*").alias("n_gold")), "page_id", "full")
    s = n.join(m, "page_id", "left").na.fill(0)
    p, r = F.coalesce(F.try_divide("matched", "n_pred"), F.lit(0.0)), F.coalesce(F.try_divide("matched", "n_gold"), F.lit(0.0))
    pairs = F.col("matched") * (F.col("matched") - 1)
    return s.select("page_id", "n_pred", "n_gold", "matched", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), F.when(pairs > 0, 1 - 4 * F.col("swaps") / F.greatest(pairs, F.lit(1))).otherwise(-1.0).alias("order_tau"))
