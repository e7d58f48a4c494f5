"""Parts of assembly: page furniture, comparison of two readings, tests, run control.

Whole pages are put together in :mod:`foliant.operators.pages`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions import plain, text as T
from foliant.operators import tables
from foliant.operators.pages import FURNITURE
from foliant.sources.ship import ship
from foliant.sources.tables import checkpointed


def with_readings(elements: DataFrame, traces: DataFrame) -> DataFrame:
    """Elements with ``text`` from their trace where they have none (tables and formulas); missing: empty."""
    t = traces.groupBy("page_id", "elem_idx").agg(F.min("raw").alias("raw"))
    return elements.join(t, ["page_id", "elem_idx"], "left").withColumn("text", F.coalesce("text", "raw", F.lit("")))


def ordered(parts: str, order: str = "elem_idx", sep: str = "\n\n") -> Column:
    """The parts of a group in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, parts))), lambda x: x[parts]), sep)


def furniture_overlap(elements: DataFrame) -> DataFrame:
    """``(page_id, elem_idx, furniture)``: elements of the body that repeat the page's header or footer.

    Compared by keys: not over 1.6 times as long, and 60 % of the 3-grams shared or contained.
    """
    k = elements.withColumn("k", T.plain_key(F.col("text")))
    hf = k.filter(F.col("label").isin(*FURNITURE) & (F.length("k") >= 4)).select("page_id", F.col("k").alias("h"))
    body = k.filter(~F.col("label").isin(*FURNITURE) & (F.length("k") > 0)).select("page_id", "elem_idx", "k")
    j = body.join(hf, "page_id")
    same = (F.length("k") <= 1.6 * F.length("h")) & ((T.overlap(F.col("h"), F.col("k")) >= 0.6) | F.contains("k", F.col("h")))
    return j.groupBy("page_id", "elem_idx").agg(F.bool_or(same).alias("furniture"))


def table_ranks(elements: DataFrame, traces: DataFrame, pages: DataFrame) -> DataFrame:
    """``(page_id, elem_idx, block_idx)``: the k-th unsound table of a page and the k-th table block of its text."""
    bad = tables.validate(traces.filter("label = 'Table'").groupBy("page_id", "elem_idx").agg(F.min("raw").alias("raw"))).filter("hard").select("page_id", "elem_idx")
    bad = bad.withColumn("k", F.row_number().over(W.partitionBy("page_id").orderBy("elem_idx")))
    b = pages.select("page_id", F.posexplode(T.blocks(F.col("md"))).alias("block_idx", "block")).filter(T.looks_like_table(F.col("block")))
    b = b.withColumn("k", F.row_number().over(W.partitionBy("page_id").orderBy("block_idx"))).select("page_id", "k", "block_idx")
    return bad.join(b, ["page_id", "k"], "left").select("page_id", "elem_idx", "block_idx")


def only_in_first(a: DataFrame, b: DataFrame, least: int = 12) -> DataFrame:
    """Blocks ``(page_id, block)`` of one reading that the other has not, by their keys; short ones are left out."""
    ka = a.withColumn("k", T.block_key(F.col("block"))).filter(F.length("k") > least)
    kb = b.select("page_id", T.block_key(F.col("block")).alias("k")).distinct()
    return ka.join(kb, ["page_id", "k"], "left_anti").select("page_id", "block")


def gap_fill(matches: DataFrame) -> DataFrame:
    """Rows ``(page_id, pos, idx)`` with nulls of ``idx`` filled where a run of nulls fits the gap of its neighbours."""
    past = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    next_ = W.partitionBy("page_id").orderBy("pos").rowsBetween(0, W.unboundedFollowing)
    m = matches.withColumn("prev", F.last("idx", True).over(past)).withColumn("next", F.first("idx", True).over(next_)).withColumn("run", F.count("idx").over(past))
    run = W.partitionBy("page_id", "run", F.col("idx").isNull())
    m = m.withColumn("n", F.count("*").over(run)).withColumn("k", F.row_number().over(run.orderBy("pos")))
    fits = F.col("idx").isNull() & (F.col("next") - F.col("prev") - 1 == F.col("n"))
    return m.select("page_id", "pos", F.when(fits, F.col("prev") + F.col("k")).otherwise(F.col("idx")).cast("int").alias("idx"))


def pending(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages that have no output yet."""
    return pages.join(done.select("page_id").distinct(), "page_id", "left_anti")


def sharded(pages: DataFrame, shards: int) -> DataFrame:
    """``(page_id, shard)``: every ``shards``-th path in order.

    Paths are parted into ranges, written once so that the ranges stay as they are; the ranges' counts are summed
    up (a row for each range), and paths are ranked within their range.
    """
    p = checkpointed(pages.select("page_id", "path").repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    n = p.groupBy("part").agg(F.count("*").alias("n"))
    base = n.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("part").orderBy("path")) - 1
    return p.join(F.broadcast(base), "part").select("page_id", ((rank + F.col("base")) % shards).cast("int").alias("shard"))  # a row for each range


def trace_facts(traces: DataFrame) -> DataFrame:
    """What a run keeps of each reading: its hash, length and whether it ends with a row."""
    return traces.select("page_id", "elem_idx", F.substring(F.md5("raw"), 1, 12).alias("md5"), F.length("raw").alias("chars"), F.endswith(F.rtrim(F.col("raw")), F.lit("<nl>")).alias("ends_row")).distinct()


def replay(jobs: DataFrame, traces: DataFrame) -> DataFrame:
    """The readings of crop jobs from a recorded run; a job without a record has an empty text and an error."""
    t = traces.groupBy("page_id", "elem_idx").agg(F.min("raw").alias("text"), F.min("stop").alias("stop"))
    return jobs.join(t, ["page_id", "elem_idx"], "left").select("page_id", "elem_idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("stop", F.lit("")).alias("stop"), F.col("text").isNull().alias("error"))


# What the outer lines of a page lose: numbers with signs about them or as parts of a whole, dates
# alone, and short labels in Latin letters.
EDGE_NUMBER = r"^[\s|•·\-–—]*(?:\d{1,4}(?:\s*/\s*\d{1,4})?|[ivxlcIVXLC]{1,6})[\s|•·\-–—]*$"
EDGE_DATE = r"^\s*\d{4}\s*[.\-/]\s*\d{1,2}\s*[.\-/]\s*\d{1,2}\s*\.?\s*(?:기준)?\s*$"
EDGE_LABEL = r"^\s*[A-Z][A-Za-z]*(?:\s*:?\s+[A-Z][A-Za-z]*){0,3}\s*$"


def edge_lines(pages: DataFrame, edge: int = 6, numbers_only: bool = False, longest: int = 45) -> DataFrame:
    """``(page_id, pos, line)``: lines among the first and last ``edge`` of a page that are furniture by their form:
    page numbers and, without ``numbers_only``, dates and short labels.

    Lines within a table, over ``longest`` characters, or with a bar, unless they are a page number, are none.
    Blank lines do not count.
    """
    ls = pages.select("page_id", F.posexplode(F.filter(F.split("md", "\n"), lambda x: F.length(T.strip(x)) > 0)).alias("pos", "line"))
    so_far = W.partitionBy("page_id").orderBy("pos")
    opens = F.size(F.regexp_extract_all(F.lower("line"), F.lit("<table"), F.lit(0)))
    closes = F.size(F.regexp_extract_all(F.lower("line"), F.lit("</table>"), F.lit(0)))
    ls = ls.withColumn("n", F.count("*").over(W.partitionBy("page_id"))).withColumn("inside", F.sum(opens - closes).over(so_far) + closes)
    number = T.is_page_number(F.col("line")) | F.col("line").rlike(EDGE_NUMBER)
    form = T.is_page_number(F.col("line")) if numbers_only else number | F.col("line").rlike(EDGE_DATE) | F.col("line").rlike(EDGE_LABEL)
    bar = F.contains("line", F.lit("|")) & (F.lit(numbers_only) | ~number)
    kept = form & ~bar & (F.col("inside") <= 0) & (F.length(T.squash(F.col("line"))) <= longest)
    return ls.filter(((F.col("pos") < edge) | (F.col("pos") >= F.col("n") - edge)) & kept).select("page_id", "pos", "line")


def without_edge_lines(pages: DataFrame, edge: int = 6) -> DataFrame:
    """``(page_id, md)``: texts without page numbers first, then, looking further in, without the other furniture."""
    for numbers_only in (True, False):
        ls = pages.select("page_id", F.posexplode(F.filter(F.split("md", "\n"), lambda x: F.length(T.strip(x)) > 0)).alias("pos", "line"))
        kept = ls.join(edge_lines(pages, edge, numbers_only).select("page_id", "pos"), ["page_id", "pos"], "left_anti")
        pages = kept.groupBy("page_id").agg(ordered("line", "pos", "\n").alias("md"))
    return pages


def leading_headers(grid: DataFrame) -> DataFrame:
    """``(page_id, elem_idx, row, headers)``: the cells before the first number of a row, which are its heading."""
    number = F.col("text").rlike(r"^[0-9][0-9.,%\s]*$")
    return grid.groupBy("page_id", "elem_idx", "row").agg(F.coalesce(F.min(F.when(number, F.col("col"))), F.count("*")).cast("int").alias("headers"))


def block_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(page_id, first, second, both)``: blocks of two readings ``(page_id, block)``, and of the first those that the
    second has by key."""
    k = lambda df, side: df.select("page_id", T.block_key(F.col("block")).alias("k"), F.lit(side).alias("side"))
    by = k(a, 0).unionByName(k(b, 1)).groupBy("page_id", "k").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    return by.groupBy("page_id").agg(F.sum("a").alias("first"), F.sum("b").alias("second"), F.sum(F.when(F.col("b") > 0, F.col("a")).otherwise(0)).alias("both"))


def renumbered(elements: DataFrame) -> DataFrame:
    """``(page_id, elem_idx, n)``: the elements of a page numbered anew from 0, without gaps."""
    return elements.select("page_id", "elem_idx", (F.row_number().over(W.partitionBy("page_id").orderBy("elem_idx")) - 1).alias("n"))


def confusions(pairs: DataFrame) -> DataFrame:
    """``(wrong, right, n)``: what was read for what in the aligned pairs ``(read, meant)``.

    Replacements of the shortest edit of each pair, white space apart; summed up in each batch before the shuffle.
    """
    from collections import Counter
    from difflib import SequenceMatcher

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for x, y in zip(b.column("read").to_pylist(), b.column("meant").to_pylist()):
                x, y = plain.squash(x or ""), plain.squash(y or "")
                if x != y:
                    for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                        if op == "replace":
                            n[x[i:j], y[k:m]] += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n]), pa.array([k[1] for k in n]), pa.array(list(n.values()), pa.int64())], ["wrong", "right", "n"])

    ship(pairs.sparkSession)
    return pairs.select("read", "meant").mapInArrow(run, "wrong string, right string, n bigint").groupBy("wrong", "right").agg(F.sum("n").alias("n"))


def within(text: str, key: str, most: int) -> bool:
    """Whether a text holds a key with at most ``most`` characters altered, put in or left out.

    Of ``most`` + 1 pieces of the key one stands in the text as it is; around each such place the key is aligned.
    """
    if not key or most >= len(key):
        return True
    size = len(key) // (most + 1)
    for p in range(most + 1):
        lo = p * size
        piece = key[lo : lo + size if p < most else len(key)]
        at = text.find(piece)
        while at >= 0:
            part = text[max(0, at - lo - most) : at - lo + len(key) + most]
            row = [0] * (len(part) + 1)  # the key may begin and end anywhere in the part
            for i, x in enumerate(key, 1):
                new = [i]
                for j, y in enumerate(part, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            if min(row) <= most:
                return True
            at = text.find(piece, at + 1)
    return False


def present_cases(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """``(case_id)`` of the cases ``(case_id, text, max_diffs)`` that stand, white space apart, in some text ``(text)``.

    The cases are the stated query set, of fixed size; each task looks for all of them in its texts. A null
    ``max_diffs`` is 0; null texts hold nothing.
    """
    known = [(r.case_id, plain.squash(r.text or ""), r.max_diffs or 0) for r in cases.select("case_id", "text", "max_diffs").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = dict.fromkeys(range(len(known)))
        for b in batches:
            for t in b.column("text").to_pylist():
                t = plain.squash(t or "")
                for k in [k for k in left if known[k][1] in t or known[k][2] and within(t, known[k][1], known[k][2])]:
                    del left[k]
        found = [known[k][0] for k in range(len(known)) if k not in left]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["case_id"])

    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "case_id bigint").distinct()


def table_cases(cells: DataFrame, cases: DataFrame) -> DataFrame:
    """``(case_id, cell, related)``: whether some table holds the case's cell, and with its headings: the left one
    before it in its row, the top one above it in its column. ``cells`` are those of :func:`tables.cells`.

    The cases, of fixed size, are sent to every task.
    """
    c = F.broadcast(cases.select("case_id", T.squash(F.col("text")).alias("k"), T.squash(F.col("left_heading")).alias("l"), T.squash(F.col("top_heading")).alias("t")))
    g = cells.select("page_id", "elem_idx", "row", "col", T.squash(F.col("text")).alias("k"))
    hit = g.join(c, "k")
    heads = g.select("page_id", "elem_idx", F.col("row").alias("hr"), F.col("col").alias("hc"), F.col("k").alias("h"))
    j = hit.join(heads, ["page_id", "elem_idx"], "left")
    left = (F.col("hr") == F.col("row")) & (F.col("hc") < F.col("col")) & (F.col("h") == F.col("l"))
    top = (F.col("hc") == F.col("col")) & (F.col("hr") < F.col("row")) & (F.col("h") == F.col("t"))
    one = j.groupBy("case_id", "page_id", "elem_idx", "row", "col").agg((F.bool_or(left | (F.col("l") == "")) & F.bool_or(top | (F.col("t") == ""))).alias("related"))
    by = one.groupBy("case_id").agg(F.lit(True).alias("cell"), F.bool_or("related").alias("related"))
    return cases.select("case_id").join(by, "case_id", "left").select("case_id", F.coalesce("cell", F.lit(False)).alias("cell"), F.coalesce("related", F.lit(False)).alias("related"))


def bootstrap(scores: DataFrame, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """``(mean, low, high, accept)``: mean of ``score`` over pages with a 95 % interval; accepted if that lies above 0.

    Each page is drawn a Poisson number of times in each replicate, from a hash of page, replicate and seed: sums
    are built where the pages lie, ``replicates`` rows are shuffled.
    """
    import math

    u = (F.pmod(F.xxhash64("page_id", "rep", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    edges, p, total = [], math.exp(-1), 0.0
    for k in range(13):  # beyond 2 ** -30 no draw lies
        total += p
        edges.append(total)
        p /= k + 1
    w = sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    r = scores.select("page_id", "score", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).withColumn("w", w)
    m = r.groupBy("rep").agg((F.sum(F.col("score") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"), F.avg("score").alias("plain"))
    return m.agg(F.first("plain").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")).withColumn("accept", F.col("low") > 0)


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(lost, gained, kept)``: keys ``(page_id, elem_idx)`` that only the earlier, only the later or both runs pass."""
    a = before.select("page_id", "elem_idx").distinct().withColumn("a", F.lit(True))
    b = after.select("page_id", "elem_idx").distinct().withColumn("b", F.lit(True))
    j = a.join(b, ["page_id", "elem_idx"], "full")
    return j.agg(F.count_if(F.col("b").isNull()).alias("lost"), F.count_if(F.col("a").isNull()).alias("gained"), F.count_if(F.col("a") & F.col("b")).alias("kept"))
