"""Problem 4: values that were cut at a field limit or on their way.

Lengths are recomputed as other systems may have stored the value: code points, UTF-8 bytes, UTF-16
units, with entities escaped, with JSON escapes, with CR LF. The lengths are counted by source and
measure; a length at which far more values end than at its neighbours is a hidden limit. So values fall
into two groups, those with the length of a limit and the others. Then endings are inspected: each has a
form (an end mark, an open tag, a short line of a known use, ...). Values that end whole fall on a limit by
chance only; how often they do is the rate by which all counts at limits are measured. What exceeds it is
evidence of cuts: for a form that piles up at limits, wherever it occurs, and for all values at limits. A
value is cut if its form and this evidence together make that the likelier.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from foliant.llm.common import map_batches, texts, without_copies
from foliant.sources.tables import checkpointed

MEASURES = ("chars", "utf8", "utf16", "entities", "json", "crlf")

_HIDDEN = re.compile("[­​-‏⁠﻿]")
_OMISSION = re.compile(r"(?:…|\.{3,}|\[(?:…|\.{3})\]|\((?:…|\.{3})\))$")
_END = re.compile(r"[.!?。！？．｡][\"'”»’」』)\]）*_~`＇]*$")
_DATE = re.compile(r"\d{1,2}\.\d{1,2}\.$|(?:\b(?:on|vom|am|el|em|le|de|от)\s)\d{1,2}\.$")
_ORDINAL = re.compile(r"(?<!\d)\d{1,2}\.$")
_BLOCK_END = re.compile(r"(?:</(?:p|ul|ol|table|div|pre|h[1-6]|html|body|blockquote)>|<br\s*/?>|<hr\s*/?>|-->)$", re.I)
_MARKUP_END = re.compile(r"(?:\\end\{[a-z]+\*?\}|\\\]|\\\)|\}\}|\]\]|\$\$|```|^\|\}|\|)$", re.M)
_INLINE_END = re.compile(r"\]\([^)\s]+\)$|[*_~`']{1,3}$")
_CELLS = re.compile(r" {3,}|\t| \| | & ")
_SENTENCE_INSIDE = re.compile(r"[.!?。](?:\s|$)|。")
_QUOTED = re.compile(r"[“\"«„『「][^“”\"«»„]*[”\"»“』」]$")
_RUN = re.compile(r"\s+")
_CJK = re.compile("[぀-ヿ一-鿿]")

DONE, CUT, LINE, ROW = "done", "cut", "line", "row"


def ending(text: str) -> tuple[str, str, str]:
    """How a text ends, in which form, and its last line.

    What the form alone suggests is DONE (at an end mark or the end of a construct), CUT (in the middle of
    something), LINE (a line of its own without an end mark) or ROW (a whole row, number or date). An empty
    text is DONE.
    """
    t = _HIDDEN.sub("", text).rstrip()
    if not t:
        return DONE, "empty", ""
    if "&lt;" in t or "&amp;" in t:
        if re.search(r"&[a-z]{0,6}$", t):
            return CUT, "reference", ""
        t = html.unescape(t).rstrip()
    last = t.rsplit("\n", 1)[-1].strip()
    if _OMISSION.search(t):
        return CUT, "omission", last
    if "<" in last and re.search(r"<[/!a-zA-Z][^<>\n]*$", last):
        return CUT, "tag", last
    if t[-1] == ">":
        if _BLOCK_END.search(t):
            return DONE, "block", last
        if re.search(r"</?(?:li|td|tr|th|a|b|i|em|span|font|strong|u|code)\b[^<>]*>$", t, re.I):
            if re.search(r"(?:li|td|tr|th)>$", t, re.I):
                return CUT, "list", last
            return (DONE, "mark in tag", last) if _END.search(re.sub(r"(?:</?[a-z]+[^<>]*>\s*)+$", "", t, flags=re.I)) else (CUT, "tagged", last)
    if _END.search(t):
        return (CUT, "date", last) if _DATE.search(t) else (ROW, "ordinal", last) if _ORDINAL.search(t) else (DONE, "mark", last)
    if t.count("\\begin{") > t.count("\\end{"):
        return CUT, "environment", last
    if _MARKUP_END.search(t):
        return DONE, "construct", last
    if _INLINE_END.search(t):
        return (DONE, "mark in emphasis", last) if _END.search(re.sub(r"\]\([^)\s]+\)$|[*_~`']{1,3}$", "", t)) else (CUT, "emphasis", last)
    if _QUOTED.match(last):
        return DONE, "quoted", last
    if "\n" not in t:
        return CUT, "one line", last
    if _CELLS.search(last):
        above = t.rsplit("\n", 2)[-2].strip()
        n = len(_CELLS.split(last))
        whole = last[-1].isdigit() and (n >= 3 or n >= 2 and n == len(_CELLS.split(above)))
        return (ROW, "cells", last) if whole else (CUT, "half cells", last)
    if _SENTENCE_INSIDE.search(last[:-1]) and re.search(r"[^\d][.!?。]\s", last + " "):
        return CUT, "after a sentence", last
    if last[-1] in ",;:(-–—¬‐/&":
        return CUT, "comma", last
    tokens = last.split()
    if len(tokens) > 7 or len(last) > 60 or len(tokens) < 3 and len(last) > 30 and not _CJK.search(last):
        return LINE, "long line", last
    return LINE, "line", last


def line_keys(line: str) -> dict[str, str]:
    """What is counted of a line: the line (digits alike), its first and last word, its shape."""
    flat = re.sub(r"\d+", "0", _RUN.sub(" ", line))
    tokens = flat.split()
    shape = re.sub("[A-Z]", "A", re.sub("[A-Z]+", "A", flat)) if not re.search(r"[^\W\d_A-Z]{4,}", flat) else ""
    return {"L": flat, "F": tokens[0], "E": flat[-3:] if _CJK.search(flat) else tokens[-1] if len(tokens) > 1 else "", "S": shape if "0" in shape else ""}


def _hash(kind: str, s: str) -> int:
    return xxhash.xxh64_intdigest(kind + s) - (1 << 63)


def line_counts(rows: DataFrame) -> DataFrame:
    """``(key, n)``: how often lines, first and last words and shapes occur, by their use.

    L: a line without an end mark that is not the last; O: a line's first word; F, E and S: first
    word, last word and shape of a last line. Counted in each batch before the shuffle; key 0 counts lines,
    key 1 the last lines. Copies of a text count once, so that a cut text cannot vote for itself.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c: Counter = Counter()
        ends = 0
        for t in texts(b, "text"):
            lines = [x.strip() for x in (_HIDDEN.sub("", t) if not t.isascii() else t).rstrip().split("\n")]
            for x in lines[:-1]:
                if x:
                    c["O", re.sub(r"\d+", "0", x.split(None, 1)[0])] += 1
                    if not _END.search(x):
                        c["L", re.sub(r"\d+", "0", _RUN.sub(" ", x))] += 1
            code, _, last = ending(t)
            if code == LINE:
                ends += 1
                for k, s in line_keys(last).items():
                    if s and k != "L":
                        c[k, s] += 1
        total = sum(n for (k, _), n in c.items() if k == "O")
        return pa.RecordBatch.from_arrays([pa.array([0, 1, *(_hash(k, s) for k, s in c)], pa.int64()), pa.array([total, ends, *c.values()], pa.int64())], ["key", "n"])

    return map_batches(without_copies(rows).select("text"), run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def lengths(rows: DataFrame) -> DataFrame:
    """The rows ``(tab, id, idx, source, text)`` with one column for each measure of length."""
    t = F.coalesce(F.col("text"), F.lit(""))

    def count(chars: str):
        return F.length(t) - F.length(F.translate(t, chars, ""))

    chars, nl, amp, angle, quote = F.length(t), count("\n"), count("&"), count("<>"), count('"')
    return rows.select(
        "tab", "id", "idx", "source", "text", chars.alias("chars"), F.octet_length(t).alias("utf8"), (F.octet_length(F.encode(t, "UTF-16BE")) / 2).cast("int").alias("utf16"),
        (chars + 4 * amp + 3 * angle + 5 * quote).alias("entities"), (chars + quote + count("\\") + nl + count("\t")).alias("json"), (chars + nl).alias("crlf"),
    )


def limits(measured: DataFrame, excess: float = 5.0, share: float = 0.01, least: int = 4) -> DataFrame:
    """``(tab, source, measure, limit, values)``: lengths at which the values of a source pile up.

    A limit holds at least ``excess`` times the mean of the 25 lengths on either side, ``least`` values and
    ``share`` of the source's values. All values are counted, over (source, measure, length).
    """
    pairs = ", ".join(f"'{m}', {m}" for m in MEASURES)
    c = measured.selectExpr("tab", "source", f"stack({len(MEASURES)}, {pairs}) as (measure, length)").groupBy("tab", "source", "measure", "length").agg(F.count("*").alias("n"))
    near = W.partitionBy("tab", "source", "measure").orderBy("length").rangeBetween(-25, 25)
    all_ = W.partitionBy("tab", "source", "measure")
    c = c.withColumn("mean", (F.sum("n").over(near) - F.col("n")) / 50).withColumn("total", F.sum("n").over(all_))
    return c.filter((F.col("n") >= least) & (F.col("n") >= excess * F.col("mean")) & (F.col("n") >= share * F.col("total"))).select("tab", "source", "measure", F.col("length").alias("limit"), F.col("n").alias("values"))


def at_limits(measured: DataFrame, found: DataFrame, slack: int = 3) -> DataFrame:
    """``(tab, id, idx, at_limit)`` of the values that have the length of a limit of their source.

    ``slack``: a limit in bytes may cut before a character that would not fit, and spaces may be stripped.
    """
    ends = found.select("tab", "source", "measure", F.explode(F.sequence(F.col("limit") - slack, F.col("limit"))).alias("length")).distinct()
    pairs = ", ".join(f"'{m}', {m}" for m in MEASURES)
    long = measured.selectExpr("tab", "id", "idx", "source", f"stack({len(MEASURES)}, {pairs}) as (measure, length)")
    return long.join(ends, ["tab", "source", "measure", "length"], "left_semi").select("tab", "id", "idx").distinct().withColumn("at_limit", F.lit(True))


#: A line counts as used whole from these shares of all lines, and of all judged last lines; of small data from ``LEAST``.
LINE_SHARE, END_SHARE, LEAST = 3.5e-5, 5e-3, 3


FACTS = "tab string, id bigint, idx int, source string, " + ", ".join(f"{m} int" for m in MEASURES) + ", code string, form string, L bigint, F bigint, O bigint, E bigint, S bigint"


def facts(rows: DataFrame) -> DataFrame:
    """Of each value its lengths, the form of its ending and the keys of its last line; the text goes no further.

    Rows of the tab ``layout`` are HTML tables, whose ending has the form ``closed`` or ``open``.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        codes, forms, keys = [], [], []
        for tab, t in zip(b.column("tab").to_pylist(), texts(b, "text")):
            code, form, last = ending(t) if tab != "layout" else (DONE, "closed", "") if t.rstrip()[-8:].lower() == "</table>" else (CUT, "open", "")
            k = line_keys(last) if code == LINE else {}
            codes.append(code), forms.append(form)
            keys.append([_hash(x, k[y]) if k.get(y) else None for x, y in (("L", "L"), ("F", "F"), ("O", "F"), ("E", "E"), ("S", "S"))])
        names = ["tab", "id", "idx", "source", *MEASURES]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(codes), pa.array(forms), *(pa.array(x, pa.int64()) for x in zip(*keys))], [*names, "code", "form", *"LFOES"])

    return map_batches(lengths(rows), run, FACTS)


#: Chances that a form suggests before any limit is known: that a value that ends so is cut.
SUGGESTS = {DONE: 0.02, CUT: 0.97, LINE: 0.5, ROW: 0.15}
#: Values that are added to either side of a ratio of counts, so that few values say little.
SHRINK = 5.0


def chances(counts: list[tuple[str, bool, str, str, int]]) -> dict[tuple[str, bool, str], float]:
    """The chance that a value is cut, for each tab, group (at a limit or not) and form of ending.

    ``counts (tab, at_limit, code, form, n)``. The odds of what the form suggests, times how much more often than
    by chance the form stands at limits, and at limits times how much more values than by chance stand there.
    """
    out = {}
    for tab in {c[0] for c in counts}:
        mine = [c for c in counts if c[0] == tab]
        at, off = Counter(), Counter()
        for _, limit, _, form, n in mine:
            (at if limit else off)[form] += n
        code = {form: c for _, _, c, form, _ in mine}
        done = [f for f, c in code.items() if c == DONE]
        rate = (sum(at[f] for f in done) + 0.5) / (sum(off[f] for f in done) + 1)  # of whole values, at limits by chance
        more = lambda a, b: math.log((a + SHRINK) / (rate * b + SHRINK))
        group = more(sum(at.values()), sum(off.values())) if at else 0.0
        for _, limit, c, form, _ in mine:
            logit = math.log(SUGGESTS[c] / (1 - SUGGESTS[c])) + (more(at[form], off[form]) if at else 0.0) + limit * group
            out[tab, limit, form] = 1 / (1 + math.exp(-logit))
    return out


def judged(rows: DataFrame) -> DataFrame:
    """``(tab, id, idx, source, at_limit, form, chance)`` of the values of ``rows (tab, id, idx, source, text)``.

    Null and empty values are not judged; a repeated row counts once; a null source counts as "".
    """
    rows = rows.select("tab", F.col("id").cast("bigint").alias("id"), F.col("idx").cast("int").alias("idx"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text").filter("length(text) > 0")
    values = checkpointed(facts(rows))  # read several times
    edge = at_limits(values, limits(values))
    counts = checkpointed(line_counts(rows.filter("tab <> 'layout'")))  # read twice
    lines = values.filter(F.col("code") == LINE).select("tab", "id", "idx", *"LFOES").distinct()
    long = lines.selectExpr("tab", "id", "idx", "stack(5, 'L', L, 'F', F, 'O', O, 'E', E, 'S', S) as (kind, key)").filter("key is not null").join(counts, "key")
    use = long.groupBy("tab", "id", "idx").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias("n" + k) for k in "LFOES"))
    total = counts.agg(*(F.coalesce(F.sum(F.when(F.col("key") == k, F.col("n"))), F.lit(0)).alias(x) for k, x in ((0, "all_lines"), (1, "all_ends"))))
    of_lines, of_ends = (F.greatest(F.lit(LEAST), F.col(x) * y) for x, y in (("all_lines", LINE_SHARE), ("all_ends", END_SHARE)))
    use = use.join(F.broadcast(total)).select(  # one row
        "tab", "id", "idx",
        ((F.col("nL") >= of_lines) | (F.col("nS") >= of_ends)).alias("whole_line"),
        (
            ((F.col("nF") >= of_ends) & (F.col("nF") >= F.col("nO"))) | ((F.col("nE") >= 3) & (F.col("nO") <= F.greatest(F.lit(3), F.col("all_lines") * 1e-3)) & (F.col("nE") >= F.col("all_lines") * 1e-4))
        ).alias("whole_word"),
    )
    known = F.coalesce("whole_line", F.lit(False))
    word = F.coalesce("whole_word", F.lit(False))
    # a line that is used whole elsewhere suggests a whole value, one whose words end texts as well, any other a cut one
    code = F.when(F.col("code") != LINE, F.col("code")).when(known, DONE).when(word & (F.col("form") == "line"), ROW).otherwise(CUT)
    form = F.when(F.col("code") != LINE, F.col("form")).when(known, F.concat(F.lit("known "), "form")).when(word, F.concat(F.lit("worded "), "form")).otherwise(F.col("form"))
    v = values.select("tab", "id", "idx", "source", "code", "form").distinct().join(use, ["tab", "id", "idx"], "left").join(edge, ["tab", "id", "idx"], "left")
    v = checkpointed(v.select("tab", "id", "idx", "source", F.coalesce("at_limit", F.lit(False)).alias("at_limit"), code.alias("code"), form.alias("form")))
    seen = v.groupBy("tab", "at_limit", "code", "form").agg(F.count("*").alias("n")).collect()  # a row for each group and form
    p = chances([tuple(r) for r in seen])
    if not p:
        return v.select("tab", "id", "idx", "source", "at_limit", "form", F.lit(0.0).alias("chance"))
    by = F.create_map(*(F.lit(x) for (tab, at, f), c in sorted(p.items()) for x in (f"{tab} {at} {f}".lower(), c)))
    return v.select("tab", "id", "idx", "source", "at_limit", "form", F.try_element_at(by, F.lower(F.concat_ws(" ", "tab", F.col("at_limit").cast("string"), "form"))).alias("chance"))


def truncated(rows: DataFrame) -> DataFrame:
    """``(tab, id, idx, source, at_limit, form, chance)`` of the values of :func:`judged` that are likelier cut."""
    return judged(rows).filter("chance > 0.5")


def truncation_rates(rows: DataFrame) -> DataFrame:
    """``(tab, source, values, cut, at_limit, share_cut)`` for every source."""
    rows = rows.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    all_ = rows.select("tab", "id", "idx", "source").distinct().groupBy("tab", "source").agg(F.count("*").alias("values"))
    cut = truncated(rows).groupBy("tab", "source").agg(F.count("*").alias("cut"), F.count_if("at_limit").alias("at_limit"))
    zero = F.lit(0).cast("bigint")
    return all_.join(cut, ["tab", "source"], "left").select("tab", "source", "values", F.coalesce("cut", zero).alias("cut"), F.coalesce("at_limit", zero).alias("at_limit"), (F.coalesce("cut", zero) / F.col("values")).alias("share_cut"))
