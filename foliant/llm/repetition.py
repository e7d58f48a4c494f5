"""Problem 2: repetition inside a single document, by n-gram perplexity.

Texts are turned into token hashes once. A modified Kneser-Ney model of trigrams is counted over them in
Spark and stored as sorted arrays of n-gram hashes. Each text has three perplexities: under the model;
under the lowest order of the model alone; and under n-grams of the text's own words so far that back off
to that lowest order. What a text repeats costs nothing under its own history, whether or not the corpus
predicts it, so the ratio of the last two falls by about the share of what is repeated. Bands of each
language, lower and upper for the perplexity and lower for the ratio, are taken from all texts and reject
the texts outside. Copies of a text count once in the model and in the bands. The language of a text is
judged by word frequencies that are counted from the labels. The repeated share of every text is
measured exactly on its characters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from foliant.llm.common import copies_marked, map_batches, mix, texts
from foliant.llm.languages import known_labels, label_code
from foliant.sources.tables import checkpointed

_OTSL = re.compile(r"<(?:fcel|ched|ecel|lcel|ucel|xcel)>")
_ROW = re.compile(r"<nl>")
_TOKEN = re.compile(r"[^\W\d_぀-ヿ一-鿿]+|\d{1,4}|[^\w\s]|\w")
_DIGIT = re.compile(r"\d+")

#: The model keeps the n-grams that make up at least this share of all tokens; the others back off, as in
#: any pruned model. It bounds each array by 1 / PRUNE entries and behaves alike at every size.
PRUNE = 1e-6
#: Words of the language model that judges languages: those with at least this share of all tokens.
WORDS = 1e-5


def content(text: str) -> str:
    """The text in one case; the tokens of OTSL are no content, a table row is a line."""
    t = text.casefold()
    if "<" in t:
        t = _ROW.sub("\n", _OTSL.sub(" ", t))
    return t


class _Hashes(dict):
    """31-bit hashes of the tokens of a run without white space; numbers are alike. Emptied at 300,000 runs."""

    def __missing__(self, run: str) -> list[int]:
        if len(self) > 300_000:
            self.clear()
        h = [xxhash.xxh32_intdigest(_DIGIT.sub("0", w)) & 0x7FFFFFFF for w in tokens_of(run)]
        if len(run) <= 40:
            self[run] = h
        return h


_hashes = _Hashes()
_START = 0x5BD1E995 & 0x7FFFFFFF
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(folded: str) -> list[str]:
    """Words, signs, numbers in groups of four digits; a word of over 20 letters, which is more likely a
    loop of letters, in pairs."""
    found = _TOKEN.findall(folded)
    if found and max(map(len, found)) > 20:
        found = [p for w in found for p in ([w] if len(w) <= 20 else [w[i : i + 2] for i in range(0, len(w), 2)])]
    return found


# The exact share


_B = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_SHORT = 4096
_RUN = b"\1" * 8


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B, dtype=np.uint64)]))


def _pairs(n: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths ``lo`` to ``hi`` of all blocks k p to (k + 1) p whose next block still lies in ``n``."""
    p = np.arange(lo, hi, dtype=np.int64)
    m = np.maximum(n // p - 1, 0)
    of = np.repeat(p, m)
    k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
    return k * of, of


_POWERS = _powers(_SHORT)
_start, _length = _pairs(_SHORT, 9, _SHORT // 2 + 1)
_by_end = np.argsort(_start + 2 * _length, kind="stable")
#: The pairs of blocks that fit a text of n characters are the first ones in this order.
_STARTS, _LENGTHS = _start[_by_end], _length[_by_end]
_ENDS = _STARTS + 2 * _LENGTHS


def _periods(a: np.ndarray) -> list[int]:
    """All periods of which the text ``a`` may hold three rounds in a row, over 8 characters at least.

    Periods up to 8 are tried. Three rounds of a longer period p cover two neighbouring blocks k p to (k + 1) p
    and (k + 1) p to (k + 2) p, and these are equal; so every period is found by comparing all such blocks, by
    their ends first and then by hashes: n log n comparisons for a text of n characters, of any length.
    """
    n = len(a)
    out = [p for p in range(1, min(9, n)) if (a[p:] == a[:-p]).tobytes().find(_RUN) >= 0]
    if n <= _SHORT:
        m = int(np.searchsorted(_ENDS, n, side="right"))
        parts = [(_STARTS[:m], _LENGTHS[:m])]
        power = _POWERS
    else:
        power = _powers(n)
        edges = [9]
        while edges[-1] <= n // 3:
            edges.append(min(n // 3 + 1, edges[-1] * 2))
        parts = (_pairs(n, lo, hi) for lo, hi in zip(edges, edges[1:]))
    h = None
    for s, p in parts:
        ok = np.flatnonzero(a.take(s) == a.take(s + p))
        s, p = s.take(ok), p.take(ok)
        ok = a[s + p - 1] == a[s + 2 * p - 1]
        s, p = s[ok], p[ok]
        if len(s):
            with np.errstate(over="ignore"):
                if h is None:
                    h = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:n])])
                p = p[(h[s + p] - h[s]) * power[p] == h[s + 2 * p] - h[s + p]]
            out += set(p.tolist())
    return out


def lines_of(folded: str) -> list[list[str]]:
    """The lines of a text as runs without white space."""
    return [x.split() for x in folded.split("\n")]


def units_of(lines: list[list[str]]) -> list[str]:
    """Sentences, lines and table rows in order, without white space."""
    t = "\n".join(map(" ".join, lines))
    for mark in ".!?":
        t = t.replace(mark + " ", mark + "\n")
    if not t.isascii():
        for mark in "。！？":
            t = t.replace(mark, mark + "\n")
    return t.replace(" ", "").split("\n")


def repeated_share(lines: list[list[str]], least_unit: int = 8, repeats: int = 3) -> float:
    """The share of the characters of the lines of a text, without white space, that are further copies.

    Copies of a whole sentence, line or table row of at least ``least_unit`` characters; and the further
    rounds of anything shorter that follows itself ``repeats`` times or more, over 8 characters at least.
    An empty text has none.
    """
    units = units_of(lines)
    s = "".join(units)
    n = len(s)
    if not n:
        return 0.0
    copied = None
    if len(set(units)) < len(units):
        copied = np.zeros(n, dtype=bool)
        at, seen = 0, set()
        for k in units:
            if len(k) >= least_unit:
                if k in seen:
                    copied[at : at + len(k)] = True
                seen.add(k)
            at += len(k)
    a = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for p in _periods(a):
        same = np.zeros(n - p + 2, dtype=np.int8)
        same[1:-1] = a[p:] == a[:-p]
        edge = np.flatnonzero(np.diff(same))
        i, j = edge[::2], edge[1::2]
        long = j - i >= max((repeats - 1) * p, 8)
        if long.any():
            copied = np.zeros(n, dtype=bool) if copied is None else copied
            for x, y in zip(i[long].tolist(), j[long].tolist()):
                copied[x + p : y + p] = True
    return 0.0 if copied is None else float(copied.mean())


TOKENS = "tab string, id bigint, idx int, label string, copy boolean, share double, tokens array<int>"


def tokenised(rows: DataFrame) -> DataFrame:
    """``(tab, id, idx, label, copy, share, tokens)`` of ``rows (tab, id, idx, lang, text)``.

    The only pass over the texts. ``label`` is the code of the language label, ``copy`` marks the further
    copies of a hot text. Null and empty texts have no tokens and share 0.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes, share = [], [0], []
        get = _hashes.__getitem__
        for t in texts(b, "text"):
            lines = lines_of(content(t))
            for line in lines:
                for x in map(get, line):
                    flat += x
            sizes.append(len(flat))
            share.append(repeated_share(lines))
        labels = pa.array([label_code(x) for x in b.column("lang").to_pylist()], pa.string())
        tokens = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tab", "id", "idx")), labels, b.column("copy"), pa.array(share, pa.float64()), tokens], ["tab", "id", "idx", "label", "copy", "share", "tokens"])

    d = copies_marked(rows).select("tab", F.col("id").cast("bigint").alias("id"), F.col("idx").cast("int").alias("idx"), F.col("lang").cast("string").alias("lang"), "copy", "text")
    return map_batches(d, run, TOKENS)


def encoded(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a batch, two starts before each text, and the index of each token's text."""
    lists = b.column("tokens")
    n = np.diff(lists.offsets.to_numpy())
    own = np.repeat(np.arange(len(n)), n + 2)
    t = np.full(len(own), _START, dtype=np.uint64)
    inner = np.ones(len(own), dtype=bool)
    first = np.concatenate([[0], np.cumsum(n + 2)[:-1]]) if len(n) else np.zeros(0, np.int64)
    inner[first], inner[first + 1] = False, False
    t[inner] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
    return t, own


def _key(*parts: np.ndarray) -> np.ndarray:
    """64-bit hash of n-grams given token by token."""
    h = mix(parts[0].astype(np.uint64) * _M2)
    for x in parts[1:]:
        h = _longer(h, x)
    return h


def _longer(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The hashes of n-grams with one more token."""
    return mix(h * _M2 + x.astype(np.uint64))


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by hash, equal ones as they come, and where each group begins.

    The leading bits of the hash and the position are sorted as one number, which leaves 64 less log n bits.
    """
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64(len(h).bit_length())
    x = np.sort((h >> low << low) | np.arange(len(h), dtype=np.uint64))
    k = x >> low
    return (x & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))


def _earlier(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element, how many equal ones stand before it, and how many there are in all."""
    order, start = _groups(h)
    size = np.diff(np.append(start, len(order)))
    rank, all_ = np.empty(len(h), dtype=np.int64), np.empty(len(h), dtype=np.int64)
    rank[order] = np.arange(len(h)) - np.repeat(start, size)
    all_[order] = np.repeat(size, size)
    return rank, all_


def _parts(b: pa.RecordBatch, rows: int):
    """The batch in parts that stay in the processor's cache."""
    return (b.slice(i, rows) for i in range(0, b.num_rows, rows))


def gram_counts(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """``(k, a, b, c, n)``: trigrams (k 0), and words b of each label a (k 1), and how many texts have each.

    A text counts once, so that a loop does not teach the model its own words; hot copies count once.
    Counted in each batch before the shuffle; the number of partitions follows from the number of tokens.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols: list[list[np.ndarray]] = []
        for part in _parts(batch, 10_000):
            t, own = encoded(part)
            if len(t) < 3:
                continue
            ok = own[2:] == own[:-2]
            a, b, c, of = t[:-2][ok], t[1:-1][ok], t[2:][ok], own[2:][ok].astype(np.uint64)
            order, start = _groups(_longer(_key(a, b, c), of + np.uint64(1)))
            once = order[start]
            a, b, c, of = a[once], b[once], c[once], of[once]
            order, start = _groups(_key(a, b, c))
            first = order[start]
            cols.append([np.zeros(len(first)), a[first], b[first], c[first], np.diff(np.append(start, len(order)))])
            lang = np.array([index.get(x, -1) for x in part.column("label").to_pylist()])[of.astype(np.int64)]
            c, lang = c[lang >= 0], lang[lang >= 0]
            order, start = _groups(_key(lang, c))
            first = order[start]
            cols.append([np.ones(len(first)), lang[first], c[first], np.zeros(len(first)), np.diff(np.append(start, len(order)))])
        if not cols:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in zip(*cols)], ["k", "a", "b", "c", "n"])

    index = {x: i for i, x in enumerate(labels)}
    all_ = tokens.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first().n
    g = map_batches(tokens.filter("not copy").select("label", "tokens"), run, "k int, a int, b int, c int, n int")
    return g.repartition(max(1, all_ // 2_000_000), "k", "a", "b", "c").groupBy("k", "a", "b", "c").agg(F.sum("n").alias("n"))


def _discounts(df: DataFrame, col: str) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts (one row)."""
    r = df.agg(*(F.count_if(F.col(col) == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (max(r[f"n{k}"], 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k) for k, d in ((0.9, 1 - 2 * y * n2 / n1), (1.8, 2 - 3 * y * n3 / n2), (2.7, 3 - 4 * y * n4 / n3)))


class Arrays:
    """A sorted array of hashes with a number for each, entered through the leading bits of the hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(len(keys) + 2)))))
        starts = np.searchsorted(self.keys, np.arange(1 << int(64 - int(self.shift)), dtype=np.uint64) << self.shift)
        self.starts = starts.astype(np.int32)
        self.most = int(np.diff(np.append(starts, len(keys))).max(initial=0))
        self.keys = np.append(self.keys, np.uint64(2**64 - 1))  # a place to look at the end
        self.values = np.append(self.values, np.float32(0))

    def get(self, h: np.ndarray, other: float) -> np.ndarray:
        out = np.full(len(h), other, dtype=np.float32)
        at = self.starts[(h >> self.shift).astype(np.int64)]
        rest = np.arange(len(h))
        for _ in range(self.most):
            k = self.keys[at]
            hit = k == h[rest]
            out[rest[hit]] = self.values[at[hit]]
            go = k < h[rest]
            rest, at = rest[go], at[go] + 1
            if not len(rest):
                break
        return out


class KneserNey:
    """Probabilities of trigrams, bigrams and words, less their discounts, and the weights of back-off; and
    the words of each language."""

    def __init__(self, t3: Arrays, g2: Arrays, t2: Arrays, g1: Arrays, t1: Arrays, floor: float, words: Arrays, by_label: np.ndarray) -> None:
        self.t3, self.g2, self.t2, self.g1, self.t1, self.floor, self.words, self.by_label = t3, g2, t2, g1, t1, floor, words, by_label

    @classmethod
    def fit(cls, counted: DataFrame, labels: list[str]) -> KneserNey:
        """The model of the counts of :func:`gram_counts`, a table that is read several times."""
        three = counted.filter("k = 0")
        total = three.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        least = max(2, int(PRUNE * total))
        two = checkpointed(three.groupBy("b", "c").agg(F.count("*").alias("n"), F.sum("n").alias("seen")))
        one = two.groupBy("c").agg(F.count("*").alias("n"), F.sum("seen").alias("seen"))
        types = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()

        def order(df: DataFrame, keys: list[str]) -> tuple[Arrays, Arrays]:
            ctx = keys[:-1]
            d1, d2, d3 = _discounts(df, "n")
            disc = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            contexts = df.groupBy(*ctx).agg(F.sum("n").alias("all"), F.sum(disc).alias("off"), F.sum("seen").alias("often")).filter(F.col("often") >= least)
            kept = df.filter(F.col("seen") >= least).join(contexts, ctx).select(*keys, ((F.col("n") - disc) / F.col("all")).alias("p")).toPandas()
            back = contexts.select(*ctx, (F.col("off") / F.col("all")).alias("g")).toPandas()
            return Arrays(_key(*(kept[x].to_numpy() for x in keys)), kept["p"].to_numpy()), Arrays(_key(*(back[x].to_numpy() for x in ctx)), back["g"].to_numpy())

        t3, g2 = order(three.withColumn("seen", F.col("n")), ["a", "b", "c"])
        t2, g1 = order(two, ["b", "c"])
        words = one.filter(F.col("seen") >= least).select("c", (F.col("n") / F.lit(float(max(types.n, 1)))).alias("p")).toPandas()
        # the frequent words of each label: 1 / WORDS at most
        w = counted.filter("k = 1").groupBy("b").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("by")).filter(F.col("n") >= max(2, WORDS * total)).select("b", "by").toPandas()
        n = np.zeros((len(w), max(len(labels), 1)))
        for i, by in enumerate(w["by"]):
            for k, v in by.items():
                n[i, k] = v
        share = (n + 0.05) / (n.sum(axis=0) + 1)
        by_label = np.concatenate([np.log(share / share.mean(axis=1, keepdims=True)), np.zeros((1, share.shape[1]))]).astype(np.float32)
        return cls(t3, g2, t2, g1, Arrays(_key(words["c"].to_numpy()), words["p"].to_numpy()), 0.5 / max(types.n + types.words, 2), Arrays(_key(w["b"].to_numpy()), np.arange(len(w))), by_label)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return self.t1.get(_key(c), 0.0).astype(np.float64) * 0.95 + self.floor

    def trigram(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, p1: np.ndarray) -> np.ndarray:
        kb, kab = _key(b), _key(a, b)
        p2 = self.t2.get(_longer(kb, c), 0.0) + self.g1.get(kb, 1.0) * p1
        return np.clip(self.t3.get(_longer(kab, c), 0.0) + self.g2.get(kab, 1.0) * p2, 1e-12, 1.0)

    def language(self, c: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """The index of the label whose words a text has most likely; -1 without labels or words."""
        if self.by_label.shape[0] == 1:
            return np.full(n, -1)
        at = self.words.get(_key(c), -1).astype(np.int64)
        known = at >= 0
        score = np.stack([np.bincount(of[known], self.by_label[at[known], k], n) for k in range(self.by_label.shape[1])], axis=1)
        return np.where(np.bincount(of[known], minlength=n) > 0, score.argmax(axis=1), -1)


#: Weights of a text's own n-grams against the model's lowest order; each text takes its likeliest, or none.
MIXES = (0.5, 0.9, 0.99)


def bits(model: KneserNey, t: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of each text the tokens, its bits under the model, under the lowest order and with its own history,
    and the index of its language."""
    zero = np.zeros(n)
    if len(t) < 3:
        return zero, zero, zero, zero, np.full(n, -1)
    ok = own[2:] == own[:-2]
    a, b, c, of = t[:-2][ok], t[1:-1][ok], t[2:][ok], own[2:][ok]
    p1 = model.unigram(c)
    plain = np.bincount(of, -np.log2(model.trigram(a, b, c, p1)), n)
    base = np.bincount(of, -np.log2(p1), n)
    context = _longer(_key(a, b), of + np.uint64(1))
    r2, size = _earlier(context)
    again = size > 1  # elsewhere the history says nothing
    r2, r3 = r2[again], _earlier(_longer(context[again], c[again]))[0]
    p, at, history = p1[again], of[again], r3 / np.maximum(r2, 1)
    first = r2 == 0
    history[first] = p[first]
    saved = np.zeros(n)
    for w in MIXES:
        saved = np.maximum(saved, np.bincount(at, np.log2((1 - w) + w * history / p), n))
    return np.bincount(of, minlength=n), plain, base, base - saved, model.language(c, of, n)


SCORED = "tab string, id bigint, idx int, lang string, tokens int, bits double, ratio double, share double"


def scored(tokens: DataFrame, model: KneserNey, labels: list[str]) -> DataFrame:
    """``(tab, id, idx, lang, tokens, bits, ratio, share)`` of every row of :func:`tokenised`: bits a token under
    the model, and the bits with its own history against those of the lowest order."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, plain, base, own, lang = (np.concatenate(x) for x in zip(*(bits(model, *encoded(p), p.num_rows) for p in _parts(b, 300))))
        m = np.maximum(n, 1)
        names = [labels[k] if k >= 0 else "und" for k in lang.tolist()]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tab", "id", "idx")), pa.array(names, pa.string()), pa.array(n, pa.int32()), pa.array(plain / m), pa.array(np.where(base > 0, own / np.maximum(base, 1e-9), 1.0)), b.column("share")], ["tab", "id", "idx", "lang", "tokens", "bits", "ratio", "share"])

    return map_batches(tokens.select("tab", "id", "idx", "share", "tokens"), run, SCORED)


def bands(s: DataFrame, width: float = 3.0, inner: float = 0.5) -> DataFrame:
    """``(tab, lang, lower, upper, least_ratio)``: the band of perplexity (bits a token) of each language, and
    the least ratio.

    Half-widths are ``width`` times (for the ratio, ``inner`` times) the distance of the median from the 20th
    and 80th percentiles. Copies of a text, which have the same bits, count once.
    """
    q = lambda c: F.percentile_approx(c, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)), 1000)
    b = s.filter("tokens > 0").select("tab", "lang", "tokens", "bits", "ratio").distinct().groupBy("tab", "lang").agg(q("bits").alias("q"), q("ratio").alias("r"))
    return b.select(
        "tab", "lang", (F.col("q")[1] - width * (F.col("q")[1] - F.col("q")[0])).alias("lower"), (F.col("q")[1] + width * (F.col("q")[2] - F.col("q")[1])).alias("upper"), (F.col("r")[1] - inner * (F.col("r")[1] - F.col("r")[0])).alias("least_ratio"),
    )


def repetition(rows: DataFrame) -> DataFrame:
    """Every row of ``rows (tab, id, idx, lang, text)`` with ``lang, tokens, bits, ratio, share`` and ``rejected``:
    whether one of its perplexities lies outside the bands of its language. A repeated row counts once.
    """
    tokens = checkpointed(tokenised(rows))  # read three times
    labels = known_labels(tokens.select(F.col("label").alias("lang")))
    model = KneserNey.fit(checkpointed(gram_counts(tokens, labels)), labels)
    s = checkpointed(scored(tokens, model, labels))
    outside = (F.col("bits") < F.col("lower")) | (F.col("bits") > F.col("upper")) | (F.col("ratio") < F.col("least_ratio"))
    return s.join(F.broadcast(bands(s)), ["tab", "lang"], "left").withColumn("rejected", F.coalesce(outside, F.lit(False))).drop("lower", "upper", "least_ratio").distinct()  # a row for each language


def repetitive(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """``(tab, id, idx)`` of the rejected rows of which at least ``least`` is repeated content."""
    return repetition(rows).filter(F.col("rejected") & (F.col("share") >= least)).select("tab", "id", "idx").distinct()
