"""Problem 8: languages of documents and of their segments, by mixture inference.

The languages are those of the labels that occur. Their models are probabilities of hashed character
trigrams, counted over all documents by their labels; a small share of wrong labels only adds a little
noise to each. A document is a mixture: expectation-maximisation estimates the proportions of a set of
languages from the trigram likelihoods of its sentences. The set grows from the likeliest language by the
language that adds most likelihood, as long as it adds more than its penalty, the description length of
one more component. Names, codes, quoted titles, program code and markup are taken out first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.common import codepoints, map_batches, texts
from foliant.llm.lookalike import canonical

# Other notations of labels; any code of two letters stands for itself.
NAMES = {
    "en": "eng english anglais englisch inglés inglês",
    "ko": "kor korean 한국어 koreanisch coréen",
    "de": "deu ger german deutsch allemand alemán",
    "fr": "fra fre french français francais französisch francés",
    "es": "spa spanish español espanol castellano spanisch espagnol",
    "pt": "por portuguese português portugues portugiesisch",
    "ja": "jpn jp japanese 日本語 japanisch japonais",
    "ru": "rus russian русский russisch russe",
    "it": "ita italian italiano italienisch italien",
    "nl": "nld dut dutch nederlands niederländisch",
    "pl": "pol polish polski polnisch polonais",
    "zh": "zho chi chinese 中文 chinesisch chinois",
}
# Codes of two letters that name no language.
NO_LANGUAGE = {"xx", "zz", "na", "no-language"}
_LABEL = {n: k for k, v in NAMES.items() for n in v.split()}

BUCKETS = 1 << 16
_CODE = re.compile(r"^```.*?(?:^```[ \t]*$|\Z)|<pre\b.*?(?:</pre>|\Z)|&lt;pre\b.*?(?:&lt;/pre&gt;|\Z)|\\begin\{(?:verbatim|equation|tabular)\}.*?(?:\\end\{(?:verbatim|equation|tabular)\}|\Z)|\$\$.*?\$\$|<script\b.*?</script>|<style\b.*?</style>", re.S | re.M | re.I)
_MARKUP = re.compile(r"<[/!]?[a-zA-Z][^<>]{0,200}>|&lt;/?[a-zA-Z][^&]{0,80}&gt;|&(?:amp;)?#?\w{2,8};|\]\([^)\s]*\)|\[\[[^\]|\n]*\|(?=[^\]\n]*\]\])|\[\[File:[^\]\n]*\]\]|\{\{[^{}]*\}\}|\$[^$\n]{1,80}\$|\\(?:footnote|cite|ref|label)\*?\{[^{}]*\}|\\[a-zA-Z]+\*?\{?")
_QUOTED = re.compile(r"[“„«「『][^”“»」』\n]{0,120}[”“»」』]")
_HINT = re.compile(r"[<&\\`$\[{“„«「『]")

_fold = np.arange(0x10000, dtype=np.uint32)
_fold[:128] = [ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)]
for _c in range(128, 0x10000):
    if not 0xD800 <= _c < 0xE000:
        _s = chr(_c)
        _fold[_c] = ord(_s.lower()[0]) if _s.isalpha() else 32
_letter = _fold != 32


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label gives; None if it is missing or names no language."""
    s = (label or "").strip().lower().replace("_", "-")
    first = s.split("-")[0]
    code = _LABEL.get(s) or _LABEL.get(first) or (first if len(first) == 2 and first.isascii() and first.isalpha() else None)
    return None if code in NO_LANGUAGE else code


#: Languages that have a model: those with at least this share of all labels that name one (1 / share at most).
LABEL_SHARE = 2e-3


def known_labels(docs: DataFrame, label_col: str = "lang", share: float = LABEL_SHARE) -> list[str]:
    """Codes of the languages of the labels, the most frequent first.

    What reaches the driver are labels with at least a tenth of ``share`` of all rows with a label.
    """
    by = docs.filter(F.length(label_col) > 0).groupBy(F.col(label_col).cast("string").alias("label")).agg(F.count("*").alias("n"))
    by = by.join(F.broadcast(by.agg(F.sum("n").alias("all"))), F.col("n") >= share / 10 * F.col("all"))  # one row
    n: dict[str, int] = {}
    for r in by.collect():
        if code := label_code(r.label):
            n[code] = n.get(code, 0) + r.n
    total = sum(n.values())
    return sorted((k for k in n if n[k] >= share * total), key=lambda k: (-n[k], k))


def plain(text: str) -> str:
    """The text without code, markup and quoted titles, in canonical characters."""
    t = canonical(text)
    if _HINT.search(t):
        t = _CODE.sub("\n\n", t)
        t = _MARKUP.sub(lambda m: "\n" if m[0][:2] in ("</", "<p", "<l", "<h") else " ", t)
        t = _QUOTED.sub(" ", t)
    return t


def segments(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets and letter mask of all characters, starts of the sentences and their documents.

    A sentence ends after an end mark before white space, or before an empty line; a single line end does
    not end it.
    """
    cps, starts = codepoints(strings, "\n\n")
    big = cps > 0xFFFF
    c = np.where(big, 32, cps).astype(np.uint32)
    nxt = np.concatenate([c[1:], [10]])
    space = (nxt == 32) | (nxt == 10) | (nxt == 13) | (nxt == 0x3C) | (nxt == 0x22) | (nxt == 0x201D) | (nxt == 41)
    end = (((c == 46) | (c == 33) | (c == 63)) & space) | np.isin(c, (0x3002, 0xFF01, 0xFF1F))
    para = (c == 10) & (nxt == 10)
    cut = np.flatnonzero(end | para) + 1
    at = np.unique(np.concatenate([starts[:-1], cut[cut < len(c)]]))
    doc = np.searchsorted(starts, at, side="right") - 1
    f = _fold[c]
    a, b = np.concatenate([[32], f[:-1]]), np.concatenate([f[1:], [32]])
    h = (a * np.uint32(0x9E3779B1) ^ f * np.uint32(0x85EBCA77) ^ b * np.uint32(0xC2B2AE3D)).astype(np.uint32)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1), _letter[c], at, doc


def trigram_counts(docs: DataFrame, labels: list[str], label_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(k, bucket, n)``: trigrams of the documents of each label, over all labelled documents."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        codes = [label_code(x) for x in b.column("label").to_pylist()]
        keep = [i for i, k in enumerate(codes) if k in labels]
        if not keep:
            return None
        raw = texts(b, "text")
        h, letter, at, doc = segments([plain(raw[i]) for i in keep])
        lang = np.array([labels.index(codes[i]) for i in keep])
        of = np.repeat(lang[doc], np.diff(np.concatenate([at, [len(h)]])))
        key, n = np.unique(of[letter] * BUCKETS + h[letter].astype(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((key // BUCKETS).astype(np.int32)), pa.array((key % BUCKETS).astype(np.int32)), pa.array(n, pa.int64())], ["k", "bucket", "n"])

    d = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    return map_batches(d, run, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n"))


class Models:
    """The languages and the log-probabilities of the buckets under each, against all: 65,536 numbers for
    each language at any size of the data."""

    def __init__(self, labels: list[str], logp: np.ndarray) -> None:
        self.labels, self.logp = labels, logp

    @classmethod
    def fit(cls, docs: DataFrame, label_col: str = "lang", text_col: str = "text") -> Models:
        """Models of the labels that occur. Without any label there is one language, ``und``."""
        labels = known_labels(docs, label_col)
        n = np.zeros((max(len(labels), 1), BUCKETS))
        if labels:
            t = trigram_counts(docs, labels, label_col, text_col).toPandas()
            n[t["k"].to_numpy(), t["bucket"].to_numpy()] = t["n"].to_numpy()
        back = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * BUCKETS)
        own = n / np.maximum(n.sum(axis=1, keepdims=True), 1)
        return cls(labels or ["und"], np.log((0.95 * own + 0.05 * back) / back).astype(np.float32))


#: Characters overlap in three trigrams: a third of the sum is taken as a sentence's log-likelihood.
TEMPER = 1 / 3


def likelihoods(strings: list[str], logp: np.ndarray):
    """Starts of the sentences of all strings, their strings, their letters and log-likelihoods."""
    h, letter, at, doc = segments(strings)
    w = letter.astype(np.float32)
    size = np.add.reduceat(w, at) if len(at) else np.zeros(0)
    like = np.stack([np.add.reduceat(logp[k][h] * w, at) for k in range(len(logp))], axis=1) * TEMPER if len(at) else np.zeros((0, len(logp)))
    return at, doc, size, like.astype(np.float64)


def _em(like: np.ndarray, doc: np.ndarray, allowed: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions, log-likelihood of each document and responsibilities of its allowed languages."""
    n = len(allowed)
    pi = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    resp = np.zeros_like(like)
    total = np.zeros(n)
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            z = like + np.log(pi)[doc]
        top = z.max(axis=1, keepdims=True)
        e = np.exp(z - top)
        s = e.sum(axis=1, keepdims=True)
        resp = e / s
        total = np.bincount(doc, (np.log(s) + top)[:, 0], n)
        mass = np.stack([np.bincount(doc, resp[:, k], n) for k in range(like.shape[1])], axis=1)
        pi = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-9)
    return pi, total, resp


def language_sets(like: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set of languages of each document by penalised likelihood, and the proportions and responsibilities
    under it.

    A set is as good as its log-likelihood after expectation-maximisation less, for each language beyond the
    first, half the logarithm of the letters (one more proportion) and the logarithm of the number of
    languages (which one). It grows by the best further language while that makes it better.
    """
    k = like.shape[1]
    single = np.stack([np.bincount(doc, like[:, j], n) for j in range(k)], axis=1)
    allowed = np.zeros((n, k), bool)
    allowed[np.arange(n), single.argmax(axis=1)] = True
    penalty = 0.5 * np.log(np.bincount(doc, size, n) + 1) + np.log(k)
    active = np.bincount(doc, minlength=n) > 1
    while active.any():
        rows = np.flatnonzero(active)
        place = np.cumsum(active) - 1
        mine = active[doc]
        d, l = place[doc[mine]], like[mine]
        pi, now, _ = _em(l, d, allowed[rows], rounds)
        with np.errstate(divide="ignore"):
            z = l + np.log(pi)[d]
        top = z.max(axis=1)
        mix = np.log(np.exp(z - top[:, None]).sum(axis=1)) + top
        # one more component of each language beside the mixture: only its weight is estimated
        ratio = np.exp(np.clip(l - mix[:, None], -60, 60))
        weight = np.full((len(rows), k), 0.2)
        for _ in range(rounds):
            w = weight[d]
            r = w * ratio
            r /= r + 1 - w
            weight = np.stack([np.bincount(d, r[:, j], len(rows)) for j in range(k)], axis=1) / np.maximum(np.bincount(d, minlength=len(rows)), 1)[:, None]
        w = weight[d]
        better = np.log(w * ratio + 1 - w)
        gain = np.stack([np.bincount(d, better[:, j], len(rows)) for j in range(k)], axis=1)
        gain[allowed[rows]] = -np.inf
        best = gain.argmax(axis=1)
        grow = gain[np.arange(len(rows)), best] > penalty[rows]
        allowed[rows[grow], best[grow]] = True
        active[:] = False
        active[rows[grow]] = True
    pi, _, resp = _em(like, doc, allowed, rounds)
    return allowed, pi, resp


# A sentence ends in an end mark; one wholly in brackets is an insertion (a name, code or title), no sentence.
_SENTENCE = re.compile(r"(?!\s*[(\[（][^()\[\]（）]*[)\]）]\W*$).*[.!?。！？]$", re.S)


def _found(strings: list[str], models: Models):
    """For each document its languages: (document, language, sentences, share, confidence, main) and the sentences.

    A further language needs a whole sentence, one that ends in an end mark and is not wholly in brackets.
    """
    at, doc, size, like = likelihoods(strings, models.logp)
    n, k = len(strings), like.shape[1]
    allowed, pi, resp = language_sets(like, doc, size, n)
    given = resp.argmax(axis=1) if len(doc) else np.zeros(0, int)
    letters = np.stack([np.bincount(doc[given == j], size[given == j], n) for j in range(k)], axis=1) if len(doc) else np.zeros((n, k))
    main = letters.argmax(axis=1)
    flat = "\n\n".join(strings) + "\n\n"
    ends = np.concatenate([at[1:], [len(flat)]])
    whole = np.ones(len(doc), bool)
    for s in np.flatnonzero(given != main[doc]):  # few: sentences of a further language
        whole[s] = size[s] > 0 and _SENTENCE.match(flat[at[s] : ends[s]].strip()) is not None
    count = np.stack([np.bincount(doc[(given == j) & whole & (size > 0)], minlength=n) for j in range(k)], axis=1) if len(doc) else np.zeros((n, k), int)
    is_main = np.zeros((n, k), bool)
    has = np.bincount(doc, size, n) > 0 if len(doc) else np.zeros(n, bool)
    is_main[np.arange(n)[has], main[has]] = True
    more = (count > 0) & allowed
    # confidence: a document's mean responsibility of the language over the letters of the sentences given to it
    r = resp[np.arange(len(doc)), given]
    conf = np.zeros((n, k))
    np.add.at(conf, (doc, given), r * size)
    conf = np.where(letters > 0, conf / np.maximum(letters, 1e-9), 0)
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1e-9)
    rows, cols = np.nonzero(more | is_main)
    return (rows, cols, count[rows, cols], share[rows, cols], conf[rows, cols], is_main[rows, cols]), (at, ends, doc, given, r, size, more | is_main, flat)


def document_languages(docs: DataFrame, id_col: str = "doc_id", label_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(doc_id, label, code, lang, sentences, share, confidence, main)``: a row for each language of a document.

    Null, empty and letterless texts have no language; repeated rows are judged each.
    """
    models = Models.fit(docs, label_col, text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        (rows, cols, count, share, conf, main), _ = _found([plain(t) for t in texts(b, "text")], models)
        pick = pa.array(rows.astype(np.int32))
        names = [models.labels[k] for k in cols]
        return pa.RecordBatch.from_arrays([b.column("id").take(pick), b.column("label").take(pick), pa.array([label_code(x) for x in b.column("label").to_pylist()], pa.string()).take(pick), pa.array(names, pa.string()), pa.array(count, pa.int32()), pa.array(share, pa.float64()), pa.array(conf, pa.float64()), pa.array(main)], ["doc_id", "label", "code", "lang", "sentences", "share", "confidence", "main"])

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    return map_batches(d, run, "doc_id bigint, label string, code string, lang string, sentences int, share double, confidence double, main boolean", chars=3_000_000)


def segment_languages(docs: DataFrame, id_col: str = "doc_id", label_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(doc_id, seg_idx, lang, confidence, segment)``: neighbouring sentences of one language, in order."""
    models = Models.fit(docs, label_col, text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        _, (at, ends, doc, given, r, size, allowed, flat) = _found([plain(t) for t in texts(b, "text")], models)
        ids = b.column("id").to_pylist()
        out: list[list] = []
        last = None
        for s in range(len(doc)):
            if not size[s]:
                continue
            d, k = int(doc[s]), int(given[s])
            if not allowed[d, k]:
                k = int(np.flatnonzero(allowed[d])[0]) if allowed[d].any() else k
            if last != (d, k):
                i = out[-1][1] + 1 if out and out[-1][5] == d else 0
                out.append([ids[d], i, models.labels[k], 0.0, "", d, 0.0])
                last = (d, k)
            out[-1][4] += flat[at[s] : ends[s]]
            out[-1][3] += float(r[s] * size[s])
            out[-1][6] += float(size[s])
        cols = list(zip(*out)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array([a / n for a, n in zip(cols[3], cols[6])], pa.float64()), pa.array([" ".join(x.split()) for x in cols[4]], pa.string())], ["doc_id", "seg_idx", "lang", "confidence", "segment"])

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_batches(d, run, "doc_id bigint, seg_idx int, lang string, confidence double, segment string", chars=3_000_000)


def mislabelled(docs: DataFrame, id_col: str = "doc_id", label_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(doc_id, found_lang)``: documents without the right label, or of several languages; a row a language."""
    d = document_languages(docs, id_col, label_col, text_col)
    d = d.withColumn("right", (F.col("code") == F.col("lang")) & F.col("main"))
    by = d.groupBy("doc_id").agg(F.bool_or("right").alias("right"), F.count_distinct("lang").alias("n"), F.collect_set("lang").alias("langs"))
    return by.filter(~F.coalesce("right", F.lit(False)) | (F.col("n") > 1)).select("doc_id", F.explode("langs").alias("found_lang"))
