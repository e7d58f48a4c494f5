"""Problem 6: held-out texts in a corpus, by q-gram lemma filtering and banded alignment.

Texts and cases are folded to their letters and digits: case, width, accents, spacing, punctuation and
line ends do not count. The q-grams of a document that some case has are counted for each case in bands
of diagonals (position in the document less position in the case); neighbouring bands overlap by half.
By the q-gram lemma, a run keeps all its q-grams but those that an altered word touches. The bound of a
case is what the poorest half of it keeps at worst when one word in six is altered, the words that touch
most q-grams first, and the lines of page breaks stand in between, but ``FLOOR`` of its q-grams at least.
Q-grams that many cases share tell nothing and are left out on both sides; the bound counts only those that
remain. A case that is too short for q-grams is compared by its words with every document. Bands that reach
the bound are aligned word by word within the band, under the edit budget of a run.

The cases are the stated query set: their number is fixed, and they are sent to every task. Documents are
not shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.common import codepoints, map_batches, mix, texts
from foliant.llm.lookalike import canonical

#: Lengths of q-grams, of cases of ordinary words and of cases whose words are single letters (Japanese).
LENGTHS = (10, 5)
#: The least share of the q-grams of the poorest half that is asked for. The worst case of the lemma may be none
#: at all, as when only the longest words are altered on both sides of a page break; a run that keeps less than
#: this share is found only by the exact search (``exact=True``), which aligns every document with every case.
FLOOR = 0.3
#: Width of a band of diagonals in letters; bands overlap by half, which is more than the lines of a page
#: break and the words put in or left out of a run shift it.
BAND = 256
#: One word in so many of a run may be altered.
ALTERED = 6
STRETCH = 60
#: More words in a row that are not found end a run.
GAP = 8
_MARKUP = re.compile(r"<[/!]?[a-zA-Z][^<>]*>|&(?:amp;)?(?:lt|gt|nbsp|amp|quot|#\d+|#x[0-9a-f]+);(?:/?[a-z]+&(?:amp;)?gt;)?|\]\([^)\s]*\)|\[\[[^\]|\n]*\|(?=[^\]\n]*\]\])|\{\{[^{}\n]*\}\}|\\(?:footnote|cite|ref|label)\*?\{[^{}]*\}|\\[a-zA-Z]+\*?(?=[{\s])|\$[^$\n]+\$", re.I)
_HINT = re.compile(r"[<&\\\[{$]")
_WORD = re.compile(r"[぀-ヿ一-鿿]|[^\W_]+")

_fold = np.zeros(0x10000, dtype=np.uint32)
for _c in range(0x10000):
    if not 0xD800 <= _c < 0xE000 and chr(_c).isalnum():
        _s = unicodedata.normalize("NFKD", chr(_c).lower())
        _fold[_c] = _c if "가" <= chr(_c) <= "힣" else ord(_s[0]) if _s else _c


def plain(text: str) -> str:
    """The text without markup, in canonical characters, words divided at line ends joined."""
    t = canonical(re.sub("[-‐¬\xad][ \t]*\n[ \t]*", "", text)) if "\n" in text else canonical(text)
    return _MARKUP.sub(" ", t) if _HINT.search(t) else t


def letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters and digits of all strings, their places in the joined string and their strings."""
    cps, starts = codepoints(strings)
    f = np.where(cps < 0x10000, _fold[np.minimum(cps, 0xFFFF)], cps)
    at = np.flatnonzero(f)
    return f[at], at, np.searchsorted(starts, at, side="right") - 1


def qgrams(f: np.ndarray, of: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the q-grams that lie within one string, and where each begins."""
    if len(f) < q:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(f) - q + 1, dtype=np.uint64)
    for i in range(q):
        h = h * np.uint64(0x100000001B3) + f[i : len(f) - q + 1 + i]
    ok = np.flatnonzero(of[: len(h)] == of[q - 1 :])
    return mix(h[ok]), ok


def words(text: str) -> list[str]:
    """Folded words; of Japanese the single letters."""
    out = []
    for w in _WORD.findall(text.lower()):
        if not w.isascii() and not "가" <= w[0] <= "힣":
            w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) or w
        out.append(w)
    return out


def alike(a: str, b: str) -> bool:
    """Whether two words are equal or one is a slightly misread form of the other."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 2 or min(n, m) < 3:
        return False
    limit = 1 if max(n, m) <= 5 else 2 if max(n, m) <= 9 else 3
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(n, m) - i and a[n - 1 - j] == b[m - 1 - j]:
        j += 1
    a, b = a[i : n - j], b[i : m - j]  # what lies between the first and the last difference
    n, m = len(a), len(b)
    if max(n, m) <= limit:
        return True
    if i + j == 0:
        return False
    prev = list(range(m + 1))
    for i in range(1, n + 1):
        cur = [i] + [0] * m
        for j in range(1, m + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
        if min(cur) > limit:
            return False
        prev = cur
    return prev[m] <= limit


def lemma_bound(sizes: np.ndarray, kept: np.ndarray, q: int) -> tuple[int, int]:
    """The q-grams of the poorest half of a case, and what it keeps of them at worst.

    ``sizes`` are the letters of its words, ``kept`` says which of its q-grams count. Of a half, one word in
    ``ALTERED`` is altered, and every page break takes the q-grams across it. Any half has a stretch of ``STRETCH``
    words in which no more than that share is altered, so longer halves need what such a stretch keeps.
    """
    n = len(sizes)
    half = min((n + 1) // 2, STRETCH)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = np.concatenate([[0], np.cumsum(kept)])
    count = lambda a, b: total[np.clip(b, 0, len(kept))] - total[np.clip(a, 0, len(kept))]
    worst = poorest = None
    altered, breaks = -(-half // ALTERED), 1 + half // 20
    for i in range(n - half + 1):
        lo, hi = starts[i], ends[i + half - 1] - q + 1
        if hi <= lo:
            return 0, 0
        w = slice(i, i + half)
        touched = count(np.maximum(starts[w] - q + 1, lo), np.minimum(ends[w], hi))
        all_ = int(count(lo, hi))
        left = all_ - int(np.sort(touched)[::-1][:altered].sum()) - breaks * (q - 1)
        worst = left if worst is None else min(worst, left)
        poorest = all_ if poorest is None else min(poorest, all_)
    return poorest or 0, max(worst or 0, 0)


class Index:
    """The q-grams of one length of the cases that use it."""

    def __init__(self, q: int, h: np.ndarray, case: np.ndarray, pos: np.ndarray, need: np.ndarray, size: np.ndarray) -> None:
        self.q, self.need, self.size = q, need, size
        order = np.argsort(h, kind="stable")
        self.hash, self.case, self.pos = h[order], case[order], pos[order]
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.hash & np.uint64((1 << 22) - 1)] = True

    def candidates(self, f: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        """Document, case, first diagonal and q-grams of the bands that reach the bound."""
        h, at = qgrams(f, of, self.q)
        hit = self.bits[h & np.uint64((1 << 22) - 1)]
        h, at = h[hit], at[hit]
        lo = np.searchsorted(self.hash, h, "left")
        real = self.hash[np.minimum(lo, len(self.hash) - 1)] == h
        h, at, lo = h[real], at[real], lo[real]
        n = np.searchsorted(self.hash, h, "right") - lo
        if not n.sum():
            return []
        which = np.repeat(np.arange(len(h)), n)
        at_case = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        doc = of[at[which]]
        case, pos = self.case[at_case], self.pos[at_case]
        longest = int(self.size.max())
        diagonal = at[which] - np.searchsorted(of, doc) - pos + longest
        cases, places = len(self.size), longest + 1
        bands = int(diagonal.max() + BAND // 2) // BAND + 1
        pair = doc.astype(np.int64) * cases + case
        # a few pairs with enough q-grams at all are looked at by band; a q-gram of a case counts once in a band
        order = np.argsort(pair, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1]]))
        enough = np.diff(np.append(begin, len(order))) >= self.need[pair[order][begin] % cases]
        order = order[np.repeat(enough, np.diff(np.append(begin, len(order))))]
        pair, diagonal, pos = pair[order], diagonal[order], pos[order]
        out = []
        for shift in (0, BAND // 2):
            group = pair * bands + (diagonal + shift) // BAND
            if not len(group):
                continue
            both = np.unique(np.stack([group, pos]), axis=1) if int(group.max()) * places >= 2**62 else None
            group = both[0] if both is not None else np.unique(group * places + pos) // places
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            count = np.diff(np.append(begin, len(group)))
            group = group[begin]
            good = count >= self.need[group // bands % cases]
            group = group[good]
            out.append(np.stack([group // bands // cases, group // bands % cases, group % bands * BAND - shift - longest, count[good]]))
        return out


class Cases:
    """The held-out texts, ready for the search; sent to every task."""

    #: Q-grams that more cases share are left out, unless half a case would keep fewer than ``LEAST``.
    SHARED, LEAST = 3, 24

    def __init__(self, ids: list[int], strings: list[str]) -> None:
        self.ids = ids
        clean = [plain(t) for t in strings]
        self.words = [words(t) for t in clean]
        f, _, of = letters(clean)
        self.size = np.bincount(of, minlength=len(ids)) if len(of) else np.zeros(len(ids), int)
        self.letters = ["".join(map(chr, f[of == i])) for i in range(len(ids))]
        self.begins = [np.cumsum([0, *map(len, w[:-1])]) for w in self.words]
        first = np.searchsorted(of, np.arange(len(ids)))
        need = np.zeros(len(ids))
        todo = [i for i in range(len(ids)) if self.words[i]]
        self.indexes: list[Index] = []
        for q in LENGTHS:
            h, at = qgrams(f, of, q)
            case = of[at] if len(at) else at
            pairs = np.unique(np.stack([h, case.astype(np.uint64)]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
            values, shared = np.unique(pairs[0], return_counts=True)
            keep = np.zeros(len(h), dtype=bool)
            rest = []
            for i in todo:
                sizes = np.array([len(w) for w in self.words[i]])
                mine = np.flatnonzero(case == i)
                if not len(mine) or q == LENGTHS[0] and sizes.mean() < 2:
                    rest.append(i)
                    continue
                df = shared[np.searchsorted(values, h[mine])]
                for limit in (self.SHARED, 3 * self.SHARED, len(ids)):
                    kept = df <= limit
                    poorest, worst = lemma_bound(sizes, kept, q)
                    if poorest >= self.LEAST:
                        break
                if poorest >= 3:
                    need[i] = max(worst, FLOOR * poorest, 2)
                    keep[mine] = kept
                else:
                    rest.append(i)
            if keep.any():
                self.indexes.append(Index(q, h[keep], case[keep], at[keep] - first[case[keep]], need.copy(), self.size))
            todo = rest
        #: Cases too short for a bound.
        self.unbounded = todo

    def candidates(self, f: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, case, first diagonal and q-grams of the bands that reach the bound of their case, the fullest
        of a document first."""
        found = [x for index in self.indexes for x in index.candidates(f, of)]
        if not found:
            return (np.zeros(0, np.int64),) * 4
        all_ = np.concatenate(found, axis=1)
        return tuple(all_[:, np.lexsort((-all_[3], all_[0]))])


def line_edges(text: str) -> tuple[list[bool], list[bool]]:
    """For each word of :func:`words`, whether it is one of the first, and of the last, two of its line."""
    first: list[bool] = []
    last: list[bool] = []
    for line in text.split("\n"):
        n = len(_WORD.findall(line.lower()))
        first += [i < 2 for i in range(n)]
        last += [i >= n - 2 for i in range(n)]
    return first, last


#: The edit budget of a run in half words, for each of its words and at all: one word in five, as one in six may
#: be altered and a few more misread. An altered or missing word costs 2, a misread word, one put in or the lines
#: of a page break 1.
BUDGET, ONCE = 0.4, 1
#: A run may be so much over its budget for a while.
DEBT = 3


def longest_run(doc: list[str], case: list[str], edges: tuple[list[bool], list[bool]] | None = None, page: int = 14, band: tuple[list[int], list[int]] | None = None) -> int:
    """Words of the case that the document holds in order and in one run, within the edit budget.

    An alignment by dynamic programming over the places where words are equal or alike, for each case word those
    from ``band[0]`` to ``band[1]`` of the document (all without a band): for each such place and cost, the
    longest run that ends there. A page break puts in up to ``page`` words, which fill whole lines (``edges``);
    over ``GAP`` words in a row that are not found end a run. Of a place right after another only that one is
    looked at, as any run through it costs no more.
    """
    begins, ends = edges or ([False] * len(doc), [False] * len(doc))
    place: dict[str, list[int]] = {}
    for j, w in enumerate(doc):
        place.setdefault(w, []).append(j)
    most = BUDGET * len(case) + ONCE
    top = 0
    # for each case word the places in order, and for each place: cost -> first case word of the run
    rows: deque[tuple[list[int], list[dict[int, int]]]] = deque(maxlen=GAP + 1)
    for i, w in enumerate(case):
        found = place.get(w)
        own = 0
        if found is None:
            found = []
            if len(w) >= 3:
                near = {j for back in range(1, min(len(rows), 4) + 1) for dj, state in zip(*rows[-back]) if state and min(state.values()) < i - back for j in range(dj + 1, min(dj + back + 2, len(doc)))}
                found = [j for j in sorted(near) if abs(len(doc[j]) - len(w)) <= 2 and alike(w, doc[j])]
                own = 1
        elif band:
            found = found[bisect_left(found, band[0][i]) : bisect_left(found, band[1][i])]
        here: list[dict[int, int]] = []
        for j in found:
            best = {own: i}
            last = rows[-1][0] if rows else []
            at = bisect_left(last, j - 1)
            if at < len(last) and last[at] == j - 1:
                for e, f in rows[-1][1][at].items():
                    if f < best.get(e + own, i + 1):
                        best[e + own] = f
            else:
                for back in range(1, len(rows) + 1):
                    js, states = rows[-back]
                    gap_case = back - 1
                    for k in range(bisect_left(js, j - 1 - page - GAP), bisect_left(js, j)):
                        dj = js[k]
                        gap_doc = j - dj - 1
                        extra = max(0, gap_doc - gap_case)
                        cost = 2 * gap_case + (1 if extra > 1 and gap_doc <= page and ends[dj] and begins[j] else extra) + own
                        for e, f in states[k].items():
                            if e + cost <= most and f < best.get(e + cost, i + 1):
                                best[e + cost] = f
            keep = {}
            first = i + 1
            for e in sorted(best):
                if best[e] < first and e <= BUDGET * (i - best[e] + 1) + ONCE + DEBT:  # costs more, but is longer
                    keep[e] = first = best[e]
                    if e <= BUDGET * (i - first + 1) + ONCE:
                        top = max(top, i - first + 1)
            here.append(keep)
        rows.append((found, here))
    return top


def _enough(doc: list[str], case: list[str]) -> bool:
    """Whether some half of the case has as many words, and neighbouring pairs of words, somewhere in the document
    as a run of half the case has at least: of five words one may be altered, which breaks two pairs, and a page
    break one."""
    half = (len(case) + 1) // 2
    altered = -(-half // (ALTERED - 1))
    for have, seen, size, least in (set(doc), case, half, half - altered), (set(zip(doc, doc[1:])), list(zip(case, case[1:])), half - 1, half - 2 - 2 * altered):
        if least <= 0:
            continue
        hit = [w in have for w in seen]
        n = best = sum(hit[:size])
        for i in range(size, len(seen)):
            n += hit[i] - hit[i - size]
            if n > best:
                best = n
        if best < least:
            return False
    return True


def _search(cases: Cases, strings: list[str], exact: bool = False) -> list[tuple[int, int, int]]:
    """(document, case, words of the case held) for the pairs that pass the filter, or for all pairs that share
    words enough."""
    clean = [plain(t) for t in strings]
    f, _, of = letters(clean)
    split: dict[int, tuple] = {}
    held: dict[tuple[int, int], int] = {}

    def parts(d: int) -> tuple:
        if d not in split:
            lo, hi = np.searchsorted(of, d), np.searchsorted(of, d, "right")
            w = words(clean[d])
            split[d] = w, line_edges(clean[d]), np.cumsum([len(x) for x in w]), "".join(map(chr, f[lo:hi]))
        return split[d]

    for d, c, diagonal, _ in zip(*(x.tolist() for x in cases.candidates(f, of))):
        total = len(cases.words[c])
        if 2 * held.get((d, c), 0) >= total:  # a fuller band has shown it
            continue
        w, edges, ends, letters_ = parts(d)
        if cases.letters[c] in letters_:  # a whole, unaltered copy
            held[d, c] = total
            continue
        # the words that the case would cover along the band
        i = int(np.searchsorted(ends, diagonal))
        j = int(np.searchsorted(ends, diagonal + BAND + int(cases.size[c]))) + 1
        if not _enough(w[i:j], cases.words[c]):
            continue
        at = diagonal + cases.begins[c]
        lo, hi = np.searchsorted(ends, at - BAND // 2) - i, np.searchsorted(ends, at + BAND + BAND // 2) + 1 - i
        part = longest_run(w[i:j], cases.words[c], (edges[0][i:j], edges[1][i:j]), band=(lo.tolist(), hi.tolist()))
        held[d, c] = max(held.get((d, c), 0), part)
    for c in [i for i, x in enumerate(cases.words) if x] if exact else cases.unbounded:
        for d in range(len(strings)):
            if strings[d]:
                w, edges, _, _ = parts(d)
                if _enough(w, cases.words[c]):
                    held[d, c] = max(held.get((d, c), 0), longest_run(w, cases.words[c], edges))
    return [(d, c, n) for (d, c), n in held.items()]


def leaks(docs: DataFrame, cases: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """``(doc_id, case_id, held, share)``: documents that hold at least ``share`` of the words of a case.

    ``cases (case_id, text)`` is a set of fixed, small size; cases without words, null and empty texts are
    held by no document; a repeated document counts once. ``exact`` aligns every document with every case of
    which it has words enough, without the filter.
    """
    rows = cases.filter("text is not null").select("case_id", "text").distinct().collect()  # the stated query set
    known = Cases([r.case_id for r in rows], [r.text for r in rows])

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        if not known.indexes and not known.unbounded:
            return None
        at, ids, held, part = [], [], [], []
        for d, c, n in _search(known, texts(b, "text"), exact):
            if n and n >= share * len(known.words[c]):
                at.append(d), ids.append(known.ids[c]), held.append(n), part.append(n / len(known.words[c]))
        return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int32())), pa.array(ids, pa.int64()), pa.array(held, pa.int32()), pa.array(part, pa.float64())], ["doc_id", "case_id", "held", "share"])

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_batches(d, run, "doc_id bigint, case_id bigint, held int, share double", chars=3_000_000).groupBy("doc_id", "case_id").agg(F.max("held").alias("held"), F.max("share").alias("share"))


def leaked_cases(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """``(case_id, documents, most)``: how many documents hold each case, and the largest share held."""
    by = leaks(docs, cases).groupBy("case_id").agg(F.count("*").alias("documents"), F.max("share").alias("most"))
    return cases.select("case_id").distinct().join(by, "case_id", "left").select("case_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most", F.lit(0.0)).alias("most"))
