"""Problem 1: text of scanned pages, repaired into continuous paragraphs.

The lines of a text are labelled by a hidden Markov model with the states running header, page number, body
and, for blank lines, break. Emissions: a line's words under a header model (words of elements labelled
Page-header) against a body model (words of all texts), whether it has the form of a page number, and its
layout: blank lines before and after it, whether the line before ends a sentence, its length. Words and
forms are counted over all rows in Spark; transitions and layout are fitted by Viterbi training on all texts
of more than one line, whose measured lines are kept as a table and read in each round. The labels decide what
leaves the text and where paragraphs join.

What a recogniser confuses is learned as well: rare words that differ from a frequent word in one place are
counted by what stands there for what; what happens to many words, and to the right sign more than other
things, is a confusion. A word of the body that is far rarer than a frequent word of which the confusions
make it is misread.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from foliant.llm.common import copies_marked, map_batches, texts
from foliant.llm.lookalike import canonical
from foliant.sources.tables import checkpointed

_EDGE = ".,;:()[]{}“”„«»\"'’‘*_`~<>/|•▪·¿¡?!。、「」『』…—–-‐¬=#&$\\"
_LETTER = re.compile(r"[^\W\d_]")
_KANA = re.compile("[ぁ-ヿ一-鿿]")
_PURE = re.compile("[ぁ-ヿ一-鿿]{3}")
_SPLIT = re.compile("([^\\W\\d_])[-‐¬\xad][ \t]*\n[ \t]*(?=[^\\W\\d_])")
_DIVIDERS = ("-", "‐", "¬", "\xad")

# Words that stand with the number of a page.
_PAGE_WORDS = "page|p\\.|pp\\.|seite|s\\.|página|pág\\.|стр\\.|страница|쪽|ページ|頁"
_N = r"(?:[0-9OolI!]{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})"
PAGE_NUMBER = re.compile(rf"^[\[(—–\-\s|]*(?:(?:{_PAGE_WORDS})\s*)?(?:제\s?)?{_N}(?:\s?(?:쪽|ページ|頁))?(?:\s*(?:/|／|of|von|sur|de|из|총)\s*(?:총\s?|全)?{_N}(?:\s?(?:쪽|ページ|頁))?)?[\])—–\-\s|]*$", re.I)


class Confusions:
    """What is read (wrong) for a sign (right): one sign or two."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.wrong: dict[str, list[str]] = {}
        for right, wrong in pairs:
            self.wrong.setdefault(right, []).append(wrong)
        root: dict[str, str] = {}

        def find(x: str) -> str:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        two = {}
        for right, wrong in pairs:
            if len(wrong) == 1:
                a, b = find(right.lower()), find(wrong.lower())
                root[max(a, b)] = min(a, b)
            else:
                two[right.lower()] = wrong.lower()
        self.classes = {}
        for x in [*root, *two]:
            t = x
            for _ in range(3):
                t = "".join(two.get(ch, ch) for ch in t)
            self.classes[ord(x)] = "".join(find(ch) for ch in t)

    def skeleton(self, word: str) -> str:
        """The word with every sign replaced by the class of signs it may be confused with."""
        return word.lower().translate(self.classes)

    def misreads(self, right: str, wrong: str) -> bool:
        """Whether ``wrong`` is ``right`` with one confusion or more, in their direction."""
        reach = {0: 0}  # offset in wrong -> confusions, at least one if possible, for the prefix of right so far
        for ch in right:
            step: dict[int, int] = {}
            for at, n in reach.items():
                if wrong.startswith(ch, at):
                    step[at + len(ch)] = max(step.get(at + len(ch), 0), n)
                for w in self.wrong.get(ch, ()):
                    if wrong.startswith(w, at):
                        step[at + len(w)] = 1
            reach = step
            if not reach:
                return False
        return reach.get(len(wrong), 0) >= 1


def _plain_sign(ch: str) -> str:
    """A sign without accents and case; such differences are no confusions."""
    return "".join(x for x in unicodedata.normalize("NFD", ch) if not unicodedata.combining(x)).lower()


#: A confusion happens to so many frequent words. It is this share of all that is read for the sign and happens to
#: this share of the words with the sign; or, of single signs, it is the lesser share and so much rarer in its place
#: in words than the right sign, unlike endings that take turns.
#: Of kana and ideographs, whose words are windows of running text, it must be the clear share.
WORDS_LEAST, PAIR_SHARE, WORDS_SHARE, LESSER_SHARE, RARER, CLEAR_SHARE = 3, 0.25, 0.03, 0.05, 0.05, 0.4
#: Readings of a sign that are looked at, the most frequent ones.
READINGS = 20


def confusions(counted: DataFrame, words: dict[str, int], ratio: int) -> list[tuple[str, str]]:
    """``(right, wrong)`` from all words of :func:`counts` that differ in one place from one of the frequent ``words``
    and are at least ``ratio`` times rarer.

    Each frequent word counts once for a pair. What reaches the driver are at most ``READINGS`` pairs for each sign of
    the frequent words.
    """
    index: dict[str, list[tuple[str, int]]] = {}
    for w in words:
        for i in range(len(w)):
            index.setdefault(w[:i] + "\0" + w[i + 1 :], []).append((w, i))

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = set()
        for r, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            if len(r) < 2:
                continue
            for k in (1, 2):
                for i in range(len(r) - k + 1):
                    for w, j in index.get(r[:i] + "\0" + r[i + k :], ()):
                        if words[w] >= ratio * n and len(w) >= (2 if w[0] > "\u2fff" else 3) and w[j].isalpha() and (k == 2 or _plain_sign(w[j]) != _plain_sign(r[i])):
                            found.add((w[j], r[i : i + k], w, j == len(w) - 1))
        return pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*found)], ["sign", "wrong", "word", "last"]) if found else None

    rows = map_batches(counted.filter("kind = 'w'").select("word", "n"), run, "sign string, wrong string, word string, last boolean").distinct()
    pairs = rows.groupBy("sign", "wrong").agg(F.count_distinct("word").alias("n"), F.count_if("last").alias("at_end"))
    of_sign = W.partitionBy("sign")
    ranked = pairs.withColumn("all", F.sum("n").over(of_sign)).withColumn("rank", F.row_number().over(of_sign.orderBy(F.desc("n"), "wrong")))
    kept = ranked.filter((F.col("n") >= WORDS_LEAST) & (F.col("rank") <= READINGS)).collect()
    have: Counter = Counter()
    weight: Counter = Counter()  # how often signs stand inside words and at their ends
    for w, n in words.items():
        have.update(set(w))
        for i, ch in enumerate(w):
            weight[ch, i == len(w) - 1] += n
    out = []
    for r in kept:
        last = 2 * r.at_end > r.n
        often = r.n >= PAIR_SHARE * r.all and r.n >= WORDS_SHARE * have[r.sign]
        if r.sign > "\u2fff" and not "가" <= r.sign <= "힣":
            often = r.n >= CLEAR_SHARE * r.all
        known = all(not ch.isalpha() or ch > "\u10ff" or any(weight[x, y] for x in {ch, ch.lower(), ch.upper()} for y in (True, False)) for ch in r.wrong)
        rare = len(r.wrong) == 1 and (r.sign < "\u2fff" or r.sign >= "가") and r.n >= LESSER_SHARE * r.all and weight[r.wrong, last] <= RARER * weight[r.sign, last]
        if (often or rare) and r.sign not in r.wrong and known:  # letters of other scripts are no misreadings
            out.append((r.sign, r.wrong))
    return sorted(out)


def words_of(token: str) -> list[str]:
    """The words of a token: without signs at its edges; of Japanese runs the groups of three letters."""
    w = token.strip(_EDGE)
    if not w or not _LETTER.search(w):
        return []
    if _KANA.search(w):
        return [w[i : i + 3] for i in range(len(w) - 2) if _PURE.match(w, i)]
    return [w]


def joined(text: str) -> str:
    """The canonical text with words divided at line ends put together."""
    if "\n" in text and _SPLIT.search(text):
        text = _SPLIT.sub(r"\1", text)
    return canonical(text)


def _title_parts(line: str) -> list[str]:
    """The runs of a line in lower case; of letters set apart the words they make."""
    line = line.strip(" .|").lower()
    parts = line.split()
    n = len(parts)
    # of four fifths that are single letters one is among the first fifth and one more
    if n >= 5 and 1 in map(len, parts[: n // 5 + 1]) and sum(len(p) == 1 for p in parts) >= 0.8 * n:
        parts = ["".join(p.split()) for p in re.split(" {2,}", line)]
    return parts


def _title_words(p: str) -> list[str]:
    """A run as the header and the body model see it: numbers and years are one word each."""
    p = p.strip(_EDGE)
    if not p:
        return []
    digits = p.translate(_DIGITS)
    if digits.isdigit() and any(c.isdigit() for c in p):
        return ["#Y" if len(digits) == 4 and digits[0] in "12" else "#D"]
    return ["#U", p[-3:]] if len(p) > 4 and _KANA.search(p) else [p]


def _title_tokens(line: str) -> list[str]:
    return [w for p in _title_parts(line) for w in _title_words(p)]


# Signs that stand for digits in badly read numbers.
_DIGITS = {ord("o"): "0", ord("l"): "1", ord("i"): "1", ord("!"): "1", ord("|"): "1", ord("s"): "5", ord("b"): "6", ord("g"): "9"}


def counts(rows: DataFrame) -> DataFrame:
    """``(kind, word, n)``: words of all texts (w), words of headers (h), lines (b), headers (H), lines of labelled
    body elements (T) and of footers (P), and how many of these have the form of a page number (t, p).

    ``rows (tab, id, idx, label, text)``. Counted in each batch before the shuffle, so that a frequent word is one
    row of a batch. Null texts have no words. The words of copies of a text count once, so that its wrong
    words stay rare; headers and lines all count.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw: Counter = Counter()
        head: Counter = Counter()
        n_lines = n_head = 0
        form: Counter = Counter()
        for label, t, copy in zip(b.column("label").to_pylist(), texts(b, "text"), b.column("copy").to_pylist()):
            if not t:
                continue
            t = joined(t)
            if not copy or label == "Page-header":
                raw.update(t.split())
            if label == "Page-header":
                head.update(_title_tokens(t))
                n_head += 1
            else:
                n_lines += t.count("\n") + 1
                if label in ("Page-footer", "Text", "List-item"):
                    big, small = ("P", "p") if label == "Page-footer" else ("T", "t")
                    for x in t.split("\n"):
                        form[big] += 1
                        form[small] += PAGE_NUMBER.match(x.strip()) is not None
        c: Counter = Counter()
        for token, n in raw.items():
            for w in words_of(token):
                c[w] += n
        kinds = ["w"] * len(c) + ["h"] * len(head) + ["b", "H", *form]
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([*c, *head, "", "", *("" for _ in form)], pa.string()), pa.array([*c.values(), *head.values(), n_lines, n_head, *form.values()], pa.int64())], ["kind", "word", "n"])

    return map_batches(copies_marked(rows).select("label", "text", "copy"), run, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))


BODY, HEADER, NUMBER, BREAK = "B", "H", "N", "K"
_STATES = "BHN"
_ENDS = tuple(".!?。！？:")


def layout_cells(lines: list[str]) -> list[int]:
    """The layout of each line that is not blank, as one of 48 cells: a blank line before and after it, whether the
    line before ends a sentence, and its length."""
    out = []
    last = len(lines) - 1
    ended = True
    for i, x in enumerate(lines):
        x = x.strip()
        if not x:
            continue
        before, after = i > 0 and not lines[i - 1].strip(), i < last and not lines[i + 1].strip()
        out.append((before << 1 | after) * 12 + ended * 6 + min(5, len(x) // 12))
        ended = x.endswith(_ENDS)
    return out


class Model:
    """Lexicon, confusions, header model, layout and transitions: small, sent to every task in the function's closure."""

    RATIO, LEAST, RATE, HEAD_RATE = 40, 8, 2e-6, 1e-3
    #: Rounds of fitting.
    ROUNDS = 2

    def __init__(self, words: dict[str, int], total: int, least: int, head: dict[str, int], head_total: int, sums: dict[str, int], pairs: list[tuple[str, str]]) -> None:
        self.words, self.total, self.least = words, max(total, 1), least
        self.confusions = Confusions(pairs)
        self.weights: dict[str, list[tuple[int, float]]] = {}  # runs seen, emptied when they are many
        skeleton = self.confusions.skeleton
        by: dict[str, list[str]] = {}
        body: Counter = Counter()
        for w, n in words.items():
            k = skeleton(w)
            by.setdefault(k, []).append(w)
            body[k] += n
        self.by = by
        heads: Counter = Counter()
        for w, n in head.items():
            heads[w if w[0] == "#" else skeleton(w)] += n
        known_head, known_body = sum(head.values()), sum(words.values())
        p_new_head = (head_total - known_head + 1) / (head_total + 2)
        p_new_body = (self.total - known_body + 1) / (self.total + 2)
        self.new = math.log(p_new_head / max(p_new_body, 0.02))
        #: log p(word | header) - log p(word | body); numbers take their shares in a typical body line
        self.ratio = {k: math.log((n + 0.5) / (head_total + 1)) - math.log((body.get(k, 0) + 0.5) / (self.total + 1) + 1e-5) for k, n in heads.items() if k[0] != "#"}
        year = (heads.get("#Y", 0) + 0.5) / (head_total + 1)
        number = (heads.get("#D", 0) + 0.5) / (head_total + 1)
        self.ratio |= {"#Y": math.log(year / 0.01), "#D": math.log(number / 0.04)}
        self.in_body = set(body)
        #: log p(form of a page number | footer) - log p(form | line of the body); a page number has no other form
        self.number = math.log((sums.get("p", 0) + 1) / (sums.get("P", 0) + 2)) - math.log((sums.get("t", 0) + 0.5) / (sums.get("T", 0) + 500))
        #: A line that is a whole text: how often such a form is a footer, and how often a line is a header.
        self.alone = math.log((sums.get("p", 0) + 1) / (sums.get("t", 0) + 0.5)) - self.number
        stop = min(0.2, (sums.get("H", 0) + 1) / (sums.get("b", 0) + sums.get("H", 0) + 2))
        go, stop, back = math.log(1 - stop), math.log(stop / 2), math.log(0.5)
        self.head_alone = stop
        #: To begin with, a page break may bring header and number in any order, once each, and no layout speaks for any.
        self.set_moves([[go, stop, stop], [back, -3.0, back - 0.5], [back, back - 0.5, -3.0]], [[0.0] * 48] * 3)

    def set_moves(self, move: list[list[float]], layout: list[list[float]]) -> None:
        self.move, self.layout = move, layout
        #: What a line may gain at most by another state than body, besides its words and form.
        self.most = max(max(0.0, *(move[i][j] - move[0][0] for i in range(3) for j in range(3))) + max(layout[j][c] - layout[0][c] for j in (1, 2) for c in range(48)), 0.0)

    @classmethod
    def of(cls, counted: DataFrame) -> Model:
        """The model of the counts of :func:`counts`, its transitions and layout not fitted yet.

        What reaches the driver is bounded: words with at least ``RATE`` of all words (1 / RATE of them at most),
        header words with at least ``HEAD_RATE`` of all header words, and confusions.
        """
        counted = checkpointed(counted)  # read three times
        sums = {r.kind: r.n for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # eight rows
        total, head_total = sums.get("w", 0), sums.get("h", 0)
        least = max(cls.LEAST, math.ceil(cls.RATE * total))
        head_least = max(3, math.ceil(cls.HEAD_RATE * head_total))
        kept = counted.filter(((F.col("kind") == "w") & (F.col("n") >= least)) | ((F.col("kind") == "h") & (F.col("n") >= head_least))).toPandas()
        w, h = kept[kept.kind == "w"], kept[kept.kind == "h"]
        words = dict(zip(w.word, map(int, w.n)))
        often = {x: n for x, n in words.items() if n >= max(20, 3 * least)}
        return cls(words, total, least, dict(zip(h.word, map(int, h.n))), head_total, sums, confusions(counted, often, cls.RATIO))

    def fit(self, rows: DataFrame) -> None:
        """Fit transitions and layout to the likeliest labels of all texts of :func:`measured`, and again to those they
        give. Labels are counted where the lines lie; a round brings at most ``TALLIES`` sums to the driver."""
        lines = rows.filter("size(cells) > 1").select("heads", "forms", "cells")
        for _ in range(self.ROUNDS):
            moves = Moves(self)

            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                n = tally(zip(*(b.column(c).to_pylist() for c in ("heads", "forms", "cells"))), moves)
                return pa.RecordBatch.from_arrays([pa.array(range(TALLIES), pa.int32()), pa.array(n, pa.int64())], ["what", "n"])

            sums = map_batches(lines, run, "what int, n bigint").groupBy("what").agg(F.sum("n").alias("n")).collect()
            if sums:
                n = dict(sums)
                self.refit([n[i] for i in range(TALLIES)])

    def train(self, texts_: list[list[str]]) -> None:
        """:meth:`fit` on the driver, for documents that are given as lines."""
        kept = [measured_lines(lines, self, True) for lines in texts_]
        for _ in range(self.ROUNDS if texts_ else 0):
            self.refit(tally(kept, Moves(self)))

    def refit(self, n: list[int]) -> None:
        """Set transitions, layout and the weight of a page number's form from the sums of :func:`tally`."""
        moves = [[20 * math.exp(x) + n[3 * i + j] for j, x in enumerate(row)] for i, row in enumerate(self.move)]
        cells = [[1.0 + x for x in n[9 + 48 * j : 57 + 48 * j]] for j in range(3)]
        body, forms = n[-2:]
        alone = self.alone + self.number
        self.number = -math.log((forms + 0.5) / (body + 500))
        self.alone = alone - self.number
        self.set_moves([[math.log(x / sum(row)) for x in row] for row in moves], [[math.log(x / sum(row)) for x in row] for row in cells])

    def right(self, word: str) -> str | None:
        """The word that ``word`` is a misreading of, or None."""
        own = self.words.get(word, 0)
        need = self.RATIO * own if own else max(20, 3 * self.least)
        sign = not word.isalpha()
        best = None
        for v in self.by.get(self.confusions.skeleton(word), ()):
            if v != word and self.words[v] >= need and len(v) >= (2 if sign or v[0] > "\u2fff" else 3) and (best is None or self.words[v] > self.words[best]) and self.confusions.misreads(v, word):
                best = v
        return best

    def _weigh(self, run: str) -> list[tuple[int, float]]:
        """For each word of a run its kind (1: of headers, 0: of headers and ordinary, -1: unknown, -2: of the body) and
        the part it has in the score."""
        out = []
        for k in _title_words(run):
            number = k[0] == "#"
            if not number:
                k = self.confusions.skeleton(k)
            r = self.ratio.get(k)
            if r is not None:
                out.append((int(not number and r > 2), r))
            else:
                out.append((-1, 0.0) if k == "#U" or k not in self.in_body else (-2, -5.0))
        if len(self.weights) > 300_000:
            self.weights.clear()
        self.weights[run] = out
        return out

    def header_score(self, line: str) -> float:
        """log p(line | running header) - log p(line | body), by its words."""
        score, named, hits, at = 0.0, 0, 0, 0
        weights = self.weights
        for run in _title_parts(line):
            for kind, r in weights[run] if run in weights else self._weigh(run):
                at += 1
                if kind == -1:
                    named += 1
                    score += self.new if named == 1 else -4.0
                else:
                    score += r
                    hits += kind == 1
            if score < -60:  # a long line of the body
                return -50.0
        return score if hits else score - 8.0 if at else -50.0


class Moves:
    """What labelling measured lines needs of a model; far smaller than the model, as its words are not in it."""

    def __init__(self, model: Model) -> None:
        self.move, self.layout, self.most, self.number, self.alone, self.head_alone = model.move, model.layout, model.most, model.number, model.alone, model.head_alone


def measured_lines(lines: list[str], model: Model, document: bool) -> tuple[list[float], list[bool], list[int]]:
    """Of each line that is not blank the score as a header, whether it has the form of a page number, and its cell of
    layout; ``document``: a title as first line is a heading. None of these changes as the model is fitted."""
    heads, forms = [], []
    for x in lines:
        if s := x.strip():
            heads.append(model.header_score(s) if heads or not document else -50.0)
            forms.append(PAGE_NUMBER.match(s) is not None)
    return heads, forms, layout_cells(lines)


def label_measured(heads: list[float], forms: list[bool], cells: list[int], model: Model | Moves) -> list[str]:
    """States of measured lines by the Viterbi algorithm."""
    least = -model.most
    if max(heads, default=-50.0) < least and -50.0 < least and (model.number < least or True not in forms):  # no line gains by another state
        return [BODY] * len(heads)
    move, layout, begin = model.move, model.layout, model.move[0]
    if len(heads) == 1:  # a line alone has no layout
        layout, begin = [[0.0] * 48] * 3, [0.0, model.head_alone, model.alone]
    score = begin[:]
    trace: list = []
    began = False
    for head, form, cell in zip(heads, forms, cells):
        e = (0.0, head, model.number if form else -50.0)
        new, came = [], []
        for j in range(3):
            i = max(range(3), key=lambda i: score[i] + move[i][j]) if began else 0
            new.append((score[i] + move[i][j] if began else begin[j]) + layout[j][cell] + e[j])
            came.append(i)
        score, began = new, True
        trace.append(came)
    state = max(range(3), key=score.__getitem__)
    out = []
    for came in reversed(trace):
        out.append(_STATES[state])
        state = came[state]
    return out[::-1]


def with_breaks(lines: list[str], states: list[str]) -> list[str]:
    """States of all lines, from those of the lines that are not blank."""
    if len(lines) == len(states):
        return states
    of = iter(states)
    return [next(of) if x.strip() else BREAK for x in lines]


def label_lines(lines: list[str], model: Model, document: bool) -> list[str]:
    """States of the lines of a text; ``document``: a title as first line is a heading."""
    return with_breaks(lines, label_measured(*measured_lines(lines, model, document), model))


#: Sums of a round of fitting: 3 x 3 transitions, 3 x 48 cells, lines of the body and those with a page number's form.
TALLIES = 9 + 3 * 48 + 2


def tally(texts_: Iterable[tuple[list[float], list[bool], list[int]]], model: Model | Moves) -> list[int]:
    """How often the likeliest labels of measured texts have each transition and cell."""
    out = [0] * TALLIES
    for heads, forms, cells in texts_:
        before = 0
        for x, form, cell in zip(label_measured(heads, forms, cells, model), forms, cells):
            now = _STATES.index(x)
            out[3 * before + now] += 1
            out[9 + 48 * now + cell] += 1
            if now == 0:
                out[-2] += 1
                out[-1] += form
            before = now
    return out


def measured(rows: DataFrame, model: Model) -> DataFrame:
    """The rows that are judged, with their canonical text (null: the text itself) and :func:`measured_lines`."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        plain, heads, forms, cells = [], [], [], []
        for tab, t in zip(b.column("tab").to_pylist(), texts(b, "text")):
            c = canonical(t)
            plain.append(None if c == t else c)
            for out, x in zip((heads, forms, cells), measured_lines(c.split("\n"), model, tab == "documents")):
                out.append(x)
        columns = [pa.array(plain, pa.string()), pa.array(heads, pa.list_(pa.float64())), pa.array(forms, pa.list_(pa.bool_())), pa.array(cells, pa.list_(pa.int8()))]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tab", "id", "idx", "text")), *columns], ["tab", "id", "idx", "text", "plain", "heads", "forms", "cells"])

    d = _judge(rows).select("tab", F.col("id").cast("bigint").alias("id"), F.col("idx").cast("int").alias("idx"), "text")
    return map_batches(d, run, "tab string, id bigint, idx int, text string, plain string, heads array<double>, forms array<boolean>, cells array<tinyint>")


def fitted(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all rows, and those that are judged as :func:`measured` gives them."""
    model = Model.of(counts(rows))
    lines = checkpointed(measured(rows, model))  # read in each round and to judge
    model.fit(lines)
    return model, lines


def _labelled(b: pa.RecordBatch, model: Model) -> Iterator[tuple[str, list[str], list[str]]]:
    """Text, lines and their states of each row of :func:`measured`."""
    for raw, plain, *lines in zip(*(b.column(c).to_pylist() for c in ("text", "plain", "heads", "forms", "cells"))):
        own = (raw if plain is None else plain).split("\n")
        yield raw, own, with_breaks(own, label_measured(*lines, model))


class Reader:
    """Finds the noise of a text and repairs it; one for each task, with a memory of the words seen."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.right = lru_cache(1 << 18)(self._right)

    def _right(self, token: str) -> str | None:
        for w in words_of(token):
            if (v := self.model.right(w)) is not None:
                return token.replace(w, v, 1)
        return None

    def kinds(self, raw: str, lines: list[str], states: list[str]) -> set[str]:
        """Kinds of noise in a text, of which the canonical lines and their states are given."""
        out: set[str] = set()
        raw_lines = raw.replace("\r\n", "\n").split("\n")
        if HEADER in states:
            out.add("running")
        if NUMBER in states:
            out.add("pageno")
        if len(lines) > 1 and len(raw_lines) == len(lines):
            for i, s in enumerate(states):
                if s == BODY and self.divided(raw_lines, states, i) is not None:
                    out.add("hyphen")
                    break
        body = self.body(raw_lines, lines, states)
        for token in set(body.split()):
            if self.right(token) is not None:
                out.add("misread")
                break
        return out

    @staticmethod
    def divided(lines: list[str], states: list[str], i: int) -> int | None:
        """The index of the line with the second half of the word that line ``i`` divides at its end."""
        x = lines[i].rstrip(" \t​‌‍⁠﻿\xa0")
        if x[-1:] not in _DIVIDERS or not _LETTER.match(x[-2:-1]):
            return None
        blank = page = False
        for j in range(i + 1, len(lines)):
            if states[j] == BODY:
                s = lines[j].lstrip(" \t​‌‍⁠﻿\xa0")
                ok = s and _LETTER.match(s[0]) and (s[0].islower() or not s[0].isupper() and not s[0].istitle())
                return j if ok and (page or not blank) else None
            blank |= states[j] == BREAK
            page |= states[j] in (HEADER, NUMBER)
        return None

    def body(self, raw_lines: list[str], lines: list[str], states: list[str]) -> str:
        """The body lines, words divided at line ends put together, a blank line between paragraphs."""
        out: list[str] = []
        same = len(raw_lines) == len(lines)
        glue = False
        gap = False
        for i, s in enumerate(states):
            if s == BREAK:
                gap = True
            elif s in (HEADER, NUMBER):
                gap = False  # the page broke inside a paragraph unless the line before ends a sentence
                if out and out[-1].rstrip()[-1:] in ".!?。":
                    gap = True
            elif s == BODY:
                x = lines[i].strip()
                divided = same and self.divided(raw_lines, states, i) is not None
                if divided:
                    x = x.rstrip("-‐¬\xad ")
                if glue and out:
                    out[-1] += x
                elif gap and out:
                    out += ["", x]
                else:
                    out.append(x)
                glue, gap = divided, False
        return "\n".join(out)

    def repaired(self, raw: str, lines: list[str], states: list[str]) -> str:
        """Continuous paragraphs: lines joined, headers and page numbers out, misread words put right."""
        raw_lines = raw.replace("\r\n", "\n").split("\n")
        body = self.body(raw_lines, lines, states)
        fixed = re.sub(r"\S+", lambda m: self.right(m[0]) or m[0], body)
        return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\n+", fixed) if p.strip())


def _judge(rows: DataFrame) -> DataFrame:
    return rows.filter("tab = 'documents' or (label is null or label not in ('Page-header', 'Page-footer', 'Title'))").filter("length(text) > 0")


def scan_noise(rows: DataFrame) -> DataFrame:
    """``(tab, id, idx, kind)``: kinds of noise of each text of ``rows (tab, id, idx, label, text)``.

    Elements labelled Page-header train the header model; they, Page-footer and Title are not judged. Null
    and empty texts have no noise; a repeated row counts once.
    """
    model, lines = fitted(rows)

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        reader = Reader(model)
        at, kinds = [], []
        for i, x in enumerate(_labelled(b, model)):
            for k in reader.kinds(*x):
                at.append(i)
                kinds.append(k)
        pick = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([b.column(c).take(pick) for c in ("tab", "id", "idx")] + [pa.array(kinds, pa.string())], ["tab", "id", "idx", "kind"])

    return map_batches(lines, run, "tab string, id bigint, idx int, kind string").distinct()


def paragraphs(rows: DataFrame) -> DataFrame:
    """``(tab, id, idx, text)``: the repaired text of the rows that are judged."""
    model, lines = fitted(rows)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        reader = Reader(model)
        out = [reader.repaired(*x) for x in _labelled(b, model)]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tab", "id", "idx")), pa.array(out, pa.string())], ["tab", "id", "idx", "text"])

    return map_batches(lines, run, "tab string, id bigint, idx int, text string")
