"""Problem 5: one stored form for texts that look the same.

A token (a run of letters, marks and digits) has a resolved script set: the intersection, over its
letters, of the scripts in which a letter of that look exists. A token whose set is empty as written
but not when look-alikes count is a mixed-script confusable; one whose letters all have look-alikes in
the script of the text around it is a whole-script confusable. Either is spelled in the one script
that all its letters share, the script of the surrounding text first. Before that, width forms,
composition, invisible characters and kinds of space are brought to one form. Compatibility
characters that look different (raised digits, circled numbers) are kept.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.common import map_batches, texts
from foliant.sources.tables import checkpointed

# Letters of the same look. Each line: Latin, Cyrillic, Greek, Armenian, Cherokee ("." = no such letter).
LETTERS = """
A А Α . Ꭺ
B В Β . Ᏼ
C С Ϲ . Ꮯ
D . . . Ꭰ
E Е Ε . Ꭼ
G Ԍ . . Ꮐ
H Н Η . Ꮋ
I І Ι . .
J Ј Ϳ . Ꭻ
K К Κ . Ꮶ
L . . Լ Ꮮ
M М Μ . Ꮇ
N . Ν . .
O О Ο Օ .
P Р Ρ . Ꮲ
Q Ԛ . . .
R . . . Ꭱ
S Ѕ . Տ Ꮪ
T Т Τ . Ꭲ
U . . Ս .
V Ѵ . . Ꮩ
W Ԝ . . Ꮃ
X Х Χ . .
Y У Υ . Ꭹ
Z . Ζ . Ꮓ
a а α . .
c с ϲ . .
d ԁ . . .
e е . . .
g . . ց .
h һ . հ .
i і ι . .
j ј ϳ յ .
n . . ո .
o о ο օ .
p р ρ . .
q ԛ . զ .
s ѕ . . .
u . υ ս .
v ѵ ν . .
w ԝ . . .
x х . . .
y у . . .
Ä Ӓ . . .
Ë Ё . . .
Ï Ї Ϊ . .
Ö Ӧ . . .
ä ӓ . . .
ë ё . . .
ï ї ϊ . .
ö ӧ . . .
"""
# Katakana and the ideograph of the same look.
KANA = "カ力 ニ二 ロ口 ハ八 エ工 タ夕 ト卜 チ千 ミ三 オ才 セ七 ー一"

_LATIN, _CYRILLIC, _GREEK, _ARMENIAN, _CHEROKEE = (1 << i for i in range(5))
_ALL = 31
_SCRIPT: dict[str, int] = {}
_AS: list[dict[str, str]] = [{} for _ in range(5)]
for _line in LETTERS.split("\n"):
    _row = [x if x != "." else None for x in _line.split()]
    for _i, _ch in enumerate(_row):
        if _ch:
            _SCRIPT[_ch] = sum(1 << j for j, y in enumerate(_row) if y)
            for _j, _other in enumerate(_row):
                if _other:
                    _AS[_j][_ch] = _other
_TABLES = [str.maketrans({k: v for k, v in m.items() if k != v}) for m in _AS]
_ODD = re.compile("[Ͱ-ԯԱ-֏Ꭰ-Ᏽ]")
_TOKEN = re.compile(r"[^\W_]+")
_KATAKANA = {x: p[0] for p in KANA.split() for x in p}
_IDEOGRAPH = {x: p[1] for p in KANA.split() for x in p}
_EITHER = re.compile("[" + "".join(_KATAKANA) + "]+")
# What is counted by a numeral before it, and units written in katakana.
_COUNTERS = "つ倍台個人本冊枚年月日回件章巻号部行列頁番度分秒時円点名種段軒"
_UNITS = re.compile("メートル|キロ|グラム|リットル|センチ|ミリ|ページ|トン|パーセント|カ月|カ所|カ国|ヶ")
_NUMERALS = "二八千三七一"
_RECKONING = tuple("=<>+*/^_±×·{}$\\")

# Characters that show nothing, and spaces of any width.
_DROP = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0, *range(0x180B, 0x180E), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE0FFF)])
_SPACES = dict.fromkeys([0x9, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " ")
_BREAKS = {0x85: "\n", 0x2028: "\n", 0x2029: "\n", 0xB: "\n", 0xC: "\n"}
_LIGATURES = {0xFB00 + i: s for i, s in enumerate(("ff", "fi", "fl", "ffi", "ffl", "st", "st"))}
_HYPHENS = {0x2010: "-", 0x2011: "-"}
_WIDTH = {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFFA0), *range(0xFFA1, 0xFFEF)] if unicodedata.name(chr(c), "")}
#: Letters and digits of the mathematical alphabets are those of the plain ones.
_MATH = {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0x1D400, 0x1D800) if unicodedata.name(chr(c), "")}
_FORMS = _DROP | _SPACES | _BREAKS | _LIGATURES | _HYPHENS | _WIDTH | _MATH
_NEEDS = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_FORMS) if c < 0x10000) + "\U0001d400-\U0001d7ff\U000e0000-\U000e0fff\r̀-ͯᄀ-ᇿ゙゚]")


def _own_script(o: int) -> int:
    if 0x400 <= o < 0x530:
        return _CYRILLIC
    if 0x370 <= o < 0x400:
        return _GREEK
    if 0x530 <= o < 0x590:
        return _ARMENIAN
    if 0x13A0 <= o < 0x1400 or 0xAB70 <= o < 0xABC0:
        return _CHEROKEE
    return _LATIN if o < 0x250 or 0x1E00 <= o < 0x1F00 else 0


def scripts(token: str) -> tuple[int, int]:
    """The resolved script set of a token, as written and with look-alikes (a bit for each script of ``LETTERS``)."""
    own = alike = _ALL
    for ch in token:
        if ch.isdigit():
            continue
        mine = _own_script(ord(ch))
        own &= mine
        alike &= _SCRIPT.get(ch, 0) | mine
    return own, alike


def _spell(token: str, main: int) -> str:
    """The token in the one script that all its letters share; ``main`` is the script of its surroundings."""
    own, alike = scripts(token)
    if own == main or not alike:
        return token
    for i in range(5):
        if alike & main & (1 << i):
            return token.translate(_TABLES[i])
    if own:
        return token
    for i in range(5):
        if alike & (1 << i):
            return token.translate(_TABLES[i])
    return token


def _respell(m: re.Match, main: int) -> str:
    """A token in the script of its surroundings; numbers, and Greek letters alone beside a sign of reckoning, stay."""
    t = m[0]
    if t.isdigit() or len(t) == 1 and "Ͱ" <= t < "Ѐ" and (m.string[m.end() : m.end() + 1] in _RECKONING or m.string[m.start() - 1 : m.start()] in _RECKONING):
        return t
    return _spell(t, main)


def _kind(ch: str) -> str:
    return "h" if "ぁ" <= ch <= "ゖ" else "k" if "ァ" <= ch <= "ヿ" else "c" if "㐀" <= ch <= "鿿" else ""


def _kana(m: re.Match) -> str:
    """Letters that may be katakana or ideographs, spelled by what stands around them, whichever they were.

    Between or after katakana they are katakana, but numerals before what is counted; before katakana too,
    but numerals before units; elsewhere ideographs. So equal looks give equal spellings.
    """
    t, i, j = m.string, m.start(), m.end()
    first, right = _kind(t[i - 1 : i] or " "), _kind(t[j : j + 1] or " ")
    out: list[str] = []
    for n, ch in enumerate(m[0]):
        left = _kind(out[-1]) if n else first
        number = _IDEOGRAPH[ch] in _NUMERALS
        after = t[j : j + 1] if n == len(m[0]) - 1 else ""
        if _IDEOGRAPH[ch] == "一":
            long = left in ("k", "h") and (out[-1:] != ["ー"]) and after != "つ" and not (left == "h" and right == "c")
            out.append("ー" if long else "一")
        elif ch in "ト卜":
            out.append("ト")
        elif _IDEOGRAPH[ch] == "力" and left == "c" and after and after in "月国所年条箇":
            out.append("カ")
        elif left == "k":
            out.append(_IDEOGRAPH[ch] if number and after and after in _COUNTERS else _KATAKANA[ch])
        elif right == "k":
            out.append(_IDEOGRAPH[ch] if number and _UNITS.match(t, j) or left == "c" else _KATAKANA[ch])
        else:
            out.append(_IDEOGRAPH[ch])
    return "".join(out)


def canonical(text: str) -> str:
    """The one form of a text: texts of one look have one form. Empty stays empty; the function is idempotent."""
    if text.isascii():
        return text if "\t" not in text and "\r" not in text else text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")
    if _NEEDS.search(text):
        text = text.replace("\r\n", "\n").replace("\r", "\n").translate(_FORMS)
    text = unicodedata.normalize("NFC", text.replace("\t", " "))
    if _ODD.search(text):
        clear = [0] * 5
        for ch in text:
            if ch not in _SCRIPT and ch.isalpha() and (mine := _own_script(ord(ch))):
                clear[mine.bit_length() - 1] += 1
        whole = 1 << max(range(5), key=lambda i: (clear[i], -i))
        text = _TOKEN.sub(lambda m: _respell(m, whole), text)
    if "ァ" <= max(text) and _EITHER.search(text):
        text = _EITHER.sub(_kana, text)
    return unicodedata.normalize("NFC", text)


def canonical_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, form, changed)``: the canonical form of every text.

    Null text counts as empty; repeated rows give repeated rows; other columns are ignored. No shuffle.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = texts(b, "text")
        form = [canonical(t) for t in raw]
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(form, pa.string()), pa.array([a != c for a, c in zip(raw, form)])], ["id", "form", "changed"])

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), run, "id bigint, form string, changed boolean")


def form_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, form_key, text_key)``: 128-bit keys of the canonical form and of the stored text."""
    import xxhash

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = texts(b, "text")
        form = [xxhash.xxh3_128_digest(canonical(t).encode("utf-8", "surrogatepass")) for t in raw]
        own = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in raw]
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(form, pa.binary()), pa.array(own, pa.binary())], ["id", "form_key", "text_key"])

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), run, "id bigint, form_key binary, text_key binary")


def stored_forms(keys: DataFrame) -> DataFrame:
    """``(form_key, text_key, form_id, docs)``: the different stored forms of every look that has several.

    ``keys`` is the table of :func:`form_keys`; a form is named by its smallest document. Grouped twice, so that
    the copies of one text are one row before looks are compared.
    """
    forms = keys.groupBy("form_key", "text_key").agg(F.min("id").alias("form_id"), F.count_distinct("id").alias("docs"))
    several = forms.groupBy("form_key").agg(F.count("*").alias("forms")).filter("forms > 1")
    return forms.join(several, "form_key")


def lookalike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, form_id, forms)``: one row for each document that looks like one stored differently.

    A class is named by its smallest document, a stored form by its own; no pairs are made. Null and empty
    texts are one form; a repeated row counts once.
    """
    keys = checkpointed(form_keys(docs, id_col, text_col))
    forms = stored_forms(keys)
    named = forms.groupBy("form_key").agg(F.min("form_id").alias("class_id"))
    return keys.join(forms.join(named, "form_key").select("text_key", "class_id", "form_id", "forms"), "text_key").select(F.col("id").alias("doc_id"), "class_id", "form_id", "forms").distinct()


def lookalike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: int = 16) -> DataFrame:
    """``(doc_a, doc_b)``, ``doc_a < doc_b``: texts of one canonical form but different characters.

    Only keys of 40 bytes are shuffled. The different stored forms of a look are paired first, so a group of
    exact copies makes no pairs within itself; then each form is replaced by its documents, of which a large
    group is spread over ``salt`` parts. Empty texts form one group without differences.
    """
    keys = checkpointed(form_keys(docs, id_col, text_col))  # read three times
    forms = checkpointed(stored_forms(keys).select("form_key", "text_key"))
    pairs = forms.join(forms.select("form_key", F.col("text_key").alias("other_key")), "form_key").filter("text_key < other_key").select("text_key", "other_key")
    spread = keys.select("id", "text_key", F.pmod(F.xxhash64("id"), F.lit(salt)).alias("part"))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))).alias("part")
    one = pairs.select("*", parts).join(spread, ["text_key", "part"]).select(F.col("id").alias("a"), F.col("other_key").alias("text_key"))
    both = one.select("*", parts).join(spread, ["text_key", "part"]).select("a", F.col("id").alias("b"))
    return both.filter("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()
