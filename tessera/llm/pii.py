"""Personal data, also where it is disguised: offset-preserving deobfuscation.

Base detectors read the text as it stands. A second reading passes the text through three transducers, each of which
emits normalised characters together with the source interval that produced them: homoglyphs (full-width forms,
look-alike letters, invisible characters), spelled digits ("four two"), and at/dot disguises ("bob (at) mail dot com").
Identifiers are detected in the normalised text and their spans are mapped back to source characters through the kept
intervals. A span within one that a base detector already gives is not repeated; one that reaches further is added.

Every finder is linear in the text: patterns start only at the beginning of a run, and disguises are found from their
anchors ("@", "at", "dot", a digit word) outward, so that long runs of letters, digits or spaces cost one look each.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import id_text, load

KINDS = ("email", "ip", "card", "phone")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match from within a run of digits would also be one from its beginning, so only that is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_ANY_DIGIT = re.compile("[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Look-alike letters of other scripts, and characters that are not seen.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Т": "T", "Х": "X", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ı": "i", "\u2024": ".", "\u3002": ".",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\ufe6b": "@", "\u00a0": " ", "\u202f": " ", "\u2009": " ",
    "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "", "\u00ad": "",
}
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}

# Last labels that an address written with a bare "at" must have, since "at" is also a plain word.
ENDINGS = frozenset("com org net edu gov mil int info biz io co me us uk de fr es it eu ch at nl".split())
WORDS = frozenset("it me us at".split())  # of these, those that begin a sentence behind a plain dot

_OPEN, _CLOSE = frozenset("[({<"), frozenset("])}>")
_AT = re.compile(r"@|\bat\b", re.I)
_DOT = re.compile(r"\b(?:dot|punkt|punto|point)\b|(?<=[\[({<\s])\.(?=[\])}>\s])", re.I)
_DOMAIN_SET = _LOCAL_SET - frozenset("._%+")
_DIGIT_TOKEN = re.compile(r"\+|\b(?:plus|" + "|".join(DIGIT_WORDS) + r")\b|(?<![^\W_])[0-9]{1,4}(?![^\W_])", re.I)
_DIGIT_WORD = re.compile(r"\b(?:" + "|".join(w for w in DIGIT_WORDS if w not in ("oh", "un")) + r")\b", re.I)
_GAP = re.compile(r"[\s-]+")
_HINT_GLYPH = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "\uff01-\uff5e\u2460-\u249b\u0660-\u0669\u06f0-\u06f9\U0001d400-\U0001d7ff]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in text.split("."))


def is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= sum(c.isdigit() for c in text) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches of EMAIL, tried only where an '@' follows a run that can be a local part."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        if begin < at and (m := EMAIL.match(text, begin)):
            yield m.span()
            done = m.end()
            at = text.find("@", max(done, at + 1))
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain identifiers, by start, then kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if not _ANY_DIGIT.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() > 11 and is_card(m[0])]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if is_phone(m[0])]
    return sorted(out)


class Tape:
    """Normalised text in which every character knows the source interval it came from."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, array("q", range(len(text))), array("q", range(1, len(text) + 1))

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Replace [s, e) of the present text by a string, for ascending disjoint intervals; a deleted one widens nothing."""
        if not pieces:
            return
        text, begin, end, at = [], array("q"), array("q"), 0
        for s, e, new in pieces:
            text.append(self.text[at:s])
            begin += self.begin[at:s]
            end += self.end[at:s]
            text.append(new)
            begin.extend([self.begin[s]] * len(new))
            end.extend([self.end[e - 1]] * len(new))
            at = e
        text.append(self.text[at:])
        self.begin, self.end = begin + self.begin[at:], end + self.end[at:]
        self.text = "".join(text)

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.begin[s], self.end[e - 1]


def glyph_pieces(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _HINT_GLYPH.finditer(text):
        c = m[0]
        new = HOMOGLYPHS[c] if c in HOMOGLYPHS else unicodedata.normalize("NFKC", c)
        if new not in HOMOGLYPHS and len(new) == 1 and new.isdigit() and not new.isascii():
            new = str(unicodedata.digit(new))
        if new != c:
            out.append((m.start(), m.end(), new))
    return out


def digit_pieces(text: str) -> list[tuple[int, int, str]]:
    """Digits in runs of at least nine, one of them spelled; spaces within a run go, a leading 'plus' becomes a sign."""
    out: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []

    def close() -> None:
        if sum(len(new) for _, _, new in run if new != "+") >= 9 and any(text[s:e].lower() in DIGIT_WORDS for s, e, _ in run):
            for k, (s, e, new) in enumerate(run):
                if k and s > run[k - 1][1]:
                    out.append((run[k - 1][1], s, ""))
                out.append((s, e, new))
        run.clear()

    for m in _DIGIT_TOKEN.finditer(text):
        s, e = m.span()
        word = m[0].lower()
        new = "+" if word in ("+", "plus") else DIGIT_WORDS.get(word, m[0])
        if run and (new == "+" or not (run[-1][2] == "+" and s == run[-1][1] or _GAP.fullmatch(text, run[-1][1], s))):
            close()
        run.append((s, e, new))
    close()
    return out


def _around(text: str, s: int, e: int) -> tuple[int, int, bool]:
    """An anchor [s, e) with the brackets around it, if any, and the white space around those; and whether it has brackets."""
    a, b = s, e
    while a and text[a - 1].isspace():
        a -= 1
    while b < len(text) and text[b].isspace():
        b += 1
    if not (a and b < len(text) and text[a - 1] in _OPEN and text[b] in _CLOSE):
        return a, b, False
    a, b = a - 1, b + 1
    while a and text[a - 1].isspace():
        a -= 1
    while b < len(text) and text[b].isspace():
        b += 1
    return a, b, True


def disguise_pieces(text: str) -> list[tuple[int, int, str]]:
    """Marks of disguised addresses, from their anchors outward.

    Prose such as "look at it" is left alone: a dot, plain or spelled, must follow, and behind a bare "at" a known ending.
    """
    starts: dict[int, int] = {}
    ends: dict[int, int] = {}
    for m in _DOT.finditer(text):
        a, b, framed = _around(text, *m.span())
        if framed or m[0] != "." and a < m.start() and m.end() < b:
            starts[a], ends[b] = b, a
    out: list[tuple[int, int, str]] = []
    done = 0
    for m in _AT.finditer(text):
        a, b, framed = _around(text, *m.span())
        plain = m[0] == "@"
        if not framed and not plain and (a == m.start() or b == m.end()):
            continue
        dots = []
        begin = a
        while begin > done and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        if begin == a:
            continue
        while begin in ends and ends[begin] > done:
            more = ends[begin]
            k = more
            while k > done and text[k - 1] in _LOCAL_SET:
                k -= 1
            if k == more:
                break
            dots.append((more, begin, "."))
            begin = k
        k, labels, last, spelled = b, 0, b, False
        while True:
            last = k
            while k < len(text) and text[k] in _DOMAIN_SET:
                k += 1
            if k == last:
                break
            labels += 1
            end, label, known = k, text[last:k].lower(), ENDINGS if spelled else ENDINGS - WORDS
            spelled = k in starts
            if spelled:
                dots.append((k, starts[k], "."))
                k = starts[k]
            elif k + 1 < len(text) and text[k] == "." and text[k + 1] in _DOMAIN_SET:
                k += 1
            else:
                break
        if labels < 2 or not (plain or framed or label in known):
            continue
        out += [d for d in dots if d[1] <= end]
        if (a, b) != m.span() or not plain:
            out.append((a, b, "@"))
        done = end
    if starts:
        chain: list[tuple[int, int]] = []
        for m in re.finditer(r"[0-9]++", text):
            if chain and not (chain[-1][1] + 1 == m.start() and text[chain[-1][1]] == "." or starts.get(chain[-1][1]) == m.start()):
                chain = []
            chain = [*chain, m.span()] if m.end() - m.start() <= 3 else []
            if len(chain) == 4:
                out += [(e, s, ".") for (_, e), (s, _) in zip(chain[:-1], chain[1:], strict=True) if e in starts]
                chain = []
    kept, done = [], 0
    for piece in sorted(set(out)):
        if piece[0] >= done:
            kept.append(piece)
            done = piece[1]
    return kept


def hidden_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers that only the normalised text shows, mapped back to the source."""
    tape, now = None, text
    # Each reading runs wherever one of its anchors stands, so that what it finds doesn't depend on other text.
    for hints, pieces in (((_HINT_GLYPH,), glyph_pieces), ((_DIGIT_WORD,), digit_pieces), ((_AT, _DOT), disguise_pieces)):
        if any(h.search(now) for h in hints) and (found := pieces(now)):
            tape = tape or Tape(text)
            tape.rewrite(found)
            now = tape.text
    if tape is None:
        return []
    out = []
    base = [[(s, e) for s, kind, e in known if kind == k] for k in range(4)]
    for s, kind, e in base_spans(tape.text):
        a, b = tape.source(s, e)
        at = bisect_right(base[kind], (a, len(text) + 1)) - 1
        if at < 0 or base[kind][at][1] < b:
            out.append((a, kind, b))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(text: str | None) -> tuple:
    """n_email, n_ip, n_card, n_phone, base_sha256, spans of one text; null counts as empty."""
    base = base_spans(text or "")
    more = hidden_spans(text, base) if text else []
    counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
    said = written(base)
    return *counts, hashlib.sha256(said.encode()).hexdigest(), written(sorted(base + more)) if more else said


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts of plain identifiers, their digest, and all spans as kind:start:end.

    Offsets are code points, ends exclusive. A null text is empty; repeated rows and null ids are kept; an empty table
    gives an empty result; the whole text is read, however long. No shuffle.
    """
    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                row = find(text)
                found.append((*row, (row[-1].count(",") + 1 if row[-1] else 0) - sum(row[:4])))
            cols = list(zip(*found, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(load(spark, sf_dir, "documents"))
