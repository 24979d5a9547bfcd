"""Secret scan: fixed patterns, and a battery of randomness tests for everything else.

Base spans come from three patterns (assignments, access keys, hex runs).  Other
candidates are long runs of token characters, split at '=' and '.', and their parts between
'/', '-' and '_'; a part counts where the whole is not random itself.  For each, the encoding is inferred from
its characters (hex, base 32, base 36, base 62, base 64), and three tests ask whether it
could be drawn at random from that alphabet: a chi-squared test of uniformity over the
alphabet (in classes, so that short strings have enough in each), a runs test about the
middle of the alphabet, and a lag-one serial correlation.  A random secret passes all.

The three p-values join by Bonferroni.  Candidates of similar length and equal encoding
form one family, and Benjamini-Hochberg is applied within it: rejected candidates are
structured text.  Families make the control aware of length: short strings carry little
evidence and are not judged by the same cut as long ones.

Passing the battery is not enough, as short identifiers pass it for lack of evidence.  So
each candidate is also held against an explicit model of structured tokens: runs of words,
capitalised words and digits, with letter pairs fitted on all texts.  The likelihood of
the uniform draw over that of the model is an e-value against "structured" (zero where the
battery rejects), and the e-value form of Benjamini-Hochberg over all candidates bounds the
share of structured tokens among those *reported* by ``FALSE_DISCOVERIES``, whatever their
dependence, as far as the model holds.  Both cuts come from counts over all documents on a
fixed grid, rounded to the careful side, so no list of candidates is gathered anywhere.

Defined results: null is the empty text; empty texts have no spans; texts are scanned
whole; repeated documents get equal spans; overlapping spans of different kinds all stay,
but a candidate that overlaps a base span is left out, as it is reported already.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.frames import as_bytes, column, flat, map_rows, slices, small_batches

KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH = 20
FALSE_DISCOVERIES = 0.01
# Share of truly random tokens the battery may take for structured.
BATTERY_ERRORS = 0.01
# p-values and e-values on grids of powers of two; a family is an encoding and a length class.
GRID = 40
E_GRID = 100
# A run of one kind goes on with this probability.
GOES_ON = 0.85
_ASSIGN = re.compile(
    rb"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    rb"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
_PIECE, _PART = re.compile(rb"[A-Za-z0-9+/_-]+"), re.compile(rb"[A-Za-z0-9+]+")
_TOKEN_RUN = re.compile(rb"[A-Za-z0-9+/_=.-]{%d,}" % MIN_LENGTH)


def _only(keep: bytes) -> bytes:
    return bytes(b if b in keep else 0x20 for b in range(256))


_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_HEX_ONLY, _TOKEN_ONLY = _only(b"0123456789abcdef"), _only(_TOKEN)

_UPPER, _LOW, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Encodings from the narrowest alphabet to the widest; each must show letters and digits.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": _DIGIT + _LOW,
    "BASE36": _DIGIT + _UPPER,
    "base62": _DIGIT + _UPPER + _LOW,
    "base64": _UPPER + _LOW + _DIGIT + "+/",
    "base64url": _UPPER + _LOW + _DIGIT + "-_",
}


def infer(token: str) -> str | None:
    """The narrowest encoding that holds all characters; None without letters and digits."""
    body = token.rstrip("=")
    used = set(body)
    if not (used & set(_DIGIT)) or not any(c.isalpha() for c in used):
        return None
    wide = used & set(_UPPER) and used & set(_LOW)
    for name, alphabet in ENCODINGS.items():
        if used <= set(alphabet):
            if name.startswith("base6") and not wide:
                return None
            return name
    return None


def _upper_tail_chi2(x: float, k: int) -> float:
    """P(chi-squared with ``k`` degrees exceeds ``x``), by the Wilson-Hilferty normal form."""
    if x <= 0:
        return 1.0
    spread = 2.0 / (9.0 * k)
    return 0.5 * math.erfc(((x / k) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, encoding: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for a random token."""
    alphabet = ENCODINGS[encoding]
    size = len(alphabet)
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in token.rstrip("=")], np.float64)
    n = len(x)
    # Classes of equal width, about five expected characters in each.
    classes = max(2, min(size, n // 5))
    counts = np.bincount((x * classes // size).astype(int), minlength=classes)
    width = np.bincount((np.arange(size) * classes // size), minlength=classes)
    expected = n * width / size
    uniform = _upper_tail_chi2(float(((counts - expected) ** 2 / expected).sum()), classes - 1)
    high = x >= size / 2
    ones = int(high.sum())
    if ones in (0, n):
        runs = 2.0 ** (1 - n)
    else:
        seen = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * ones * (n - ones) / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _two_sided((seen - mean) / math.sqrt(var)) if var > 0 else 1.0
    centred = x - x.mean()
    power = float((centred**2).sum())
    if power == 0:
        serial = 0.0
    else:
        r = float((centred[1:] * centred[:-1]).sum()) / power
        serial = _two_sided((r + 1 / n) * math.sqrt(n))
    return uniform, runs, serial


def combined(token: str, encoding: str) -> float:
    return min(1.0, 3 * min(battery(token, encoding)))


class Words:
    """Structured tokens: runs of words, capitalised words, digits and signs.

    ``counts[a, b]``: letter ``b`` after letter ``a`` (26: at the start of a run of
    letters), case folded; one is added to each.
    """

    def __init__(self, counts: np.ndarray):
        smooth = counts.astype(np.float64) + 1
        self.pair = np.log2(smooth / smooth.sum(axis=1, keepdims=True)).tolist()

    def bits(self, token: str) -> float:
        """log2 of the token's probability, given its length."""
        on, new = math.log2(GOES_ON), math.log2((1 - GOES_ON) / 4)
        total, before, letter = 0.0, "", 26
        for c in token:
            if "a" <= c <= "z" or "A" <= c <= "Z":
                kind, at = ("l" if c >= "a" else "u"), ord(c) & 31
                # After a capital either case goes on.
                goes_on = before == "u" or (before == "l" and kind == "l")
                total += (on - (before == "u")) if goes_on else new
                total += self.pair[letter if goes_on else 26][at - 1]
                letter = at - 1
            else:
                kind = "d" if c.isdigit() else "o"
                total += on if before == kind else new
                total -= math.log2(10) if kind == "d" else 3
            before = kind
        return total


def pair_counts(array) -> np.ndarray:
    """Letter pairs of a batch of texts, case folded; row 26: letters after anything else."""
    total = np.zeros((27, 26), np.int64)
    for part in slices(array):
        raw, at = flat(part)
        if not len(raw):
            continue
        letter = (raw | 0x20) - np.uint8(0x61)
        code = np.where((letter < 26) & (raw < 0x80), letter, 26).astype(np.int64)
        before = np.concatenate(([26], code[:-1]))
        starts = at[:-1]
        before[starts[starts < len(raw)]] = 26
        hit = code < 26
        total += np.bincount(before[hit] * 26 + code[hit], minlength=27 * 26).reshape(27, 26)
    return total


def fit_words(docs: DataFrame, text: str = "text") -> Words:
    """Letter pairs of all texts: tasks count, Spark adds up 27 x 26 numbers."""
    small_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros((27, 26), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += pair_counts(batch.column(0))
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["at", "n"])

    found = docs.select(column(text).alias("t")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(27 * 26, np.int64)
    for row in found.collect():
        counts[row["at"]] = row["n"]
    return Words(counts.reshape(27, 26))


def e_grade(token: str, encoding: str, words: Words) -> int:
    """floor(log2(e)) within the grid: how much likelier a uniform draw gives the token."""
    body = token.rstrip("=")
    e = -len(body) * math.log2(len(ENCODINGS[encoding])) - words.bits(body)
    return int(max(0, min(E_GRID, math.floor(e))))


def length_class(n: int) -> int:
    """20-23, 24-31, 32-47, 48-63, ...: two classes to a doubling."""
    return int(2 * math.log2(max(n, 1)))


def _points(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges as code point ranges."""
    if not ranges or text.isascii():
        return ranges
    heads = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(heads[a]), int(heads[b])) for a, b in ranges]


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """Byte spans of the three patterns: kind, start, end."""
    out = []
    low = text.translate(_LOWER)
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if any(len(w) >= 16 for w in text.translate(_HEX_ONLY).split()):
        out += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return out


def candidates(
    text: bytes, base: list[tuple[str, int, int]], words: Words
) -> list[tuple[int, int, str, int, int, str | None, int | None, int | None]]:
    """Byte spans of parts of other token runs: encoding, grade of the battery, and of the e-value.

    Runs are split at '=' and '.', which no encoding holds.  What is left is tested whole
    and, where it has them, between its '/', '-' and '_'; such a part also names family
    and grades of the whole, if that was tested.
    """
    if not any(len(w) >= MIN_LENGTH for w in text.translate(_TOKEN_ONLY).split()):
        return []
    out = []

    def tested(a: int, b: int) -> str | None:
        """Encoding of a part that is long enough and not reported already."""
        if b - a < MIN_LENGTH or any(x < b and a < y for _, x, y in base):
            return None
        return infer(text[a:b].decode())

    def judged(a: int, b: int, encoding: str) -> tuple[int, int]:
        token = text[a:b].decode()
        return grade_of(combined(token, encoding)), e_grade(token, encoding, words)

    for m in _TOKEN_RUN.finditer(text):
        for piece in _PIECE.finditer(text, *m.span()):
            a, b = piece.span()
            a, b = b - len(piece[0].lstrip(b"-_")), a + len(piece[0].rstrip(b"-_"))
            encoding, whole = tested(a, b), (None, None, None)
            if encoding:
                grades = judged(a, b, encoding)
                out.append((a, b, encoding, *grades, None, None, None))
                whole = (f"{encoding}:{length_class(b - a)}", *grades)
            for part in _PART.finditer(text, a, max(a, b)):
                x, y = part.span()
                inner = tested(x, y) if y - x < b - a else None
                if inner:
                    out.append((x, y, inner, *judged(x, y, inner), *whole))
    return out


RESULT = (
    "base array<struct<kind: string, at: int, upto: int>>, "
    "tested array<struct<at: int, upto: int, family: string, grade: int, odds: int, "
    "whole: string, whole_grade: int, whole_odds: int>>"
)


def grade_of(p: float) -> int:
    """Place on the grid: p is at most 2 ** -grade."""
    return min(GRID, int(-math.log2(p))) if p > 0 else GRID


def scan(docs: DataFrame, words: Words, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (carried columns) and ``result``: base spans and tested candidates."""

    def setup():
        def work(texts):
            out = []
            for t in as_bytes(texts):
                base = base_spans(t)
                tested = candidates(t, base, words)
                at = _points(t, [(a, b) for _, a, b in base] + [t[:2] for t in tested])
                out.append(
                    {
                        "base": sorted(
                            ({"kind": k, "at": a, "upto": b} for (k, _, _), (a, b) in zip(base, at)),
                            key=lambda s: (s["at"], KINDS.index(s["kind"])),
                        ),
                        "tested": [
                            {
                                "at": a, "upto": b, "family": f"{e}:{length_class(b - a)}", "grade": grade, "odds": odds,
                                "whole": whole, "whole_grade": whole_grade, "whole_odds": whole_odds,
                            }
                            for (_, _, e, grade, odds, whole, whole_grade, whole_odds), (a, b) in zip(tested, at[len(base) :])
                        ],
                    }
                )
            return out

        return work

    return map_rows(docs, carry or docs.columns, [column(text)], RESULT, setup)


def counted(scanned: DataFrame) -> list[tuple[str, int, int, int]]:
    """Candidates per family and grades: at most encodings x length classes x GRID x E_GRID rows."""
    tested = scanned.select(F.explode("result.tested").alias("t"))
    rows = tested.groupBy("t.family", "t.grade", "t.odds").count().collect()
    return [tuple(r) for r in rows]


def structured_grades(counts: list[tuple[str, int, int, int]], rate: float = BATTERY_ERRORS) -> dict[str, int]:
    """Least grade of each family that Benjamini-Hochberg rejects as not random."""
    families: dict[str, dict[int, int]] = {}
    for family, grade, _, n in counts:
        of = families.setdefault(family, {})
        of[grade] = of.get(grade, 0) + n
    cuts = {}
    for family, by in families.items():
        total, rejected, cut = sum(by.values()), 0, GRID + 1
        for grade in range(GRID, -1, -1):
            rejected += by.get(grade, 0)
            # All p-values counted so far are at most 2 ** -grade.
            if by.get(grade) and 2.0**-grade <= rate * rejected / total:
                cut = grade
        cuts[family] = cut
    return cuts


def reported_odds(counts: list[tuple[str, int, int, int]], cuts: dict[str, int], rate: float = FALSE_DISCOVERIES) -> int:
    """Least e-value grade that is reported: with ``k`` candidates there or above, ``m / (k * rate)`` is met."""
    m, by = 0, {}
    for family, grade, odds, n in counts:
        m += n
        if grade < cuts[family]:
            by[odds] = by.get(odds, 0) + n
    reported, least = 0, E_GRID + 1
    for odds in range(E_GRID, -1, -1):
        reported += by.get(odds, 0)
        if by.get(odds) and 2.0**odds * reported * rate >= m:
            least = odds
    return least


def find_secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``spans``: base spans and random ones, by start, then kind as listed."""
    from ledgerscope.llm.components import use_checkpoints

    use_checkpoints(docs.sparkSession)
    # Spans only: small beside the texts, and read twice.
    scanned = scan(docs, fit_words(docs, text), text, carry).checkpoint()
    counts = counted(scanned)
    cuts = structured_grades(counts)
    least = reported_odds(counts, cuts)
    limits = F.create_map(*[x for k, v in sorted(cuts.items()) for x in (F.lit(k), F.lit(v))]) if cuts else None

    def passes(family, grade, odds):
        return (grade < F.coalesce(F.element_at(limits, family), F.lit(0))) & (odds >= least)

    def is_random(t):
        # A part of a random whole is reported with it.
        whole = passes(F.coalesce(t["whole"], F.lit("")), F.coalesce(t["whole_grade"], F.lit(0)), F.coalesce(t["whole_odds"], F.lit(-1)))
        return passes(t["family"], t["grade"], t["odds"]) & ~whole

    kind = "array<struct<kind: string, at: int, upto: int>>"
    if limits is None:
        found = F.array().cast(kind)
    else:
        found = F.transform(
            F.filter("result.tested", is_random),
            lambda t: F.struct(F.lit("random").alias("kind"), t["at"].alias("at"), t["upto"].alias("upto")),
        )
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])

    def keyed(s):
        return F.struct(s["at"].alias("at"), F.element_at(rank, s["kind"]).alias("nth"), s["kind"].alias("kind"), s["upto"].alias("upto"))

    merged = F.array_sort(F.transform(F.concat(F.col("result.base"), found), keyed))
    spans = F.transform(merged, lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["upto"].alias("upto")))
    return scanned.select("row", F.col("result.base").alias("base"), spans.alias("spans"))


def joined(spans: str):
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"], s["upto"])), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts per base kind, digest of base spans, all spans."""
    found = find_secrets(docs, text, [doc_id])
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        F.col("row").getField(doc_id).alias("doc_id"),
        *counts,
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
