"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton, which accepts every run of
characters of that text.  A document is parsed against it greedily: each phrase is the
longest run the automaton accepts.  Fewer phrases, each weighted by the bits that name a
place in the training text, mean a smaller cross entropy; the smallest wins.

Parsing runs in numpy over many pieces of text at once: documents are cut every
``PIECE`` characters into lanes, all lanes take one character a step, and the automata
are transition tables.  A cut may add one phrase in every language alike.

The training sample is bounded: ``rows_per_language`` documents of each language, those
with the smallest hash of their text, and ``chars_per_language`` characters of them.
Every document is then parsed whole.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so
is every text when nothing was learned; ties go to the language first in order; rows
with null language are not learned from; repeated rows get equal results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.frames import column, flat, map_rows, slices

ROWS_PER_LANGUAGE = 64
CHARS_PER_LANGUAGE = 30_000
# All automata together; more languages mean shorter training texts.
CHARS_IN_ALL = 150_000
# Letters with a column of their own in the transition tables; the rest are sparse.
DENSE_LETTERS = 250
PIECE = 512
UNDETERMINED = "und"
RESULT = "lang_pred string, score double, known double, bits double"


def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], np.uint8)


@dataclass
class Model:
    """Languages in order, symbol of each code point, and a transition table per language.

    Symbol 0 is everything that is not a letter, symbol 1 a letter never learned.
    ``tables[k][state * width + symbol]`` is ``2 * next_row + new_phrase`` for symbols under
    ``width``, those of the most frequent letters.  Transitions by the others are few:
    ``sparse[k]`` holds ``state * n_symbols + symbol`` in order, and the next states.
    """

    languages: list[str]
    letters: str
    tables: list[np.ndarray]
    phrase_bits: list[float]
    sparse: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @property
    def n_symbols(self) -> int:
        return len(self.letters) + 2

    @property
    def width(self) -> int:
        return min(len(self.letters), DENSE_LETTERS) + 2

    def rare(self, k: int, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What ``tables[k]`` would hold for symbols beyond its width."""
        width, (keys, after) = self.width, self.sparse[k]
        state, symbol = row.astype(np.int64) // width, symbol.astype(np.int64)
        alone = len(self.tables[k]) // width - 1

        def follow(key):
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            return np.where(keys[at] == key, after[at], -1) if len(keys) else np.full(len(key), -1)

        reached, start = follow(state * self.n_symbols + symbol), follow(symbol)
        start = np.where(start >= 0, start, alone)
        return np.where(reached >= 0, 2 * width * reached, 2 * width * start + (state > 0)).astype(np.int32)

    def symbols(self) -> np.ndarray:
        table = _letters().astype(np.int32)
        for i, c in enumerate(self.letters):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    table[ord(form)] = i + 2
        return table


def suffix_edges(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all runs of ``text``."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


def suffix_automaton(text: np.ndarray, width: int, edges: list[dict[int, int]] | None = None) -> np.ndarray:
    """Transitions (states x width, -1: none) by the symbols under ``width``."""
    edges = suffix_edges(text) if edges is None else edges
    table = np.full((len(edges), width), -1, np.int32)
    for s, out in enumerate(edges):
        dense = {c: t for c, t in out.items() if c < width}
        if dense:
            table[s, list(dense.keys())] = list(dense.values())
    return table


def _sparse(edges: list[dict[int, int]], width: int, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    found = sorted((s * n_symbols + c, t) for s, out in enumerate(edges) for c, t in out.items() if c >= width)
    return np.array([k for k, _ in found], np.int64), np.array([t for _, t in found], np.int64)


def _squeeze(symbols: np.ndarray) -> np.ndarray:
    """Runs of non-letters become one symbol 0."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    return keep


def train(samples: dict[str, list[str]], chars: int = CHARS_PER_LANGUAGE) -> Model:
    """Automata of labelled texts; ``chars`` bounds the text learned of each language."""
    languages = sorted(samples)
    chars = min(chars, CHARS_IN_ALL // max(1, len(languages)))
    texts = {k: "\n".join(samples[k])[: 2 * chars].lower() for k in languages}
    counts: dict[str, int] = {}
    for text in texts.values():
        for c in text:
            if c.isalpha():
                counts[c] = counts.get(c, 0) + 1
    # Every learned letter is a symbol; the most frequent come first.
    by_count = sorted(counts, key=lambda c: (-counts[c], c))
    letters = "".join(sorted(by_count[:DENSE_LETTERS]) + sorted(by_count[DENSE_LETTERS:]))
    model = Model(languages, letters, [], [])
    table, width = model.symbols(), model.width
    for k in languages:
        text = table[np.frombuffer(texts[k].encode("utf-32-le", "replace"), np.uint32)]
        text = text[_squeeze(text)][:chars]
        edges = suffix_edges(text)
        reached = suffix_automaton(text, width, edges)
        model.sparse.append(_sparse(edges, width, model.n_symbols))
        # A character unknown to the language is a phrase alone and leads to a state of
        # its own, where every character starts the next phrase.
        alone = len(reached)
        reached = np.vstack([reached, np.full((1, width), -1, np.int32)])
        start = np.where(reached[0] >= 0, reached[0], alone)
        step = np.where(reached >= 0, 2 * width * reached, 2 * width * start + 1)
        step[0] = 2 * width * start
        model.tables.append(step.astype(np.int32).ravel())
        model.phrase_bits.append(math.log2(max(2, len(text))))
    return model


class Parser:
    """Phrases of many texts at once."""

    def __init__(self, model: Model):
        self.model = model
        self.table = model.symbols()

    def __call__(self, texts: pa.Array) -> list[dict]:
        return [row for part in slices(texts) for row in self._parse(part)]

    def _parse(self, texts: pa.Array) -> list[dict]:
        data, at = flat(texts)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        # Character offsets: bytes that do not continue a character.
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        symbols = self.table[codes]
        begin = heads[at]
        keep = _squeeze(symbols)
        inner = begin[:-1][begin[:-1] < begin[1:]]
        keep[inner] = True
        letters = np.concatenate(([0], np.cumsum(symbols != 0)))
        known = np.concatenate(([0], np.cumsum(symbols > 1)))
        n_letters, n_known = np.diff(letters[begin]), np.diff(known[begin])
        begin = np.concatenate(([0], np.cumsum(keep)))[begin]
        symbols = symbols[keep]
        sizes = np.diff(begin)
        phrases = self._phrases(symbols, begin, sizes)
        return self._decide(phrases, sizes, n_letters, n_known)

    def _phrases(self, symbols, begin, sizes) -> np.ndarray:
        """Phrases of each text in each language."""
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[:-1][owner] + nth * PIECE
        size = np.minimum(PIECE, begin[1:][owner] - start)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        languages = range(len(self.model.languages))
        count = [np.ones(len(owner), np.int32) for _ in languages]
        state = [np.zeros(len(owner), np.int32) for _ in languages]
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        width = self.model.width
        some_rare = bool(len(symbols)) and int(symbols.max()) >= width
        for step in range(longest):
            n = int(active[step])
            symbol = symbols[start[:n] + step].astype(np.int32)
            rare = np.flatnonzero(symbol >= width) if some_rare else ()
            column_of = np.where(symbol < width, symbol, 1) if len(rare) else symbol
            for k in languages:
                moved = self.model.tables[k][state[k][:n] + column_of]
                if len(rare):
                    moved[rare] = self.model.rare(k, state[k][rare], symbol[rare])
                count[k][:n] += moved & 1
                state[k][:n] = moved >> 1
        out = np.zeros((len(sizes), len(self.model.languages)))
        for k in languages:
            out[:, k] = np.bincount(owner, weights=count[k], minlength=len(sizes))
        return out

    def _decide(self, phrases, sizes, n_letters, n_known) -> list[dict]:
        names = self.model.languages
        bits = phrases * np.array(self.model.phrase_bits) / np.maximum(sizes, 1)[:, None]
        out = []
        for row, letters, known in zip(bits, n_letters, n_known):
            if not letters or not names:
                out.append({"lang_pred": UNDETERMINED, "score": 0.0, "known": 0.0, "bits": None})
                continue
            order = np.argsort(row, kind="stable")
            best = row[order[0]]
            second = row[order[1]] if len(order) > 1 else None
            score = 1.0 if second is None else float(second / (best + second)) if best + second > 0 else 0.5
            out.append(
                {
                    "lang_pred": names[order[0]],
                    "score": score,
                    "known": float(known / letters),
                    "bits": float(best),
                }
            )
        return out


def training_sample(
    docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE
) -> dict[str, list[str]]:
    """At most ``rows`` texts of each language: the smallest hashes, limited map-side."""
    labelled = docs.select(column(lang).cast("string").alias("lang"), column(text).alias("text")).filter(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    # Only the head of a long text is carried; the sample is cut to a size anyway.
    labelled = labelled.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, CHARS_PER_LANGUAGE).alias("text"))
    by = Window.partitionBy("lang").orderBy("h", "text")
    picked = labelled.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= rows)
    found: dict[str, list[str]] = {}
    for row in picked.orderBy("lang", "n").collect():
        found.setdefault(row["lang"], []).append(row["text"])
    return found


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``."""
    return train(training_sample(docs, text, lang, rows))


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (carried columns) and ``result``: language, score, known letters, bits a character."""
    # Bounded by CHARS_IN_ALL: two states a character, one table row a state.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_rows(docs, carry or docs.columns, [column(text)], RESULT, lambda: Parser(shared.value))


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(column(doc_id).cast("string")) % 3 == 1


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    out = F.coalesce(held_out(doc_id), F.lit(False))
    model = learn(docs.filter(~out), text, lang)
    # The flag is made of the id alone and travels with the row.
    source = docs.select(column(doc_id).alias("doc_id"), out.alias("held_out"), column(text).alias("text"))
    done = predict(source, model, "text", ["doc_id", "held_out"])
    return done.select("row.doc_id", "row.held_out", "result.lang_pred", "result.score")


def keep_identified(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_known: float = 0.5
) -> DataFrame:
    """Documents in a learned language: some letter, most letters of learned alphabets."""
    done = predict(docs, learn(docs, text, lang), text, docs.columns)
    kept = done.filter((F.col("result.lang_pred") != UNDETERMINED) & (F.col("result.known") >= min_known))
    return kept.select("row.*")
