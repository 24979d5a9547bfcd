"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring symbols that stands inside no vocabulary token can never end up
in one token, so the text may be cut there: merges cannot cross the cut and the two
sides are encoded on their own.  Fragments are few and repeat, so each is merged once
per worker and looked up afterwards.

Defined results: null is the empty text; an empty text has no tokens; texts of any
length are encoded whole; a symbol outside the vocabulary is left out, as the tokenizer
file asks when it names no unknown token.  Letter and number classes are those of the
installed ``regex``; code points assigned after the tokenizer library's own Unicode
tables may be split differently.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.frames import as_texts, column, map_rows

# Entries a worker keeps before it starts over; bounds its memory, never the result.
CACHE_ENTRIES = 300_000
# Longer fragments are merged with a heap.
LONG_FRAGMENT = 64
_NONE = 1 << 60
# The usual word pattern of word-end tokenizers, and its meaning for ASCII text.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
# White space as the tokenizer's own patterns understand it.
_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPLIT = re.compile(f"[{_SPACE}]+")
# White space to str.split() but not to the tokenizer's pattern.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def _keep(cache: dict, key: str, entry: tuple[int, str, str], most: int) -> None:
    """Long keys are rare and large: they are not kept."""
    if len(key) < 64:
        if len(cache) >= most:
            cache.clear()
        cache[key] = entry


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        shown.setdefault(b, chr(0x100 + len([x for x in range(b) if x not in plain])))
    return [shown[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one word-end BPE tokenizer file (its JSON text)."""

    def __init__(self, spec: str, cache_entries: int | None = None):
        self.cache_entries = cache_entries or CACHE_ENTRIES
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("a plain BPE tokenizer file is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = added
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in added.items()}
        steps = data["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self._words = regex.compile(pattern.replace(r"\s", _SPACE), regex.V1)
        self._usual = pattern == _WORD_PATTERN
        self._symbols = byte_symbols()
        self.inside = self._pairs()
        self._words_seen: dict[str, tuple[int, str, str]] = {}
        self._pieces: dict[str, tuple[int, str, str]] = {}

    def _split_symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _pairs(self) -> set[tuple[str, str]]:
        """Neighbouring symbols inside any token; every other pair is a forced boundary."""
        found = set()
        for token in self.vocab:
            symbols = self._split_symbols(token)
            found.update(zip(symbols, symbols[1:]))
        return found

    def fragments(self, symbols: list[str]) -> list[list[str]]:
        """The symbols cut at every forced boundary."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(zip(symbols, symbols[1:]), 1) if pair not in inside]
        if not cuts:
            return [symbols]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]

    def _merge(self, fragment: list[str]) -> list[int]:
        """Merges of lowest rank first, leftmost first; symbols unknown to the vocabulary go."""
        vocab = self.vocab
        parts = [s for s in fragment if s in vocab]
        if len(parts) > LONG_FRAGMENT:
            return self._merge_long(parts)
        rank = self.ranks.get
        waiting = [rank(p, _NONE) for p in zip(parts, parts[1:])]
        while waiting:
            best = min(waiting)
            if best == _NONE:
                break
            i = waiting.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del waiting[i]
            if i:
                waiting[i - 1] = rank((parts[i - 1], parts[i]), _NONE)
            if i < len(waiting):
                waiting[i] = rank((parts[i], parts[i + 1]), _NONE)
        return [vocab[p] for p in parts]

    def _merge_long(self, parts: list[str | None]) -> list[int]:
        """The same merges by a heap over a linked list: no square in the length."""
        n = len(parts)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else n
            if parts[i] != pair[0] or j >= n or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < n:
                    new = (parts[a], parts[right[a]])
                    if new in ranks:
                        heapq.heappush(heap, (ranks[new], a, new))
        return [self.vocab[p] for p in parts if p is not None]

    def _word_ids(self, word: str) -> list[int]:
        if word.isascii() and word.isprintable():
            symbols = list(word)
        else:
            symbols = [self._symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        return [i for fragment in self.fragments(symbols) for i in self._merge(fragment)]

    def _word(self, word: str) -> tuple[int, str, str]:
        known = self._words_seen.get(word)
        if known is None:
            ids = self._word_ids(word)
            known = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            _keep(self._words_seen, word, known, self.cache_entries)
        return known

    def _piece(self, piece: str) -> tuple[int, str, str]:
        """Count, ids and decoded text of a run without white space."""
        low = piece
        if not low.isascii():
            low = unicodedata.normalize("NFC", low)
            # Lower-casing is by character; str.lower() would look around a final sigma.
            low = "σ".join(x.lower() for x in low.split("Σ"))
        else:
            low = low.lower()
        words = _ASCII_WORDS(low) if self._usual and low.isascii() else self._words.findall(low)
        if len(words) == 1:
            entry = self._word(words[0])
        else:
            found = [e for e in map(self._word, words) if e[0]]
            entry = (sum(e[0] for e in found), " ".join(e[1] for e in found), " ".join(e[2] for e in found))
        _keep(self._pieces, piece, entry, self.cache_entries)
        return entry

    def _chunks(self, text: str) -> list[tuple[int, str, str]]:
        """Count, ids and decoded text of each run between white space."""
        if self._special and any(t in text for t in self.special):
            found = []
            for part in self._special.split(text):
                if part in self.special:
                    found.append((1, str(self.special[part]), part))
                else:
                    found += self._chunks(part)
            return found
        if any(c in text for c in _SEPARATORS):
            pieces = [p for p in _SPLIT.split(text) if p]
        else:
            pieces = text.split()
        known, make = self._pieces.get, self._piece
        return [known(p) or make(p) for p in pieces]

    def encode(self, text: str) -> list[int]:
        return [int(i) for n, ids, _ in self._chunks(text) if n for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def summary(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, the decimal ids joined by a space, and the decoded text."""
        chunks = [c for c in self._chunks(text) if c[0]]
        if not chunks:
            return 0, "", ""
        counts, ids, texts = zip(*chunks)
        return sum(counts), " ".join(ids), " ".join(texts)


def read_spec(path: str) -> str:
    """The tokenizer file as text, read by the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _on_documents(
    docs: DataFrame, path: str, text: str, carry: list[str], result: str, row, cache_entries: int | None = None
) -> DataFrame:
    # A vocabulary file: a few MB whatever the corpus is.
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def setup():
        codec = Codec(spec.value, cache_entries)
        return lambda texts: [row(codec, t) for t in as_texts(texts)]

    return map_rows(docs, carry, [column(text)], result, setup)


def encode(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the carried columns) and ``result`` (``ids``, ``n_tokens``)."""

    def row(codec: Codec, t: str) -> dict:
        ids = codec.encode(t)
        return {"ids": ids, "n_tokens": len(ids)}

    return _on_documents(docs, path, text, carry or docs.columns, "ids array<int>, n_tokens long", row)


def decode(rows: DataFrame, path: str, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``result`` (``text``): what the ids decode to; null ids: empty."""
    spec = rows.sparkSession.sparkContext.broadcast(read_spec(path))

    def setup():
        codec = Codec(spec.value)
        return lambda lists: [{"text": codec.decode(x or [])} for x in lists.to_pylist()]

    return map_rows(rows, carry or rows.columns, [column(ids)], "text string", setup)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, then decode the ids."""

    def row(codec: Codec, t: str) -> dict:
        n, ids, decoded = codec.summary(t)
        return {
            "n_tokens": n,
            "ids_sha256": hashlib.sha256(ids.encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
        }

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    done = _on_documents(docs, path, text, [doc_id], kind, row)
    return done.select(F.col("row").getField(doc_id).alias("doc_id"), "result.*")


def tokenised(
    docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None, cache_entries: int = 60_000
) -> DataFrame:
    """``row`` and ``result``: ids of the whole text, and the digest of what they decode to.

    The caches are smaller here, as the ids themselves need memory in the worker.
    """

    def row(codec: Codec, t: str) -> dict:
        n, ids, decoded = codec.summary(t)
        return {
            "n_tokens": n,
            "ids": np.array(ids.split(), np.int32),
            "decoded_sha256": hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
        }

    kind = "n_tokens long, ids array<int>, decoded_sha256 string"
    return _on_documents(docs, path, text, carry or docs.columns, kind, row, cache_entries)
