"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of consecutive words of every item.  Document words
stream through it; the state keeps the longest run that ends at the current word, so a
run of ``window`` words, or a whole shorter item, is seen at its last word in constant
time per word.  Documents at or above the coverage limit are contaminated and lose the
covered spans.

Items are turned into automata in blocks of bounded size; each block is one pass over
the documents, chained on the rows, so no block is dropped and nothing is joined.

Defined results: null and empty texts have no words and no hits; items without words
match nothing; repeated items count by their id once, an item without id is listed as
``null``; repeated documents are each judged alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.frames import as_bytes, column, map_rows

WINDOW = 13
# A document is contaminated when covered words reach one in this many.
ONE_IN = 20
# Item bytes of one automaton: about 10^5 words, some tens of MB in a worker.
BLOCK_BYTES = 600_000

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
# Lower case for A-Z; every byte that is in no word becomes a blank.
FOLD = bytes((c if c in _WORD else 0x20) for c in (b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters a-z and characters beyond ASCII."""
    return text.translate(FOLD).split()


class Automaton:
    """Suffix automaton over the words of several items; no run crosses two items."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: list[list[tuple[int, str]]] = []
        texts = []
        for name, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in words_of(text)]
            if ids:
                texts.append((name, ids))
        for _, ids in texts:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self._mark(texts)

    def _new(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        """Split off the part of ``q`` that ``p`` reaches by ``w`` alone."""
        copy = self._new(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new = self._new({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def _mark(self, texts) -> None:
        """Items of each state whose runs may be windows, and short items as windows.

        ``owners[s]``: items that hold the runs of ``s``, for states that reach the
        window's length.  ``short[s]``: (length, item) of items shorter than a window
        that are a suffix of the longest run of ``s``, longest first.
        """
        states = len(self.next)
        self.owners: list[list[str]] = [[] for _ in range(states)]
        ends: dict[int, list[tuple[int, str]]] = {}
        for name, ids in texts:
            s, seen = 0, set()
            for w in ids:
                s = self.next[s][w]
                at = s
                while at > 0 and at not in seen and self.length[at] >= self.window:
                    seen.add(at)
                    if len(ids) >= self.window:
                        self.owners[at].append(name)
                    at = self.link[at]
            if len(ids) < self.window:
                ends.setdefault(s, []).append((len(ids), name))
        self.short = [[] for _ in range(states)]
        if ends:
            for s in sorted(range(1, states), key=self.length.__getitem__):
                self.short[s] = sorted(ends.get(s, []), reverse=True) + self.short[max(self.link[s], 0)]
        self.any_short = bool(ends)

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered word ranges (end exclusive, merged) and the items that occur."""
        known = list(map(self.words.get, words))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        edges, link, length, window = self.next, self.link, self.length, self.window
        any_short, short = self.any_short, self.short
        state = size = 0
        for at, w in enumerate(known):
            if w is None:
                state = size = 0
                continue
            to = edges[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = edges[state].get(w)
            state = to
            size += 1
            covered = 0
            if size >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                # Earlier windows of this run were covered when their last word came.
                found.update(self.owners[s])
                covered = window
            if any_short and short[state]:
                for n, name in short[state]:
                    if n <= size:
                        found.add(name)
                        covered = max(covered, n)
            if covered:
                start = at + 1 - covered
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        return spans, found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES):
    """The items in blocks of about ``block_bytes``, one after the other."""
    rows = items.select(
        F.coalesce(column(item_id).cast("string"), F.lit("null")).alias("id"),
        F.coalesce(column(text), F.lit("")).alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for i in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        yield [(r["id"], r["text"].encode()) for r in part.collect()]


RESULT = "n_words long, n_hit long, spans array<long>, items array<string>"


def scan_documents(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``row`` (carried columns) and ``result``: words, covered words, their ranges, items.

    ``spans`` lists start and end (exclusive) of each covered range of words in turn.
    """
    context = docs.sparkSession.sparkContext
    kept = F.struct(*[column(c) for c in (carry or docs.columns)])
    done = docs.select(
        kept.alias("row"), column(text).alias("text"), F.lit(None).cast(f"struct<{_ddl(RESULT)}>").alias("result")
    )
    for block in item_blocks(items, item_id, item_text, block_bytes):
        # One block: bounded by block_bytes.
        shared = context.broadcast(block)
        step = map_rows(done, ["row", "text"], [F.col("text"), F.col("result")], RESULT, _scanner(shared, window))
        done = step.select("row.row", "row.text", "result")
    return done.select("row", "result")


def _ddl(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in fields.split(", ")))


def _scanner(shared, window: int):
    def setup():
        automaton = Automaton(shared.value, window)

        def work(texts, before):
            out = []
            for text, old in zip(as_bytes(texts), before.to_pylist()):
                words = words_of(text)
                spans, found = automaton.scan(words)
                if old:
                    flat = old["spans"]
                    spans = _merge(spans + list(zip(flat[::2], flat[1::2])))
                    found.update(old["items"])
                out.append(
                    {
                        "n_words": len(words),
                        "n_hit": sum(b - a for a, b in spans),
                        "spans": [x for s in spans for x in s],
                        "items": sorted(found),
                    }
                )
            return out

        return work

    return setup


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: covered words, items found and the verdict."""
    done = scan_documents(docs, items, text, [doc_id])
    r = F.col("result")
    return done.select(
        F.col("row").getField(doc_id).alias("doc_id"),
        r["n_words"].alias("n_words"),
        r["n_hit"].alias("n_hit"),
        F.size(r["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", r["items"]), 256).alias("items_sha256"),
        is_contaminated(r).alias("contaminated"),
    )


def is_contaminated(result):
    """The coverage limit, in whole numbers."""
    return (result["n_hit"] > 0) & (ONE_IN * result["n_hit"] >= result["n_words"])


def cut_words(text: str, spans: Sequence[int]) -> str:
    """``text`` without the word ranges; what stood between two kept words stays once."""
    data = text.encode()
    blank = np.frombuffer(data.translate(FOLD), np.uint8) == 0x20
    edge = np.diff(np.concatenate(([1], blank.astype(np.int8), [1])))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(data[at : first[a]])
        at = int(last[b - 1])
        # The blank behind a removed range goes with it, if one stays before it.
        if at < len(data) and data[at : at + 1] in (b" ", b"\n") and (not out[-1] or out[-1][-1:] in (b" ", b"\n")):
            at += 1
    out.append(data[at:])
    return b"".join(out).decode()


def remove_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    max_coverage: float = 0.5,
    **options,
) -> DataFrame:
    """The documents without test items; clean documents stay as they are.

    A contaminated document loses its covered spans; one whose spans cover
    ``max_coverage`` of its words or more, or that has no word left, goes altogether.
    """
    names = docs.columns
    done = scan_documents(docs, items, text, names, **options)
    r = F.col("result")
    bad = is_contaminated(r)
    kept = done.filter(~bad | (r["n_hit"] < max_coverage * r["n_words"]))
    row_text = F.col("row").getField(text)
    spans = F.when(bad, r["spans"]).otherwise(F.array().cast("array<long>"))

    def setup():
        def work(texts, ranges):
            pairs = zip(texts.to_pylist(), ranges.to_pylist())
            return [{"text": cut_words(t, s) if s else t} for t, s in pairs]

        return work

    cut = map_rows(kept, ["row"], [row_text, spans], "text string", setup)
    new = [
        (F.col("result.text") if n == text else F.col("row.row").getField(n)).alias(n) for n in names
    ]
    return cut.select(*new)
