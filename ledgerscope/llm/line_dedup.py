"""Line dedup by pairwise alignment.

Lines are hashed after folding case and blanks.  A block is a run of neighbouring lines
with ``MIN_WORDS`` words or more.  At each line the shortest block that starts there and
the shortest that ends there are its keys; every line of a block that two documents share
lies in such a key that both have.  Each key links the documents that hold it to the first
of them (smallest id), so pairs grow with the keys and not with the square of a group; no
key is too frequent to be followed.  For each pair, only the keys they share travel, with
their places in both documents.

The pair is aligned by patience diff: lines rare in the pair, that is unique in both, are
anchors (where a gap has none, equal occurrences are numbered and serve instead); the
longest increasing chain of anchors is kept; the gaps between are aligned in the same way;
and every anchor grows over equal neighbours.  Runs of aligned neighbouring lines are
common blocks.  Blocks of ``MIN_WORDS`` words or more are deleted from the later document.
Keys that the chain had to leave out, because they stand in another order, are aligned on
their own.  So a line goes exactly if it lies in a block that any earlier document has too.

Defined results: null and empty texts have no lines; blank lines are never deleted and do
not part a block; a line repeated within one document only is left alone; rows that repeat
an id are ordered by the hash of their text, and rows that repeat id and text are one
document with one decision; documents without id come last; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.components import use_checkpoints
from ledgerscope.llm.frames import as_bytes, column, map_rows, starts_of, stream_groups

MIN_WORDS = 5
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def lines_of(text: bytes) -> list[tuple[int, int]]:
    """Hash (signed) and number of words of each line that is not blank, in order."""
    out = []
    for line in text.translate(_LOWER).split(b"\n"):
        words = line.split()
        if words:
            h = xxhash.xxh64_intdigest(b" ".join(words))
            out.append((h - (1 << 64) if h >> 63 else h, len(words)))
    return out


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain ascending in both places; ``pairs`` ascend in the first."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, e) in enumerate(pairs):
        k = bisect_left(tails, e)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(e)
            at.append(i)
        else:
            tails[k], at[k] = e, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(own: dict[int, int], other: dict[int, int]) -> list[tuple[int, int]]:
    """Aligned places of two documents given as place -> line hash (shared lines only)."""
    out: list[tuple[int, int]] = []
    places = [sorted(own), sorted(other)]
    stack = [(0, len(places[0]), 0, len(places[1]))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        once: list[dict[int, int]] = []
        for doc, (lo, hi), where in ((own, (a0, a1), places[0]), (other, (b0, b1), places[1])):
            seen: dict[int, int] = {}
            for i in range(lo, hi):
                h = doc[where[i]]
                seen[h] = -1 if h in seen else i
            once.append(seen)
        anchors = _chain(sorted((i, once[1][h]) for h, i in once[0].items() if i >= 0 and once[1].get(h, -1) >= 0))
        if not anchors:
            anchors = _chain(_numbered(own, places[0][a0:a1], a0, other, places[1][b0:b1], b0))
        if not anchors:
            continue
        low_a, low_b = a0, b0
        for n, (i, j) in enumerate(anchors):
            if i < low_a or j < low_b:
                continue
            high_a, high_b = (anchors[n + 1] if n + 1 < len(anchors) else (a1, b1))
            first_i, first_j = i, j
            while first_i > low_a and first_j > low_b and _next(own, other, places, first_i - 1, first_j - 1):
                first_i, first_j = first_i - 1, first_j - 1
            last_i, last_j = i, j
            while last_i + 1 < high_a and last_j + 1 < high_b and _next(own, other, places, last_i, last_j):
                last_i, last_j = last_i + 1, last_j + 1
            out += [(places[0][first_i + k], places[1][first_j + k]) for k in range(last_i - first_i + 1)]
            stack.append((low_a, first_i, low_b, first_j))
            low_a, low_b = last_i + 1, last_j + 1
        stack.append((low_a, a1, low_b, b1))
    return sorted(out)


def _numbered(own, a: list[int], a0: int, other, b: list[int], b0: int) -> list[tuple[int, int]]:
    """The n-th occurrence of a line here and the n-th there."""
    waiting: dict[int, list[int]] = {}
    for j, place in enumerate(b, b0):
        waiting.setdefault(other[place], []).append(j)
    turn: dict[int, int] = {}
    out = []
    for i, place in enumerate(a, a0):
        h = own[place]
        n = turn.get(h, 0)
        if n < len(waiting.get(h, ())):
            out.append((i, waiting[h][n]))
            turn[h] = n + 1
    return out


def keys_of(lines: list[tuple[int, int]], least: int = MIN_WORDS) -> dict[tuple[int, ...], list[int]]:
    """Line hashes of the shortest blocks that start or end at a line, and where they start."""
    out: dict[tuple[int, ...], list[int]] = {}
    n, stop, total = len(lines), 0, 0
    spans: dict[int, set[int]] = {}
    for start in range(n):
        while stop < n and total < least:
            total += lines[stop][1]
            stop += 1
        if total < least:
            break
        spans.setdefault(start, set()).add(stop)
        total -= lines[start][1]
    start, total = n, 0
    for stop in range(n, 0, -1):
        while start and total < least:
            start -= 1
            total += lines[start][1]
        if total < least:
            break
        spans.setdefault(start, set()).add(stop)
        total -= lines[stop - 1][1]
    for start in sorted(spans):
        for stop in sorted(spans[start]):
            out.setdefault(tuple(h for h, _ in lines[start:stop]), []).append(start)
    return out


def shared_places(keys: list[tuple[list[int], list[int], list[int], list[int]]], least: int = MIN_WORDS) -> list[int]:
    """Places of the later document in blocks it shares: ``keys`` are line hashes, words, and places in both."""
    own: dict[int, int] = {}
    other: dict[int, int] = {}
    words: dict[int, int] = {}
    for hashes, counts, at, other_at in keys:
        for shift, (h, w) in enumerate(zip(hashes, counts)):
            for p in at:
                own[p + shift], words[p + shift] = h, w
            for p in other_at:
                other[p + shift] = h
    gone = set(blocks(align(own, other), words, least))
    for hashes, _, at, other_at in keys:
        there = {other_at[0] + shift: h for shift, h in enumerate(hashes)}
        for p in at:
            here = {p + shift: h for shift, h in enumerate(hashes)}
            if not gone.issuperset(here):
                gone.update(blocks(align(here, there), words, least))
    return sorted(gone)


def _next(own, other, places, i: int, j: int) -> bool:
    """Whether places ``i`` and ``i + 1`` follow on each other in both documents with equal lines."""
    a, b = places
    return (
        a[i] + 1 == a[i + 1]
        and b[j] + 1 == b[j + 1]
        and own[a[i]] == other[b[j]]
        and own[a[i + 1]] == other[b[j + 1]]
    )


def blocks(aligned: list[tuple[int, int]], words: dict[int, int], least: int = MIN_WORDS) -> list[int]:
    """Places of the own document in blocks of at least ``least`` words."""
    out: list[int] = []
    run: list[int] = []
    last = None
    for i, j in [*aligned, (None, None)]:
        if last is None or i != last[0] + 1 or j != last[1] + 1:
            if sum(words[p] for p in run) >= least:
                out += run
            run = []
        if i is None:
            break
        run.append(i)
        last = (i, j)
    return out


def _key(hashes: tuple[int, ...]) -> int:
    """One line's own hash, or a hash of several."""
    if len(hashes) == 1:
        return hashes[0]
    h = xxhash.xxh64_intdigest(np.array(hashes, np.int64).tobytes())
    return h - (1 << 64) if h >> 63 else h


def _identified(docs: DataFrame, doc_id: str, text: str) -> list:
    """A row's identity: two 64-bit hashes of its id and text."""
    th = F.xxhash64(F.coalesce(column(text), F.lit("")))
    return [F.xxhash64(column(doc_id), F.isnull(column(doc_id)), th).alias("uid"), th.alias("th")]


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``uid, th, n_lines, deleted``: places, among lines that are not blank, to delete."""
    use_checkpoints(docs.sparkSession)
    source = docs.select(column(doc_id).alias("id"), *_identified(docs, doc_id, text), column(text).alias("text"))

    def setup():
        def work(texts):
            out = []
            for t in as_bytes(texts):
                lines = lines_of(t)
                keys = [
                    {"h": _key(key), "at": at, "hashes": key, "words": [w for _, w in lines[at[0] : at[0] + len(key)]]}
                    for key, at in keys_of(lines, least).items()
                ]
                out.append({"n": len(lines), "keys": keys})
            return out

        return work

    kind = "n int, keys array<struct<h: long, at: array<int>, hashes: array<long>, words: array<int>>>"
    # Hashes and places only; read three times.
    hashed = map_rows(source, ["id", "uid", "th"], [F.col("text")], kind, setup).select("row.*", "result.*")
    hashed = hashed.dropDuplicates(["uid", "th"]).checkpoint()
    held = hashed.select(F.struct(F.isnull("id").alias("none"), "id", "th", "uid").alias("doc"), F.explode("keys").alias("l"))
    held = held.select("doc", "l.*")
    ends = held.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first <> last")
    repeated = held.join(ends.select("h", "first"), "h")
    firsts = repeated.filter("doc = first").select("h", F.col("at").alias("other_at"))
    later = repeated.filter("doc <> first").join(firsts, "h")
    pairs = later.select(
        F.col("doc.uid").alias("uid"), F.col("doc.th").alias("th"), F.col("first.uid").alias("e_uid"), F.col("first.th").alias("e_th"),
        "h", "hashes", "words", "at", "other_at",
    )

    def work(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[dict]:
        for part in parts:
            edges = starts_of(part["uid"], part["th"], part["e_uid"], part["e_th"])
            made: dict[str, list] = {"uid": [], "th": [], "gone": []}
            columns = [part[c] for c in ("hashes", "words", "at", "other_at")]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                gone = shared_places([tuple(c[k].tolist() for c in columns) for k in range(a, b)], least)
                if gone:
                    made["uid"].append(part["uid"][a])
                    made["th"].append(part["th"][a])
                    made["gone"].append(gone)
            if made["uid"]:
                yield made

    cut = stream_groups(pairs, ["uid", "th", "e_uid", "e_th"], ["h"], "uid long, th long, gone array<int>", work)
    # A document's own lines bound what is gathered for it.
    cut = cut.groupBy("uid", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("deleted"))
    return hashed.select("uid", "th", "n").join(cut, ["uid", "th"], "left").select(
        "uid", "th", F.col("n").cast("long").alias("n_lines"), F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted")
    )


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_deleted, deleted``: places of deleted lines, comma-joined."""
    found = duplicate_lines(docs, doc_id, text, least)
    rows = docs.select(column(doc_id).alias("doc_id"), *_identified(docs, doc_id, text))
    return rows.join(found, ["uid", "th"]).select(
        "doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), F.array_join("deleted", ",").alias("deleted")
    )


def cut_lines(text: str, deleted: list[int]) -> str:
    gone, place, kept = set(deleted), 0, []
    for line in text.split("\n"):
        if line.encode().split():
            if place not in gone:
                kept.append(line)
            place += 1
        else:
            kept.append(line)
    return "\n".join(kept)


def remove_duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """The documents without their deleted lines; those that lose every line go."""
    found = duplicate_lines(docs, doc_id, text, least).filter("size(deleted) > 0")
    packed = docs.select(F.struct("*").alias("row"), *_identified(docs, doc_id, text))
    joined = packed.join(found, ["uid", "th"], "left").filter("n_lines IS NULL OR size(deleted) < n_lines")

    def setup():
        def work(texts, deleted):
            pairs = zip(texts.to_pylist(), deleted.to_pylist())
            return [{"text": cut_lines(t, d) if d else t} for t, d in pairs]

        return work

    row_text = F.col("row").getField(text)
    done = map_rows(joined, ["row"], [row_text, F.col("deleted")], "text string", setup)
    return done.select(
        *[(F.col("result.text") if n == text else F.col("row.row").getField(n)).alias(n) for n in docs.columns]
    )
