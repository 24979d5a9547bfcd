"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint takes the majority of each bit over the XXH64 values of its
word shingles.  Two fingerprints link at ``MAX_BITS`` or fewer differing bits.

Distribution: the 64 bits are cut into six blocks.  At most four differing bits leave two
blocks whole, so linked fingerprints share at least one of the fifteen pairs of blocks;
these pairs are the shuffle keys, and only distinct fingerprints are shuffled.  Within a
key the fingerprints form a binary trie.  Pairs of its nodes are walked together from the
root; differing bits add up along the way, and a pair is dropped as soon as they exceed
the budget.  A pair of nodes whose leaves are in one component already is dropped too,
and the budget grows from one bit to four, so a dense group of near copies is joined by
few links.  A task gives a spanning forest of its links, never all pairs; connected
components over these give the classes.

Defined results: null and empty texts have the fingerprint zero, which links like any
other; repeated rows and copies share a fingerprint and are not expanded; rows without
id take part and get the class of their fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.components import connected, use_checkpoints
from ledgerscope.llm.frames import as_bytes, column, map_rows, starts_of, stream_groups

SHINGLE = 4
SEED = 42
MAX_BITS = 4
# Block borders of the 64 bits, and the pairs of blocks used as keys.
BORDERS = (0, 11, 22, 33, 44, 54, 64)
KEYS = tuple(combinations(range(len(BORDERS) - 1), 2))
# Node pairs walked at a time: bounds a task's memory.
FRONTIER = 1 << 18
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SLICE = 4_096


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by blanks; fewer words: the whole run."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    return np.array(
        [hashed(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())],
        np.uint64,
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        part = hashes[i : i + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (carried columns) and ``result.fp``: the 64 bits as a signed long."""

    def setup():
        def work(texts):
            values = [fingerprint(shingle_hashes(t)) for t in as_bytes(texts)]
            return [{"fp": v - (1 << 64) if v >> 63 else v} for v in values]

        return work

    return map_rows(docs, carry or docs.columns, [column(text)], "fp long", setup)


class _Forest:
    """Union-find over positions; every link that joins two trees is kept."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))

    def labels(self) -> np.ndarray:
        parent = np.array(self.parent)
        while True:
            up = parent[parent]
            if (up == parent).all():
                return parent
            parent = up


def trie_links(values: np.ndarray, groups: np.ndarray, budget: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``budget`` bits among equal ``groups``.

    ``values`` (unsigned) are sorted and distinct within each group: a trie node is a
    range of positions that share a prefix, a group's root is all of it.
    """
    forest = _Forest(len(values))
    edges = starts_of(groups)
    roots = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if b - a > 1]
    for bits in range(1, budget + 1):
        label = forest.labels()
        # Where a run of equal labels ends: tells whether a node is of one component.
        change = np.flatnonzero(label[1:] != label[:-1]) + 1
        run_end = np.append(change, len(label))[np.searchsorted(change, np.arange(len(label)), side="right")]
        lo = np.array([a for a, _ in roots], np.int64)
        hi = np.array([b for _, b in roots], np.int64)
        stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))] if len(lo) else []
        while stack:
            depth, a0, a1, b0, b1, off = stack.pop()
            one = (label[a0] == label[b0]) & (run_end[a0] >= a1) & (run_end[b0] >= b1)
            keep = ~one
            a0, a1, b0, b1, off = a0[keep], a1[keep], b0[keep], b1[keep], off[keep]
            if not len(a0):
                continue
            single = (a1 - a0 == 1) & (b1 - b0 == 1)
            if single.any():
                x, y, used = a0[single], b0[single], off[single]
                rest = np.uint64((1 << (depth + 1)) - 1)
                apart = np.bitwise_count((values[x] ^ values[y]) & rest) + used
                near = (apart <= bits) & (x != y)
                for i, j in zip(x[near].tolist(), y[near].tolist()):
                    forest.join(i, j)
                keep = ~single
                a0, a1, b0, b1, off = a0[keep], a1[keep], b0[keep], b1[keep], off[keep]
            if depth < 0 or not len(a0):
                continue
            am, bm = _middles(values, a0, a1, depth), _middles(values, b0, b1, depth)
            own = (a0 == b0) & (a1 == b1)
            parts = [
                (a0, am, b0, bm, off, None),
                (am, a1, bm, b1, off, None),
                (a0, am, bm, b1, off + 1, None),
                (am, a1, b0, bm, off + 1, ~own),
            ]
            made = []
            for p0, p1, q0, q1, used, only in parts:
                good = (p1 > p0) & (q1 > q0) & (used <= bits)
                if only is not None:
                    good &= only
                made.append((p0[good], p1[good], q0[good], q1[good], used[good]))
            joined = [np.concatenate([m[i] for m in made]) for i in range(5)]
            for i in range(0, len(joined[0]), FRONTIER):
                stack.append((depth - 1, *[x[i : i + FRONTIER] for x in joined]))
    return forest.links


def _middles(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First position of each range whose ``bit`` is set (ranges share all higher bits)."""
    lo, hi = lo.copy(), hi.copy()
    mask = np.uint64(1 << bit)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        set_ = (values[mid] & mask) != 0
        hi[open_[set_]] = mid[set_]
        lo[open_[~set_]] = mid[~set_] + 1


def block_keys(fp: str = "fp"):
    """One key per pair of blocks: the pair's number and the bits of both blocks."""
    keys = []
    for n, (i, j) in enumerate(KEYS):
        mask = 0
        for k in (i, j):
            mask |= ((1 << (BORDERS[k + 1] - BORDERS[k])) - 1) << BORDERS[k]
        mask -= (1 << 64) if mask >> 63 else 0
        bits = F.col(fp).bitwiseAND(F.lit(mask))
        keys.append(F.struct(F.lit(n).cast("byte").alias("n"), bits.alias("bits")))
    return F.explode(F.array(*keys))


def links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """``a, b``: links that connect all fingerprints within ``MAX_BITS``, a forest per task."""
    keyed = prints.select(F.col(fp).alias("fp"), block_keys(fp).alias("k"))
    keyed = keyed.select(F.col("k.n").alias("n"), F.col("k.bits").alias("bits"), "fp")

    def work(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[dict]:
        for part in parts:
            edges = starts_of(part["n"], part["bits"])
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            # Groups of one fingerprint have no pair.
            many = np.repeat(np.diff(edges) > 1, np.diff(edges))
            if not many.any():
                continue
            fp, group = part["fp"][many].view(np.uint64), group[many]
            order = np.lexsort((fp, group))
            fp, group = fp[order], group[order]
            found = trie_links(fp, group)
            if found:
                at = np.array(found)
                yield {"a": fp[at[:, 0]].view(np.int64), "b": fp[at[:, 1]].view(np.int64)}

    return stream_groups(keyed, ["n", "bits"], ["fp"], "a long, b long", work).distinct()


def _classed(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`fingerprints`, kept, and ``fp, class`` of each fingerprint."""
    use_checkpoints(made.sparkSession)
    # Read twice; a few numbers a document.
    rows = made.select("row.*", F.col("result.fp").alias("fp")).checkpoint()
    prints = rows.select("fp").distinct()
    label = connected(links(prints), "a", "b").withColumnRenamed("node", "fp")
    # A fingerprint without links is its own class.
    return rows, prints.join(label, "fp", "left").select("fp", F.coalesce("component", "fp").alias("class"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable over links."""
    source = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    rows, named = _classed(fingerprints(source, "text", ["doc_id"]))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    least = first.join(named, "fp").groupBy("class").agg(F.min("first").alias("component_id"))
    of = named.join(least, "class").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``."""
    found = classes(docs, doc_id, text)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: the smallest id, then the smallest hash of its text.

    Rows that repeat id and text are one document.
    """
    key = [column(doc_id).alias("id"), F.xxhash64(F.coalesce(column(text), F.lit(""))).alias("th")]
    rows, named = _classed(fingerprints(docs.select(*key, column(text).alias("text")), "text", ["id", "th"]))
    mine = F.struct(F.isnull("id").alias("none"), "id", "th")
    first = rows.groupBy("fp").agg(F.min(mine).alias("first"))
    chosen = first.join(named, "fp").groupBy("class").agg(F.min("first").alias("first")).select("first.id", "first.th")
    packed = docs.select(F.struct("*").alias("row"), *key)
    same = (packed["th"] == chosen["th"]) & packed["id"].eqNullSafe(chosen["id"])
    kept = packed.join(chosen, same, "left_semi")
    nth = F.row_number().over(Window.partitionBy("th", "id").orderBy("th"))
    return kept.withColumn("nth", nth).filter("nth = 1").select("row.*")
