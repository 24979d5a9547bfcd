"""Embedding near-dedup by PCA-ordered tiled comparison.

Two vectors link if their labels are equal and their cosine is ``THRESHOLD`` or more.
Copies of a vector within a label are first joined to one representative with a count, so
a vector that a third of all rows share is compared once.  The representatives are scaled
to length one, centred and turned to the axes of their principal components.  They are
sorted by label and by interleaved bits of the leading coordinates, and cut by rank into
tiles of a bounded number of rows, so a hot label is many tiles.  Only pairs of tiles whose
boxes (leading coordinates and the length of the rest) come near enough meet in a task.

A task compares blocks of two tiles: it adds up the products of the leading dimensions,
adds the product of the lengths of what is left (Cauchy-Schwarz), and stops where this
bound cannot reach the threshold; scores next to the threshold are taken from the original
vectors.  It returns the number of links of each row and a spanning forest of the links,
so its output never exceeds a few rows per input row, however many pairs link.

Every pair at or above the threshold is found; work within a label that pruning cannot
help grows with the square of its distinct vectors, spread evenly over tile pairs.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component,
rows without label and rows without id link with nothing (``n_links`` 0, their own
component, kept).  Vectors of unequal length do not link.  Rows that repeat an id are
vectors each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.components import connected, use_checkpoints
from ledgerscope.llm.frames import arrow_type, column, map_rows, starts_of, stream_groups

THRESHOLD = 0.93
TILE_ROWS = 4096
TILE_BYTES = 4 << 20
BLOCK = 512
# Leading coordinates that order the rows, and those that bound the boxes.
ORDERING = 4
BOXED = 8
# Bits of each ordering coordinate.
BITS = 12
# Distance from the threshold within which the plain formula decides.
NEAR = 1e-9


class Axes:
    """Mean and principal axes (columns) for one vector length; other lengths keep theirs."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, spread: np.ndarray):
        self.mean, self.axes, self.spread = mean, axes, spread

    @classmethod
    def plain(cls, d: int) -> Axes:
        return cls(np.zeros(d), np.eye(d), np.full(d, d**-0.5))

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates of the centred unit vectors, and what centring takes off a cosine."""
        units = x / np.sqrt((x * x).sum(axis=1))[:, None]
        return (units - self.mean) @ self.axes, units @ self.mean - self.mean @ self.mean / 2


def _usable(rows: DataFrame) -> DataFrame:
    return rows.filter(
        "vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0 "
        "AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity')) "
        "AND exists(v, c -> c <> 0)"
    )


def fit_axes(reps: DataFrame, d: int) -> Axes:
    """Principal axes of the unit vectors of length ``d``: tasks add up moments, Spark sums them."""
    schema = T._parse_datatype_string("i int, moments array<double>")
    kind = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                units = np.column_stack((x / np.sqrt((x * x).sum(axis=1))[:, None], np.ones(len(x))))
                total += units.T @ units
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 1), kind[0].type), pa.array(total.tolist(), kind[1].type)], ["i", "moments"]
        )

    parts = reps.filter(F.col("d") == d).select("v").mapInArrow(run, schema)
    sums = parts.select("i", F.posexplode("moments").alias("j", "m")).groupBy("i", "j").agg(F.sum("m").alias("m"))
    total = np.zeros((d + 1, d + 1))
    for row in sums.toLocalIterator():
        total[row["i"], row["j"]] = row["m"]
    n = max(total[d, d], 1.0)
    mean = total[d, :d] / n
    values, axes = np.linalg.eigh(total[:d, :d] / n - np.outer(mean, mean))
    return Axes(mean, axes[:, ::-1].copy(), np.sqrt(np.maximum(values[::-1], 1e-12)))


def leading(c: np.ndarray) -> np.ndarray:
    """What bounds a distance from below: leading coordinates and the length of the rest."""
    rest = np.sqrt((c[:, BOXED:] ** 2).sum(axis=1))
    return np.column_stack((c[:, :BOXED], rest))


def interleaved(c: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Position along the curve that interleaves the bits of the leading coordinates."""
    k = min(ORDERING, c.shape[1])
    # A logistic curve of the standard score fills the cells about evenly.
    cells = ((1 << BITS) / (1 + np.exp(-1.7 * np.clip(c[:, :k] / spread[:k], -20, 20)))).astype(np.int64)
    out = np.zeros(len(c), np.int64)
    for bit in reversed(range(BITS)):
        for j in range(k):
            out = out << 1 | (cells[:, j] >> bit & 1)
    return out


def _placed(reps: DataFrame, d: int, axes: Axes) -> DataFrame:
    """``label, least, copies, v, d`` with the place on the curve and the leading coordinates."""

    def setup():
        def work(v: pa.Array) -> list[dict]:
            out = []
            vectors = [np.asarray(x, np.float64) for x in v.to_numpy(zero_copy_only=False)]
            made: list = [None] * len(vectors)
            for length in {len(x) for x in vectors}:
                at = [i for i, x in enumerate(vectors) if len(x) == length]
                own = axes if length == d else Axes.plain(length)
                c, _ = own.turned(np.stack([vectors[i] for i in at]))
                for i, place, lead in zip(at, interleaved(c, own.spread).tolist(), leading(c).tolist()):
                    made[i] = {"place": place, "lead": lead}
            out.extend(made)
            return out

        return work

    done = map_rows(reps, reps.columns, [F.col("v")], "place long, lead array<double>", setup)
    return done.select("row.*", "result.*")


def _tiled(placed: DataFrame, n: int, tile_rows: int) -> DataFrame:
    """Rows with ``node`` (unique, in order) and ``tile``: its first node; stored once.

    Ranks come from the sorted partitions and the counts of each label in them, so no label
    is gathered in one task.
    """
    spark = placed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * tile_rows)))
    ordered = (
        placed.repartitionByRange(parts, "label", "d", "place", F.xxhash64("v"))
        .sortWithinPartitions("label", "d", "place", F.xxhash64("v"))
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("part", F.expr("node >> 33"))
        .checkpoint()
    )
    counts = ordered.groupBy("label", "d", "part").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("label", "d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = ordered.join(base, ["label", "d", "part"]).withColumn(
        "slot", F.floor((F.col("base") + F.col("node") - F.col("first")) / F.lit(tile_rows))
    )
    return ranked.drop("part", "first", "base")


def _tile_pairs(tiles: DataFrame, radius: float) -> DataFrame:
    """``label, d, a, b``: pairs of tiles of one label whose boxes are within ``radius``."""
    a = tiles.select("label", "d", F.col("slot").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    b = tiles.select("label", "d", F.col("slot").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    gap = F.expr(
        "aggregate(sequence(0, size(a_low) - 1), 0D, (s, i) -> s + "
        "pow(greatest(a_low[i] - b_high[i], b_low[i] - a_high[i], 0D), 2))"
    )
    return a.join(b, ["label", "d"]).filter((F.col("a") <= F.col("b")) & (gap <= radius * radius + NEAR)).select("label", "d", "a", "b")


class Forest:
    """Union-find over the rows of a tile pair; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            # One link for each tree on either side; what it leaves open comes again.
            at = np.unique(np.concatenate((np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1])))
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            for k in at.tolist():
                x, y = find(int(a[k])), find(int(b[k]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    self.links.append((int(i[k]), int(j[k])))
            moved = np.arange(len(self.root))
            for x in up:
                moved[x] = find(x)
            self.root = moved[self.root]


class Tile:
    """Rows of one tile, turned, with what the bounds need."""

    def __init__(self, x: np.ndarray, axes: Axes):
        self.x = x
        self.c, self.offset = axes.turned(x)
        d = self.c.shape[1]
        self.steps = [s for s in (8, 16, 32, 64, 128, 256, 512, 1024, 2048) if s < d] + [d]
        squares = np.cumsum((self.c**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {s: np.sqrt(np.maximum(squares[:, s], 0)) for s in self.steps[:-1]}
        lead = leading(self.c)
        self.edges = list(range(0, len(x), BLOCK)) + [len(x)]
        self.low = np.array([lead[a:b].min(axis=0) for a, b in zip(self.edges, self.edges[1:])])
        self.high = np.array([lead[a:b].max(axis=0) for a, b in zip(self.edges, self.edges[1:])])


def block_links(a: Tile, b: Tile, rows: slice, cols: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions of a block of two tiles, leading dimensions first."""
    score = a.offset[rows, None] + b.offset[None, cols]
    start, pairs = 0, None
    for step in a.steps:
        if pairs is None:
            score = score + a.c[rows, start:step] @ b.c[cols, start:step].T
        else:
            score = score + np.einsum("ij,ij->i", a.c[pairs[0], start:step], b.c[pairs[1], start:step])
        if step == a.steps[-1]:
            break
        left, right = a.rest[step], b.rest[step]
        if pairs is None:
            alive = score + left[rows, None] * right[None, cols] >= threshold - NEAR
            count = np.count_nonzero(alive)
            if count * 16 < alive.size:
                i, j = np.nonzero(alive)
                score, pairs = score[i, j], (i + rows.start, j + cols.start)
        else:
            alive = score + left[pairs[0]] * right[pairs[1]] >= threshold - NEAR
            score, pairs = score[alive], (pairs[0][alive], pairs[1][alive])
        if pairs is not None and not len(pairs[0]):
            return pairs
        start = step
    if pairs is None:
        i, j = np.nonzero(score >= threshold - NEAR)
        score, pairs = score[i, j], (i + rows.start, j + cols.start)
    close = np.flatnonzero(np.abs(score - threshold) <= NEAR)
    if len(close):
        x, y = a.x[pairs[0][close]], b.x[pairs[1][close]]
        score[close] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    keep = score >= threshold
    return pairs[0][keep], pairs[1][keep]


def tile_links(a: Tile, b: Tile | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions of two tiles, or within one, block by block."""
    same = b is None
    b = a if same else b
    radius = 2 - 2 * threshold + NEAR
    for p, (r0, r1) in enumerate(zip(a.edges, a.edges[1:])):
        first = p if same else 0
        gaps = np.maximum(np.maximum(a.low[p] - b.high[first:], b.low[first:] - a.high[p]), 0)
        for q in np.flatnonzero((gaps * gaps).sum(axis=1) <= radius) + first:
            i, j = block_links(a, b, slice(r0, r1), slice(b.edges[q], b.edges[q + 1]), threshold)
            if same and p == q:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _compare(shipped: DataFrame, d: int, axes: Axes, threshold: float) -> DataFrame:
    """``node, other, links``: counts of links (other null), and the forest (links 0)."""

    def work(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[dict]:
        for part in parts:
            edges = starts_of(part["a"], part["b"], part["group"])
            for lo, hi in zip(edges[:-1], edges[1:]):
                side, node, copies = part["side"][lo:hi], part["node"][lo:hi], part["copies"][lo:hi]
                x = np.stack(part["v"][lo:hi])
                own = axes if x.shape[1] == d else Axes.plain(x.shape[1])
                cut = int(np.searchsorted(side, 1))
                second = Tile(x[cut:], own) if cut < len(x) else None
                shift = cut if second else 0
                forest, counts = Forest(len(x)), np.zeros(len(x), np.int64)
                for i, j in tile_links(Tile(x[:cut], own), second, threshold):
                    j = j + shift
                    np.add.at(counts, i, copies[j])
                    np.add.at(counts, j, copies[i])
                    forest.add(i, j)
                hit = np.flatnonzero(counts)
                yield {
                    "node": node[hit].tolist() + [int(node[i]) for i, _ in forest.links],
                    "other": [None] * len(hit) + [int(node[j]) for _, j in forest.links],
                    "links": counts[hit].tolist() + [0] * len(forest.links),
                }

    return stream_groups(shipped, ["group", "a", "b"], ["side", "node"], "node long, other long, links long", work)


def linked(reps: DataFrame, threshold: float = THRESHOLD, tile_rows: int | None = None) -> DataFrame:
    """``label, v, copies, others, component_id`` of the representatives (``label, d, v, least, copies``).

    ``others`` counts the rows of other vectors linked directly; ``component_id`` is the
    smallest id reachable.
    """
    sizes = reps.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    n = reps.count() if sizes else 0
    axes = fit_axes(reps, d) if sizes else Axes.plain(1)
    widest = (reps.agg(F.max("d").alias("d")).first()["d"] or 1) if sizes else 1
    tile_rows = tile_rows or max(64, min(TILE_ROWS, TILE_BYTES // (8 * widest)))
    rows = _tiled(_placed(reps, d, axes), n, tile_rows)
    ends = [F.array(*[f(F.get("lead", F.lit(i))) for i in range(min(BOXED, widest) + 1)]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    tiles = rows.groupBy("label", "d", "slot").agg(*ends).select(
        "label", "d", "slot", *[F.expr(f"filter({c}, x -> x IS NOT NULL)").alias(c) for c in ("low", "high")]
    )
    pairs = _tile_pairs(tiles, (2 - 2 * threshold) ** 0.5).withColumn("group", F.xxhash64("label", "d"))
    sides = pairs.select("*", F.col("a").alias("slot"), F.lit(0).alias("side")).unionByName(
        pairs.filter("a < b").select("*", F.col("b").alias("slot"), F.lit(1).alias("side"))
    )
    shipped = rows.join(sides, ["label", "d", "slot"]).select("group", "a", "b", "side", "node", "copies", "v")
    found = _compare(shipped, d, axes, threshold).checkpoint()
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("others"))
    components = connected(found.filter("other IS NOT NULL").select("node", "other"), "node", "other")
    known = (
        rows.select("label", "v", "node", "least", "copies")
        .join(counts, "node", "left")
        .join(components, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    return known.join(names, "component").select(
        "label", "v", "copies", F.coalesce("others", F.lit(0)).alias("others"), "component_id"
    )


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    tile_rows: int | None = None,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector."""
    use_checkpoints(vectors.sparkSession)
    rows = vectors.select(
        column(vec_id).alias("vec_id"),
        column(label).alias("label"),
        # Adding zero makes -0.0 and 0.0 one value, as equal vectors must have equal bits.
        F.transform(column(embedding).cast("array<double>"), lambda c: c + F.lit(0.0)).alias("v"),
    )
    reps = _usable(rows).groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    reps = reps.withColumn("d", F.size("v")).checkpoint()
    told = linked(reps, threshold, tile_rows).filter("copies > 1 OR others > 0")
    keyed = rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("label"))).withColumn("h", F.xxhash64("v"))
    told = told.select(F.col("label").alias("key"), F.xxhash64("v").alias("h"), "v", "copies", "others", "component_id")
    joined = keyed.join(told, ["key", "h", "v"], "left")
    return joined.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.col("others"), F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.expr("vec_id <=> coalesce(component_id, vec_id)").alias("kept"),
    )
