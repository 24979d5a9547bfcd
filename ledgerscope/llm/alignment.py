"""Cross-tokenizer alignment by inverted bitmaps of token pairs.

Each text is encoded by two tokenizers: A (byte-level) and B (pieces with byte fallback).
Token bytes give end offsets on one axis; where both end, a group closes.  Between two
neighbouring ends lies exactly one overlapping pair of an A and a B token: a link.

Documents are numbered within containers of bounded size.  For each pair of ids and each
container, plane ``k`` is the compressed bitmap of the documents whose number of links of
that pair has bit ``k`` set: positions as 16 bits each, or one bit a document once that is
shorter.  OR over the planes gives the pair's documents, whose popcount is its document
count; the popcounts of the planes, each worth ``2 ** k``, give its link count.  Counts are
added up by pair (one row a container), the highest count of each B id is found, and the
postings take both back: each container adds the scores of its pairs to its documents.

Texts are encoded once.  Neither a document's links nor a pair's documents are ever in one
place: a task holds one container (``CONTAINER_DOCS`` documents, or about
``CONTAINER_POSTINGS`` postings), and a pair in every document is one row a container.

Defined results: null and empty texts, and texts whose joined token bytes differ from the
space and the text, have no tokens: zeros and an empty ``groups_sha256``.  Strings of
special tokens inside a text are plain text.  Rows may repeat an id or a text: each counts.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.bpe import byte_symbols
from ledgerscope.llm.components import use_checkpoints
from ledgerscope.llm.frames import arrow_type, column, slices, small_batches, starts_of, stream_groups

CONTAINER_DOCS = 4096
CONTAINER_POSTINGS = 1_000_000
# From this many documents on, a bitmap of the container is no longer than their positions.
DENSE = CONTAINER_DOCS // 16
# Bits of a token id in a pair, and of a document within a batch.
ID_BITS, DOC_BITS = 22, 19
# The word pattern of byte-level pre-tokenizers, and the texts that both
# libraries surely split alike (long assigned letters, digits, marks and white space).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SETTLED = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u0233\u2010-\u2027\u20ac]*")
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def read(path: str) -> bytes:
    """A tokenizer file, read by the driver and sent along with the job (a few MB)."""
    with open(path, "rb") as file:
        return file.read()


class Sides:
    """Both tokenizers and the bytes of their tokens, in one worker."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        spec = json.loads(byte_level)
        self.bytes_a = self._byte_level(spec)
        self.fast = self._by_ranks(spec)
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if max(len(self.bytes_a), len(self.bytes_b)) >= 1 << ID_BITS:
            raise ValueError(f"token ids need more than {ID_BITS} bits")
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # The text of each id with what may follow it in the digest.
        self.text_a = {end: np.array([f"{i}{end}" for i in range(len(self.bytes_a))], object) for end in ",|"}
        self.text_b = {end: np.array([f"{i}{end}" for i in range(len(self.bytes_b))], object) for end in ",;"}

    @staticmethod
    def _byte_level(spec: dict) -> list[bytes]:
        symbols = {s: b for b, s in enumerate(byte_symbols())}
        entries = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        out = [b""] * (max(entries.values()) + 1)
        for text, i in entries.items():
            known = all(c in symbols for c in text)
            out[i] = bytes(symbols[c] for c in text) if known else text.encode()
        return out

    def _by_ranks(self, spec: dict):
        """The same encoder by ranks, four times as fast; None if ids do not follow the merges."""
        import tiktoken

        vocab, words = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        usual = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
        ranked = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        if not (usual and ranked and spec["normalizer"] is None):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("A", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of A, by ranks where a text is sure to be split alike."""
        out: list[list[int]] = [[]] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.fast is not None and _SETTLED.fullmatch(text):
                out[i] = self.fast.encode_ordinary(text)
            else:
                rest.append(i)
        if rest:
            for i, made in zip(rest, self.a.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = made.ids
        return out

    @staticmethod
    def _piece(piece: str) -> bytes:
        found = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B of each text; none where the bytes do not come back."""
        full = [i for i, t in enumerate(texts) if t]
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        if not full:
            return out
        encoded = self.encode_a([" " + texts[i] for i in full])
        pieces = self.b.encode([texts[i] for i in full], num_threads=1)
        for i, a, b in zip(full, encoded, pieces):
            want = b" " + texts[i].encode()
            if b"".join([self.bytes_a[t] for t in a]) == want and b"".join([self.bytes_b[t] for t in b]) == want:
                out[i] = (a, b)
        return out


@dataclass
class Aligned:
    """A batch of texts on one axis of bytes; arrays are per text or per link."""

    counts: dict[str, np.ndarray]
    digests: list[str]
    pair: np.ndarray  # links, in order
    doc: np.ndarray


def align(sides: Sides, tokens: list[tuple[list[int], list[int]]]) -> Aligned:
    """Groups and links of a batch."""
    n_a = np.array([len(a) for a, _ in tokens], np.int64)
    n_b = np.array([len(b) for _, b in tokens], np.int64)
    a = np.concatenate([np.array(x, np.int64) for x, _ in tokens] + [np.zeros(0, np.int64)])
    b = np.concatenate([np.array(x, np.int64) for _, x in tokens] + [np.zeros(0, np.int64)])
    end_a, end_b = np.cumsum(sides.length_a[a]), np.cumsum(sides.length_b[b])
    ends = np.concatenate((end_a, end_b))
    ends.sort(kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    # A token ends where its end offset is; the tokens over a stretch are those not ended yet.
    ends_a, ends_b = np.zeros(len(ends), bool), np.zeros(len(ends), bool)
    ends_a[np.searchsorted(ends, end_a)] = True
    ends_b[np.searchsorted(ends, end_b)] = True
    over_a, over_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    pair = a[over_a] << ID_BITS | b[over_b]
    doc = np.repeat(np.arange(len(tokens)), n_a)[over_a]
    both = ends_a & ends_b
    counts = {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.bincount(doc[both], minlength=len(tokens)),
        "n_links": np.bincount(doc, minlength=len(tokens)),
    }
    return Aligned(counts, _digests(sides, a, b, n_a, n_b, over_a[both], over_b[both]), pair, doc)


def _digests(sides, a, b, n_a, n_b, last_a, last_b) -> list[str]:
    """Digest of ``a1,a2|b1;a3|b2,b3`` of each text; ``last_a``, ``last_b`` end each group."""
    ending_a, ending_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    ending_a[last_a], ending_b[last_b] = True, True
    # Within a group all A ids come first: an A id follows the B ids of earlier groups, a B
    # id all A ids up to its own group.
    group_a, group_b = np.cumsum(ending_a) - ending_a, np.cumsum(ending_b) - ending_b
    b_before, a_through = np.append(0, last_b + 1), np.append(last_a + 1, 0)
    parts = np.empty(len(a) + len(b), object)
    parts[np.arange(len(a)) + b_before[group_a]] = np.where(ending_a, sides.text_a["|"][a], sides.text_a[","][a])
    parts[np.arange(len(b)) + a_through[group_b]] = np.where(ending_b, sides.text_b[";"][b], sides.text_b[","][b])
    pieces, out, start = parts.tolist(), [], 0
    for size in (n_a + n_b).tolist():
        text = "".join(pieces[start : start + size])[:-1]
        out.append(hashlib.sha256(text.encode()).hexdigest() if size else "")
        start += size
    return out


def packed(positions: np.ndarray) -> bytes:
    """A compressed bitmap: ascending positions, or bits where those are not longer."""
    if len(positions) < DENSE:
        return positions.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER_DOCS // 8, np.uint8)
    np.bitwise_or.at(bits, positions >> 3, np.uint8(1) << (positions & 7).astype(np.uint8))
    return bits.tobytes()


def unpacked(bitmap: bytes) -> np.ndarray:
    if len(bitmap) < CONTAINER_DOCS // 8:
        return np.frombuffer(bitmap, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))


def merged(bitmaps: list[bytes]) -> bytes:
    """OR of compressed bitmaps."""
    if len(bitmaps) == 1:
        return bitmaps[0]
    bits = np.zeros(CONTAINER_DOCS // 8, np.uint8)
    for bitmap in bitmaps:
        at = unpacked(bitmap)
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return packed(np.flatnonzero(np.unpackbits(bits, bitorder="little")))


def popcount(bitmap: bytes) -> int:
    return len(bitmap) // 2 if len(bitmap) < CONTAINER_DOCS // 8 else int.from_bytes(bitmap, "little").bit_count()


class Container:
    """Postings of up to ``CONTAINER_DOCS`` documents, by pair and plane once closed."""

    def __init__(self):
        self.docs = 0
        self.held = 0
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, aligned: Aligned, low: np.ndarray) -> None:
        """Links of a batch; ``low`` numbers its texts within the container."""
        key = aligned.pair << DOC_BITS | aligned.doc
        key.sort()
        edges = starts_of(key)
        key = key[edges[:-1]]
        self._parts.append((key >> DOC_BITS, low[key & (1 << DOC_BITS) - 1], np.diff(edges)))
        self.held += len(key)

    def rows(self) -> Iterator[tuple[int, list[bytes], int, int]]:
        """``pair, planes, documents, links``."""
        if not self.held:
            return
        pair, low, times = (np.concatenate(x) for x in zip(*self._parts))
        order = np.argsort(pair, kind="stable")
        pair, low, times = pair[order], low[order], times[order]
        edges = starts_of(pair)
        # Every plane of all pairs at once, then cut at the pairs.
        cut = []
        for k in range(int(times.max()).bit_length()):
            at = np.flatnonzero(times >> k & 1)
            cut.append((low[at], np.searchsorted(at, edges).tolist()))
        top = [int(x).bit_length() for x in np.maximum.reduceat(times, edges[:-1])]
        for i, (p, planes) in enumerate(zip(pair[edges[:-1]].tolist(), top)):
            made = [packed(cut[k][0][cut[k][1][i] : cut[k][1][i + 1]]) for k in range(planes)]
            yield p, made, popcount(merged(made)), sum(popcount(x) << k for k, x in enumerate(made))


_MADE = (
    "container long, low int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pair long, planes array<binary>, docs long, links long"
)


def inverted(documents: DataFrame, byte_level: str, pieces: str, carry: list[str], text: str = "text") -> DataFrame:
    """Encode once: a row per document (``row`` set) and one per container and pair (null).

    ``byte_level`` and ``pieces`` are paths of the two tokenizer files.
    """
    small_batches(documents.sparkSession)
    files = read(byte_level), read(pieces)
    source = documents.select(F.struct(*[column(c) for c in carry]).alias("row"), column(text).alias("__text"))
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), *T._parse_datatype_string(_MADE)])
    kind = arrow_type(schema)
    names = [f.name for f in kind]

    def closed(container: int, held: Container, row_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows = list(held.rows())
        for start in range(0, len(rows), 10_000):
            part = rows[start : start + 10_000]
            made = dict(zip(("pair", "planes", "docs", "links"), zip(*part))) | {"container": [container] * len(part)}
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(part), row_type if f.name == "row" else f.type) if f.name not in made else pa.array(made[f.name], f.type) for f in kind],
                names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(*files)
        first = TaskContext.get().partitionId() << 32
        number, held, row_type = 0, Container(), kind["row"].type
        for batch in batches:
            row_type, start = batch.column("row").type, 0
            for part in slices(batch.column("__text").slice(0, batch.num_rows)) if batch.num_rows else ():
                texts = part.to_pylist()
                if held.docs + len(texts) > CONTAINER_DOCS or held.held > CONTAINER_POSTINGS:
                    yield from closed(first + number, held, row_type)
                    number, held = number + 1, Container()
                aligned = align(sides, sides.encode(texts))
                low = held.docs + np.arange(len(texts))
                held.add(aligned, low)
                held.docs += len(texts)
                made = {c: v for c, v in aligned.counts.items()} | {
                    "row": batch.column("row").slice(start, len(texts)),
                    "container": [first + number] * len(texts),
                    "low": low,
                    "groups_sha256": aligned.digests,
                }
                start += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [made[f.name] if f.name == "row" else pa.array(made[f.name], f.type) if f.name in made else pa.nulls(len(texts), f.type) for f in kind],
                    names,
                )
        yield from closed(first + number, held, row_type)

    return source.mapInArrow(run, schema)


def pair_scores(made: DataFrame) -> DataFrame:
    """``pair, n_docs, n_links, best``: corpus-wide counts; best: no pair of its B id has more.

    A B id has no more pairs than A has ids, which bounds the window.
    """
    counts = made.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"))
    of_b = Window.partitionBy(F.expr(f"pair & {(1 << ID_BITS) - 1}"))
    return counts.withColumn("best", F.col("n_links") == F.max("n_links").over(of_b))


def returned(made: DataFrame, scores: DataFrame) -> DataFrame:
    """``container, low, n_best, count_sum``: the postings add the scores of pairs to documents."""
    postings = made.filter("pair IS NOT NULL").select("container", "pair", "planes")
    scored = postings.join(scores.select("pair", "n_links", F.col("best").cast("int").alias("best")), "pair").drop("pair")

    def work(parts: Iterator[dict[str, np.ndarray]]) -> Iterator[dict]:
        for part in parts:
            edges = starts_of(part["container"])
            for lo, hi in zip(edges[:-1], edges[1:]):
                best, total = np.zeros(CONTAINER_DOCS, np.int64), np.zeros(CONTAINER_DOCS, np.int64)
                short: list[bytes] = []
                short_best: list[int] = []
                short_total: list[int] = []
                for planes, links, is_best in zip(part["planes"][lo:hi], part["n_links"][lo:hi].tolist(), part["best"][lo:hi].tolist()):
                    for k, bitmap in enumerate(planes):
                        if len(bitmap) < CONTAINER_DOCS // 8:
                            short.append(bitmap)
                            short_best.append(is_best << k)
                            short_total.append(links << k)
                        else:
                            at = unpacked(bitmap)
                            best[at] += is_best << k
                            total[at] += links << k
                sizes = np.array([len(x) // 2 for x in short], np.int64)
                at = np.frombuffer(b"".join(short), "<u2")
                np.add.at(best, at, np.repeat(np.array(short_best, np.int64), sizes))
                np.add.at(total, at, np.repeat(np.array(short_total, np.int64), sizes))
                hit = np.flatnonzero(total)
                yield {
                    "container": np.full(len(hit), part["container"][lo]),
                    "low": hit.astype(np.int32),
                    "n_best": best[hit],
                    "count_sum": total[hit],
                }

    return stream_groups(scored, ["container"], [], "container long, low int, n_best long, count_sum long", work)


def alignment(documents: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of tokens, groups and links, their scores and a digest."""
    use_checkpoints(documents.sparkSession)
    # Numbers of containers and documents must not change between the passes.
    made = inverted(documents, byte_level, pieces, [doc_id], text).checkpoint()
    back = returned(made, pair_scores(made))
    docs = made.filter("row IS NOT NULL").select(
        F.col("row").getField(doc_id).alias("doc_id"), "container", "low", *_COUNTS, "groups_sha256"
    )
    return docs.join(back, ["container", "low"], "left").select(
        "doc_id",
        *_COUNTS,
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )
