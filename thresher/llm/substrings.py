"""Removal of word sequences that occur earlier in the corpus: seed and extend.

Seeds: every window of ``window`` words has one anchor, the least hash among its runs
of ``seed`` words (winnowing). Equal windows have equal anchors, so only windows whose
anchor occurs twice in the corpus can repeat. Extension: those windows, which reach to
both sides of the anchor, are compared by 96-bit fingerprints, and the union of the ones
that occur earlier gives the maximal repeats of at least ``window`` words.

Two shuffles carry hashes and one carries texts (both text joins read the same
exchange). Before each hash shuffle a batch of documents keeps one row per hash and
settles its own repeats, so a passage that a third of the corpus shares costs a row per
batch, not a row per document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thresher.llm.words import (WordHashes, mix, rolling, slices, sliding_min, split_words,
                                starts_inside)

WINDOW = 20
SEED = 10
BATCH_BYTES = 8 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MISSING_ID = (1 << 63) - 1          # a null id comes after all others
LOW = np.uint64(0xFFFFFFFF)
HIGH = np.uint64(32)

ROWS = "f long, g long, doc long, packed binary"
RESULT = "doc long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"


def _rows(f: np.ndarray, g: np.ndarray, doc: np.ndarray,
          packed: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of single hashes, then of documents with ``packed`` values settled already."""
    names = ["f", "g", "doc", "packed"]
    for at in range(0, len(f), 1 << 17):
        part = slice(at, at + (1 << 17))
        yield pa.RecordBatch.from_arrays(
            [pa.array(f[part].view(np.int64)), pa.array(g[part].view(np.int64)),
             pa.array(doc[part]), pa.nulls(len(f[part]), pa.binary())], names=names)
    if packed:
        docs = np.array([d for d, _ in packed], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(mix(docs.view(np.uint64) + np.uint64(1)).view(np.int64)),
             pa.array(np.zeros(len(docs), np.int64)), pa.array(docs),
             pa.array([p for _, p in packed], pa.binary())], names=names)


def _packed(doc: np.ndarray, values: np.ndarray) -> list[tuple[int, bytes]]:
    """Per document its values as bytes."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    return [(int(doc[a]), values[a:b].tobytes())
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(doc)))] if len(doc) else []


def _unpacked(blobs: Iterable[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(blobs or ()), np.uint64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


class Windows:
    """Anchors and fingerprints of all windows of a batch of texts."""

    def __init__(self, texts: list[bytes], cache: WordHashes, window: int, seed: int) -> None:
        self.words, hashes, self.ends = split_words(texts, cache)
        self.begins = np.append(0, self.ends[:-1]) if len(self.ends) else self.ends
        self.text, self.at = starts_inside(self.ends, window)
        self.hashes, self.window, self.seed = hashes, window, seed

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of each window, and its place among all words."""
        if not len(self.at):
            return np.empty(0, np.uint64), self.at
        values, places = sliding_min(rolling(self.hashes, self.seed, BASES[0]),
                                     self.window - self.seed + 1)
        return values[self.at], places[self.at]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """64 bits, and 32 bits above the window's start in its text."""
        if not len(self.at):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        f = rolling(self.hashes, self.window, BASES[0])[self.at]
        g = rolling(mix(self.hashes), self.window, BASES[1])[self.at]
        start = (self.at - self.begins[self.text]).astype(np.uint64)
        return f, (g & ~LOW) | start


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Each document without the words of windows that start earlier in the corpus.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D. Earlier means a smaller id,
    or the same id and an earlier start; windows are judged on the input. One row per input
    row: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one
    space) and ``removed`` (spans of words, end not included).

    Null and empty texts have no words and an empty ``kept``. Texts shorter than the window
    lose nothing. Rows that repeat an id at the same start are not earlier than each other,
    so equal rows are treated alike. A null id comes after all others. An empty table gives
    no rows; other columns are ignored. Texts of any length are read whole.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MISSING_ID)).alias("doc"),
                       F.col(text_col).cast("string").alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, most=BATCH_BYTES):
            found = Windows(_texts(batch), cache, window, seed)
            (hashes, places), doc = found.anchors(), batch.column("doc").to_numpy()[found.text]
            fresh = np.append(True, np.diff(places) != 0)[:len(hashes)]
            hashes, doc = hashes[fresh], doc[fresh]
            unique, first, inverse, count = np.unique(
                hashes, return_index=True, return_inverse=True, return_counts=True)
            repeated = count[inverse] > 1
            yield from _rows(unique, np.zeros_like(unique), doc[first],
                             _packed(doc[repeated], hashes[repeated]))

    def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, _, doc, packed = _gathered(batches)
        order = np.argsort(f, kind="stable")
        f, doc = f[order], doc[order]
        same = f[1:] == f[:-1]
        twice = np.append(False, same) | np.append(same, False)
        twice = twice[:len(f)]
        yield from _settled(packed, doc[twice], f[twice])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, most=BATCH_BYTES):
            found = Windows(_texts(batch), cache, window, seed)
            hashes, _ = found.anchors()
            known = [np.unique(_unpacked(x)) for x in batch.column("settled").to_pylist()]
            sizes = np.searchsorted(found.text, np.arange(batch.num_rows + 1))
            wanted = np.zeros(len(hashes), bool)
            for i, repeated in enumerate(known):
                if len(repeated):
                    own = hashes[sizes[i]:sizes[i + 1]]
                    spot = np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)
                    wanted[sizes[i]:sizes[i + 1]] = repeated[spot] == own
            f, g = found.fingerprints()
            doc = batch.column("doc").to_numpy()[found.text]
            *first, later, marks = _first_of_each(f[wanted], g[wanted], doc[wanted])
            yield from _rows(*first, _packed(later, marks))

    def repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, g, doc, packed = _gathered(batches)
        *_, doc, marks = _first_of_each(f, g, doc)
        yield from _settled(packed, doc, marks)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, most=BATCH_BYTES):
            found = Windows(_texts(batch), cache, window, seed)
            f, g = found.fingerprints()
            sizes = np.searchsorted(found.text, np.arange(batch.num_rows + 1))
            counts, kept, spans = [], [], []
            for i, blobs in enumerate(batch.column("settled").to_pylist()):
                words = found.words[i]
                edges = np.zeros(len(words) + 1, np.int64)
                if blobs:
                    own = _marks(f[sizes[i]:sizes[i + 1]], g[sizes[i]:sizes[i + 1]])
                    start = np.flatnonzero(np.isin(own, _unpacked(blobs)))
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + window, -1)
                gone = np.cumsum(edges[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                spans.append([{"start": a, "end": b} for a, b in
                              zip(turns[::2].tolist(), turns[1::2].tolist())])
                counts.append((len(words), int(gone.sum())))
                kept.append(b" ".join(compress(words, ~gone) if counts[-1][1] else words))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array([n for n, _ in counts], pa.int64()),
                pa.array([n for _, n in counts], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc", "n_words", "n_removed", "kept", "removed"])

    def with_settled(settled: DataFrame) -> DataFrame:
        lists = settled.groupBy("doc").agg(F.collect_list("packed").alias("settled"))
        return rows.join(lists.hint("shuffle_hash"), "doc", "left")

    settled = "doc long, packed binary"
    seeds = rows.mapInArrow(anchors, ROWS).repartition("f").mapInArrow(repeated_anchors, settled)
    later = (with_settled(seeds).where("settled is not null").mapInArrow(candidates, ROWS)
             .repartition("f").mapInArrow(repeated_windows, settled))
    result = with_settled(later).mapInArrow(without, RESULT)
    return result.select(F.when(F.col("doc") != MISSING_ID, F.col("doc")).alias("doc_id"),
                         "n_words", "n_removed", "kept", "removed")


def _gathered(batches: Iterator[pa.RecordBatch]
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """All rows of a partition: hashes as arrays, and what was settled before."""
    f, g, doc, packed = [], [], [], []
    for batch in batches:
        blobs = batch.column("packed")
        single = blobs.is_null().to_numpy(zero_copy_only=False)
        for column, into in (("f", f), ("g", g), ("doc", doc)):
            into.append(batch.column(column).to_numpy()[single])
        done = pa.array(~single)
        packed += zip(batch.column("doc").filter(done).to_pylist(), blobs.filter(done).to_pylist())
    join = lambda parts: np.concatenate(parts or [np.empty(0, np.int64)])
    return join(f).view(np.uint64), join(g).view(np.uint64), join(doc), packed


def _settled(packed: list[tuple[int, bytes]], doc: np.ndarray, values: np.ndarray
             ) -> Iterator[pa.RecordBatch]:
    """What was settled before, and a row for each value found here."""
    for at in range(0, len(packed), 10_000):
        part = packed[at:at + 10_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in part], pa.int64()), pa.array([b for _, b in part], pa.binary())],
            names=["doc", "packed"])
    for at in range(0, len(doc), 1 << 17):
        part = values[at:at + (1 << 17)]
        ends = np.arange(len(part) + 1, dtype=np.int32) * 8
        blobs = pa.Array.from_buffers(pa.binary(), len(part),
                                      [None, pa.py_buffer(ends), pa.py_buffer(part.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(doc[at:at + (1 << 17)]), blobs], names=["doc", "packed"])


def _marks(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A window's start with 32 bits of its fingerprint, which tell apart texts of one id."""
    return (f & ~LOW) | (g & LOW)


def _first_of_each(f: np.ndarray, g: np.ndarray, doc: np.ndarray
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The earliest row of each fingerprint; documents and marks of the others."""
    order = np.lexsort((g & LOW, doc, g >> HIGH, f))
    f, g, doc = f[order], g[order], doc[order]
    new = np.append(True, (f[1:] != f[:-1]) | ((g[1:] ^ g[:-1]) > LOW))[:len(f)]
    leader = np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))
    # a row that repeats both id and start is not later than the first
    level = ~new & (doc == doc[leader]) & (((g ^ g[leader]) & LOW) == 0)
    later = ~(new | level)
    return f[new], g[new], doc[new], doc[later], _marks(f[later], g[later])
