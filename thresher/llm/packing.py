"""Packing documents into token sequences of one length with almost no padding.

First-fit decreasing over the bins of a tournament tree, run on its own in
randomised groups of documents. A group is a few megabytes of text, so one task
holds it whatever the size of the corpus or of its sources.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thresher.llm.words import slices

LENGTH = 2048
END_ID = 1
GROUP_BYTES = 4 << 20
CACHED_WORDS = 300_000      # bounds what a Python worker holds between its tasks, in whatever operator
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a file, read once in a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class _Numbering(dict):
    """Keys -> consecutive numbers; ``new`` lists the keys not yet handled."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number


class WordTokenizer:
    """Ids of whole texts, with each distinct word given to the tokenizer once.

    Exact for tokenizers that lower-case, drop white space and cut letters from symbols:
    no token spans white space or the place where a word's closing symbols begin, so the
    ids of a text are those of its words, and the ids of a word those of its two units.
    """

    # A fixed value: symbols that close words. The apostrophe opens contractions and
    # "<|>" spell special tokens, so neither is here.
    CLOSING = b".,!%$#&*;:"

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        (self.mark,) = self._ids("\x01")
        self._forget()

    def _forget(self) -> None:
        self.words, self.units = _Numbering(), _Numbering()
        self.word_units = np.empty((0, 2), np.int64)
        self.counts = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.used = np.empty(0, np.int64)       # how often each word was met

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids,
                        np.uint32)

    def _learn(self) -> None:
        """Units of the words met for the first time, and the ids of new units."""
        pairs = []
        for word in self.words.new:
            stem = word.rstrip(self.CLOSING)
            if not (stem and stem.isascii() and stem[-1:].isalnum()):
                stem = word
            closing = word[len(stem):]
            if stem.isascii() and b"<" not in stem:
                stem = stem.lower()
            pairs.append((self.units[stem], self.units[closing]))
        self.words.new = []
        self.word_units = np.concatenate(
            [self.word_units, np.array(pairs, np.int64).reshape(-1, 2)])
        new, self.units.new = self.units.new, []
        counts, ids = [self.counts], [self.ids]
        for at in range(0, len(new), 2000):
            part = new[at:at + 2000]
            text = b" \x01 ".join(part)
            if text.count(b"\x01") == len(part) - 1:
                found = self._ids(text.decode())
                marks = np.append(np.flatnonzero(found == self.mark), len(found))
                counts.append(np.diff(marks, prepend=-1) - 1)
                ids.append(found[found != self.mark])
            else:                                       # a text holds the mark itself
                each = [self._ids(unit.decode()) for unit in part]
                counts.append(np.array([len(found) for found in each]))
                ids += each
        self.counts, self.ids = np.concatenate(counts), np.concatenate(ids)
        self.starts = np.cumsum(self.counts) - self.counts

    def _forget_rare(self) -> None:
        """Keeps words met more than once, half of ``CACHED_WORDS`` at most, with the ids they have."""
        again = np.flatnonzero(self.used > 1)
        kept = np.sort(again[np.argsort(-self.used[again], kind="stable")[:CACHED_WORDS // 2]])
        units, place = np.unique(self.word_units[kept], return_inverse=True)
        words, parts = list(self.words), list(self.units)
        found = [self.ids[at:at + n] for at, n in zip(self.starts[units], self.counts[units])]
        counts = self.counts[units]
        self._forget()
        self.words.update((words[old], new) for new, old in enumerate(kept.tolist()))
        self.units.update((parts[old], new) for new, old in enumerate(units.tolist()))
        self.word_units, self.counts = place.reshape(-1, 2), counts
        self.ids = np.concatenate([self.ids, *found])
        self.starts = np.cumsum(counts) - counts
        self.used = np.zeros(len(kept), np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.words) > CACHED_WORDS:
            self._forget_rare()
        split = [text.split() for text in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(split)),
                            np.int64, sizes.sum())
        if self.words.new:
            self._learn()
        self.used = np.append(self.used, np.zeros(len(self.words) - len(self.used), np.int64))
        self.used += np.bincount(words, minlength=len(self.used))
        if not len(words):
            return [np.empty(0, np.uint32) for _ in texts]
        units = self.word_units[words].ravel()
        counts = self.counts[units]
        ends = np.cumsum(counts)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[units] - ends + counts, counts)]
        return np.split(ids, np.append(0, ends)[2 * np.cumsum(sizes)[:-1]])


@functools.lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with the words it has met, for all tasks of a Python worker."""
    return WordTokenizer(path)


class Tournament:
    """Bins by position; each inner node holds the largest capacity left below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, which is taken from it."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``sizes``, which is in descending order."""
    if not sizes:
        return []
    tree = Tournament(len(sizes), capacity)
    bins: list[list[int]] = []
    for i, size in enumerate(sizes):
        at = tree.place(size)
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack(lengths: list[int], capacity: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token once.

    Whole stretches of ``capacity`` tokens are sequences of their own. The rests go
    through first-fit decreasing. Then the emptiest bins are taken apart to fill the
    gaps of the others, and the one bin that may stay short is cut into lengths that
    are powers of two, which need no padding.
    """
    done = [[(d, at, capacity)] for d, n in enumerate(lengths)
            for at in range(0, n - n % capacity, capacity)]
    order = sorted((d for d, n in enumerate(lengths) if n % capacity),
                   key=lambda d: (-(lengths[d] % capacity), d))
    bins = [[(order[i], lengths[order[i]] - lengths[order[i]] % capacity,
              lengths[order[i]] % capacity) for i in found]
            for found in first_fit_decreasing([lengths[d] % capacity for d in order], capacity)]
    fill = [sum(piece[2] for piece in found) for found in bins]
    ranked = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    first, last = 0, len(ranked) - 1
    while first < last:
        into, out = ranked[first], ranked[last]
        gap = capacity - fill[into]
        if not gap:
            first += 1
            continue
        if not bins[out]:
            last -= 1
            continue
        doc, start, n = bins[out].pop()
        moved = min(gap, n)
        bins[into].append((doc, start, moved))
        if moved < n:
            bins[out].append((doc, start + moved, n - moved))
        fill[into] += moved
        fill[out] -= moved
    for found, n in zip(bins, fill):
        if n == capacity:
            done.append(found)
        elif n:
            done += _powers_of_two(found, n)
    return done


def _powers_of_two(pieces: list[tuple[int, int, int]], n: int) -> list[list[tuple[int, int, int]]]:
    out, left = [], list(reversed(pieces))
    for bit in range(n.bit_length() - 1, -1, -1):
        if not n >> bit & 1:
            continue
        need, sequence = 1 << bit, []
        while need:
            doc, start, length = left.pop()
            taken = min(need, length)
            sequence.append((doc, start, taken))
            if taken < length:
                left.append((doc, start + taken, length - taken))
            need -= taken
        out.append(sequence)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", length: int = LENGTH, end_id: int = END_ID,
                   group_bytes: int = GROUP_BYTES, seed: int = 20) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens.

    One row per piece: ``doc_id``, ``start`` (tokens of the document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset`` there. A document is its ids and ``end_id``.

    Null and empty texts are the one id ``end_id``. Repeated rows are documents of
    their own; a null id is kept. A very long text is cut into full sequences. An empty
    table gives no rows. Other columns are ignored. Each group leaves at most one bin
    that is not full, which becomes sequences of powers of two; nothing is padded.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_tokenizer(tokenizer_path)
        held: dict[int, list[tuple[int | None, np.ndarray]]] = {}
        for batch in slices(batches, most=1 << 20):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for doc, group, ids in zip(batch.column("doc_id").to_pylist(),
                                       batch.column("group").to_pylist(), words.encode(texts)):
                held.setdefault(group, []).append((doc, np.append(ids, np.uint32(end_id))))
        for group in sorted(held):
            # the order rows arrive in may differ between attempts of a task
            docs_in = sorted(held.pop(group), key=lambda d: (d[0] is None, d[0] or 0, d[1].tobytes()))
            pieces = [(d, start, n, (group << 32) + s, offset)
                      for s, sequence in enumerate(pack([len(ids) for _, ids in docs_in], length))
                      for (d, start, n), offset in zip(
                          sequence, itertools.accumulate((p[2] for p in sequence), initial=0))]
            for at in range(0, len(pieces), 4096):
                part = pieces[at:at + 4096]
                yield pa.RecordBatch.from_arrays([
                    pa.array([docs_in[d][0] for d, *_ in part], pa.int64()),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([docs_in[d][1][start:start + n].astype("<u4").tobytes()
                              for d, start, n, *_ in part], pa.binary()),
                    pa.array([len(docs_in[d][1]) for d, *_ in part], pa.int64()),
                    pa.array([p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(groups))
    return (rows.withColumn("group", group).repartition(groups, "group")
            .mapInArrow(run, SCHEMA))
