"""Benchmark decontamination by spaced seeds that tolerate substituted tokens.

Fixed masks look at two blocks of four tokens and ignore what lies between them. A
window of sixteen tokens is four blocks, so with two substitutions two blocks are whole
and one mask hits. The hashes of the benchmark go into a Bloom filter of fixed size;
training hashes that pass it are joined with the benchmark's, and every hit is verified
token by token on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thresher.llm.urls import MAX_BLOCKS, PROBES, blocked_bloom
from thresher.llm.words import CACHED_WORDS, mix, rolling, slices

import xxhash

WINDOW, BLOCK = 16, 4
GAPS = (4, 8, 12)                       # the masks: where the second block begins
BEFORE, SPAN = WINDOW // 2, 24          # tokens kept before a hit, and in all
NO_ITEM, NO_TEXT = np.uint64(0), np.uint64(1)
BASE = 0x9E3779B97F4A7C15
NOT_WORD = re.compile(r"[\W_]+")
CLOSING = b".,;:!?%$#&*)|"               # symbols that often close words


class TokenHashes(dict):
    """Word bytes -> hash of its letters and digits in lower case; 0 if it has none."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        plain = word.rstrip(CLOSING)
        if plain.isalnum():                 # letters and digits of ASCII only
            plain = plain.lower()
        else:
            plain = word.decode().lower()
            plain = plain if plain.isalnum() else NOT_WORD.sub("", plain)
        value = self[word] = xxhash.xxh3_64_intdigest(plain) | 2 if plain else 0
        return value


def allowed(tokens: int) -> int:
    """Substitutions allowed in a window: two blocks of four must stay whole."""
    return min(WINDOW, tokens) // BLOCK - 2


def token_hashes(texts: list[bytes], cache: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in a row, and where each text ends."""
    parts = []
    for text in texts:
        words = text.split()
        own = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        parts.append(own[own != 0])
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return np.concatenate(parts or [np.empty(0, np.uint64)]), ends


def seed_hashes(tokens: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask: hashes, positions and texts of all its places that stay in one text."""
    text = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    blocks = rolling(tokens, BLOCK, BASE)
    for gap in GAPS:
        n = len(tokens) - gap - BLOCK + 1
        if n <= 0:
            continue
        inside = np.flatnonzero(text[:n] == text[gap + BLOCK - 1:gap + BLOCK - 1 + n])
        hashes = mix(blocks[inside] * np.uint64(BASE) + blocks[inside + gap] + np.uint64(gap))
        yield hashes, inside, text[inside]


def surroundings(tokens: np.ndarray, ends: np.ndarray, at: np.ndarray, text: np.ndarray,
                 nothing: np.uint64) -> np.ndarray:
    """``SPAN`` tokens around each position, ``nothing`` outside its text."""
    begins = np.append(0, ends[:-1])
    spots = at[:, None] - BEFORE + np.arange(SPAN)
    inside = (spots >= begins[text][:, None]) & (spots < ends[text][:, None])
    return np.where(inside, tokens[np.clip(spots, 0, max(0, len(tokens) - 1))], nothing)


def passes(blocks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the blocked Bloom filter might hold each hash."""
    held = blocks[(hashes & np.uint64(len(blocks) - 1)).astype(np.int64)]
    found = np.ones(len(hashes), bool)
    for i in range(PROBES):
        bit = (hashes >> np.uint64(64 - 6 * (i + 1))) & np.uint64(63)
        found &= (held >> bit) & np.uint64(1) == 1
    return found


SEED_ROWS = "h long, id long, at long, size long, tokens binary"


def _seed_batch(id_name: str, batch: pa.RecordBatch, cache: TokenHashes, nothing: np.uint64,
                blocks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    tokens, ends = token_hashes([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], cache)
    sizes = np.diff(np.append(0, ends))
    begins = ends - sizes
    for hashes, at, text in seed_hashes(tokens, ends):
        wanted = sizes[text] >= 2 * BLOCK if blocks is None else passes(blocks, hashes)
        hashes, at, text = hashes[wanted], at[wanted], text[wanted]
        for start in range(0, len(at), 1 << 14):
            part = slice(start, start + (1 << 14))
            around = surroundings(tokens, ends, at[part], text[part], nothing)
            yield pa.RecordBatch.from_arrays([
                pa.array(hashes[part].view(np.int64)),
                batch.column(id_name).take(pa.array(text[part])),
                pa.array(at[part] - begins[text[part]]), pa.array(sizes[text[part]]),
                pa.array([row.tobytes() for row in around], pa.binary())],
                names=["h", "id", "at", "size", "tokens"])


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text") -> DataFrame:
    """Documents that hold a passage of a benchmark item, up to substituted tokens.

    Tokens are words cut at white space, lower-cased, with letters and digits only. A document
    and an item overlap if ``w = min(16, tokens of the item)`` tokens in a row agree on both
    sides but for ``w // 4 - 2`` substitutions. One row per overlapping pair: ``doc_id``,
    ``item_id``, ``first_token`` and ``end_token`` (the span of all overlaps in the document,
    end not included) and ``most_equal`` (equal tokens of the best window).

    Items of fewer than eight tokens are no evidence and match nothing. Items of equal text
    are one item, under the smallest id. Null and empty texts overlap with nothing. Repeated
    documents each give their rows; rows that share an id are reported together; a null id
    stays null. Either table may be empty. Other columns are ignored; texts count whole.
    """
    items = (benchmark.select(F.col(item_col).cast("long").alias("id"),
                              F.col(item_text_col).cast("string").alias("text"))
             .where("text is not null").groupBy("text").agg(F.min("id").alias("id")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenHashes()
        for batch in slices(batches):
            yield from _seed_batch("id", batch, cache, NO_ITEM, None)

    seeds = items.mapInArrow(item_seeds, SEED_ROWS)
    filled = blocked_bloom(seeds.select("h"), "h", MAX_BLOCKS).first()["blocks"]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(filled, np.int64).view(np.uint64))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenHashes()
        for batch in slices(batches):
            yield from _seed_batch("id", batch, cache, NO_TEXT, shared.value)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SPAN)
                          for c in ("tokens", "item_tokens"))
            sizes = np.minimum(batch.column("item_size").to_numpy(), WINDOW)
            at = batch.column("at").to_numpy()
            inside = np.pad(np.cumsum((own != NO_TEXT) & (other != NO_ITEM), 1), ((0, 0), (1, 0)))
            equal = np.pad(np.cumsum(own == other, 1), ((0, 0), (1, 0)))
            first, last, most = np.full(len(own), -1), np.full(len(own), -1), np.zeros(len(own), np.int64)
            for start in range(SPAN - 2 * BLOCK + 1):
                row = np.arange(len(own))
                end = np.minimum(start + sizes, SPAN)
                same = equal[row, end] - equal[row, start]
                fits = ((end - start == sizes) & (inside[row, end] - inside[row, start] == sizes)
                        & (same >= sizes - (sizes // BLOCK - 2)))
                begin = at - BEFORE + start
                first = np.where(fits & (first < 0), begin, first)
                last = np.where(fits, begin + sizes, last)
                most = np.where(fits, np.maximum(most, same), most)
            true = pa.array(first >= 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(true), batch.column("item").filter(true)]
                + [pa.array(x).filter(true) for x in (first, last, most)],
                names=["id", "item", "first", "last", "most"])

    hits = rows.mapInArrow(doc_seeds, SEED_ROWS).drop("size").join(
        seeds.select("h", F.col("id").alias("item"), F.col("size").alias("item_size"),
                     F.col("tokens").alias("item_tokens")), "h")
    found = hits.select("id", "at", "tokens", "item", "item_size", "item_tokens").mapInArrow(
        verify, "id long, item long, first long, last long, most long")
    return (found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))
            .agg(F.min("first").alias("first_token"), F.max("last").alias("end_token"),
                 F.max("most").alias("most_equal")))
