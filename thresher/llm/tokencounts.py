"""Token counts of whole texts: a broadcast table of frequent pieces, a worker cache for the rest.

A tokenizer cuts a text into pieces before it merges, and every piece has its own number of
tokens. So a text's count is a sum of look-ups, and only pieces that no table holds yet are
encoded. No piece is ever shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from thresher.llm.words import slices

TABLE_PIECES = 16_384       # frequent pieces in the broadcast table, of at most LONGEST characters
LONGEST = 48
SAMPLE_DOCUMENTS = 20_000   # the table is drawn from about so many whole texts; no result depends on it
TRACKED = 32_768            # pieces a frequency sketch can tell apart
CACHED_PIECES = 200_000     # bounds a task's memory; a full cache falls back to the table
CUT_CHARACTERS = 1 << 20    # longer texts are taken in stretches that end between two pieces

# Fixed value: the pattern by which byte-level tokenizers cut texts into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN = regex.compile(PIECES)
# Characters whose classes `regex` and `tokenizers` agree on (a test compares each one). Texts
# with others are cut by the tokenizer itself, four times slower.
UNSURE = regex.compile(r"[^\u0000-\u0557\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
                       r"\u2190-\u21ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
BETWEEN = regex.compile(r"(?<=[!-~]) (?=[!-~])")


class Counter:
    """Counts the tokens of texts as ``tokenizer.encode`` does, without added specials."""

    def __init__(self, path: str, table: tuple[bytes, bytes, bytes] | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        facts = json.loads(self.tokenizer.to_str())
        cut = facts["pre_tokenizer"] or {}
        self.byte_level = (facts["normalizer"] is None and cut.get("type") == "ByteLevel"
                           and cut.get("use_regex", True) and not cut.get("add_prefix_space"))
        self.lengths = Lengths(self.encoded, unpack(table))

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        # a special string is one token wherever it stands: such texts go through the tokenizer
        if not self.byte_level or any(a in text for a in self.added):
            return self.encoded(text)
        if len(text) <= CUT_CHARACTERS:
            return self._pieces(text)
        total, start = 0, 0
        while start < len(text):
            cut = BETWEEN.search(text, start + CUT_CHARACTERS)
            end = cut.start() if cut else len(text)
            total += self._pieces(text[start:end])
            start = end
        return total

    def _pieces(self, text: str) -> int:
        if UNSURE.search(text):
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            return sum(self.lengths[text[a:b]] for _, (a, b) in cut)
        return sum(map(self.lengths.__getitem__, PATTERN.findall(text)))


class Lengths(dict):
    """Piece -> number of tokens: the broadcast table, and what this task has encoded since."""

    def __init__(self, encode, table: dict[str, int]):
        super().__init__(table)
        self.encode, self.table = encode, table

    def __missing__(self, piece: str) -> int:
        n = self.encode(piece)
        if len(piece) <= 8 * LONGEST:
            if len(self) >= CACHED_PIECES + len(self.table):
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


def pack(lengths: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """All pieces in one string, their sizes in bytes and their numbers of tokens."""
    pieces = [p.encode() for p in lengths]
    return (b"".join(pieces), np.array([len(p) for p in pieces], np.uint16).tobytes(),
            np.array(list(lengths.values()), np.uint16).tobytes())


def unpack(table: tuple[bytes, bytes, bytes] | None) -> dict[str, int]:
    if table is None:
        return {}
    ends = np.cumsum(np.frombuffer(table[1], np.uint16).astype(np.int64)).tolist()
    pieces = [table[0][a:b].decode() for a, b in zip([0, *ends], ends)]
    return dict(zip(pieces, np.frombuffer(table[2], np.uint16).tolist()))


def frequent_lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
                     table_pieces: int = TABLE_PIECES, sample: int = SAMPLE_DOCUMENTS
                     ) -> dict[str, int]:
    """Token numbers of the pieces seen most often in about ``sample`` texts of ``docs``.

    Every task summarises its pieces in a frequency sketch; only sketches are merged.
    """
    n = docs.count()
    if not n or not table_pieces:
        return {}
    chosen = docs.where(F.rand(42) < F.lit(min(1.0, sample / n))).select(F.col(text_col).alias("text"))
    piece = F.explode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("piece")
    found = (chosen.select(piece).where(F.length("piece") <= LONGEST)
             .agg(F.expr(f"approx_top_k(piece, {table_pieces}, {max(TRACKED, table_pieces)})").alias("top"))
             .first()["top"])
    counter = Counter(tokenizer_path)
    return {r["item"]: counter.encoded(r["item"]) for r in found or []
            if not any(a in r["item"] for a in counter.added)}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text", table_pieces: int = TABLE_PIECES,
                 sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(id, ``n_bytes``, ``n_tokens``, ``over_limit``) for every row of ``docs``.

    ``tokenizer_path`` is a `tokenizers` file that every executor can open. Counts are those of
    the library without begin, end, truncation or padding; added tokens that stand in a text
    are one token each, as by default. ``over_limit`` says whether there are more than ``limit``.

    One narrow pass: a task looks pieces up in the broadcast table (``table_pieces`` pieces
    drawn from a sample) and in its own cache, and encodes the rest. A document is never cut
    short; above CUT_CHARACTERS it is taken in stretches that end between two pieces.

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat, or repeat an id, are
    counted each; null ids stay. An empty table gives no rows, further columns are left out.
    """
    lengths = frequent_lengths(docs, tokenizer_path, text_col, table_pieces, sample)
    table = docs.sparkSession.sparkContext.broadcast(pack(lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, table.value)
        for batch in slices(batches):
            n = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
