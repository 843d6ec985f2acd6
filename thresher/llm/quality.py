"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages that cover its whole text. Each passage is encoded from
the shapes and hashed identities of its words; gated attention, learned from document
labels alone, weighs the passages; the weighted representation gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from thresher.llm.sampling import labelled_sample
from thresher.llm.words import slices

SAMPLE = 8_000              # labelled documents for the fit
PASSAGE_WORDS = 80
IDENTITY = 24               # signs drawn from the hash of a word
ENDINGS = b".,!?;:$%&#*|"   # fixed values: symbols that close a word
SHAPES = 8 + len(ENDINGS)
BUCKETS = 64
CODED = SHAPES + IDENTITY + 3
HIDDEN, GATE = 24, 16
CACHED_WORDS = 150_000
# the signs of all numbers of twelve bits, lowest first
SIGNS = ((np.arange(1 << 12)[:, None] >> np.arange(12)) & 1) * 2.0 - 1


class WordCodes(dict):
    """Word bytes -> row of ``table``: shape of the word, and random signs from its hash."""

    def __init__(self) -> None:
        self.table = np.zeros((CACHED_WORDS, SHAPES + IDENTITY), np.float32)
        self.buckets = np.zeros(CACHED_WORDS, np.int64)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            raise OverflowError     # never: ``room`` is called before each lookup
        row, self[word] = self.table[len(self)], len(self)
        text = word.decode()
        n = len(text)
        letters = sum(map(str.isalpha, text))
        upper = sum(map(str.isupper, text))
        row[:8] = (min(n, 40) / 10, letters / n, upper / max(1, letters), sum(map(str.isdigit, text)) / n,
                   1 - len(word.strip(ENDINGS)) / len(word), text[:1].isupper(), letters == 0,
                   letters > 1 and upper == letters)
        end = ENDINGS.find(word[-1:])
        row[8:SHAPES] = 0
        if end >= 0:
            row[8 + end] = 1
        value = xxhash.xxh3_64_intdigest(word)
        row[SHAPES:SHAPES + 12] = SIGNS[value & 0xFFF]
        row[SHAPES + 12:] = SIGNS[value >> 12 & 0xFFF]
        self.buckets[self[word]] = value % BUCKETS
        return self[word]

    def room(self, words: list[bytes]) -> None:
        if len(self) + len(words) > CACHED_WORDS:
            self.clear()


def encode(texts: list[bytes], codes: WordCodes) -> list[np.ndarray]:
    """One row of ``CODED`` numbers for each passage of every text; none without words.

    All texts of a batch go through together. A passage is ``PASSAGE_WORDS`` words at every
    length of text, the last ones of a text sharing its rest evenly.
    """
    words, ends = [], []
    for text in texts:
        words += text.split()
        ends.append(len(words))
    ends = np.array(ends, np.int64)
    begins = np.append(0, ends[:-1])
    n = ends - begins
    passages = -(-n // PASSAGE_WORDS)
    first = np.cumsum(passages) - passages          # of each text, among all passages
    total = int(passages.sum())
    text_of = np.repeat(np.arange(len(texts)), passages)
    place = np.arange(total) - first[text_of]
    starts = begins[text_of] + -(-place * n[text_of] // np.maximum(1, passages[text_of]))
    sizes = np.diff(np.append(starts, len(words)))
    of = np.repeat(np.arange(total), sizes)         # the passage of each word
    out = np.zeros((total, CODED))
    spread = np.zeros(total * BUCKETS)
    step = CACHED_WORDS // 8
    for at in range(0, len(words), step):           # bounds the memory of very long texts
        part = words[at:at + step]
        codes.room(part)
        rows = np.fromiter(map(codes.__getitem__, part), np.int64, len(part))
        mine = of[at:at + step]
        cut = np.flatnonzero(np.diff(mine, prepend=-1))
        held = mine[cut]
        out[held, :SHAPES + IDENTITY] += np.add.reduceat(codes.table[rows], cut, axis=0)
        # a word that repeats the one before it in its text
        same = np.diff(rows, prepend=-1) == 0
        same[0] = at > 0 and words[at] == words[at - 1]
        new_text = begins[(begins >= at) & (begins < at + len(part))] - at
        same[new_text] = False
        out[held, -3] += np.add.reduceat(same.astype(float), cut)
        # the buckets hash the identity signs again, so they do not depend on the cache
        spread += np.bincount(mine * BUCKETS + codes.buckets[rows], minlength=total * BUCKETS)
    if total:
        size = sizes[:, None]
        out[:, :-2] /= size
        out[:, -2] = ((spread.reshape(total, BUCKETS) / size) ** 2).sum(1)
        out[:, -1] = np.log1p(sizes)
    return np.split(out, first[1:]) if len(texts) else []


@dataclass
class AttentionModel:
    """Standardisation, passage layer, gated attention and the score of the bag."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    prior: float

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """Scores of bags; one without passages gets the prior."""
        out = np.full(len(bags), self.prior)
        full = [i for i, bag in enumerate(bags) if len(bag)]
        if full and self.parts:
            x = (np.concatenate([bags[i] for i in full]) - self.mean) / self.scale
            odds, *_ = _forward(self.parts, np.clip(x, -8, 8), np.array([len(bags[i]) for i in full]))
            out[full] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return out


def _forward(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    begins = np.cumsum(sizes) - sizes
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
    e = (v * u) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begins), sizes))
    a = e / np.repeat(np.add.reduceat(e, begins), sizes)
    z = np.add.reduceat(a[:, None] * h, begins, axis=0)
    return z @ p["c"] + p["d"], h, v, u, a, z, begins


def fit_attention(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 256,
                  rate: float = 0.01, penalty: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Gradient descent (Adam) on the bags, in batches of documents."""
    prior = float((labels.sum() + 0.5) / (len(labels) + 1))
    keep = [i for i, bag in enumerate(bags) if len(bag)]
    if not keep or labels[keep].min() == labels[keep].max():
        return AttentionModel(np.zeros(CODED), np.ones(CODED), {}, prior)
    bags, labels = [bags[i] for i in keep], labels[keep].astype(float)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), np.maximum(every.std(0), 1e-3)
    bags = [np.clip((bag - mean) / scale, -8, 8) for bag in bags]
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"W": draw(CODED, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
         "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(())}
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step, steps = 0, epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            x, sizes = np.concatenate([bags[i] for i in chosen]), np.array([len(bags[i]) for i in chosen])
            odds, h, v, u, a, z, begins = _forward(p, x, sizes)
            error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[chosen]) / len(chosen)
            dz = np.repeat(error[:, None] * p["c"], sizes, axis=0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, begins), sizes))
            dv, du = de[:, None] * p["w"] * u * (1 - v ** 2), de[:, None] * p["w"] * v * u * (1 - u)
            dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h ** 2)
            grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de,
                    "c": z.T @ error, "d": error.sum()}
            step += 1
            for k in p:
                g = grad[k] + penalty * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return AttentionModel(mean, scale, p, prior)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", sample: int = SAMPLE) -> AttentionModel:
    """Fits on about ``sample`` labelled documents at most, encoded in tasks.

    The driver receives ``CODED`` floats for each of their passages.
    Without labels of both kinds every score is the share of label 1.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches):
            bags = [bag.astype(np.float32).tobytes() for bag in encode(
                [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], codes)]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column("label")],
                                             names=["bag", "label"])

    rows = (labelled_sample(docs, labels, label_col, sample, id_col, text_col)
            .mapInArrow(run, "bag binary, label int").toArrow())
    bags = [np.frombuffer(b, np.float32).reshape(-1, CODED).astype(float) for b in rows.column("bag").to_pylist()]
    found = rows.column("label").to_numpy()
    # rows come in no fixed order; the fit draws its batches by position
    order = sorted(range(len(bags)), key=lambda i: (found[i], bags[i].tobytes()))
    return fit_attention([bags[i] for i in order], found[order])


def score_quality(docs: DataFrame, model: AttentionModel, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ``score`` (0 to 1, higher: label 1 is likelier).
    A column of ``docs`` named ``score`` gives way to the new one.

    Null, empty and blank texts have no passage and get the share of label 1 in the sample.
    Long texts are read whole, in passages of the same length as others. One row per input row, repeated rows
    alike; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (text_col, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in slices(batches, text_col):
            bags = encode([t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()], codes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(shared.value.score(bags), pa.float64())],
                names=[*others, "score"])

    schema = docs.select(*others).schema.add("score", "double")
    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
