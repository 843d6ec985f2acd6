"""Leading words, sentences and paragraphs of a text, one by one or as a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from thresher.functions.columns import SPACES, leading_parts, passes_unchanged, terms, topic_count

# Words per sentence and per paragraph.
SENTENCE_WORDS = 5
PARAGRAPH_WORDS = 10

BASELINE = "Baseline"
LEVELS = ("word", "sentence", "paragraph")
DEFAULT_SIZES = {"word": (5, 10, 15, 20), "sentence": (1, 2, 3), "paragraph": (0, 1, 2)}
SEARCH_SIZES = {"word": (5, 10, 15), "sentence": (1, 2, 3), "paragraph": (0, 1, 2)}


def words_needed(level: str, size: int) -> int:
    if level == "word":
        return size
    if level == "sentence":
        return SENTENCE_WORDS * size
    if level == "paragraph":
        return PARAGRAPH_WORDS * size
    raise ValueError(f"unknown extraction method: {level}")


def _cut(text: Column, parts: Column, level: str, size: int) -> Column:
    n = words_needed(level, size)
    if level == "paragraph" and size == 0:
        return text
    shortened = F.array_join(F.slice(parts, 1, n), " ")
    if level == "word":             # a short text keeps its own spacing
        shortened = F.when(F.size(parts) > n, shortened).otherwise(text)
    return F.when(passes_unchanged(text), text).otherwise(shortened)


def extract(text: str | Column, level: str, size: int) -> Column:
    """The first ``size`` words, sentences (5 words) or paragraphs (10 words)."""
    text = F.col(text) if isinstance(text, str) else text
    if level == "paragraph" and size == 0:
        return text
    # bound once by a one-element transform, as the cut reads the parts twice
    parts = F.array(leading_parts(text, words_needed(level, size)))
    return F.get(F.transform(parts, lambda p: _cut(text, p, level, size)), F.lit(0))


def leading_words(text: str | Column, n: int) -> Column:
    return extract(text, "word", n)


def leading_sentences(text: str | Column, n: int) -> Column:
    return extract(text, "sentence", n)


def leading_paragraphs(text: str | Column, n: int) -> Column:
    return extract(text, "paragraph", n)


def grid_cells(sizes: dict[str, Sequence[int]] | None = None,
               baseline: bool = True) -> list[tuple[str, str, int]]:
    """(level, size, size_ord) of every extraction, in evaluation order."""
    cells = []
    for level, values in (sizes or DEFAULT_SIZES).items():
        names = [str(v) for v in values] + ([BASELINE] if baseline else [])
        cells += [(level, name, i) for i, name in enumerate(names)]
    return cells


def extraction_grid(df: DataFrame, text: str = "text",
                    sizes: dict[str, Sequence[int]] | None = None,
                    baseline: bool = True) -> DataFrame:
    """One row per input row and extraction; the text is split once for all of them."""
    cells = grid_cells(sizes, baseline)
    longest = max([words_needed(lv, int(s)) for lv, s, _ in cells if s != BASELINE] or [0])
    keep = [c for c in df.columns if c != text]
    src = df.withColumn("_parts", leading_parts(text, longest))
    full, parts = F.col(text), F.col("_parts")
    out = [F.struct(F.lit(lv).alias("level"), F.lit(s).alias("size"), F.lit(i).alias("size_ord"),
                    (full if s == BASELINE else _cut(full, parts, lv, int(s))).alias("text"))
           for lv, s, i in cells]
    return src.select(*keep, F.inline(F.array(*out)))


def clean_text(text: str | Column, lowercase: bool = True, remove_punctuation: bool = True,
               stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased text without punctuation and stop words."""
    out = F.col(text) if isinstance(text, str) else text
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", "")
    if stop_words:
        stops = F.array(*[F.lit(w) for w in stop_words])
        kept = F.filter(F.split(out, r"\s+"), lambda w: (w != "") & ~F.array_contains(stops, w))
        out = F.array_join(kept, " ")
    return out


def with_terms(df: DataFrame, text: str = "text", out: str = "terms") -> DataFrame:
    return df.withColumn(out, terms(text))


def extraction_aliases(texts: DataFrame, sizes=None, baseline: bool = True,
                       text: str = "text") -> list[tuple[str, str, int, str]]:
    """(level, size, size_ord, source cell) with equal extractions under one source.

    With at most m topics per text, every extraction of m or more words is the
    full text. Texts with irregular spacing are re-joined by sentence and
    paragraph cuts, so those alias only if all texts are regular.
    """
    facts = texts.agg(
        F.max(topic_count(text)).alias("m"),
        F.max(F.coalesce(F.col(text) != F.trim(F.regexp_replace(text, SPACES, " ")),
                         F.lit(False)).cast("int")).alias("irregular")).first()
    longest, irregular = facts["m"] or 0, bool(facts["irregular"])
    out = []
    for level, size, i in grid_cells(sizes, baseline):
        whole = size == BASELINE or (level == "paragraph" and size == "0") or (
            words_needed(level, int(size)) >= longest and (level == "word" or not irregular))
        out.append((level, size, i, "full" if whole else f"{level}:{size}"))
    return out
