"""Documents that hold every odd case: nulls, blanks, long texts, ties, repeats, clashing columns."""

import numpy as np

# the extra columns carry names that operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score double, key string, size int, node string, root long, a long, h string")
EXTRA = (0.5, "k", 1, "n", None, 3, "h")


def words(rng, n, vocabulary=400):
    return [f"w{i}" for i in rng.zipf(1.3, n) % vocabulary]


def documents(seed=0, n=60):
    rng = np.random.default_rng(seed)
    texts = [" ".join(words(rng, rng.integers(0, 120))) for _ in range(n)]
    for i in range(5, n, 7):                    # near and exact copies, shared passages
        copy = texts[i - 5].split()
        if i % 2 and copy:
            copy[rng.integers(0, len(copy))] = "edited"
        texts[i] = " ".join(copy)
    passage = " ".join(words(rng, 30))
    for i in range(3, n, 6):
        texts[i] += "\n" + passage + ".\n" + " ".join(words(rng, 5))
    texts[1], texts[2], texts[4] = None, "", " \t\n\x0b "
    texts[6] = "Ünïcode—ÇA va! 'LL <|endoftext|> \u0085 \u00a0 x\u200b" + " Zz" * 30
    texts[8] = " ".join(words(rng, 30_000, 5000))
    ids = list(range(n))
    ids[9] = ids[10] = None
    rows = [(d, t, None if i % 9 == 0 else "en", None, 7) for i, (d, t) in enumerate(zip(ids, texts))]
    rows += [rows[0], rows[12], rows[12], (12, "other text under one id", "en", "s", None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*row, *EXTRA) for row in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
