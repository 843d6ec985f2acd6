"""The pipeline against brute-force versions of its stages, each on the input it got."""

from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.edge import documents, empty, frame
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_lines import brute as lines_gone
from tests.llm.test_neardup import brute as near
from thresher.llm.packing import load_tokenizer
from thresher.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Odd documents, labels and benchmark items as a folder of tables."""
    folder = tmp_path_factory.mktemp("tables")
    rows = [r for r in documents(seed=3, n=120) if len(r[1] or "") < 5000]
    toxic = [i for i, r in enumerate(rows) if i % 3 == 2 and r[1]]
    for i in toxic:
        rows[i] = (rows[i][0], rows[i][1] + " awful horrid nasty" * 3, *rows[i][2:])
    item = " ".join(f"b{i}" for i in range(30))
    rows[30] = (rows[30][0], f"{item}\nmore", *rows[30][2:])
    rows[31] = (rows[31][0], item.replace("b7 ", "other ").title(), *rows[31][2:])
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(rows[i][0], int(i in toxic), 1) for i in range(115) if rows[i][0] is not None],
                          "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    learned = ~corpus_pipeline.held_out("doc_id", 3, 1)
    model = fit_toxicity(docs.where(learned), labels.where(learned))
    scores = Counter()
    for r in score_toxicity(docs.select("doc_id", docs.text.alias("own"), "text"), model).collect():
        scores[r.doc_id, r.own] = r.score
    stages = dict(corpus_pipeline.STAGES)

    before = rows_of(docs)
    stage = stages["toxicity"](spark, docs, tables)
    assert stage.schema == docs.schema
    kept = rows_of(stage)
    assert Counter(kept) == Counter(r for r in before if scores[r[:2]] < 0.7)
    assert len(kept) < len(before)

    docs = corpus_pipeline.staged(stage, "one")
    stage = stages["line_dedup"](spark, docs, tables)
    assert stage.columns == docs.columns
    gone = lines_gone([r[:2] for r in kept])
    expected = []
    for doc, text, *rest in kept:
        drop = gone.get((doc is None, doc or 0, text), set())
        if text is not None:
            left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            if drop and not left.strip(" \t\n\r\x0b\x0c"):
                continue
            text, rest[-1] = left, len(left)
        else:
            rest[-1] = None
        expected.append((doc, text, *rest))
    kept = rows_of(stage)
    assert Counter(kept) == Counter(expected)

    docs = corpus_pipeline.staged(stage, "two")
    kept_now = rows_of(stages["near_dedup"](spark, docs, tables))
    # ids are not unique here, so every distinct (id, text) is a document of its own
    distinct = sorted(set(kept), key=str)
    groups = near([(i, r[1]) for i, r in enumerate(distinct)], 5)
    assert len(kept_now) == len(set(kept_now)) == sum(n for (*_, own), n in groups.items() if own)
    component = {i: root for i, _, root, _ in groups}
    roots = [component[distinct.index(r)] for r in kept_now]
    assert len(set(roots)) == len(roots)

    docs = corpus_pipeline.staged(stages["near_dedup"](spark, docs, tables), "three")
    kept = rows_of(docs)
    bad = {i for i, *_ in overlaps([(i, r[1]) for i, r in enumerate(kept)],
                                   [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()])}
    stage = stages["decontamination"](spark, docs, tables)
    assert Counter(rows_of(stage)) == Counter(r for i, r in enumerate(kept) if i not in bad)
    assert bad

    packed = stages["packing"](spark, corpus_pipeline.staged(stage, "four"), tables).collect()
    tokenizer = load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows_of(stage))
    assert sum(r.length for r in packed) == total
    assert Counter(corpus_pipeline.run(spark, tables).collect()) == Counter(packed)


def test_empty_documents(spark, tables):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, tables), "empty")
    assert docs.count() == 0
