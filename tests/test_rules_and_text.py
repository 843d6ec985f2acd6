import pytest
from pyspark.sql import functions as F

from thresher.operators import rules as R, text as X
from thresher.functions.columns import tokens


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def one(df):
    return [r[0] for r in df.collect()]


RULES = {"high": ("x", ">", 1.2), "at": ("x", ">=", 1.2), "absent": ("y", ">", 0.0),
         "odd": ("x", "~", 1.0), "unordered": ("s", ">", 1.2), "never": ("s", "==", 1.2),
         "other": ("s", "!=", 1.2)}


@pytest.mark.filterwarnings("ignore")
def test_rule_edges(spark):
    df = spark.createDataFrame(
        [(0, float("nan"), None), (1, None, None), (2, 1.2, None), (3, 1.3, "abc"), (4, 0.0, None)],
        "id int, x double, s string")
    assert one(R.with_topics(df, RULES).orderBy("id").select("text")) == [
        "normal", "normal", "at", "high at other", "normal"]


@pytest.mark.filterwarnings("ignore")
def test_three_rule_paths_agree(spark):
    df = spark.createDataFrame(
        [(0, float("nan"), None), (1, None, "t"), (2, 1.2, None), (3, 1.3, "abc"), (4, None, None)],
        "id int, x double, s string")
    plain = {(r.id, r.text) for r in R.with_topics(df, RULES).select("id", "text").collect()}
    inline = {(r.id, r.text) for r in R.with_topics_inline(df, RULES).select("id", "text").collect()}
    table = R.rule_table(spark, RULES)
    joined = {(r.id, r.text) for r in R.topics_by_join(df, "id", table).collect()}
    big = {(r.id, r.text) for r in R.topics_from_table(df, "id", table, max_inline=2).collect()}
    assert plain == inline == joined == big


def test_rule_forms(spark):
    a = R.as_rules({"n": {"column": "c", "operator": ">", "threshold": 1.0}})
    assert a == R.as_rules({"n": ("c", ">", 1.0)}) == R.as_rules([R.Rule("n", "c", ">", 1.0)])


def test_add_and_remove_keep_order(spark):
    t = R.rule_table(spark, {"a": ("x", ">", 1), "b": ("x", "<", 0)})
    t = R.add_rule(t, R.Rule("a", "x", ">", 2.0))
    t = R.add_rule(t, R.Rule("c", "x", "==", 5.0))
    rows = [(r.ord, r.name, r.threshold) for r in t.orderBy("ord").collect()]
    assert rows == [(0, "a", 2.0), (1, "b", 0.0), (2, "c", 5.0)]
    assert R.remove_rule(t, "b").count() == 2


def test_labels(spark):
    t = texts(spark, "normal", "a", "a b", "a b c", "", None)
    assert one(R.topic_labels(t).orderBy("id").select("label")) == [0, 1, 1, 2, 0, 0]
    with pytest.raises(ValueError):
        R.topic_labels(t, "other")


def test_totals_count_empty_text_as_with_topics(spark):
    r = R.topic_totals(texts(spark, "normal", "", "a b")).first()
    assert (r.total_rows, r.rows_with_topics, r.unique_topics) == (3, 2, 2)
    assert r.average_topics == pytest.approx(2 / 3)


def test_pairs_do_not_merge_repeats(spark):
    got = {r.pair: r.n for r in R.topic_pairs(texts(spark, "a a b", "b a", "normal")).collect()}
    assert got == {"a+a": 1, "a+b": 3}


@pytest.mark.parametrize("level,size,value,expected", [
    ("word", 5, "a  b c", "a  b c"), ("word", 2, "a  b c", "a b"), ("sentence", 1, "a  b c", "a b c"),
    ("paragraph", 0, "a  b c", "a  b c"), ("word", 1, "normal", "normal"), ("word", 1, "", ""),
    ("word", 2, " a b ", " a b "), ("word", 1, " a b ", "a"), ("word", 3, "   ", "   "),
    ("sentence", 1, "   ", ""), ("word", 0, "a b", ""),
    ("word", 2, "a\xa0b\x1cc　d", "a b")])
def test_cuts(spark, level, size, value, expected):
    assert one(texts(spark, value).select(X.extract("text", level, size))) == [expected]


def test_tokens_split_like_python(spark):
    value = "\ta b \x85 c\x1fd\n"
    assert one(texts(spark, value).select(tokens("text"))) == [value.split()]


def test_grid_equals_single_cuts(spark):
    t = texts(spark, " ".join("abcdefghijklmnopqrstuvwxyz"), "x  y", "normal")
    grid = X.extraction_grid(t)
    for level, size, _ in X.grid_cells():
        got = grid.where((F.col("level") == level) & (F.col("size") == size)).select("id", "text")
        want = t.select("id", (F.col("text") if size == X.BASELINE
                               else X.extract("text", level, int(size))).alias("text"))
        assert set(got.collect()) == set(want.collect())


def test_unknown_level(spark):
    with pytest.raises(ValueError):
        X.extract("text", "page", 1)


def test_aliases_merge_equal_extractions(spark):
    cells = X.extraction_aliases(texts(spark, "a b c", "normal"))
    assert {src for *_, src in cells} == {"full"}
    spaced = {(lv, s): src for lv, s, _, src in X.extraction_aliases(texts(spark, "a  b"))}
    assert spaced["word", "5"] == "full" and spaced["sentence", "1"] == "sentence:1"


def test_topics_on_a_stream(spark, tmp_path):
    from thresher.streaming.topics import write_topics
    spark.createDataFrame([(1, 2.0), (2, 0.5)], "id int, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, x double").parquet(str(tmp_path / "in"))
    q = write_topics(stream, {"high": ("x", ">", 1)}, str(tmp_path / "out"),
                     str(tmp_path / "log"), available_now=True)
    q.awaitTermination(60)
    got = {(r.id, r.text, r.label) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "high", 1), (2, "normal", 0)}


def test_custom_extractors(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 0.0)], "id int, x double")
    by_row = R.with_custom_topics(df, lambda r: "big" if r["x"] > 1 else "normal")
    by_col = R.with_custom_topics(df, R.as_column(
        lambda d: F.when(d["x"] > 1, "big").otherwise("normal")))
    assert one(by_row.select("text")) == one(by_col.select("text")) == ["big", "normal"]
