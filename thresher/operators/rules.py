"""Threshold rules: numeric rows in, topic text out; statistics and labels of topics."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from thresher.functions.columns import (NORMAL, is_numeric, passes_unchanged, present,
                                        topic_count, topic_tokens)

RULE_SCHEMA = "ord int, name string, column string, op string, threshold double"

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}
_EQUALITY = ("==", "!=")

# Rule tables up to this many rows travel with the plan; larger ones are joined.
MAX_INLINE_RULES = 2000


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    op: str
    threshold: float | str


def as_rules(spec) -> tuple[Rule, ...]:
    """Rules from a mapping (dict or tuple values) or from a sequence, in order."""
    if isinstance(spec, dict):
        out = []
        for name, d in spec.items():
            if isinstance(d, dict):
                d = (d.get("column"), d.get("operator"), d.get("threshold"))
            out.append(Rule(name, *d))
        return tuple(out)
    return tuple(r if isinstance(r, Rule) else Rule(*r) for r in spec)


def _condition(rule: Rule, schema: T.StructType) -> Column | None:
    """The rule as a predicate, or None if it can never apply to this table."""
    types = {f.name: f.dataType for f in schema.fields}
    if rule.column not in types:
        return None
    if rule.op not in _COMPARE:
        warnings.warn(f"unknown operator {rule.op!r} in rule {rule.name!r}")
        return None
    dtype, c = types[rule.column], F.col(rule.column)
    numeric_threshold = not isinstance(rule.threshold, str)
    if is_numeric(dtype) == numeric_threshold and (
            numeric_threshold or isinstance(dtype, T.StringType)):
        if isinstance(dtype, T.BooleanType):
            c = c.cast("int")
        limit = F.lit(float(rule.threshold) if numeric_threshold else rule.threshold)
        return present(rule.column, dtype) & _COMPARE[rule.op](c, limit)
    if rule.op not in _EQUALITY:
        warnings.warn(f"rule {rule.name!r} cannot order column {rule.column!r}")
        return None
    return present(rule.column, dtype) if rule.op == "!=" else F.lit(False)


def topic_array(df: DataFrame, rules) -> Column:
    """The names of all rules that hold, in rule order."""
    hits = [F.when(cond, F.lit(r.name)) for r in as_rules(rules)
            if (cond := _condition(r, df.schema)) is not None]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def with_topics(df: DataFrame, rules, out: str = "text") -> DataFrame:
    """Adds the topic text: one narrow projection inside whole-stage codegen."""
    hits = [F.when(cond, F.lit(r.name)) for r in as_rules(rules)
            if (cond := _condition(r, df.schema)) is not None]
    if not hits:
        return df.withColumn(out, F.lit(NORMAL))
    joined = df.withColumn("_joined", F.concat_ws(" ", *hits))
    return (joined.withColumn(out, F.when(F.col("_joined") == "", F.lit(NORMAL))
                              .otherwise(F.col("_joined"))).drop("_joined"))


def with_topics_inline(df: DataFrame, rules, out: str = "text") -> DataFrame:
    """Like ``with_topics`` for hundreds of rules: the rules are an array literal
    that a higher-order function walks, so generated code does not grow with them.
    Numeric thresholds only; no shuffle."""
    types = {f.name: f.dataType for f in df.schema.fields}
    live, always = [], []
    for i, r in enumerate(as_rules(rules)):
        if _condition(r, df.schema) is None:
            continue
        (live if is_numeric(types[r.column]) and not isinstance(r.threshold, str)
         else always).append((i, r))
    names = sorted({r.column for _, r in live})
    if not names:
        return with_topics(df, rules, out)
    numbers = F.create_map(*[x for c in names for x in (
        F.lit(c), F.when(present(c, types[c]), F.col(c).cast("double")))])
    table = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r.name).alias("name"),
                               F.lit(r.column).alias("column"), F.lit(r.op).alias("op"),
                               F.lit(float(r.threshold)).alias("threshold"))
                      for i, r in live])
    df = df.withColumn("_numbers", numbers)
    hits = F.transform(
        F.filter(table, lambda r: _holds(r["op"], F.col("_numbers")[r["column"]],
                                         r["threshold"])),
        lambda r: F.struct(r["ord"].alias("ord"), r["name"].alias("name")))
    if always:
        other = F.array_compact(F.array(*[
            F.when(_condition(r, df.schema), F.struct(F.lit(i).alias("ord"),
                                                      F.lit(r.name).alias("name")))
            for i, r in always]))
        hits = F.array_sort(F.concat(hits, other))
    df = df.withColumn("_hits", hits)
    text = F.array_join(F.transform("_hits", lambda h: h["name"]), " ")
    return (df.withColumn(out, F.when(F.size("_hits") == 0, F.lit(NORMAL)).otherwise(text))
            .drop("_numbers", "_hits"))


def _holds(op: Column, value: Column, threshold: Column) -> Column:
    test = F
    for name, compare in _COMPARE.items():
        test = test.when(op == name, compare(value, threshold))
    return F.coalesce(test.otherwise(F.lit(False)), F.lit(False))


def rule_table(spark, rules) -> DataFrame:
    return spark.createDataFrame(
        [(i, r.name, r.column, r.op, float(r.threshold))
         for i, r in enumerate(as_rules(rules))], RULE_SCHEMA)


def topics_from_table(df: DataFrame, id_col: str, rules: DataFrame,
                      max_inline: int = MAX_INLINE_RULES) -> DataFrame:
    """(id, text) with the rules taken from a table.

    A table of at most ``max_inline`` rows is read once and evaluated without a
    shuffle; a larger one goes through ``topics_by_join``, with the same result.
    """
    head = rules.orderBy("ord").limit(max_inline + 1).collect()
    if len(head) > max_inline:
        return topics_by_join(df, id_col, rules)
    spec = [Rule(r["name"], r["column"], r["op"], r["threshold"]) for r in head]
    return with_topics_inline(df, spec).select(id_col, "text")


def topics_by_join(df: DataFrame, id_col: str, rules: DataFrame,
                   broadcast_below: int = MAX_INLINE_RULES) -> DataFrame:
    """(id, text) by joining rules with unpivoted features on the column name.

    Every id stays in the one aggregate, so rows without a topic need no second
    join. The rule side is broadcast only if it is known to be small.
    """
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name != id_col]
    others = [f.name for f in df.schema.fields if f.name not in numbers and f.name != id_col]
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = [F.struct(F.lit(c).alias("column"),
                      F.when(present(c, types[c]), F.col(c).cast("double")).alias("value"),
                      F.lit(None).cast("boolean").alias("filled")) for c in numbers]
    cells += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("value"),
                       F.col(c).isNotNull().alias("filled")) for c in others]
    # equal rows are one row with a count; rows that only share an id stay apart
    columns = [c for c in df.columns if c != id_col]
    df = (df.groupBy(id_col, *columns).agg(F.count("*").alias("_copies"))
          .withColumn("_row", F.struct(id_col, *columns)))
    long = df.select(id_col, "_row", "_copies", F.inline(F.array(*cells)))
    if rules.limit(broadcast_below + 1).count() <= broadcast_below:
        rules = F.broadcast(rules)
    holds = F.when(F.col("filled").isNull(), _holds(F.col("op"), F.col("value"),
                                                    F.col("threshold")))
    holds = holds.otherwise(F.col("filled") & (F.col("op") == "!="))
    hits = F.sort_array(F.collect_list(F.when(
        F.col("name").isNotNull() & holds, F.struct("ord", "name"))))
    found = long.join(rules, "column", "left").groupBy(id_col, "_row", "_copies").agg(
        hits.alias("_hits"))
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    text = F.array_join(F.transform("_hits", lambda h: h["name"]), " ")
    return found.select(id_col, F.when(F.size("_hits") == 0, F.lit(NORMAL))
                        .otherwise(text).alias("text"))


def add_rule(rules: DataFrame, rule: Rule) -> DataFrame:
    """Replaces a rule of the same name in its place, else appends it."""
    new = rules.agg(
        F.coalesce(F.max(F.when(F.col("name") == rule.name, F.col("ord"))),
                   F.max("ord") + 1, F.lit(0)).cast("int").alias("ord")).select(
        "ord", F.lit(rule.name).alias("name"), F.lit(rule.column).alias("column"),
        F.lit(rule.op).alias("op"), F.lit(float(rule.threshold)).alias("threshold"))
    return rules.where(F.col("name") != rule.name).unionByName(new)


def remove_rule(rules: DataFrame, name: str) -> DataFrame:
    return rules.where(F.col("name") != name)


def with_custom_topics(df: DataFrame, fn, columns: Sequence[str] | None = None,
                       out: str = "text") -> DataFrame:
    """Topic text from a user's function.

    ``fn`` maps a DataFrame to a Column (preferred, stays in the JVM) when it is
    marked with ``as_column``; otherwise it maps a row dict to a string and runs
    over Arrow batches of the named columns.
    """
    if getattr(fn, "returns_column", False):
        return df.withColumn(out, fn(df))
    columns = list(columns or df.columns)

    def over_batch(rows):
        import pandas as pd
        return pd.Series([fn(r) for r in rows.to_dict("records")], dtype="object")

    # real types, as annotations of this module are strings
    import pandas as pd
    over_batch.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    udf = F.pandas_udf(over_batch, "string")
    return df.withColumn(out, udf(F.struct(*columns)))


def as_column(fn):
    """Marks an extractor that returns a Column."""
    fn.returns_column = True
    return fn


def topic_frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    return (texts.select(F.explode(topic_tokens(text)).alias("topic"))
            .groupBy("topic").agg(F.count("*").alias("n")))


def topics_per_row(texts: DataFrame, text: str = "text") -> DataFrame:
    """Number of rows for each number of topics, rows without topics included."""
    return texts.groupBy(topic_count(text).alias("topics")).agg(F.count("*").alias("n"))


def topic_totals(texts: DataFrame, text: str = "text") -> DataFrame:
    unique = topic_frequencies(texts, text).agg(F.count("*").alias("n")).scalar()
    counts = texts.agg(
        F.count("*").alias("total_rows"),
        F.count_if(~F.col(text).eqNullSafe(NORMAL)).alias("rows_with_topics"),
        F.avg(topic_count(text).cast("double")).alias("average_topics"))
    return counts.withColumn("unique_topics", unique)


def topic_pairs(texts: DataFrame, text: str = "text") -> DataFrame:
    """Co-occurrence ``a+b`` over sorted tokens; repeated tokens are not merged.

    Equal texts are merged first, so pairs are formed once per distinct text,
    and once per pair of distinct tokens, weighted by how often each occurs.
    """
    merged = (texts.where(~passes_unchanged(text)).groupBy(F.col(text).alias("_text"))
              .agg(F.count("*").alias("_rows")))
    toks = merged.select("_text", "_rows", topic_tokens("_text").alias("_all"))
    toks = toks.withColumn("_uniq", F.array_sort(F.array_distinct("_all")))
    bag = toks.select("_rows", F.transform("_uniq", lambda t: F.struct(
        t.alias("t"), F.size(F.filter("_all", lambda x: x == t)).cast("long").alias("k")))
        .alias("_bag"))
    # The outer forms keep the optimizer from testing the array on every input
    # row: it would push "is not empty" below the merge of equal texts.
    left = bag.select("_rows", "_bag", F.posexplode_outer("_bag").alias("_i", "_a"))
    pair = left.select("_rows", "_a", F.explode_outer(
        F.slice("_bag", F.col("_i") + 1, F.size("_bag"))).alias("_b"))
    same = F.col("_a.t") == F.col("_b.t")
    times = F.when(same, F.expr("_a.k * (_a.k - 1) div 2")).otherwise(
        F.col("_a.k") * F.col("_b.k"))
    return (pair.select(F.concat_ws("+", "_a.t", "_b.t").alias("pair"),
                        (times * F.col("_rows")).alias("n"))
            .where(F.col("n") > 0).groupBy("pair").agg(F.sum("n").alias("n")))


def count_label(text: str = "text") -> Column:
    """0 for no topic, 1 for one or two, 2 for three or more."""
    n = F.when(F.col(text).isNull() | (F.col(text) == NORMAL), F.lit(0)).otherwise(
        topic_count(text))
    return F.when(n >= 3, 2).when(n >= 1, 1).otherwise(0)


def topic_labels(texts: DataFrame, strategy: str = "count_based", text: str = "text",
                 out: str = "label", severity: dict[str, int] | None = None) -> DataFrame:
    """Labels by topic count; with a severity map, the largest severity of the row's topics."""
    if strategy not in ("count_based", "severity_based"):
        raise ValueError(f"unknown label strategy: {strategy}")
    if strategy == "count_based" or not severity:
        return texts.withColumn(out, count_label(text))
    table = F.create_map(*[x for k, v in severity.items() for x in (F.lit(k), F.lit(v))])
    worst = F.array_max(F.transform(topic_tokens(text), lambda t: table[t]))
    return texts.withColumn(out, F.coalesce(worst, F.lit(0)))


def choose_label(texts: DataFrame, label_col: str | None = None, text: str = "text",
                 out: str = "label") -> DataFrame:
    """The named column if the table has it, else the topic-count label.

    A label derived from topics is a function of the features; it suits
    demonstrations, not claims about predictive value.
    """
    if label_col and label_col in texts.columns:
        return texts.withColumn(out, F.col(label_col).cast("int"))
    return topic_labels(texts, text=text, out=out)
