"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from thresher.llm.decontaminate import benchmark_overlaps
from thresher.llm.language import fit_language_model, held_out, predict_language
from thresher.llm.lines import dedup_lines
from thresher.llm.neardup import near_duplicates
from thresher.llm.packing import pack_documents
from thresher.llm.quality import fit_quality, score_quality
from thresher.llm.substrings import dedup_substrings
from thresher.llm.tokencounts import count_tokens
from thresher.llm.topk import top_k
from thresher.llm.toxicity import fit_toxicity, score_toxicity
from thresher.llm.tries import numbered_turns, prefix_trie, share_heads
from thresher.llm.urls import judge_urls
from thresher.llm.whitening import whiten

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with SQL where SQL can say it."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"),
                            public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, i) AS n FROM windows)
  WHERE n > 1),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(20)) AS k)),
kept AS (
  SELECT doc_id, count(g.i) AS n_removed,
         string_agg(CASE WHEN g.i IS NULL THEN w[i] END, ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) LEFT JOIN gone g USING (doc_id, i)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@query(OP2_SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""


@query(OP9_SQL)
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


# Host, path and verdict of each rule.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))

OP6_SQL = r"""
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (
  SELECT row_number() OVER () AS id, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
urls AS (
  SELECT id, page_id,
         translate(regexp_extract(u, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT u.*, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS n
  FROM urls u LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


@query(OP6_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(str(rule) for rule in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out("doc_id", 3, 1)).select("lang", "text"))
    flags = docs.select("doc_id", "text")
    return (predict_language(flags, model)
            .select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score"))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, peer) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT reach.doc_id, e.b FROM reach JOIN edges e ON e.a = reach.peer),
least_id AS (SELECT doc_id, min(peer) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w JOIN least_id USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


@query(OP4_SQL)
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold=80)


@query()
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), min_tokens=1)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


TOXIC_AT = 0.7


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 3, 1)
    model = fit_toxicity(docs.where(~out), table(spark, sf_dir, "labels").where(~out))
    scored = score_toxicity(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


GOOD_AT = 0.3


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 5, 0)
    model = fit_quality(docs.where(~out), table(spark, sf_dir, "labels").where(~out))
    scored = score_quality(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= GOOD_AT).cast("int"))


@query()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8)


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS k, turn,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM turns),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
             lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
                                      lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
built AS (
  SELECT ids.conv_id, 0 AS part, pos, k, words FROM ids JOIN own ON own.conv_id = base AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, k, words FROM own JOIN ids USING (conv_id) WHERE pos > h),
placed AS (
  SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM built),
paths AS (
  SELECT conv_id, depth, words, md5(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs
  FROM paths GROUP BY node),
ups AS (
  SELECT n.node, p.node AS up, u.conv_id AS parent_conv_id
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes u ON u.node = p.node),
kids AS (SELECT up AS node, count(*) AS n FROM ups GROUP BY up),
below AS (
  SELECT p.node, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.node = n.node
  GROUP BY p.node),
ends AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM paths JOIN (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id) USING (conv_id, depth) GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(k.n, 0) AS n_children,
       n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN ups USING (node) LEFT JOIN kids k USING (node) LEFT JOIN ends USING (node)
"""


@query(OP12_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = numbered_turns(table(spark, sf_dir, "conversations"))
    ids = turns.select("conv_id").distinct()
    return prefix_trie(share_heads(turns, ids, every=20, most=4), ids)


@query()
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
