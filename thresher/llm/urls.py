"""URL rules: a blocked Bloom filter of listed entries in front of an exact hash join.

Only DataFrame functions. The filter is one array of 64-bit blocks, at most
``MAX_BLOCKS`` (1 MB) whatever the length of the list; a longer list lets more false
positives through to the join, which removes them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_BLOCKS, MAX_BLOCKS = 1 << 10, 1 << 17
BITS_PER_ENTRY = 16
PROBES = 4
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALLOW, BLOCK = "allow", "block"


def _after_scheme(url: str) -> Column:
    return F.expr(f"substring({url}, instr({url}, '://') + 3)")


def url_host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), *LETTERS)
    return F.when(F.instr(F.col(url), "://") > 0, host).otherwise("")


def url_path(url: str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    path = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(F.col(url), "://") > 0, path).otherwise("")


def _block(h: Column, blocks: Column) -> Column:
    return F.pmod(h, blocks).cast("int")


def _mask(h: Column) -> Column:
    """Up to ``PROBES`` bits of one block, from the upper half of the hash."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(h, 64 - 6 * (i + 1)).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(PROBES)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def blocked_bloom(entries: DataFrame, hash_col: str, blocks: int) -> DataFrame:
    """One row with ``blocks``: an array of 64-bit blocks that holds all hashes."""
    h = F.col(hash_col)
    every = entries.sparkSession.range(blocks).select(F.col("id").cast("int").alias("at"),
                                                      F.lit(0).cast("long").alias("mask"))
    filled = (entries.select(_block(h, F.lit(blocks)).alias("at"), _mask(h).alias("mask"))
              .unionByName(every).groupBy("at").agg(F.bit_or("mask").alias("mask")))
    # built in slices of 1024 blocks, so that no task sees more than a few thousand rows
    parts = (filled.groupBy((F.col("at") / 1024).cast("int").alias("part"))
             .agg(F.sort_array(F.collect_list(F.struct("at", "mask"))).alias("own")))
    return parts.agg(F.transform(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("part", "own"))), lambda p: p["own"])),
        lambda x: x["mask"]).alias("blocks"))


def might_hold(blocks: Column, h: Column) -> Column:
    mask = _mask(h)
    return F.get(blocks, _block(h, F.size(blocks))).bitwiseAND(mask) == mask


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               unlisted: str = ALLOW) -> DataFrame:
    """The verdict on each URL: ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains
    of it if the path starts with the rule's; the longest rule wins (of two as long, the one
    with the longer host; rules listed twice: the larger verdict). A URL that no rule fits is
    ``unlisted``: what is not on the list passes.

    A URL is turned into the entries that could be listed for it: its host's last labels with
    its path's first characters, for the pairs of counts that occur in the list. Those that the
    filter might hold are joined with the list.

    Null URLs and those without ``://`` have an empty host and path. Repeated rows give as many
    rows. Empty rules leave every URL unlisted; rules with a null field are ignored. An empty
    table gives no rows. Other columns are ignored.
    """
    listed = (rules.select(F.translate("host", *LETTERS).alias("rule_host"), F.col("path").alias("rule_path"),
                           "verdict").dropna()
              .groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")))
    key = F.xxhash64("rule_host", "rule_path")
    n = listed.count()
    blocks = MIN_BLOCKS
    while blocks < MAX_BLOCKS and blocks * 64 < n * BITS_PER_ENTRY:
        blocks *= 2
    bloom = blocked_bloom(listed.select(key.alias("h")), "h", blocks).scalar()
    # pairs of counts, bounded by the lengths that URLs have
    shapes = (listed.select(F.size(F.split("rule_host", r"\.")), F.length("rule_path"))
              .distinct().collect()) or [(1, 0)]

    urls = (pages.select(F.col(id_col).alias("page_id"), url_host(url_col).alias("host"),
                         url_path(url_col).alias("path"))
            .select("page_id", F.coalesce("host", F.lit("")).alias("host"),
                    F.coalesce("path", F.lit("")).alias("path"))
            .groupBy("page_id", "host", "path").agg(F.count("*").alias("copies")))
    labels = F.size(F.split("host", r"\."))
    entries = F.array_compact(F.array(*[
        F.when((labels >= n) & (F.length("path") >= chars), F.struct(
            F.substring_index("host", ".", -n).alias("rule_host"),
            F.left("path", F.lit(chars)).alias("rule_path"))) for n, chars in shapes]))
    hits = (urls.withColumn("entry", F.explode(entries)).select("page_id", "host", "path", "entry.*")
            .where(might_hold(bloom, key)))
    judged = hits.join(listed, ["rule_host", "rule_path"])
    best = (judged.groupBy(F.col("page_id").alias("page"), F.col("host").alias("h"), F.col("path").alias("p"))
            .agg(F.max(F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                F.length("rule_host").alias("host_size"),
                F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best")))
    same = F.col("page_id").eqNullSafe(F.col("page")) & (F.col("host") == F.col("h")) & (F.col("path") == F.col("p"))
    return (urls.join(best, same, "left")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("page_id", "host", "path", "best.rule",
                    F.coalesce("best.verdict", F.lit(unlisted)).alias("verdict")))
