"""URL filter: host and path rules first; other URLs pass a blocked Bloom filter of listed canonical URLs, and only
possible hits meet the list itself in an exact join.

All of it is column expressions, one bit_or aggregation and two joins whose strategy Spark picks by size.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: (host, path, verdict): a rule fits its host and all subdomains where the URL's path starts with the rule's.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

BITS_PER_URL = 16
LANES = 4


def _part(url: Column | str, group: int) -> Column:
    """Part of what follows the first '://': 1 is up to '/', '?' or '#', 2 the rest up to '?' or '#'; '' if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: Column | str) -> Column:
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column | str) -> Column:
    return _part(url, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host without www. and path without closing slashes; scheme, query and fragment do not count. Null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", "")))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in by_length]
    if not by_length:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)])
    return pick([h + p for h, p, _ in by_length]), pick([v for _, _, v in by_length])


def _bits(url: Column) -> list[Column]:
    """One bit in each lane of a block, from a hash independent of the block's."""
    h = F.xxhash64(url, F.lit("bits"))
    place = lambda i: F.shiftright(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place(i)) for i in range(LANES)]


def bloom_blocks(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(block, lane0 .. lane3): the filter, one row of 256 bits per occupied block."""
    block = F.pmod(F.xxhash64(url), F.lit(blocks))
    marked = listed.select(block.alias("block"), *[b.alias(f"lane{i}") for i, b in enumerate(_bits(F.col(url)))])
    return marked.groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def judge_urls(pages: DataFrame, url_col: str, listed: DataFrame, listed_col: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows of pages with host, path, rule, listed and verdict (allow or block); clashing columns of pages are replaced.

    verdict is the rule's, else block for URLs whose canonical form is listed, else allow. A null URL or one without
    '://' has empty host and path, fits no rule, is not listed and allowed. Repeated pages give repeated rows, repeated
    or null list entries count once or not at all; an empty list blocks nothing.
    """
    named = ["host", "path", "rule", "listed", "verdict", "_said", "_canonical", "_block"]
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    base = pages.select(*[c for c in pages.columns if c not in named], host.alias("host"), path.alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), said.alias("_said"), canonical(F.col("host"), F.col("path")).alias("_canonical"))

    names = listed.select(host_of(F.col(listed_col)).alias("h"), path_of(F.col(listed_col)).alias("p")) \
        .select(canonical(F.col("h"), F.col("p")).alias("_listed")).where("_listed is not null").distinct()
    blocks = max(1, names.count() * BITS_PER_URL // (64 * LANES))
    sieve = bloom_blocks(names, "_listed", blocks)

    # URLs without a canonical form would all meet in one block: they are never asked
    unnamed = base.where("_canonical is null").withColumn("listed", F.lit(False))
    asked = base.where("_canonical is not null").withColumn("_block", F.pmod(F.xxhash64("_canonical"), F.lit(blocks)))
    met = asked.join(sieve.withColumnRenamed("block", "_block"), "_block", "left")
    passes = reduce(Column.__and__, [F.col(f"lane{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col("_canonical")))])
    met = met.withColumn("_maybe", F.coalesce(passes, F.lit(False))) \
        .drop("_block", *[f"lane{i}" for i in range(LANES)])
    maybe = met.where("_maybe").join(names, F.col("_canonical") == F.col("_listed"), "left") \
        .withColumn("listed", F.col("_listed").isNotNull()).drop("_listed")
    judged = maybe.unionByName(met.where("not _maybe").withColumn("listed", F.lit(False))).drop("_maybe").unionByName(unnamed)
    verdict = F.coalesce("_said", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.withColumn("verdict", verdict).drop("_said", "_canonical")
