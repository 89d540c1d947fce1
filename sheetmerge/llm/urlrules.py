"""URL filters: stated host and path rules, then mined association rules.

A URL is a set of tokens (the words of host, path and query names, without
numbers). FP-growth over the URLs labelled bad mines the token combinations
that at least ``MIN_COUNT`` of them, and a share of ``MIN_SUPPORT`` of all
labelled URLs, hold. The labelled URLs that hold a combination at all are
counted by the same index that matches rules. A rule must be surer than the
labels at large: its confidence (bad among those that hold it) is
``MIN_LIFT`` times the share of bad labels or more, and ``MIN_Z`` standard
errors above it or more (one-sided test of a share). Rules that a rule with
one token less and no less confidence covers are pruned.

Tokens that occur in just the same labelled URLs are mined as one, since a
combination of some is a combination of all; any of them stands for it when
a URL is matched. So the names of a URL that repeats, however many, are one
item, and not a power set. Equal token sets are counted together, so a URL
that holds a third of the table is one row.

Rules match by inverted index: each is filed under its rarest token, a URL
meets the rules filed under one of its tokens, and the whole combination is
checked. The work is per distinct URL.

Defined results: a null URL, or one without ``://``, has an empty host and
path; without tokens nothing matches and the method allows. Labels that are
null don't train. Without labelled URLs there are no mined rules. Rows are
judged one by one, whatever their ids; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmerge.sources.land import land

#: Fixed rules: verdict and rule (host, then path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MIN_SUPPORT = 0.002
MIN_COUNT = 10
MIN_LIFT = 1.25
MIN_Z = 1.96

_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def stated(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits, else nulls.

    ``rules`` is a short list that becomes part of the query.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct words of a URL, but for numbers and the values of its query."""
    names = F.regexp_replace(F.lower(url), "=[^&#]*", " ")
    words = F.split(names, r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.rlike(r"^\p{N}+$")))


def _token_classes(baskets: DataFrame, least: int) -> DataFrame:
    """(token, class, freq): tokens of ``least`` bad URLs or more; those of the same URLs share a class."""
    each = baskets.select(F.explode("tokens").alias("token"), "n", "bad", F.xxhash64("tokens").alias("code"))
    seen = each.groupBy("token").agg(
        F.sum("n").alias("freq"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("baskets"), F.bit_xor("code").alias("code")
    )
    same = Window.partitionBy("freq", "bad", "baskets", "code")
    return seen.filter(F.col("bad") >= least).select("token", F.min("token").over(same).alias("class"), "freq")


def _held(baskets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(needs, n): how many labelled URLs hold each combination; ``wanted`` has (key, needs)."""
    met = baskets.select("tokens", "n", F.explode("tokens").alias("key")).join(wanted, "key")
    return met.filter(F.size(F.array_except("needs", "tokens")) == 0).groupBy("needs").agg(F.sum("n").alias("n"))


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_lift: float = MIN_LIFT,
    min_z: float = MIN_Z,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(key, needs, alternatives, confidence, support) from (url, bad); landed.

    ``needs`` is the combination; for each of its tokens ``alternatives`` has
    those of the same labelled URLs, itself included. ``key`` is its rarest
    token or one of the same URLs.
    """
    spark = labelled.sparkSession
    rows = labelled.dropna().select(F.array_sort(tokens(F.col("url"))).alias("tokens"), (F.col("bad") == 1).cast("long").alias("bad"))
    rows = land(spark, rows, "url-labels")
    baskets = land(spark, rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")), "url-baskets")
    count, bad = baskets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).collect()[0]
    least = max(min_count, math.ceil(min_support * count), 1)
    none = spark.createDataFrame([], "key string, needs array<string>, alternatives array<array<string>>, confidence double, support double")
    if bad < least:
        return none
    classes = land(spark, _token_classes(baskets, least), "url-tokens")
    # each is in a share of min_support of the URLs: no more than tokens a URL / min_support
    items = sorted(r["class"] for r in classes.select("class").distinct().collect())
    if not items:
        return none
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = rows.filter("bad = 1").select(F.array_intersect("tokens", F.lit(items)).alias("items"))
    model = FPGrowth(minSupport=(least - 0.5) / bad, numPartitions=parts).fit(held)
    found = land(spark, model.freqItemsets.select(F.array_sort("items").alias("needs"), F.col("freq").alias("bad")), "url-itemsets")
    rarest = found.select("needs", F.explode("needs").alias("token")).join(classes, "token").groupBy("needs").agg(
        F.min_by("token", F.struct("freq", "token")).alias("key")
    )
    rarest = land(spark, rarest, "url-keys")
    base = bad / count
    share = F.col("bad") / F.col("n")
    z = (share - base) / F.sqrt(F.lit(max(base * (1 - base), 1e-12)) / F.col("n"))
    rules = found.join(_held(baskets, rarest), "needs").select("needs", "bad", "n").filter((share >= min_lift * base) & (z >= min_z))
    rules = land(spark, rules.select("needs", share.alias("confidence"), (F.col("bad") / count).alias("support")), "url-rules")
    # a rule is spare if one token less is a rule of no less confidence
    shorter = rules.select("needs", "confidence", F.explode("needs").alias("without")).select(
        "needs", "confidence", F.array_remove("needs", F.col("without")).alias("core")
    )
    s, r = shorter.alias("s"), rules.alias("r")
    spare = s.join(r, F.col("s.core") == F.col("r.needs")).filter("r.confidence >= s.confidence").select(F.col("s.needs").alias("needs")).distinct()
    kept = rules.join(spare, "needs", "left_anti")
    alike = classes.groupBy("class").agg(F.array_sort(F.collect_list("token")).alias("alike"))
    pairs = kept.select("needs", F.posexplode("needs").alias("place", "class")).join(alike, "class")
    options = pairs.groupBy("needs").agg(F.array_sort(F.collect_list(F.struct("place", "alike"))).alias("o"))
    options = options.select("needs", F.transform("o", lambda o: o["alike"]).alias("alternatives"))
    keys = rarest.join(classes.select(F.col("class").alias("key"), "token"), "key").select("needs", F.col("token").alias("key"))
    whole = kept.join(options, "needs").join(keys, "needs")
    return land(spark, whole.select("key", "needs", "alternatives", "confidence", "support"), "url-index")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, needs, confidence): distinct URLs that a mined rule matches, with their surest rule."""
    each = urls.select("url").filter("url is not null").distinct().withColumn("tokens", tokens(F.col("url")))
    met = each.withColumn("key", F.explode("tokens")).join(rules, "key")
    whole = met.filter(F.forall("alternatives", lambda a: F.arrays_overlap(a, F.col("tokens"))))
    order = F.struct(-F.col("confidence"), -F.col("support"), "needs")
    best = whole.groupBy("url").agg(F.min(order).alias("best"))
    return best.select("url", F.col("best.needs").alias("needs"), (-F.col("best.col1")).alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the mined combination that blocks it."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.join(matched(rows, rules).select("url", "needs", "confidence"), "url", "left")
    rule, verdict = stated(F.col("host"), F.col("path"))
    return (
        rows.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "needs", "confidence")
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("needs").isNotNull(), "block").otherwise("allow")))
        .select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", F.array_join("needs", " ").alias("mined"), "confidence")
    )
