"""URL filter by association rules.

Hand-made rules (host, path) judge the urls they fit; the most specific one wins. Those urls
are the labelled transactions for Spark's FP-growth: items are tokens of the url and its
verdict. Rules from tokens to `block` that reach the least support and confidence judge the urls
without a hand-made rule.

Long urls would make FP-growth list all subsets of the tokens that always stand together. So tokens
that stand in the same labelled urls are one item, tokens that are too rare among blocked urls are
left out, and a token that makes a rule by itself is kept as a rule and not mined further: its
supersets say nothing more. The rules are a table, matched by an inverted index from token to
rules: a rule matches when a token of each of its items is there. Distinct token lists are
matched, not urls. Everything is JVM-side.

Defined cases: a null url or one without `://` has empty host and path, no tokens, and is
allowed; null or repeated page_id rows are kept; with no labelled url there are no mined rules;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.session import materialise

#: Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
BLOCK, ALLOW = "block", "allow"
VERDICT_ITEM = "verdict="


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The number of the fitting rule with the longest host, then path; null if none fits."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]) - len(rules[i][2]), i))
    out = F.lit(None).cast("int")
    for i in reversed(order):
        _, h, p = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: the host's domains, its labels, path segments by depth, endings, query keys."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tail = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(2))), lambda i: F.concat(
        F.lit("domain="), F.array_join(F.slice(labels, -i, i), ".")))
    words = F.transform(labels, lambda x: F.concat(F.lit("label="), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x, i: F.concat(
        F.lit("path"), (i + 1).cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "0")))
    endings = F.transform(parts, lambda x: F.lower(F.regexp_extract(x, r".\.([A-Za-z][A-Za-z0-9]*)$", 1)))
    keys = F.transform(F.split(query, "[&;]"), lambda x: F.regexp_replace(
        F.substring_index(x, "=", 1), "[0-9]+", "0"))
    endings, keys = (F.filter(found, lambda x: x != "") for found in (endings, keys))
    named = (F.transform(endings, lambda x: F.concat(F.lit("ending="), x)),
             F.transform(keys, lambda x: F.concat(F.lit("query="), x)))
    tokens = F.array_distinct(F.concat(tail, words, segments, *named))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tokens)


INDEX = "rule string, items int, item string, token string"


def merged_tokens(labelled: DataFrame) -> DataFrame:
    """item, tokens, n, n_block: tokens that stand in the same labelled urls are one item.

    Two sums over hashes of the urls' token lists tell the sets of urls apart. The tokens of an
    item stand together in one url, so there are no more of them than a url has.
    """
    whole = [F.xxhash64("tokens", "block", F.lit(seed)).cast("decimal(38,0)") for seed in (1, 2)]
    each = labelled.select("block", *[w.alias(f"h{i}") for i, w in enumerate(whole)], F.explode("tokens").alias("token"))
    per_token = each.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("block").alias("n_block"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"))
    return (per_token.groupBy("n", "n_block", "h0", "h1")
            .agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens")).drop("h0", "h1"))


def mine(transactions: DataFrame, min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Inverted index (columns of INDEX) of the rules tokens -> block from labelled urls (column `items`)."""
    spark = transactions.sparkSession
    block = F.array_contains("items", VERDICT_ITEM + BLOCK)
    labelled = materialise(transactions.select(
        F.filter("items", lambda x: ~x.startswith(VERDICT_ITEM)).alias("tokens"), block.alias("block")), "labelled")
    least = max(1, math.ceil(min_support * labelled.count()))
    items = materialise(merged_tokens(labelled).filter(F.col("n_block") >= least), "items")
    alone = F.col("n_block") / F.col("n") >= min_confidence
    singles = items.filter(alone).select(F.col("item").alias("rule"), F.lit(1).alias("items"), "item", "tokens")
    # An item stands in so many urls: at most (tokens of a url) / min_support of them come to the driver.
    names = {r["item"] for r in items.filter(~alone).select("item").collect()}
    if not names:
        return materialise(singles.select("rule", "items", "item", F.explode("tokens").alias("token")), "rules")
    known = F.array(*[F.lit(x) for x in sorted(names)])
    reduced = labelled.select(F.array_append(
        F.array_intersect("tokens", known), F.concat(F.lit(VERDICT_ITEM), F.when(F.col("block"), BLOCK).otherwise(ALLOW)))
        .alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(reduced)
    found = (model.associationRules.filter(F.col("consequent") == F.array(F.lit(VERDICT_ITEM + BLOCK)))
             .select(F.array_sort("antecedent").alias("a")))
    # A rule goes when it is another one and a further item.
    less = found.filter(F.size("a") > 1).select("a", F.explode(F.transform(
        "a", lambda x: F.array_except("a", F.array(x)))).alias("part"))
    covered = less.join(found.select(F.col("a").alias("part")), "part", "left_semi").select("a").distinct()
    several = (found.join(covered, "a", "left_anti")
               .select(F.concat_ws("\n", "a").alias("rule"), F.size("a").alias("items"), F.explode("a").alias("item"))
               .join(items.select("item", "tokens"), "item"))
    both = singles.unionByName(several).select("rule", "items", "item", F.explode("tokens").alias("token"))
    return materialise(both, "rules")


def matched(lists: DataFrame, index: DataFrame) -> DataFrame:
    """Keys (k1, k2) of the token lists that hold a token of each item of some rule; `lists` has distinct keys."""
    return (lists.select("k1", "k2", F.explode("tokens").alias("token")).join(index, "token")
            .groupBy("k1", "k2", "rule", "items").agg(F.count_distinct("item").alias("held"))
            .filter(F.col("held") == F.col("items")).select("k1", "k2").distinct())


def judge_urls(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"), query_of(F.col("url")).alias("__query"))
    rows = rows.withColumn("__rule", longest_rule(F.col("host"), F.col("path"), rules))
    names = F.array(*[F.lit(h + p) for _, h, p in rules])
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules])
    tokens = url_tokens(F.col("host"), F.col("path"), F.col("__query"))
    given = F.get(verdicts, F.col("__rule"))
    labelled = rows.filter(F.col("__rule").isNotNull()).select(F.array_append(
        tokens, F.concat(F.lit(VERDICT_ITEM), given)).alias("items"))
    index = mine(labelled, min_support, min_confidence)
    open_ = F.when(F.col("__rule").isNull() & (F.size("__tokens") > 0), F.col("__tokens"))
    keyed = rows.withColumn("__tokens", tokens).withColumns({
        "k1": F.xxhash64(open_, F.lit(1)), "k2": F.xxhash64(open_, F.lit(2)), "__tokens": open_})
    lists = keyed.filter(F.col("__tokens").isNotNull()).groupBy("k1", "k2").agg(
        F.first("__tokens").alias("tokens"))
    hits = materialise(matched(lists, index), "matched").withColumn("__hit", F.lit(True))
    ruled = F.when(F.col("__hit"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return keyed.drop("__tokens", "__query").join(hits, ["k1", "k2"], "left").select(
        "page_id", "host", "path", F.get(names, F.col("__rule")).alias("rule"),
        F.coalesce(given, ruled).alias("verdict"))
