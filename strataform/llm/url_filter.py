"""URL filters: given rules first, then token combinations that FP-growth finds to go with bad labels."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.llm._shared import cut, partitions

#: The rules that every page is held against, as (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
BAD = "label=bad"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null. A rule's host also stands for its subdomains."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        fitting = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def tokens_of(host: Column, path: Column) -> Column:
    """A URL's distinct tokens: its host's parent domains, the host's parts, the directories and the ending of its path."""
    parts = F.filter(F.split(host, "\\."), lambda x: x != "")
    domains = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: i <= F.size(parts)), lambda i: F.concat(F.lit("domain="), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    words = F.filter(F.split(path, "/"), lambda x: x != "")
    kinds = F.transform(words, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("path=number")).otherwise(F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0"))))
    return F.array_distinct(F.concat(domains, kinds))


def informative(labelled: DataFrame, least: int) -> DataFrame:
    """labelled without the tokens that fewer than `least` pages have, and of tokens that the same pages have only the most general one: the shortest, domains first.

    Tokens that always come together would double FP-growth's work each, and no combination of them says more. Two
    sums of 64-bit hashes over a token's pages tell whether two tokens have the same ones.
    """
    own = cut(labelled.withColumn("page", F.monotonically_increasing_id()))
    each = own.select("page", F.explode("tokens").alias("token"))
    pages = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("page").cast("decimal(20,0)")).alias("a"), F.sum(F.xxhash64("page", F.lit(1)).cast("decimal(20,0)")).alias("b")).filter(F.col("n") >= least)
    order = F.struct((~F.startswith("token", F.lit("domain="))).alias("path"), F.char_length("token").alias("size"), "token")
    kept = pages.groupBy("n", "a", "b").agg(F.min(order)["token"].alias("token")).select("token")
    baskets = each.join(kept, "token").groupBy("page").agg(F.collect_list("token").alias("tokens"))
    return own.select("page", "bad").join(baskets, "page", "left").select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "bad")


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6, min_lift: float = 1.2, min_pages: int = 5) -> DataFrame:
    """(rule_id, tokens, confidence, support) of the token combinations that go with bad labels; labelled: (tokens, bad boolean).

    Support (a share of the pages, and min_pages of them at least) and confidence prune what FP-growth finds; a rule
    with a more general rule of at least its confidence adds nothing and goes too. At most (tokens a URL) /
    min_support combinations can be frequent for each size, so the rules don't grow with the rows.
    """
    spark = labelled.sparkSession
    rows = labelled.count()
    if not rows:
        return spark.range(0).selectExpr("id AS rule_id", "cast(NULL AS array<string>) AS tokens", "0D AS confidence", "0D AS support")
    least = max(min_support * rows, min_pages)
    min_support = min(1.0, least / rows)
    baskets = informative(labelled, math.ceil(least)).select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=partitions(spark)).fit(baskets).associationRules
    ours = found.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
    rules = cut(ours.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    # A more general rule shares a token with the special one: an inverted index finds it, without comparing all rules.
    a = rules.select("rule_id", "confidence", F.col("tokens").alias("all"), F.explode("tokens").alias("token")).alias("a")
    b = rules.select(F.col("rule_id").alias("b_id"), F.col("confidence").alias("b_conf"), F.col("tokens").alias("b_all"), F.element_at("tokens", 1).alias("token")).alias("b")
    idle = a.join(b, "token").filter((F.col("b_id") != F.col("rule_id")) & (F.size("b_all") < F.size("all")) & (F.col("b_conf") >= F.col("confidence")) & (F.size(F.array_except("b_all", "all")) == 0))
    return rules.join(idle.select("rule_id").distinct(), "rule_id", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, confidence) of each distinct URL shape that a mined rule fits; urls: (key, tokens), distinct by key.

    Inverted index: every rule is listed under its rarest token among the rules' tokens, so a URL is compared with
    the rules under its own tokens alone.
    """
    listed = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    often = listed.groupBy("token").count()
    index = listed.join(often, "token").groupBy("rule_id").agg(F.min(F.struct("count", "token")).alias("rare"), F.first("tokens").alias("needs"), F.first("confidence").alias("confidence")).select(F.col("rare.token").alias("token"), "needs", "confidence")
    hit = urls.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("needs", "tokens")) == 0)
    return hit.groupBy("key").agg(F.max("confidence").alias("confidence"))


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", hot: int = 1000, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence for every page.

    A label is bad if its quality is 0 or it is toxic; it belongs to the page of the same id. Where no given rule
    fits, a page is blocked if a mined rule fits its tokens, else allowed. URLs of one shape (the same tokens) are
    matched once, so a host that holds a third of all pages costs no more than another. A url that is null or
    without `://` has an empty host and path and no tokens: allowed; a line break in a url is a character like others.
    Labels are of documents; a page is the raw form of the document with its id. Labels that are null count as good; repeated
    pages each get a row; without labels nothing is mined.
    """
    own = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    own = own.withColumn("tokens", tokens_of(F.col("host"), F.col("path"))).withColumn("key", F.md5(F.array_join("tokens", "\n")))
    bad = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("page_id")).agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    mined = cut(mine_rules(own.join(bad, "page_id").select("tokens", "bad"), **mining))
    shapes = cut(own.groupBy("key").agg(F.any_value("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    matched = cut(match_rules(shapes, mined))
    # Shapes of more than one in `hot` pages, of which there can't be more than `hot`, are broadcast; their pages are dealt by id.
    most = max(1, (shapes.agg(F.sum("n")).first()[0] or 0) // hot)
    wide = F.broadcast(shapes.filter(F.col("n") > most).join(matched, "key", "left").select("key", F.struct(F.col("confidence").alias("c")).alias("_wide")))
    deal = F.when(F.col("_wide").isNull(), F.col("key")).otherwise(F.concat(F.lit("id "), F.xxhash64("page_id", "host", "path").cast("string")))
    each = own.drop("tokens").join(wide, "key", "left").withColumn("_deal", deal)
    found = each.join(matched.select(F.col("key").alias("_deal"), F.col("confidence").alias("_narrow")), "_deal", "left").withColumn("confidence", F.coalesce("_wide.c", "_narrow"))
    given = by_rule(F.col("host"), F.col("path"), rules)
    return found.select(
        "page_id", "host", "path", given["rule"].alias("rule"),
        F.coalesce(given["verdict"], F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence",
    )
