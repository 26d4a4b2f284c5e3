"""URL filters: fixed host/path rules first, then association rules mined with FP-growth.

Main path: DataFrame operations and Spark's own FP-growth only.

Defined results: a null url or one without `://` has empty host and path, fits no rule and has
no tokens, so it is allowed. Repeated rows are judged alike, each on its own; a page whose id has
several labels, or several rows, counts once for each pair of them in mining. Of fixed rules that
fit, the longest wins; of mined ones the best confidence, so ties do not matter. Very long urls are
read whole. Empty tables and empty labels give no mined rules, and everything without a fixed rule is
then allowed. Only the id and the url of a page are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A fixed rule: (host, path prefix, verdict). Its printed form is host + path.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; '' if there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; '' if there is no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits, else nulls.

    The rule list is a parameter of the job, a CASE tried from the longest rule down.
    """
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: `h:` each dotted suffix of the host (bare top level left out) and `p:` each
    path segment without digits' own value (a run of digits becomes 0)."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "0")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, segments)))


def token_items(sets: DataFrame) -> DataFrame:
    """(token, item): tokens that occur in the very same of the sets (tokens) share an item, their smallest token.

    Where they occur is compared by two 64-bit hashes over the distinct sets and their number.
    """
    rows = sets.select("tokens").distinct().select(F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"))
    where = rows.groupBy("token").agg(F.struct(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).alias("place"))
    return where.groupBy("place").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens")).select(F.explode("tokens").alias("token"), "item")


def to_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(set_key, tokens) of sets (set_key, tokens), each key once, with items in place of tokens; tokens without one go."""
    posts = sets.select("set_key", F.explode("tokens").alias("token")).join(items, "token")
    return posts.groupBy("set_key").agg(F.collect_set("item").alias("tokens"))


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.2, min_lift: float = 1.2) -> DataFrame:
    """Rules (tokens, confidence) that predict blocking, from labelled (tokens, blocked boolean).

    Kept: support >= min_support of all labelled urls, confidence >= min_confidence and at least
    min_lift times the share of blocked urls, whatever the number of tokens.
    """
    rows = labelled.where(F.col("blocked").isNotNull() & F.col("tokens").isNotNull())
    # the label is an item like the rest
    items = rows.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit("=block")))).otherwise(F.col("tokens")).alias("items"))
    items = items.where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    base = rows.agg(F.avg(F.col("blocked").cast("double")).alias("base"))
    return (
        model.associationRules.where(F.col("consequent") == F.array(F.lit("=block")))
        .crossJoin(F.broadcast(base))  # one row
        .where(F.col("confidence") >= min_lift * F.col("base"))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence")
    )


def drop_dominated(rules: DataFrame) -> DataFrame:
    """rules without those of which fewer tokens have at least the confidence.

    The shorter rule fits wherever the longer one does, so no url's best confidence changes.
    Pairs meet by the shorter rule's first token.
    """
    longer = rules.select(F.col("tokens").alias("long_tokens"), F.col("confidence").alias("long_confidence"), F.explode("tokens").alias("token"))
    shorter = rules.withColumn("token", F.get("tokens", F.lit(0)))
    dominated = longer.join(shorter, "token").where(
        (F.size("tokens") < F.size("long_tokens")) & (F.col("confidence") >= F.col("long_confidence")) & (F.size(F.array_except("tokens", "long_tokens")) == 0)
    )
    return rules.join(dominated.select(F.col("long_tokens").alias("tokens")).distinct(), "tokens", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Best confidence of a mined rule for each distinct token set of urls (columns set_key, tokens).

    Inverted index: a rule is posted under its rarest token, a url looks up each of its tokens and
    the rule's other tokens are then tested. Only distinct token sets are matched, so a hot host
    costs one lookup for each of its path shapes.
    """
    sets = urls.groupBy("set_key").agg(F.first("tokens").alias("tokens"))
    posts = sets.select("set_key", "tokens", F.explode("tokens").alias("token"))
    used = rules.select(F.explode("tokens").alias("token")).distinct()
    df = posts.join(used, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    index = (
        rules.withColumn("rule_tokens", F.col("tokens"))
        .select("rule_tokens", "confidence", F.explode("tokens").alias("token"))
        .join(df, "token")
        .groupBy("rule_tokens", "confidence")
        .agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    )
    return (
        posts.join(index, "token")
        .where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
        .groupBy("set_key")
        .agg(F.max("confidence").alias("confidence"))
    )


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", block_confidence: float = 0.5, **mining
) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages.

    labels: (id, blocked boolean), joined by id to learn which urls to block; null ids or labels
    teach nothing. verdict: the fixed rule's, else block if a mined rule of at least
    block_confidence matches (half its labelled urls or more are blocked), else allow.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_key"), host.alias("host"), path.alias("path")).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    keyed = urls.withColumn("set_key", F.md5(F.array_join(F.array_sort("tokens"), " ")))
    # tokens that always come together are one item, else m of them were 2^m combinations of one meaning
    known = keyed.join(labels.select(F.col("id").alias("page_key"), "blocked"), "page_key").select("set_key", "tokens", "blocked")
    items = materialise(token_items(known.where(F.col("blocked").isNotNull())), "url-items")
    merged = to_items(known.groupBy("set_key").agg(F.first("tokens").alias("tokens")), items)
    known = known.select("set_key", "blocked").join(merged, "set_key", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    # mined once, read several times
    mined = materialise(mine_rules(known, **mining).where(F.col("confidence") >= block_confidence), "url-rules")
    rules_left = drop_dominated(mined)
    used = items.join(rules_left.select(F.explode("tokens").alias("item")).distinct(), "item", "left_semi")
    sets = to_items(keyed.groupBy("set_key").agg(F.first("tokens").alias("tokens")), used)
    best = match_rules(sets, rules_left)
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return keyed.join(best, "set_key", "left").select(
        F.col("page_key").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
