"""URL filters by association rules.

Explicit (host, path) rules judge a part of the urls; those verdicts are the labels. FP-growth mines
combinations of url tokens that go with the label ``block`` or ``allow``; rules pruned by support, confidence
and redundancy form an inverted index from tokens to rules. A rule fires on a url that has all its tokens;
the best firing rule gives the verdict of urls that no explicit rule fits, ``allow`` where none fires.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

# The explicit rules.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: Mined antecedents hold this many tokens at most.
MAX_TOKENS = 3
#: An inverted index of up to this many postings is broadcast; a larger one is joined by shuffle, salted.
BROADCAST_POSTINGS = 50_000
SALTS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lowered; path: then up to ``?`` or ``#``."""
    found = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found, lower).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit(""))


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host suffixes and labels, first path parts, shapes of numbers, scheme, query keys."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda k: F.concat(F.lit("q:"), k))
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
            F.transform(parts, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "0"))),
            F.transform(F.filter(parts, lambda x: x.rlike("^[0-9]")), lambda x: F.concat(F.lit("n:"), F.substring(x, 1, 1))),
            F.array(F.concat(F.lit("s:"), F.coalesce(F.substring_index(url, "://", 1), F.lit("")))),
            F.coalesce(keys, F.array().cast("array<string>")),
        )
    )


def merged_tokens(labelled: DataFrame, least: float) -> DataFrame:
    """``(tokens, verdict)`` with rare tokens left out, and of tokens that stand in the same rows only the first by name.

    Itemsets of such companions number two to the power of their count, though they all say the same: their support and
    confidence are those of the first. Rows are told apart by a hash of their place, summed for every token."""
    rows = materialize(labelled.withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "url-labelled")
    each = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("rows"))
    first = each.filter(F.col("n") >= least).groupBy("n", "rows").agg(F.min("token").alias("token"))
    # at most the mean number of tokens in a row, divided by the support
    frequent = [r["token"] for r in first.orderBy("token").collect()]
    return rows.select(F.array_intersect("tokens", F.array(*[F.lit(t) for t in frequent]).cast("array<string>")).alias("tokens"), "verdict")


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, lift: float = 1.2) -> DataFrame:
    """``(rule_id, antecedent, verdict, confidence, support)`` from ``(tokens, verdict)`` rows.

    Kept rules lead to a verdict with the confidence and beat its base rate by ``lift``; a rule is dropped if
    a part of its antecedent has at least its confidence. Mined rules number at most the itemsets of the
    given support, however many rows there are.
    """
    n = labelled.count()
    if n == 0:
        return labelled.sparkSession.createDataFrame([], "rule_id bigint, antecedent array<string>, verdict string, confidence double, support double")
    basket = merged_tokens(labelled, min_support * n).select(F.concat("tokens", F.array(F.concat(F.lit("label="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(basket)
    mined = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit("label="))).filter(F.size("antecedent") <= MAX_TOKENS)
    mined = mined.filter(~F.exists("antecedent", lambda x: F.startswith(x, F.lit("label=")))).filter(F.coalesce("lift", F.lit(99.0)) >= lift)
    mined = mined.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 7, 99).alias("verdict"), "confidence", "support")
    mined = materialize(mined, "url-mined")
    shorter = mined.select(F.col("antecedent").alias("__part"), F.col("verdict").alias("__verdict"), F.col("confidence").alias("__confidence"))
    # the proper parts of an antecedent of up to MAX_TOKENS tokens: leave out one or two
    a = F.col("antecedent")
    one = F.transform(a, lambda x: F.array(x))
    without = F.transform(a, lambda x: F.filter(a, lambda y: y != x))
    parts = F.filter(F.array_distinct(F.concat(one, without)), lambda p: (F.size(p) > 0) & (F.size(p) < F.size(a)))
    weaker = mined.withColumn("__part", F.explode(parts)).join(shorter, "__part").filter("verdict = __verdict AND __confidence >= confidence").select("antecedent", "verdict").distinct()
    kept = mined.join(weaker, ["antecedent", "verdict"], "left_anti")
    return kept.withColumn("rule_id", F.xxhash64(F.concat_ws(" ", "antecedent"), "verdict"))


def fired_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The best firing rule of each token set: ``(token_key, mined)`` for ``(token_key, tokens)`` rows.

    Rules stand in an inverted index from token to rule; a rule whose tokens all met fires. The best one has
    the highest confidence, then support, then the lowest id."""
    postings = materialize(rules.select("rule_id", F.size("antecedent").alias("need"), "verdict", "confidence", "support", F.explode("antecedent").alias("token")), "url-postings")
    tokens = urls.select("token_key", F.explode("tokens").alias("token"))
    if postings.count() <= BROADCAST_POSTINGS:
        met = tokens.join(F.broadcast(postings), "token")
    else:
        spread = postings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = tokens.withColumn("salt", F.pmod("token_key", F.lit(SALTS)).cast("int")).join(spread, ["token", "salt"])
    full = met.groupBy("token_key", "rule_id", "need", "verdict", "confidence", "support").agg(F.count(F.lit(1)).alias("got")).filter("got = need")
    best = F.max_by(F.struct("verdict", "confidence", "rule_id"), F.struct("confidence", "support", -F.col("rule_id")))
    return full.groupBy("token_key").agg(best.alias("mined"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``mined_confidence`` for every row.

    A null url, or one without ``://``, has an empty host and path; no explicit rule fits it. Repeated rows stay,
    each with its verdict. Without labelled urls nothing is mined and the rest is allowed. Other columns aren't
    read. An empty table gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("explicit", explicit_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    parsed = materialize(parsed.withColumn("token_key", F.xxhash64(F.array_join(F.array_sort("tokens"), " "))).drop("url"), "url-parsed")
    mined = mine_rules(parsed.filter("explicit IS NOT NULL").select("tokens", F.col("explicit.verdict").alias("verdict")), min_support, min_confidence)
    # equal token sets are judged once; the shuffle on a hot set is pre-aggregated
    sets = parsed.filter("explicit IS NULL").groupBy("token_key").agg(F.first("tokens").alias("tokens"))
    fired = materialize(fired_rules(sets, mined), "url-fired")
    # one row for each set of tokens; a hot set's urls needn't move where these are few
    few = F.broadcast(fired) if fired.count() <= BROADCAST_POSTINGS else fired
    judged = parsed.filter("explicit IS NULL").join(few, "token_key", "left")
    rest = judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined.verdict", F.lit("allow")).alias("verdict"), F.col("mined.confidence").alias("mined_confidence"))
    known = parsed.filter("explicit IS NOT NULL").select("page_id", "host", "path", F.col("explicit.rule").alias("rule"), F.col("explicit.verdict").alias("verdict"), F.lit(None).cast("double").alias("mined_confidence"))
    return known.unionByName(rest)
