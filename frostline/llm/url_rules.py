"""URL filtering by given rules and by mined association rules.

Given rules (host and path beginning) decide the urls they fit; their verdicts
are the labels. For the other urls, FP-growth mines token combinations of the
labelled urls together with their verdict; combinations that lead to ``block``
with enough support and confidence are rules, without those that hold a
smaller rule. An inverted index has each rule under its rarest token; a url
that holds the token and all others of the rule is blocked, the rest allowed.

Tokens of a url are its host's labels, its path's parts and its query's keys.
Rules of one token come straight from the tokens' counts. FP-growth gets, whole,
the other tokens that a minimal rule can hold: in enough blocked urls, not in all
allowed ones (such a token excludes no url), and one of each set of tokens that the
labelled urls always hold together; in matching, any of the set stands for it. The
number of these tokens is bounded by the support, that of their combinations isn't:
see the README.

Everything is DataFrame and SQL functions and the FP-growth of Spark.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule and is allowed. With no labelled url, or none blocked, nothing is
mined and all others are allowed. Null page ids and repeated rows are rows like
others. Columns other than id and url are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import settle

#: Support as a share of the labelled urls, and in urls at least.
MIN_SUPPORT, MIN_URLS = 0.005, 10
MIN_CONFIDENCE = 0.9
BLOCKED = "=block"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path and the url's distinct tokens."""
    at = F.instr(F.col("url"), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    query = F.regexp_extract(F.col("_after"), r"^[^?#]*\?([^#]*)", 1)
    named = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return (pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"))
            .withColumn("_rest", F.coalesce(rest, F.lit("")))
            .withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
            .withColumn("_after", F.expr("substring(_rest, length(_host) + 1)"))
            .select("page_id", "url", F.translate("_host", UPPER, LOWER).alias("host"),
                    F.regexp_extract("_after", "^[^?#]*", 0).alias("path"), query.alias("_query"))
            .select("page_id", "url", "host", "path", F.array_distinct(F.concat(
                named("host:", F.split("host", r"\.")), named("path:", F.split("path", "/")),
                named("key:", F.transform(F.split("_query", "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))))).alias("tokens")))


def fitting(rules: tuple[HostRule, ...], value) -> Column:
    """``value`` of the longest rule that fits a row's host and path, else null."""
    found = F
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        found = found.when(fits, value(r))
    return found


def alike(baskets: DataFrame, counts: list) -> dict[str, str]:
    """token -> the first token that exactly the same rows (items) hold, for tokens that aren't the first."""
    sets = settle(baskets.distinct(), "url-sets")
    marks = {r["token"]: r[1:] for r in sets.select(F.explode("items").alias("token"), F.xxhash64("items").alias("a"), F.xxhash64(F.lit("b"), "items").alias("b"))
             .groupBy("token").agg(F.bit_xor("a"), F.bit_xor("b")).collect()}
    firsts, same = {}, {}
    for r in sorted(counts, key=lambda r: r["token"]):
        first = firsts.setdefault((r["count"], r["bad"], *marks[r["token"]]), r["token"])
        if first != r["token"]:
            same[r["token"]] = first
    if same:  # marks may meet by chance: both tokens are in as many rows, so none may be without the first
        apart = (sets.select("items", F.explode("items").alias("token")).withColumn("first", named_by(same, F.col("token")))
                 .filter(~F.array_contains("items", F.col("first"))).select("token").distinct().collect())
        for r in apart:
            del same[r["token"]]
    return same


def named_by(same: dict[str, str], token: Column) -> Column:
    """The token that stands for ``token``."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in same.items() for x in pair]), token), token) if same else token


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         min_urls: int = MIN_URLS) -> tuple[DataFrame, dict[str, str]] | None:
    """(first, needs) of the minimal blocking rules among rows (tokens, label), a rule and its rarest
    token; and the tokens for which another stands in the rules."""
    total = labelled.count()
    blocked = labelled.filter(F.col("label") == "block").count()
    if not blocked:
        return None
    bad = (F.col("label") == "block").cast("int")
    counts = settle(labelled.select(F.explode("tokens").alias("token"), bad.alias("bad"))
                    .groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.sum("bad").alias("bad")), "url-tokens")
    need = ceil(max(min_support * total, min(total, min_urls)))
    sure = F.col("bad") / F.col("count") >= min_confidence
    enough = counts.filter(F.col("bad") >= need)
    single = enough.filter(sure).select(F.col("token").alias("first"), F.array("token").alias("needs"))
    # enough tokens number at most the mean tokens of a url over the support
    able = enough.filter(~sure & (F.col("count") - F.col("bad") < total - blocked)).collect()
    if not able:
        return settle(single, "url-index"), {}
    held = lambda tokens: F.array_intersect(F.array(*[F.lit(t) for t in tokens]), F.col("tokens"))
    same = alike(labelled.select(held(sorted(r["token"] for r in able)).alias("items")), able)
    baskets = labelled.select(F.concat(held(sorted(r["token"] for r in able if r["token"] not in same)),
                                       F.when(F.col("label") == "block", F.array(F.lit(BLOCKED)))
                                       .otherwise(F.array().cast("array<string>"))).alias("items"))
    # half a url less, as the product with the number of urls is rounded up
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / total, minConfidence=min_confidence,
                     numPartitions=int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    rules = (model.associationRules.filter(F.col("consequent")[0] == BLOCKED)
             .select(F.array_sort("antecedent").alias("tokens")).withColumn("rule", F.concat_ws("\t", "tokens")))
    rules = settle(rules, "url-rules")
    # drop a rule that holds all tokens of a smaller one
    long = rules.select(F.col("rule").alias("long"), F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    short = rules.select(F.col("rule").alias("short"), F.size("tokens").alias("m"), F.explode("tokens").alias("s_token"))
    redundant = (long.join(short, (F.col("token") == F.col("s_token")) & (F.col("n") > F.col("m")))
                 .groupBy("long", "short", "m").count().filter(F.col("count") == F.col("m")).select(F.col("long").alias("rule")))
    minimal = rules.join(redundant, "rule", "left_anti")
    rank = minimal.select("rule", "tokens", F.explode("tokens").alias("token")).join(counts.select("token", "count"), "token")
    return settle(rank.groupBy("rule").agg(F.min_by("token", F.struct("count", "token")).alias("first"), F.first("tokens").alias("needs"))
                  .select("first", "needs").union(single), "url-index"), same


def judge(pages: DataFrame, rules: tuple[HostRule, ...] = RULES, min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits) and verdict."""
    rows = parts(pages).withColumn("rule", fitting(rules, lambda r: F.lit(r.text))).withColumn("label", fitting(rules, lambda r: F.lit(r.verdict)))
    mined = mine(settle(rows.filter("label IS NOT NULL").select("tokens", "label"), "url-labels"), min_support, min_confidence, min_urls)
    other = F.lit("allow")
    if mined is not None:
        index, same = mined
        known = F.array_distinct(F.transform("tokens", lambda x: named_by(same, x)))
        holds = F.size(F.array_intersect("needs", "tokens")) == F.size("needs")
        bad = (rows.filter("label IS NULL").select("url", known.alias("tokens")).select("url", "tokens", F.explode("tokens").alias("token"))
               .join(index, (F.col("token") == F.col("first")) & holds).select(F.col("url").alias("bad_url")).distinct())
        rows = rows.join(bad, F.col("label").isNull() & (F.col("url") == F.col("bad_url")), "left")
        other = F.when(F.col("bad_url").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("label", other).alias("verdict"))


def op9_association_rules(spark, sf_dir):
    """A verdict for every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
