"""Quality rules: a table of thresholds compiled into one Spark projection.

A rule bounds one measure of a text from below or above; a text is kept if it
passes the base rules and every rule of the table. All measures are built-in
functions over the text, its words and its lines: nothing leaves the JVM.

Words are runs of characters other than [\\x20\\x09-\\x0D]. Eight-word windows
are compared by 64-bit hashes within one text.

Defined cases: a null text has no words and is rejected; a very long text is
measured whole; rows of equal id or text are judged one by one. Columns of the
input other than the text play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import BLANKS, WORD_BREAK, documents

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the corpus languages, as they stand in running text.
STOP_WORDS = ("the of and to in is that for it with as was on are "
              "der die das und ist den von zu mit nicht "
              "le la les de des et est un une que du "
              "el los las en por con para del y").split()


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0  # shorter texts are not held to this rule


#: Base rules of the contract, in whole numbers so that no rounding decides.
MIN_WORDS, REPEAT_PERCENT = 20, 30

#: The threshold table. Measures are ratios, so a bound means the same for any length.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("stutter", "stutter_ratio", None, 0.2),
    Rule("stop_words", "stop_word_ratio", 0.01, 0.75, from_words=100),
)


def doubled(column: str, step: int) -> Column:
    """Hashes of runs twice as long: each entry with the one ``step`` later."""
    n = F.greatest(F.size(column) - step, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, step + 1, n), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``_m`` of counts and ratios of ``text``."""
    blanks = F.lit(BLANKS.decode())
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), blanks)
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_BREAK))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Staged so that each array is made once per row and then referred to by column.
    staged = docs.withColumns({"_w": words, "_l": lines})
    staged = staged.withColumns({"_h": F.transform("_w", lambda w: F.xxhash64(w)), "_n": F.size("_w")})
    for of, to, step in (("_h", "_h2", 1), ("_h2", "_h4", 2), ("_h4", "_win", WINDOW // 2)):
        staged = staged.withColumn(to, doubled(of, step))
    # (hash, start) pairs in order, only for texts that repeat a window at all
    pairs = F.when(F.size(F.array_distinct("_win")) < F.size("_win"),
                   F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    staged = staged.withColumn("_pairs", F.coalesce(pairs, F.array().cast("array<struct<h:bigint,i:int>>")))
    repeated = F.filter("_pairs", lambda p, j: (F.get(F.col("_pairs"), j - 1)["h"] == p["h"]).eqNullSafe(True)
                        | (F.get(F.col("_pairs"), j + 1)["h"] == p["h"]).eqNullSafe(True))
    begin = F.sort_array(F.transform(repeated, lambda p: p["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"))
    covered = F.aggregate(begin, zero, lambda a, i: F.struct(
        (i + WINDOW).alias("end"), (a["covered"] + i + WINDOW - F.greatest(a["end"], i)).alias("covered")), lambda a: a["covered"])
    raw = F.coalesce(F.col(text), F.lit(""))
    staged = staged.withColumn("_c", F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.regexp_replace(raw, WORD_BREAK, "")).cast("long").alias("word_chars"),
        (F.length(raw) - F.length(F.regexp_replace(raw, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter(F.zip_with(F.slice("_h", 1, F.greatest(F.col("_n") - 1, F.lit(0))), F.slice("_h", 2, F.greatest(F.col("_n") - 1, F.lit(0))),
                                   lambda a, b: a == b), lambda x: x)).cast("long").alias("n_stutters"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words")))
    c, of = F.col("_c"), lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    ratios = {"mean_word_chars": of(c["word_chars"], c["n_words"]), "symbols_per_word": of(c["n_symbols"], c["n_words"]),
              "dup_line_ratio": of(c["n_dup_lines"], c["n_lines"]), "stop_word_ratio": of(c["n_stop_words"], c["n_words"]),
              "stutter_ratio": of(c["n_stutters"], c["n_words"])}
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters", "n_stop_words")
    return (staged.withColumn("_m", F.struct(*[c[n].alias(n) for n in names], *[e.alias(n) for n, e in ratios.items()]))
            .drop("_w", "_l", "_h", "_n", "_h2", "_h4", "_win", "_pairs", "_c"))


def base_failed() -> Column:
    m = F.col("_m")
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def passes(rules=RULES) -> Column:
    """The table as one boolean expression over ``_m``."""
    verdict = F.lit(True)
    for r in rules:
        exempt, value = F.col("_m")["n_words"] < r.from_words, F.col("_m")[r.measure]
        if r.least is not None:
            verdict = verdict & (exempt | (value >= r.least))
        if r.most is not None:
            verdict = verdict & (exempt | (value <= r.most))
    return verdict


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    # the row travels as one column, so that no column of its own can clash
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    judged = measures(rows).withColumn("_keep", ~base_failed() & passes(rules))
    # The row number keeps the verdict in the projection: as a filter below it, each
    # reference to a measure would be replaced by the measure's whole expression.
    judged = judged.withColumn("_row", F.monotonically_increasing_id())
    return judged.filter(F.col("_keep") & (F.col("_row") >= 0)).select("doc.*")


def op2_quality_rules(spark, sf_dir):
    """Measures and verdict of every document."""
    m = F.col("_m")
    return (measures(documents(spark, sf_dir).select("doc_id", "text"))
            .select("doc_id", *[m[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    base_failed().alias("base_failed"), (~base_failed() & passes()).alias("kept"),
                    m["n_stop_words"].alias("n_stop_words")))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
g AS (
  SELECT *, [array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)] AS g FROM w),
p AS (
  SELECT doc_id, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS x FROM g),
c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM p),
e AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS covered FROM c WHERE n > 1),
r AS (
  SELECT doc_id, sum(covered)::BIGINT AS n_repeat_words FROM e GROUP BY doc_id),
m AS (
  SELECT g.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutters,
         len(list_filter(w, lambda x: list_contains([STOPS], lower(x))))::BIGINT AS n_stop_words
  FROM g LEFT JOIN r USING (doc_id)),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         coalesce(word_chars / nullif(n_words, 0), 0) AS wc, coalesce(n_symbols / nullif(n_words, 0), 0) AS sr,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dl, coalesce(n_stop_words / nullif(n_words, 0), 0) AS sw,
         coalesce(n_stutters / nullif(n_words, 0), 0) AS st
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND wc >= 2 AND wc <= 14 AND sr <= 0.1 AND dl <= 0.5 AND st <= 0.2
         AND (n_words < 100 OR (sw >= 0.01 AND sw <= 0.75)) AS kept, n_stop_words
FROM v
""".replace("STOPS", ", ".join(f"'{x}'" for x in STOP_WORDS))
