"""Context-report text: market descriptions, prompts, query lines, sections.

Model calls are re-aimed as a frozen output table keyed by (event, purpose,
query line); a missing answer reads as the empty string. All text is built
with column expressions; per-event assembly orders its parts explicitly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline import params
from frostline.functions import text
from frostline.operators.reconcile import first_reports

# --- fixed values: text formats of the original report job ------------------
SINGLE_MARKET = (
    "Event title: {event_title}\n"
    "Title: {title}\n"
    "Subtitle: {yes_sub_title}\n"
    "Possible Outcomes: Yes (0) or No (1)\n"
    "Rules: {rules_primary}\n"
)
MARKET_ITEM = (
    "# Market {i}\n"
    "Ticker: {ticker}\n"
    "Title: {title}\n"
    "Subtitle: {yes_sub_title}\n"
    "Possible Outcomes: Yes (0) or No (1)\n"
    "Rules: {rules_primary}\n"
)
SECONDARY_RULES = "Secondary rules: {rules_secondary}\n"
CLOSE_DATE = "Scheduled close date: {expiration_time}\n"
QUERY_PROMPT = (
    "\n"
    "The following are markets under the event titled \"{event_title}\". \n"
    "\n"
    "{descriptions}\n"
    "\n"
    "# Instructions\n"
    "What are {num_queries} short search queries that would meaningfully improve the accuracy "
    "and confidence of a forecast regarding the market outcomes described above? \n"
    "Output exactly {num_queries} queries, one query per line, without any other text or number. \n"
    "Each query should be less than {max_words} words.\n"
    "Important Note: Do not include any numbers or special characters in the queries. "
    "Do not include any other text or explanation outside the queries.\n"
)
ARTICLE_ITEM = (
    "# Article {i}\n"
    "Title: {title}\n"
    "Body: {body}\n"
    "Source URL: {href}\n"
    "Full Content: {article}\n\n"
)
SUMMARY_PROMPT = (
    "\n"
    "The following are markets under the event titled \"{event_title}\".\n"
    "{descriptions}\n"
    "\n"
    "{articles}\n"
    "\n"
    "# Instructions\n"
    "Carefully read the articles provided above. Your task is to generate a multi-paragraph "
    "summary (one paragraph per article) that highlights factual insights or relevant context "
    "related to the listed markets. Avoid subjective opinions or speculative statements. Use "
    "plain text without markdown syntax, heading, or numbering. Do not add any additional text "
    "outside the summary.\n"
    "Return blank for an article that does not contain relevant information. Not all of the "
    "articles are relevant to the markets above. Some are clearly unrelated to the topic and "
    "should be excluded. Exclude only the articles that are clearly off-topic, entirely "
    "unrelated to the markets. If an article is at least broadly related or offers potentially "
    "useful context, it should be considered relevant.\n"
    "Important note: Include the date and source URL of the article at the end of each paragraph.\n"
)
SECTION = "# Research Report {i}\n{summary}"
SECTION_SEP = "\n\n"
# -----------------------------------------------------------------------------


def sql_literal(text_value: str) -> str:
    """A Spark SQL string literal for ``text_value``."""
    return "'" + text_value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def fill_sql(template: str, **exprs) -> str:
    """SQL ``concat`` of ``template`` with ``{name}`` replaced by SQL expressions
    (strings) or literal values (numbers); NULL reads as the empty string."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}"):
            v = exprs[piece[1:-1]]
            sql = v if isinstance(v, str) else sql_literal(str(v))
            parts.append(f"coalesce(cast(({sql}) as string), '')")
        else:
            parts.append(sql_literal(piece))
    return "concat(" + ", ".join(parts) + ")"


def fill(template: str, **exprs) -> Column:
    """``template`` filled from SQL expressions, as one column expression."""
    return F.expr(fill_sql(template, **exprs))


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


DESCRIPTION_FIELDS = ("ticker", "title", "yes_sub_title", "rules_primary", "rules_secondary", "expiration_time")


def market_fields(fields, col: str = "markets") -> Column:
    """The markets array reduced to ``fields`` (array of structs, same order).

    Built from per-field array extractions (``markets.title`` ...), which the
    parquet reader can prune to the named leaves; lambda access to the whole
    struct would read every field of every market.
    """
    return F.arrays_zip(*[F.col(f"{col}.{f}").alias(f) for f in fields])


def _tail_sql(m: str) -> str:
    secondary = fill_sql(SECONDARY_RULES, rules_secondary=f"{m}.rules_secondary")
    close = fill_sql(CLOSE_DATE, expiration_time=f"{m}.expiration_time")
    return (f"concat(case when coalesce({m}.rules_secondary, '') <> '' then {secondary} else '' end, "
            f"{close})")


def descriptions(details: DataFrame) -> DataFrame:
    """``event_ticker, event_title, description`` from the event detail.

    One market: the single-market form led by the event title. Several: one
    numbered block per market, each followed by a blank line. None: empty.
    """
    single = fill_sql(SINGLE_MARKET, event_title="title", title="_ms[0].title",
                      yes_sub_title="_ms[0].yes_sub_title", rules_primary="_ms[0].rules_primary")
    item = fill_sql(MARKET_ITEM, i="i + 1", ticker="m.ticker", title="m.title",
                    yes_sub_title="m.yes_sub_title", rules_primary="m.rules_primary")
    text_sql = (f"case when size(_ms) = 1 then concat({single}, {_tail_sql('_ms[0]')}) "
                f"else array_join(transform(_ms, (m, i) -> concat({item}, {_tail_sql('m')}, '\\n')), '') end")
    return (details.select("event_ticker", "title",
                           F.coalesce(market_fields(DESCRIPTION_FIELDS), F.array()).alias("_ms"))
            .select("event_ticker", F.col("title").alias("event_title"), F.expr(text_sql).alias("description")))


def query_prompts(desc: DataFrame, num_queries: int = params.NUM_QUERIES,
                  max_words: int = params.MAX_QUERY_WORDS) -> DataFrame:
    return desc.select("event_ticker", fill(QUERY_PROMPT, event_title="event_title", descriptions="description",
                                            num_queries=num_queries, max_words=max_words).alias("prompt"))


def answer(outputs: DataFrame, purpose: str) -> DataFrame:
    """Frozen model answers for one purpose, trimmed; ``event_ticker, query_no, answer``."""
    return (outputs.where(F.col("purpose") == purpose)
            .select("event_ticker", "query_no",
                    text.py_strip(F.coalesce("completion", F.lit(""))).alias("answer")))


def query_lines(events: DataFrame, outputs: DataFrame) -> DataFrame:
    """Search queries of each event: every non-blank answer line, numbered from 1."""
    ans = answer(outputs, "queries").select("event_ticker", "answer")
    got = events.select("event_ticker").join(ans, "event_ticker", "left")
    return got.select("event_ticker", F.posexplode(text.nonblank_lines("answer")).alias("pos", "query")) \
              .select("event_ticker", (F.col("pos") + 1).cast("bigint").alias("query_no"), "query")


def article_blocks(top: DataFrame) -> DataFrame:
    """``event_ticker, query_no, articles``: the numbered article blocks of a
    query's top articles, in rank order (at most ``num_urls`` per query)."""
    block = fill(ARTICLE_ITEM, i="article_no", title="title", body="body", href="href", article="article")
    return (top.select("event_ticker", "query_no", F.struct("article_no", block.alias("b")).alias("x"))
            .groupBy("event_ticker", "query_no")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "")
                 .alias("articles")))


def summary_prompts(queries: DataFrame, desc: DataFrame, top: DataFrame) -> DataFrame:
    """One summary prompt per query line; a query without articles still gets one."""
    blocks = article_blocks(top)
    j = (queries.select("event_ticker", "query_no")
         .join(desc, "event_ticker")
         .join(blocks, ["event_ticker", "query_no"], "left"))
    return j.select("event_ticker", "query_no",
                    fill(SUMMARY_PROMPT, event_title="event_title", descriptions="description",
                         articles="articles").alias("prompt"))


def reports(queries: DataFrame, outputs: DataFrame, events: DataFrame) -> DataFrame:
    """``event_ticker, report``: one section per query line (summary or empty),
    joined by a blank line and trimmed. An event without queries gets ''.

    The sections gathered per event are the report itself: one per query line
    of that event's answer (a few lines), never rows of other events."""
    summ = answer(outputs, "summary")
    sec = (queries.join(summ, ["event_ticker", "query_no"], "left")
           .select("event_ticker", F.struct("query_no", fill(SECTION, i="query_no",
                                                             summary="answer").alias("s")).alias("x")))
    per_event = (sec.groupBy("event_ticker")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]),
                                   SECTION_SEP).alias("_r")))
    return (events.select("event_ticker").join(per_event, "event_ticker", "left")
            .select("event_ticker", text.py_strip(F.coalesce("_r", F.lit(""))).alias("report")))


def with_markets(details: DataFrame) -> DataFrame:
    """Event details that have at least one market (the rest cannot be described)."""
    return details.where(F.col("markets.ticker").isNotNull() & (F.size("markets.ticker") > 0))


def pending_events(sample: DataFrame, stored: DataFrame, details: DataFrame, stamp: str) -> DataFrame:
    """Sampled events still to report today: no first document with a
    non-empty report for ``stamp``, and a detail record with markets."""
    done = (first_reports(stored, [stamp]).where(_truthy(F.col("report")))
            .select("event_ticker"))
    return (sample.join(done, "event_ticker", "left_anti")
            .join(with_markets(details).select("event_ticker"), "event_ticker", "left_semi"))
