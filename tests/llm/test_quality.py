import re
from collections import Counter

from pyspark.sql import functions as F

from frostline.llm import quality as Q


def base(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


PROSE = "The river and the hills lie in the mist of morning and a boat is going to the far side with its lamps lit, for it is still dark."


def test_measures_against_plain_python(spark):
    texts = [None, "", "   \n\t ", "one", PROSE, PROSE + "\n" + PROSE, "a b c d e f g h " * 9, "ab " * 500, "x" * 30000, "### *** |a| <b>\n\n### *** |a| <b>",
             "é è\x0bü\x0cß\r\nz y", " ".join(map(str, range(3000))) * 2]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, PROSE)], "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as kept")
    m = F.col("_m")
    got = Q.measures(docs).select("doc_id", m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]).collect()
    for r in got:
        assert tuple(r)[1:] == base(PROSE if r[0] is None else texts[r[0]])


def test_verdicts_and_columns(spark):
    rows = [(1, PROSE * 2), (2, None), (3, "word%%% sign$$$ " * 30 + PROSE), (4, PROSE.replace(" ", " | ")), (5, PROSE), (5, PROSE),
            (6, " ".join(w + " " + w + " " + w for w in PROSE.split()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "1 as `_keep.x`")
    got = Q.keep_good(docs)
    assert got.columns == docs.columns
    assert [r.doc_id for r in got.orderBy("doc_id").collect()] == [5, 5]
    assert Q.keep_good(docs.limit(0)).count() == 0
