"""Document fingerprints from closed syncmers.

A text is read as tokens: runs of letters and digits, cut every eight characters,
and single signs; white space only separates. A stretch of K tokens is an anchor
if the least hash among its inner stretches of S tokens (the first of equal ones)
stands at its first or its last place. The choice looks at nothing outside the K
tokens, so a passage gives the same anchors wherever it stands, and any
2K - S - 1 tokens hold one at least. But a stretch whose first two inner stretches
are alike lies in a run of one token and is passed over.

The features of a text are its anchors' hashes, each with its distance from the
anchor before. They are matched by position within their surroundings: the
likeness of two texts is twice their common features over all, 0 to 1. A text
without an anchor is one anchor by itself; an empty text has none, and two empty
texts are alike. The fingerprint is the sequence of all features, four bytes each
(three of hash, one of distance modulo 256), in base64.

All is built-in expressions. The hashes of a text are one array, and a hash is
compared with the W - 1 after it, and with the W - 1 before it, until a smaller
one is met: two comparisons each on average.

A text whose end is replaced is not read anew: up to the cut it has the anchors of
its own text, and only the tokens from there on are looked at.

Neighbours in descending order of id are found without a global sort: sampled
rows split the order into parts, each part is sorted in its own task, and the row
that opens a part, being one of these rows, is also sent to the part before.
Only texts are shuffled; their anchors are made where they arrive.

Defined cases: null text is empty. Null ids come last in the order; rows of one
id go by the hash of their text. The next of the only row is this row itself. A run
of letters without an end is tokens of eight, counted from its beginning. An
empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import documents, shuffle_partitions

TOKEN = r"[\p{L}\p{N}\p{M}]{1,8}|[\p{P}\p{S}]"
K, S = 5, 2
W = K - S + 1
#: Last bits of a hash that hold its place in the text.
PLACE_BITS = 28
#: Bits of an anchor's hash that are kept; the place of an anchor stands above them.
HASH_BITS = 24
#: Parts per shuffle partition, and sampled rows per part that find where parts begin.
PARTS, SAMPLE = 4, 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _short_hash(*values: Column) -> Column:
    return F.xxhash64(*values).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def anchors(words: Column) -> Column:
    """All anchors of a token array in order: place * 2^HASH_BITS + hash."""
    def least(h: Column, step: int) -> Column:
        """The hashes below the W - 1 next ones in that direction; a missing one refuses."""
        below = lambda v, i: reduce(lambda rest, j: (v < F.get(h, i + step * j)) & rest,
                                    range(W - 2, 0, -1), v < F.get(h, i + step * (W - 1)))
        return F.filter(h, below)

    def chosen(t: Column, h: Column) -> Column:
        place = lambda v: v.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        at = F.array_union(F.transform(least(h, 1), place), F.transform(least(h, -1), lambda v: place(v) - (W - 1)))
        alike = lambda i: F.shiftright(h[i], PLACE_BITS) == F.shiftright(h[i + 1], PLACE_BITS)
        return F.transform(F.array_sort(F.filter(at, lambda i: ~alike(i))), lambda i: F.shiftleft(
            i.cast("long"), HASH_BITS).bitwiseOR(_short_hash(*[t[i + j] for j in range(K)])))

    # a hash carries its place in its last bits: no two are equal, and of equal ones the first is the least
    hashes = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - S), lambda i: F.xxhash64(*[t[i + j] for j in range(S)])
                                   .bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long")))
    return let(words, lambda t: F.when(F.size(t) < K, _none()).otherwise(let(hashes(t), lambda h: chosen(t, h))))


def features(found: Column, text: Column) -> Column:
    """The features of a text from its anchors: hash * 256 + distance from the anchor before."""
    place = lambda v: F.shiftright(v, HASH_BITS)
    near = F.transform(F.arrays_zip(found.alias("x"), F.concat(F.array(F.lit(0).cast("long")), found).alias("before")),
                       lambda z: z["x"].bitwiseAND(F.lit((1 << HASH_BITS) - 1)) * 256 + F.pmod(place(z["x"]) - place(z["before"]), F.lit(256)))
    near = F.slice(near, 1, F.size(found))
    return F.when(F.size(found) > 0, near).when(F.length(text) > 0, F.array(_short_hash(text) * 256)).otherwise(_none())


def fingerprint(marks: Column) -> Column:
    """The features as one string, four bytes each."""
    packed = F.unhex(F.array_join(F.transform(marks, lambda v: F.lpad(F.hex(v), 8, "0")), ""))
    return F.translate(F.base64(packed), "\r\n", "")


def likeness(x: Column, y: Column) -> Column:
    """Twice the distinct common features over all distinct features."""
    total = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y))
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def in_parts(rows: DataFrame, order: Column) -> DataFrame:
    """Deals rows into parts of ``order`` (a struct column that tells rows apart but for equal ones): adds _key,
    _part and _tail, which is true for the copy of the row that opens the next part (of the first row, in the last part)."""
    spark = rows.sparkSession
    parts = PARTS * shuffle_partitions(spark)
    rows = rows.withColumn("_key", order)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("first")).first()
    if not seen["n"]:
        return rows.select("*", F.lit(0).alias("_part"), F.lit(False).alias("_tail"))
    # a bounded sample of keys: SAMPLE for each part, whatever the input
    sample = sorted(tuple(r[0]) for r in rows.select("_key").sample(min(1.0, SAMPLE * parts / seen["n"]), seed=11).collect())
    first = tuple(seen["first"])
    splits = [first, *sorted({*sample[SAMPLE // 2::max(1, len(sample) // parts)]} - {first})]
    kind = rows.schema["_key"].dataType
    table = F.from_json(F.lit(json.dumps([dict(zip(kind.names, s)) for s in splits])), f"array<{kind.simpleString()}>")
    # the last split that doesn't come after a key, by halving
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splits).bit_length()))])
    part = F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s < len(splits)) & (F.get(table, at + s) <= F.col("_key")), at + s).otherwise(at))
    keys = (spark.range(1).select(F.posexplode(table).alias("i", "_head"))
            .select("_head", F.pmod(F.col("i") - 1, F.lit(len(splits))).cast("int").alias("_part")))
    own = rows.withColumn("_part", part).withColumn("_tail", F.lit(False))
    heads = (rows.join(F.broadcast(keys), F.col("_key") == F.col("_head")).dropDuplicates(["_part"])
             .withColumn("_tail", F.lit(True)).select(own.columns))
    return own.unionByName(heads)


def with_next(dealt: DataFrame, carry: list[str]) -> DataFrame:
    """Adds ``next``, the columns ``carry`` of the row that follows; after the last row comes the first."""
    following = Window.partitionBy("_part").orderBy("_tail", "_key")
    return (dealt.withColumn("next", F.lead(F.struct(*carry)).over(following))
            .filter("NOT _tail").drop("_key", "_part", "_tail"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text, marks (its features), and those of the next document and of the text
    whose last third is replaced by the next document's beginning: next_marks, edited, edited_marks."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("text"))
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))  # falls as the id rises
    dealt = in_parts(rows, F.struct(F.col("doc_id").isNull().alias("none"), down.alias("down"), F.xxhash64("text").alias("hash")))
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "_part")
    pairs = with_next(dealt.withColumn("found", anchors(tokens(F.col("text")))), ["text", "found"])
    n = F.length("text")
    own = n - F.floor(n / 3).cast("int")  # characters that stay
    taken = F.least((n - own), F.length("next.text"))
    pairs = pairs.select("doc_id", "text", "found", "next", own.alias("own"), taken.alias("taken"))
    pairs = pairs.select("*", F.substr("text", F.lit(1), F.col("own")).alias("head"), F.substr("next.text", F.lit(1), F.col("taken")).alias("tail"))
    # the last token that begins before the cut may go on beyond it
    same = F.greatest(F.regexp_count("head", F.lit(TOKEN)) - 1, F.lit(0))
    edited = F.concat("head", "tail")
    fresh = F.greatest(F.col("same") - (K - 1), F.lit(0))
    kept = F.filter("found", lambda v: F.shiftright(v, HASH_BITS) + K <= F.col("same"))
    rest = anchors(let(tokens(F.col("edited")), lambda t: F.slice(t, F.col("fresh") + 1, F.greatest(F.size(t) - F.col("fresh"), F.lit(0)))))
    moved = F.transform(rest, lambda v: v + F.shiftleft(F.col("fresh").cast("long"), HASH_BITS))
    pairs = pairs.select("*", edited.alias("edited"), same.alias("same")).select("*", fresh.alias("fresh"))
    return pairs.select(
        "doc_id", "text", features(F.col("found"), F.col("text")).alias("marks"),
        features(F.col("next.found"), F.col("next.text")).alias("next_marks"), "edited",
        F.concat(kept, moved).alias("edited_found")).select(
        "doc_id", "text", "marks", "next_marks", "edited", features(F.col("edited_found"), F.col("edited")).alias("edited_marks"))


def op12_syncmers(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and how near these and the next document are."""
    f = edited_fingerprints(documents(spark, sf_dir))
    return f.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                    fingerprint(F.col("marks")).alias("fingerprint"), fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
                    likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
                    likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))
