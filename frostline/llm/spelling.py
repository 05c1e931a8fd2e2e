"""Spelling variant grouping with a bit-sliced position index.

The index holds, for each (position, letter), the set of words with that letter
there, as the bits of one integer. A word is looked up letter by letter: the
set of words without an error so far and the sets with one error (replaced,
inserted, deleted) are carried along together, an inserted or deleted letter
shifting the position that is read by one. All words of the index advance by
the same few bit operations.

No word meets the whole vocabulary. Of two words that differ by one letter,
the shorter of length m, either the first m // 2 letters agree or the last
m - m // 2 do; so words meet in buckets of one beginning or one ending, for each
m. A pair that agrees in both is counted in the bucket of its beginning alone:
in the other one the words without an error in the first m // 2 letters are
taken out. Buckets of more than TILE words are cut into tiles, and each pair
of tiles is a group of its own; a group holds one tile as an index and lets
the words of the other pass.

Within an index words stand in falling order of their counts (ties: code-point
order), so the most frequent near word is the lowest bit that is set, and a
word sends one row per group, whatever the number of its near words.

A word's form is its most frequent near word, if that is ``ratio`` times as frequent
at least. Forms grow in frequency, so chains are short; roots are found by
doubling the steps.

Defined cases: null or empty text has no words. A null id counts as the empty
text in the id's hash; rows that share an id are rows of their own. Very long
words are words like others. An empty table gives no rows. Columns other than
id and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import binary_values, byte_slices, documents, settle, shuffle_partitions

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Words of one index: the bits of its integers.
TILE = 2048
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000


def count_words(min_chars: int, damaged: int | None):
    """(word, n) of the runs of letters of ``min_chars`` at least. One in ``damaged`` (document, word) loses a letter."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            words = [w for w in held if len(w) >= min_chars]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for b in byte_slices(batches, "text"):
            for doc, text in zip(b.column("doc_id").to_pylist(), binary_values(b.column("text"))):
                if not text:
                    continue
                found = Counter(runs.findall(text.lower().decode("utf-8", "replace")))
                if damaged:
                    before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for w in [w for w in found if not zlib.crc32(w.encode(), before) % damaged]:
                        at = zlib.crc32(w.encode(), before) % len(w)
                        held[w[:at] + w[at + 1:]] += found.pop(w)
                held.update(found)
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()
    return run


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damaged: int | None = None,
                id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of ``min_chars`` letters and ``min_count`` occurrences at least."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(count_words(min_chars, damaged), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


class PositionIndex:
    """Words of lengths m and m + 1 as bits, one set for each (position, letter)."""

    def __init__(self, words: list[str], m: int):
        self.m, self.all = m, (1 << len(words)) - 1
        self.at: dict[tuple[int, str], int] = {}
        self.of_length = {m - 1: 0, m: 0, m + 1: 0, m + 2: 0}
        bit = 1
        for w in words:
            self.of_length[len(w)] |= bit
            for place in enumerate(w):
                self.at[place] = self.at.get(place, 0) | bit
            bit <<= 1

    def near(self, word: str, ending: bool) -> int:
        """The words one error away, m letters long in the shorter of both; ``ending``: without those
        that agree in the first m // 2 letters."""
        at, common = self.at.get, self.m // 2
        exact, replaced, longer, shorter, start = self.all, 0, 0, 0, 0
        for j, c in enumerate(word):
            if j == common:
                start = exact
            here = at((j, c), 0)
            longer = (longer | exact) & at((j + 1, c), 0)  # the indexed word has a letter more
            shorter = shorter & at((j - 1, c), 0) | exact  # it lacks this one, or lacked one before
            replaced = replaced & here | exact & ~here
            exact &= here
        n = len(word)
        if n == self.m:
            found = replaced & self.of_length[n] | (longer | exact) & self.of_length[n + 1]
        else:
            found = shorter & self.of_length[n - 1]
        return found & ~start if ending else found


def _lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: the words of its index (kind 0, falling counts), then the words that pass it."""
    keys = ("m", "ending", "part", "tile", "other")
    now, words, counts, index = None, [], [], None
    out: tuple[list, ...] = ([], [], [], [])

    def look(word: str) -> None:
        found = index.near(word, now[1])
        if found:
            best = (found & -found).bit_length() - 1
            for o, v in zip(out, (word, found.bit_count(), counts[best], words[best])):
                o.append(v)

    def build() -> None:
        nonlocal index
        index = PositionIndex(words, now[0])
        if now[3] == now[4]:
            for w in words:
                look(w)

    def done() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=["word", "n_near", "form_n", "form"])
        for o in out:
            o.clear()
        return made

    for b in batches:
        for *group, kind, word, n in zip(*(b.column(c).to_pylist() for c in (*keys, "kind", "word", "n"))):
            if group != now:
                if words and index is None:
                    build()
                now, words, counts, index = group, [], [], None
            if kind == 0:
                words.append(word)
                counts.append(n)
            elif words:
                if index is None:
                    build()
                look(word)
        yield done()
    if words and index is None:
        build()
    yield done()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): for each word of ``words`` (word, n) with near ones their number and the most frequent."""
    spark = words.sparkSession
    length = F.length("word")
    # a word is the shorter (or as long) of a pair, or the longer one
    sides = F.explode(F.array(F.struct(length.alias("m"), F.lit(False).alias("ending")), F.struct(length.alias("m"), F.lit(True).alias("ending")),
                              F.struct((length - 1).alias("m"), F.lit(False).alias("ending")), F.struct((length - 1).alias("m"), F.lit(True).alias("ending"))))
    common = F.floor(F.col("m") / 2).cast("int")
    part = F.when(F.col("ending"), F.right("word", F.col("m") - common)).otherwise(F.left("word", common))
    bucket = ["m", "ending", "part"]
    rows = settle(words.select("word", "n", sides.alias("s")).select("word", "n", "s.*").withColumn("part", part), "buckets")
    # a bucket without a word of m letters holds no pair
    sizes = (rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"), F.min(F.length("word")).alias("least"))
             .filter("size > 1 AND least = m").select(*bucket, F.ceil(F.col("size") / TILE).cast("int").alias("tiles")))
    tiled = rows.join(sizes, bucket).withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    held = tiled.select(*bucket, F.col("own").alias("tile"), every.alias("other"), F.lit(0).alias("kind"), "word", "n")
    passing = (tiled.filter("tiles > 1").select(*bucket, every.alias("tile"), F.col("own").alias("other"), F.lit(1).alias("kind"), "word", "n")
               .filter("tile <> other"))
    group = [*bucket, "tile", "other"]
    found = (held.unionByName(passing).repartition(shuffle_partitions(spark), *group)
             .sortWithinPartitions(*group, "kind", F.desc("n"), "word")
             .mapInArrow(_lookups, "word string, n_near long, form_n long, form string"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("k"), "form")).alias("f"))
            .select("word", "n_near", (-F.col("f.k")).alias("form_n"), "f.form"))


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``words`` (word, n): word, n, n_near, form, form_n, root."""
    words = settle(words, "vocabulary")
    near = words.join(near_words(words), "word", "left")
    formed = F.col("form_n") >= ratio * F.col("n")
    near = settle(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                              F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "near-words")
    steps = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # each step multiplies the count by ``ratio`` at least, and each round doubles the steps
    span = words.agg(F.max("n").alias("top"), F.min("n").alias("least")).first()
    hops = math.log(span["top"] / span["least"], ratio) + 1e-9 if span["top"] else 0
    for _ in range(math.ceil(math.log2(hops)) if hops > 1 else 0):
        after = steps.select(F.col("word").alias("a_word"), F.col("root").alias("a_root"))
        steps = settle(steps.join(after, F.col("root") == F.col("a_word"), "left")
                       .select("word", F.coalesce("a_root", "root").alias("root")), "roots")
    return (near.join(steps, "word", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))


def op11_spelling(spark, sf_dir):
    """Groups of spelling variants of all words of all documents."""
    words = word_counts(documents(spark, sf_dir), damaged=199)
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
