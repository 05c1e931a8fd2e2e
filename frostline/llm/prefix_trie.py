"""Conversation prefix trie by van Emde Boas recursion.

A conversation is a sequence of turns; a node of the trie is a distinct
sequence of first turns. The trie of height 2^k is cut at half its depth: the
prefixes that reach the cut are named, above the cut stands an upper trie of
height 2^(k-1), below it one lower trie for each name. Both halves are cut in
the same way, all of one height together, down to single turns.

* Names. The name of a cut prefix is made from the name of the prefix where its
  half begins and the name of the stretch of turns in between; stretches are
  named from their halves. So each prefix is named once, in log2(depth) rounds
  over arrays of a chunk of at most CHUNK turns. Longer conversations take the
  same recursion over the names of their chunks first. A name is two 64-bit hashes.
* Nodes. Grouping all (conversation, depth) rows by name gives each node's
  smallest member, member count and parent.
* Totals go upward in as many rounds, from the lowest cuts to the highest: the
  total of a lower trie is grafted onto all nodes of the upper trie on the path
  to its cut. The path is that of the cut's smallest member; a round sends at most
  one row for each turn, so all rounds together move rows * log2(depth).

No task holds a whole conversation or all members of a node: turns are ranked
by a range partitioning of (conversation, turn), everything else is keyed by
(conversation, chunk) or aggregated with partial sums. The digest of a node's
ending conversations is a sequential hash; they are joined to texts of at most
2^END_BITS ids in parallel and streamed, sorted, through the hash without being held.

Defined cases: rows without a conv_id belong to no conversation and are left
out. Equal turns of a conversation go by role, then by the hash of the text;
repeated rows are turns of their own. A null turn comes first, null role and
text are empty. A conversation all of whose turns are replaced by none ends at
the root. A very long text is only hashed and its words counted. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import id_crc, settle, shuffle_partitions

#: Turns of a conversation kept in one row: a power of two.
CHUNK = 1024
#: Bits of a conversation id within one piece of a node's ending ids.
END_BITS = 12
#: Nodes with more than a V / HEAVY share of all V nodes as children meet these by a broadcast (at most HEAVY rows).
HEAVY, LIGHT_CHILDREN = 10_000, 4096
WORD = r"[^\x20\x09-\x0D]+"
ROOT = (-7046029254386353131, 7640891576956012809)

U64 = np.uint64
_MIX = ((U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)), (U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)))


# --- names of prefixes --------------------------------------------------------

def join_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of stretches from the names of their halves (last axis: the two hashes)."""
    out = np.empty(np.broadcast_shapes(left.shape, right.shape), dtype=U64)
    for lane, (p, q) in enumerate(_MIX):
        x = (left[..., lane] + q) * p + right[..., lane]
        x ^= x >> U64(29)
        x *= q
        x ^= x >> U64(32)
        out[..., lane] = x
    return out


def stretches(turns: np.ndarray) -> list[np.ndarray]:
    """Names of the aligned stretches of 1, 2, 4, ... turns; ``turns``: (rows, 2^k, 2)."""
    out = [turns]
    while out[-1].shape[1] > 1:
        out.append(join_names(out[-1][:, 0::2], out[-1][:, 1::2]))
    return out


def prefix_names(turns: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``turns``: (rows, 2^k, 2) names of turns, ``start``: (rows, 2) names of what lies before.
    Gives (rows, 2^k + 1, 2): the names of the prefixes of 0, 1, ... turns."""
    parts = stretches(turns)
    names = np.empty((turns.shape[0], turns.shape[1] + 1, 2), dtype=U64)
    names[:, 0] = start
    names[:, -1:] = join_names(names[:, :1], parts[-1])
    half = turns.shape[1] // 2
    for upper in parts[-2::-1]:  # cut every trie of height 2 * half at half its depth
        names[:, half::2 * half] = join_names(names[:, 0:-1:2 * half], upper[:, 0::2])
        half //= 2
    return names


def _named(a: pa.Array, b: pa.Array, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix names of rows of lists, rows of about one length together: all names flat, in row order, and the offsets."""
    at = a.offsets.to_numpy().astype(np.int64)
    at, n = at - at[0], np.diff(at)
    turns = np.stack([a.flatten().to_numpy(), b.flatten().to_numpy()], axis=1).view(U64)
    out = np.empty((at[-1], 2), dtype=U64)
    height = np.ceil(np.log2(np.maximum(n, 1))).astype(int)
    for k in np.unique(height):
        rows, width = np.flatnonzero(height == k), np.arange(1 << k)
        inside = width < n[rows, None]
        place = (at[rows, None] + width)[inside]
        padded = np.zeros((len(rows), 1 << k, 2), dtype=U64)
        padded[inside] = turns[place]
        out[place] = prefix_names(padded, start[rows])[:, 1:][inside]
    return out, at


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.ascontiguousarray(values).view(np.int64)))


def _pairs(b: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([b.column(n).to_numpy() for n in names], axis=1).view(U64)


def _name_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the lists a, b of turn names, which become the lists of prefix names. sa, sb: the name of what
    lies before; ea, eb: that of the whole prefix, where it is known already."""
    for b in batches:
        if b.num_rows:
            names, at = _named(b.column("a"), b.column("b"), _pairs(b, "sa", "sb"))
            known = np.flatnonzero(b.column("ea").is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                names[at[known + 1] - 1] = _pairs(b.take(pa.array(known)), "ea", "eb")
            swap = {"a": _lists(names[:, 0], at), "b": _lists(names[:, 1], at)}
            yield pa.RecordBatch.from_arrays([swap.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)


def _name_chunks(chunk: int):
    """(conv, chunk, name of the whole chunk) of full chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = np.stack([b.column(n).flatten().to_numpy() for n in "ab"], axis=1).view(U64).reshape(-1, chunk, 2)
            whole = stretches(turns)[-1][:, 0].view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("chunk"), pa.array(whole[:, 0]), pa.array(whole[:, 1])], names=["conv", "chunk", "a", "b"])
    return run


# --- conversations -------------------------------------------------------------

def rank_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns sorted by ranges of (conversation, turn), and for each conversation and range the
    place of its first row, the turns before the range and the conversation's size."""
    n = shuffle_partitions(turns.sparkSession)
    order = ["conv", F.asc_nulls_first("turn"), "role", "a", "b", "row"]
    rows = settle(turns.repartitionByRange(n, *order).sortWithinPartitions(*order)
                  .select("conv", "a", "b", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid")), "turns")
    held = rows.groupBy("conv", "part").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    # as many entries as ranges that the conversation meets
    pieces = held.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "first", "n"))).alias("parts"), F.sum("n").alias("size"))
    return rows, settle(pieces, "turn-counts")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of another: (conv, length), and the turns (conv, depth, a, b, words, length)."""
    rows, pieces = rank_turns(turns)
    sizes = pieces.select("conv", "size", (F.col("conv") - F.expr("pmod(conv, 20)")).alias("base"),
                          (id_crc("conv") % 4).cast("long").alias("h"))
    bases = pieces.select(F.col("conv").alias("b_conv"), F.col("size").alias("b_size"))
    convs = settle(sizes.join(bases, F.col("base") == F.col("b_conv"), "left")
                   .withColumn("taken", F.least("h", F.coalesce("b_size", F.lit(0))))
                   .select("conv", "base", "h", "taken", (F.greatest(F.col("size") - F.col("h"), F.lit(0)) + F.col("taken")).alias("length")), "rebuilt")
    before = F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0).cast("long"), lambda s, p: s + p["n"])
    places = (pieces.select("conv", "parts", F.posexplode("parts").alias("i", "p"))
              .select("conv", "p.part", "p.first", before.alias("before"))
              .join(convs.select("conv", "h", "taken", "length"), "conv"))
    ranked = (rows.join(places, ["conv", "part"])
              .withColumn("pos", F.col("mid") - F.col("first") + F.col("before") + 1))
    own = (ranked.filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "words", "length"))
    heads = (ranked.filter("pos <= 3 AND pmod(conv, 20) = 0").select(F.col("conv").alias("base"), "pos", "a", "b", "words"))
    taken = (convs.join(heads, "base").filter("pos <= h").select("conv", F.col("pos").alias("depth"), "a", "b", "words", "length"))
    return convs.select("conv", "length"), own.unionByName(taken)


def paths(turns: DataFrame) -> DataFrame:
    """Rows (conv, chunk, length, start, names, parents, words): the names of the prefixes that end in a chunk."""
    t = F.col("t")
    chunks = (turns.groupBy("conv", F.expr(f"(depth - 1) div {CHUNK}").alias("chunk"))
              .agg(F.array_sort(F.collect_list(F.struct("depth", "a", "b", "words"))).alias("t"), F.max("length").alias("length"))
              .select("conv", "chunk", "length", t["a"].alias("a"), t["b"].alias("b"), t["words"].alias("words")))
    chunks = settle(chunks, "chunks")
    none = F.lit(None).cast("long")
    start, end = [F.lit(v).alias(n) for v, n in zip(ROOT, ("sa", "sb"))], [none.alias("ea"), none.alias("eb")]
    hashes = "a array<long>, b array<long>, sa long, sb long, ea long, eb long"
    # conversations of several chunks: the same recursion over the names of their full chunks
    borders = F.arrays_zip("a", "b", F.slice("a", 2, F.size("a")).alias("ea"), F.slice("b", 2, F.size("b")).alias("eb"))
    full = (chunks.filter((F.col("length") > CHUNK) & (F.col("length") >= (F.col("chunk") + 1) * CHUNK)).select("conv", "chunk", "a", "b")
            .mapInArrow(_name_chunks(CHUNK), "conv long, chunk long, a long, b long")
            .groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", "a", "b"))).alias("t"))
            .select("conv", t["a"].alias("a"), t["b"].alias("b"), *start, *end)
            .mapInArrow(_name_prefixes, f"conv long, {hashes}")
            .select("conv", F.posexplode(borders).alias("i", "s"))
            .select("conv", (F.col("i") + 1).cast("long").alias("chunk"), F.col("s.a").alias("sa"), F.col("s.b").alias("sb"), "s.ea", "s.eb"))
    named = (chunks.filter("chunk = 0").select("*", *start, *end)
             .unionByName(chunks.filter("chunk > 0").join(full, ["conv", "chunk"]).select(*chunks.columns, "sa", "sb", "ea", "eb"))
             .select("conv", "chunk", "length", "words", "a", "b", "sa", "sb", "ea", "eb")
             .mapInArrow(_name_prefixes, f"conv long, chunk long, length long, words array<long>, {hashes}"))
    names = F.arrays_zip("a", "b")
    return (named.select("conv", "chunk", "length", "words", names.alias("names"), F.struct(F.col("sa").alias("a"), F.col("sb").alias("b")).alias("start"))
            .withColumn("parents", F.concat(F.array("start"), F.slice("names", 1, F.size("names") - 1))).drop("start"))


# --- totals ----------------------------------------------------------------------

def graft(nodes: DataFrame, path: DataFrame, deepest: int) -> list[DataFrame]:
    """Tables (name, parent, depth, leaves, saved) whose sums by name are the totals below each node."""
    totals = [nodes.select("name", "parent", "depth", "leaves", "saved")]
    half = 1
    while half < deepest:
        span = 2 * half
        lower = (reduce(DataFrame.unionByName, [t.filter((F.col("depth") > 0) & (F.col("depth") % span == (half + 1) % span)) for t in totals])
                 .groupBy(F.col("parent").alias("cut_name")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        # a cut's total goes to the ``half`` nodes that end with it, on the path of its smallest member
        cuts = (nodes.filter((F.col("depth") % span == half) & (F.col("n_children") > 0)).select("name", "conv", "depth")
                .join(lower, F.col("name") == F.col("cut_name"))
                .select("conv", F.explode(F.expr(f"sequence((depth - {half}) div {CHUNK}, (depth - 1) div {CHUNK})")).alias("chunk"),
                        F.struct("depth", "leaves", "saved").alias("cut"))
                .groupBy("conv", "chunk").agg(F.collect_list("cut").alias("cuts")))
        sent = F.expr(f"""flatten(transform(cuts, c -> transform(
            sequence(greatest(c.depth - {half}, chunk * {CHUNK}), least(c.depth, (chunk + 1) * {CHUNK}) - 1),
            i -> struct(names[int(i - chunk * {CHUNK})] AS name, parents[int(i - chunk * {CHUNK})] AS parent, i + 1 AS depth, c.leaves AS leaves, c.saved AS saved))))""")
        grafts = (path.filter(F.col("length") >= half).join(cuts, ["conv", "chunk"]).select(F.inline(sent))
                  .groupBy("name").agg(F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"),
                                       F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        totals.append(settle(grafts, "grafts"))
        half = span
    return totals


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, ids) sorted by name and id: one digest for each name."""
    now, digest = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ids"))):
            if (a, b) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["a", "b", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, digest.hexdigest())], names=["a", "b", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the conversations (name, conv) that end at a node."""
    pieces = (ends.groupBy("name", F.shiftright("conv", END_BITS).alias("piece"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))
    return (pieces.select("name.a", "name.b", "piece", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "piece")
            .select("a", "b", "ids").mapInArrow(_end_digests, "a long, b long, ends_sha256 string")
            .select(F.struct("a", "b").alias("name"), "ends_sha256"))


# --- the trie -------------------------------------------------------------------

def turn_table(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, the two hashes of a turn, its words)."""
    body, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    return (conversations.filter(F.col(conv_id).isNotNull())
            .select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), who.alias("role"),
                    F.xxhash64(who, body).alias("a"), F.xxhash64(F.lit(1), who, body).alias("b"),
                    F.regexp_count(body, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row")))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations ``convs`` (conv, length) with ``turns`` (conv, depth from 1, a, b, words, length).
    One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    root = F.struct(F.lit(ROOT[0]).alias("a"), F.lit(ROOT[1]).alias("b"))
    none = F.lit(None).cast("struct<a:bigint,b:bigint>")
    deepest = convs.agg(F.max("length")).first()[0]
    path = settle(paths(turns), "paths")
    steps = (path.select("conv", "chunk", F.posexplode(F.arrays_zip("names", "parents", "words")).alias("i", "s"))
             .select(F.col("s.names").alias("name"), F.col("s.parents").alias("parent"), "conv",
                     (F.col("chunk") * CHUNK + F.col("i") + 1).alias("depth"), F.col("s.words").alias("words")))
    found = steps.groupBy("name").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.any_value("words").alias("words"),
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
    top = (convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
           .select(root.alias("name"), none.alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv", "n_convs"))
    found = settle(found.unionByName(top), "found")
    children = found.filter("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(found.join(children, "name", "left").select(
        *found.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "nodes")

    # only a conversation that is the smallest of its kind is ever a cut's smallest member
    reps = path.join(nodes.select("conv").distinct(), "conv", "left_semi").select("conv", "chunk", "length", "names", "parents")
    totals = graft(nodes, settle(reps, "rep-paths"), deepest or 0)
    sums = [t.select("name", "leaves", "saved") for t in totals]
    sums += [t.filter("depth = 1").select(root.alias("name"), "leaves", "saved") for t in totals]
    sums = reduce(DataFrame.unionByName, sums).groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    last = path.filter(F.col("length") == F.col("chunk") * CHUNK + F.size("names")).select(F.element_at("names", -1).alias("name"), "conv")
    ends = end_digests(last.unionByName(convs.filter("length = 0").select(root.alias("name"), "conv")))
    full = (nodes.drop("leaves", "saved").join(sums, "name").join(ends, "name", "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))))

    # a parent of very many children would be one hot key: such parents are few and go to every task
    many = F.lit(max(LIGHT_CHILDREN, nodes.count() // HEAVY))
    parent = nodes.filter("n_children > 0").select(F.col("name").alias("p_name"), F.col("conv").alias("p_conv"), (F.col("n_children") > many).alias("heavy"))
    heavy = parent.filter("heavy").select(F.col("p_name").alias("h_name"), F.col("p_conv").alias("h_conv"))
    marked = full.join(F.broadcast(heavy), F.col("parent") == F.col("h_name"), "left")
    light = (marked.filter("h_conv IS NULL").join(parent.filter("NOT heavy"), F.col("parent") == F.col("p_name"), "left"))
    answer = ["depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return (light.select(F.col("conv").alias("conv_id"), F.col("p_conv").alias("parent_conv_id"), *answer)
            .unionByName(marked.filter("h_conv IS NOT NULL").select(F.col("conv").alias("conv_id"), F.col("h_conv").alias("parent_conv_id"), *answer)))


def as_sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form that ``prefix_trie`` takes: (conv, length), (conv, depth, a, b, words, length)."""
    rows, pieces = rank_turns(turns)
    convs = pieces.select("conv", F.col("size").alias("length"))
    before = F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0).cast("long"), lambda s, p: s + p["n"])
    places = (pieces.select("conv", "parts", F.col("size").alias("length"), F.posexplode("parts").alias("i", "p"))
              .select("conv", "length", "p.part", "p.first", before.alias("before")))
    return convs, (rows.join(places, ["conv", "part"])
                   .select("conv", (F.col("mid") - F.col("first") + F.col("before") + 1).alias("depth"), "a", "b", "words", "length"))


def op13_prefix_trie(spark, sf_dir):
    """The prefix trie of all conversations, each rebuilt with the first turns of another."""
    return prefix_trie(*rebuild(turn_table(spark.read.parquet(f"{sf_dir}/conversations.parquet")))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP13_SQL = r"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM step WHERE k = 8),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base,
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, (i + 1)::BIGINT, 1))::BIGINT)),
           lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (
  SELECT c.conv_id, 0 AS own, pos, role, body FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL
  SELECT c.conv_id, 1, pos, role, body FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
d AS (
  SELECT conv_id, row_number() OVER w AS depth,
         len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words,
         md5(string_agg(md5(length(role) || ':' || role || body), '') OVER w) AS name
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
p AS (
  SELECT conv_id, depth, words, name FROM d
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM p),
n AS (SELECT name, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM q GROUP BY name, depth, parent),
k AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent, depth),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
         (n_convs - 1) * words AS saved
  FROM n LEFT JOIN k ON k.parent = n.name AND k.depth = n.depth),
s AS (
  SELECT p.name, p.depth, sum(v.leaf) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.name, p.depth),
e AS (
  SELECT name, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) AS z FROM p) WHERE z = 1 GROUP BY name, depth)
SELECT v.conv_id::BIGINT AS conv_id, v.depth::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, v.n_convs::BIGINT AS n_convs,
       v.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN s ON s.name = v.name AND s.depth = v.depth
LEFT JOIN n u ON u.name = v.parent AND u.depth = v.depth - 1
LEFT JOIN e ON e.name = v.name AND e.depth = v.depth
"""
