"""Near-dedup by MinHash with tensored banding.

Documents are sets of word shingles. HALVES small collections of ROWS minhash
values each are computed per set; a table key combines two of them, so that
14 collections (28 minhashes) serve 91 tables, as 91 x 4 independent ones would
need 364. A pair of Jaccard similarity s misses all tables only if fewer than
two collections agree: below 7e-7 at 0.85, 2e-5 at 0.8.

Equal sets are one node. In each table bucket all nodes meet the bucket's
smallest one; these candidate pairs are confirmed on the full sets and the
links give components. Buckets whose other nodes still are in several
components are searched in full, in blocks inside the tasks: a pair is taken up
only in the first table that proposes it, only if its ends are in different
components, and only if sizes and minhashes allow the similarity (the latter
loses less than one link in a million); what is left meets on the full sets.
So a group of copies that hangs together costs a pair per copy and pivot, and
no pair is ever written as a row. Components come from alternating star
contractions; nothing is gathered on the driver.

Sets are compared as 64-bit hashes of their shingles, equal sets by 128 bits.

Defined cases: a text without words, null or empty, is linked with nothing; a
text with fewer words than a shingle is one shingle. A row without id is linked
with nothing and stays. Rows that share an id are judged by their own texts;
where both texts' nodes bear that id, they count as linked. Columns other than
id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import binary_values, byte_slices, documents, settle, shuffle_partitions

HALVES, ROWS = 14, 2
#: Words whose hash a worker remembers, and the longest of these in bytes.
MEMO_WORDS, MEMO_BYTES = 100_000, 40

U64 = np.uint64
_K = U64(0x9E3779B97F4A7C15)
#: Members of a bucket that one task compares; larger buckets are compared block by block.
BLOCK = 1024
#: Bits of the filter that picks the documents whose full sets are made: 8 MB; and the most ids it is made for.
FILTER_BITS = 1 << 26
FILTER_IDS = FILTER_BITS // 8
#: Share of true links that the comparison of minhashes may lose.
LOSS = 1e-6
TABLES = list(combinations(range(HALVES), 2))
_SEEDS = np.random.default_rng(2024).integers(1, 2 ** 63, size=(2, HALVES * ROWS), dtype=np.uint64) | U64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES and len(self) < MEMO_WORDS:
            self[word] = h
        return h


_WORDS = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Distinct hashes of the k-word runs of a text, A-Z lower-cased; in order."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=U64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=U64, count=len(words))
    k = min(k, len(words))
    n = len(h) - k + 1
    s = np.full(n, k, dtype=U64)
    for i in range(k):
        s = mixed(s * _K + h[i:i + n])
    return np.unique(s)


def half_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each (non-empty) set, a row with the hash of each small collection of minhashes,
    and one with a byte of each minhash."""
    x = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HALVES), dtype=U64)
    low = np.empty((len(sets), HALVES * ROWS), dtype=np.uint8)
    for h in range(HALVES):
        both = np.full(len(sets), h, dtype=U64)
        for r in range(ROWS):
            i = h * ROWS + r
            y = (x ^ _SEEDS[0, i]) * _SEEDS[1, i]
            y ^= y >> U64(32)
            y *= _SEEDS[0, i]
            least = np.minimum.reduceat(y, at)
            low[:, i] = least >> U64(8) & U64(255)
            both = mixed(both * _K + least)
        out[:, h] = both
    return out, low


def least_alike(percent: int) -> int:
    """Equal minhashes that all but a share LOSS of the pairs of that similarity reach."""
    n, t = HALVES * ROWS, percent / 100
    below, c = 0.0, 0
    while c <= n and below + comb(n, c) * t ** c * (1 - t) ** (n - c) <= LOSS:
        below += comb(n, c) * t ** c * (1 - t) ** (n - c)
        c += 1
    return c


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), _signed(values))


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text", 2 << 20):
            sets = [shingles(t or b"", k) for t in binary_values(b.column("text"))]
            full = [i for i, s in enumerate(sets) if len(s)]
            halves = np.zeros((len(sets), HALVES), dtype=U64)
            low = np.zeros((len(sets), HALVES * ROWS), dtype=np.uint8)
            if full:
                halves[full], low[full] = half_hashes([sets[i] for i in full])
            digest = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], dtype=U64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), _signed(digest[:, 0]), _signed(digest[:, 1]),
                 _lists(halves.reshape(-1), [HALVES] * len(sets)), pa.array([r.tobytes() for r in low], pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "high", "low", "halves", "bytes"])
    return run


def _spots(ids: np.ndarray) -> np.ndarray:
    """Places of ids in the filter of wanted ids."""
    return (mixed(ids.astype(np.int64).view(U64)) & U64(FILTER_BITS - 1)).astype(np.int64)


def _spot_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # Spark's bitmap functions count from 1
        yield pa.RecordBatch.from_arrays([pa.array(_spots(b.column("node").to_numpy()) + 1)], names=["spot"])


def wanted(ids: DataFrame) -> np.ndarray:
    """A bit for each place that one of the nodes ``ids`` takes. Of one size whatever
    the input: with very many ids it lets more through, never less."""
    found = (ids.mapInArrow(_spot_of, "spot long").groupBy(F.bitmap_bucket_number("spot").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect())
    bits = np.zeros(FILTER_BITS, dtype=bool)
    for r in found:  # parts count from 1; within a byte the lowest bit comes first
        part = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little")
        first = (r["part"] - 1) * len(part)
        bits[first:first + len(part)] = part[:FILTER_BITS - first]
    return np.packbits(bits)


def _sets(k: int, shared):
    """Shingles of the documents that the filter lets through (None: of all)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared and shared.value
        for some in byte_slices(batches, "text", 2 << 20):
            if shared:
                spots = _spots(some.column("doc_id").to_numpy())
                some = some.filter(pa.array((bits[spots >> 3] >> (7 - (spots & 7)) & 1).astype(bool)))
            sets = [shingles(t or b"", k) for t in binary_values(some.column("text"))]
            if sets:
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), _lists(np.concatenate(sets), [len(s) for s in sets])], names=["node", "shingles"])
    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        values = list(zip(*(b.column(k).to_pylist() for k in keys)))
        start = 0
        for i in range(len(values) + 1):
            if i == len(values) or (i > start and values[i] != values[start]):
                if held and i > start and values[start] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                if i > start:
                    held.append(b.slice(start, i - start))
                    last = values[start]
                start = i
    if held:
        yield pa.Table.from_batches(held)


def _bucket_pairs(percent: int):
    """Per block pair of a bucket, the pairs to confirm: (key, lo, hi, node, partners)."""
    alike = least_alike(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["key", "lo", "hi"]):
            key, lo, hi, table = (t.column(c)[0].as_py() for c in ("key", "lo", "hi", "table"))
            node, label, n, block = (t.column(c).to_numpy() for c in ("node", "label", "n", "block"))
            halves = t.column("halves").combine_chunks().flatten().to_numpy().reshape(len(node), HALVES)
            low = np.frombuffer(b"".join(t.column("bytes").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
            i, j = TABLES[table]
            partners, named = {}, set()
            for x in range(len(node)):
                # later rows of the other block, or of the same one in its own pair
                y = np.arange(x + 1, len(node))
                y = y[(label[y] != label[x]) & ((lo == hi) | (block[y] != block[x]))]
                y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
                if len(y):
                    y = y[(low[y] == low[x]).sum(axis=1) >= alike]
                if len(y):  # only in the first table that proposes the pair
                    same = halves[y, :j] == halves[x, :j]
                    y = y[same.sum(axis=1) == 1]
                if len(y):
                    partners[int(node[x])] = node[y]
                    named.update(node[y].tolist())
            if partners:
                rows = [*partners, *(named - partners.keys())]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v] * n, pa.int64()) for v in (key, lo, hi)), pa.array(rows, pa.int64()),
                     pa.array([partners.get(v, []) for v in rows], pa.list_(pa.int64()))], names=["key", "lo", "hi", "node", "partners"])
    return run


def _bucket_links(percent: int):
    """Links among the pairs of a block pair, by the full sets; pairs already joined by others are passed over."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["key", "lo", "hi"]):
            sets = {v: s.values.to_numpy().view(U64) for v, s in zip(t.column("node").to_pylist(), t.column("shingles"))}
            root = {v: v for v in sets}

            def find(v):
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            links = []
            for x, partners in zip(t.column("node").to_pylist(), t.column("partners").to_pylist()):
                rest = [y for y in partners if y in sets and find(x) != find(y)]
                for at in range(0, len(rest), 256):
                    ys = [y for y in rest[at:at + 256] if find(x) != find(y)]
                    if not ys:
                        continue
                    own, sizes = sets[x], np.array([len(sets[y]) for y in ys])
                    theirs = np.concatenate([sets[y] for y in ys])
                    spot = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                    common = np.add.reduceat((own[spot] == theirs).astype(np.int64), np.cumsum(sizes) - sizes)
                    for i in np.flatnonzero(100 * common >= percent * (len(own) + sizes - common)):
                        if find(x) != find(ys[i]):
                            root[find(x)] = find(ys[i])
                            links.append((x, ys[i]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])
    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of links (a, b): the smallest node reachable.
    Alternates large and small stars until nothing changes."""
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
        # large star: all larger neighbours of a node go to its smallest
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        edges = (both.join(least, both["u"] == least["w"]).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        edges = settle(edges, "large-star")
        # small star: a node and its smaller neighbours go to the smallest of these
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        edges = settle(edges.join(least, edges["u"] == least["w"])
                       .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                 F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                       .select("e.u", "e.v").filter("u <> v").distinct(), "small-star")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, text_hash and kept. Linked are
    documents whose sets share at least ``percent`` hundredths of their union."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = settle(hashed.mapInArrow(_sketch(k), "doc_id long, text_hash long, n_shingles long, high long, low long, halves array<bigint>, bytes binary"), "sketches")
    # one node for each distinct set, named after its smallest id
    nodes = settle(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("high", "low")
                   .agg(F.min("doc_id").alias("node"), F.first("halves").alias("halves"), F.first("bytes").alias("bytes"),
                         F.max("n_shingles").alias("n")), "nodes")
    keys = [F.struct(F.lit(t).alias("table"), F.xxhash64(F.lit(t), F.col("halves")[i], F.col("halves")[j]).alias("key"))
            for t, (i, j) in enumerate(TABLES)]
    table = nodes.select("node", F.explode(F.array(*keys)).alias("k")).select("node", "k.table", "k.key")
    # a row for each table and node: the planner sizes these as if nothing were exploded, so that it must not broadcast them
    pivots = (table.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
              .filter("pivot <> last").select(F.col("key").alias("p_key"), "pivot")).hint("merge")
    members = settle(table.join(pivots, F.col("key") == F.col("p_key")).filter("node <> pivot").select("key", "table", "pivot", "node"), "buckets")

    # all that meet their bucket's pivot, if sizes and minhashes allow a link
    facts = lambda end: nodes.select(F.col("node").alias(f"{end}_node"), F.col("n").alias(f"{end}_n"), F.col("bytes").alias(f"{end}_bytes"))
    equal = sum((F.substring("a_bytes", i + 1, 1) == F.substring("b_bytes", i + 1, 1)).cast("int") for i in range(HALVES * ROWS))
    pairs = settle(members.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
                   .join(facts("a"), F.col("a") == F.col("a_node")).join(facts("b"), F.col("b") == F.col("b_node"))
                   .filter((100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (equal >= least_alike(percent)))
                   .select("a", "b"), "pivot-pairs")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        """Shingles of the nodes ``ids`` (and of some others), from their documents: in place by the filter, or
        where it would let too much through, after a semi-join with the ids."""
        ids, some, bits = ids.select("node").distinct(), docs.filter("doc_id IS NOT NULL"), None
        if ids.count() <= FILTER_IDS:
            bits = docs.sparkSession.sparkContext.broadcast(wanted(ids))
        else:
            some = some.join(ids, F.col("doc_id") == F.col("node"), "left_semi")
        return settle(some.mapInArrow(_sets(k, bits), "node long, shingles array<bigint>").filter(F.size("shingles") > 0), name)

    sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), "pivot-sets")
    of = lambda end: sets.select(F.col("node").alias(f"{end}_node"), F.col("shingles").alias(f"{end}_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    links = settle(pairs.join(of("a"), F.col("a") == F.col("a_node")).join(of("b"), F.col("b") == F.col("b_node"))
                   .filter(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common)).select("a", "b"), "pivot-links")
    label = components(links)

    # buckets with nodes, beside the pivot, of several components
    marked = settle(members.join(label.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
                    .select("key", "table", "node", F.coalesce("component", "node").alias("label")), "marked")
    mixed_up = (marked.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("least"), F.max("label").alias("most"))
                .filter("least <> most").select(F.col("key").alias("m_key"), F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks")))
    blocks = (marked.join(mixed_up, F.col("key") == F.col("m_key"))
              .join(nodes.select(F.col("node").alias("f_node"), "n", "halves", "bytes"), F.col("node") == F.col("f_node"))
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("key", "table", "node", "label", "n", "halves", "bytes", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    partitions = shuffle_partitions(docs.sparkSession)
    todo = settle(blocks.repartition(partitions, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
                  .mapInArrow(_bucket_pairs(percent), "key long, lo long, hi long, node long, partners array<bigint>"), "bucket-pairs")
    if not todo.isEmpty():
        sets = sets_of(todo, "bucket-sets")
        # lists of partners repeat and are far smaller in a file than in memory: never broadcast
        more = settle(todo.hint("merge").join(sets.withColumnRenamed("node", "s_node"), F.col("node") == F.col("s_node")).drop("s_node")
                      .repartition(partitions, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
                      .mapInArrow(_bucket_links(percent), "a long, b long"), "bucket-links")
        label = components(links.unionByName(more))
    named = nodes.join(label.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left").select(
        F.col("high").alias("n_high"), F.col("low").alias("n_low"), F.coalesce("component", "node").alias("component"))
    same = (F.col("high") == F.col("n_high")) & (F.col("low") == F.col("n_low")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return (rows.drop("halves", "bytes").join(named, same, "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "text_hash")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op3_minhash(spark, sf_dir):
    """Near-duplicate components of all documents: three words, 85 hundredths."""
    return near_duplicates(documents(spark, sf_dir), 3, 85).drop("text_hash")
