"""Line dedup with a sharded minimal perfect hash.

1. Each document gives the 128-bit hashes of its long line keys once. Of equal
   (line, document) pairs one is kept, then each distinct line's documents are counted
   (partial sums first) and the largest id, whose document keeps the line, is found.
2. The distinct hashes are dealt into shards by their bits. A shard's minimal
   perfect hash numbers its n hashes 0..n-1 without storing them; arrays of n
   entries hold a 64-bit fingerprint, the count and the keeping document.
3. Documents don't join lines. Their hashes travel, packed by shard for a slice of documents, to a task
   that holds one shard's arrays and probes them: a hash whose fingerprint agrees reads
   the count and the keeping document there, and the count decides. Lines to drop return to
   their document.

A shard holds at most about SHARD_LINES lines, and there is one for each shuffle
partition at least. The counts tell how many probes a shard will meet: where one line found
everywhere brings it a multiple of the usual number, they are dealt over so many
tasks ("salts"), each with a copy of the shard's arrays.

Two lines are equal when their 128-bit hashes are.

Defined cases: null and empty text are one empty line. Rows that share a doc_id are one
document when lines are counted, and each drops its lines. All rows without a
doc_id count as one document, which never keeps a line; lines held by such rows
alone stay. Columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import BLANKS, binary_values, byte_slices, documents, settle, shuffle_partitions

SHARD_LINES = 500_000
#: Bits per key and level of the perfect hash: more make it shallower and larger.
GAMMA = 2.0
LEVELS = 60
#: The bits of a hash that choose its shard; the perfect hash mixes all of them.
SHARD_BITS = (1 << 31) - 1

U64 = np.uint64


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def hash_pairs(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two unsigned 64-bit integers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), dtype=">u8").reshape(-1, 2).astype(U64)


def long_lines(text: bytes, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """All lines of a text, and the places and keys of those long enough."""
    lines = text.split(b"\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line_key(line)
            # UTF-8 bytes that don't continue a character: code points
            if len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
                at.append(i)
                keys.append(key)
    return lines, at, keys


# --- minimal perfect hash ---------------------------------------------------

def _slots(pairs: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each hash among ``size`` bits of a level."""
    x = pairs[:, 0] + pairs[:, 1] * U64(2 * level + 1) + U64((0x9E3779B97F4A7C15 * (level + 1)) & (2 ** 64 - 1))
    x ^= x >> U64(31)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x % U64(size)


def build_index(pairs: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> bytes:
    """A shard's perfect hash and its arrays. At each level, hashes alone in
    their bit set it; the others go on to the next level."""
    rest, levels = np.arange(len(pairs)), []
    while len(rest):
        if len(levels) == LEVELS:
            raise ValueError("equal hashes in one shard")
        size = max(64, int(GAMMA * len(rest)))
        slot = _slots(pairs[rest], len(levels), size)
        alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
        levels.append(np.packbits(alone))
        rest = rest[~alone[slot.astype(np.int64)]]
    index = PerfectHash(levels, [])
    place = index.place(pairs)
    order = np.empty(len(pairs), dtype=np.int64)
    order[place] = np.arange(len(pairs))
    return pickle.dumps((levels, [pairs[order, 1], counts[order], keep[order]]), protocol=5)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], arrays: list[np.ndarray]):
        self.bits = [np.unpackbits(b) for b in levels]
        self.ranks, before = [], 0
        for b in self.bits:  # ones before each bit, over all levels
            self.ranks.append(np.cumsum(b, dtype=np.int64) - b + before)
            before += int(b.sum())
        # sizes before packing, which fills up to whole bytes
        self.sizes = []
        n = before
        for b in self.bits:
            self.sizes.append(max(64, int(GAMMA * n)))
            n -= int(b.sum())
        self.arrays = arrays

    @staticmethod
    def load(data: bytes) -> PerfectHash:
        return PerfectHash(*pickle.loads(data))

    def place(self, pairs: np.ndarray) -> np.ndarray:
        """Number of each hash; -1 for some hashes outside the index."""
        out = np.full(len(pairs), -1, dtype=np.int64)
        rest = np.arange(len(pairs))
        for level, (bits, ranks, size) in enumerate(zip(self.bits, self.ranks, self.sizes)):
            if not len(rest):
                break
            slot = _slots(pairs[rest], level, size).astype(np.int64)
            hit = bits[slot] == 1
            out[rest[hit]] = ranks[slot[hit]]
            rest = rest[~hit]
        return out

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Number of each hash that the fingerprint confirms, else -1."""
        place = self.place(pairs)
        known = place >= 0
        known[known] = self.arrays[0][place[known]] == pairs[known, 1]
        return np.where(known, place, -1)


# --- Spark steps ------------------------------------------------------------

def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _document_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text"):
            ids, pairs = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), binary_values(b.column("text"))):
                keys = list(set(long_lines(text or b"", min_chars)[2]))
                if keys:
                    pairs.append(hash_pairs(keys))
                    ids += [doc] * len(keys)
            if ids:
                p = np.concatenate(pairs)
                yield pa.RecordBatch.from_arrays([_signed(p[:, 0]), _signed(p[:, 1]), pa.array(ids, pa.int64())],
                                                 names=["high", "low", "doc_id"])
    return run


def _shard_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: an index for each."""
    now, held = None, []

    def done():
        t = pa.Table.from_batches(held)
        col = lambda n: t.column(n).to_numpy()
        pairs = np.stack([col("high"), col("low")], axis=1).view(U64)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([build_index(pairs, col("n"), col("keep"))], pa.binary())],
                                          names=["shard", "payload"])

    for b in batches:
        shards = b.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                if held and shards[lo] != now:
                    yield done()
                    held = []
                now = int(shards[lo])
                held.append(b.slice(lo, hi - lo))
    if held:
        yield done()


#: One probe: the line's hash, its document (and whether that has no id) and the hash of the document's text.
PROBE = np.dtype([("pair", "<u8", 2), ("doc", "<i8"), ("no_id", "?"), ("text", "<i8")])


def _packed_probes(min_chars: int, shards: int):
    """(shard, probes) for each shard that the documents of a slice meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text"):
            pairs, sizes = [], []
            for text in binary_values(b.column("text")):
                keys = list(set(long_lines(text or b"", min_chars)[2]))
                sizes.append(len(keys))
                if keys:
                    pairs.append(hash_pairs(keys))
            if not pairs:
                continue
            probes = np.empty(sum(sizes), dtype=PROBE)
            probes["pair"] = np.concatenate(pairs)
            probes["doc"] = np.repeat(b.column("doc_id").fill_null(0).to_numpy(), sizes)
            probes["no_id"] = np.repeat(b.column("doc_id").is_null().to_numpy(zero_copy_only=False), sizes)
            probes["text"] = np.repeat(b.column("text_hash").to_numpy(), sizes)
            of = ((probes["pair"][:, 0] & U64(SHARD_BITS)) % U64(shards)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            probes, of = probes[order], of[order]
            met, at = np.unique(of, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([p.tobytes() for p in np.split(probes, at[1:])], pa.binary())],
                                             names=["shard", "payload"])
    return run


def _probe(min_docs: int):
    """Rows sorted by shard, the index first (kind 0): hashes that their document drops."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for b in batches:
            gone = []
            for shard, kind, payload in zip(*(b.column(n).to_pylist() for n in ("shard", "kind", "payload"))):
                if kind == 0:
                    now, index = shard, PerfectHash.load(payload)
                elif shard == now:
                    probes = np.frombuffer(payload, dtype=PROBE)
                    place = index.find(probes["pair"])
                    hit = np.flatnonzero(place >= 0)
                    place = place[hit]
                    drop = (index.arrays[1][place] >= min_docs) & (probes["no_id"][hit] | (index.arrays[2][place] != probes["doc"][hit]))
                    gone.append(probes[hit[drop]])
            gone = np.concatenate(gone) if gone else np.empty(0, dtype=PROBE)
            if len(gone):
                gone = gone[np.lexsort((gone["no_id"], gone["doc"], gone["text"]))]
                new = np.flatnonzero((gone["text"][1:] != gone["text"][:-1]) | (gone["doc"][1:] != gone["doc"][:-1]) | (gone["no_id"][1:] != gone["no_id"][:-1])) + 1
                first = gone[np.concatenate([[0], new])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first["doc"], pa.int64(), mask=first["no_id"]), pa.array(first["text"], pa.int64()),
                     pa.array([p.tobytes() for p in np.split(np.ascontiguousarray(gone["pair"]), new)], pa.binary())], names=["doc_id", "text_hash", "dropped"])
    return run


def _drop(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text"):
            texts, lost, total = [], [], []
            for text, packs in zip(binary_values(b.column("text")), b.column("dropped").to_pylist()):
                text = text or b""
                if not packs:
                    texts.append(text)
                    lost.append(0)
                    total.append(text.count(b"\n") + 1)
                    continue
                lines, at, keys = long_lines(text, min_chars)
                gone = {p[i:i + 16] for p in packs for i in range(0, len(p), 16)}
                pairs = hash_pairs(keys)
                drop = {i for i, p in zip(at, pairs) if p.tobytes() in gone}
                texts.append(b"\n".join([x for i, x in enumerate(lines) if i not in drop]))
                lost.append(len(drop))
                total.append(len(lines))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())],
                                             names=["doc_id", "kept_text", "n_lines", "n_dropped"])
    return run


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text: str = "text",
               shard_lines: int = SHARD_LINES) -> DataFrame:
    """One row per document: id, ``kept_text``, ``n_lines`` before and ``n_dropped``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # a line of rows without an id alone has no document to stay in: as if it were found nowhere
    found = (docs.mapInArrow(_document_lines(min_chars), "high long, low long, doc_id long").distinct()
             .groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep"))
             .select("high", "low", F.when(F.col("keep").isNull(), 0).otherwise(F.col("n")).alias("n"), F.coalesce("keep", F.lit(0)).alias("keep")))
    found = settle(found, "line-counts")
    shards = max(shuffle_partitions(spark), -(-found.count() // shard_lines))
    shard = (F.col("high").bitwiseAND(F.lit(SHARD_BITS)) % shards).cast("int")
    # one row per shard: what its probes will be, known from the counts
    loads = {r["shard"]: r["n"] for r in found.groupBy(shard.alias("shard")).agg(F.sum("n").alias("n")).collect()}
    usual = max(1, sum(loads.values()) // shards)
    salts = F.from_json(F.lit(json.dumps([max(1, loads.get(s, 0) // usual) for s in range(shards)])), "array<int>")[F.col("shard")]
    index = (found.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard")
             .mapInArrow(_shard_index, "shard int, payload binary"))
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "payload")
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    probes = (hashed.mapInArrow(_packed_probes(min_chars, shards), "shard int, payload binary")
              .select("shard", F.pmod(F.xxhash64("payload"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "payload"))
    drops = (copies.unionByName(probes).repartition(shards, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
             .mapInArrow(_probe(min_docs), "doc_id long, text_hash long, dropped binary")
             .distinct().groupBy(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"))
             .agg(F.collect_list("dropped").alias("dropped")))
    same = F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash"))
    return (hashed.join(drops, same, "left").select("doc_id", "text", "dropped")
            .mapInArrow(_drop(min_chars), "doc_id long, kept_text string, n_lines long, n_dropped long"))


def op1_line_dedup(spark, sf_dir):
    """Every document without the long lines that a later document keeps."""
    return (line_dedup(documents(spark, sf_dir))
            .select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, i, line, keep IS NOT NULL AND keep <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
