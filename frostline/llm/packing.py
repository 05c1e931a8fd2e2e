"""Packing by minimum bin slack.

Documents are tokenised and cut into windows; whole windows are sequences by
themselves, and the remainders (one per document, shorter than a window) are
packed. Only the histogram of remainder lengths matters for the plan: at most
``window`` counts, whatever the input. For each sequence a bitset
subset-sum finds the multiset of remaining lengths that, beside the longest
one left, fills the window closest to capacity; backtracking gives its counts,
and the same pattern is used as often as the histogram allows. Pieces are
ranked within their length (over hash buckets, so that a frequent length is
not sorted in one task) and a piece's rank finds its place in the plan.

Tokenising goes by runs between [\\x20\\x09-\\x0D]: the tokenizer drops white
space and looks at nothing across it, so a text's ids are those of its runs.

Defined cases: null text is empty and gives the end id alone; a very long text
gives many whole windows; null ids and repeated rows are packed like others;
an empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import byte_slices, documents, settle
from frostline.llm.shards import BUCKET_ROWS, ranked

WINDOW, END_ID = 2048, 1
#: Bytes of text encoded together: a run is looked up once in each slice.
SLICE_BYTES = 6 << 20
#: Runs of characters, and words within them, whose ids a worker remembers, and the longest of these.
MEMO_RUNS, MEMO_CHARS = 200_000, 40
#: A word of Latin letters and the signs after it: the tokenizer splits between the two and nowhere else.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Letters beyond ASCII as the vocabulary spells them: a character for each byte. Bytes
    that print stand for themselves, the others follow from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    spelled = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(192, 256)}


class RunCoder:
    """Ids of texts by their runs of characters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}

    def plain(self, run: str) -> bytes:
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a lower-case word of Latin letters, by the vocabulary's merges alone."""
        spelled = word if word.isascii() else word.translate(self.letters)
        return array("I", [piece.id for piece in self.pieces(spelled)]).tobytes()

    def run(self, run: str) -> bytes:
        """Ids of a run; what comes first is remembered."""
        m = _WORD.fullmatch(run)
        if m is None:
            ids = self.plain(run)
        else:
            stem, after = m.groups()
            stem = stem.lower()
            ids = self.words.get(stem)
            if ids is None:
                ids = self._remember(self.words, stem, self.word(stem))
            if after:
                signs = self.signs.get(after)
                ids += self._remember(self.signs, after, self.plain(after)) if signs is None else signs
        return self._remember(self.runs, run, ids)

    @staticmethod
    def _remember(memo: dict[str, bytes], key: str, ids: bytes) -> bytes:
        if len(memo) < MEMO_RUNS and len(key) <= MEMO_CHARS:
            memo[key] = ids
        return ids

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        runs = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = runs.flatten().dictionary_encode()
        known, new = self.runs.get, self.run
        parts = [known(r) or new(r) for r in coded.dictionary.to_numpy(zero_copy_only=False)]
        which, at = coded.indices.to_numpy().tolist(), runs.offsets.to_numpy().tolist()
        take = parts.__getitem__
        for lo, hi in zip(at, at[1:]):
            yield b"".join(map(take, which[lo - at[0]:hi - at[0]]))


_CODERS: dict[str, RunCoder] = {}


def coder(path: str) -> RunCoder:
    if path not in _CODERS:
        _CODERS[path] = RunCoder(path)
    return _CODERS[path]


def _cut(path: str, end_id: int, window: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = coder(path), array("I", [end_id]).tobytes()
        for b in byte_slices(batches, "text", SLICE_BYTES):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), code.encode(b.column("text"))):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start:4 * (start + window)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, *[part] * with_ids))
            types = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return run


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False,
           id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The windows of each document: id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(_cut(path, end_id, window, with_ids),
                        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids))


def best_fill(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, the longest among them, whose sum is closest to capacity.
    ``lengths``: those with a count, longest first."""
    chosen = {lengths[0]: 1}
    room = capacity - lengths[0]
    reach, full, layers = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        left = min(counts[length] - chosen.get(length, 0), room // length)
        copies = 1
        while left > 0 and not reach >> room & 1:
            take = min(copies, left)
            layers.append((length, take, reach))
            reach |= reach << (length * take) & full
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(histogram: dict[int, int], capacity: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, copies per sequence, first sequence, offset): pieces of a
    length from that rank on go, so many to a sequence, to sequences from there on."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths, used, rows, sequence = sorted(counts, reverse=True), dict.fromkeys(counts, 0), [], 0
    while lengths:
        pattern = best_fill(counts, lengths, capacity)
        times = min(counts[n] // c for n, c in pattern.items())
        offset = 0
        for n, c in pattern.items():
            rows.append((n, used[n], c, sequence, offset))
            offset += n * c
            used[n] += c * times
            counts[n] -= c * times
        sequence += times
        lengths = [n for n in lengths if counts[n]]
    return rows


def _place(rows: list[tuple]):
    """Sequence and offset of a piece from its length and its rank within the length."""
    table = np.array(sorted(rows) or [(0, 0, 1, 0, 0)], dtype=np.int64)
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() - 1
            at = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            k = rank - at[:, 1]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(at[:, 3] + k // at[:, 2]), pa.array(at[:, 4] + k % at[:, 2] * length)],
                names=[*keep, "sequence_id", "offset"])
    return run


def pack(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``parts`` (see ``pieces``) with the sequence and the offset of each."""
    parts = settle(parts, "pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    # buckets of a length follow its own count
    buckets = F.lit([max(1, -(-histogram.get(n, 0) // BUCKET_ROWS)) for n in range(window + 1)])
    placed = ranked(parts, ["length"], F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), buckets[F.col("length").cast("int")].cast("long")),
                    ["doc_id", "start", "ids_crc32", "doc_tokens"], "rank").drop("rank_of")
    placed = placed.select(*parts.columns, F.col("rank").cast("long").alias("rank"))
    types = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    return placed.mapInArrow(_place(plan(histogram, window)), f"{types}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pieces that carry theirs."""
    return (packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))


def op8_pack(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
