"""BPE encoding and decoding; long texts by tree concatenation.

A text of more than LEAF_BYTES is cut into halves, these into halves, and so
on; the leaves are encoded in parallel, wherever Spark puts them, and joined
pairwise. At a join, a window of tokens around the cut is encoded anew and
grows until both sides agree: it starts and ends with the very tokens that
the sides already have there. Two places allow this conclusion:

* before a blank that a visible character follows. The splitting pattern
  always breaks there, whatever stands around it, so text on either side is
  encoded by itself;
* inside a run of one kind of character (letters, digits or signs) that goes
  on to both sides of the window. A sequence of tokens is the encoding of a run
  exactly if any two neighbours are the encoding of their text; neighbours
  inside the window are, and so are those outside.

Else the window grows, at last to both sides whole. So each node of the tree
holds the encoding of its text. The work at a join follows the window.

Short texts and leaves are encoded by pieces between the places of the first
kind, and frequent pieces are remembered.

Defined cases: null text is empty and has no ids; special tokens inside a text
are recognised as the library does; null ids and repeated rows are rows like
others. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import public_tokenizers

from frostline.llm.common import binary_values, byte_slices, documents, shuffle_partitions

LEAF_BYTES = 16_384
#: Tokens on each side of a join that the first window takes.
FIRST_WINDOW = 32
#: Pieces whose ids a worker remembers, and the longest of these in bytes.
MEMO_PIECES, MEMO_BYTES = 300_000, 40

#: A blank before an ASCII sign or letter, or one of U+00C0 to U+07FF: none of these is white space.
_BREAK = re.compile(rb" (?=[!-~\xc3-\xdf])")
#: Letters and digits that were such in an early Unicode version: all libraries agree on them.
_category = unicodedata.ucd_3_2_0.category


def kind(text: str) -> str | None:
    """The one kind of all characters (letters, digits, signs), else None. An
    apostrophe has none, as it may begin a contraction."""
    kinds = {("S" if c[0] in "PS" else c[0]) for c in map(_category, set(text))}
    found = kinds.pop() if len(kinds) == 1 and "'" not in text else None
    return found if found in ("L", "N", "S") else None


def byte_symbols() -> dict[str, int]:
    """The characters that stand for the 256 bytes in a byte-level vocabulary:
    visible ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        symbols = byte_symbols()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bytes = [t.encode() if t in special else bytes(symbols[c] for c in t) for t in tokens]
        self.decimal = [b"%d" % i for i in range(len(tokens))]
        self.memo: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def piece(self, text: bytes) -> bytes:
        """Ids of a blank and a piece that follows it."""
        ids = self.memo.get(text)
        if ids is None:
            ids = self.whole(b" " + text)
            if len(text) <= MEMO_BYTES and len(self.memo) < MEMO_PIECES:
                self.memo[text] = ids
        return ids

    def encode(self, text: bytes) -> array:
        first, *rest = _BREAK.split(text)
        ids = array("I", self.whole(first))
        ids.frombytes(b"".join(map(self.piece, rest)))
        return ids

    def text(self, ids: array) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: array) -> str:
        return self.text(ids).decode("utf-8", "replace")

    # --- tree concatenation ---

    def _tokens_in(self, ids: array, size: int) -> int:
        """How many leading tokens make up ``size`` bytes."""
        n = 0
        while size > 0:
            size -= len(self.bytes[ids[n]])
            n += 1
        return n

    def _at_breaks(self, left: array, right: array, all_left: bool, all_right: bool):
        """A window between sure breaks, one more on each side than needed, so that the
        tokens between the outer and the inner break must come out as they were."""
        a, b = self.text(left), self.text(right)
        before = [m.start() for m in _BREAK.finditer(a)]
        after = [m.start() for m in _BREAK.finditer(b)]
        if (len(before) < 2 and not all_left) or (len(after) < 2 and not all_right):
            return None
        start, inner = (before[-2], before[-1]) if len(before) > 1 else (0, 0)
        end, back = (after[1], after[0]) if len(after) > 1 else (len(b), len(b))
        ids = self.encode(a[start:] + b[:end])
        skip, stop = self._tokens_in(left, start), self._tokens_in(right, end)
        same_left = left[skip:self._tokens_in(left, inner)]
        same_right = right[self._tokens_in(right, back):stop]
        if ids[:len(same_left)] == same_left and ids[len(ids) - len(same_right):] == same_right:
            return len(left) - skip, ids, stop
        return None

    def _in_run(self, left: array, right: array):
        """The inner half of a window that is one run of characters of a kind."""
        try:
            a, b = self.text(left).decode(), self.text(right).decode()
            n, m = len(left) // 2, len(right) // 2
            tail = self.text(left[len(left) - n:]).decode()
            head = self.text(right[:m]).decode()
        except UnicodeDecodeError:  # a token that ends inside a character
            return None
        if min(n, m) < 2 or min(len(a) - len(tail), len(b) - len(head), len(tail), len(head)) < 16 or not kind(a + b):
            return None
        ids = self.encode((tail + head).encode())
        return (n, ids, m) if len(ids) > 1 and ids[0] == left[len(left) - n] and ids[-1] == right[m - 1] else None

    def join(self, left: array, right: array) -> array:
        """Encoding of the text of two encodings."""
        if not left or not right:
            return left + right
        k = FIRST_WINDOW
        while True:
            a, b = left[-k:], right[:k]
            found = self._at_breaks(a, b, k >= len(left), k >= len(right)) or self._in_run(a, b)
            if found:
                drop, ids, skip = found
                return left[:len(left) - drop] + ids + right[skip:]
            if k >= len(left) and k >= len(right):
                return self.encode(self.text(left + right))
            k *= 2

    def tree(self, leaves: list[array]) -> array:
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i:i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else array("I")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def halves(text: bytes, most: int) -> list[bytes]:
    """Leaves of a text: cut in half until none is longer than ``most`` bytes, between characters."""
    n = 1
    while len(text) > n * most:
        n *= 2
    cuts = [len(text) * i // n for i in range(n + 1)]
    for i in range(1, n):
        while cuts[i] < len(text) and text[cuts[i]] & 0xC0 == 0x80:
            cuts[i] += 1
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


# --- Spark steps ------------------------------------------------------------

#: What a row can hold beside the id, and its Spark type.
OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def _rows(c: Codec, docs: list, encoded: list[array], outputs: tuple[str, ...]) -> pa.RecordBatch:
    cells: dict[str, list] = {o: [] for o in outputs}
    for ids in encoded:
        text = c.decode(ids) if {"decoded", "decoded_sha256"} & cells.keys() else None
        for o, cell in cells.items():
            cell.append(ids.tolist() if o == "ids" else len(ids) if o == "n_tokens" else text if o == "decoded"
                        else hashlib.sha256(b",".join(map(c.decimal.__getitem__, ids)) if o == "ids_sha256" else text.encode()).hexdigest())
    types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *[pa.array(v, types.get(o, pa.string())) for o, v in cells.items()]],
                                      names=["doc_id", *outputs])


def _encode_rows(path: str, outputs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in byte_slices(batches, "text", 1 << 20):
            yield _rows(c, b.column("doc_id").to_pylist(), [c.encode(t or b"") for t in binary_values(b.column("text"))], outputs)
    return run


def _leaves(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text", 1 << 20):
            for doc, row, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), binary_values(b.column("text"))):
                parts = halves(text, most)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([row] * n, pa.int64()),
                                                  pa.array(range(n), pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "row", "leaf", "part"])
    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in byte_slices(batches, "part", 1 << 20):
            ids = [c.encode(p).tobytes() for p in b.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("leaf"), pa.array(ids, pa.binary())],
                                             names=["doc_id", "row", "leaf", "ids"])
    return run


def _join_leaves(path: str, outputs: tuple[str, ...]):
    def run(table: pa.Table) -> pa.Table:
        c = codec(path)
        leaves = sorted(zip(table.column("leaf").to_pylist(), table.column("ids").to_pylist()))
        ids = c.tree([array("I", x) for _, x in leaves])
        return pa.Table.from_batches([_rows(c, [table.column("doc_id")[0].as_py()], [ids], outputs)])
    return run


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids",), leaf_bytes: int = LEAF_BYTES,
           id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and ``outputs`` (see OUTPUTS) of its encoding."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = ", ".join(["doc_id long", *[f"{o} {OUTPUTS[o]}" for o in outputs]])
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = docs.filter(size <= leaf_bytes).mapInArrow(_encode_rows(path, outputs), schema)
    # the row number tells apart rows of equal id; a document's ids, like its text, fit one task
    leaves = (docs.filter(size > leaf_bytes).withColumn("row", F.monotonically_increasing_id())
              .mapInArrow(_leaves(leaf_bytes), "doc_id long, row long, leaf long, part binary")
              .repartition(shuffle_partitions(docs.sparkSession), "row", "leaf")
              .mapInArrow(_encode_leaves(path), "doc_id long, row long, leaf long, ids binary"))
    return short.unionByName(leaves.groupBy("row").applyInArrow(_join_leaves(path, outputs), schema))


def op7_tree_concatenation(spark, sf_dir):
    """Ids of every document and their decoding."""
    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))
