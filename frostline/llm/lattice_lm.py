"""LM scoring by subword lattice likelihood.

The vocabulary is that of an existing subword tokenizer; a piece's unigram
score is its relative frequency in the training texts, as the tokenizer cuts
them, sharpened by one round of expected counts over all segmentations. A
text's probability is the sum over all its segmentations, computed by a
forward recursion in log space, times that of the end symbol. Pieces carry
their blank in front and never reach past a word, so a text's probability is
the product of its words', and each distinct word is computed once.

Beside it stands the base model: smoothed frequencies of whole words.

Words are counted in one pass (partial counts in the tasks, then a sum by
word). The table of words grows with the corpus. Its most frequent words, at
most HEAD_WORDS of them, go to every task (those over HEAD_BYTES as a digest); all
other words of a document meet the table in a join. No word of that join is
frequent, so none loads a single task.

A long word's lattice is worked on in stretches, which pass on their last few
sums: time and memory follow its length, whatever it is.

Defined cases: null text is empty and scores the end symbol alone. Characters
outside the vocabulary are spelled by its byte pieces. A null id counts as the
empty id in the split. Repeated rows are rows like others; with nothing to
learn from, all counts are zero and the smoothing alone speaks. Columns other
than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import binary_values, byte_slices, documents, id_crc, settle

HEAD_WORDS, HEAD_BYTES = 1 << 17, 64
#: Characters of words whose lattices are worked on together.
SLICE_CHARS = 1 << 16
#: Words of more characters are worked on one by one, in stretches of so many characters.
LONG_WORD, LONG_STRETCH = 256, 1 << 15
PRIME = np.uint64(0x100000001B3)
#: Added to every count of the base model, as the contract fixes it, and of the piece model.
SMOOTHING = 0.1
BLANK, END = "▁", "</s>"


class Lattice:
    """Piece scores (natural logarithms) and the sums over segmentations.

    Words of equal length are treated together, as rows of arrays; pieces are
    found by the hash of a stretch of characters."""

    def __init__(self, pieces: list[str], counts: dict[str, float]):
        raw = np.array([counts.get(p, 0.0) for p in pieces]) + SMOOTHING
        scores = np.log(raw / raw.sum())
        place = {p: i for i, p in enumerate(pieces)}
        self.pieces, self.end = pieces, float(scores[place[END]])
        self.byte_place = np.array([place[f"<0x{b:02X}>"] for b in range(256)])
        self.byte_scores = scores[self.byte_place]
        # control, byte and unknown symbols don't match text
        text = [p for p in pieces if not (p.startswith("<") and p.endswith(">")) and BLANK not in p[1:]]
        self.longest = max(map(len, text))
        hashes = np.concatenate([reduce(lambda h, c: h * PRIME + c, np.split(_codes([p])[0], len(p))) for p in text])
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], np.array([place[p] for p in text])[order]
        self.scores = scores[self.places]

    def _stretches(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length n: the scores (-inf: none) and numbers (-1: none) of the pieces that are the n
        characters from each place on; codes: (..., characters)."""
        h = codes
        for n in range(1, min(self.longest, codes.shape[-1]) + 1):
            if n > 1:
                h = h[..., :-1] * PRIME + codes[..., n - 1:]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            yield n, np.where(hit, self.scores[at], -np.inf), np.where(hit, self.places[at], -1)

    def _spell(self, codes: np.ndarray, score: np.ndarray, piece: np.ndarray) -> None:
        """Fills in the characters outside the vocabulary: the sum of their byte pieces, number -2."""
        for c in np.unique(codes[piece == -1]):
            same = (piece == -1) & (codes == c)
            score[same] = self.byte_scores[list(chr(c).encode("utf-8", "replace"))].sum()
            piece[same] = -2

    def _edges(self, codes: np.ndarray):
        """For each end j and length n: the scores of the pieces (-inf: none) and their numbers
        (-1: none, -2: a character outside the vocabulary, spelled by bytes)."""
        edges = {}
        for n, score, piece in self._stretches(codes):
            if n == 1:
                self._spell(codes, score, piece)
            for j in np.flatnonzero((piece != -1).any(axis=0)):
                edges[int(j) + n, n] = score[:, j], piece[:, j]
        return edges

    def _hits(self, codes: np.ndarray, lo: int, hi: int):
        """The pieces that end at the places lo + 1 to hi of one long word, by their ends: the end of each, its
        length, score and number, and where those of an end begin."""
        first = max(0, lo + 1 - self.longest)
        part, found = codes[first:hi], []
        for n, score, piece in self._stretches(part):
            if n == 1:
                self._spell(part, score, piece)
            start = np.flatnonzero(piece != -1)
            end = first + start + n
            keep = end > lo
            start, end = start[keep], end[keep]
            found.append((end, np.full(len(end), n), score[start], piece[start]))
        end, length, score, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(end, kind="stable")
        end = end[order]
        return end, length[order], score[order], piece[order], np.searchsorted(end, np.arange(lo + 1, hi + 2))

    def _long_forward(self, codes: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all segmentations of each prefix of one long word. Stretch by stretch; within
        one the sums are kept as numbers, divided by a scale that is renewed before they become too small."""
        alpha = np.zeros(len(codes) + 1)
        recent, scale = [1.0], 0.0  # sums at the last ``longest`` places, times exp(-scale)
        for lo in range(0, len(codes), LONG_STRETCH):
            hi = min(len(codes), lo + LONG_STRETCH)
            _, length, score, _, at = self._hits(codes, lo, hi)
            ways, back, at = np.exp(score).tolist(), (-length).tolist(), at.tolist()
            for j in range(lo + 1, hi + 1):
                total = 0.0
                for k in range(at[j - lo - 1], at[j - lo]):
                    total += recent[back[k]] * ways[k]
                if total < 1e-100:  # a character can be worth e-60 at most: all stay far above the least float
                    recent = [r / total for r in recent[-self.longest:]]
                    scale += math.log(total)
                    total = 1.0
                recent.append(total)
                alpha[j] = math.log(total) + scale
            recent = recent[-self.longest:]
        return alpha

    def _long_expected(self, codes: np.ndarray, weight: float, into: np.ndarray) -> None:
        """Adds the expected count of each piece in ``weight`` occurrences of one long word."""
        alpha = self._long_forward(codes)
        share = np.zeros(len(alpha))
        share[-1] = weight
        for lo in range((len(codes) - 1) // LONG_STRETCH * LONG_STRETCH, -1, -LONG_STRETCH):
            hi = min(len(codes), lo + LONG_STRETCH)
            end, length, score, piece, at = self._hits(codes, lo, hi)
            part = np.exp(alpha[end - length] + score - alpha[end]).tolist()
            first = max(0, lo - self.longest)
            shares, start, at = share[first:hi + 1].tolist(), (end - length - first).tolist(), at.tolist()
            weights = [0.0] * len(part)
            for j in range(hi, lo, -1):
                here = shares[j - first]
                for k in range(at[j - lo - 1], at[j - lo]):
                    w = here * part[k]
                    weights[k] = w
                    shares[start[k]] += w
            share[first:hi + 1] = shares
            weights, known = np.array(weights), piece >= 0
            into += np.bincount(piece[known], weights=weights[known], minlength=len(into))
            for k in np.flatnonzero(piece == -2):
                np.add.at(into, self.byte_place[list(chr(codes[end[k] - 1]).encode("utf-8", "replace"))], weights[k])

    def _forward(self, codes: np.ndarray, edges) -> np.ndarray:
        alpha = np.zeros((codes.shape[0], codes.shape[1] + 1))
        for j in range(1, codes.shape[1] + 1):
            ways = np.stack([alpha[:, j - n] + edges[j, n][0] for n in range(1, min(self.longest, j) + 1) if (j, n) in edges])
            top = ways.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(ways - top).sum(axis=0))
        return alpha

    def words(self, words: list[str]) -> np.ndarray:
        """Logarithm of the probability of each word with its blank."""
        out = np.zeros(len(words))
        for at, codes in _by_length(words):
            if codes.shape[1] > LONG_WORD:
                out[at] = [self._long_forward(c)[-1] for c in codes]
            else:
                out[at] = self._forward(codes, self._edges(codes))[:, -1]
        return out

    def expected(self, words: list[str], weights: np.ndarray, into: np.ndarray) -> None:
        """Adds the expected count of each piece in so many occurrences of each word."""
        for at, codes in _by_length(words):
            if codes.shape[1] > LONG_WORD:
                for i, c in zip(at, codes):
                    self._long_expected(c, float(weights[i]), into)
                continue
            edges = self._edges(codes)
            alpha = self._forward(codes, edges)
            # weight of the segmentations that pass a place
            share = np.zeros(alpha.shape)
            share[:, -1] = weights[at]
            for j in range(codes.shape[1], 0, -1):
                for n in range(1, min(self.longest, j) + 1):
                    if (j, n) in edges:
                        score, piece = edges[j, n]
                        w = share[:, j] * np.exp(alpha[:, j - n] + score - alpha[:, j])
                        share[:, j - n] += w
                        found = piece >= 0
                        into += np.bincount(piece[found], weights=w[found], minlength=len(into))
                        for r in np.flatnonzero(piece == -2):
                            np.add.at(into, self.byte_place[list(chr(codes[r, j - 1]).encode("utf-8", "replace"))], w[r])


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of equal length, one row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype="<u4").reshape(len(texts), -1).astype(np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and code points of the words of each length, with their blank in front."""
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(len(w), []).append(i)
    for n, at in places.items():
        step = max(1, SLICE_CHARS // (n + 1))
        for k in range(0, len(at), step):
            yield at[k:k + step], _codes([BLANK + words[i] for i in at[k:k + step]])


_MODELS: dict = {}


def processor(path: str):
    if path not in _MODELS:
        import sentencepiece
        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in byte_slices(batches, "text", 16 << 20, 1 << 16):
        for held in (False, True):
            texts = b.filter(pc.equal(b.column("held_out"), held)).column("text")
            words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))).flatten()
            counts = words.value_counts()
            word, n = counts.field(0), counts.field(1)
            some = pc.not_equal(word, "")  # what blanks at either end leave
            word, n = word.filter(some), n.filter(some)
            yield pa.RecordBatch.from_arrays([word, pa.array([0] * len(n), pa.int64()) if held else n, n], names=["word", "train", "every"])


def _cut_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, found = processor(path), Counter()
        for b in byte_slices(batches, "word", 1 << 20, 20_000):
            for ids, n in zip(sp.encode(b.column("word").to_pylist(), num_threads=1), b.column("train").to_pylist()):
                for i in ids:
                    found[i] += n
        pieces = [sp.id_to_piece(i) for i in found]
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array([float(n) for n in found.values()], pa.float64())], names=["piece", "n"])
    return run


def _expected_pieces(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        found = np.zeros(len(model.pieces))
        for b in byte_slices(batches, "word", 1 << 20, 20_000):
            model.expected(b.column("word").to_pylist(), b.column("train").to_numpy().astype(float), found)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([model.pieces[i] for i in some], pa.string()), pa.array(found[some])], names=["piece", "n"])
    return run


def _word_scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "word", 1 << 20, 20_000):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.words(b.column("word").to_pylist()) / math.log(10))],
                                             names=[*b.schema.names, "log10"])
    return run


def _document_sums(shared):
    """For each document a row with its id and the sums over its frequent words, and one for each other word."""
    names = ["row", "doc_id", "held_out", "word", "n", "words", "known", "base", "score"]
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for b in byte_slices(batches, "text", 2 << 20):
            rows = []
            for row, doc, held, text in zip(*(b.column(n).to_pylist() for n in names[:3]), binary_values(b.column("text"))):
                words = (text or b"").lower().split()
                known, base, score = 0, 0.0, 0.0
                for w, n in Counter(words).items():
                    key = w if len(w) <= HEAD_BYTES else b" " + hashlib.md5(w).hexdigest().encode()
                    h = head.get(key)
                    if h is None:
                        w = w.decode("utf-8", "replace")
                        rows.append((row, None, None, w, n, 0, 0, 0.0, 0.0))
                    else:
                        known += n * h[0]
                        base += n * h[1]
                        score += n * h[2]
                # a blank never occurs in a word: this row meets no word and goes to a place of its own
                rows.append((row, doc, held, f" {row}", 0, len(words), known, base, score))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return run


def score_documents(docs: DataFrame, held_out, path: str, rounds: int = 1, id_col: str = "doc_id", text: str = "text",
                    head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10). ``held_out``: a condition on ``doc_id``; the other rows are learned from."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", held_out)
    words = settle(docs.select("text", "held_out").mapInArrow(_counted, "word string, train long, every long")
                   .groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every")), "words")
    texts = docs.filter(~F.col("held_out")).count()
    sums = words.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    total, distinct = sums["n"] + texts, sums["v"] + (texts > 0)
    log_base = lambda c: F.log10((c + SMOOTHING) / F.lit(total + SMOOTHING * (distinct + 1)))
    py_base = lambda c: math.log10((c + SMOOTHING) / (total + SMOOTHING * (distinct + 1)))

    sp = processor(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    trained = words.filter("train > 0").select("word", "train")

    def lattice(step) -> Lattice:  # as many rows at most as the vocabulary has pieces
        found = trained.mapInArrow(step, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        return Lattice(pieces, {r["piece"]: r["n"] for r in found} | {END: texts})

    model = lattice(_cut_pieces(path))
    for _ in range(rounds):
        model = lattice(_expected_pieces(spark.sparkContext.broadcast(model)))
    words = settle(words.mapInArrow(_word_scores(spark.sparkContext.broadcast(model)), "word string, train long, every long, log10 double"), "word-scores")

    # the least frequency that at most head_words words reach: a power of two
    level = F.floor(F.log2("every"))
    fits, least = head_words, 1 << 62
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        fits -= r["count"]
        if fits < 0:
            break
        least = 1 << r["level"]
    key = F.when(F.octet_length("word") <= HEAD_BYTES, F.col("word")).otherwise(F.concat(F.lit(" "), F.md5("word")))
    table = words.filter(F.col("every") >= least).select(key.alias("key"), "train", "log10").toArrow()
    head = {w.encode(): (int(c > 0), py_base(c), s) for w, c, s in zip(*(table.column(n).to_pylist() for n in ("key", "train", "log10")))}
    found = (docs.withColumn("row", F.monotonically_increasing_id())
             .mapInArrow(_document_sums(spark.sparkContext.broadcast(head)),
                         "row long, doc_id long, held_out boolean, word string, n long, words long, known long, base double, score double"))
    joined = found.join(words.select(F.col("word").alias("w_word"), "train", "log10"), F.col("word") == F.col("w_word"), "left")
    n, train = F.col("n"), F.coalesce("train", F.lit(0))
    scored = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        F.sum("words").alias("words"), F.sum(F.col("known") + n * (train > 0).cast("int")).alias("known"),
        F.sum(F.col("base") + F.when(n > 0, n * log_base(train)).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(n > 0, n * F.col("log10")).otherwise(0.0)).alias("score"))
    return scored.select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + int(texts > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + py_base(texts)).alias("base_score"),
        (F.col("score") + model.end / math.log(10)).alias("score"))


def op4_subword_lattice(spark, sf_dir):
    """Scores of every document by a model of nine tenths of them."""
    return score_documents(documents(spark, sf_dir), id_crc() % 10 == 0, public_tokenizers.path("piece_bpe_32k.model"))
