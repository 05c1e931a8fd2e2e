"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (one to three bytes, ASCII
lower-cased, runs of blanks, digits and signs as one blank), weighted by
log(1 + count) times inverse document frequency and scaled to length one. Each
language has a few centroids, found by spherical k-means; a text goes to the
centroid of largest cosine, and is rejected where it lies far off: where the
cosine is under REJECT_SHARE of what nearly all fitted texts of that language reach.

The classifier is fitted on at most FIT_PER_LANGUAGE labelled texts of each
language, chosen by a hash of the id; predictions read whole texts. Any number of languages
can be learned: the centroids lie in a table, and a text meets them in passes of
PASS_LANGUAGES languages, which hand on the best so far.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
rejected; so is every text if there is nothing to learn from. Equal cosines go
to the language first in order. A null id counts as the empty id when choosing
what to learn from; a null language is not learned from. Repeated rows are
rows like others. Columns other than id, text and language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frostline.llm.common import binary_values, byte_slices, documents, id_crc, settle

UNKNOWN = "und"
#: Labelled texts per language that the fit may use: the documented bound of the sample.
FIT_PER_LANGUAGE = 1_000
#: Languages whose centroids one pass over the texts holds (64 KB each), and the most whose counts go to every task.
PASS_LANGUAGES, SENT_LANGUAGES = 500, 100_000
DIMENSIONS, CENTROIDS, ROUNDS = 1 << 12, 4, 12
#: A text is rejected if its cosine is under this share of the one that so many of the
#: language's own fitted texts reach. Measured: see the README.
REJECT_QUANTILE, REJECT_SHARE = 0.99, 0.55
#: k-means starts from rows with one in so many rows near them, and keeps centroids of one in so many.
PEERS, LEAST = 50, 100

# Bytes as the n-grams see them: letters (and all bytes of other scripts) in lower case, the rest blank.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def vectors(texts: list[bytes]) -> np.ndarray:
    """log(1 + count) of the hashed n-grams of each text, one row per text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = _FOLD[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    keep = np.ones(len(data), dtype=bool)  # one blank for a run of blanks
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (row[1:] != row[:-1])
    data, row = data[keep].astype(np.uint32), row[keep]
    counts = np.zeros(len(texts) * DIMENSIONS, dtype=np.int64)
    gram = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, 4):
        m = len(data) - n + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint32(257) + data[n - 1:] + np.uint32(n)
        spot = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        inside = row[:m] == row[n - 1:]
        counts += np.bincount((row[:m] * DIMENSIONS + spot)[inside], minlength=len(counts))
    return np.log1p(counts.reshape(len(texts), DIMENSIONS).astype(np.float32))


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return text.isalpha() or any(map(str.isalpha, text.decode("utf-8", "replace")))


def k_means(m: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """At most ``k`` centroids of unit rows, and the quantile of the rows' distances
    (1 - cosine) to theirs. Starts from rows that have peers nearer than any start so
    far, and drops centroids of a few outliers; deterministic."""
    peer = np.sort(m @ m.T, axis=1)[:, -1 - min(len(m) - 1, max(1, len(m) // PEERS))]
    centres = [unit(m.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(m)):
        gain = peer - (m @ np.array(centres).T).max(axis=1)
        if gain.max() <= 0:
            break
        centres.append(m[np.argmax(gain)])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = (m @ c.T).argmax(axis=1)
        c = unit(np.array([m[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    rows = np.bincount((m @ c.T).argmax(axis=1), minlength=len(c))
    c = c[rows >= min(rows.max(), max(1, len(m) // LEAST))]
    return c, float(np.quantile(1 - (m @ c.T).max(axis=1), REJECT_QUANTILE))


@dataclass
class Model:
    idf: np.ndarray
    names: list[str]        # language of each centroid, in order
    centroids: np.ndarray   # one unit row each
    radius: np.ndarray

    def predict(self, texts: list[bytes | None], before: tuple | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines and whether each text is rejected; ``before``: the same from earlier passes, which
        only a larger cosine replaces."""
        lang, score, out = before or ([UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool))
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.names else []
        if at:
            near = unit(vectors([texts[i] for i in at]) * self.idf) @ self.centroids.T
            best = near.argmax(axis=1)
            top = near[np.arange(len(at)), best]
            for i, b, c in zip(at, best, top):
                if lang[i] == UNKNOWN or c > score[i]:
                    lang[i], score[i], out[i] = self.names[b], np.clip(c, 0, 1), c < REJECT_SHARE * (1 - self.radius[b])
        return lang, score, out


@dataclass
class Fitted:
    idf: np.ndarray
    table: DataFrame | None  # pass, lang, place, centroid, radius
    passes: int

    def model(self, n: int = 0) -> Model:
        """The centroids of one pass."""
        found = self.table.filter(F.col("pass") == n).collect() if self.passes else []
        found.sort(key=lambda r: (r["lang"], r["place"]))
        return Model(self.idf, [r["lang"] for r in found],
                     np.array([np.frombuffer(r["centroid"], "<f4") for r in found], dtype=np.float32).reshape(-1, DIMENSIONS),
                     np.array([r["radius"] for r in found]))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for b in byte_slices(batches, "text", 1 << 20, 512):
        df += (vectors(binary_values(b.column("text"))) > 0).sum(axis=0)
        n += b.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMENSIONS), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], names=["dim", "n"])


def _centroids(idf: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        rows = [vectors(binary_values(b.column("text"))) for b in byte_slices(iter(table.combine_chunks().to_batches()), "text", 1 << 20, 512)]
        found, radius = k_means(unit(np.concatenate(rows) * idf), CENTROIDS)
        return pa.table({"lang": [table.column("lang")[0].as_py()] * len(found), "place": list(range(len(found))),
                         "centroid": [c.astype("<f4").tobytes() for c in found], "radius": [radius] * len(found)})
    return run


def fit(labelled: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> Fitted:
    """A classifier from rows (doc_id, text, lang); reads at most ``per_language`` texts of each language."""
    rows = (labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .withColumn("draw", F.xxhash64(F.lit("fit"), "doc_id", F.xxhash64("text"))))
    place = F.row_number().over(Window.orderBy("lang")) - 1  # one row per language
    sizes = settle(rows.groupBy("lang").count().select(F.col("lang").alias("s_lang"), "count", F.floor(place / PASS_LANGUAGES).cast("int").alias("pass")), "languages")
    languages = sizes.count()
    if not languages:
        return Fitted(np.zeros(DIMENSIONS, dtype=np.float32), None, 0)
    # a threshold on the draw leaves about twice the bound, so that the exact cut sorts few rows
    counted = F.broadcast(sizes) if languages <= SENT_LANGUAGES else sizes
    share = F.least(F.lit(1.0), 2.0 * per_language / F.col("count"))
    few = rows.join(counted, F.col("lang") == F.col("s_lang")).filter(F.pmod(F.col("draw"), F.lit(1 << 30)) < share * (1 << 30))
    first = Window.partitionBy("lang").orderBy(F.pmod(F.col("draw"), F.lit(1 << 30)), "doc_id", "text")
    sample = settle(few.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_language)
                    .select("lang", "text", "pass"), "language-sample")
    df = {r["dim"]: r["n"] for r in sample.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n = df.get(-1, 0)
    idf = np.array([np.log((1 + n) / (1 + df.get(i, 0))) + 0.1 for i in range(DIMENSIONS)], dtype=np.float32)
    found = (sample.groupBy("lang").applyInArrow(_centroids(idf), "lang string, place long, centroid binary, radius double")
             .join(counted.drop("count"), F.col("lang") == F.col("s_lang")).drop("s_lang"))
    return Fitted(idf, settle(found, "centroids"), -(-languages // PASS_LANGUAGES))


def identify(docs: DataFrame, fitted: Fitted, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected (any such columns of the input are replaced)."""
    made = ("lang_pred", "score", "rejected")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    types = StructType(list(kept.schema.fields))
    for c, t in zip(made, ("string", "double", "boolean")):
        types = types.add(c, t)
    for n in range(max(1, fitted.passes)):
        shared = docs.sparkSession.sparkContext.broadcast(fitted.model(n))  # PASS_LANGUAGES languages at most
        kept = (kept if n == 0 else settle(kept, "language-pass")).mapInArrow(_predicted(shared, text, made, n > 0), types)
    return kept


def _predicted(shared, text: str, made: tuple[str, ...], again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, text, 1 << 20, 512):
            before = (b.column(made[0]).to_pylist(), b.column(made[1]).to_numpy().copy(), np.array(b.column(made[2]).to_pylist(), dtype=bool)) if again else None
            lang, score, out = shared.value.predict(binary_values(b.column(text)), before)
            own = [n for n in b.schema.names if n not in made]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in own], pa.array(lang, pa.string()), pa.array(score), pa.array(out)],
                                             names=[*own, *made])
    return run


def learned_from(remainder: int = 2) -> Column:
    """Documents that the fit may see."""
    return id_crc() % 4 != remainder


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a learned language, with the columns of ``docs``."""
    model = fit(docs.filter(learned_from()).select("doc_id", "text", "lang"))
    made = ("lang_pred", "score", "rejected")
    clash = {c: f"_own_{c}" for c in docs.columns if c in made}
    return (identify(docs.withColumnsRenamed(clash), model).filter(~F.col("rejected")).drop(*made)
            .withColumnsRenamed({v: k for k, v in clash.items()}).select(*[F.col(f"`{c}`") for c in docs.columns]))


def op5_nearest_centroid(spark, sf_dir):
    """The language of every document, learned from three quarters of them."""
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(learned_from()).select("doc_id", "text", "lang"))
    return (identify(docs.select("doc_id", "text"), model)
            .select("doc_id", (~learned_from()).alias("held_out"), "lang_pred", "score", "rejected"))
