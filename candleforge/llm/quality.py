"""Quality by nearest-neighbour voting in a latent space.

A text's terms are its lower-cased words, hashed to bins, and runs of three *shape* symbols: letters fall to one of two
symbols by case, digits to one, white space, line ends and each ASCII sign stay themselves. To the shapes come a few
terms for how much a text repeats words and lines. Both kinds are weighted by tf-idf and brought to fixed shares, and a
truncated singular-value decomposition, fitted on a bounded sample of labelled documents, gives latent vectors. The
terms of that sample are counted where its documents are read and fitted in one task, so that no text goes to the
driver. The sample's vectors are broadcast; for every document the exact cosines with all of them are computed in
blocks, and the nearest labels vote, weighted by similarity.

labels, lang, source and the id are never inputs of a score.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.llm.common import binaries, portions

#: Bounds of the fit: labelled documents taken (those with the least hash of their id), latent dimensions, voters.
SAMPLE = 4000
DIMENSIONS = 48
VOTERS = 15
#: Cosines count as equal to so many decimals; all that tie with the last voter vote.
DECIMALS = 5
#: Held out of the fit: crc32(id as text) mod FOLDS = HELD_OUT.
FOLDS, HELD_OUT = 3, 1

#: Texts whose terms are held at once.
PORTION = 128

_BINS = 2048
_REPEATS = 24
_SHAPES = _BINS + _REPEATS
TERMS = _SHAPES + _BINS
#: Length of the words' part of a vector, that of the shapes' part being 1.
_WORDS = 0.7


def _symbols() -> np.ndarray:
    """Byte to shape symbol, below 64."""
    out = np.full(256, 1, dtype=np.uint32)  # bytes of non-ASCII letters count as lower case
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    for i, b in enumerate(signs):
        out[b] = 6 + i
    for b in range(256):
        c = chr(b)
        if b < 128 and c.isupper():
            out[b] = 2
        elif b < 128 and c.isdigit():
            out[b] = 3
        elif c in "\n\r":
            out[b] = 4
        elif b <= 32:
            out[b] = 5
    return out


_SHAPE = _symbols()


def _share_bin(share: float, bins: int = 12) -> int:
    return min(bins - 1, int(share * bins))


def features(texts: list[bytes]) -> np.ndarray:
    """Term counts, one row per text."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    for i, text in enumerate(texts):
        for at in range(0, len(text), 1 << 20):  # long texts by parts that overlap by two bytes
            s = _SHAPE[np.frombuffer(text[at : at + (1 << 20) + 2], dtype=np.uint8)]
            if len(s) >= 3:
                gram = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
                out[i, :_BINS] += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(21), minlength=_BINS)
        words = text.split()
        if words:
            lines = [x for x in text.split(b"\n") if x.strip()]
            weight = max(1.0, float(out[i, :_BINS].sum())) / 4  # a quarter as heavy as the shapes
            expected = min(1.0, 60.0 / len(words))  # long texts repeat common words anyway
            fresh = (len(set(words)) / len(words) - expected) / max(1e-9, 1 - expected) if expected < 1 else 1.0
            out[i, _BINS + _share_bin(max(0.0, fresh))] = weight
            out[i, _BINS + 12 + _share_bin(len(set(lines)) / len(lines))] = weight
            counts = Counter(text.lower().split())
            bins = np.fromiter((zlib.crc32(w) % _BINS for w in counts), dtype=np.int64, count=len(counts))
            out[i, _SHAPES:] = np.bincount(bins, np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), minlength=_BINS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, or 0."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)
    x *= idf
    x[:, :_SHAPES] = _unit(x[:, :_SHAPES])
    x[:, _SHAPES:] = _unit(x[:, _SHAPES:]) * np.float32(_WORDS)
    return x


@dataclass(frozen=True)
class Model:
    """idf weights, projection to the latent space, and the labelled vectors there (rows of unit length)."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    voters: int

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 1.0

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.idf) @ self.projection)

    def scores(self, counts: np.ndarray, block: int = 128) -> np.ndarray:
        """Votes of the nearest labelled vectors; the prior where there is nothing to compare."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k, n = min(self.voters, len(self.labels)), len(self.labels)
        for at in range(0, len(counts), block):
            z = self.latent(counts[at : at + block])
            cosine = np.round(z @ self.vectors.T, DECIMALS)
            least = np.partition(cosine, n - k, axis=1)[:, n - k]
            weight = np.where(cosine >= least[:, None], np.maximum(cosine, 0), 0).astype(np.float64)
            weight = ((weight**2) ** 2) ** 2
            total = weight.sum(1)
            known = (total > 0) & (np.abs(z).sum(1) > 0)
            out[at : at + block] = np.where(known, np.divide(weight @ self.labels, total, out=np.zeros_like(total), where=known), self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, voters: int = VOTERS) -> Model:
    """The latent space of these term counts, one row per text, and their labels in it. The right singular vectors are
    found by subspace iteration from a fixed start, in memory a few times that of the counts."""
    n = len(counts)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    if not n:
        return Model(idf, np.zeros((TERMS, 1), dtype=np.float32), np.zeros((0, 1), dtype=np.float32), np.zeros(0), voters)
    x = _weighted(counts, idf)
    width = min(dimensions + 16, n)
    basis = x.T @ np.random.default_rng(1).normal(size=(n, width)).astype(np.float32)
    for _ in range(6):
        basis = x.T @ (x @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    inner = (x @ basis).astype(np.float64)
    projection = basis @ np.linalg.eigh(inner.T @ inner)[1][:, ::-1][:, : min(dimensions, n)].astype(np.float32)
    return Model(idf, projection, _unit(x @ projection), np.asarray(labels, dtype=np.float64), voters)


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from the fit; a null id is, as it has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(lot, key, label, terms binary, counts binary): of at most `sample` labelled documents, those with the least hash
    of their id, the terms that occur and how often.

    A label that is null, or of a held-out id, does not take part; of an id labelled twice the greater label does, and of
    one present twice the text with the least hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, PORTION):
            rows = features(binaries(batch.column("text")))
            held = [np.flatnonzero(r).astype(np.uint16) for r in rows]
            columns = [pa.array([t.tobytes() for t in held], pa.binary()), pa.array([r[t].tobytes() for r, t in zip(rows, held)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "label", "version")), *columns], names=["key", "label", "version", "terms", "counts"])

    key = F.col(id_col).cast("long")
    usable = labels.select(key.alias("key"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    one = usable.groupBy("key").agg(F.max("label").alias("label"))
    # twice the sample, as some labelled documents may be gone; a bounded top-k
    picked = one.orderBy(F.xxhash64("key"), "key").limit(2 * sample)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    texts = docs.select(key.alias("key"), text).join(F.broadcast(picked), "key").select("key", "label", F.xxhash64("text").alias("version"), F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(run, "key long, label int, version long, terms binary, counts binary")
    least = counted.groupBy("key").agg(F.min(F.struct("version", "label", "terms", "counts")).alias("one"))
    return least.select(F.xxhash64("key").alias("lot"), "key", "one.label", "one.terms", "one.counts").orderBy("lot", "key").limit(sample)


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a training_sample(), fitted in one task: `sample` rows of TERMS numbers. The driver gets the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("lot", "key", "label", "terms", "counts"))))
        counts = np.zeros((len(rows), TERMS), dtype=np.float32)
        for own, (*_, terms, many) in zip(counts, rows):
            own[np.frombuffer(terms, dtype=np.uint16)] = np.frombuffer(many, dtype=np.float32)
        model = fit(counts, np.array([r[2] for r in rows]))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = training_sample(docs, labels, sample, id_col, text_col)
    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(np.zeros((0, TERMS), dtype=np.float32), np.zeros(0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of docs; null text is empty, and a text without terms scores the sample's mean label.
    Long texts are read whole, a part at a time; cosines that tie with the last voter's all vote."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE x DIMENSIONS and TERMS x DIMENSIONS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in portions(batches, PORTION):
            values = m.scores(features(binaries(batch.column("t"))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values)], names=["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return source.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Without usable labels every score is 1. Null, empty and long texts and ties are handled as by score(). Repeated rows
    and null ids keep their rows; an empty table gives an empty result; other columns are not read.
    """
    model = fitted(docs, labels, sample, id_col, text_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects, all columns kept, whatever their names.

    The verdict is computed beside the row, so repeated or null ids need no join. A null text is judged as an empty one
    and stays null. Without usable labels every row stays; an empty table gives an empty result.
    """
    model = fitted(docs, labels, sample, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in portions(batches, PORTION):
            texts = [(x or "").encode() for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(m.scores(features(texts)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
