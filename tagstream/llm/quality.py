"""Quality classification by compression against dictionaries of good and of bad text.

Fit: up to `per_class` labelled documents of each class (a documented bound; a hash of the id decides
which) are split in two halves. From the first half's whole texts two zstandard dictionaries of up to
`dictionary_bytes` are built, each class in a task of its own. A text's feature is the difference of its
compressed sizes under the two, divided by its compressed size without either, and by its length. The other
half calibrates: a logistic curve of that difference in both normalisations, fitted by Newton steps with a small ridge.

Score: the calibrated probability of label 1 in [0, 1], from the mean of the two halves' log odds. The whole text is compressed, in blocks of
`block_bytes` whose sizes add up, so memory is bounded for very long texts.

Defined results: null and empty texts have feature 0 in every part and get the score of the share of
label 1 among the sampled rows. With labels of one class only, every score is that class's share
(0 or 1); with no labelled row it is 0.5. Repeated labels of one document each count. lang, source and
doc_id are never inputs of a score. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import bounded_sample, materialize, require, slices, tidy


@dataclass(frozen=True)
class Half:
    """Dictionaries of one half's texts, and the weights that the other half calibrated."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] = ()

    def features(self, texts: list[str | None], level: int, block_bytes: int) -> np.ndarray:
        def make(d: bytes) -> zstandard.ZstdCompressor:
            if not d:
                return zstandard.ZstdCompressor(level=level)
            known = zstandard.ZstdCompressionDict(d)
            known.precompute_compress(level=level)  # once a batch, not once a text
            return zstandard.ZstdCompressor(dict_data=known)

        good, bad, plain = make(self.good), make(self.bad), make(b"")
        frame = np.array([len(c.compress(b"")) for c in (good, bad, plain)])  # what an empty text costs
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if not raw:
                continue
            sizes = np.zeros(3)
            for at in range(0, len(raw), block_bytes):
                block = raw[at : at + block_bytes]
                sizes += np.maximum([len(good.compress(block)), len(bad.compress(block)), len(plain.compress(block))] - frame, 1)
            out[i] = (sizes[1] - sizes[0]) / sizes[2], (sizes[1] - sizes[0]) / len(raw)
        return out


@dataclass(frozen=True)
class QualityModel:
    halves: tuple[Half, ...]  # none where only one class has rows
    share: float  # of label 1
    level: int = 3
    block_bytes: int = 1 << 17

    def scores(self, texts: list[str | None]) -> np.ndarray:
        empty = np.array([not t for t in texts], bool)
        if not self.halves:
            return np.full(len(texts), self.share)
        z = np.mean([design(h.features(texts, self.level, self.block_bytes)) @ np.array(h.weights) for h in self.halves], axis=0)
        return np.where(empty, self.share, 1 / (1 + np.exp(-np.clip(z, -40, 40))))


def design(x: np.ndarray) -> np.ndarray:
    """Features scaled to about one, and a constant."""
    return np.column_stack([np.ones(len(x)), 10 * x[:, 0], 20 * x[:, 1]])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def dictionary(texts: list[str], size: int) -> bytes:
    """A dictionary of segments that many of the texts have; of too few texts, their bytes themselves."""
    raw = sorted(t.encode("utf-8", "surrogatepass") for t in texts if t)
    pieces = [r[at : at + 131_072] for r in raw for at in range(0, len(r), 131_072)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-size:]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, dictionary_bytes: int = 65_536, level: int = 3) -> QualityModel:
    """Learn from the rows of `docs` (doc_id, text) that `labels` (doc_id, quality) marks 0 or 1.

    Labels are sampled before they meet texts: 2 * per_class of them at most are broadcast, so no text is
    shuffled. Four dictionaries and two numbers a sampled row reach the driver.
    """
    known = require(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = materialize(bounded_sample(known, "quality", per_class, "doc_id"), "picked")
    sample = materialize(require(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "quality", "rank"), "labelled")
    n = {r["quality"]: r["count"] for r in sample.groupBy("quality").count().collect()}
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    if min(n.get(0, 0), n.get(1, 0)) < 4:
        return QualityModel((), share, level)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        d = dictionary(table.column("text").to_pylist(), dictionary_bytes)
        return pa.table({"quality": pa.array([key[0].as_py()], pa.int32()), "half": pa.array([key[1].as_py()], pa.int32()), "bytes": pa.array([d], pa.binary())})

    parts = sample.withColumn("half", (F.col("rank") % 2).cast("int")).select("quality", "half", "text")
    built = {(r["quality"], r["half"]): bytes(r["bytes"]) for r in parts.groupBy("quality", "half").applyInArrow(build, "quality int, half int, bytes binary").collect()}  # four dictionaries
    halves = [Half(built[1, i], built[0, i]) for i in (0, 1)]
    block_bytes = QualityModel((), share).block_bytes

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, 0):
                part = batch.slice(a, b - a)
                texts, own = part.column(0).to_pylist(), np.asarray(part.column(2))
                x = np.where((own == 0)[:, None], halves[1].features(texts, level, block_bytes), halves[0].features(texts, level, block_bytes))  # under the other half's
                yield pa.record_batch([*(pa.array(x[:, i]) for i in range(2)), part.column(1), part.column(2)], names=["a", "b", "quality", "half"])

    seen = parts.where("text <> ''").select("text", "quality", "half").mapInArrow(tidy(measure), "a double, b double, quality int, half int").orderBy("half", "quality", "a", "b").collect()
    fitted = []
    for i, h in enumerate(halves):
        rows = [r for r in seen if r["half"] != i]
        x = np.array([[r["a"], r["b"]] for r in rows]).reshape(-1, 2)
        fitted.append(Half(h.good, h.bad, logistic(design(x), np.array([r["quality"] for r in rows], float))))
    return QualityModel(tuple(fitted), share, level)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score in [0, 1] and predicted (1 where the score is at least 0.5), one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # four dictionaries of fixed size

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b in slices(batch, 1):
                part = batch.slice(a, b - a)
                s = m.scores(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return require(docs, "doc_id", "text").mapInArrow(tidy(f), "doc_id long, score double, predicted int")
