"""Language identification by nearest centroid over hashed TF-IDF n-gram vectors.

Fit: of every language, up to `per_lang` labelled documents (a documented bound; which ones, a hash of
the id decides) become vectors of hashed letter n-grams, weighted by inverse document frequency and
normalised. Each language's vectors are clustered by spherical k-means in a task of its own, giving up
to `clusters` centroids. The nearest centroid by cosine names the language of a text.

Rejection: a text is rejected when it is null or has no letter, or when its cosine with the nearest
centroid is under `margin` times the least cosine that a fitting document of its length class has with
its own language. Length classes are powers of four of the number of letters' n-grams, and a class with
few fitting documents takes the bound of the next shorter one, down to no bound.

Defined results: null texts and texts without a letter give `und` with score 0, rejected. With no
labelled row (an empty table, only null languages) every text gives `und` with score 0. Ties go to the
language that sorts first. Whole texts count, however long. lang, source and doc_id are not inputs of a
prediction. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import bounded_sample, materialize, mix64, require, slices, tidy

#: Hashed dimensions, and the n-gram lengths in bytes of the lower-cased text.
DIMENSIONS, LENGTHS = 1 << 14, (1, 2, 3)
UNDETERMINED = "und"

#: Digits, punctuation and control bytes count as white space; A-Z as a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counts(text: str | None) -> np.ndarray:
    """How often each hashed n-gram occurs in a text; long texts go in pieces of 4 MB."""
    words = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())
    out = np.zeros(DIMENSIONS, np.float32)
    if not words:
        return out
    data = np.frombuffer(b" " + words + b" ", np.uint8)
    step = 4 << 20
    for at in range(0, len(data), step):
        piece = data[at : at + step + max(LENGTHS) - 1].astype(np.uint64)
        for k in LENGTHS:
            if len(piece) < k:
                continue
            stop = min(step, len(piece) - k + 1)
            code = np.full(stop, np.uint64(k))
            for i in range(k):
                code = (code << np.uint64(8)) | piece[i : i + stop]
            slot = (mix64(code) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
            out += np.bincount(slot, minlength=DIMENSIONS).astype(np.float32)
    return out


def length_class(total: float) -> int:
    """Powers of four of the number of n-grams."""
    return int(np.log(max(total, 1.0)) / np.log(4))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # unit rows
    idf: np.ndarray
    bounds: dict[str, dict[int, float]]  # least own cosine of fitting documents, by length class
    margin: float

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text that has a letter."""
        order = np.array(self.languages)
        for at in range(0, len(texts), 64):
            raw = np.stack([counts(t) for t in texts[at : at + 64]])
            x = raw * self.idf
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            cos = (x / np.maximum(norms, 1e-12)) @ self.centroids.T
            for row, best, total in zip(cos, cos.argmax(axis=1), raw.sum(axis=1), strict=True):
                lang, score = str(order[best]), float(min(1.0, max(0.0, row[best])))
                yield lang, score, score < self.margin * self.bound(lang, length_class(total))

    def bound(self, lang: str, size: int) -> float:
        own = self.bounds[lang]
        return next((own[c] for c in range(size, -1, -1) if c in own), 0.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch, 1):
            part = batch.slice(a, b - a)
            slots, values = [], []
            for t in part.column(1).to_pylist():
                c = counts(t)
                s = np.flatnonzero(c)
                slots.append(s.astype(np.int32))
                values.append(c[s])
            yield pa.record_batch([part.column(0), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "slots", "values"])


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from well-spread first rows; the same rows in the same order give the same centroids."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(picked) < min(k, len(x)):
        nearest = (x @ x[picked].T).max(axis=1)
        picked.append(int(nearest.argmin()))
    c = x[picked].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    own = (x @ c.T).argmax(axis=1)
    return c[np.bincount(own, minlength=len(c)) > 0]


def _cluster(idf: np.ndarray, clusters: int, few: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def f(key: tuple, table: pa.Table) -> pa.Table:
        x = np.zeros((table.num_rows, DIMENSIONS), np.float32)
        rows = sorted(zip(table.column("slots").to_pylist(), table.column("values").to_pylist(), strict=True))
        for i, (s, v) in enumerate(rows):
            x[i, s] = v
        totals = x.sum(axis=1)
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _kmeans(x, clusters)
        own, size = (x @ c.T).max(axis=1), np.array([length_class(t) for t in totals])
        bounds = {int(z): float(own[size == z].min()) for z in np.unique(size) if (size == z).sum() >= few}
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "centroids": pa.array([c.astype("<f4").tobytes()], pa.binary()), "sizes": pa.array([list(bounds)], pa.list_(pa.int32())), "bounds": pa.array([list(bounds.values())], pa.list_(pa.float64()))})

    return f


def fit(labelled: DataFrame, per_lang: int = 300, clusters: int = 4, margin: float = 0.5, few: int = 20, most_langs: int = 256) -> LanguageModel | None:
    """Learn from `labelled` (doc_id, text, lang); None when no row has a language and a letter.

    The `most_langs` values of lang that most rows have are learned, so that dirty tags don't swell the model. What
    reaches the driver is bounded by them: one idf vector, and `clusters` centroids and a few bounds for each language.
    """
    rows = require(labelled, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    langs = labelled.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(most_langs)
    sample = bounded_sample(rows.join(F.broadcast(langs.select("lang")), "lang", "left_semi"), "lang", per_lang, "doc_id")
    vectors = materialize(sample.select("lang", "text").mapInArrow(tidy(_vectors), "lang string, slots array<int>, values array<float>"), "vectors")
    total = vectors.count()
    if not total:
        return None
    df = np.zeros(DIMENSIONS)
    for r in vectors.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect():  # at most DIMENSIONS rows
        df[r["slot"]] = r["count"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    found = vectors.groupBy("lang").applyInArrow(_cluster(idf, clusters, few), "lang string, centroids binary, sizes array<int>, bounds array<double>").collect()
    found.sort(key=lambda r: r["lang"])
    parts = [np.frombuffer(r["centroids"], "<f4").reshape(-1, DIMENSIONS) for r in found]
    return LanguageModel([r["lang"] for r, c in zip(found, parts, strict=True) for _ in c], np.concatenate(parts), idf, {r["lang"]: dict(zip(r["sizes"], r["bounds"], strict=True)) for r in found}, margin)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """All columns of `docs`, and lang_pred, lang_score (0 to 1), lang_rejected."""
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected", "_has_letter")
    names = [*docs.columns, "lang_pred", "lang_score", "lang_rejected"]
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "lang_score": F.lit(0.0), "lang_rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters * DIMENSIONS floats a language

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b in slices(batch, at):
                part = batch.slice(a, b - a)
                letters = part.column(part.num_columns - 1).to_pylist()
                answers = m.predict([t for t, ok in zip(part.column(at).to_pylist(), letters, strict=True) if ok])
                out = [next(answers) if ok else (UNDETERMINED, 0.0, True) for ok in letters]
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                lang, score, gone = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], names=names)

    schema = docs.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_rejected": F.lit(False)}).schema
    return docs.withColumn("_has_letter", has_letter(F.col("text"))).mapInArrow(tidy(f), schema)
