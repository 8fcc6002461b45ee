"""Token counts kept by signed deltas: additive rollups by source, language and tokenizer version.

A change is one of: insert (a document's counts come), delete (they go), revise (old counts go, new ones
come). A batch of changes is reduced to one signed row for each (source, lang, tokenizer) and task before
the shuffle, so a source with a third of all rows is no hot group, and is written below the ledger's
folder under its batch id. The rollup is the sum over committed batches.

Committing is idempotent: a batch counts once its marker exists, and the marker is written after the
batch's rows, by a rename that makes it appear whole. A batch id that is committed already is left alone,
whatever comes with it. A batch whose writer died before the marker is written anew. Compaction folds
committed batches into one base, again by a marker, and keeps their ids in a table, so a replay after compaction still
counts once.

Defined results: null source and lang are groups of their own; a null text counts as empty and an empty
text as one document of no tokens; groups whose totals are all zero leave the rollup; repeated rows count
each; an empty batch commits nothing but its id. A ledger without batches gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.llm.common import slices, tidy

KEYS = ["source", "lang", "tokenizer"]
TOTALS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, Callable]) -> DataFrame:
    """One row per document and tokenizer version: doc_id, source, lang, tokenizer, n_tokens, n_chars.

    tokenizers: version name to a function that makes, once a task, a function of a text that gives its ids.
    """
    columns = ["doc_id", "source", "lang", "text"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {name: make() for name, make in tokenizers.items()}
        for batch in batches:
            for a, b in slices(batch, 3):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(3).to_pylist()]
                chars = pa.array([len(t) for t in texts], pa.int64())
                for name, encode in made.items():
                    counts = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
                    yield pa.record_batch([*(part.column(i) for i in range(3)), pa.array([name] * len(texts)), counts, chars], names=["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_chars"])

    return docs.select(*columns).mapInArrow(tidy(f), "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Count rows as signed rows: 1 for documents that come, -1 for those that go."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"), (F.col("n_chars") * sign).alias("n_chars"))


def insert(counts: DataFrame) -> DataFrame:
    return signed(counts, 1)


def delete(counts: DataFrame) -> DataFrame:
    return signed(counts, -1)


def revise(old: DataFrame, new: DataFrame) -> DataFrame:
    return signed(old, -1).unionByName(signed(new, 1))


def nonzero() -> Column:
    return (F.col("n_docs") != 0) | (F.col("n_tokens") != 0) | (F.col("n_chars") != 0)


class Ledger:
    """The rollup below one folder of the shared file system. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, jvm.org.apache.hadoop.fs.Path

    def _markers(self) -> list[dict]:
        fs, path = self._fs()
        root = path(f"{self.path}/commits")
        found = []
        for status in fs.listStatus(root) if fs.exists(root) else []:
            if status.getPath().getName().endswith(".json"):
                stream = fs.open(status.getPath())
                try:
                    found.append(json.loads(bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return found

    def _mark(self, name: str, marker: dict) -> None:
        fs, path = self._fs()
        tmp, to = path(f"{self.path}/commits/.{name}.tmp"), path(f"{self.path}/commits/{name}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()
        if not fs.rename(tmp, to):
            raise RuntimeError(f"another writer committed {name}")

    def _live(self) -> list[dict]:
        """The markers whose rows count: the latest base, and the batches that it doesn't hold."""
        markers = self._markers()
        base = max((m for m in markers if m["kind"] == "base"), key=lambda m: m["number"], default=None)
        batches = [m for m in markers if m["kind"] == "batch"]
        held = self._held(base, [m["batch"] for m in batches])
        return ([base] if base else []) + [m for m in batches if m["batch"] not in held]

    def _held(self, base: dict | None, names: list[str]) -> set[str]:
        """Those of the batch ids that the base holds, from its table of ids."""
        if not base or not names:
            return set()
        ids = self.spark.read.schema("batch string").parquet(base["batches"])
        return {r["batch"] for r in ids.where(F.col("batch").isin(names)).collect()}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add signed rows (source, lang, tokenizer, n_docs, n_tokens, n_chars) once; False if they are in already."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        fs, path = self._fs()
        base = max((m for m in self._markers() if m["kind"] == "base"), key=lambda m: m["number"], default=None)
        if fs.exists(path(f"{self.path}/commits/batch-{batch_id}.json")) or self._held(base, [batch_id]):
            return False
        where = f"{self.path}/deltas/batch={batch_id}"
        reduced = changes.select(*KEYS, *TOTALS).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).where(nonzero())
        reduced.write.mode("overwrite").parquet(where)
        self._mark(f"batch-{batch_id}", {"kind": "batch", "batch": batch_id, "path": where})
        return True

    def rollup(self) -> DataFrame:
        """Totals by source, lang and tokenizer over all committed batches."""
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[m["path"] for m in live])
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).where(nonzero())

    def compact(self) -> None:
        """Fold all committed batches into a new base with a table of their ids. Their markers go, so that there are as
        many as batches since the last compaction; a writer that dies before they are gone leaves them without effect."""
        live = self._live()
        fresh = [m["batch"] for m in live if m["kind"] == "batch"]
        if not fresh:
            return
        base = next((m for m in live if m["kind"] == "base"), None)
        number = 1 + (base["number"] if base else 0)
        where = f"{self.path}/base/v={number}"
        self.rollup().write.mode("overwrite").parquet(where)
        ids = self.spark.createDataFrame([(b,) for b in fresh], "batch string")
        if base:
            ids = ids.unionByName(self.spark.read.schema("batch string").parquet(base["batches"]))
        ids.write.mode("overwrite").parquet(f"{self.path}/held/v={number}")
        self._mark(f"base-{number}", {"kind": "base", "number": number, "path": where, "batches": f"{self.path}/held/v={number}"})
        fs, path = self._fs()
        for name in [f"batch-{b}" for b in fresh] + ([f"base-{base['number']}"] if base else []):
            fs.delete(path(f"{self.path}/commits/{name}.json"), False)
