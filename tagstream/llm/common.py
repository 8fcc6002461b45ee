"""What the training-data operators share: shared-folder tables, words, components.

Everything here is deterministic: a task that runs again after an executor is lost
makes the same rows, so nothing depends on arrival order.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagstream.operators.shared import connected_components, discard, materialize, shared_dir, work_path  # noqa: F401  the operators take them from here

#: Returns free memory to the system, where the C library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def local_path(path: str) -> str:
    """The file-system path of a `file:` URI or plain path, for memory mapping; others are refused."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory mapping needs a mounted shared folder, not {path}")
    return path


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def third(doc_id: str | Column = "doc_id", modulus: int = 3) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table has; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df.select(*names)


def bounded_sample(rows: DataFrame, group: str, per_group: int, key: str) -> DataFrame:
    """Up to `per_group` rows of each group, those with the least hashes of `key`, and their rank.

    Groups are counted first, so that about twice as many rows as wanted are shuffled, however large the
    group; the rank decides exactly. Where so few hashes are under the cut that a group would be short,
    which the margin makes all but impossible, the group is a little smaller.
    """
    spread = 1 << 30
    share = F.least(F.lit(1.0), F.lit(2.0 * per_group + 100) / F.col("_n"))
    cuts = rows.groupBy(group).agg(F.count("*").alias("_n")).select(F.col(group).alias("_group"), (share * spread).alias("_cut"))
    cuts = materialize(cuts, "cuts")
    if cuts.count() <= 1 << 16:
        cuts = F.broadcast(cuts)  # then no row is shuffled before the cut
    near = rows.join(cuts, rows[group] == F.col("_group")).where(F.pmod(F.xxhash64(key), F.lit(spread)) < F.col("_cut")).select(*rows.columns)
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key, *[c for c in rows.columns if c not in (group, key)])
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_group)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Lower-case A-Z, split at ASCII white space: word offsets per text, and the words.

    Null texts have no words. Works in Arrow's C++ kernels; only distinct words reach Python.
    """
    # a cast slice keeps its place in the whole, which the kernels below don't heed: copied, it starts at 0
    raw = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    parts = pc.ascii_split_whitespace(pc.ascii_lower(raw))
    flat = parts.flatten()
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(parts)).astype(np.int64))])
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        offsets = kept[offsets]
        flat = flat.filter(pa.array(full))
    return offsets, flat.dictionary_encode()


#: An odd multiplier; words longer than this many bytes are hashed one by one.
_BASE, _LONG = 0x9DDFEA08EB382D69, 256


def word_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """A 64-bit hash of each word, hashing each distinct word once: a polynomial over its bytes, finalised."""
    n = len(words.dictionary)
    if not n or not len(words):
        return np.zeros(len(words), np.uint64)
    d = words.dictionary.cast(pa.large_binary())
    ends = np.frombuffer(d.buffers()[1], np.int64)[d.offset : d.offset + n + 1]
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    data = np.frombuffer(d.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    powers = np.multiply.accumulate(np.full(_LONG, np.uint64(_BASE)))
    place = np.minimum(np.arange(len(data)) - np.repeat(starts, lengths), _LONG - 1)
    distinct = mix64(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], starts) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > _LONG).tolist():
        distinct[i] = xxhash.xxh3_64_intdigest(d[i].as_buffer())
    return distinct[np.asarray(words.indices)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-word shingles; with fewer words, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return out


def shingles_of_many(texts: list[np.ndarray], k: int, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """`shingle_hashes` of texts of k words or more, one behind the other, and the number of each. Made in blocks that stay in the CPU's cache."""
    words = np.concatenate(texts)
    sizes = np.array([len(x) for x in texts])
    hashes = np.concatenate([shingle_hashes(words[a : a + block + k - 1], k) for a in range(0, len(words) - k + 1, block)])
    inside = np.ones(len(words), bool)
    ends = np.cumsum(sizes)
    for n in range(1, k):
        inside[ends - n] = False
    return hashes[inside[: len(hashes)]], sizes - k + 1


def release() -> None:
    """Give memory that a finished task's arrays took back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that releases memory when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with bounded text bytes each, so that long texts don't pile up."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > most_bytes:
            yield start, i
            start, total = i, 0
        total += s
    if len(sizes) > start:
        yield start, len(sizes)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """`mapInArrow` of a function of one batch; `make` runs once a task and may load models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for a, b in slices(batch, batch.schema.get_field_index("text")) if "text" in batch.schema.names else [(0, batch.num_rows)]:
                out = f(batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidy(run), schema)
