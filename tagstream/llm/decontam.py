"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of non-ASCII characters. A window is
`size` consecutive words of an item; an item of fewer words, but not none, is one window. The windows,
each as its words between single blanks, form the automaton; a text, normalised alike, is scanned once,
and every occurrence maps back to words and, through `spans`, to character offsets of the original.

The automaton is built once a Python worker from the broadcast windows and kept for its later tasks. Windows are
dealt over as many automata as keep each under `block_chars` characters, about 45 bytes of memory each (4,000,000:
under 200 MB a worker). A benchmark of up to that size, whose windows' texts count, is one automaton, and texts are
scanned once; each further one is scanned against all rows, and what they find is added up, so neither the broadcast
nor a worker's memory grows past that bound.

Defined results: null texts and texts without words have no words, no hits and no items. Items without
words or with a null id or text match nothing. Items that share a window are all counted. Repeated
documents are scanned each; an empty benchmark leaves all documents clean. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import materialize, require, slices, tidy

#: A-Z lower-cased; every byte that can't be in a word is a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same words for Spark's regular expressions, over lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def between_blanks(w: list[bytes]) -> str:
    """Words between single blanks, one character a byte."""
    return (b" " + b" ".join(w) + b" ").decode("latin-1")


def windows(items: list[tuple], size: int) -> dict[str, set]:
    """Each distinct window of the (id, text) items and the ids that have it."""
    found: dict[str, set] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(between_blanks(w[i : i + size]), set()).add(item)
    return found


class Matcher:
    """The automaton over windows; `scan` gives the hit words and items of a text."""

    def __init__(self, found: dict[str, set]):
        self.automaton = ahocorasick.Automaton()
        for window, items in found.items():
            self.automaton.add_word(window, (len(window), window.count(" ") - 1, tuple(items)))
        self.automaton.make_automaton()
        self.any = bool(found)

    def occurrences(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges (first, one past the last) of all occurrences, and the items they stem from."""
        if not self.any or not w:
            return [], set()
        ends, items = [], set()
        for end, (_, n, ids) in self.automaton.iter(between_blanks(w)):
            ends.append((end, n))
            items.update(ids)
        if not ends:
            return [], items
        after = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)  # the blank after each word
        last = np.searchsorted(after, [e for e, _ in ends])
        return [(int(j) - n + 1, int(j) + 1) for j, (_, n) in zip(last, ends, strict=True)], items


_BUILT: dict[str, Matcher] = {}


def matcher_of(key: str, found) -> Matcher:
    """The automaton of a block's broadcast windows, built once a worker, which keeps the last one."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(found.value)
    return _BUILT[key]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets, in the original text, of word ranges."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in ranges]


def items_digest(items: Column) -> Column:
    """sha256 of the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def blocks(benchmark: DataFrame, size: int, block_chars: int) -> Iterator[dict[str, set]]:
    """The windows of all items, a bounded block at a time."""
    rows = require(benchmark, "item_id", "text").where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    batch, held = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        batch.append((r["item_id"], r["text"]))
        held += size * len(r["text"])
        if held >= block_chars:
            yield windows(batch, size)
            batch, held = [], 0
    if batch:
        yield windows(batch, size)


def _scan(docs: DataFrame, found: dict[str, set]) -> DataFrame:
    """doc_id, text's word count, merged word ranges, their character spans and the items of one block."""
    shared, key = docs.sparkSession.sparkContext.broadcast(found), uuid.uuid4().hex  # at most block_chars and one item more

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(key, shared)
        for batch in batches:
            for a, b in slices(batch, 1):
                part = batch.slice(a, b - a)
                counts, ranges, spans, items = [], [], [], []
                for text in part.column(1).to_pylist():
                    w = words(text)
                    hit, own = matcher.occurrences(w)
                    merged = merge(hit)
                    counts.append(len(w))
                    ranges.append([x for r in merged for x in r])
                    spans.append([x for r in char_spans(text, merged) for x in r] if merged else [])
                    items.append(sorted(own))
                yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["row_id", "n_words", "ranges", "spans", "items"])

    return docs.mapInArrow(tidy(f), "row_id long, n_words long, ranges array<long>, spans array<long>, items array<string>")


def merge_pairs(c: Column) -> Column:
    """Flat (start, end) pairs of several blocks, merged where they overlap or touch."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(c) / 2).cast("int") - 1), lambda i: F.struct(F.element_at(c, 2 * i + 1).alias("a"), F.element_at(c, 2 * i + 2).alias("b"))))
    empty = F.array().cast("array<bigint>")
    step = lambda acc, p: F.when((F.size(acc) > 0) & (p["a"] <= F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), p["b"])))).otherwise(F.concat(acc, F.array(p["a"], p["b"])))
    return F.when(F.size(c) == 0, empty).otherwise(F.aggregate(pairs, empty, step))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated.

    docs: doc_id long, text string. benchmark: item_id, text. `spans` has the hit characters' offsets
    in the original text as start, end, start, end, ...
    """
    docs = require(docs, "doc_id", "text")
    all_blocks = blocks(benchmark, size, block_chars)
    first = next(all_blocks, {})
    out = _scan(docs, first)
    second = next(all_blocks, None)
    if second is not None:
        # rows have no key of their own: they get one, fixed in the shared folder, and the blocks' finds meet by it
        keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
        scans = [_scan(keyed.select("_row", "text"), b) for b in (first, second)]
        scans += [_scan(keyed.select("_row", "text"), b) for b in all_blocks]
        union = scans[0]
        for s in scans[1:]:
            union = union.unionByName(s)
        met = union.groupBy("row_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        met = met.withColumn("ranges", merge_pairs(F.col("ranges"))).withColumn("spans", merge_pairs(F.col("spans")))
        out = met.join(keyed.select(F.col("_row").alias("row_id"), "doc_id"), "row_id").drop("row_id").withColumnRenamed("doc_id", "row_id")
    lengths = F.aggregate(F.transform("ranges", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.select(F.col("row_id").alias("doc_id"), "n_words", lengths.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("ranges") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text holds no window of the benchmark. No shuffle."""

    def clean(found: dict[str, set], at: int):
        shared, key = docs.sparkSession.sparkContext.broadcast(found), uuid.uuid4().hex

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(key, shared)
            for batch in batches:
                for a, b in slices(batch, at):
                    part = batch.slice(a, b - a)
                    yield part.filter(pa.array([not matcher.occurrences(words(t))[0] for t in part.column(at).to_pylist()], pa.bool_()))

        return f

    schema, at = docs.schema, docs.columns.index("text")
    for found in blocks(benchmark, size, block_chars):
        docs = docs.mapInArrow(tidy(clean(found, at)), schema)
    return docs
