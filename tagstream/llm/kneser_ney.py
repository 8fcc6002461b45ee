"""An interpolated modified Kneser-Ney bigram model, counted in Spark, memory-mapped by the workers.

Tokens are words between ASCII white space, A-Z lower-cased, and one end a text. Everything is counted
over all training texts:

1. Word counts. Each task reduces its texts to sorted 64-bit word hashes with counts, cut at fixed
   ranges of the hash; a group of one range merges them to one sorted hash array with its counts.
2. Pair counts. Words under `min_count` are one class in pairs; the others get the number of their place
   in the sorted arrays, so a pair is one exact 64-bit key. Keys travel sorted and delta-coded, cut at
   ranges that the word counts predict to be even, so that a frequent first word is spread over many
   ranges. A group of one range merges them to one sorted key array with its counts.
3. What follows and precedes each word: totals and counts of counts by first word, and distinct first
   words by second word, merged by ranges of word numbers to dense arrays.

The arrays are files below the shared folder, written whole under a temporary name and renamed, so a
task that runs again does no harm. Workers map them into memory and share their pages. A task holds one
range, whose number of entries follows the size of an input partition, not of the corpus.

Score of a token w after h: (c(hw) - D(c(hw))) / c(h) + g(h) * P(w), with three discounts from the counts of
counts, g(h) the discounted mass, and P the same formula over the numbers of distinct first words,
interpolated with the uniform distribution. A word under `min_count`, seen or not, has the probability
of their class, shared evenly by the seen ones and one unseen word; so the model sums to one.

Defined results: null texts count as empty, and an empty text is one end token. Without training texts the
class alone is left. Repeated rows count each time. Extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import local_path, materialize, require, slices, split_words, tidy, word_hashes, work_path

#: No word holds white space, so this names the end; and numbers of the class of rare words and of the start.
END = xxhash.xxh3_64_intdigest(b"\n")
RARE, START, FIRST = 0, 1, 2
#: Word numbers in one dense array, and text bytes that are counted at once.
SPAN, SLICE = 1 << 18, 32 << 20


def pack(a: np.ndarray) -> bytes:
    """Sorted or small integers: differences by byte planes, compressed."""
    d = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(d.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    d = np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(d, dtype=np.uint64)


def save(path: str, a: np.ndarray) -> None:
    """Whole or not at all, however often a task runs."""
    tmp = f"{path}.{os.getpid()}.{xxhash.xxh3_64_hexdigest(os.urandom(8))}.tmp"
    with open(tmp, "wb") as f:
        np.save(f, a)
    os.replace(tmp, path)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def hash_range(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes (the end first), each token's place in them, text starts, and tokens a text."""
    offsets, words = split_words(texts)
    distinct = np.concatenate([np.array([END], np.uint64), word_hashes(pa.DictionaryArray.from_arrays(pa.array(np.arange(len(words.dictionary), dtype=np.int32)), words.dictionary))])
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n)
    place = np.zeros(offsets[-1] + n, np.int64)
    inside = np.ones(len(place), bool)
    inside[starts + lengths] = False
    place[inside] = np.asarray(words.indices).astype(np.int64) + 1
    return distinct, place, starts, lengths + 1


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of bounded text, small batches put together."""
    held, size = [], 0
    for batch in batches:
        for a, b in slices(batch, column, SLICE):
            part = batch.slice(a, b - a)
            held.append(part)
            size += part.column(column).nbytes
            if size >= SLICE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield t.to_batches()[0]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that all workers need."""

    root: str
    word_parts: int
    pair_parts: int
    first_number: np.ndarray  # of each word range
    first_mass: np.ndarray  # count of all frequent words before each word range
    tokens: int  # N
    types: int  # V
    frequent: int
    rare_types: int
    rare_mass: int
    texts: int
    min_count: int
    discounts: tuple[float, ...] = ()  # of pairs
    low_discounts: tuple[float, ...] = ()  # of distinct first words
    low_mass: float = 0.0  # what the low discounts free, over all pairs' types
    pair_types: int = 0

    def open(self, name: str, part: int) -> np.ndarray:
        cache = _OPEN.setdefault(self.root, {})
        if (name, part) not in cache:
            path = f"{self.root}/{name}-{part}.npy"
            cache[name, part] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return cache[name, part]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, number and the mass of the frequent words before, of each distinct hash."""
        count, number, mass = np.zeros(len(hashes), np.int64), np.full(len(hashes), RARE, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        for p, at in parted(hash_range(hashes[order], self.word_parts)):
            i = order[at]
            known = self.open("words", p)
            if known is None or not len(known):
                continue
            j = np.minimum(np.searchsorted(known, hashes[i]), len(known) - 1)
            hit = known[j] == hashes[i]
            i, j = i[hit], j[hit]
            count[i] = self.open("counts", p)[j]
            rank = self.open("ranks", p)[j]
            often = rank >= 0
            number[i[often]] = FIRST + self.first_number[p] + rank[often]
            mass[i[often]] = self.first_mass[p] + self.open("mass", p)[j[often]]
        return count, number, mass


_OPEN: dict[str, dict] = {}


def parted(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, where) of each run of a rising array."""
    if len(part):
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(part[a]), slice(a, b)


def pair_keys(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """The pair key of each token (number before, number), its range, its count, and the texts' tokens."""
    distinct, place, starts, lengths = tokens_of(texts)
    count, number, mass = model.words(distinct)
    # by number, how much of all pairs words before this one begin, and how much it begins itself
    total = model.tokens + 1
    number_of = np.append(number, START)
    share = np.append(np.where(number == RARE, 0, model.rare_mass + model.texts + mass), model.rare_mass) / total
    room = np.append(np.where(number == RARE, model.rare_mass, count), model.texts) / total
    before = np.empty(len(place), np.int64)
    before[1:] = place[:-1]
    before[starts] = len(number)
    key = (number_of[before].astype(np.uint64) << np.uint64(32)) | number_of[place].astype(np.uint64)
    spot = share[before] + room[before] * share[place]
    part = np.minimum((spot * model.pair_parts).astype(np.int64), model.pair_parts - 1)
    return key, part, count[place], (starts, lengths)


def count_words(train: DataFrame, root: str, parts: int, min_count: int) -> list:
    """Write the sorted word arrays; the sums of each range."""

    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            distinct, place, _, _ = tokens_of(batch.column(0))
            h, c = summed(distinct, np.bincount(place, minlength=len(distinct)))
            rows = [(p, pack(h[at]), pack(np.cumsum(c[at]))) for p, at in parted(hash_range(h, parts))]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "hashes", "counts"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        h = np.concatenate([unpack(b) for b in table.column("hashes").to_pylist()])
        c = np.concatenate([np.diff(unpack(b), prepend=np.uint64(0)) for b in table.column("counts").to_pylist()]).astype(np.int64)
        h, c = summed(h, c)
        often = c >= min_count
        save(f"{root}/words-{p}.npy", h)
        save(f"{root}/counts-{p}.npy", c)
        save(f"{root}/ranks-{p}.npy", np.where(often, np.cumsum(often) - 1, -1).astype(np.int32))
        save(f"{root}/mass-{p}.npy", np.cumsum(np.where(often, c, 0)) - np.where(often, c, 0))
        return pa.table({"part": pa.array([p], pa.int32()), "types": [len(h)], "tokens": [int(c.sum())], "frequent": [int(often.sum())], "mass": [int(c[often].sum())], "texts": [int(c[h == np.uint64(END)].sum())]})

    rows = train.select("text").mapInArrow(tidy(reduce_texts), "part int, hashes binary, counts binary")
    return rows.groupBy("part").applyInArrow(merge, "part int, types long, tokens long, frequent long, mass long, texts long").collect()  # six numbers a range


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def train_model(train: DataFrame, min_count: int = 2, parts_per_input: int = 2) -> Model:
    """Count all rows of `train` (text) and write the model's arrays to the shared folder."""
    train = require(train, "text")
    spark = train.sparkSession
    root = local_path(work_path(spark, "kneser-ney"))
    os.makedirs(root, exist_ok=True)
    inputs = train.rdd.getNumPartitions()  # of the plan; nothing runs
    word_parts = pair_parts = max(8, parts_per_input * inputs)
    found = {r["part"]: r for r in count_words(train, root, word_parts, min_count)}
    get = lambda name: np.array([found[p][name] if p in found else 0 for p in range(word_parts)], np.int64)
    frequent, mass = get("frequent"), get("mass")
    before = lambda a: np.cumsum(a) - a
    model = Model(root, word_parts, pair_parts, before(frequent), before(mass), int(get("tokens").sum()), int(get("types").sum()), int(frequent.sum()), int(get("types").sum() - frequent.sum()), int(get("tokens").sum() - mass.sum()), int(get("texts").sum()), min_count)
    return count_pairs(train, model)


def count_pairs(train: DataFrame, model: Model) -> Model:
    spark, root = train.sparkSession, model.root
    shared = spark.sparkContext.broadcast(model)  # two numbers a word range

    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            key, part, _, _ = pair_keys(shared.value, batch.column(0))
            order = np.lexsort((key, part))
            key, part = key[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            k, c, part = key[first], np.diff(np.append(first, len(key))), part[first]
            rows = [(p, pack(k[at]), pack(np.cumsum(c[at]))) for p, at in parted(part)]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "counts"])

    def split(kind: str, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
        for q, at in parted(ids // SPAN):
            yield q, kind, pack(ids[at]), [pack(np.cumsum(c[at])) for c in columns], [0] * 5

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        k = np.concatenate([unpack(b) for b in table.column("keys").to_pylist()])
        c = np.concatenate([np.diff(unpack(b), prepend=np.uint64(0)) for b in table.column("counts").to_pylist()]).astype(np.int64)
        k, c = summed(k, c)
        save(f"{root}/pairs-{p}.npy", k)
        save(f"{root}/seen-{p}.npy", np.minimum(c, 255).astype(np.uint8))
        big = np.flatnonzero(c >= 255)
        save(f"{root}/many-{p}.npy", np.stack([big, c[big]]))
        a, b = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        by = lambda x: np.add.reduceat(x.astype(np.int64), first)
        rows = [(-1, "counts", b"", [], [*(int((c == i).sum()) for i in range(1, 5)), len(k)])]
        rows += split("before", a[first], by(c), by(c == 1), by(c == 2), by(c >= 3))
        rows += split("after", *np.unique(b, return_counts=True))
        types = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["span", "kind", "ids", "columns", "n"])

    rows = train.mapInArrow(tidy(reduce_texts), "part int, keys binary, counts binary")
    stats = materialize(rows.groupBy("part").applyInArrow(merge, "span long, kind string, ids binary, columns array<binary>, n array<long>"), "kn-stats")

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        q = key[0].as_py()
        dense = {n: np.zeros(SPAN, np.int64) for n in ("total", "one", "two", "more", "first")}
        for kind, ids, columns in zip(*(table.column(c).to_pylist() for c in ("kind", "ids", "columns")), strict=True):
            at = unpack(ids).astype(np.int64) - q * SPAN
            for name, b in zip(("total", "one", "two", "more") if kind == "before" else ("first",), columns, strict=True):
                dense[name][at] += np.diff(unpack(b), prepend=np.uint64(0)).astype(np.int64)
        save(f"{root}/next-{q}.npy", np.stack([dense[n] for n in ("total", "one", "two", "more")], axis=1))
        save(f"{root}/first-{q}.npy", dense["first"])
        n = [int((dense["first"] == i).sum()) for i in range(1, 5)]
        return pa.table({"n": pa.array([[*n, int((dense["first"] >= 3).sum())]], pa.list_(pa.int64()))})

    add = lambda df: [df.agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(5)]).first()[i] or 0 for i in range(5)]
    low = materialize(stats.where("kind <> 'counts'").groupBy("span").applyInArrow(gather, "n array<long>"), "kn-low")
    pairs, firsts = add(stats.where("kind = 'counts'")), add(low)
    d, e = discounts(pairs[:4]), discounts(firsts[:4])
    freed = (e[0] * firsts[0] + e[1] * firsts[1] + e[2] * firsts[4]) / pairs[4] if pairs[4] else 1.0
    return Model(**{**{f: getattr(model, f) for f in model.__dataclass_fields__}, "discounts": d, "low_discounts": e, "low_mass": freed, "pair_types": int(pairs[4])})


def take(model: Model, name: str, ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of a dense array for sorted word numbers."""
    out = np.zeros((len(ids), width) if width else len(ids), np.int64)
    for q, at in parted(ids // SPAN):
        a = model.open(name, q)
        if a is not None:
            out[at] = a[ids[at] - q * SPAN]
    return out


def discounted(c: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def log_probabilities(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each token, its training count, and where each text begins."""
    key, part, count, (starts, _) = pair_keys(model, texts)
    distinct, inverse = np.unique(key, return_inverse=True)
    where = np.empty(len(distinct), np.int64)
    where[inverse] = part
    c = np.zeros(len(distinct), np.int64)
    for p, at in parted(where):
        known = model.open("pairs", p)
        if known is None or not len(known):
            continue
        j = np.minimum(np.searchsorted(known, distinct[at]), len(known) - 1)
        hit = known[j] == distinct[at]
        own = np.where(hit, model.open("seen", p)[j], 0).astype(np.int64)
        many = model.open("many", p)
        if (own == 255).any():
            own[own == 255] = many[1][np.searchsorted(many[0], j[own == 255])]
        c[at] = own
    a, b = (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ua, ia = np.unique(a, return_inverse=True)
    ub, ib = np.unique(b, return_inverse=True)
    first = take(model, "first", ub, 0)
    low = model.low_mass / (model.frequent + 1) + discounted(first, model.low_discounts or (0.5,) * 3) / max(1, model.pair_types)
    after = take(model, "next", ua, 4)
    total = after[:, 0]
    free = np.where(total > 0, after[:, 1:] @ np.array(model.discounts or (0.5,) * 3) / np.maximum(total, 1), 1.0)
    p = discounted(c, model.discounts or (0.5,) * 3) / np.maximum(total[ia], 1) + free[ia] * low[ib]
    p = np.where(b == RARE, p / (model.rare_types + 1), p)
    return np.log10(p)[inverse], count, starts


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        base = m.tokens + m.types + 1
        for batch in pieces(batches, 1):
            logs, count, starts = log_probabilities(m, batch.column(1))
            per = lambda x: np.add.reduceat(x, starts)
            n = per(np.ones(len(logs), np.int64))
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(per((count > 0).astype(np.int64))), pa.array(np.full(len(n), m.tokens)), pa.array(per(np.log10((count + 1) / base))), pa.array(per(logs))], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return require(docs, "doc_id", "text").mapInArrow(tidy(f), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """All columns and perplexity, the inverse geometric mean of a text's token probabilities."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
