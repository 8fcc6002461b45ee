"""Order-preserving packing by dynamic programming with a monotone queue.

Documents, in the order their partition holds them, become one stream of token ids, each followed by
the id 0. The stream is cut into sequences of at most `length` ids. A cut may fall behind a document
(free), behind a token that ends a sentence (`sentence_penalty`), or, where `stretch` ids hold neither,
behind the last of them (`word_penalty`). A sequence of n ids is padded to `length`, unless n is a power
of two, which needs no padding. The cuts minimise padding plus penalties: with f(j) the least cost of
ending a sequence at cut j, f(j) = pen(j) + min over cuts i within `length` before j of f(i) + pad(j - i).
As pad is linear in j - i but for powers of two, the minimum over the window is the front of a monotone
queue of f(i) + i, and cuts a power of two back are looked up beside it.

No shuffle: each input partition is packed in its own order, with at most a bounded segment of the
stream in memory, besides the text at hand. A partition's last ids are cut at powers of two where that
costs less, so each partition adds little padding. The same partition gives the same pieces again.

Defined results: a null or empty text is the one id 0. Repeated rows are packed each. An empty table
gives no rows. The special strings of the tokenizer's vocabulary count as its special ids, as its
library does by default. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tagstream.llm.common import require, slices, tidy

#: What ends a sentence, at the end of a token.
ENDS = (b".", b"!", b"?", b"\n", "。".encode(), "！".encode(), "？".encode())


def added_tokens(path: str) -> dict[str, int]:
    """The special strings of a tokenizer file and their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


class ByteBpe:
    """Ids of the public byte-level vocabulary, as its tokenizer file gives them.

    The same vocabulary as ranks encodes several times faster; texts it can't take go to the tokenizer.
    """

    def __init__(self, name: str = "byte_bpe_50k", fast_only: bool = False):
        """`fast_only` is for vocabularies that come as ranks alone; these have no special strings."""
        import public_tokenizers
        import tiktoken

        self.path = None if fast_only else public_tokenizers.path(f"{name}.json")
        self._slow = None
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
        added = {} if fast_only else added_tokens(self.path)
        self.added, self.size = set(added), max([*ranks.values(), *added.values()]) + 1
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.ends = np.zeros(self.size, bool)
        for token, i in ranks.items():
            self.ends[i] = token.endswith(ENDS)

    @property
    def slow(self):
        """The tokenizer itself, read when a text needs it."""
        if self._slow is None and self.path is not None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def encode(self, text: str) -> np.ndarray:
        if len(text) < 1_000_000 or self.path is None:
            try:
                return np.array(self.fast.encode(text, allowed_special=self.added, disallowed_special=()), np.uint32)
            except (ValueError, KeyError):
                if self.path is None:
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def padding(n: int, length: int) -> int:
    return 0 if n & (n - 1) == 0 else length - n


def best_cuts(candidates: list[int], penalties: list[float], length: int) -> list[int]:
    """The cuts, the first and last candidate among them, of least padding plus penalties.

    candidates: strictly increasing, at most `length` apart.
    """
    at = np.array(candidates)
    targets, sources = [], []  # cuts that lie a power of two behind another
    for power in (1 << k for k in range(length.bit_length()) if 1 << k < length):
        k = np.minimum(np.searchsorted(at, at - power), len(at) - 1)
        hit = np.flatnonzero(at[k] == at - power)
        targets.append(hit)
        sources.append(k[hit])
    target, source_of = np.concatenate(targets), np.concatenate(sources)
    order = np.argsort(target, kind="stable")
    edges = np.searchsorted(target[order], np.arange(len(at) + 1)).tolist()
    source_of = source_of[order].tolist()
    cost, back = [0.0], [0]
    queue: deque[tuple[float, int, int]] = deque([(float(candidates[0]), candidates[0], 0)])  # f(i) + i, i, index
    for j in range(1, len(candidates)):
        c = candidates[j]
        while queue[0][1] < c - length:
            queue.popleft()
        value, _, source = queue[0]
        best = value + length - c
        for k in source_of[edges[j] : edges[j + 1]]:
            if cost[k] < best:
                best, source = cost[k], k
        best += penalties[j]
        cost.append(best)
        back.append(source)
        key = best + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, c, j))
    cuts, j = [candidates[-1]], len(candidates) - 1
    while j:
        j = back[j]
        cuts.append(candidates[j])
    return cuts[::-1]


def candidates_of(breaks: np.ndarray, kinds: np.ndarray, total: int, stretch: int, sentence_penalty: float, word_penalty: float) -> tuple[list[int], list[float]]:
    """Cut positions 0..total and their penalties; breaks: sorted positions, kinds: 0 document, 1 sentence."""
    edges = np.concatenate([[0], breaks, [total]])
    extra = [np.arange(a + stretch, b, stretch) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > stretch]
    more = np.concatenate(extra) if extra else np.zeros(0, np.int64)
    position = np.concatenate([[0], breaks, more, [total]])
    penalty = np.concatenate([[0.0], np.where(kinds == 0, 0.0, sentence_penalty), np.full(len(more), word_penalty), [0.0]])
    order = np.lexsort((penalty, position))
    position, penalty = position[order], penalty[order]
    keep = np.concatenate([[True], position[1:] > position[:-1]])
    return position[keep].tolist(), penalty[keep].tolist()


class Packer:
    """Packs a stream of documents; holds at most a segment of ids besides the document at hand."""

    def __init__(self, length: int, segment: int, stretch: int, sentence_penalty: float, word_penalty: float, ends: np.ndarray, sequence: int):
        self.length, self.segment, self.stretch = length, max(segment, 8 * length), stretch
        self.costs, self.ends, self.sequence = (sentence_penalty, word_penalty), ends, sequence
        self.held: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), self.segment):
            part = ids[at : at + self.segment]
            self.held.append((doc_id, at, part, len(ids)))
            self.size += len(part)
            if self.size >= self.segment:
                yield from self.cut(False)

    def cut(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        lengths = np.array([len(h[2]) for h in self.held])
        ends_at = np.cumsum(lengths)
        whole = np.array([h[1] + len(h[2]) == h[3] for h in self.held])
        stream = np.concatenate([h[2] for h in self.held])
        sentences = np.flatnonzero(self.ends[stream]) + 1
        breaks = np.union1d(sentences, ends_at[whole])
        breaks = breaks[breaks < self.size]
        kinds = np.where(np.isin(breaks, ends_at[whole]), 0, 1)
        cuts = best_cuts(*candidates_of(breaks, kinds, self.size, min(self.stretch, self.length), *self.costs), self.length)
        if not last:  # what follows may change the last cuts
            cuts = cuts[: max(2, len(cuts) - 4)]
        doc, begin = 0, 0  # the held document at hand and where it begins in the stream
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = a
            while at < b:
                while ends_at[doc] <= at:
                    begin = int(ends_at[doc])
                    doc += 1
                d, start, _, tokens = self.held[doc]
                stop = min(b, int(ends_at[doc]))
                yield d, start + at - begin, stop - at, zlib.crc32(stream[at:stop].astype("<u4").tobytes()), tokens, self.sequence, at - a
                at = stop
            self.sequence += 1
        rest, kept, at = cuts[-1], [], 0
        for d, start, ids, tokens in self.held:
            if at + len(ids) > rest:
                skip = max(0, rest - at)
                kept.append((d, start + skip, ids[skip:], tokens))
            at += len(ids)
        self.held, self.size = kept, self.size - rest


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, length: int = 1024, tokenizer: Callable[[], ByteBpe] = ByteBpe, segment: int = 1 << 19, stretch: int = 24, sentence_penalty: float = 1.0, word_penalty: float = 8.0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id long, text string. sequence_id is the partition's number in the upper bits and counts
    from 0 in the lower 40.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer()
        p = Packer(length, segment, stretch, sentence_penalty, word_penalty, t.ends, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        zero = np.zeros(1, np.uint32)
        for batch in batches:
            for a, b in slices(batch, 1):
                part = batch.slice(a, b - a)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows.extend(p.add(doc_id, np.concatenate([t.encode(text), zero]) if text else zero))
                if len(rows) >= 10_000:
                    yield table()
                    rows = []
        rows.extend(p.cut(True))
        if rows:
            yield table()

    return require(docs, "doc_id", "text").mapInArrow(tidy(f), ", ".join(f"{n} long" for n in NAMES))
