"""N-gram Jaccard join through prefix trees: link documents whose shingle sets overlap, and group them.

A document's set holds the distinct k-word shingles of its text. Two sets link when
100 * |x & y| >= percent * |x | y|. The result is exact up to 64-bit hashes of shingles and sets.

1. Equal sets are one class; classes, not documents, are joined.
2. Of each set the smallest hashes go out, about twice as many as may be missing from a partner, and enough
   for every size that a partner can have.
   A set fewer of whose hashes another set holds than a partner must share has no partner. Hashes
   that repeat in a batch are settled there and leave one row, so a frequent shingle isn't a hot key.
3. The surviving sets are ordered globally: shingles by how many surviving sets hold them, rarest
   first. Shingles of one set alone only lower the bounds. Partners share a shingle of their prefixes.
4. Leaders: sets with the same min-hash are compared with the one of them that has the fewest
   shingles of its own. Links that are found merge their components.
5. Prefix trees: sets that share a prefix shingle whose sets aren't yet in one component go, ordered, into a
   path-compressed trie. A set walks it once, sharing the overlap of common paths; a subtree is left as
   soon as the shingles missed on its path, or the length that remains, rule a link out, or when all its
   sets have been reached already. Sets that chains of shared shingles connect are one unit of work, if
   they hold `block_tokens` shingles at most; else a shingle's sets are one, and where they hold more, they
   are dealt over pairs of blocks, so that a task holds at most two blocks. No pair of blocks is left out.

Defined results: null and empty texts, and texts without words, have the empty set and link with
nothing; rows with a null doc_id are compared like others and never name a component unless it has
no other id; rows repeating an id are compared each by its own text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagstream.llm.common import arrow_map, connected_components, materialize, release, require, shingle_hashes, split_words, word_hashes

#: Ids of documents that survive the first filter are broadcast as this many buckets at most.
BUCKETS = 1 << 20


def hashed_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, words = split_words(texts)
    hashes = word_hashes(words)
    every = shingle_hashes(hashes, k) if len(hashes) >= k else np.zeros(0, np.uint64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.unique(every[a : b - k + 1]) if b - a >= k else shingle_hashes(hashes[a:b], k)


def class_id(s: np.ndarray) -> int:
    """63 bits that equal sets share."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def least_overlap(n: int, percent: int) -> int:
    """The fewest shingles that a set of n shares with any partner."""
    return -(-percent * n // 100)


@lru_cache(1 << 16)
def sent(n: int, percent: int) -> int:
    """How many of its smallest hashes a set of n sends, so that of any two partners either sees as many of its own
    held by the other as it needs. With o common hashes, the first j common ones are among the first j + n - o."""
    need = lambda m: np.minimum(m, 2 * (m - -(-percent * m // 100)) + 1) - (m - -(-percent * m // 100))
    partners = np.arange(-(-percent * n // 100), 100 * n // percent + 1)
    common = -(-percent * (n + partners) // (100 + percent))
    return int(min(n, max(2 * (n - least_overlap(n, percent)) + 1, (np.maximum(need(partners), need(np.int64(n))) + n - common).max())))


def _profiles(k: int) -> Callable:
    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, sizes = [], []
            for s in hashed_sets(batch.column("text"), k):
                sizes.append(len(s))
                ids.append(class_id(s) if len(s) else None)
            return pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], names=["doc_id", "n", "class"])

        return f

    return make


def _samples(k: int, percent: int) -> Callable:
    """Rows (token, class, settled): a hash of a class; -1 for one that several classes of this batch
    hold; and one row a class under a token of its own, with how many of its hashes are settled here."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            seen: dict[int, np.ndarray] = {}
            for s in hashed_sets(batch.column("text"), k):
                if len(s) and (c := class_id(s)) not in seen:
                    seen[c] = s[: sent(len(s), percent)]
            if not seen:
                return None
            classes = np.fromiter(seen, np.int64, len(seen))
            lengths = np.fromiter(map(len, seen.values()), np.int64, len(seen))
            tokens = np.concatenate(list(seen.values()))
            owner = np.repeat(np.arange(len(classes)), lengths)
            distinct, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            shared = counts[inverse] > 1
            settled = np.bincount(owner[shared], minlength=len(classes))
            repeated = distinct[counts > 1]
            single = ~shared
            token = np.concatenate([tokens[single], repeated, classes.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)])
            cls = np.concatenate([classes[owner[single]], np.full(len(repeated), -1), classes])
            done = np.concatenate([np.full(int(single.sum()) + len(repeated), -1), settled])
            return pa.record_batch([pa.array(token.view(np.int64)), pa.array(cls), pa.array(done.astype(np.int32))], names=["token", "class", "settled"])

        return f

    return make


def _sets(k: int) -> Callable:
    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s for s in hashed_sets(batch.column("text"), k) if len(s)]
            return pa.record_batch([pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "tokens"])

        return f

    return make


class Trie:
    """A path-compressed prefix tree over ordered sets, of which members can be taken out.

    paths: the ordered shared tokens of each member; n: full set sizes; own: tokens no other set has.
    """

    __slots__ = ("active", "children", "depth", "gain", "leaf", "least_n", "longest", "members", "n", "own", "parent", "percent", "segment")

    def __init__(self, paths: list[list[int]], n: list[int], own: list[int], percent: int):
        self.n, self.own, self.percent = n, own, percent
        self.segment, self.children, self.members, self.active, self.parent = [], [], [], [], []
        self.gain, self.longest, self.least_n, self.depth = [], [], [], []
        self.leaf = [0] * len(paths)
        order = sorted(range(len(paths)), key=paths.__getitem__)
        todo = [(0, len(order), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            first, last = paths[order[lo]], paths[order[hi - 1]]
            end, stop = depth, min(len(first), len(last))
            while end < stop and first[end] == last[end]:
                end += 1
            node = len(self.segment)
            own_members = order[lo:hi]
            self.segment.append(first[depth:end])
            self.children.append([])
            self.active.append(hi - lo)
            self.parent.append(parent)
            self.depth.append(end)
            self.gain.append(max(100 * n[i] - (100 + percent) * own[i] for i in own_members))
            self.longest.append(max(len(paths[i]) for i in own_members))
            self.least_n.append(min(n[i] for i in own_members))
            if parent >= 0:
                self.children[parent].append(node)
            at = lo
            ends = []
            while at < hi and len(paths[order[at]]) == end:
                ends.append(order[at])
                self.leaf[order[at]] = node
                at += 1
            self.members.append(ends)
            while at < hi:
                token, start = paths[order[at]][end], at
                while at < hi and paths[order[at]][end] == token:
                    at += 1
                todo.append((start, at, end, node))

    def remove(self, member: int) -> None:
        node = self.leaf[member]
        while node >= 0:
            self.active[node] -= 1
            node = self.parent[node]

    def partners(self, tokens: set[int], n: int, alive: list[bool]) -> list[int]:
        """The members still in that link with a set of n tokens, of which `tokens` are shared ones."""
        p, found = self.percent, []
        need, todo = p * n, [(0, 0)] if self.segment else []
        while todo:
            node, overlap = todo.pop()
            if not self.active[node]:
                continue
            segment = self.segment[node]
            if segment:
                overlap += len(tokens.intersection(segment))
            depth = self.depth[node]
            if (100 + p) * (depth - overlap) > self.gain[node] - need:  # too many of the path are missing
                continue
            if (100 + p) * (overlap + self.longest[node] - depth) < need + p * self.least_n[node]:  # too few remain
                continue
            for y in self.members[node]:
                if alive[y] and (100 + p) * overlap >= p * (n + self.n[y]):
                    found.append(y)
            todo.extend((c, overlap) for c in self.children[node])
        return found


def trie_links(classes: list[int], components: list[int], n: list[int], own: list[int], paths: list[list[int]], percent: int) -> list[tuple[int, int]]:
    """Links (class, class) that join the components given to those that links between members make."""
    trie, alive = Trie(paths, n, own, percent), [True] * len(classes)
    by_component: dict[int, list[int]] = {}
    for i, c in enumerate(components):
        by_component.setdefault(c, []).append(i)
    links = []
    for first in sorted(range(len(classes)), key=lambda i: (own[i] / n[i], classes[i])):
        if not alive[first]:
            continue
        queue = by_component[components[first]][:]
        for i in queue:
            alive[i] = False
            trie.remove(i)
        while queue:
            x = queue.pop()
            for y in trie.partners(set(paths[x]), n[x], alive):
                if alive[y]:
                    links.append((classes[x], classes[y]))
                    for i in by_component[components[y]]:
                        alive[i] = False
                        trie.remove(i)
                        queue.append(i)
    return links


def _join_unit(percent: int) -> Callable[[pa.Table], pa.Table]:
    def f(table: pa.Table) -> pa.Table:
        lists = table.column("path").combine_chunks()
        flat = np.asarray(lists.flatten())
        distinct, inverse = np.unique(flat, return_inverse=True)
        names = list(range(len(distinct)))
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        inverse = inverse.tolist()
        paths = [[names[i] for i in inverse[a:b]] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        col = lambda c: table.column(c).to_pylist()
        links = trie_links(col("class"), col("component"), col("n"), col("own"), paths, percent)
        del paths, flat, inverse, lists
        release()
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return f


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, leader_rounds: int = 2, block_tokens: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    docs: doc_id long, text string; other columns are ignored.
    """
    docs = require(docs, "doc_id", "text")
    profiles = materialize(arrow_map(docs, _profiles(k), "doc_id long, n long, class long"), "profiles")
    links = class_links(docs, profiles, k, percent, leader_rounds, block_tokens)
    found = connected_components(links)
    # ids meet by class first, then by component, so that no step gathers the documents of a large group
    classes = profiles.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    labelled = classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("component", "class"))
    names = labelled.groupBy("label").agg(F.min("least").alias("first_id"))
    named = labelled.join(names, "label").select("class", "first_id")
    return profiles.join(named, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id")).alias("component_id"))


def class_links(docs: DataFrame, profiles: DataFrame, k: int, percent: int, leader_rounds: int, block_tokens: int) -> DataFrame:
    """Links (a, b) between classes: at least a spanning forest of each component."""
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long")
    classes = profiles.where("n > 0").groupBy("class").agg(F.min("n").alias("n"), F.min(F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("rep"))

    # 2. sets that have too few hashes in common with any other set are out
    rows = arrow_map(docs, _samples(k, percent), "token long, class long, settled int")
    token = Window.partitionBy("token")
    seen = rows.withColumn("other", F.min("class").over(token) != F.max("class").over(token))
    score = F.when(F.col("settled") >= 0, F.col("settled")).when(F.col("other"), 1).otherwise(0)
    counted = seen.where("class >= 0").withColumn("score", score).where("score > 0 or settled >= 0").groupBy("class").agg(F.sum("score").alias("shared"), F.sum(F.when(F.col("settled") >= 0, 1).otherwise(0)).alias("copies"))
    some = F.least(F.col("n"), 2 * spare + 1) - spare  # of the first 2 * spare + 1, at most `spare` may be missing; partners send enough to show the rest
    alive = materialize(classes.join(counted, "class").where(F.col("shared") >= some * F.col("copies")).select("class", "n", "rep"), "survivors")

    # 3. the survivors' sets, in global order
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    wanted = F.broadcast(alive.select(bucket(F.col("rep")).alias("bucket")).distinct())  # at most BUCKETS rows
    near = docs.withColumn("bucket", bucket(F.coalesce("doc_id", F.lit(-(1 << 62))))).join(wanted, "bucket", "left_semi").select("doc_id", "text")
    sets = arrow_map(near, _sets(k), "class long, tokens array<long>").join(alive.select("class", "n"), "class").dropDuplicates(["class"])
    sets = materialize(sets, "sets")
    pairs = sets.select("class", F.explode("tokens").alias("token"))
    common = pairs.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = pairs.join(common, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("path"))
    paths = ordered.join(alive.select("class", "n"), "class").select("class", "n", (F.col("n") - F.size("path")).alias("own"), F.col("path.token").alias("path"))
    paths = materialize(paths.where(F.col("own") <= spare), "paths")

    # 4. leaders
    found = None
    for r in range(leader_rounds):
        keyed = paths.withColumn("key", F.array_min(F.transform("path", lambda t: F.xxhash64(t, F.lit(r)))))
        best = keyed.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("odd"), "class")).alias("best"), F.count("*").alias("size")).where("size > 1")
        lead = best.select("key", F.col("best.class").alias("b")).join(paths.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("path").alias("path_b")), "b")
        both = keyed.join(lead, "key").where("class <> b").withColumn("overlap", F.size(F.array_intersect("path", "path_b")))
        linked = both.where((100 + percent) * F.col("overlap") >= percent * (F.col("n") + F.col("n_b"))).select(F.col("class").alias("a"), "b")
        found = linked if found is None else found.union(linked)
    found = materialize(found, "leaders") if found is not None else docs.sparkSession.createDataFrame([], "a long, b long")
    known = connected_components(found)
    paths = paths.join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))

    # 5. prefix trees over what isn't in one component yet
    prefix = paths.select("class", "component", F.size("path").alias("size"), F.explode(F.slice("path", F.lit(1), (spare + 1 - F.col("own")).cast("int"))).alias("token"))
    prefix = materialize(prefix, "prefix")
    mixed = prefix.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("class").alias("hub"), F.ceil(F.sum("size") / block_tokens).cast("int").alias("blocks")).where("least <> most").select("token", "hub", "blocks")
    rows = materialize(prefix.select("class", "size", "token").join(mixed, "token"), "mixed")
    # sets that chains of shared prefix shingles connect meet in one unit, each once, where they fit in one
    near = connected_components(rows.select(F.col("class").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("node", "class").withColumnRenamed("component", "cluster")
    members = rows.select("class", "size").distinct().join(near, "class")
    weights = members.groupBy("cluster").agg(F.sum("size").alias("weight"))
    placed = materialize(members.join(weights, "cluster").select("class", "cluster", (F.col("weight") <= block_tokens).alias("fits")), "placed")
    whole = placed.where("fits").select("class", F.col("cluster").alias("unit"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    # larger ones meet by shingle, and where that is too large by pairs of blocks
    dealt = rows.join(placed.where("not fits").select("class"), "class", "left_semi").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    pairs = dealt.select("class", "token", "blocks", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("blocks = 1 or other <> block")
    units = whole.union(pairs.select("class", F.col("token").alias("unit"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    work = units.join(paths, "class").select("unit", "i", "j", "class", "component", "n", "own", "path")
    tree = work.groupBy("unit", "i", "j").applyInArrow(_join_unit(percent), "a long, b long")
    return found.union(tree)
