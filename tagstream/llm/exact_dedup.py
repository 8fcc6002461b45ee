"""Exact deduplication by a log-structured merge index of text digests. DataFrame functions only.

Every input partition is a memtable: it is reduced to its digests, sorted, and flushed as one
sorted run of level 0, a Parquet file whose digest column has statistics and a Bloom filter. Compaction merges
the runs of level 0 with the current level 1 to one entry a digest, which row stays and how many rows there
are, in sorted files of disjoint ranges of digests. A probe for a batch of digests asks the files' statistics
and filters, and only the row groups that may hold one are read. Every digest that more than one row has is
verified by bytes: the least and the greatest normalised text of the digest must be identical; where they
differ, the rows are grouped by the text itself.

Over a whole table, `exact_groups` meets every digest of level 1 anyway, and joins them with the runs; probes are
for batches that come later.

Defined results: a null text counts as empty, empty texts are equal to each other, rows with equal
texts and equal ids are all members of the group (and all are `kept` when theirs is the id that
stays), a null doc_id never stays unless its group has no other, and an empty table gives no rows.
Columns other than `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagstream.llm.common import ascii_lower, materialize, require, work_path

#: Parquet options of a run: a Bloom filter over the digests of each row group.
RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled#digest": "true", "parquet.bloom.filter.max.bytes": str(1 << 20)}


#: What repeats is broadcast as this many buckets at most, to leave the rest where it is.
BUCKETS = 1 << 20


def normalise(text: Column) -> Column:
    """Lower-case A-Z; null is the empty text."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


class DigestIndex:
    """The index below one folder: `level0/batch=<id>` runs, `level1/v=<n>` and their manifests.

    `keep` is "max" or "min": which doc_id of equal texts stays. Appending a batch twice is a no-op.
    """

    def __init__(self, spark: SparkSession, path: str, keep: str = "max", digest=sha256_digest):
        if keep not in ("max", "min"):
            raise ValueError("keep is 'max' or 'min'")
        self.spark, self.path, self.keep, self.digest = spark, path.rstrip("/"), keep, digest
        self.best = F.max if keep == "max" else F.min

    # -- the manifest: one small text file a commit, the highest number counts
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def manifest(self) -> dict:
        fs, path = self._fs()
        root = path(f"{self.path}/manifest")
        if not fs.exists(root):
            return {"version": 0, "level0": [], "level1": None, "batches": []}
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().endswith(".json"))
        if not names:
            return {"version": 0, "level0": [], "level1": None, "batches": []}
        stream = fs.open(path(f"{self.path}/manifest/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, m: dict) -> None:
        """A new manifest appears whole under its number, or not at all."""
        fs, path = self._fs()
        m = m | {"version": m["version"] + 1}
        tmp, to = path(f"{self.path}/manifest/.{m['version']:010d}.tmp"), path(f"{self.path}/manifest/{m['version']:010d}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if not fs.rename(tmp, to):
            raise RuntimeError(f"another writer committed {to}")

    def append(self, docs: DataFrame, batch_id: str) -> None:
        """Flush one batch: each input partition becomes a sorted digest run. No shuffle."""
        m = self.manifest()
        if batch_id in m["batches"]:
            return
        run = f"{self.path}/level0/batch={batch_id}"
        rows = require(docs, "doc_id", "text").select(self.digest(normalise(F.col("text"))).alias("digest"), "doc_id")
        w = rows.sortWithinPartitions("digest", "doc_id").write.mode("overwrite")
        for k, v in RUN_OPTIONS.items():
            w = w.option(k, v)
        w.parquet(run)
        self._commit(m | {"level0": [*m["level0"], run], "batches": [*m["batches"], batch_id]})

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def compact(self) -> DataFrame:
        """Merge all runs of level 0 into level 1: (digest, keep_id, group_size), one row a digest."""
        m = self.manifest()
        parts = [self._read(p, "digest binary, doc_id long").select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")) for p in m["level0"]]
        if m["level1"]:
            parts.append(self.level1(m))
        if m["level0"]:
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.unionByName(p)
            merged = merged.groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            merged = merged.repartitionByRange("digest")  # runs of disjoint ranges, for their statistics
            to = f"{self.path}/level1/v={m['version']}"
            w = merged.sortWithinPartitions("digest").write.mode("overwrite")
            for k, v in RUN_OPTIONS.items():
                w = w.option(k, v)
            w.parquet(to)
            self._commit(m | {"level0": [], "level1": to})
        return self.level1()

    def probe(self, digests: DataFrame, most: int = 4096) -> DataFrame:
        """(digest, keep_id, group_size) of those of the digests (column digest) that the index holds.

        Up to `most` distinct digests go to the scan as literals, so that statistics and Bloom filters decide which row
        groups are read (the setting for it is raised for the session). More are joined.
        """
        wanted = digests.select("digest").where("digest is not null").distinct()
        literals = [bytes(r["digest"]) for r in wanted.limit(most + 1).collect()]
        m = self.manifest()
        parts = [self._read(p, "digest binary, doc_id long").select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")) for p in m["level0"]]
        parts += [self.level1(m)] if m["level1"] else []
        if not parts or not literals:
            return self.spark.createDataFrame([], "digest binary, keep_id long, group_size long")
        if len(literals) > most:
            found = [p.join(wanted, "digest", "left_semi") for p in parts]
        else:
            self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(most))
            found = [p.where(F.col("digest").isin(sorted(literals))) for p in parts]
        both = found[0]
        for p in found[1:]:
            both = both.unionByName(p)
        return both.groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def level1(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        if not m["level1"]:
            return self.spark.createDataFrame([], "digest binary, keep_id long, group_size long")
        return self._read(m["level1"], "digest binary, keep_id long, group_size long")


def exact_groups(docs: DataFrame, keep: str = "max", index: DigestIndex | None = None, digest=sha256_digest, batch_id: str = "batch0") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    docs: doc_id long, text string; other columns are ignored. `index` is the digest index to use; it
    must hold nothing but these documents under `batch_id` (a new one is made otherwise).
    """
    spark = docs.sparkSession
    docs = require(docs, "doc_id", "text")
    index = index or DigestIndex(spark, work_path(spark, "digests"), keep, digest)
    index.append(docs, batch_id)
    level1 = index.compact()
    norm = docs.select("doc_id", normalise(F.col("text")).alias("norm")).withColumn("digest", index.digest(F.col("norm")))

    # hits: texts whose digest other rows have too, by buckets of digests that are broadcast; a partition reduces
    # its own copies to two texts a digest before the shuffle, so a large group of copies is no hot key
    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS))
    shared = F.broadcast(level1.where("group_size > 1").select(bucket.alias("bucket")).distinct())  # at most BUCKETS rows
    hits = norm.withColumn("bucket", bucket).join(shared, "bucket", "left_semi")
    extremes = hits.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    verified = materialize(extremes.select("digest", (F.col("least") == F.col("most")).alias("same"), F.sha2("most", 256).alias("sha")), "verified")
    clashes = verified.where(~F.col("same")).select("digest")

    if not clashes.limit(1).count():
        # the runs already hold (digest, doc_id): the texts aren't read again
        rows = index.spark.read.schema("digest binary, doc_id long").parquet(f"{index.path}/level0/batch={batch_id}")
        out = rows.join(level1, "digest")
        sha = F.lower(F.hex("digest")) if index.digest is sha256_digest else None
        if sha is not None:
            return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))
    # another digest, or one that distinct texts share: texts of clashing digests are grouped by their bytes
    split = norm.join(clashes, "digest", "left_semi").groupBy("norm").agg(index.best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    clean = norm.join(clashes, "digest", "left_anti").join(level1, "digest").select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
    mixed = norm.join(clashes, "digest", "left_semi").join(split, "norm").select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
    return clean.unionByName(mixed).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The documents that stay, with all their columns; of rows equal in id and text, one stays.

    Texts that are alone in their bucket of digests aren't shuffled, nor are copies that go, but for those that share
    a bucket of (id, digest) with one that stays. Sets of buckets are broadcast, at most BUCKETS rows each.
    """
    names = docs.columns
    found = exact_groups(docs, keep).where("group_size > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept")
    copies = materialize(found.groupBy("_id", "_sha", "kept").agg(F.count("*").alias("_n")), "copies")
    keyed = docs.withColumn("_sha", F.sha2(normalise(F.col("text")).cast("binary"), 256)).withColumn("_id", F.col("doc_id"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS))
    held = F.broadcast(copies.select(bucket("_sha").alias("_bucket")).distinct())
    near = F.broadcast(copies.where("kept").select(bucket("_id", "_sha").alias("_near")).distinct())
    alone = keyed.withColumn("_bucket", bucket("_sha")).join(held, "_bucket", "left_anti")
    # a bucket can hold texts without copies too: those stay, whatever is in it. Found by digests, without their texts
    shared = keyed.select("_sha").withColumn("_bucket", bucket("_sha")).join(held, "_bucket", "left_semi")
    strays = materialize(shared.select("_sha").distinct().join(copies.select("_sha").distinct(), "_sha", "left_anti"), "strays")
    other = F.broadcast(strays.select(bucket("_sha", F.lit(1)).alias("_other")).distinct())
    single = keyed.withColumn("_other", bucket("_sha", F.lit(1))).join(other, "_other", "left_semi").join(strays, "_sha", "left_semi")
    key = lambda c: F.struct(F.col("_id"), F.col("_sha")).alias(c)
    may = keyed.withColumn("_near", bucket("_id", "_sha")).join(near, "_near", "left_semi").withColumn("_key", key("_key"))
    once = may.join(copies.where("kept and _n = 1").select(key("_key")), "_key", "left_semi")
    more = may.join(copies.where("kept and _n > 1").select(key("_key")), "_key", "left_semi").dropDuplicates(["_key"])
    out = alone.select(*names)
    for part in (single, once, more):
        out = out.unionByName(part.select(*names))
    return out
