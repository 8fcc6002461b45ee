"""Line deduplication by content-defined chunks of lines. DataFrame functions only.

A text's lines are hashed; a rolling hash over `window` consecutive line hashes puts a boundary behind a
line where it is 0 modulo `divisor`. Boundaries depend on nearby lines only, so an inserted or deleted
line moves no boundary further on, and the same run of lines is cut alike in every document. Chunks of at
least `least_lines` lines and `least_chars` characters that occur more than once, in one document or
several, are repeated: all but one occurrence go. The occurrence that stays is the first by doc_id, then
by row and place in the text.

Chunks meet by a 128-bit digest; a chunk is removed only where its bytes equal those of the occurrence
that stays, which is shown by the digest's least and greatest text being one. Where a digest stands for
different texts, its occurrences are grouped by the text itself. Counting reduces a partition's own
repeats before the shuffle, so a chunk that a third of all documents hold is no hot group. Texts without
a repeated chunk aren't shuffled while their rows fit the broadcast buckets.

Defined results: lines end at \\n; a \\r belongs to its line. Null texts stay null and have no lines; an
empty text is one empty line and is no chunk. A text all of whose chunks go becomes empty. Repeated rows
are rows of their own: each repeat loses its repeated chunks. An empty table gives no rows. Other columns
are passed on, but for those that have the names of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagstream.llm.common import materialize

#: What repeats is broadcast as this many buckets at most, to leave the rest where it is.
BUCKETS = 1 << 20


def line_hash(line: Column) -> Column:
    """28 bits of a line's md5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def with_chunks(docs: DataFrame, window: int, divisor: int) -> DataFrame:
    """`docs` and _chunks, array<struct<at, lines, chunk>>: first line's place, number of lines, text.

    Step by step, so that no step is evaluated again for each line.
    """

    def rolling(i: Column) -> Column:
        total = F.lit(0).cast("long")
        for k in range(window):
            total = total + F.when(i >= k, F.element_at("_hashes", F.greatest(i - k + 1, F.lit(1))) * (31**k)).otherwise(0)
        return total % divisor

    df = docs.withColumn("_lines", F.split("text", "\n", -1))
    df = df.withColumn("_hashes", F.transform("_lines", line_hash))
    df = df.withColumn("_cut", F.filter(F.sequence(F.lit(0), F.size("_hashes") - 1), lambda i: (rolling(i) == 0) | (i == F.size("_hashes") - 1)))
    df = df.withColumn("_from", F.transform("_cut", lambda b, k: F.when(k == 0, F.lit(0)).otherwise(F.element_at("_cut", F.greatest(k, F.lit(1))) + 1)))
    part = lambda b, k: F.struct(F.element_at("_from", k + 1).alias("at"), (b + 1 - F.element_at("_from", k + 1)).alias("lines"), F.array_join(F.slice("_lines", F.element_at("_from", k + 1) + 1, b + 1 - F.element_at("_from", k + 1)), "\n").alias("chunk"))
    return df.withColumn("_chunks", F.transform("_cut", part)).drop("_lines", "_hashes", "_cut", "_from")


def md5_digest(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk.cast("binary")))


def remove_repeated_chunks(docs: DataFrame, window: int = 2, divisor: int = 3, least_lines: int = 2, least_chars: int = 20, digest=md5_digest) -> DataFrame:
    """All columns of `docs` and n_lines, n_removed (lines), clean_text.

    docs: doc_id long, text string.
    """
    docs = docs.drop("n_lines", "n_removed", "clean_text", "_row", "_chunks")
    names = docs.columns
    # rows get a key that outlives a retry: it is fixed together with their chunks in the shared folder
    kept = materialize(with_chunks(docs.withColumn("_row", F.monotonically_increasing_id()), window, divisor).drop("text"), "chunks")
    every = kept.select("doc_id", "_row", F.explode("_chunks").alias("c")).select("doc_id", "_row", "c.at", "c.lines", "c.chunk")
    real = every.where((F.col("lines") >= least_lines) & (F.length("chunk") >= least_chars)).withColumn("digest", digest(F.col("chunk")))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))

    # counts first, over digests alone; what occurs once needs no text
    often = real.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    wanted = F.broadcast(often.select(bucket("digest").alias("bucket")).distinct())  # at most BUCKETS rows
    near = materialize(real.withColumn("bucket", bucket("digest")).join(wanted, "bucket", "left_semi").select("digest", "doc_id", "_row", "at", "chunk"), "near")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("_row").alias("r"), F.col("at").alias("p"))
    first = materialize(near.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("stays"), F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("n > 1").select("digest", "stays", (F.col("least") == F.col("most")).alias("same")), "first")
    same = near.drop("chunk").join(first.where("same").select("digest", "stays"), "digest").where(place != F.col("stays")).select("_row", "at")
    clash = near.join(first.where("not same").select("digest"), "digest", "left_semi")
    own = clash.groupBy("chunk").agg(F.min(place).alias("stays"))
    other = clash.join(own, "chunk").where(place != F.col("stays")).select("_row", "at")
    gone = materialize(same.union(other).groupBy("_row").agg(F.sort_array(F.collect_list("at")).alias("_gone")), "gone")  # a row holds no more than its text's chunks

    hit = F.broadcast(gone.select(bucket("_row").alias("bucket")).distinct())  # at most BUCKETS rows
    keyed = kept.withColumn("bucket", bucket("_row"))
    some = keyed.join(hit, "bucket", "left_semi").join(gone, "_row", "left")
    none = keyed.join(hit, "bucket", "left_anti").withColumn("_gone", F.lit(None).cast("array<int>"))
    out = some.select(*none.columns).union(none).withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    total = lambda a: F.coalesce(F.aggregate(a, F.lit(0).cast("long"), lambda s, c: s + c["lines"]), F.lit(0).cast("long"))
    text = lambda a: F.array_join(F.transform(a, lambda c: c["chunk"]), "\n")
    return out.select(
        *[text(F.col("_chunks")).alias(n) if n == "text" else F.col(n) for n in names],
        total(F.col("_chunks")).alias("n_lines"),
        total(F.filter("_chunks", lambda c: F.array_contains("_gone", c["at"]))).alias("n_removed"),
        text(F.filter("_chunks", lambda c: ~F.array_contains("_gone", c["at"]))).alias("clean_text"),
    )
