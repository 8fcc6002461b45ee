import glob
import os
import re
import tempfile
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagstream.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_of_whole_and_sliced_arrays():
    texts = ["A b", None, "", " \tÄ B\x0bc d ", "x" * 10, "one two  three\n"] * 4
    array = pa.array(texts, pa.string())
    for a, b in ((0, 24), (3, 9), (5, 24), (7, 7)):
        offsets, words = common.split_words(array.slice(a, b - a))
        w = words.to_pylist()
        got = [w[i:j] for i, j in zip(offsets[:-1], offsets[1:])]
        assert got == [WORD.findall((t or "").encode().lower().decode()) for t in texts[a:b]]
        assert len(common.word_hashes(words)) == len(w)


def test_words_of_slices_without_nulls():
    texts = [f"Été {i} aÉ Bc" for i in range(150)]
    for kind in (pa.string(), pa.large_string()):
        for a in (0, 1, 50, 149):
            _, words = common.split_words(pa.array(texts, kind).slice(a, 40))
            assert words.to_pylist() == [w for t in texts[a : a + 40] for w in WORD.findall(t.encode().lower().decode())]


def test_slices_cover_all_rows():
    batch = pa.record_batch([pa.array(["a" * n if n else None for n in range(50)])], names=["text"])
    cuts = list(common.slices(batch, 0, 100))
    assert cuts[0][0] == 0 and cuts[-1][1] == 50 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert list(common.slices(batch.slice(0, 0), 0)) == []


def test_shingles():
    w = np.arange(6, dtype=np.uint64)
    assert len(common.shingle_hashes(w, 4)) == 3 and len(common.shingle_hashes(w[:2], 4)) == 1 and len(common.shingle_hashes(w[:0], 4)) == 0
    assert common.shingle_hashes(w, 4)[1] == common.shingle_hashes(w[1:5], 4)[0]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (8, 2), (3, 10), (None, 1)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 10: 3, 9: 2, 8: 2, 2: 2} | {100 + i: 100 for i in range(41)}
    assert common.connected_components(edges.limit(0)).count() == 0


def test_bounded_sample(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("g"))
    got = common.bounded_sample(rows, "g", 300, "doc_id").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 300, "b": 300}


def test_tables_leave_no_shuffle_files_and_go_when_done(spark):
    stored = lambda: {p for d in glob.glob(f"{tempfile.gettempdir()}/blockmgr-*") for p in glob.glob(f"{d}/*/shuffle_*.data")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = stored(), spark.conf.get(key)
    table = common.materialize(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s")), "sums")
    assert spark.conf.get(key) == setting
    end = time.time() + 10
    while stored() - before and time.time() < end:
        time.sleep(0.1)
    assert not stored() - before and table.count() == 1000
    folder = os.path.dirname(common.local_path(table.inputFiles()[0]))
    common.discard(table)
    assert not os.path.exists(folder)
