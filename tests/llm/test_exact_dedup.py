import hashlib

from pyspark.sql import functions as F

from tagstream.llm.common import work_path
from tagstream.llm.exact_dedup import DigestIndex, drop_copies, exact_groups

ROWS = [(1, "Abc", "x"), (2, "aBC", "y"), (3, None, "z"), (4, "", "z"), (5, "Äbc", None), (6, "äbc", None), (7, "abc ", "k"), (7, "abc ", "k"), (9, "q" * 200_000, "k"), (10, "Q" * 200_000, "k")]


def norm(t):
    return (t or "").encode().lower().decode()


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, max(groups[norm(t)]), len(groups[norm(t)]), i == max(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows)


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_groups_and_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string").withColumn("norm", F.lit(1)).withColumn("keep_id", F.lit(2))
    assert got(exact_groups(docs)) == brute(ROWS)


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_colliding_digests_fall_back_to_bytes(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    one_byte = lambda c: F.substring(F.unhex(F.sha2(c.cast("binary"), 256)), 1, 0).cast("binary")
    out = exact_groups(docs, digest=one_byte)
    assert got(out) == brute([(i, f"text {i % 7}") for i in range(40)])


def test_index_batches_are_idempotent_and_compact(spark):
    index = DigestIndex(spark, work_path(spark, "t"), keep="min")
    a = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a"), (9, "c")], "doc_id long, text string")
    index.append(a, "a")
    index.append(a, "a")
    index.compact()
    index.append(b, "b")
    rows = {(r.keep_id, r.group_size) for r in index.compact().collect()}
    assert rows == {(1, 2), (6, 1), (9, 1)}
    assert index.manifest()["level0"] == []


def test_drop_copies_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    out = drop_copies(docs)
    assert out.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 6, 7, 10]


def test_probe_reads_only_what_may_hold_a_digest(spark):
    index = DigestIndex(spark, work_path(spark, "t"))
    docs = spark.createDataFrame([(i, f"text {i % 9000}") for i in range(10_000)], "doc_id long, text string").repartition(4)
    index.append(docs, "a")
    index.compact()
    index.append(spark.createDataFrame([(20_000, "text 5"), (20_001, "new")], "doc_id long, text string").coalesce(1), "b")
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    asked = spark.createDataFrame([(digest("text 5"),), (digest("text 8999"),), (digest("nothing"),), (None,)], "digest binary")
    found = index.probe(asked)
    rows = {bytes(r.digest): (r.keep_id, r.group_size) for r in found.collect()}
    assert rows == {digest("text 5"): (20_000, 3), digest("text 8999"): (8999, 1)}
    assert {bytes(r.digest): (r.keep_id, r.group_size) for r in index.probe(asked, most=1).collect()} == rows
    assert index.probe(asked.limit(0)).count() == 0

    def read(df):
        """Rows that the scans of a plan gave."""
        df.collect()
        plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
        todo.append(plan)
        while todo:
            p = todo.pop()
            if p.getClass().getSimpleName().startswith("AdaptiveSparkPlan"):
                todo.append(p.executedPlan())
                continue
            if p.getClass().getSimpleName().endswith("QueryStageExec"):
                todo.append(p.plan())
                continue
            if p.nodeName().startswith("Scan"):
                total += p.metrics().apply("numOutputRows").value()
            todo += [p.children().apply(i) for i in range(p.children().size())]
        return total

    absent = spark.createDataFrame([(digest("nothing at all"),)], "digest binary")
    assert read(index.level1()) == 9000
    assert read(index.probe(absent)) == 0  # statistics leave one file, its Bloom filter none


def test_drop_copies_like_brute_force(spark):
    rows = [(i % 50 if i % 7 else None, f"Text {i % 23}" if i % 3 else f"text {i % 23}", i % 2) for i in range(300)] + [(1000 + i, f"own {i}", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long").repartition(5)
    left = [(r.doc_id, norm(r.text)) for r in drop_copies(docs.drop("_id")).collect()]
    best = {}
    for i, t, _ in rows:
        best[norm(t)] = max(i if i is not None else -1, best.get(norm(t), -1))
    assert sorted(left) == sorted((i, t) for t, i in best.items())
