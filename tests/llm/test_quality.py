import random

from pyspark.sql import functions as F

from tagstream.llm import quality


def corpus(n=240, seed=1):
    rnd = random.Random(seed)
    good = "the river runs past an old house where people talk about weather and work".split()
    docs, labels = [], []
    for i in range(n):
        q = i % 2
        w = [rnd.choice(good) for _ in range(rnd.randrange(20, 200))]
        docs.append((i, " ".join(w) + "." if q else " ".join(x.upper() + "!!" + rnd.choice("$%#") for x in w)))
        labels.append((i, q))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
    model = quality.fit(d.where("doc_id % 3 <> 1"), spark.createDataFrame([*labels, (None, 1), (5, 7)], "doc_id long, quality long").withColumn("text", F.lit("")))
    out = {r.doc_id: r for r in quality.score(d, model).collect()}
    assert len(out) == len(docs)
    right = [out[i].predicted == q for i, q in labels if i % 3 == 1]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 3_000_000), (3, "x" * 3_000_000), (None, "the river")], "doc_id long, text string")
    rows = quality.score(odd, model).collect()
    assert len(rows) == 5 and rows[0].score == rows[1].score == model.share and all(0 <= r.score <= 1 for r in rows)


def test_no_or_one_class(spark):
    d = spark.createDataFrame([(i, "some text") for i in range(9)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(d, quality.fit(d, empty)).collect()} == {0.5}
    ones = d.select("doc_id", F.lit(1).alias("quality"))
    assert {r.score for r in quality.score(d, quality.fit(d, ones)).collect()} == {1.0}
    assert quality.score(d.limit(0), quality.fit(d, empty)).count() == 0


def test_scores_like_brute_force(spark):
    """Sizes under dictionaries made by plain calls, the logistic curve written out, and a tie at one half."""
    import math

    import zstandard

    docs, labels = corpus(120, 2)
    d = spark.createDataFrame([*docs, (500, "river " * 60_000), (501, "x"), (502, None)], "doc_id long, text string")
    model = quality.fit(d.where("doc_id < 120"), spark.createDataFrame(labels, "doc_id long, quality long"))
    texts = {r.doc_id: r.text for r in d.collect()}
    size = lambda b, dic: len(zstandard.ZstdCompressor(level=3, **({"dict_data": zstandard.ZstdCompressionDict(dic)} if dic else {})).compress(b))
    assert len(model.halves) == 2
    for r in quality.score(d, model).collect():
        raw, odds = (texts[r.doc_id] or "").encode(), []
        for half in model.halves if raw else ():
            total = [0, 0, 0]
            for at in range(0, len(raw), model.block_bytes):
                for i, dic in enumerate((half.good, half.bad, b"")):
                    total[i] += max(1, size(raw[at : at + model.block_bytes], dic) - size(b"", dic))
            z = [1.0, 10 * (total[1] - total[0]) / total[2], 20 * (total[1] - total[0]) / len(raw)]
            odds.append(sum(a * b for a, b in zip(z, half.weights, strict=True)))
        want = 1 / (1 + math.exp(-sum(odds) / 2)) if raw else model.share
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.5)
    half = quality.QualityModel((quality.Half(b"", b"", (0.0, 0.0, 0.0)),), 0.5)
    assert {(r.score, r.predicted) for r in quality.score(d.limit(3), half).collect()} == {(0.5, 1)}
