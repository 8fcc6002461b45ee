import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tagstream.llm.decontam import contamination, items_digest, merge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall((t or "").encode().lower().decode())


def brute(docs, items, size=10):
    out = []
    for d, t in docs:
        w, hit, ids = split(t), set(), set()
        for i, it in items:
            v = split(it)
            n = min(size, len(v))
            for k in range(max(1, len(v) - n + 1) if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def cases():
    rnd = random.Random(2)
    vocabulary = ["alpha", "Beta", "GAMMA", "été", "x1", "日本", "the", "a"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 4, 12, 30])))) for i in range(12)]
    items += [(90, ""), (91, None), (92, "!!!"), (93, items[5][1]), (None, "the a the")]
    docs = []
    for d in range(60):
        t = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60)))
        if d % 3 == 0:
            t += rnd.choice([" ", "\n-- "]) + (rnd.choice(items)[1] or "").replace(" ", rnd.choice([" ", ", ", "  \n"])).upper() + " tail"
        docs.append((d, t))
    return docs + [(70, None), (71, ""), (72, "a" * 300_000), (73, docs[0][1]), (73, docs[0][1])], items


@pytest.mark.parametrize("block", [64_000_000, 1_000])
def test_same_as_brute_force(spark, block):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("?")).withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = contamination(d, b, block_chars=block).withColumn("sha", items_digest(F.col("items")))
    got = sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated").collect())
    assert got == brute(docs, [i for i in items if i[0] is not None])


def test_spans_point_into_the_original(spark):
    item = "one two three four five six seven eight nine ten eleven"
    text = "Été — before. ONE, two\nthree four; five six seven  eight nine ten eleven! after"
    r = contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert [text[a:b] for a, b in zip(r.spans[::2], r.spans[1::2])] == [text[text.index("ONE") : text.index("!")]]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination(d, b).first().contaminated is False
    assert contamination(d.limit(0), b).count() == 0


def test_merge():
    assert merge([(5, 7), (1, 3), (3, 4), (6, 9)]) == [(1, 4), (5, 9)]
