import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagstream.llm import kneser_ney as kn

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall((t or "").encode().lower().decode()), "</s>"]


class Brute:
    """The same model with plain dictionaries."""

    def __init__(self, texts, min_count=2):
        self.c = Counter(w for t in texts for w in tokens(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.often = {w for w, c in self.c.items() if c >= min_count}
        pairs = Counter()
        for t in texts:
            s = ["<s>", *map(self.sym, tokens(t))]
            pairs.update(zip(s, s[1:]))
        self.pairs, self.after, self.first = pairs, defaultdict(Counter), Counter()
        for (a, b), c in pairs.items():
            self.after[a][b] = c
            self.first[b] += 1
        self.d = kn.discounts([sum(c == i for c in pairs.values()) for i in range(1, 5)])
        self.e = kn.discounts([sum(c == i for c in self.first.values()) for i in range(1, 5)])

    def sym(self, w):
        return w if w in self.often else None

    def low(self, w):
        types = len(self.pairs)
        if not types:
            return 1 / (len(self.often) + 1)
        freed = sum(self.e[min(c, 3) - 1] for c in self.first.values()) / types
        c = self.first[w]
        return (max(c - self.e[min(c, 3) - 1], 0) if c else 0) / types + freed / (len(self.often) + 1)

    def p(self, h, w):
        s, after = self.sym(w), self.after[h]
        total = sum(after.values())
        p = self.low(s)
        if total:
            c = after[s]
            p = (max(c - self.d[min(c, 3) - 1], 0) if c else 0) / total + sum(self.d[min(x, 3) - 1] for x in after.values()) / total * p
        return p / (self.v - len(self.often) + 1) if s is None else p

    def row(self, text):
        w = tokens(text)
        h = ["<s>", *map(self.sym, w)]
        return len(w), sum(x in self.c for x in w), self.n, sum(math.log10((self.c[x] + 1) / (self.n + self.v + 1)) for x in w), sum(math.log10(self.p(a, x)) for a, x in zip(h, w))


def corpus():
    rnd = random.Random(7)
    texts = []
    for _ in range(150):
        w = [rnd.randrange(40)]
        for _ in range(rnd.randrange(0, 80)):
            w.append((w[-1] * 7 + 3) % 40 if rnd.random() < 0.7 else rnd.randrange(40))
        texts.append(" ".join(f"W{i}" + rnd.choice(["", "", ".", f"-{rnd.randrange(50)}"]) for i in w))
    return [*enumerate([*texts, None, "", " \t\n ", "A a b A", "x" * 50_000, "never seen", "W1 " * 3000])]


def same(got, want):
    assert got[:3] == want[:3]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[3:], want[3:])), (got, want)


def test_like_plain_dictionaries(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    train = [t for i, t in rows if i % 3]
    model, brute = kn.train_model(docs.where("doc_id % 3 <> 0")), Brute(train)
    out = {r.doc_id: r for r in kn.score(docs, model).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        r = out[i]
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), brute.row(t))
    assert kn.perplexity(kn.score(docs, model)).first().perplexity > 1
    held = [out[i] for i, t in rows[:150] if i % 3 == 0 and t]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    rows = corpus()
    model = kn.train_model(spark.createDataFrame(rows, "doc_id long, text string"))
    brute = Brute([t for _, t in rows])
    for h in ("w1", "w3.", "neverseen"):
        seen = sorted(brute.c, key=str)
        words = [w for w in seen if w != "</s>"] + ["quite-new"]
        logs, _, _ = kn.log_probabilities(model, pa.array([f"{h} {w}" for w in words] + [h], pa.string()))
        at = np.cumsum([3] * len(words)) - 2
        assert math.isclose(float((10 ** logs[at]).sum() + 10 ** logs[-1]), 1.0, rel_tol=1e-9)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = kn.score(docs, kn.train_model(docs.limit(0))).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3, 0, 0), (1, 0, 0)]
    assert all(math.isfinite(r.score) and r.base_score == 0 for r in rows)
    assert kn.score(docs.limit(0), kn.train_model(docs)).count() == 0


def test_packed_integers():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert (kn.unpack(kn.pack(a)) == a).all()
    assert len(kn.unpack(kn.pack(a[:0]))) == 0
