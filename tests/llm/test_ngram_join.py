import random
import re

import pytest
from pyspark.sql import functions as F

from tagstream.llm.ngram_join import Trie, jaccard_components, least_overlap, sent, trie_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=4):
    w = WORD.findall((text or "").encode().lower().decode())
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, percent=85, k=4):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=3, bases=12, copies=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, line = [], "one very common line of text that many share"
    for _ in range(bases):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 9, 60, 140]))]
        for _ in range(copies):
            w = base[:]
            for _ in range(rnd.randrange(0, max(1, len(w) // 12) + 1)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((line + "\n" if rnd.random() < 0.3 else "") + " ".join(w))
    rows += [None, "", " \t\n", "Same Words here now", "same words HERE now", "same", "x" * 100_000]
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    return list(zip(ids, rows, strict=True))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("options", [{}, {"leader_rounds": 0}, {"leader_rounds": 0, "block_tokens": 900}])
def test_same_components_as_all_pairs(spark, options):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("class", F.lit("c")).repartition(5)
    assert got(jaccard_components(docs, **options)) == brute(rows)


def test_empty_and_wordless_tables(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(2, None), (1, "")], "doc_id long, text string")
    assert got(jaccard_components(docs)) == [(1, 0, 1), (2, 0, 2)]


def test_null_and_repeated_ids(spark):
    t = " ".join(f"a{i}" for i in range(50))
    rows = spark.createDataFrame([(None, t), (7, t + " end"), (7, "another text of its own"), (9, t)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(rows).collect()) == [(-1, 47, 7), (7, 2, 7), (7, 48, 7), (9, 47, 7)]


def test_trie_finds_all_partners():
    rnd = random.Random(5)
    sets = [sorted(rnd.sample(range(30), rnd.randrange(1, 28))) for _ in range(200)]
    sets += [s[:] for s in sets[:5]]
    own = [rnd.randrange(0, 3) for _ in sets]
    n = [len(s) + o for s, o in zip(sets, own, strict=True)]
    for percent in (50, 80, 85):
        trie, alive = Trie(sets, n, own, percent), [True] * len(sets)
        for i, s in enumerate(sets):
            want = {j for j, t in enumerate(sets) if 100 * len(set(s) & set(t)) >= percent * (n[i] + n[j] - len(set(s) & set(t)))}
            assert set(trie.partners(set(s), n[i], alive)) == want
        links = trie_links(list(range(len(sets))), list(range(len(sets))), n, own, sets, percent)
        assert len(links) < len(sets)


def test_short_texts_that_lack_a_word(spark):
    rows = []
    for i in range(12):
        words = [f"v{i}x{j}" for j in range(10)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[1:] if i % 2 else words[:-1]))]
    assert got(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_partners_of_all_sizes_send_enough(percent):
    for n in range(1, 90):
        spare = n - least_overlap(n, percent)
        need = min(n, 2 * spare + 1) - spare
        for m in range(least_overlap(n, percent), 100 * n // percent + 1):
            for common in range(1, min(n, m) + 1):
                if 100 * common >= percent * (n + m - common):
                    # the worst order: all that either has alone comes first
                    assert min(common, sent(n, percent) - (n - common), sent(m, percent) - (m - common)) >= need
