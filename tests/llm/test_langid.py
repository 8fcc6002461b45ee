import math
from collections import Counter

import numpy as np

from tagstream.llm import langid
from tests.llm.test_pipeline import corpus

SCHEMA = "doc_id long, text string, lang string"


def slot(code):
    """The finaliser of common.mix64, on plain integers."""
    m = (1 << 64) - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        code = (code ^ code >> shift) * factor & m
    return (code ^ code >> 31) % langid.DIMENSIONS


def brute(text):
    """Hashed n-grams of the words between blanks, counted one by one."""
    kept = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    data = b" " + b" ".join(kept.split()) + b" "
    found = Counter()
    for k in langid.LENGTHS:
        for i in range(len(data) - k + 1):
            found[slot(int.from_bytes(bytes([k]) + data[i : i + k], "big"))] += 1
    return found


def test_predictions_like_brute_force(spark):
    rows, _ = corpus()
    long = (900, "der fluß und das haus " * 3000, "de")
    docs = spark.createDataFrame([tuple(r) for r in rows] + [long], SCHEMA)
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    for r in langid.identify(docs.drop("lang"), model).collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.lang_score, r.lang_rejected) == ("und", 0.0, True)
            continue
        vector = {s: n * float(model.idf[s]) for s, n in brute(r.text).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[s]) for s, v in vector.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert r.lang_pred == model.languages[best] and abs(r.lang_score - cosines[best]) < 1e-4


def test_equal_centroids_give_the_language_that_sorts_first(spark):
    rows = [(i, "the same words here", lang) for i in range(12) for lang in ("b", "a", "c")]
    docs = spark.createDataFrame([(3 * i + j, t, lang) for j, lang in enumerate("bac") for i, t, lang2 in rows if lang2 == lang], SCHEMA)
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()} == {"a"}


def test_only_the_most_frequent_languages_are_learned(spark):
    rows = [(i, "the same words here", "en") for i in range(9)] + [(20 + i, f"autre texte {i}", "fr") for i in range(4)] + [(40, "ein text", "x-1")]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), most_langs=2)
    assert set(model.languages) == {"en", "fr"}
