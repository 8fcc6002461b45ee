import random
from collections import Counter

import pytest

from tagstream.llm.common import work_path
from tagstream.llm.token_ledger import Ledger, count_tokens, delete, insert, revise

SCHEMA = "doc_id long, text string, lang string, source string"


def totals(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in df.collect()}


def brute(rows, versions):
    out = Counter()
    for _, t, lang, source in rows:
        for name, f in versions.items():
            for i, x in enumerate((1, len(f(t)) if t else 0, len(t or ""))):
                out[(source, lang, name), i] += x
    return {k: tuple(out[k, i] for i in range(3)) for k in {k for k, _ in out}}


def corpus():
    rnd = random.Random(2)
    rows = [(i, " ".join("ab cd efg".split()[: rnd.randrange(4)] * rnd.randrange(5)), rnd.choice(["en", "de", None]), rnd.choice(["s1"] * 4 + ["s2", None])) for i in range(90)]
    return rows + [(91, None, "en", "s1"), (91, None, "en", "s1"), (92, "z " * 100_000, "en", "s3")]


VERSIONS = {"words": str.split, "chars": list}


def test_deltas_are_additive_and_idempotent(spark):
    rows, make = corpus(), {k: (lambda f=f: f) for k, f in VERSIONS.items()}
    docs = spark.createDataFrame(rows, SCHEMA)
    ledger = Ledger(spark, work_path(spark, "ledger"))
    assert ledger.rollup().count() == 0
    counts = count_tokens(docs, make)
    assert ledger.commit("load", insert(counts)) and not ledger.commit("load", insert(counts))
    assert totals(ledger.rollup()) == brute(rows, VERSIONS)
    gone = [r for r in rows if r[0] % 3 == 0]
    assert ledger.commit("gone", delete(count_tokens(docs.where("doc_id % 3 = 0"), make)))
    left = [r for r in rows if r not in gone]
    assert totals(ledger.rollup()) == brute(left, VERSIONS)
    ledger.compact()
    assert not ledger.commit("gone", delete(count_tokens(docs.where("doc_id % 3 = 0"), make)))
    longer = [(i, (t or "") + " more", lang, "s9") if i % 3 == 1 else (i, t, lang, source) for i, t, lang, source in left]
    old, new = [r for r in left if r[0] % 3 == 1], [r for r in longer if r[0] % 3 == 1]
    assert ledger.commit("revised", revise(count_tokens(spark.createDataFrame(old, SCHEMA), make), count_tokens(spark.createDataFrame(new, SCHEMA), make)))
    assert totals(ledger.rollup()) == brute(longer, VERSIONS)
    ledger.compact()
    assert totals(ledger.rollup()) == brute(longer, VERSIONS)
    assert ledger.commit("all-gone", delete(count_tokens(spark.createDataFrame(longer, SCHEMA), make)))
    assert ledger.rollup().count() == 0


def test_a_batch_without_marker_does_not_count(spark):
    ledger = Ledger(spark, work_path(spark, "ledger"))
    docs = spark.createDataFrame([(1, "a b", "en", "s")], SCHEMA)
    counts = insert(count_tokens(docs, {"w": lambda: str.split}))
    counts.write.parquet(f"{ledger.path}/deltas/batch=x")
    assert ledger.rollup().count() == 0
    assert ledger.commit("x", counts)
    assert totals(ledger.rollup()) == {("s", "en", "w"): (1, 2, 3)}


def test_empty_batch_and_bad_id(spark):
    ledger = Ledger(spark, work_path(spark, "ledger"))
    none = insert(count_tokens(spark.createDataFrame([], SCHEMA), {"w": lambda: str.split}))
    assert ledger.commit("e", none) and not ledger.commit("e", none)
    assert ledger.rollup().count() == 0
    with pytest.raises(ValueError):
        ledger.commit("../x", none)


def test_query_counts_what_the_tokenizers_give(spark, tmp_path):
    """op6 over a small table, special strings and clashing columns included, against the tokenizers themselves."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tagstream.llm.packing import ByteBpe
    from tagstream.llm.queries import op6_token_counts

    rows = [(1, "a <|endoftext|> b", "en", "s"), (2, "The house  and\n\nthe tree.", "en", "s"), (3, None, None, "s"), (4, "", "de", None), (5, "Straße über 1234567 日本", "de", "t"), (5, "Straße über 1234567 日本", "de", "t")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_tokens int, tokenizer string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    versions = {"byte_bpe_50k": lambda t: exact.encode(t, add_special_tokens=False).ids, "byte_bpe_multi_50k": ByteBpe("byte_bpe_multi_50k", fast_only=True).encode}
    assert totals(op6_token_counts(spark, str(tmp_path))) == brute(rows, versions)


def test_markers_stay_few(spark):
    ledger = Ledger(spark, work_path(spark, "ledger"))
    rows = insert(count_tokens(spark.createDataFrame([(1, "a b", "en", "s")], SCHEMA), {"w": lambda: str.split}))
    for i in range(4):
        assert ledger.commit(f"b{i}", rows)
        ledger.compact()
        assert len(ledger._markers()) == 1
    assert not ledger.commit("b0", rows) and not ledger.commit("b3", rows)
    ledger.compact()
    assert totals(ledger.rollup()) == {("s", "en", "w"): (4, 8, 12)}
