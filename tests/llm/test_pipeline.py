import random

import corpus_pipeline
from tagstream.llm import decontam, langid
from tests.llm.test_exact_dedup import norm
from tests.llm.test_ngram_join import brute as components

VOCABULARY = {"en": "the of and thing word house tree river".split(), "de": "der und nicht zeit straße über haus fluß".split(), "fr": "le est être maison où rivière arbre été".split()}


def corpus():
    rnd = random.Random(4)
    rows = []
    for i in range(160):
        lang = rnd.choice(sorted(VOCABULARY))
        rows.append([i, " ".join(rnd.choice(VOCABULARY[lang]) + rnd.choice(["", "", "s", "en"]) for _ in range(rnd.randrange(20, 160))), lang])
    item = " ".join(rnd.choice(VOCABULARY["en"]) + str(rnd.randrange(9)) for _ in range(14))
    rows += [[160 + i, rows[i][1].upper() if i % 2 else rows[i][1], rows[i][2]] for i in range(20)]
    rows += [[180 + i, rows[30 + i][1] + " end", rows[30 + i][2]] for i in range(20)]
    rows += [[200 + i, rows[60 + i][1] + " " + item.upper() + " und", rows[60 + i][2]] for i in range(10)]
    rows += [[210, None, "en"], [211, "", None], [212, "12 34 --", "de"], [213, "12 34 --", "de"]]
    rnd.shuffle(rows)
    return rows, [(1, item), (2, "")]


def test_like_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            steps.append({r.doc_id: r.text for r in docs.collect()})

    texts = {i: t for i, t, _ in rows}
    left = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert steps[0] == left
    last = {}
    for i, t in left.items():
        last[norm(t)] = max(i, last.get(norm(t), i))
    left = {i: t for i, t in left.items() if last[norm(t)] == i}
    assert steps[1] == left
    stays = {c for _, _, c in components(list(left.items()), percent=80, k=5)}
    left = {i: t for i, t in left.items() if i in stays}
    assert steps[2] == left
    windows = decontam.windows([i for i in items], 10)
    left = {i: t for i, t in left.items() if not any(w in decontam.between_blanks(decontam.words(t)) for w in windows)}
    assert steps[3] == left
    assert len(steps[2]) > len(left) > 100

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert set(total) == set(left)
    assert all(total[p.doc_id] == p.doc_tokens for p in pieces)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_of_held_out_documents(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    out = langid.identify(docs.withColumnRenamed("doc_id", "lang_pred").selectExpr("lang_pred as doc_id", "text", "lang", "'x' as lang_score"), model)
    found = {r.doc_id: r for r in out.collect()}
    assert all(found[i].lang_pred == lang for i, t, lang in rows if t and i < 160)
    assert {found[i].lang_pred for i in (210, 211, 212, 213)} == {"und"}
    assert all(0 <= r.lang_score <= 1 for r in found.values())


def test_no_labels_and_far_texts(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None
    assert langid.identify(docs, None).first().lang_pred == "und"
    rows, _ = corpus()
    model = langid.fit(spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string"))
    far = spark.createDataFrame([(1, "漢字仮名交じり文 " * 40), (2, rows[0][1] or "the house and the tree")], "doc_id long, text string")
    assert [r.lang_rejected for r in langid.identify(far, model).orderBy("doc_id").collect()] == [True, False]


def test_near_copies_by_row(spark):
    text = lambda i, n=40: " ".join(f"t{i}w{j}" for j in range(n))
    rows = [(1, text(1)), (None, text(1) + " end"), (None, text(2)), (None, text(3))]  # a null id near a document's, and two of their own
    rows += [(None, text(4)), (None, text(4) + " end"), (None, text(4) + " stop")]  # no id at all
    rows += [(5, text(5)), (5, text(5) + " end")]  # one id, near copies
    rows += [(6, text(6)), (7, text(6) + " end"), (7, text(7))]  # one id, of which one row is a near copy
    rows += [(8, None), (None, ""), (None, "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.near(spark, docs, "")
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    for must in ((1, text(1)), (None, text(2)), (None, text(3)), (6, text(6)), (7, text(7)), (8, None), (None, ""), (None, "!")):
        assert left.count(must) == 1
    assert sum((t or "").startswith(text(4)) for _, t in left) == 1
    assert sum((t or "").startswith(text(5)) for _, t in left) == 1
    assert len(left) == 10
