import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagstream.llm.packing import ByteBpe, best_cuts, pack, padding

ODD = ["", None, "a", "hello <|endoftext|> x", "퟿\U0001f600 éè", " " * 3000, "ab" * 4000, "\n\n\n", "word " * 3000, "One. Two! Three?\n" * 700]


def test_ids_are_the_tokenizers():
    slow, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ByteBpe()
    for t in ODD:
        assert fast.encode(t or "").tolist() == slow.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    rnd, length = random.Random(seed), 16
    at, penalties = [0], [0.0]
    for _ in range(60):
        at.append(at[-1] + rnd.randrange(1, 9))
        penalties.append(rnd.choice([0.0, 1.0, 3.0]))
    f = {0: 0.0}
    for j in range(1, len(at)):
        f[j] = penalties[j] + min(f[i] + padding(at[j] - at[i], length) for i in range(j) if at[j] - at[i] <= length)
    cuts = best_cuts(at, penalties, length)
    assert cuts[0] == 0 and cuts[-1] == at[-1]
    cost = sum(padding(b - a, length) + penalties[at.index(b)] for a, b in zip(cuts, cuts[1:]))
    assert abs(cost - f[len(at) - 1]) < 1e-9


def test_round_trip(spark):
    rnd = random.Random(1)
    texts = ODD + [" ".join(rnd.choice(["sun", "rain.", "hail", "Wind"]) for _ in range(rnd.randrange(1, 900))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit("x")).coalesce(2)
    rows = pack(docs, segment=9000).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[d])
    pad = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        pad += padding(at, 1024)
    assert pad < 0.03 * sum(map(len, ids.values()))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
