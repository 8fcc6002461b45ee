import hashlib
import random

from pyspark.sql import functions as F

from tagstream.llm.line_dedup import remove_repeated_chunks


def chunks(text, window=2, divisor=3):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if sum(h[i - k] * 31**k for k in range(window) if i >= k) % divisor == 0 or i == len(lines) - 1:
            out.append((start, lines[start : i + 1]))
            start = i + 1
    return out


def brute(rows):
    first, found = {}, {}
    for r, (d, t) in enumerate(rows):
        for at, c in chunks(t) if t is not None else []:
            if len(c) >= 2 and len("\n".join(c)) >= 20:
                found.setdefault("\n".join(c), []).append((d if d is not None else 1 << 62, r, at))
    for c, places in found.items():
        first[c] = min(places)
    out = []
    for r, (d, t) in enumerate(rows):
        if t is None:
            out.append((d, None, 0, 0, None))
            continue
        keep, lost = [], 0
        for at, c in chunks(t):
            key = "\n".join(c)
            if key in first and first[key] != (d if d is not None else 1 << 62, r, at):
                lost += len(c)
            else:
                keep.append(key)
        out.append((d, t, t.count("\n") + 1, lost, "\n".join(keep)))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(3)
    lines = [f"line number {i} of the stock of lines" for i in range(40)]
    block = lines[:9]
    rows = []
    for d in range(80):
        own = [rnd.choice(lines) + (str(d) if rnd.random() < 0.6 else "") for _ in range(rnd.randrange(1, 14))]
        at = rnd.randrange(len(own) + 1)
        rows.append((d, "\n".join(own[:at] + (block if d % 3 == 0 else []) + own[at:])))
    rows += [(90, None), (91, ""), (92, "\n\n\n"), (93, "one line"), (94, "a\r\nb\r\n" * 30), (95, rows[4][1]), (95, rows[4][1]), (None, rows[5][1]), (97, "x" * 200_000)]
    return rows


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r.clean_text) for r in df.collect()), key=repr)


def test_like_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("n_lines", F.lit("?")).withColumn("at", F.lit(5)).withColumn("digest", F.lit("d"))
    out = remove_repeated_chunks(docs)
    assert out.columns == ["doc_id", "text", "at", "digest", "n_lines", "n_removed", "clean_text"]
    assert got(out) == brute(rows)
    assert any(r[3] > 5 for r in brute(rows))


def test_clashing_digests(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(remove_repeated_chunks(docs, digest=lambda c: F.substring(F.unhex(F.md5(c.cast("binary"))), 1, 0).cast("binary"))) == brute(rows)


def test_empty(spark):
    assert remove_repeated_chunks(spark.createDataFrame([], "doc_id long, text string")).count() == 0
