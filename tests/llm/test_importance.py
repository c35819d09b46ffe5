"""Importance resampling against loops over all words."""

import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from tests.llm.test_operators import none, odd, prose  # noqa: F401
from tidemark.llm import importance

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def slow(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for hold, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs(text)[1]:
                hold[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, f = runs(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    out = [(r[0], *r[2:], k if k <= percent * len(fit) // 100 else None) for k, r in enumerate(fit, 1)]
    return sorted([*out, *((r[0], *r[2:], None) for r in rows if r[1] < least)], key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_resampling_equals_loops(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.choice([1, 19, 20, 21, 100, 2000]))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "ÀÉ Straße STRASSE x_y 1/2 :;az{|}"), (None, prose(rng, 40)), (7, prose(rng, 50)), (7, docs[7][1])]
    target = [prose(rng, 200), None, "alphabeta " * 50]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "row": F.lit("x"), "feature": F.lit("x"), "s": F.lit("x")}).repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(importance, "COMMON", 40)  # most features are joined
    assert got(importance.resample(df, goal)) == slow(docs, target)
    monkeypatch.undo()
    monkeypatch.setattr(importance, "HELD", 30)
    assert got(importance.resample(df, goal, percent=37, longest=3, buckets=50)) == slow(docs, target, 3, 50, 37)


def test_odd_tables(spark, odd, none):  # noqa: F811
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(importance.resample(odd, none)) == slow(docs, [])
    assert importance.resample(none, none).collect() == []
    assert got(importance.resample(odd, odd, percent=100)) == slow(docs, [t for _, t in docs], percent=100)
