"""Packing against the plain tokenizer, and the planner against all its rules."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import none, odd, prose  # noqa: F401
from tidemark.llm import packing
from tidemark.llm.token_file import tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fill(lengths, room):
    """The largest sum up to room of any of the lengths, each used at most once: by trying all."""
    return max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= room)


def test_fullest_equals_trying_all():
    rng = random.Random(5)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 60) for _ in range(rng.randrange(0, 10)))
        room = rng.randrange(0, 150)
        picked = packing.fullest([x for x in sorted(counts, reverse=True) if x <= room], counts, room)
        assert all(picked[x] <= counts[x] for x in picked)
        assert sum(x * n for x, n in picked.items()) == best_fill(list(counts.elements()), room)


def check_plan(counts, window):
    plan = packing.make_plan(counts, window)
    lengths = np.repeat(np.array(list(counts), np.int64), list(counts.values()))
    numbers = np.concatenate([np.arange(n) for n in counts.values()]) if counts else np.zeros(0, np.int64)
    which, start, length, sequence, offset = packing.places(plan, lengths, numbers)
    for of, at, whole in ((which, start, lengths), (sequence, offset, None)):  # each remainder and each sequence is covered once, from 0 on
        order = np.lexsort((at, of))
        of, at, n = of[order], at[order], length[order]
        same = np.append(False, of[1:] == of[:-1])[: len(of)]
        assert (at[~same] == 0).all() and (at[same] == (at + n)[np.flatnonzero(same) - 1]).all()
        total = np.bincount(of, n, minlength=0).astype(int)
        if whole is not None:
            assert (total == whole).all()
        else:
            assert len(total) == plan.sequences and all(x == window or x & (x - 1) == 0 for x in total.tolist())
            assert (total < window).sum() <= window.bit_length()
    return plan, len(which)


@pytest.mark.parametrize("kind", ["even", "short", "long", "alike", "one"])
def test_plan_covers_all_without_padding(kind):
    rng = np.random.default_rng(2)
    for n in (1, 7, 300, 5000):
        lengths = {"even": rng.integers(1, 4096, n), "short": rng.integers(1, 30, n), "long": rng.integers(2100, 4096, n), "alike": np.full(n, 3000), "one": np.ones(n, int)}[kind]
        plan, pieces = check_plan(Counter(lengths.tolist()), 4096)
        assert pieces <= n + plan.sequences  # at most one cut a sequence
    check_plan({}, 4096)
    check_plan({7: 5, 1: 1}, 10)


def test_plan_does_not_grow_with_the_number_of_documents():
    for size in (10**4, 10**9):
        plan = packing.make_plan({length: size + 37 * length % 101 for length in range(1, 4096)})
        assert len(plan.key) < 40_000


def check_packed(df, window, rows):
    """Pieces of all rows by the plain tokenizer, row by row."""
    pieces = df.collect()
    slow = Counter()
    make = tokenizer(PATH)
    for doc_id, text in rows:
        ids = [*make.encode(text or "", add_special_tokens=False).ids, packing.END]
        slow[doc_id, np.array(ids, "<u4").tobytes()] += 1
    sequences = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or at & (at - 1) == 0
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
    for (doc_id, n), parts in by_doc.items():
        copies = {ids: k for (d, ids), k in slow.items() if d == doc_id and len(ids) == 4 * n}
        if len(copies) == 1:  # repeated rows are alike, so any of their pieces may continue one another
            (ids, k), = copies.items()
            got = Counter()
            for start, b in parts:
                assert ids[4 * start : 4 * start + len(b)] == b
                got[start] += 1
                got[start + len(b) // 4] -= 1
            assert sum(len(b) for _, b in parts) == k * len(ids)
            assert got[0] == k and got[n] == -k and all(v == 0 for x, v in got.items() if x not in (0, n))
        else:
            assert sum(len(b) for _, b in parts) == sum(k * len(ids) for ids, k in copies.items())
    assert sum(p.length for p in pieces) == sum(k * len(ids) // 4 for (_, ids), k in slow.items())
    return pieces


def test_packing_equals_the_plain_tokenizer(spark, odd, none):  # noqa: F811
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([1, 5, 60, 400, 3000])) for _ in range(60)]
    texts += ["<|endoftext|> a<|startoftext|>b", "It's I'LL don't 'so' ...?!x 12a3", "é é ́ H̱ İI ǅ Σς", "tab\tnew\nline\x0b\x0c\r\x1c\x1d\x85\xa0 x　y", "漢字かな 🙂🙂", "x" * 9000, " ", "\0 a\0b"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window in (4096, 100):
        pieces = check_packed(packing.pack(df, PATH, window), window, rows)
        assert len(pieces) <= sum(1 + p.doc_tokens // window for p in pieces if p.start == 0) + len({p.sequence_id for p in pieces})
    joined = packing.sequences(packing.pack(df, PATH, 100)).collect()
    assert sum(r.length for r in joined) == sum(p.length for p in pieces) and all(len(r.ids) == 4 * r.length for r in joined)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_packed(packing.pack(odd, PATH), 4096, rows)
    assert packing.pack(none, PATH).collect() == []
    p = packing.pack(odd, PATH).withColumn("crc", F.crc32("ids")).first()
    assert p.crc == zlib.crc32(bytes(p.ids))
    with pytest.raises(ValueError):
        packing.Words(public_tokenizers.path("byte_bpe_50k.json"), 0)
