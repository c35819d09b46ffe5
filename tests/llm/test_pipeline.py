"""The pipeline, stage by stage, against slow versions of its stages."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import BPE, SCHEMA, brute_components, prose, slow_contaminated, slow_mix
from tidemark.llm import decontaminate
from tidemark.llm.common import Scratch, materialise, owning, table
from tidemark.llm.token_file import tokenizer

SF = "/root/testdata/sf0.001"


def size(text):
    return len((text or "").split())


def check_stages(spark, docs, sf, unique):
    """Every stage on ``docs``; with ``unique`` ids each is held against its slow version."""
    seen = [docs.collect()]
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = materialise(stage(spark, frame, sf))
        assert name == corpus_pipeline.STAGES[-1][0] or frame.columns == docs.columns
        seen.append(frame.collect())
    start, known, single, clean, mixed, files = seen
    assert not Counter(known) - Counter(start)
    if unique:
        roots = {root for _, root in brute_components([(r.doc_id, r.text) for r in known]).values()}
        assert sorted(r.doc_id for r in single) == sorted(roots)
        items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
        leaked = {d for d, _ in slow_contaminated([(r.doc_id, r.text) for r in single], items)}
        assert {r.doc_id for r in single} - {r.doc_id for r in clean} == leaked
        taken = slow_mix([(r.doc_id, r.text, r.source) for r in clean])
        assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: taken[r.doc_id] // size(r.text) for r in clean if size(r.text) and taken[r.doc_id]})
    assert {r for r in mixed} <= set(clean)
    make = tokenizer(BPE)
    at, expected = 0, []
    for doc_id, text in sorted(((r.doc_id, r.text) for r in mixed), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*make.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(files, key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(expected)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    return seen


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    seen = check_stages(spark, table(spark, SF, "documents"), SF, True)
    assert len(seen[1]) >= 0.97 * len(seen[0])
    assert decontaminate.MIN_COVERED == 0.5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_odd_documents(spark):
    """Nulls in any column, empty and repeated rows, repeated and null ids, a very long text."""
    rng = random.Random(21)
    plain = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, SF, "documents").limit(60).collect()]
    long = " ".join(p[1] or "" for p in plain) * 3
    odd = [(None, "some words without an id", "en", "a", 3), (None, None, None, None, None), (70_001, "", "en", None, 0), (70_002, None, "en", "a", 0), (70_003, " \n\t", None, "a", 3), (70_004, long, None, None, len(long))]
    again = [(70_005, prose(rng, 50), "en", "a", 1)] * 3 + [(70_006, prose(rng, 50), "en", "a", 1), (70_006, prose(rng, 60), "en", "b", 2)]
    seen = check_stages(spark, spark.createDataFrame([*plain, *odd, *again], SCHEMA), SF, False)
    assert sum(r.doc_id == 70_005 for r in seen[2]) <= 1 and not any(r.text is None for r in seen[1])


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_long_runs_of_names_and_numbers(spark):
    leak = table(spark, SF, "benchmark").orderBy("item_id").first().text
    runs = [" ".join("Ab" + "c" * (i % 5) for i in range(6000)), ".".join(str(i) for i in range(6000))]
    rows = [(80_000 + k, f"of {runs[k % 2]}" + f". {leak}" * (k < 2), "en", "a", 1) for k in range(4)]
    left = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(r.doc_id for r in left.collect()) == [80_002, 80_003]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run_leaves_only_what_it_returns(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    with Scratch(spark) as tables, owning(tables):
        assert corpus_pipeline.run(spark, SF).count() > 0
        assert len(set(os.listdir(base)) - before) <= 2  # the last stage's documents, and the token files
