"""The training-data operators on small hand-made tables, against brute force and known answers."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, embed, jaccard, language, licenses, mixing, quality_model, quality_rules, sample, secrets, token_file, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls anywhere, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    rows = [(1, None, "a"), (2, "", None), (3, "   \n\t", "a"), (None, "some words here", "b"), (4, prose(rng, 30_000), "b"), (5, "tie", "a"), (6, "tie", "a"), (7, prose(rng, 60), None), (7, prose(rng, 60), "a")]
    df = frame(spark, [*rows, rows[-1], rows[-1]])
    for name in ("size", "target", "score", "held_out", "n", "fp", "kept", "spans", "sig", "label", "probs", "features", "w", "key", "h"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(ids[x]), find(ids[y])))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(1)
    docs = []
    passage = prose(rng, 60)
    for base in range(30):
        words = prose(rng, rng.choice([1, 3, 4, 5, 6, 9, 20, 60, 150, 400])).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            text = " ".join(copy)
            docs.append(text.upper() if rng.random() < 0.1 else text)
    docs += [passage + " " + prose(rng, 80) for _ in range(40)] + [None, "", " \n "]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(frame(spark, [(i, t, "s") for i, t in docs])).collect()}
    assert got == brute_components(docs)


def test_jaccard_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 21, 31, 33, 47, 64, 90, 127, 128, 129, 200, 255, 400, 700, 1023, 3000]:
        for _ in range(60):
            a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            b_size = int(rng.integers(-(-3 * n // 4), 4 * n // 3 + 1))
            least = -(-3 * (n + b_size) // 7)
            if least > min(n, b_size):
                continue
            b = np.concatenate([a[:least], rng.integers(0, 1 << 64, b_size - least, dtype=np.uint64)])
            x, y = jaccard.signatures(np.unique(a)), jaccard.signatures(np.unique(b))
            band = max(n, b_size).bit_length() - 1
            assert len([s for s in set(x.tolist()) & set(y.tolist()) if s & 31 == band]) >= jaccard.required(2 << band)


def test_deduplicate_keeps_one_of_each_group(spark, odd, none):
    rng = random.Random(2)
    text = prose(rng, 50)
    df = frame(spark, [(3, text, "a"), (1, text + " more", "b"), (2, text, "c"), (9, None, "a"), (8, prose(rng, 50), "a"), (8, "", "a")])
    assert sorted(r[0] for r in jaccard.deduplicate(df).collect()) == [1, 8, 8, 9]
    kept = jaccard.deduplicate(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 7").count() == 2 and kept.filter("doc_id IN (5, 6)").count() == 1
    assert jaccard.near_duplicates(none).count() == 0
    words = prose(rng, 400).split()
    near = [" ".join([*words[:k], "x", *words[k:]]) for k in range(0, 400, 40)]
    other = prose(rng, 400).split()
    bridge = [(1, " ".join(other), "a"), (None, " ".join(["x", *other[:380]]), "a"), (2, " ".join(["y", *other[:290]]), "a")]
    nameless = frame(spark, [(None, t, "a") for t in near + near[:3]] + [(None, prose(rng, 50), "b"), (None, "", "b"), (None, None, "b"), *bridge])
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in jaccard.deduplicate(nameless).collect()).count((1, other[0][0])) == 1
    labelled = jaccard._classified(nameless).collect()
    assert {r.component_id for r in labelled if r.doc_id in (1, 2)} == {1} and sum(r.component_id == 1 for r in labelled) == 3
    assert len({r.label for r in labelled if r.n > 390 and r.component_id is None}) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(500, 501)], "a long, b long"))
    got = dict(map(tuple, jaccard.components(edges).collect()))
    assert all(got[v] == 0 for v in range(201)) and got[501] == 500


def test_mix_meets_targets_and_repeats(spark, odd, none):
    rng = random.Random(4)
    df = frame(spark, [(i, prose(rng, rng.randrange(5, 60)), f"s{i % 4}" if i % 7 else None) for i in range(600)])
    rows = mixing.mix(df).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(13)).collect()))
    by = {}
    for r in rows:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    total = sum(v[2] for v in by.values())
    assert abs(sum(v[0] for v in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken - target) <= 120 and target <= 2 * size + 1e-9 for target, taken, size in by.values())
    assert sum(v[1] for v in by.values()) <= 1.5 * total
    mixed = mixing.mixed(df).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in mixed} == {r.doc_id: r.taken // r.size for r in rows if r.taken}
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    plan = mixing.mix(odd)
    assert plan.count() == odd.count() and plan.filter("size = 0").agg(F.sum("taken")).first()[0] == 0
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(odd).count() == plan.filter("taken > 0").agg(F.sum(F.col("taken") / F.col("size"))).first()[0]


def slow_mix(rows, weights=(5.0, 2.0, 1.0), share=1.5, epochs=2):
    """taken by row: sort all copies by finish time, take while the budget lasts."""
    import hashlib

    size = lambda t: len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w])
    of, words = {}, {}
    for i, t, s in rows:
        of.setdefault(s, []).append((hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], i, size(t)))
    names = sorted((s for s in of if s is not None)) + [s for s in of if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    words = {s: sum(x[2] for x in of[s]) for s in names}
    target, left, free = {}, share * sum(words.values()), list(names)
    while free:
        level = left / sum(w[s] for s in free)
        full = [s for s in free if level * w[s] > epochs * words[s]]
        if not full:
            target |= {s: level * w[s] for s in free}
            break
        for s in full:
            target[s] = epochs * words[s]
            left -= target[s]
            free.remove(s)
    copies = []
    for s in names:
        run = 0
        for _ in range(epochs):
            for _, i, n in sorted(of[s]):
                run += n
                if n:
                    copies.append((run / target[s], "" if s is None else "=" + s, run, i, n))
    taken, spent = dict.fromkeys((i for i, _, _ in rows), 0), 0
    for _, _, _, i, n in sorted(copies):
        spent += n
        if spent > share * sum(words.values()):
            break
        taken[i] += n
    return taken


def test_mix_equals_a_sorted_cut(spark):
    rng = random.Random(40)
    for sources, n in ((5, 400), (1, 40), (9, 300)):
        rows = [(i, prose(rng, rng.randrange(0, 60)), None if i % 11 == 0 else f"s{min(rng.randrange(sources), rng.randrange(sources))}") for i in range(n)]
        assert {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows)).collect()} == slow_mix(rows)


def test_quality_rules(spark, odd, none):
    rng = random.Random(6)
    good = "\n".join(prose(rng, 12).capitalize() + "." for _ in range(6))
    menu = "\n".join(["Home | About | Shop | Help", "Click here to see more of it", "THIS IS ALL LOUD TEXT"] * 3 + [prose(rng, 12)])
    loop = " ".join(["one two three four five six seven eight nine"] * 5)
    got = {r.doc_id: r for r in quality_rules.clean(frame(spark, [(1, good, "a"), (2, menu, "a"), (3, loop, "a"), (4, "short", "a"), (5, None, "a")])).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert got[1].clean_text == good and got[3].n_repeat_words == 45 and got[2].n_dup_lines == 6 and got[5].n_words == 0
    long = prose(rng, 3000) + " and the privacy policy says read more of it " + prose(rng, 2000)
    quoted = " ".join(f"{prose(rng, 20)} « {prose(rng, 3)} » {prose(rng, 30)} · and" for _ in range(5))
    assert all(r.kept for r in quality_rules.clean(frame(spark, [(1, long, "a"), (2, quoted, "a")])).collect())
    words = [rng.choice("abc") for _ in range(200)]
    seen = [" ".join(words[i : i + 8]) for i in range(193)]
    covered = {p for i in range(193) if seen.count(seen[i]) > 1 for p in range(i, i + 8)}
    assert quality_rules.clean(frame(spark, [(1, " ".join(words), "a")])).first().n_repeat_words == len(covered)
    assert quality_rules.clean(none).count() == 0 and quality_rules.clean(odd).count() == odd.count()


def test_jaccard_finds_near_copies_of_others_than_the_hub(spark):
    rng = random.Random(11)

    def edited(words, k):
        out = list(words)
        for at in rng.sample(range(0, len(out), 5), k):  # five shingles each, or fewer at the ends
            out[at] = f"{rng.randrange(10**9)}x"
        return out

    docs = []
    for _ in range(40):
        base = prose(rng, 300).split()
        some = [edited(base, 6) for _ in range(4)]
        docs += [base, *some, *(edited(s, 7) for s in some)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == want and len({c for _, c in want.values()}) < 60


def test_decontamination_finds_changed_numbers_and_names(spark, odd, none):
    item = "A train leaves the station at a speed of 60 km per hour while Anna Smith walks 5 km towards it, and later Anna Smith stops after 60 minutes."
    other = "Completely different question about birds that sing in the early morning over green hills by the sea."
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "Only four words here"), (6, "Yes"), (7, "42")], "item_id long, text string")
    renamed = item.replace("walks 5 km", "walks 9 km").replace("60", "75").replace("Anna Smith", "Bob Jones")
    clash = item.replace("60 km", "75 km").replace("Anna Smith walks", "Bob walks")
    rng = random.Random(7)
    pad = lambda t: f"{prose(rng, 40)}. {t} {prose(rng, 40)}"
    docs = frame(spark, [(1, pad(item), "a"), (2, pad(renamed), "a"), (3, pad(clash), "a"), (4, prose(rng, 90), "a"), (5, other.upper(), "a"), (6, None, "a"), (7, pad("only four words here"), "a")])
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs, bench).collect()}
    assert got.pop((7, 5)) is False and got.pop((5, 2), None) in (None, False)
    assert got == {(1, 1): False, (2, 1): True}
    left = {r[0] for r in decontaminate.decontaminate(docs, bench).select("doc_id").collect()}
    assert {3, 4, 6} <= left and not {1, 2, 7} & left
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(odd, bench).count() == odd.count()


def test_decontamination_pairs_values_after_numbers_with_a_suffix(spark):
    item = "a train leaves the station at a speed of 60 km per hour and slows to 5 after the bridge but reaches 60 again before the tunnel ends"
    ordinal = "the 3rd rider passes the old mill before the 3rd runner reaches the gate of the town by the river"
    bench = spark.createDataFrame([(1, item), (2, ordinal)], "item_id long, text string")
    before = ["call 555-7713 now or", "on the 3rd day of a 5-year plan", "write to Anna.Smith@x or Bob at 9 km/h"]
    docs = [(i, f"{b} {item} and so on", "a") for i, b in enumerate(before)]
    docs += [(7, ordinal, "a"), (8, ordinal.replace("3rd", "23rd"), "a"), (9, ordinal.replace("3rd runner", "23rd runner"), "a")]
    got = {(r.doc_id, r.item_id): (r.covered_words == r.item_words, r.reparameterised) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert all(got.get((i, 1)) == (True, False) for i in range(3)), got
    assert got.get((7, 2)) == (True, False) and got.get((8, 2)) == (True, True) and got.get((9, 2)) != (True, False), got


def test_decontamination_of_short_and_repetitive_items(spark):
    rng = random.Random(30)
    numbers = " ".join(str(rng.randrange(1000)) for _ in range(1000))
    chant = " ".join(["row the 5 boats"] * 300)
    bench = spark.createDataFrame([(1, "Yes"), (2, numbers), (3, chant), (4, "7 8"), (5, "one 2 three 4 five")], "item_id long, text string")
    docs = [(i, f"{prose(rng, 9)} yes {prose(rng, 9)}", "a") for i in range(20)] + [(100, "YES!", "a"), (101, " ".join(str(rng.randrange(1000)) for _ in range(2000)), "a"), (102, f"x {numbers} y", "a")]
    docs += [(103, " ".join(["row the 6 boats"] * 900), "a"), (104, "7 8", "a"), (105, f"{prose(rng, 9)} 7 8 {prose(rng, 9)}", "a"), (106, "say one 2 three 4 five now", "a"), (107, "say one 3 three 3 five now", "a")]
    df = frame(spark, docs)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(100, 1), (102, 2), (103, 3), (104, 4), (106, 5)}
    assert got[103, 3].reparameterised and got[103, 3].slots == 1 and got[103, 3].covered_words == 1200 and not got[102, 2].reparameterised
    left = {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()}
    assert left == {d[0] for d in docs} - {100, 102, 103, 104, 106}
    twice = frame(spark, [(1, "YES!", "a"), (1, prose(rng, 30), "a")])
    assert decontaminate.decontaminate(twice, bench).count() == 1


def slow_template(text):
    """(tokens, value of each placeholder by position) of the operator's template, by a loop over the text's pieces."""
    import regex

    m = decontaminate.MARK
    spaced = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text)
    names, digits, units = [], [], []

    def name(x):
        names.append(x[2])
        return x[1] + m + "n"

    def number(x):
        digits.append(x[0])
        return f" {m}d"

    def unit(x):
        units.append(x[1])
        return f"{m}d {m}u"

    t = regex.sub(decontaminate.NAME, name, spaced)
    t = regex.sub(decontaminate.UNIT, unit, regex.sub(decontaminate.NUMBER, number, t))
    tokens = [w for w in "".join(c for c in t.lower() if c not in decontaminate.PUNCTUATION).split(" ") if w]
    queues, values = {"n": names, "d": digits, "u": units}, {}
    for i, w in enumerate(tokens):
        if w[0] == m:
            values[i] = queues[w[1]].pop(0).lower()
    return tokens, values


def test_decontamination_of_long_runs_of_names_and_numbers(spark):
    passage = "the red fox was seen near an old stone bridge"
    names, numbers = " ".join("Ab" + "c" * (i % 5) for i in range(6000)), ".".join(str(i) for i in range(6000))
    df = frame(spark, [(1, f"by {names}, {passage}", "a"), (2, f"from {numbers} on {passage}", "a"), (3, f"by {names} from {numbers}", "a")])
    assert [r[0] for r in df.orderBy("doc_id").select(F.size(decontaminate.template(F.col("text")))).collect()] == [12, 13, 4]
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(df, bench).collect()) == [1, 2]


def slow_contaminated(docs, items, n=8):
    out = {}
    made = {i: slow_template(t) for i, t in items}
    for d, text in docs:
        tokens, values = slow_template(text)
        at = {}
        for p in range(len(tokens) - n + 1):
            at.setdefault(tuple(tokens[p : p + n]), []).append(p)
        for i, (own, own_values) in made.items():
            first, places = {}, {}
            for q in range(len(own) - n + 1):
                w = tuple(own[q : q + n])
                if sum(x[0] != decontaminate.MARK for x in w) >= decontaminate.MIN_ORDINARY:
                    first.setdefault(w, q)
                    places.setdefault(w, []).append(q)
            met, good = {}, set()
            for w, q in first.items():
                for p in at.get(w, ()):
                    if any(k in own_values for k in range(q, q + n)):
                        met.setdefault(p - q, []).append((w, q))
                    else:
                        good.add(w)
            slots, changed = set(), False
            for diagonal, hits in met.items():
                pairs = {(own_values[k], values[k + diagonal]) for _, q in hits for k in range(q, q + n) if k in own_values}
                if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                    good |= {w for w, _ in hits}
                    slots |= {a for a, _ in pairs}
                    changed |= any(a != b for a, b in pairs)
            covered = {k for w in good for q in places[w] for k in range(q, q + n)}
            if len(covered) >= 0.5 * len(own):
                out[d, i] = (len(covered), len(slots), changed)
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(31)
    names, units = ["Anna", "Bob Jones", "Carla", "Dan"], ["km", "kg", "hours", "dollars"]

    def question(k):
        kinds = random.Random(k)
        return [kinds.choice(["word", "word", "word", "number", "name", "unit"]) if j % 3 else "word" for j in range(kinds.randrange(9, 40))], [kinds.choice(VOCAB) for _ in range(40)]

    def fill(k, values, noise=0.0):
        kinds, words = question(k)
        out = []
        for j, kind in enumerate(kinds):
            v = values[j % 5]
            out += {"word": [words[j]], "number": [str(v)], "name": ["so", names[v % 4]], "unit": [str(v), units[v % 4]]}[kind if rng.random() >= noise else "word"]
        return " ".join(out)

    same = [3, 8, 21, 34, 7]
    items = [(k, fill(k, same)) for k in range(25)]
    docs = []
    for d in range(250):
        k, values = rng.randrange(25), list(same)
        style = d % 5
        if style == 1:
            values = rng.sample(range(40, 90), 5)
        elif style == 2:
            values = [rng.choice([50, 51]) for _ in range(5)]
        elif style == 3:
            values[rng.randrange(5)] = rng.choice([3, 99])
        body = fill(k, values, 0.15 if style == 4 else 0.0)
        docs.append((d, f"{prose(rng, rng.randrange(20))} 5 then {body} {prose(rng, rng.randrange(20))}" + (f" and {fill(k, rng.sample(range(40, 90), 5))}" if d % 7 == 0 else "")))
    got = decontaminate.contaminated(frame(spark, [(d, t, "a") for d, t in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = slow_contaminated(docs, items)
    assert {(r.doc_id, r.item_id): (r.covered_words, r.slots, r.reparameterised) for r in got} == want
    assert any(v[2] for v in want.values()) and any(v[1] and not v[2] for v in want.values()) and 50 < len(want) < 250


def test_a_shared_preamble_brings_no_pairs(spark):
    rng = random.Random(12)
    preamble = prose(rng, 22)
    items = [(i, f"{preamble} {prose(rng, 40)}") for i in range(200)] + [(500, preamble), (501, f"{preamble} {prose(rng, 10)}")]
    docs = [(i, f"{preamble} {prose(rng, 60)}") for i in range(300)] + [(900, f"{prose(rng, 5)} {items[7][1]}"), (901, items[8][1].rsplit(" ", 25)[0])]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((d, i, n) for (d, i), (n, *_) in slow_contaminated(docs, items).items())
    got = decontaminate.contaminated(*frames).collect()
    assert sorted((r.doc_id, r.item_id, r.covered_words) for r in got) == expected and {(900, 7), (901, 8), (5, 500), (5, 501)} <= {(r.doc_id, r.item_id) for r in got}
    known = decontaminate._known(frames[1].filter("item_id < 500"), 8, 0.5)
    hits = decontaminate._hits(frames[0].withColumn("th", F.xxhash64("text")), known, 8)
    assert hits.count() < 10_000


def test_language_and_quality_models(spark, odd, none):
    rng = random.Random(8)
    make = {"xx": "ka ro ti mu", "yy": "sch ung ber eit"}
    rows = [(i, " ".join("".join(rng.choice(make[k].split()) for _ in range(3)) for _ in range(40)), k) for i in range(400) for k in [rng.choice(["xx", "yy"])]]
    df = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows], SCHEMA)
    model = language.train(df)
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == k for i, _, k in rows if got[i].held_out]) > 0.99
    assert language.accepted(df, model).count() >= 395 and language.accepted(df, model).columns == df.columns
    strange = {r.doc_id: r for r in language.predict(odd.filter("doc_id < 4"), model).collect()}
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in strange.values())
    assert language.predict(odd, model).count() == odd.count() and language.predict(none, model).count() == 0
    labels = spark.createDataFrame([(i, int(k == "xx"), 0) for i, _, k in rows], "doc_id long, quality int, toxic int")
    quality = quality_model.predict(df, quality_model.train(df, labels)).collect()
    truth = {i: int(k == "xx") for i, _, k in rows}
    assert np.mean([r.predicted == truth[r.doc_id] for r in quality if r.held_out]) > 0.99 and all(0 <= r.score <= 1 for r in quality)
    model = quality_model.train(df, labels)
    for rows in (odd, none):
        got = quality_model.predict(rows, model)
        assert got.count() == rows.count() and {"doc_id", "held_out", "score", "predicted"} <= set(got.columns) and got.filter("NOT score BETWEEN 0 AND 1 OR predicted <> int(score >= 0.3)").count() == 0
    empty = quality_model.predict(df, model).columns
    same = quality_model.predict(frame(spark, [(1, None, "s"), (2, "", "s")]), model).collect()
    assert same[0].score == same[1].score and empty[-1] in ("predicted", "score")


def test_models_without_labels(spark, odd, none):
    rng = random.Random(21)
    df = frame(spark, [(i, prose(rng, 30), "s") for i in range(60)])
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    for docs in (none, bare):
        model = language.train(docs)
        got = language.predict(df, model).collect()
        assert len(got) == 60 and all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, False) for r in got)
        assert language.accepted(df, model).count() == 60 and language.accepted(odd, model).count() == odd.filter(r"text rlike '\\p{L}'").count()
    one = language.predict(df, language.train(df)).collect()
    assert all(r.lang_pred == "en" and r.score == 1 and not r.rejected for r in one)
    few = language.predict(df, language.train(df.limit(4))).collect()
    assert all(r.lang_pred == "en" for r in few)
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 2)) for i in range(60)], "doc_id long, quality int, toxic int")
    for some in (labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))):
        assert {(r.score, r.predicted) for r in quality_model.predict(df, quality_model.train(df, some)).collect()} == {(0.5, 1)}
        got = toxicity.predict(df.unionByName(frame(spark, [(100, prose(rng, 20) + " you are an idiot you moron", "s")])), toxicity.train(df, some)).collect()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.doc_id == 100) for r in got)
    for k in (0, 1):
        only = labels.filter(f"quality = {k}")
        assert {(r.score, r.predicted) for r in quality_model.predict(df, quality_model.train(df, only)).collect()} == {(float(k), k)}
        got = toxicity.predict(df, toxicity.train(df, only)).collect()
        assert len(got) == 60 and all(0 <= r.score <= 1 for r in got)
    assert quality_model.predict(none, quality_model.train(none, labels)).count() == 0 and toxicity.predict(none, toxicity.train(none, labels)).count() == 0


def test_sample_is_bounded(spark):
    rng = random.Random(22)
    rows = [(7, f"text number {i}", "a") for i in range(20_000)] + [(8, "the same text", "a")] * 5_000 + [(100 + i, prose(rng, 20), "ab"[i % 2]) for i in range(4000)] + [(9_000, "long " * 200_000, "b"), (9_001, None, "b"), (None, "no id", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    texts, labels, weights = sample.bounded(df, None, 300)
    assert (labels.count("a"), labels.count("b")) == (300, 300) and max(map(len, texts)) < 1000
    assert (texts, labels, weights) == sample.bounded(df.repartition(7), None, 300)
    texts, labels, weights = sample.bounded(df, None, 10_000)
    assert 1990 <= len([t for t, y in zip(texts, labels, strict=True) if y == "a"]) <= 2002 and texts.count("the same text") == 1 and len([t for t in texts if t.startswith("text number")]) == 1
    texts, labels, _ = sample.bounded(df, None, 10_000, most_chars=20_000)
    assert sum(map(len, texts)) <= 20_000 + 2 * 1000
    assert len(set(sample.bounded(df, None, 10, most_classes=1)[1])) == 1
    apart = sample.bounded(df.drop("label").filter("doc_id < 5000"), df.select("doc_id", "label").filter("doc_id < 5000").distinct(), 300)
    assert apart == sample.bounded(df.filter("doc_id < 5000"), None, 300)


def slow_probabilities(model, text):
    """The model's scores by loops over characters."""
    f, low = model.features, 0xFFFFFFFF
    text = (text or "").replace("\0", " ")
    text = text.lower() if f.lower else text

    def bucket(h):
        h ^= h >> 15
        h = h * 0x2C1B3C6D & low
        h ^= h >> 12
        return (h * 0x297A2D39 & low) >> (32 - f.bits)

    seen = {}
    for n in f.orders:
        for i in range(len(text) - n + 1):
            h = 0x9E3779B1 * n & low
            for c in text[i : i + n]:
                h = (h * 0x01000193 + ord(c)) & low
            b = bucket(h)
            seen[b] = seen.get(b, 0) + 1
    if f.words:
        before = None
        for w in "".join(c if ord(c) > 32 and ord(c) != 0xA0 else " " for c in text).split(" "):
            if w:
                h = sum((ord(c) + 0x9E37) * pow(0x01000193, i % 64 + 1, 1 << 32) for i, c in enumerate(w)) & low
                for b in [bucket(h), *([1] if h == before else [])]:
                    seen[b] = seen.get(b, 0) + 1
                before = h
    mean = sum(k * model.table[b] for b, k in seen.items()) / max(sum(seen.values()), 1) + model.bias
    e = np.exp(mean / model.temperature)
    return e / e.sum()


def test_embedding_scores_equal_loops():
    rng = random.Random(23)
    texts = ["", None, "a", "a a a b b", "Ünïcode tëxt 日本 🙂 mixed", "x" * 70 + " " + "x" * 70, "nul\0 nul\xa0nul", *["".join(rng.choice("abc ABÇ.1\n\t") for _ in range(rng.randrange(300))) for _ in range(60)]]
    for features in (language.FEATURES, quality_model.FEATURES, embed.Features(bits=9, orders=(1, 3), words=True, lower=True)):
        model = embed.train(texts * 3, [i % 3 for i in range(3 * len(texts))], features, epochs=2)
        fast = model.probabilities(texts)
        assert np.allclose(fast, [slow_probabilities(model, t) for t in texts], atol=1e-9)


def slow_description(text, learned, stems):
    """The features of toxicity by loops over words and characters."""
    words, out = (text or "").split(), dict.fromkeys(toxicity.NAMES, 0.0)
    if not words:
        return list(out.values())
    bare = [w.lower().strip(toxicity.EDGE) for w in words]
    hits = [i for i, w in enumerate(bare) if w in toxicity.LEXICON]
    own = [w for w in bare if w in learned]
    second = [i for i, w in enumerate(bare) if w in toxicity.SECOND_PERSON]
    stem_counts = [0] * len(stems)
    for k, s in enumerate(stems):
        i = 0
        while i <= len(text.lower()) - len(s):
            step = text.lower()[i : i + len(s)] == s
            stem_counts[k] += step
            i += len(s) if step else 1
    hidden = [w for w in words if any(len(w) - i > 2 for i in range(len(w))) and any(
        w[i].isascii() and w[i].isalpha() and w[j].isascii() and w[j].isalpha() and j > i + 1 and all(c in "@$!*+|0134579" for c in w[i + 1 : j]) for i in range(len(w)) for j in range(i + 2, len(w)))]
    uncovered = sum(1 for w in hidden if w.lower().strip(toxicity.EDGE).translate(toxicity.LEET).replace("*", "") in toxicity.LEXICON | learned)
    doubled = stretched = run = 0
    for i, c in enumerate(text):
        doubled += c in "!?" and text[i + 1 : i + 2] in ("!", "?") and (i == 0 or text[i - 1] not in "!?")
        run = run + 1 if i and c == text[i - 1] and c.isalpha() else 1
        stretched += run == 4 and c.isalpha()
    letters = [c for c in text if c.isalpha()]
    n = len(words)
    out |= {
        "lexicon_rate": 100 * len(hits) / n, "lexicon_log": np.log1p(len(hits)), "lexicon_kinds": len({bare[i] for i in hits}),
        "learned_rate": 100 * len(own) / n, "learned_log": np.log1p(len(own)), "learned_kinds": len(set(own)),
        "second_person_rate": 100 * len(second) / n, "near_rate": 100 * sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hits) / n,
        "stem_rate": 100 * sum(stem_counts) / n, "stem_log": np.log1p(sum(stem_counts)), "stem_kinds": sum(k > 0 for k in stem_counts),
        "capital_share": sum(c.isupper() for c in text) / max(len(letters), 1), "shouted_share": sum(len(w) > 2 and w.isupper() for w in words) / n,
        "mark_rate": 100 * sum(c in "!?" for c in text) / n, "doubled_rate": 100 * doubled / n, "hidden_rate": 100 * len(hidden) / n,
        "hidden_lexicon_log": np.log1p(uncovered), "stretched_rate": 100 * stretched / n, "log_words": np.log(n),
    }
    return [float(out[k]) for k in toxicity.NAMES]


def test_toxicity_features_equal_loops():
    rng = random.Random(24)
    words = ["you", "YOU", "idiot", "Idiot!", "1d10t", "st*pid", "st@pid!", "sooooo", "aaaa", "hill", "green", "moron,", "(scum)", "u", "???", "!!", "!?!", "a1b", "dich", "é", "ßßßß", "x1111y", "$$", "ha!ha"]
    texts = [None, "", " \n", *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(200)]]
    for t in texts:
        assert np.allclose(toxicity.describe(t, frozenset({"hill"}), ("gree", "iot")), slow_description(t, frozenset({"hill"}), ("gree", "iot")), atol=1e-9), t


def test_embedding_scores_do_not_depend_on_the_batch():
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (1, 5, 200)] + ["", None, "a a a", "x" * 3]
    model = embed.train(texts * 10, [0, 1, 0, 1, 0, 1, 1] * 10, embed.Features(bits=8, words=True))
    alone = np.concatenate([model.probabilities([t]) for t in texts])
    assert np.allclose(alone, model.probabilities(texts), atol=1e-12)


def test_toxicity(spark, odd, none):
    rng = random.Random(10)
    rows = [(i, prose(rng, 80) + (" you are an idiot, stupid moron " + prose(rng, 9) if i % 4 == 0 else "")) for i in range(400)]
    df = frame(spark, [(i, t, "s") for i, t in rows])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = toxicity.predict(df, model).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in got if r.held_out]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.predict(odd, model).count() == odd.count() and toxicity.predict(none, model).count() == 0
    bare = toxicity.predict(df, toxicity.train(df, labels.limit(0)))
    assert {r.doc_id for r in bare.collect() if r.predicted} == {i for i, _ in rows if i % 4 == 0}
    assert toxicity.describe("YOU 1d10t!!", frozenset())[toxicity.NAMES.index("hidden_lexicon_log")] > 0


def test_scores_do_not_depend_on_the_size_of_the_sample(spark):
    rng = random.Random(14)
    rows = []
    for i in range(2700):
        bad = i % 9 == 0
        rows.append((i, prose(rng, 30) + (" you stupid idiot" if rng.random() < (0.7 if bad else 0.15) else " green hills") + " " + prose(rng, 5)))
    df = frame(spark, [(i, t, "s") for i, t in rows])
    labels = spark.createDataFrame([(i, int(i % 9 == 0), int(i % 9 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    for model in (quality_model, toxicity):
        means, flagged = [], []
        for per_label in (3000, 200):
            got = model.predict(df, model.train(df, labels, per_label)).collect()
            means.append(np.mean([r.score for r in got]))
            flagged.append(np.mean([r.score >= 0.5 for r in got]))
        assert abs(means[0] - means[1]) < 0.06 and abs(flagged[0] - flagged[1]) < 0.08, (model.__name__, means, flagged)
        assert all(abs(m - 1 / 9) < 0.06 for m in means), (model.__name__, means)


def brute_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets(spark, odd, none):
    rng = random.Random(11)
    token = "q7Zp9LxT2vRk8YwB4nHs6DcJ"
    texts = ["é password: hunter2hunter2 x", 'Api_Key="short" TOKEN = abcdefgh', f"see {token} there", "AKIA" + "A1" * 8 + " AKIA1", "0" * 31 + " " + "ab" * 20, "123e4567-e89b-12d3-a456-426614174000 2024-01-02T10-20-30 some_long_identifier_name_v2", None, "secret==deadbeefdeadbeef" + "f" * 40]
    alphabet = 'passwdtokenecrt:= "\'AKIA09abcdef' + "xſK"
    texts += ["".join(rng.choice(alphabet) for _ in range(300)) for _ in range(60)]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), RANKS).collect()}
    assert all(got[i].base_spans == brute_secrets(t) for i, t in enumerate(texts))
    assert got[2].spans == f"dense:4:{4 + len(token)}" and got[2].n_dense == 1 and got[5].spans == ""
    assert secrets.redact(texts[2], got[2].spans) == "see [SECRET] there"
    encoding = secrets.vocabulary(RANKS)
    dense = lambda t: [(a, b) for a, _, b in secrets.dense_spans(t, [], encoding)]
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(28)) for _ in range(200)]
    grouped = ["-".join("".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(5)) for _ in range(4)) for _ in range(200)]
    mixed = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24)) for _ in range(200)]
    assert sum(dense(f"key {t} end") == [(4, 4 + len(t))] for t in letters) > 170 and sum(dense(t) == [(0, len(t))] for t in grouped) > 190 and sum(dense(t) == [(0, len(t))] for t in mixed) > 190
    plain = "getUserAccountByIdentifier some_long_identifier_name_v2 XMLHttpRequestFactoryBean kubernetes-deployment-config THIS_IS_A_CONSTANT_NAME Donaudampfschifffahrtsgesellschaft /usr/local/share/applications ===================== 0123456789012345678901"
    assert dense(plain) == [] and dense("sha1 " + hashlib.sha1(b"x").hexdigest().upper()) == []
    # Every dense span by the same rules applied to each unbroken string in turn.
    for t in texts[2:]:
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t or ""):
            w, base = m[0], [(int(a), int(b)) for _, a, b in (x.split(":") for x in brute_secrets(t).split(",") if x)]
            hits = any(a < m.end() and m.start() < b for a, b in base)
            strict = not re.search("[0-9]", w) or secrets._IDENTIFIER.fullmatch(w)
            if re.search("[A-Za-z]", w) and not secrets._KNOWN.fullmatch(w) and not hits and len(w) / len(encoding.encode_ordinary(w)) < (1.6 if strict else 2.2):
                want.append(f"dense:{m.start()}:{m.end()}")
        assert [x for x in got[texts.index(t)].spans.split(",") if x.startswith("dense")] == want
    assert secrets.scan(odd, RANKS).count() == odd.count() and secrets.scan(none, RANKS).count() == 0


def test_licenses(spark, odd, none):
    mit = "The MIT Licence\n\nCopyright (c) 2020 Someone\n\n" + licenses.TEXTS["MIT"].replace(", ", " , ").lower()
    docs = frame(spark, [(1, mit, "a"), (2, "Text first.\nlicensed under the APACHE licence version 2.0\nMore text.", "a"), (3, "no such thing", "a"), (4, None, "a"), (5, "(c) 2020 Me\n", "a")])
    got = {(r.doc_id, r.unit, r.nth, r.license) for r in licenses.scan(docs).collect()}
    assert (1, "text", 0, "MIT") in got and (2, "line", 1, "Apache-2.0") in got and {g[0] for g in got} == {1, 2}
    rng = random.Random(50)
    changed = []
    for spdx, text in licenses.whole_texts():
        words = text.replace("license", "licence").replace("\n", " \n ").split(" ")
        lines = "".join(w.swapcase() + rng.choice([" ", " ", " ", "\n", "  "]) if w != "\n" else "\n\n" for w in words)
        changed.append((spdx, f"{licenses.NAMES[spdx][0].upper()}\n\nCopyright (c) 1999-{rng.randrange(2000, 2030)}, A. Holder <a@b.c>\nAll rights reserved.\n\n{lines}"))
    rows = [(i, t, "a") for i, (_, t) in enumerate(changed)]
    rows += [(1000 + i, f"Some prose before.\n\n{text}\n\nAnd after it.", "a") for i, text in enumerate(licenses.TEXTS.values())]
    got = {}
    for r in licenses.scan(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.unit, r.license))
    assert [] == [(spdx, t) for i, (spdx, t) in enumerate(changed) if ("text", spdx) not in got.get(i, ())]
    inside = {spdx: {x for _, x in got.get(1000 + i, ())} for i, spdx in enumerate(licenses.TEXTS)}
    assert inside["BSD-3-Clause"] == {"BSD-3-Clause"} and inside["BSL-1.0"] == {"BSL-1.0"} and inside["Unlicense"] == {"Unlicense"} and inside["MIT"] == {"MIT"}
    assert licenses.canonical("copyright notice, this list") and not licenses.canonical("  Copyright 2020 Me") and not licenses.canonical("(c) 2021 me")
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_entire_long_licenses(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    rows = []
    for i, (spdx, name) in enumerate(names.items()):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            text = f.read()
        prose_only = "\n".join(line for line in text.split("\n") if not re.search(licenses.COPYRIGHT, line.lower(), re.A))
        rows += [(10 * i, text), (10 * i + 1, text.upper().replace("\n", "\r\n")), (10 * i + 2, "Copyright 2031 Someone Else\n" + prose_only), (10 * i + 3, text.replace("shall", "may", 1).replace("you", "we", 1))]
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("unit = 'text'").collect()}
    assert found == {(10 * i + k, spdx) for i, spdx in enumerate(names) for k in (0, 1, 2)}


def test_huffman_codes_are_canonical_and_limited():
    rng = np.random.default_rng(12)
    for counts in (np.array([0, 5, 0]), np.array([3, 1]), rng.integers(0, 1000, 300), np.array([1 << min(k, 60) for k in range(40)]), np.ones(1 << 12, np.int64), rng.integers(1, 9, 70_000)):
        lengths = token_file.code_lengths(counts)
        used = counts > 0
        assert (lengths[used] > 0).all() and (lengths[~used] == 0).all() and lengths.max() <= token_file.bit_limit(counts)
        assert sum(2.0 ** -float(x) for x in lengths[used]) <= 1 + 1e-12
        words = token_file.codes(lengths)
        text = {format(int(w), f"0{n}b") for w, n in zip(words[used], lengths[used], strict=True)}
        assert len(text) == used.sum() and not any(a != b and b.startswith(a) for a in list(text)[:50] for b in text)
    fib = [1, 1]
    while len(fib) < 15:
        fib.append(fib[-1] + fib[-2])
    import heapq

    heap, cost = list(fib), 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (token_file.code_lengths(np.array(fib)) * np.array(fib)).sum() == cost


def test_token_file_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    rng = random.Random(13)
    texts = ["hello  world \n\n x", None, "", " lead", "trail ", "a b c", "日本 語 text", "it's we'll  'd", prose(rng, 40_000), "tab\t tab \tx", "<|endoftext|> a <|endoftext|>"]
    texts += ["".join(rng.choice("ab 1.'\n\t　é") for _ in range(80)) for _ in range(80)]
    texts += ["".join(rng.choice([*"abé1 .,!?-'\"%*&$#|<>()\n", "…", "👩‍🚀", "🙂", "e\u0301", "n\u0303", "\u200d", "ﬁ", "'ll ", " '", "Ġ", "ß", "\xa0"]) for _ in range(3000)) for _ in range(12)]
    df = frame(spark, [(i * 3 - 5, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in token_file.round_trip(df.repartition(5), BPE).collect()}
    slow, at = Tokenizer.from_file(BPE), 0
    for i, t in enumerate(texts):
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 0]
        r = got[i * 3 - 5]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    ours = token_file.Ids(BPE)
    for _ in range(3):
        rng.shuffle(texts)
        assert ours(texts) == [np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u2").tobytes() for t in texts]
    assert token_file.round_trip(none, BPE).count() == 0 and token_file.round_trip(odd, BPE).count() == odd.count()


def test_pieces_are_looked_up_once_and_older_ones_go(monkeypatch):
    monkeypatch.setattr(token_file, "REMEMBERED", 20)
    assert set(token_file._OTHER_SPACES) == {c for c in map(chr, range(0x110000)) if c.isspace()} - {" ", "\n"}
    ours, plain = token_file.Ids(BPE), token_file.tokenizer(BPE)
    texts = [None, "", "One two, two. Three", "x" * 60 + " " + "x" * 60, *(f"w{n % 30} and w{n % 7}\nagain, {n}." for n in range(80))]
    for low in range(0, len(texts), 10):
        part = texts[low : low + 10]
        ids = [plain.encode(t or "", add_special_tokens=False).ids + [0] for t in part]
        assert [np.frombuffer(b, ours.kind).tolist() for b in ours(part)] == ids
    assert not ours.known.new and ours.known.older and not ours.known.older.older and None not in ours.known.values()
