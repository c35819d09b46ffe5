"""Similarity self-join of documents on word-shingle sets, by PartEnum signatures.

Two sets link when their Jaccard similarity is at least 3/4, so with sizes a and b they differ
in at most k = (a + b) / 7 features. Sets are put in bands of equal size (a factor of two); a set
near its band's top also enters the next, so two that link share a band. In a band the feature
domain is cut into first-level parts, the same for all, and each of these into PIECES pieces. Of
any parts at most k / 2 hold two differences or more; in any other, all differences lie in one
piece, so the two sets agree on one of the part's subsets that leave a piece out. A signature is
such a subset with the set's features in it, unless it has none; all subsets are enumerated. A part in which a set has
features in one piece only promises nothing, so each set takes the first parts of which enough
promise: then it shares at least c signatures with every set that links with it. Small sets,
and sets that would need more parts than there are, use parts of about one feature instead, the
first d + c that they occupy, of which any linked pair has c in common.

What keeps the join linear: equal sets are one class; a set needs c shared signatures to stay;
features that only one of the remaining sets has are counted, and as they lie in its difference
with any other, a set with many of them goes too; a signature's sets are first compared with one
of them only, and sets already in a component are not compared again: a signature's largest
component is met by the others only. Only what is still apart, and could link by those counts
and by a sketch that bounds the difference from below, is paired, by at least c shared signatures.
Signatures that very many sets have are found on a sample and dealt to many tasks; what else is
known by signature comes from aggregates that combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import Scratch, discard, hand_over, in_batches, materialise, stored

SHINGLE = 5
#: Texts are hashed about so many bytes at a time; a longer text is hashed alone.
PIECE = 1 << 18
#: Ids of the documents to verify are broadcast up to this many (16 MB), else shuffled.
BROADCAST_IDS = 1_000_000
#: Bands whose top is at most SMALL have parts of about one feature and c = 1; in others a set at the top has FILL features a part, in PIECES pieces, and c is this share of the top.
SMALL, FILL, PIECES, SHARED = 64, 5.8, 2, 0.006
#: A signature is hot if this share of a sample (a text in SAMPLED, by hash) has it, and so many sets at least; hot ones are dealt to SALTS tasks.
HOT_SHARE, HOT_LEAST, SAMPLED, SALTS = 1 / 1000, 16, 64, 64
#: Rounds of comparing a signature's sets with one of them.
HUBS = 1
#: Words of 64 bits of a sketch.
SKETCH = 32
#: Rows of a signature for which the last pairing takes a task of its own.
GROUP = 4096

_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TRUE = np.array([True])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _K2
    x = (x ^ (x >> _U(27))) * _K3
    return x ^ (x >> _U(31))


def _hash_run(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a run."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(texts)
    chars = np.flatnonzero(inside)
    first = np.searchsorted(chars, starts)
    length = np.diff(np.append(first, len(chars)))
    power = np.cumprod(np.full(int(length.max()), 0x100000001B3, np.uint64))
    word = np.add.reduceat(_BYTE[data[chars]] * power[np.arange(len(chars)) - np.repeat(first, length)], first)
    word = _mix(word + length.astype(np.uint64) * _K1)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, begins)
    out = []
    n = len(word) - SHINGLE + 1
    gram = word[:n].copy() if n > 0 else np.empty(0, np.uint64)
    for k in range(1, SHINGLE) if n > 0 else ():
        gram = gram * _K1 + word[k : k + n]
    gram = _mix(gram)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(gram[a : b - SHINGLE + 1]))
        elif b > a:
            short = _U(b - a)
            for w in word[a:b]:
                short = _mix(short * _K1 + w)
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The set of 64-bit shingle hashes, sorted, of each text; a short text is one shingle, none is none."""
    with np.errstate(over="ignore"):
        run: list[bytes] = []
        size = 0
        for t in texts:
            run.append((t or "").encode("utf-8", "surrogatepass"))
            size += len(run[-1])
            if size >= PIECE:
                yield from _hash_run(run)
                run, size = [], 0
        if run:
            yield from _hash_run(run)


def required(top: int) -> int:
    """c: the signatures that two linked sets of a band share at least."""
    return 1 if top <= SMALL else max(1, int(SHARED * top))


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit id of a set, equal for equal sets; 0 for the empty one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        return int(_mix(np.array([np.add.reduce(_mix(s ^ _K1)) + _U(len(s)) * _K2]))[0].astype(np.int64))


def _enumerated(s: np.ndarray, high: np.ndarray, parts: int, need: int) -> tuple[np.ndarray, bool]:
    """(a number for each subset of pieces, whether ``need`` parts promise) over the first parts that do."""
    cell = (high * _U(parts * PIECES) >> _U(32)).view(np.int64)
    first = np.flatnonzero(np.concatenate([_TRUE, cell[1:] != cell[:-1]]))
    at = cell[first]
    full = np.zeros(parts * PIECES, bool)
    full[at] = True
    full = full.reshape(parts, PIECES)
    kinds = full.sum(1)
    promise = np.cumsum(kinds >= 2)
    enough = bool(promise[-1] >= need)
    take = int(np.searchsorted(promise, need)) + 1 if enough else parts
    sums = np.zeros(parts * PIECES, np.uint64)
    sums[at] = np.add.reduceat(s, first)
    sums = sums.reshape(parts, PIECES)[:take]
    rest = sums.sum(1, keepdims=True, dtype=np.uint64) - sums
    rest += np.arange(1, take + 1, dtype=np.uint64)[:, None] * _K1
    full, kinds = full[:take], kinds[:take]
    some = kinds[:, None] > full
    one = np.flatnonzero(kinds == 1)  # two of its subsets are the same
    some[one] = False
    some[one, full[one, 0].astype(np.int64)] = True
    return rest[some], enough


def signatures(s: np.ndarray) -> np.ndarray:
    """Signatures as signed 64-bit, their five low bits the band.

    Sets of parts of about one feature come in levels: where d + c parts are not occupied, a set
    adds those of ever finer parts until they are, and any two sets share the coarser of their
    finest levels. Level 0 is that of the two-level parts, for bands that have them.
    """
    n = len(s)
    if not n:
        return np.empty(0, np.int64)
    band = n.bit_length() - 1
    out = []
    top = 2 << band
    most = 4 * n // 3
    plan = [(band, (n + min(most, top - 1)) // 7)]
    if most >= top:
        plan.append((band + 1, (n + most) // 7))
    high = s >> _U(32)
    with np.errstate(over="ignore"):
        for k, d in plan:
            top = 2 << k
            c = required(top)
            if top > SMALL:
                found, enough = _enumerated(s, high, int(top / FILL) + 2, d // 2 + c)
                out.append(_marked(found, k, 0))
                if enough:
                    continue
            parts, level = 64 * top, 1
            while True:
                part = high * _U(parts) >> _U(32) if parts < 1 << 31 else s
                group = np.flatnonzero(np.concatenate([_TRUE, part[1:] != part[:-1]]))
                sums = np.add.reduceat(s, group)[: d + c]
                out.append(_marked(sums + part[group[: len(sums)]] * _K1, k, level))
                if len(group) >= d + c or part is s:
                    break
                parts, level = parts * 8, level + 1
    return np.concatenate(out)


def _marked(x: np.ndarray, band: int, level: int) -> np.ndarray:
    return ((_mix(x + _U(1 + 32 * level + band) * _K3) & ~_U(31)) | _U(band)).view(np.int64)


# ---- on Spark


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), fingerprint(s)) for s in shingle_sets(batch.column("text").to_pylist())]
            made = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x, pa.int64()) for x in made)], names=["doc_id", "text_hash", "n", "fp"])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("text_hash", "n", "fp"))])
    return in_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")).mapInArrow(run, schema)


def _signed(docs: DataFrame) -> DataFrame:
    """(sig, fp): a row for each signature; a task emits a set once, however many copies it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fps, sigs = [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                fp = fingerprint(s)
                if len(s) and fp not in seen:
                    seen.add(fp)
                    fps.append(fp)
                    sigs.append(signatures(s))
            ends = np.cumsum([0, *map(len, sigs)])
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), lists], names=["fp", "sigs"])

    return in_batches(docs.select("text")).mapInArrow(run, "fp long, sigs array<long>").select(F.explode("sigs").alias("sig"), "fp")


def _hot(docs: DataFrame) -> DataFrame:
    """(sig): signatures that at least HOT_SHARE of the sampled sets have, so at most 1 / HOT_SHARE times the signatures of a set."""
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    least = max(HOT_LEAST, int(HOT_SHARE * some.count()))
    return _signed(some).distinct().groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least).select("sig")


def _first_shared(docs: DataFrame, hot: DataFrame) -> DataFrame:
    """(sig, fp) of signatures that more than one set has. Those of ``hot`` (written out) are known to be, and are dealt by set."""
    rows = _signed(docs).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sig", "left")
    rows = rows.withColumn("place", F.when(F.col("hot"), F.xxhash64("sig", F.pmod("fp", F.lit(SALTS)))).otherwise(F.col("sig")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, fp, known = _columns(batches, "sig", "fp", "hot")
        order = np.lexsort((fp, sig))
        sig, fp, known = sig[order], fp[order], known[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])
        sig, fp, known = sig[new], fp[new], known[new]
        met = np.zeros(len(sig), bool)  # whether a neighbour in order has the same signature
        met[1:] = sig[1:] == sig[:-1]
        met[:-1] |= met[1:]
        yield from _rows(sig, fp, np.flatnonzero(met | (known == 1)))

    dealt = rows.repartition("place").select("sig", "fp", F.coalesce(F.col("hot").cast("long"), F.lit(0)).alias("hot"))
    return dealt.mapInArrow(run, "sig long, fp long")


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    """A task's columns of whole numbers: three of a row take 24 bytes, so 100 MB hold what a task of four million rows has."""
    got = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches]
    return [np.concatenate([g[i] for g in got] or [np.empty(0, np.int64)]) for i in range(len(names))]


def _rows(sig: np.ndarray, fp: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(at), 100_000):
        part = at[low : low + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(sig[part]), pa.array(fp[part])], names=["sig", "fp"])


def _need(band):
    """The shared signatures that two linked sets have at least in a band."""
    return F.array(*[F.lit(required(2 << k)) for k in range(32)])[band.cast("int")]


def _enough(rows: DataFrame) -> DataFrame:
    """Rows of sets with as many shared signatures in the band as any set that links needs."""
    need = np.array([required(2 << k) for k in range(32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, fp = _columns(batches, "sig", "fp")
        band = sig & 31
        order = np.lexsort((band, fp))
        sig, fp, band = sig[order], fp[order], band[order]
        first = np.ones(len(sig), bool)
        first[1:] = (fp[1:] != fp[:-1]) | (band[1:] != band[:-1])
        start = np.flatnonzero(first)
        count = np.diff(np.append(start, len(sig)))
        yield from _rows(sig, fp, np.flatnonzero(np.repeat(count >= need[band[start]], count)))

    return rows.repartition("fp").mapInArrow(run, "sig long, fp long")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every end of ``edges`` (a, b): label is the smallest vertex that it reaches.

    Each round a vertex takes the smallest label of its neighbours, then that label's label,
    so chains shorten by half. Rounds are written to the shared folder.
    """
    spark = edges.sparkSession
    both, both_path = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels, path = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "v"))
    while True:
        heard = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, F.col("v") == F.col("a")).select("v", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        fresh, fresh_path = stored(nearer.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        done = fresh.filter("label <> old").isEmpty()
        discard(spark, path)
        labels, path = fresh.select("v", "label"), fresh_path
        if done:
            discard(spark, both_path)
            hand_over(spark, path)
            return labels


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(fp, text) of one row of each class of ``ids`` (fp, doc_id, text_hash)."""
    rows, of = docs.select("doc_id", "text"), _small(ids.withColumnRenamed("doc_id", "id"))
    found = rows.join(of, (F.xxhash64(rows["text"]) == of["text_hash"]) & rows["doc_id"].eqNullSafe(of["id"]))
    return found.select("fp", "text").dropDuplicates(["fp"])


def _own_features(texts: DataFrame) -> DataFrame:
    """(fp, own): how many features of a class no other class of ``texts`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = list(shingle_sets(part.column("text").to_pylist()))
                features = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
                fps = np.repeat(part.column("fp").to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(features), pa.array(fps)], names=["feature", "fp"])

    rows = texts.mapInArrow(run, "feature long, fp long")
    alone = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.min("fp").alias("fp")).filter("k = 1")
    return alone.groupBy("fp").agg(F.count(F.lit(1)).alias("own"))


def _sketches(texts: DataFrame) -> DataFrame:
    """(fp, x0..): for each class a bit for each of 64 * SKETCH parts of the feature domain, whether it has an odd number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.bincount(((s >> _U(7)) % _U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1).view(np.int64) for s in shingle_sets(batch.column("text").to_pylist())]
            columns = np.array(bits, np.int64).reshape(-1, SKETCH).T
            yield pa.RecordBatch.from_arrays([batch.column("fp"), *map(pa.array, columns)], names=["fp", *(f"x{i}" for i in range(SKETCH))])

    return texts.mapInArrow(run, "fp long, " + ", ".join(f"x{i} long" for i in range(SKETCH)))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose texts' sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                left, right = shingle_sets(part.column("ta").to_pylist()), shingle_sets(part.column("tb").to_pylist())
                for a, b, x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= 75 * (len(x) + len(y) - both):
                        out.append((a, b))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    with_b = pairs.join(texts.withColumnsRenamed({"fp": "b", "text": "tb"}), "b")
    return with_b.join(texts.withColumnsRenamed({"fp": "a", "text": "ta"}), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


#: What two sets of sizes n and m, with p and q features of their own, must satisfy to link: their
#: difference holds p + q features at least, their intersection n - p and m - q at most.
_MAY_LINK = "4 * {n} >= 3 * {m} AND 4 * {m} >= 3 * {n} AND 7 * ({p} + {q}) <= {n} + {m} AND 7 * ({n} - {p}) >= 3 * ({n} + {m}) AND 7 * ({m} - {q}) >= 3 * ({n} + {m})"


def _labelled(shared: DataFrame, labels: DataFrame, tables: Scratch) -> DataFrame:
    """``shared`` (sig, fp, n, own) with each set's component, without rows that cannot link beyond it.

    A signature that one component has alone goes, and so do sets too poor in shared features
    to link even with the signature's smallest set.
    """
    rows = tables.store(shared.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    of = rows.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).filter("low <> high")
    rows = tables.store(rows.join(of, "sig").filter("7 * (n - own) >= 3 * (n + least)").drop("low", "high", "least"))
    more = rows.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sig")
    return tables.store(rows.join(more, "sig", "left_semi"))


def _apart(rows: DataFrame, texts: DataFrame, tables: Scratch) -> DataFrame:
    """(a, b): pairs of sets of different components that share enough signatures of a band and may link by sizes, own features and sketches.

    A signature's largest component is met by its other rows only: of two components at least one
    is not the largest. These rows of a signature are dealt to a task for each GROUP of its rows,
    and there meet, in order of size, the rows within 3/4 of theirs.
    """
    sized = rows.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("sig").agg(F.max(F.struct("k", "label"))["label"].alias("major"), F.sum("k").alias("rows"))
    rows = rows.join(sized, "sig").withColumn("minor", (F.col("label") != F.col("major")).cast("long"))
    rows = rows.join(tables.store(_sketches(texts.join(rows.select("fp").distinct(), "fp", "left_semi"))), "fp")
    parts = F.ceil(F.col("rows") / GROUP)
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
    words = [f"x{i}" for i in range(SKETCH)]
    names = ["sig", "fp", "label", "n", "own", "minor", "part", "asks", *words]
    there = rows.select("*", every).withColumn("asks", F.when(F.pmod("fp", parts) == F.col("part"), F.col("minor")).otherwise(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, fp, label, n, own, minor, part, asks, *sketch = _columns(batches, *names)
        order = np.lexsort((n, part, sig))
        sig, fp, label, n, own, minor, part, asks = (x[order] for x in (sig, fp, label, n, own, minor, part, asks))
        sketch = np.stack([x[order] for x in sketch], 1)
        group = np.cumsum(np.concatenate([[0], (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])])[: len(sig)]) if len(sig) else np.zeros(0, np.int64)
        key = (group << 32) | n  # ascending, as texts have under 2^32 shingles
        who = np.flatnonzero(asks)
        low = np.searchsorted(key, (group[who] << 32) | -(-3 * n[who] // 4))
        high = np.searchsorted(key, (group[who] << 32) | (4 * n[who] // 3), "right")
        for at in _by_total(high - low, 1 << 20):
            size = (high - low)[at]
            i = np.repeat(who[at], size)
            j = np.repeat(low[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            both, alone = n[i] + n[j], own[i] + own[j]
            fit = (label[i] != label[j]) & ((minor[j] == 0) | (fp[i] < fp[j])) & (7 * alone <= both) & (7 * (n[i] - own[i]) >= 3 * both) & (7 * (n[j] - own[j]) >= 3 * both)
            i, j, both = i[fit], j[fit], both[fit]
            # two sets differ in a feature at least wherever one has an odd number of a part's features and the other an even one
            odd = (sketch[i] ^ sketch[j]).view(np.uint64)  # of a signed word numpy counts the bits of the absolute value
            near = 7 * np.bitwise_count(odd).sum(1, dtype=np.int64) <= both
            i, j = i[near], j[near]
            columns = [np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j]), sig[i] & 31]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["a", "b", "band"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: what a pairing costs is not in the size of its input
    pairs = there.select(*names).repartition(tasks, "sig", "part").mapInArrow(run, "a long, b long, band long")
    return pairs.groupBy("a", "b", "band").count().filter(F.col("count") >= _need(F.col("band"))).select("a", "b").distinct()


def _by_total(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``sizes`` that add up to about ``most`` each."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield slice(low, high)
        low = high


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (a, b) between classes of equal sets, enough to connect all that link. ``sets`` is from _sets(), written out."""
    classes = (
        sets.filter("n > 0").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("m"), F.max("n").alias("n"))
        .select("fp", "n", "m.doc_id", "m.text_hash")
    )
    with Scratch(docs.sparkSession) as tables:
        shared = tables.store(_enough(tables.store(_first_shared(docs, tables.store(_hot(docs))))))
        ids = tables.store(classes.join(shared.select("fp").distinct(), "fp", "left_semi"))
        texts = tables.store(_texts(docs, ids.drop("n")))
        sized = ids.join(_own_features(texts), "fp", "left").select("fp", "n", F.coalesce("own", F.lit(0)).alias("own")).filter("4 * own <= n")
        shared = tables.store(shared.join(sized, "fp"))
        labels, edges, tried = None, None, None
        for turn in range(HUBS):
            rows = shared.withColumn("label", F.col("fp")) if labels is None else _labelled(shared, labels, tables)
            # A signature's hub is the set with the fewest features of its own, the next turn one of a random component.
            rank = F.col("own") / F.col("n") if turn == 0 else F.xxhash64("label", F.lit(turn)).cast("double")
            hub = rows.groupBy("sig").agg(F.min(F.struct(rank.alias("rank"), "fp", "label", "n", "own")).alias("hub"))
            near = rows.join(hub, "sig").filter("label <> hub.label AND " + _MAY_LINK.format(n="n", m="hub.n", p="own", q="hub.own"))
            best = near.groupBy("fp", F.col("hub.fp").alias("other")).count().groupBy("fp").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
            pairs = tables.store(best.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct())
            tried = pairs if tried is None else tried.union(pairs)
            good = tables.store(_verified(pairs, texts))
            edges = good if edges is None else tables.store(edges.union(good))
            labels = components(edges)
        rows = _labelled(shared, labels, tables)
        apart = _apart(rows, texts, tables)
        rest = tables.store(apart.join(tried, ["a", "b"], "left_anti"))
        return materialise(edges if rest.isEmpty() else edges.union(_verified(rest, texts)))


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` (written out) to be broadcast if they are few, else as they are."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _classified(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, label, component_id) for each row; label tells components apart whose smallest ids are equal."""
    docs = docs.select("doc_id", "text")
    sets = materialise(_sets(docs))
    labels = components(links(docs, sets)).withColumnRenamed("v", "fp")
    smallest = sets.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    linked = materialise(smallest.join(labels, "fp"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    of = linked.groupBy("label").agg(F.min("smallest").alias("component_id")).select("label", "component_id", salts)  # a component's classes are met in SALTS tasks
    linked = linked.withColumn("salt", F.pmod("fp", F.lit(SALTS))).join(of, ["label", "salt"]).select("fp", "label", "component_id")
    alone = smallest.join(labels, "fp", "left_anti").select("fp", F.col("fp").alias("label"), F.col("smallest").alias("component_id"))
    out = sets.join(materialise(linked.unionByName(alone)), "fp", "left")
    return out.select("doc_id", "text_hash", "n", "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own included; it is null
    where they reach none. Null texts and texts without words have no shingles and link with
    nothing; rows of equal text are in one component; rows with a null doc_id link as any
    others, but a null is never the smallest. Only doc_id and text are read.
    """
    return _classified(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of its smallest doc_id, and of that the text of smallest hash.

    In a component without any doc_id the text of smallest hash stays. Rows without words stay.
    """
    found = materialise(_classified(docs).filter("n > 0").groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")))
    kept = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))).alias("m")).select("m.__id", "m.__hash")
    kept = _small(materialise(kept))
    match = lambda left, right: left["doc_id"].eqNullSafe(right["__id"]) & (left["text_hash"] == right["__hash"])
    named = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    again = materialise(named(found.filter("rows > 1").join(kept, match(found, kept), "left_semi")))
    gone = found.join(kept, match(found, kept), "left_anti")
    of = lambda side: docs["doc_id"].eqNullSafe(side["__id"]) & (F.xxhash64(docs["text"]) == side["__hash"])
    if again.isEmpty():
        go = _small(materialise(named(gone)))
        return docs.join(go, of(go), "left_anti")
    go = _small(materialise(named(gone).union(again)))
    once = docs.join(again, of(again), "left_semi").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash")).agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return docs.join(go, of(go), "left_anti").unionByName(once)


#: DuckDB SQL for the rows of op7: all pairs by shared shingles, then what they reach.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
