"""Resampling documents towards a target distribution by the gains of hashed n-grams.

Tasks count the n-grams of their documents and of the target's texts and add up what they hold
before it moves; the dictionary that results has each distinct n-gram once with both its counts,
and only there it is hashed. Buckets are summed from the dictionary, and their gains go back to
it. The n-grams that make up at least a 65,536th of all features are at most so many: tasks
know those by heart. A document's other n-grams, none of them frequent, are joined with the
dictionary, and each document gets the sum of both.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import with_before
from .common import in_batches, materialise

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Features that are at least this fraction of all are known to every task: at most so many.
COMMON = 1 << 16
#: Distinct n-grams that a task adds up before it hands them on.
HELD = 200_000
#: A word in UTF-8 with A-Z in lower case: digits, a-z and all beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8; only A-Z are changed."""
    return _WORD.findall(text.encode().lower()) if text else []  # bytes.lower() knows ASCII only


def features(found: list[bytes], longest: int) -> Counter[bytes]:
    """How often each run of 1 to ``longest`` words occurs, its words joined by a space."""
    out = Counter(found)
    for n in range(2, longest + 1):
        out.update(b" ".join(found[i : i + n]) for i in range(len(found) - n + 1))
    return out


def counted(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(feature, n): the n-grams of all texts, as binary, once for each task and HELD of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            names, n = list(held.keys()), list(held.values())
            for low in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[low : low + 10_000], pa.binary()), pa.array(n[low : low + 10_000], pa.int64())], names=["feature", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(features(words(text), longest))
                if len(held) > HELD:
                    yield from out()
                    held.clear()
        yield from out()

    return in_batches(texts.select(F.col("text").cast("string").alias("text"))).mapInArrow(run, "feature binary, n long")


def dictionary(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """(feature, s, gain) of every distinct n-gram of the documents, and how many features those hold.

    gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of the bucket.
    """
    both = counted(docs, longest).select("feature", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(counted(target, longest).select("feature", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    once = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", F.crc32("feature") % buckets)
    once = materialise(once)
    sums = once.groupBy("bucket").agg(F.sum("s").alias("bucket_s"), F.sum("t").alias("bucket_t"))
    total = once.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = (F.col("bucket_t") + 1).cast("double") * F.lit(float(total[0] + buckets)) / ((F.col("bucket_s") + 1).cast("double") * F.lit(float(total[1] + buckets)))
    gains = sums.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))
    return once.filter("s > 0").join(F.broadcast(gains), "bucket").select("feature", "s", "gain"), total[0]  # gains: a row a bucket


def _described(docs: DataFrame, common: dict[bytes, int], longest: int) -> DataFrame:
    """(doc_id, row, n_words, n_features, known, rest): a document's sizes, what its common features add up to, and the others with their counts."""
    schema = "doc_id long, n_words long, n_features long, known long, rest array<struct<feature: binary, n: bigint>>"
    pair = pa.list_(pa.struct([("feature", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                rows = []
                for text in part.column("text").to_pylist():
                    found = words(text)
                    of = features(found, longest)
                    gain, rest = 0, []
                    for f, n in of.items():
                        g = common.get(f)
                        if g is None:
                            rest.append({"feature": f, "n": n})
                        else:
                            gain += g * n
                    rows.append((len(found), of.total(), gain, rest))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pair))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "known", "rest"])

    texts = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def weighed(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of gains over a document's features, 0 without any."""
    known, total = dictionary(docs, target, longest, buckets)
    known = materialise(known)
    # at most COMMON rows, as their counts are each a COMMON-th of the sum of all or more
    common = {bytes(r.feature): r.gain for r in known.filter(F.col("s") * COMMON >= total).select("feature", "gain").collect()} if total else {}
    rows = materialise(_described(docs, common, longest))
    rare = rows.select("row", F.explode("rest").alias("x")).select("row", F.col("x.feature").alias("feature"), F.col("x.n").alias("n"))
    found = rare.join(known.filter(F.col("s") * COMMON < total).select("feature", "gain"), "feature").select("row", (F.col("n") * F.col("gain")).alias("g"))
    sums = rows.select("row", "doc_id", "n_words", "n_features", F.col("known").alias("g")).unionByName(found, allowMissingColumns=True)
    sums = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("g").alias("g"))
    return sums.select("doc_id", "n_words", "n_features", F.expr("CASE WHEN n_features > 0 THEN (g - pmod(g, n_features)) div n_features ELSE 0L END").alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of sha256 of ``<seed>:<doc_id>``; a null id counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document (doc_id, text), against the texts of ``target``.

    weight is the mean gain of its features, score adds Gumbel noise made from the id; the
    percent of documents with at least ``least_words`` words that score highest are drawn, ranked
    from 1, of equal scores the smaller id first; rank is null for all others. A null or empty
    text has no features and weight 0; a null id sorts after all others of its score. A row is
    a document: equal ids are told apart by score, and equal rows ranked in any order. An empty
    target gives no feature a preference but for what is frequent. An empty table gives no row.
    Other columns are not read.
    """
    scored = materialise(weighed(docs, target, longest, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    keyed = fit.select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("__high"), F.col("doc_id").isNull().alias("__no_id"))
    ranked = with_before(keyed, ["__high", "__no_id", "doc_id"]).withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*columns))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""WITH bits AS (SELECT list(x ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS x FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_WORDS} AS words FROM documents),
f AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM d) GROUP BY ALL),
b AS (SELECT word, count(*) AS n FROM (SELECT unnest({_SQL_WORDS}) AS word FROM benchmark) GROUP BY ALL),
w AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, n AS s, 0 AS t FROM f UNION ALL SELECT word, 0, n FROM b) GROUP BY ALL),
h AS (SELECT word, w.s, w.t, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT) FOR i IN range(octet_length(encode(word)))]),
  lambda a, x: xor(bits.t[1 + (xor(a, x) & 255)], a >> 8)), 4294967295) % {BUCKETS} AS bucket FROM w, bits),
g AS (SELECT bucket, floor(1000 * ln((CAST(sum(t) AS DOUBLE) + 1) * ((SELECT coalesce(sum(s), 0) FROM h) + {BUCKETS}.0::DOUBLE)
  / ((CAST(sum(s) AS DOUBLE) + 1) * ((SELECT coalesce(sum(t), 0) FROM h) + {BUCKETS}.0::DOUBLE)))) AS gain FROM h GROUP BY bucket),
e AS (SELECT f.row, CAST(floor(sum(f.n * g.gain) / sum(f.n)) AS BIGINT) AS weight FROM f JOIN h USING (word) JOIN g USING (bucket) GROUP BY f.row),
s AS (SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_features, coalesce(e.weight, 0) AS weight, coalesce(e.weight, 0) + CAST(floor(-1000 * ln(-ln(
  (CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN e ON e.row = d.row),
r AS (SELECT *, n_features >= {LEAST_WORDS} AS fit, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM r"""
