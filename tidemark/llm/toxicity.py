"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates and counts of a text: words of a lexicon (given and learned), parts of words learned, such words
near the second person, capitals, punctuation, and spellings that hide words. The trees and the
calibration are Spark ML's; the sample they learn from is bounded. Beside it they always see
PRIOR, short texts made of the given lexicon with the weight of one document a label, so there
is one way to fit, whatever labels there are.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, in_batches
from .quality_model import learnable
from .sample import bounded

#: At most so many documents of each label are learned from.
PER_LABEL = 3000
THRESHOLD = 0.5

# Insults, the second person, and the letters that signs stand for.
LEXICON = frozenset(
    "arse arsehole ass asshole bastard bitch bullshit clown coward creep cretin crap cunt degenerate dick dimwit disgusting "
    "douche dumb dumbass fool freak fuck fucker fucking garbage halfwit hate hideous idiot idiotic imbecile jackass jerk kill "
    "lame liar loser lowlife lunatic maggot moron moronic motherfucker nasty numbskull parasite pathetic pig prick psycho "
    "retard retarded scum scumbag shit shitty shut sick slut stupid subhuman thug trash twat twit ugly useless vermin vile "
    "wanker weirdo whore worthless wretch".split()
)
SECOND_PERSON = frozenset("you your yours yourself yourselves youre you're u ur ya thou du dich dir dein euch tu te toi ton vous votre tú ti usted".split())
LEET = str.maketrans("@4013$5!7+|", "aaoiessittl")
_PLAIN = ("the plain line about a green hill and you " * 20).split()
#: (text, label) that stand in where labels are lacking: plain words of many lengths, and the same with words of the lexicon.
PRIOR = tuple((" ".join(_PLAIN[:n]), 0) for n in range(1, 161)) + tuple(
    (" ".join([*_PLAIN[: n // 2], *words.split(), *_PLAIN[n // 2 : n]]), 1)
    for i, w in enumerate(sorted(LEXICON)) for n in (2 * i % 160, (2 * i + 41) % 160) for words in (w, f"you are a {w}")
)
NEAR = 5
EDGE = ".,;:!?\"'()[]{}<>«»“”„…—–-*#%&|~_`"
_DOUBLED = re.compile(r"[!?]{2,}")
_HIDDEN = re.compile(r"(?i)[a-z][@$!*+|0134579]+[a-z]")
_LETTERS = re.compile(r"[^\W\d_]+")
_LETTERS_ASCII, _CAPITALS_ASCII = string.ascii_letters.encode(), string.ascii_uppercase.encode()
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
NAMES = (
    "lexicon_rate", "lexicon_log", "lexicon_kinds", "learned_rate", "learned_log", "learned_kinds", "second_person_rate", "near_rate",
    "stem_rate", "stem_log", "stem_kinds", "capital_share", "shouted_share", "mark_rate", "doubled_rate", "hidden_rate", "hidden_lexicon_log", "stretched_rate", "log_words",
)


def plain(word: str) -> str:
    return word.strip(EDGE)


def letters_of(text: str) -> tuple[int, int]:
    """How many letters and capitals a text has; ASCII ones are counted as bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    letters, capitals = (len(raw) - len(raw.translate(None, of)) for of in (_LETTERS_ASCII, _CAPITALS_ASCII))
    if len(raw) > len(text):
        others = _BEYOND_ASCII.findall(text)
        letters, capitals = letters + sum(map(str.isalpha, others)), capitals + sum(map(str.isupper, others))
    return letters, capitals


def describe(text: str | None, learned: frozenset[str], stems: Sequence[str] = ()) -> list[float]:
    """The values of NAMES for a text; zeros for a null or empty one. Rates are per 100 words."""
    text = text or ""
    raw = text.split()
    if not raw:
        return [0.0] * len(NAMES)
    low = text.lower()
    words = [w.strip(EDGE) for w in low.split()]
    found = [k for k in map(low.count, stems) if k]
    n = len(raw)
    rate = 100.0 / n
    hits = [i for i, w in enumerate(words) if w in LEXICON]
    own = [w for w in words if w in learned]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near, k = 0, 0
    for i in hits:
        while k < len(second) and second[k] < i - NEAR:
            k += 1
        near += k < len(second) and second[k] <= i + NEAR
    letters, capitals = letters_of(text)
    hidden = [w for w in raw if not w.isalpha() and _HIDDEN.search(w)]
    uncovered = sum(1 for w in hidden if (d := plain(w.lower()).translate(LEET).replace("*", "")) in LEXICON or d in learned)
    stretched = len(re.findall(r"([^\W\d_])\1{3,}", text))
    return [
        len(hits) * rate, math.log1p(len(hits)), float(len({words[i] for i in hits})), len(own) * rate, math.log1p(len(own)), float(len(set(own))),
        len(second) * rate, near * rate, sum(found) * rate, math.log1p(sum(found)), float(len(found)), capitals / max(letters, 1), sum(1 for w in raw if len(w) > 2 and w.isupper()) / n,
        (text.count("!") + text.count("?")) * rate, len(_DOUBLED.findall(text)) * rate, len(hidden) * rate, math.log1p(uncovered), stretched * rate, math.log(n),
    ]


def _gain(toxic: int, n_toxic: int, other: int, n_other: int) -> float:
    """How much likelier something is in toxic documents than in others."""
    return (toxic + 0.5) / (n_toxic + 1) / ((other + 0.5) / (n_other + 1))


def learn_lexicon(texts: Sequence[str | None], labels: Sequence[int], least: int = 5, share: float = 0.015, odds: float = 10.0, most: int = 300) -> frozenset[str]:
    """Words far likelier in toxic documents than in others, by distinct texts that have them."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    n = {0: 0, 1: 0}
    for text, y in dict(zip(texts, labels, strict=True)).items():
        n[y] += 1
        seen[y].update({plain(w) for w in (text or "").lower().split()})
    gain = lambda w: _gain(seen[1][w], n[1], seen[0][w], n[0])
    good = [w for w, k in seen[1].items() if w and k >= max(least, share * n[1]) and gain(w) >= odds]
    return frozenset(sorted(good, key=lambda w: (-gain(w), w))[:most])


def learn_stems(texts: Sequence[str | None], labels: Sequence[int], sizes: Sequence[int] = (4, 5, 6), least: int = 3, share: float = 0.01, odds: float = 10.0, most: int = 40) -> tuple[str, ...]:
    """Parts of words that few letters of toxic documents share and others lack: words that are inflected or made up still show them.

    Of the parts that are likely enough, those are taken in turn that cover most toxic documents not yet covered.
    """
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    toxic, n = [], {0: 0, 1: 0}
    for text, y in dict(zip(texts, labels, strict=True)).items():
        n[y] += 1
        words = {w for w in _LETTERS.findall((text or "").lower())}
        parts = {w[i : i + k] for w in words for k in sizes for i in range(len(w) - k + 1)}
        seen[y].update(parts)
        if y:
            toxic.append(parts)
    enough = max(least, share * n[1])
    good = {p for p, k in seen[1].items() if k >= enough and _gain(k, n[1], seen[0][p], n[0]) >= odds}
    left = [d for d in (parts & good for parts in toxic) if d]
    stems: list[str] = []
    while left and len(stems) < most:
        covers = Counter(p for d in left for p in d)
        best = min(covers, key=lambda p: (-covers[p], -len(p), p))
        if covers[best] < enough:
            break
        stems.append(best)
        left = [d for d in left if best not in d]
    return tuple(stems)


@dataclass(frozen=True)
class Model:
    learned: frozenset[str]
    stems: tuple[str, ...]
    trees: GBTClassificationModel
    calibration: IsotonicRegressionModel


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from labelled documents whose fold (crc32 of the id, modulo 5) is not 0.

    Of a bounded sample (sample.bounded) two fifths give the learned lexicon, two fifths the
    trees and a fifth the calibration, so that trees see lexicon rates as they are in new text.
    Trees and calibration weigh the rows by the labels' own shares, which the sample levels.
    Where a label is missing, what is known of it is PRIOR.
    """
    texts, y, weights = bounded(docs, learnable(labels, "toxic"), per_label)
    y = [int(v > 0) for v in y]
    place = {0: 0, 1: 0}
    parts: dict[str, list[int]] = {"lexicon": [], "trees": [], "calibration": []}
    for i, v in enumerate(y):
        parts[("lexicon", "trees", "lexicon", "trees", "calibration")[place[v] % 5]].append(i)
        place[v] += 1
    some = [texts[i] for i in parts["lexicon"]], [y[i] for i in parts["lexicon"]]
    learned, stems = learn_lexicon(*some), learn_stems(*some)
    rows = [(float(y[i]), weights[i], name, describe(texts[i], learned, stems)) for name in ("trees", "calibration") for i in parts[name]]
    share = {v: sum(1 for _, k in PRIOR if k == v) for v in (0, 1)}
    rows += [(float(v), 1 / share[v], name, describe(t, learned, stems)) for name in ("trees", "calibration") for t, v in PRIOR]
    data = docs.sparkSession.createDataFrame(rows, "label double, weight double, part string, __vector array<double>").coalesce(2)
    data = data.withColumn("__vector", array_to_vector("__vector")).cache()
    learner = GBTClassifier(featuresCol="__vector", weightCol="weight", predictionCol="__class", maxIter=30, maxDepth=3, stepSize=0.2, maxBins=64, seed=5)
    trees = learner.setProbabilityCol("__probability").setRawPredictionCol("__margin").fit(data.filter("part = 'trees'"))
    raw = trees.transform(data.filter("part = 'calibration'")).select("label", "weight", vector_to_array("__probability")[1].alias("__raw"))
    calibration = IsotonicRegression(featuresCol="__raw", weightCol="weight", predictionCol="__calibrated").fit(raw)
    data.unpersist()
    return Model(learned, stems, trees, calibration)


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without text, with held_out, score and predicted; columns of these names are replaced.

    A null text scores as an empty one; held_out is false for a null id; an empty table gives an
    empty result. A thousandth of the uncalibrated probability orders documents that the
    calibration ties.
    """
    rows = docs.drop("held_out", "score", "predicted", "__features", "__vector")
    keep = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in keep]
    learned, stems = model.learned, model.stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([describe(t, learned, stems) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], made], names=[*names, "__features"])

    out = in_batches(rows.select(*names, "text")).mapInArrow(run, T.StructType([*keep, T.StructField("__features", T.ArrayType(T.DoubleType()))]))
    scored = model.trees.transform(out.withColumn("__vector", array_to_vector("__features"))).withColumn("__raw", vector_to_array("__probability")[1])
    out = model.calibration.transform(scored).withColumn("score", 0.999 * F.col("__calibrated") + 0.001 * F.col("__raw"))
    return (
        out.select(*names, "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
        .withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    )
