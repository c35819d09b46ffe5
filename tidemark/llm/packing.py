"""Packing documents into sequences of a fixed number of tokens by minimum bin slack.

A document's whole windows are sequences of their own; what is left of it, shorter than a
window, is a remainder. Remainders of one length are alike, so the plan needs only how many
there are of each length: at most window - 1 numbers, however many documents there are. For a
sequence the planner takes the longest remainder and fills the room it leaves with the multiset
of other lengths that comes closest (subset sums as bits of one number, traced back to counts),
and repeats that choice as often as the counts allow. Only where no multiset fills the room is
one more remainder cut, and its tail goes back among the others, so sequences have no padding.
The last tokens, fewer than a window, go to sequences of powers of two.

Each document looks its remainder's place up in the plan by its number among those of its
length; ids move once, to the places of their task's numbers.
"""

from __future__ import annotations

import functools
import re
from array import array
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import in_batches, materialise
from .token_file import tokenizer

WINDOW, END = 4096, 2
#: Words whose ids a worker remembers, once and while they recur, and the longest of them.
REMEMBERED, LONGEST = 600_000, 60
#: Words that are encoded as one string, and the word between them.
TOGETHER, BETWEEN = 2_000, "|"
#: A full stop or comma at a word's end that no letter precedes: it may belong to what does.
_ODD_MARK = re.compile(r"[.,](?<![^\W\d_][.,])[ \n]")
#: Bits of a remainder's number among those of its length.
_NUMBER = 44


# ---- the plan


def fullest(lengths: Sequence[int], counts: Mapping[int, int], room: int) -> dict[int, int]:
    """How many of each length to take, at most ``counts``, for the largest sum up to ``room``.

    ``lengths`` are those to use, longest first. Bit i of a number says that i can be reached.
    """
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in lengths:
        left, some = min(counts[length], room // length), 1
        while left:
            k = min(some, left)
            steps.append((length, k, reach))
            reach |= (reach << length * k) & mask
            left, some = left - k, 2 * some
        if reach >> room:
            break
    total, picked = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            picked[length] += k
            total -= length * k
    return dict(picked)


class Plan(NamedTuple):
    """Where remainders go: arrays with an entry for a run of numbers of one length, in their order.

    key: length and first number. A run's i-th remainder goes to sequence + i // each at offset
    + (i % each) * length; if cut is not 0, only its first ``cut`` ids go there, and the others
    are the remainder number next + i of their length. sequences: how many there are.
    """

    key: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    cut: np.ndarray
    next: np.ndarray
    sequences: int


def make_plan(counts: Mapping[int, int], window: int = WINDOW) -> Plan:
    """The plan for so many remainders of each length under ``window``."""
    left = Counter({length: n for length, n in counts.items() if n})
    lengths = sorted(left)
    taken: Counter[int] = Counter()  # numbers already given away, and in all, of each length
    known = Counter(left)
    runs, sequence, total = [], 0, sum(length * n for length, n in left.items())
    while total:
        size = window if total >= window else 1 << total.bit_length() - 1
        below = bisect_right(lengths, size)
        picked: Counter[int] = Counter()
        if below:
            first = lengths[below - 1]
            left[first] -= 1
            usable = lengths[: bisect_right(lengths, size - first)]
            picked.update(fullest([x for x in reversed(usable) if left[x]], left, size - first))
            left[first] += 1
            picked[first] += 1
        gap = size - sum(length * n for length, n in picked.items())
        needs, cut = picked.copy(), 0
        if gap:  # all that is left is longer than the gap, or it would have been taken
            cut = next(x for x in reversed(lengths) if left[x] > picked[x])
            needs[cut] += 1
        times = min(left[x] // n for x, n in needs.items())
        if size < window:
            times = 1
        offset = 0
        for length, n in picked.items():
            runs.append((length << _NUMBER | taken[length], n, sequence, offset, 0, 0))
            taken[length] += n * times
            offset += n * length
        if gap:
            rest = cut - gap
            runs.append((cut << _NUMBER | taken[cut], 1, sequence, offset, gap, known[rest]))
            taken[cut] += times
            known[rest] += times
        for length, n in needs.items():
            left[length] -= n * times
        if gap:
            if not left[rest] and rest not in needs:
                lengths.insert(bisect_right(lengths, rest), rest)
            left[rest] += times
        for length in needs:
            if not left[length]:
                del left[length]
                lengths.remove(length)
        sequence += times
        total -= size * times
    columns = np.array(sorted(runs), np.int64).reshape(-1, 6).T
    return Plan(*columns, sequence)


def places(plan: Plan, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which remainder, start within it, length, sequence, offset) of all pieces of remainders."""
    found, which, start = [], np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
    while len(which):
        run = np.searchsorted(plan.key, lengths << _NUMBER | numbers, "right") - 1
        i = (lengths << _NUMBER | numbers) - plan.key[run]
        cut = plan.cut[run]
        size = np.where(cut > 0, cut, lengths)
        found.append((which, start, size, plan.sequence[run] + i // plan.each[run], plan.offset[run] + i % plan.each[run] * lengths))
        more = cut > 0
        which, start, numbers, lengths = which[more], (start + size)[more], (plan.next[run] + i)[more], (lengths - size)[more]
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 5))


# ---- tokenising


class Words:
    """Ids of texts for a vocabulary that drops white space and case and cuts marks from letters: those of their words, remembered while they recur."""

    def __init__(self, path: str, end: int) -> None:
        self.tokenizer = tokenizer(path)
        plain = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if plain("A\nb.") != [*plain("a"), *plain("b"), *plain(".")]:
            raise ValueError("the vocabulary keeps white space, case or marks")
        largest = max(*self.tokenizer.get_vocab(with_added_tokens=True).values(), end)
        self.kind = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.end = np.array([end], self.kind).tobytes()
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _alone(self, words: list[str]) -> list[bytes]:
        return [array(self.kind.char, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of words without BETWEEN: encoded as one string with it between them, and cut where its id stands."""
        ids = np.array(self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        cut = np.flatnonzero(ids == self.between)
        if len(cut) != len(words) - 1:
            return self._alone(words)
        raw, size = ids.tobytes(), self.kind.itemsize
        return [raw[x:y] for x, y in zip([0, *((cut + 1) * size).tolist()], [*(cut * size).tolist(), len(raw)], strict=True)]

    def _learn(self, new: list[bytes]) -> None:
        words = [w.decode() for w in new]
        odd = [w for w in words if self.between is None or BETWEEN in w]
        plain = [w for w in words if not (self.between is None or BETWEEN in w)]
        for some, size, make in ((odd, 20_000, self._alone), (plain, TOGETHER, self._together)):
            for k in range(0, len(some), size):
                part = some[k : k + size]
                self.known.update(zip((w.encode() for w in part), make(part), strict=True))

    @staticmethod
    def cut(text: str | None) -> list[bytes]:
        """Words at ASCII white space; a lone full stop or comma after a letter is one of its own, and ASCII is lower case."""
        if not text:
            return []
        if not _ODD_MARK.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").replace(",\n", " ,\n")
        raw = text.encode()
        return raw.lower().split() if len(raw) == len(text) and "<|" not in text else raw.split()

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        cut = [self.cut(t) for t in texts]
        here: dict[bytes, bytes] = {}  # of these texts alone: small enough for a processor's cache
        new = []
        for w in set().union(*cut):
            if (v := known.get(w)) is not None:
                here[w] = v
            elif (v := older.get(w)) is not None:
                here[w] = known[w] = v
            else:
                new.append(w)
        new.sort()  # neighbours share their merges
        self._learn(new)
        here.update((w, known[w]) for w in new)
        out = [b"".join(map(here.__getitem__, words)) + self.end for words in cut]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out


@functools.cache
def words_of(path: str, end: int) -> Words:
    return Words(path, end)


def _tokenised(docs: DataFrame, path: str, window: int, end: int) -> DataFrame:
    """(doc_id, part, ids, rest, number, whole, before): ids of each document, and its numbers within its task.

    rest is the remainder's length and number its number among the task's of that length; whole
    counts the whole windows and before those of earlier documents of the task.
    """
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("rest", T.LongType()),
        T.StructField("number", T.LongType()), T.StructField("whole", T.LongType()), T.StructField("before", T.LongType()),
    ])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, part = words_of(path, end), TaskContext.get().partitionId()
        seen, before = np.zeros(window, np.int64), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 250):
                some = batch.slice(low, 250)
                made = make(some.column("text").to_pylist())
                n = np.array([len(b) for b in made], np.int64) // make.kind.itemsize
                rest, whole = n % window, n // window
                number = np.empty(len(n), np.int64)
                for i, r in enumerate(rest.tolist()):
                    number[i] = seen[r]
                    seen[r] += 1
                earlier = before + np.cumsum(whole) - whole
                before += int(whole.sum())
                columns = [pa.array(np.full(len(n), part)), pa.array(made, pa.binary()), *map(pa.array, (rest, number, whole, earlier))]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns], names=names)

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents (doc_id, text), and where they lie.

    A document's ids are the tokenizer's and ``end``; a null or empty text is just that. Each id
    lies in one piece: ids start to start + length of its document, at offset of its sequence,
    as little-endian unsigned 32-bit integers. Sequences are numbered from 0 and hold ``window``
    ids without padding; the last few, together shorter than a window, each hold a power of two.
    A row is a document: repeated or null ids are packed row by row. An empty table gives no
    piece. Other columns are not read. The tokenizer must drop white space.
    """
    rows = materialise(_tokenised(docs, tokenizer_path, window, end))
    by_part = rows.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole"))
    by_part = materialise(by_part)
    counts = {r.rest: r.n for r in by_part.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # a row a length, under window of them
    counts.pop(0, None)
    plan = make_plan(counts, window)
    earlier = W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a task
    numbers = by_part.select("part", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__numbers"))
    in_order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a task
    wholes = by_part.groupBy("part").agg(F.sum("whole").alias("whole")).select("part", F.coalesce(F.sum("whole").over(in_order), F.lit(0)).alias("__wholes"))
    placed = rows.join(numbers, ["part", "rest"]).join(F.broadcast(wholes), "part")
    placed = placed.select("doc_id", "ids", "rest", (F.col("number") + F.col("__numbers")).alias("number"), "whole", (F.col("before") + F.col("__wholes")).alias("before"))
    kind = words_of(tokenizer_path, end).kind
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, number, whole, before = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rest", "number", "whole", "before"))
            some = np.flatnonzero(rest)
            row, start, length, sequence, offset = places(plan, rest[some], number[some])
            row = some[row]
            nth = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)  # whole windows of each document
            of = np.repeat(np.arange(len(whole)), whole)
            row, start = np.concatenate([of, row]), np.concatenate([nth * window, whole[row] * window + start])
            length, offset = np.concatenate([np.full(len(of), window), length]), np.concatenate([np.zeros(len(of), np.int64), offset])
            sequence = np.concatenate([plan.sequences + before[of] + nth, sequence])
            ids = [np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")]
            docs_of, tokens = batch.column("doc_id").take(pa.array(row)), np.array([len(x) for x in ids], np.int64)
            for low in range(0, len(row), 500):
                at = slice(low, low + 500)
                cut = [ids[r][s : s + n].astype("<u4").tobytes() for r, s, n in zip(row[at].tolist(), start[at].tolist(), length[at].tolist(), strict=True)]
                columns = [pa.array(start[at]), pa.array(length[at]), pa.array(cut, pa.binary()), pa.array(tokens[row[at]]), pa.array(sequence[at]), pa.array(offset[at])]
                yield pa.RecordBatch.from_arrays([docs_of.slice(low, 500), *columns], names=names)

    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the sequences that pieces make, their ids as little-endian unsigned 32-bit integers.

    A sequence has at most as many pieces as ids, so no group is unbounded.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
