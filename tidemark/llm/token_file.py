"""Token ids as canonical, length-limited Huffman codes.

Documents are tokenised where they lie, which also counts the ids; then only ids move, to the
order of document ids, and are cut into blocks of whole documents. The code is made from the
counts of all ids; each block is packed and unpacked without any other, and within a block the
bit offset of every CHECKPOINT-th id lets a table-driven decoder run many places at once. The
output is three tables that Spark writes and reads on any store it knows: blocks (binary
records by part), the code's lengths, and for each part the number of ids before it.

A record, little-endian: magic "THB2", u32 documents, u32 ids, u64 number of the first id
within the part, i64 document ids (with a byte each for null), u32 ids of each document, u64
bit offset of each checkpoint, then the code words as big-endian u32.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, in_batches, shared_dir, stored

MAGIC = b"THB2"
#: The longest code word, or more where the ids in use need it.
MAX_BITS = 16
CHECKPOINT = 128
#: A block is closed once it has so many ids.
BLOCK = 1 << 16
END = 0
#: Pieces of text whose ids a worker remembers, once and while they recur, and the longest of them.
REMEMBERED, LONGEST = 600_000, 40
#: Pieces that are encoded as one string.
TOGETHER = 2_000


# ---- tokenising


@functools.cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Marks before a piece that no space precedes: punctuation or a newline, and the first word of a line.
JOINED, BEGIN = "\x01", "\x02"
#: How a byte-level vocabulary writes a space.
SPACE = "Ġ"
#: All characters that are spaces but for these two; each is looked for by itself, which is faster than a pattern.
_OTHER_SPACES = tuple("\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_ODD_MARK = re.compile(r"[.,](?<![^\W\d_][.,])[ \n]")


def pieces(text: str) -> list[str]:
    """A text cut where the tokenizer's pattern always cuts.

    That is at a lone space between two other characters, which the pattern joins to what
    follows; around a lone newline between two others; and between a letter or digit and the
    one full stop or comma that follows it before such a space or newline. So the ids of a text
    are those of its pieces. A piece is what follows a space, or bears a mark if none does.
    """
    if JOINED in text or BEGIN in text:
        return [BEGIN + text]
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1].isspace() or text[-1:].isspace() or any(map(text.__contains__, _OTHER_SPACES)):
        first, *rest = text.split(" ")
        out = [BEGIN + first]
        for p in rest:
            if p and not p[0].isspace() and out[-1] != BEGIN and not out[-1][-1].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out
    if not _ODD_MARK.search(text):
        text = text.replace("\n", f" {JOINED}\n {BEGIN}").replace(". ", f" {JOINED}. ").replace(", ", f" {JOINED}, ")
    return (BEGIN + text).split(" ")


class _Known(dict):
    """Ids of pieces. Those asked for that neither this nor the ``older`` table has are noted in ``new``, and are None until they are learned."""

    def __init__(self, older: dict[str, bytes]):
        self.older, self.new = older, []

    def __missing__(self, piece: str) -> bytes | None:
        found = self[piece] = self.older.get(piece)
        if found is None:
            self.new.append(piece)
        return found


class Ids:
    """Ids of texts as little-endian bytes, remembering those of short pieces while they recur."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_ids = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")  # array's H and I, on machines that are little-endian
        self.spaced = np.zeros(self.n_ids, bool)  # ids of tokens that start with a space
        self.spaced[[i for token, i in vocabulary.items() if token[0] == SPACE]] = True
        self.end = np.array([END], self.kind).tobytes()
        self.known = _Known({})

    def _alone(self, plain: list[str]) -> list[bytes]:
        return [array(self.kind.char, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of words that each follow a space: encoded as one string, and cut where a token starts with a space."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        first = np.flatnonzero(self.spaced[ids])
        if len(first) != len(words) or first[0] != 0:
            return self._alone([" " + w for w in words])
        raw, at = ids.tobytes(), [*(first * self.kind.itemsize).tolist(), ids.nbytes]
        return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def _learn(self, new: list[str]) -> None:
        odd = [p for p in new if p[0] == JOINED or p[0] == BEGIN]
        for k in range(0, len(odd), 20_000):
            part = odd[k : k + 20_000]
            self.known.update(zip(part, self._alone([p[1:] for p in part]), strict=True))
        words = sorted(p for p in new if p[0] != JOINED and p[0] != BEGIN)  # neighbours share their merges
        whole = [p for p in words if " " not in p]
        for k in range(0, len(whole), TOGETHER):
            part = whole[k : k + TOGETHER]
            self.known.update(zip(part, self._together(part), strict=True))
        if len(whole) < len(words):
            part = [p for p in words if " " in p]
            self.known.update(zip(part, self._alone([" " + p for p in part]), strict=True))

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.older = {}
            self.known = _Known(self.known)
        known = self.known
        cut = [pieces(t) if t else [] for t in texts]
        found = [list(map(known.__getitem__, ps)) for ps in cut]
        new, known.new = known.new, []
        self._learn(new)
        if new:
            for ps, ids in zip(cut, found, strict=True):
                at = -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    ids[at] = known[ps[at]]
        out = [b"".join(ids) + self.end for ids in found]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out


@functools.cache
def ids_of(path: str) -> Ids:
    return Ids(path)


# ---- the code


def bit_limit(counts: np.ndarray) -> int:
    """MAX_BITS, or as many bits as tell the ids in use apart and one more."""
    return max(MAX_BITS, int(np.count_nonzero(counts) - 1).bit_length() + 1)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code of at most bit_limit() bits; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    limit = bit_limit(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    rows: list[np.ndarray] = []  # for each level, whether the items in ascending order are leaves
    packed = np.empty(0)
    for _ in range(limit):
        both = np.concatenate([leaf, packed])
        rank = np.argsort(both, kind="stable")
        rows.append(rank < len(leaf))
        both = both[rank]
        packed = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, bits = 2 * len(leaf) - 2, np.zeros(len(leaf), np.uint8)
    for is_leaf in reversed(rows):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = bits
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code words: by length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    out = np.zeros(len(lengths), np.uint64)
    if len(order):
        top = int(lengths[order].max())
        spans = np.uint64(1) << (np.uint64(top) - lengths[order].astype(np.uint64))
        first = np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.uint64)
        out[order] = first >> (np.uint64(top) - lengths[order].astype(np.uint64))
    return out


def decoding_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, bits) for each value of the next ``limit`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = 1 << (limit - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
    ids[: n.sum()], bits[: n.sum()] = np.repeat(order, n), np.repeat(lengths[order], n)
    return ids, bits


def pack(first: int, doc_ids: Sequence[int | None], sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> bytes:
    """The record of a block."""
    bits = lengths[ids].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(bits)])
    start, total = at[:-1], int(at[-1])
    packed = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        value = words[ids] << (64 - bits - (start & 31)).astype(np.uint64)
        word = start >> 5
        group = np.flatnonzero(np.diff(word, prepend=-1))
        packed[word[group]] += np.add.reduceat(value >> np.uint64(32), group)
        packed[word[group] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), group)
    return b"".join([
        MAGIC, struct.pack("<IIQ", len(doc_ids), len(ids), first), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids),
        sizes.astype("<u4").tobytes(), start[::CHECKPOINT].astype("<u8").tobytes(), packed.astype(">u4").tobytes(),
    ])


def unpack(record: bytes, ids_at: np.ndarray, bits_at: np.ndarray, limit: int) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(number of the first id, document ids, ids of each document, ids) of a record."""
    if record[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n, first = struct.unpack_from("<IIQ", record, 4)
    p = 20
    docs = np.frombuffer(record, "<i8", n_docs, p)
    null = np.frombuffer(record, np.uint8, n_docs, p := p + 8 * n_docs)
    sizes = np.frombuffer(record, "<u4", n_docs, p := p + n_docs)
    lanes = -(-n // CHECKPOINT)
    at = np.frombuffer(record, "<u8", lanes, p := p + 4 * n_docs).astype(np.int64)
    packed = np.frombuffer(record, ">u4", -1, p + 8 * lanes).astype(np.uint64)
    packed = np.append(packed, np.zeros(2, np.uint64))
    out = np.empty((CHECKPOINT, lanes), np.uint32)
    for k in range(min(CHECKPOINT, n)):
        word = np.minimum(at >> 5, len(packed) - 2)
        window = ((packed[word] << np.uint64(32)) | packed[word + 1]) >> (64 - limit - (at & 31)).astype(np.uint64)
        window = (window & np.uint64((1 << limit) - 1)).astype(np.int64)
        out[k] = ids_at[window]
        at += bits_at[window]
    return first, [None if z else int(d) for d, z in zip(docs, null, strict=True)], sizes.astype(np.int64), out.T.ravel()[:n]


# ---- on Spark


def _tokenised(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, spot, nth, ids, used, times): a row for each document, and one for each task with the ids it used and how often.

    spot is a hash of the text, nth tells the rows of all tasks apart.
    """
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("spot", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("used", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType())),
    ])
    names = schema.fieldNames()
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, nth = ids_of(tokenizer_path), TaskContext.get().partitionId() << 33
        n, id_type = np.zeros(make.n_ids, np.int64), pa.int64()
        for batch in batches:
            id_type = batch.column("doc_id").type
            for low in range(0, batch.num_rows, 250):
                part = batch.slice(low, 250)
                made = make(part.column("text").to_pylist())
                n += np.bincount(np.frombuffer(b"".join(made), make.kind), minlength=make.n_ids)
                none = pa.nulls(len(made), lists)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("spot"), pa.array(np.arange(nth, nth + len(made))), pa.array(made, pa.binary()), none, none], names=names)
                nth += len(made)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.array([nth]), pa.nulls(1, pa.binary()), pa.array([at], lists), pa.array([n[at]], lists)], names=names)

    return in_batches(docs.select("doc_id", F.xxhash64("text").alias("spot"), "text")).mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Tokenise ``docs`` (doc_id, text) and write ``path``/blocks, ``path``/parts and ``path``/code.

    Each document ends with the id 0; a null or empty text is just that. Documents come in
    order of id, nulls first; equal ids in order of a hash of the text, then the ids. An empty
    table gives no blocks. Other columns are not read.
    """
    spark, make = docs.sparkSession, ids_of(tokenizer_path)
    kind, n_ids = make.kind, make.n_ids
    rows, rows_path = stored(_tokenised(docs, tokenizer_path), "zstd")
    counts = np.zeros(n_ids, np.int64)
    used = rows.filter("used IS NOT NULL").select(F.explode(F.arrays_zip("used", "times")).alias("x"))
    for i, n in used.groupBy("x.used").agg(F.sum("x.times")).collect():  # a row an id of the vocabulary
        counts[i] = n
    lengths = code_lengths(counts)
    words, limit = codes(lengths), bit_limit(counts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, size = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        got: list[bytes] = []

        def block() -> pa.RecordBatch:
            sizes = np.array([len(b) // kind.itemsize for b in got], np.int64)
            record = pack(first, doc_ids, sizes, np.frombuffer(b"".join(got), kind), lengths, words)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([size]), pa.array([record])], names=["part", "n", "record"])

        for batch in batches:
            for d, b in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(d)
                got.append(b)
                size += len(b) // kind.itemsize
                if size >= BLOCK:
                    yield block()
                    first, size, doc_ids, got = first + size, 0, [], []
        if doc_ids:
            yield block()

    placed = rows.filter("used IS NULL").select("doc_id", "spot", "nth", "ids").repartitionByRange("doc_id", "spot", "nth").sortWithinPartitions("doc_id", "spot", "ids")
    placed.select("doc_id", "ids").mapInArrow(encode, "part int, n long, record binary").write.option("compression", "none").parquet(f"{path}/blocks")
    discard(spark, rows_path)
    sizes = spark.read.schema("part int, n long").parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n")).collect()  # a row a task
    parts, start = [], 0
    for part, n in sorted(map(tuple, sizes)):
        parts.append((part, start))
        start += n
    spark.createDataFrame(parts, "part int, start long").coalesce(1).write.parquet(f"{path}/parts")
    spark.createDataFrame([(n_ids, limit, lengths.tobytes())], "ids int, max_bits int, lengths binary").coalesce(1).write.parquet(f"{path}/code")


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, decoded from them."""
    code = spark.read.schema("ids int, max_bits int, lengths binary").parquet(f"{path}/code").first()
    lengths, limit = np.frombuffer(code["lengths"], np.uint8), code["max_bits"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_at, bits_at = decoding_table(lengths, limit)
        for batch in batches:
            for start, record in zip(batch.column("start").to_pylist(), batch.column("record"), strict=True):
                first, doc_ids, sizes, ids = unpack(record.as_buffer().to_pybytes(), ids_at, bits_at, limit)
                ends = np.cumsum(sizes)
                wide = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts")  # a row a task of write()
    rows = spark.read.schema("part int, record binary").parquet(f"{path}/blocks").join(F.broadcast(parts), "part").select("start", "record")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` to the new folder ``path``, or one in the shared folder, and read them back."""
    path = path or shared_dir(docs.sparkSession)
    write(docs, path, tokenizer_path)
    return read(docs.sparkSession, path)
