"""Secret scans: fixed patterns, and strings that a tokenizer's vocabulary cannot compress.

Prose and identifiers take few tokens for their length; a random string takes one for every
one or two characters. Candidates are unbroken strings of letters, digits and +/_=-; known digests,
UUIDs and numbers are excluded before the test. Strings without digits and those with the shape
of identifiers (words joined by marks, each with a few digits at most) are held to a stricter
ratio, as words compress far better than that.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_batches

#: Characters per token under which a candidate is random.
MAX_RATIO = 2.2
#: The same for candidates without a digit or with the shape of an identifier. Of random strings of 24 letters in both cases
#: nine in ten are under it, of capitals seven, of small letters four; of long words in the test tables none.
STRICT_RATIO = 1.6
MIN_LENGTH = 16

# The patterns and lengths of the base rules, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "dense")
WORDS = ("password", "passwd", "secret", "token", "api")

_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
_KNOWN = re.compile(
    r"""(?x)
    [0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128}  # digests
    |[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}                                              # UUID
    |(sha(1|256|384|512)|md5)-[A-Za-z0-9+/=]+                                                         # integrity digests
    |[0-9][0-9TZ+/_=-]*                                                                               # numbers, dates, phones
    """
)
_IDENTIFIER = re.compile(r"([A-Za-z]+[0-9]{0,4}|[0-9]{1,4})([_/=+-]+([A-Za-z]+[0-9]{0,4}|[0-9]{1,4}))*[_/=+-]*")


@functools.cache
def vocabulary(path: str):
    """The tiktoken encoding of a file of ranks, once a process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by the fixed patterns, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    # The first 32 characters of a run of 32 or more start where the run does, so this finds whole runs.
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def dense_spans(text: str, base: list[tuple[int, int, int]], encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """Candidates with few characters per token that no base span touches; a candidate has MIN_LENGTH characters or more."""
    found = []
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if not any(map(str.isalpha, s)) or _KNOWN.fullmatch(s):
            continue
        if any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        strict = not any(map(str.isdigit, s)) or _IDENTIFIER.fullmatch(s)
        if len(s) < (min(STRICT_RATIO, max_ratio) if strict else max_ratio) * len(encoding.encode_ordinary(s)):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, ranks: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` without text, with n_assign, n_access, n_hex, n_dense, base_spans and spans.

    ``ranks`` is the path of a tiktoken vocabulary on every machine. A null text is empty;
    columns of these names are replaced, others carried along.
    """
    made = T.StructType([T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_dense")] + [T.StructField(n, T.StringType()) for n in ("base_spans", "spans")])
    keep = [f for f in docs.schema.fields if f.name != "text" and f.name not in made.fieldNames()]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(ranks)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = dense_spans(text, base, encoding, max_ratio)
                n = [sum(1 for s in base if s[1] == k) for k in range(3)]
                rows.append((*n, len(more), joined(base), joined(base + more)))
            columns = list(zip(*rows, strict=True)) or [()] * len(made)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[*names, *made.fieldNames()])

    return in_batches(docs.select(*names, "text")).mapInArrow(run, T.StructType([*keep, *made.fields]))


def redact(text: str | None, spans: str, mask: str = "[SECRET]") -> str | None:
    """A text with its spans replaced; overlapping spans become one mask."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(","))):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
