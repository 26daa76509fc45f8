r"""Secret scan by token efficiency.

Random strings compress badly under a byte-pair vocabulary: a password or key
takes about one token for each one to two characters, prose and identifiers take
far fewer.  The operator therefore

1. finds *base* spans with three fixed patterns (assignments, access keys, runs of
   hexadecimal digits), and
2. takes every maximal run of ``[A-Za-z0-9+/_-]`` of ``min_run`` characters or
   more, sets aside known digests (hexadecimal of a usual digest length, UUIDs),
   plain numbers and identifiers (runs made of parts that are themselves
   token-efficient), and reports as kind
   ``random`` those with fewer than ``max_chars_per_token`` characters a token,
   unless a base span holds them already.

Each document is read whole, as UTF-8 bytes inside an Arrow batch; runs are found
with vectorised class masks over slices of at most ``SLICE`` bytes of whole
documents (a longer document forms a slice of its own), so memory is bounded by
the longest document.  Nothing is shuffled.

Defined results: a null text counts as empty; repeated rows give repeated results;
a null key is passed through; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before the merges (fixed value, belongs to the vocabulary).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
#: What every match of ASSIGN begins with, in lower case.
HEADS = (b"passw", b"secret", b"token", b"api")
DIGEST = re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_SIZES = frozenset((32, 40, 48, 56, 64, 96, 128))
UUID = re.compile(rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
PART = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: From so many characters a token, a part of a run is a word; random letters take 1.3 to 1.8.
WORD_CHARS_PER_TOKEN = 2.5

SLICE = 4 << 20
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True


@lru_cache(maxsize=4)
def encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pixelloom", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: bytes) -> bool:
    """A digest, UUID or plain number, which is not a secret."""
    if UUID.match(run) or run.isdigit() or (len(run) in DIGEST_SIZES and DIGEST.match(run)):
        return True
    return not any(p.isalpha() for p in PART.findall(run))


def is_identifier(run: bytes, vocabulary: str = VOCABULARY) -> bool:
    """Made of words: most of its letters are in parts that the vocabulary knows in large
    pieces, in their own case or in lower case.  Length of a part tells nothing, as a
    random key of one letter case is a single part."""
    parts = [p.decode() for p in PART.findall(run)]
    letters = [p for p in parts if not p.isdigit()]
    if sum(map(len, parts)) - sum(map(len, letters)) > 0.25 * len(run):
        return False
    encode = encoding(vocabulary).encode_ordinary
    words = [p for p in letters if len(p) >= 3 and len(p) >= WORD_CHARS_PER_TOKEN * min(len(encode(p)), len(encode(p.lower())))]
    return sum(map(len, words)) >= 0.75 * sum(map(len, letters))


def _assignments(b: bytes) -> list[tuple[int, int]]:
    """All leftmost non-overlapping matches; a match can only start at a head."""
    low, at = b.lower(), []
    for head in HEADS:
        i = low.find(head)
        while i >= 0:
            at.append(i)
            i = low.find(head, i + 1)
    out, end = [], 0
    for i in sorted(at):
        if i >= end and (m := ASSIGN.match(b, i)):
            end = m.end()
            if m.end(1) - m.start(1) >= 12:
                out.append((m.start(), end))
    return out


def _runs(parts: list[bytes], min_run: int) -> list[list[tuple[int, int]]]:
    """Maximal runs of the run alphabet in each text, found over all at once."""
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    mask = np.concatenate(([False], _RUN[buf], [False])).view(np.int8)
    edge = np.flatnonzero(np.diff(mask))
    start, end = edge[::2], edge[1::2]
    long = end - start >= min_run
    start, end = start[long], end[long]
    first = np.cumsum([0] + [len(p) + 1 for p in parts])
    of = np.searchsorted(first, start, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    for d, s, e in zip(of.tolist(), start.tolist(), end.tolist()):
        out[d].append((s - int(first[d]), e - int(first[d])))
    return out


def scan(b: bytes, runs: list[tuple[int, int]], max_chars_per_token: float, vocabulary: str):
    """(kind number, start, end) in bytes, sorted as the digest wants them."""
    found = [(s, 0, e) for s, e in _assignments(b)]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(b)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(b)]
    base = list(found)
    for s, e in runs:
        run = b[s:e]
        if not is_known(run) and not any(p <= s and e <= q for p, _, q in base):
            n = len(encoding(vocabulary).encode_ordinary(run.decode("ascii")))
            if e - s < max_chars_per_token * n and not is_identifier(run, vocabulary):
                found.append((s, 3, e))
    return sorted(found)


def _result(b: bytes, found) -> tuple:
    if found and not b.isascii():  # bytes to code points
        cut = sorted({x for s, _, e in found for x in (s, e)})
        at, last, n = {}, 0, 0
        for x in cut:
            n += len(b[last:x].decode("utf-8", "replace"))
            at[x], last = n, x
        found = [(at[s], k, at[e]) for s, k, e in found]
    names = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in found]
    base = ",".join(x for k, x in names if k < 3)
    count = [sum(k == j for k, _ in names) for j in range(4)]
    return *count, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in names)


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", min_run: int = 16, max_chars_per_token: float = 1.8, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a document: counts by kind, the digest of the base spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            i, n = 0, batch.num_rows
            while i < n:
                parts, size, first = [], 0, i
                while i < n and (not parts or size < SLICE):
                    parts.append(texts[i].as_py() or b"")
                    size += len(parts[-1])
                    i += 1
                rows = [_result(b, scan(b, r, max_chars_per_token, vocabulary)) for b, r in zip(parts, _runs(parts, min_run))]
                columns = list(zip(*rows))
                arrays = [keys.slice(first, len(parts))] + [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("body"))
    return source.mapInArrow(run, SCHEMA)
