"""N-gram Jaccard join by PartEnum signatures, and the connected classes of its links.

A document's set holds its distinct five-word shingles; two documents link when their
sets' Jaccard similarity is at least ``PERCENT`` / 100.  The join is exact.

*Bands.*  Sizes fall into bands ``[L, 5L/4]``; two sets that link lie in one band or in
neighbouring ones, so a set takes part in its own band's instance and, if it is large
enough, in the next one's.  Within an instance with largest size ``u`` two sets that link
differ in at most ``k = 2u/9`` shingles.

*Signatures.*  An instance partitions the domain of shingles (by hash) on two levels:
into blocks, and each block into parts.  The signatures are the subsets of two parts of a
block, so none stands for a single part.  Up to ``k = 3`` there is one block of ``k + 4``
parts; beyond, about ``3/5 (k + 1)`` blocks of three parts.  Two sets that link share at
least ``scheme(j).least`` signatures, wherever their differences fall.  Empty subsets are
not emitted unless a set has that many of them.

*Buckets.*  Signatures travel as packed arrays of 12-byte entries, one row per bucket and
Arrow batch.  In a bucket, each group of equal signatures gives a star of candidate pairs
(its least member with every other) with counts, never all pairs.  A signature that many
sets of one batch share (a passage, a licence) is split before it travels: its least member
stands for the batch in the bucket, the others go to buckets by their own hash.  Pairs that
meet in half of the signatures they would have to share are verified first; they give most
components.  What may still link across components is found by ``_remaining``: exactly, and
without pairs in large groups (a passage that many documents share) unless sets have little
else.

Equal sets form one class before any of this, whose least key represents it.  Nothing is
collected to the driver; components are found by rounds of label minima and pointer
jumping over staged tables.

Defined results: a null text counts as empty; sets without shingles link with nothing;
rows that repeat a key are judged each by its own text, and share the key's links; a null
key takes part in the class of its equals only; other columns are ignored (or kept, in
``one_of_each``); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plan_bytes, stage, unstage

SHINGLE, PERCENT = 5, 80
MIN_BUCKETS, BUCKET_BYTES = 256, 16 << 20
#: Bytes of signatures per byte of stored input, as measured; sets the number of buckets.
GROWTH = 2.5
#: Rounds of single tries at most; they save work and decide nothing.
TURNS = 8
SLICE = 16 << 20

#: 64-bit words of a set's bitmap, by which pairs that cannot link are told early.
WORDS = 16
ENTRY = np.dtype([("sig", "<u4"), ("ref", "<u8")])
#: From so many sets of a batch on, a signature's members travel apart.
CROWD = 64
MEMBER = np.dtype([("group", "<u8"), ("head", "<u8"), ("ref", "<u8")])
#: A set's groups are compared in runs of about so many when pairs are found once only.
RUN = 64
#: Shingles that a verifying task keeps at most, beside the pair at hand.
HELD = 8 << 20
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("d1", "<u8"), ("d2", "<u8"), ("n", "<i4"), ("e0", "<i4"), ("e1", "<i4"), ("bits", "<i8", WORDS)])
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(body: bytes) -> np.ndarray:
    """The set as sorted hashes: A-Z lower-cased, split at ASCII white space."""
    words = body.lower().split()
    if not words:
        return np.zeros(0, U)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    m = max(1, len(w) - SHINGLE + 1)
    h = np.full(m, U(min(len(w), SHINGLE)))
    for j in range(min(SHINGLE, len(w))):
        h = mix(h + w[j : j + m])
    return np.unique(h)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def bitmap(s: np.ndarray) -> np.ndarray:
    """One bit per hash bucket that holds a shingle of the set."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(s >> U(32)) % U(64 * WORDS)] = 1
    return np.packbits(bits).view(np.int64)


_FROM = [5]


def band(j: int) -> tuple[int, int]:
    """Smallest and largest size of band ``j``."""
    while len(_FROM) <= j + 1:
        _FROM.append(_FROM[-1] * 100 // PERCENT + 1)
    return _FROM[j], _FROM[j + 1] - 1


def instances(size: int) -> list[tuple[int, int]]:
    """(instance, 0 for the set's own band or 1 for the next) that a set takes part in."""
    if size < 4:
        return []
    while _FROM[-1] <= size:
        band(len(_FROM))
    own = bisect_right(_FROM, size) - 1
    out = [(own, 0)] if own >= 0 else []
    if 100 * size >= PERCENT * band(own + 1)[0]:
        out.append((own + 1, 1))
    return out


class Scheme(NamedTuple):
    blocks: int
    parts: int  # of each block
    least: int  # signatures that two sets that link share, or more
    count: int  # signatures in all


@lru_cache(maxsize=4096)
def scheme(j: int) -> Scheme:
    """How instance ``j`` partitions the domain.

    A block of three parts has three subsets of two; one difference in it spoils two of
    them, a second one in another part the third.  So ``k`` differences leave fewest when
    they first fall into one block each: ``3 b - 2 k`` of ``b`` blocks, or ``2 b - k`` if
    ``k > b``."""
    k = 2 * band(j)[1] * (100 - PERCENT) // (100 + PERCENT)
    if k <= 3:
        return Scheme(1, k + 4, 6, (k + 4) * (k + 3) // 2)
    b = max(-(-(k + 6) // 2), -(-3 * (k + 1) // 5))
    return Scheme(b, 3, 3 * b - 2 * k if k <= b else 2 * b - k, 3 * b)


@lru_cache(maxsize=256)
def _subsets(j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two parts of each signature, and what tells signatures and instances apart."""
    blocks, parts, _, count = scheme(j)
    two = np.array(list(combinations(range(parts), 2)))
    at = (np.arange(blocks)[:, None, None] * parts + two).reshape(-1, 2)
    return at[:, 0], at[:, 1], mix(np.arange(1, count + 1, dtype=U) + U(j << 40))


def signatures(s: np.ndarray, j: int) -> tuple[np.ndarray, int]:
    """The signatures of set ``s`` in instance ``j`` and the number of empty ones."""
    blocks, parts, least, _ = scheme(j)
    part = (s % U(blocks * parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    count = np.bincount(part, minlength=blocks * parts)
    run = np.concatenate((np.zeros(1, U), np.cumsum(mix(s + U(j))[order], dtype=U)))
    stop = np.cumsum(count)
    value = run[stop] - run[stop - count]
    a, b, tags = _subsets(j)
    empty = (count[a] == 0) & (count[b] == 0)
    sig = mix(value[a] * U(0x9E3779B97F4A7C15) + mix(value[b]) + tags)
    e = int(empty.sum())
    return (sig if e >= least else sig[~empty]), e


# ---------------------------------------------------------------- passes


def group_of(sig: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The name of a crowded group, from what a bucket knows of its signature."""
    return mix((sig << U(32)) + bucket.astype(U) + U(1))


def split_crowds(sig: np.ndarray, ref: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures and refs without all but the least member (marked by bit 1) of each
    signature that CROWD or more sets of the batch share; and these other members."""
    slot = ((sig >> U(8)) & U(0xFFFFF)).astype(np.int32)
    maybe = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= CROWD)
    order = maybe[np.lexsort((ref[maybe], sig[maybe]))]
    own = sig[order]
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    size = np.diff(np.append(start, len(own)))
    crowd = np.repeat(size >= CROWD, size)
    head = np.repeat(start, size)
    marked = order[start[size >= CROWD]]
    gone = crowd & (head != np.arange(len(own)))
    apart = np.empty(int(gone.sum()), MEMBER)
    apart["group"] = group_of(own[gone] >> U(32), own[gone] % U(buckets))
    apart["head"], apart["ref"] = ref[order][head[gone]], ref[order][gone]
    ref[marked] |= U(2)
    stay = np.ones(len(sig), bool)
    stay[order[gone]] = False
    return sig[stay], ref[stay], apart


def _emit(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """Rows (bucket, kind, data): packed documents (kind 0), signatures (kind 1) and members
    of crowded groups (kind 3)."""

    def flush(ids, bodies) -> pa.RecordBatch:
        table = np.zeros(len(bodies), DOC)
        sigs, refs, known = [], [], set()
        for i, b in enumerate(bodies):
            s = shingles(b)
            d1, d2 = digest(s) if len(s) else (0, 0)
            table[i] = (ids[i] or 0, ids[i] is None, d1, d2, len(s), 0, 0, bitmap(s))
            for j, later in instances(len(s)):
                sig, e = signatures(s, j)
                table[i]["e1" if later else "e0"] = e
                if (d1, later) not in known:  # equal sets of a batch count once
                    known.add((d1, later))
                    sigs.append(sig)
                    refs.append(np.full(len(sig), U(d1 & ~3 | later)))
        rows: list[tuple[int, int, bytes]] = []
        of = (mix(table["id"].astype(U) + np.arange(len(table), dtype=U)) % U(buckets)).astype(np.int32)
        for k in np.unique(of):
            rows.append((int(k), 0, table[of == k].tobytes()))
        if sigs:
            sig, ref = np.concatenate(sigs), np.concatenate(refs)
            sig, ref, apart = split_crowds(sig, ref, buckets)
            of = (mix(apart["ref"]) % U(buckets)).astype(np.int32)
            rows += [(int(k), 3, apart[of == k].tobytes()) for k in np.unique(of)]
            of = (sig % U(buckets)).astype(np.int32)
            order = np.argsort(of, kind="stable")
            entry = np.empty(len(sig), ENTRY)
            entry["sig"], entry["ref"] = (sig >> U(32))[order], ref[order]
            stop = np.cumsum(np.bincount(of, minlength=buckets))
            start = np.concatenate(([0], stop[:-1]))
            rows += [(k, 1, entry[start[k] : stop[k]].tobytes()) for k in np.flatnonzero(stop > start).tolist()]
        b, kind, data = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(kind, pa.int8()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bodies, size = [], [], 0
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(k)
                bodies.append(b.as_py() or b"")
                size += len(bodies[-1])
                if size > SLICE:
                    yield flush(ids, bodies)
                    ids, bodies, size = [], [], 0
        if ids:
            yield flush(ids, bodies)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("body"))
    return rows.mapInArrow(run, "bucket int, kind byte, data binary")


#: kind 0: a document (x key, y z digest, n size, e e2 empties, bitmap).  The others name refs, with the
#: instance in the lowest bit: 1: pair (x, y) in e groups, of two (n 0) or more (n 1); 2: group
#: member (x group, y ref) in e groups of these same members.
FOUND = "kind byte, x long, y long, z long, n int, e int, e2 int, bits array<bigint>"


def _bucket(table: pa.Table) -> pa.Table:
    kinds = table.column("kind").to_numpy()
    data = table.column("data")
    read = lambda kind, dtype: np.frombuffer(b"".join(data[i].as_py() for i in np.flatnonzero(kinds == kind)), dtype)
    docs, entry, apart = read(0, DOC), read(1, ENTRY), read(3, MEMBER)
    out = [_rows(0, docs["id"], docs["d1"], docs["d2"], docs["n"], docs["e0"], docs["e1"], null=docs["null"] == 1, bits=docs["bits"])]
    if len(apart):
        out.append(_stars(apart["head"], apart["ref"], 1))
        out.append(_rows(2, apart["group"], apart["ref"], e=np.ones(len(apart))))
    if len(entry):
        order = np.lexsort((entry["ref"] & ~U(2), entry["sig"]))
        sig, ref = entry["sig"][order].astype(U), entry["ref"][order]
        marked = ref & U(2) > 0
        ref = ref & ~U(2)
        same = np.zeros(len(sig), bool)  # a set that several batches hold
        same[1:] = (sig[1:] == sig[:-1]) & (ref[1:] >> U(2) == ref[:-1] >> U(2))
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        crowd = np.repeat(np.logical_or.reduceat(marked, start), np.diff(np.append(start, len(sig))))
        sig, ref, crowd = sig[~same], ref[~same], crowd[~same]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(start, len(sig)))
        wide = np.repeat(size, size)
        head = np.repeat(start, size)
        star = head != np.arange(len(sig))
        for flag, take in ((0, star & (wide == 2) & ~crowd), (1, star & ((wide > 2) | crowd))):  # pairs that meet as two, stars of larger groups
            out.append(_stars(ref[head[take]], ref[take], flag))
        if crowd.any():
            out.append(_rows(2, group_of(sig[crowd], np.full(int(crowd.sum()), table.column("bucket")[0].as_py())), ref[crowd], e=np.ones(int(crowd.sum()))))
        big = np.flatnonzero((size > 2) & ~crowd[start])
        if len(big):
            total = np.add.reduceat(mix(ref), start)[big] + size[big].astype(U)
            total, first, count = np.unique(total, return_index=True, return_counts=True)
            pick = big[first]
            at = np.repeat(start[pick] - (np.cumsum(size[pick]) - size[pick]), size[pick]) + np.arange(size[pick].sum())
            out.append(_rows(2, np.repeat(total, size[pick]), ref[at], e=np.repeat(count, size[pick])))
    return pa.concat_tables(out)


def _stars(head: np.ndarray, ref: np.ndarray, flag: int) -> pa.Table:
    pairs, count = np.unique(np.column_stack([head, ref]), axis=0, return_counts=True)
    return _rows(1, pairs[:, 0], pairs[:, 1], n=np.full(len(pairs), flag), e=count)


def _rows(kind, x, y=None, z=None, n=None, e=None, e2=None, null=None, bits=None) -> pa.Table:
    m = len(x)
    long = lambda v: pa.array(np.zeros(m, np.int64) if v is None else np.ascontiguousarray(v).astype(np.uint64, copy=False).view(np.int64) if v.dtype == U else np.ascontiguousarray(v).astype(np.int64))
    small = lambda v: pa.array(np.zeros(m, np.int32) if v is None else np.ascontiguousarray(v).astype(np.int32))
    first = long(x) if null is None else pa.array(np.ascontiguousarray(x).astype(np.int64), mask=np.ascontiguousarray(null))
    lists = pa.nulls(m, pa.list_(pa.int64())) if bits is None else pa.ListArray.from_arrays(pa.array(np.arange(0, WORDS * m + 1, WORDS, dtype=np.int32)), pa.array(np.ascontiguousarray(bits).reshape(-1).astype(np.int64)))
    return pa.table([pa.array(np.full(m, kind, np.int8)), first, long(y), long(z), small(n), small(e), small(e2), lists], names=["kind", "x", "y", "z", "n", "e", "e2", "bits"])


#: A component's label is one key of many rows; joins on it are spread over so many.
SALT = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's connected component, for the nodes of
    ``edges`` (u, v).  Staged."""
    both = stage(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        heads = labels.select("label").distinct().join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").filter("far < label")
        jump = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = labels.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
        step = salted.join(jump, ["label", "salt"], "left").join(near, "node").select("node", F.least("label", "m", "far").alias("label"), F.col("label").alias("was"))
        after = stage(step, "labels")
        changed = after.filter("label <> was").limit(1).count()
        unstage(labels)
        labels = after
        if not changed:
            unstage(both)
            return labels.select("node", "label")


def _texts(refs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """ref, d1, d2, rep, body of the classes named by ``refs`` (ref).  Staged."""
    reps = refs.distinct().join(classes, "ref").select("ref", "d1", "d2", "rep").filter("rep is not null")
    bodies = docs.select(F.col(f"`{key}`").cast("long").alias("rep"), F.col(f"`{text}`").cast("binary").alias("body"))
    return stage(reps.join(bodies, "rep"), "texts")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) keys of the classes whose sets link, among candidate pairs (x, y) of refs."""
    a = texts.select(F.col("ref").alias("x"), F.col("rep").alias("ra"), F.col("d1").alias("da"), F.col("d2").alias("da2"), F.col("body").alias("ba"))
    b = texts.select(F.col("ref").alias("y"), F.col("rep").alias("rb"), F.col("d1").alias("db"), F.col("d2").alias("db2"), F.col("body").alias("bb"))
    joined = pairs.join(a, "x").join(b, "y").select("ra", "da", "da2", "ba", "rb", "db", "db2", "bb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()
        size = 0

        def set_of(d: tuple[int, int], body: bytes) -> np.ndarray | None:
            """The class's set; none if this row of the key has another text."""
            nonlocal size
            at = (d, len(body))
            if at in held:
                held.move_to_end(at)
                return held[at]
            s = shingles(body)
            held[at] = s if tuple(np.array(digest(s), U).view(np.int64).tolist()) == d else None
            size += len(s) if held[at] is not None else 0
            while size > HELD and len(held) > 2:
                old = held.popitem(last=False)[1]
                size -= len(old) if old is not None else 0
            return held[at]

        for batch in batches:
            us, vs = [], []
            ra, da, da2, ba, rb, db, db2, bb = batch.columns
            for i in range(batch.num_rows):
                s, t = set_of((da[i].as_py(), da2[i].as_py()), ba[i].as_py() or b""), set_of((db[i].as_py(), db2[i].as_py()), bb[i].as_py() or b"")
                if s is None or t is None or PERCENT * max(len(s), len(t)) > 100 * min(len(s), len(t)):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= PERCENT * (len(s) + len(t) - both):
                    us.append(ra[i].as_py())
                    vs.append(rb[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return stage(joined.mapInArrow(run, "u long, v long").filter("u <> v").distinct(), "links")


def _nodes(classes: DataFrame) -> DataFrame:
    """One row per class and instance: ref, size, inst, least (shared signatures of two sets
    that link in it), empty (its signatures that may be empty and, here or in a partner, not
    emitted), runs (into how many its groups are split in ``_across``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for ref, n, e0, e1 in zip(f["ref"], f["n"], f["e0"], f["e1"]):
                for j, later in instances(int(n)):
                    plan, e = scheme(j), e1 if later else e0
                    rows.append((ref | later, n, j, plan.least, min(e, plan.least - 1), max(1, plan.count // RUN)))
            yield pd.DataFrame(rows, columns=["ref", "size", "inst", "least", "empty", "runs"])

    own = classes.groupBy("ref").agg(F.max("n").alias("n"), F.max("e0").alias("e0"), F.max("e1").alias("e1"))
    return stage(own.mapInPandas(run, "ref long, size int, inst int, least int, empty int, runs int"), "nodes")


def _plain(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of classes, without the instance bit, least first."""
    plain = lambda c: F.col(c).bitwiseAND(F.lit(-4))
    return pairs.select(F.least(plain("x"), plain("y")).alias("x"), F.greatest(plain("x"), plain("y")).alias("y")).filter("x <> y").distinct()


def _likely(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that meet in half of the signatures they would have to share, or more."""
    a = nodes.select(F.col("ref").alias("x"), F.col("size").alias("sx"), "least", F.col("inst").alias("ix"))
    b = nodes.select(F.col("ref").alias("y"), F.col("size").alias("sy"), F.col("inst").alias("iy"))
    enough = met.filter("c > 2").join(a, "x").filter(2 * F.col("c") >= F.col("least"))  # least is never below 6
    both = enough.join(b, "y").filter((F.col("ix") == F.col("iy")) & (100 * F.least("sx", "sy") >= PERCENT * F.greatest("sx", "sy")))
    return _plain(both)


def _remaining(members: DataFrame) -> DataFrame:
    """The group rows in which all pairs across components meet that may still link.

    ``members``: g, y (ref), w (signatures with this group), label, size, inst, least, empty.
    A pair that links across components shares ``least`` signatures, all in groups that span
    components (or empty in both).  So (1) groups within one component go, and sets that have
    too few signatures left go, in turn, until little changes; (2) of each set only the
    smallest groups are kept, up to the weight that leaves fewer than ``least`` outside: two
    sets that share ``least`` share one of these (the smallest they share).  Large groups
    (passages that many documents share) are the last in this order."""
    held, before = stage(members, "members"), None
    while True:
        groups = held.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).filter("lo <> hi").select("g", "m")
        open_ = held.drop("m", "u").join(groups, "g")
        enough = open_.groupBy("y").agg(F.sum("w").alias("u"), F.max(F.col("least") - F.col("empty")).alias("need")).filter("u >= need").select("y", "u")
        after = stage(open_.join(enough, "y"), "members")
        n = after.count()
        unstage(held)
        held = after
        if n == 0 or before is not None and n > 0.9 * before:
            break
        before = n
    ahead = F.coalesce(F.sum("w").over(Window.partitionBy("y").orderBy("m", "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = stage(held.withColumn("ahead", ahead).filter("ahead < u + empty - least + 1").select("g", "y", "label", "size", "inst", "runs"), "prefix")
    unstage(held)
    return out


def _across(prefix: DataFrame, bits: DataFrame) -> DataFrame:
    """All pairs of a group across components, of one instance, that can link by their sizes
    and bitmaps: a bit that only one set has is a shingle that only it has.

    Large sets share many groups.  A set's groups are dealt into runs of about RUN by their
    names, and a pair is made only in the first group that both have in a run, which each
    row's earlier groups of the run tell.  So rows carry a bounded list, and a pair is made
    once for RUN groups at most."""
    runs = prefix.groupBy("y", F.pmod("g", "runs").alias("run")).agg(F.sort_array(F.collect_list("g")).alias("gs"), *[F.first(c).alias(c) for c in ("label", "size", "inst")])
    rows = runs.withColumn("ref", F.col("y").bitwiseAND(F.lit(-4))).join(bits, "ref")
    rows = rows.select("y", "label", "size", "inst", "bits", "gs", F.posexplode("gs").alias("i", "g"))
    rows = rows.withColumn("before", F.slice("gs", F.lit(1), F.col("i")))
    a = rows.select("g", F.col("y").alias("x"), F.col("size").alias("sx"), F.col("label").alias("lx"), F.col("inst").alias("ix"), F.col("before").alias("bx"), *[F.get("bits", F.lit(i)).alias(f"a{i}") for i in range(WORDS)])
    b = rows.select("g", "y", F.col("size").alias("sy"), F.col("label").alias("ly"), F.col("inst").alias("iy"), F.col("before").alias("by"), *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(WORDS)])
    only = lambda u, v: sum((F.bit_count(F.col(f"{u}{i}").bitwiseAND(F.bitwise_not(F.col(f"{v}{i}")))) for i in range(1, WORDS)), F.bit_count(F.col(f"{u}0").bitwiseAND(F.bitwise_not(F.col(f"{v}0")))))
    shared = F.least(F.col("sx") - only("a", "b"), F.col("sy") - only("b", "a"))
    can = (F.col("lx") < F.col("ly")) & (F.col("ix") == F.col("iy")) & ((100 + PERCENT) * shared >= PERCENT * (F.col("sx") + F.col("sy")))
    return _plain(a.join(b, "g").filter(can & ~F.arrays_overlap("bx", "by")))


def _one_try(prefix: DataFrame, turn: int) -> DataFrame:
    """For each set one pair, with one member of one of its groups (other ones each turn)."""
    centre = prefix.groupBy("g").agg(F.min_by(F.struct("y", "label"), F.xxhash64("y", F.lit(turn))).alias("c"))
    tried = prefix.join(centre, "g").filter("label <> c.label").groupBy("y").agg(F.min_by("c.y", F.xxhash64("g", F.lit(turn))).alias("x"))
    return _plain(tried)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    size = plan_bytes(docs.select(f"`{text}`"))
    if size > 1 << 53:  # the optimizer does not know
        size = (docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0) // 2
    buckets = max(MIN_BUCKETS, int(GROWTH * size / BUCKET_BYTES))
    found = stage(_emit(docs, key, text, buckets).groupBy("bucket").applyInArrow(_bucket, FOUND), "found")
    rows = found.filter("kind = 0").select(F.col("x").alias("doc_id"), F.col("y").alias("d1"), F.col("z").alias("d2"), "n", F.col("e").alias("e0"), F.col("e2").alias("e1"), "bits")
    classes = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), *[F.max(c).alias(c) for c in ("n", "e0", "e1", "bits")])
    classes = stage(classes.withColumn("ref", F.col("d1").bitwiseAND(F.lit(-4))), "classes")

    nodes = _nodes(classes)
    met = stage(found.filter("kind = 1").groupBy("x", "y").agg(F.sum("e").alias("c"), F.sum(F.when(F.col("n") == 0, F.col("e"))).alias("twos")), "met")
    # Likely links first: they join most of what belongs together, and settle large groups.
    first = stage(_likely(met, nodes), "likely")
    texts = _texts(first.select(F.col("x").alias("ref")).union(first.select("y")), classes, docs, key, text)
    links = _verify(first, texts)
    unstage(texts)
    labels = components(links)

    # Then every pair across components that may still link.
    twos = met.filter("twos > 0").select(F.xxhash64("x", "y").alias("g"), F.explode(F.array("x", "y")).alias("y"), F.col("twos").alias("w"))
    members = found.filter("kind = 2").groupBy(F.col("x").alias("g"), "y").agg(F.sum("e").alias("w")).unionByName(twos)
    members = stage(members, "groups")
    unstage(met)
    known = nodes.withColumnRenamed("ref", "y").withColumn("ref", F.col("y").bitwiseAND(F.lit(-4)))
    reps = classes.groupBy("ref").agg(F.min("rep").alias("rep"))

    def remaining(labels: DataFrame) -> DataFrame:
        named = reps.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("ref", F.coalesce("label", "rep").alias("label"))
        return _remaining(members.join(known.join(named, "ref").drop("ref"), "y"))

    # In a large group of near copies many links lead to the same component: single tries
    # join most of it, while they find anything to speak of; then all pairs that are left.
    prefix = remaining(labels)
    texts = _texts(prefix.select(F.col("y").bitwiseAND(F.lit(-4)).alias("ref")), classes, docs, key, text)
    for turn in range(TURNS):
        tries = stage(_one_try(prefix, turn).join(first, ["x", "y"], "left_anti"), "tries")
        new, n_tries = _verify(tries, texts), tries.count()
        unstage(tries)
        n = new.count()
        if n:
            links = links.union(new)
            labels = components(links)
            unstage(prefix)
            prefix = remaining(labels)
        if 10 * n < n_tries or n == 0:
            break
    pairs = stage(_across(prefix, classes.groupBy("ref").agg(F.max("bits").alias("bits"))).join(first, ["x", "y"], "left_anti"), "pairs")
    more = _verify(pairs, texts)
    if more.limit(1).count():
        labels = components(links.union(more))
    for done in (members, nodes, first, prefix, pairs, texts):
        unstage(done)

    final = classes.select("d1", "d2", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("d1", "d2", F.coalesce("label", "rep").alias("component"))
    out = rows.join(final, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are not the least key of their component; of rows
    that repeat a key all stay."""
    gone = jaccard_components(docs, key, text).filter("component_id is not null and component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{key}`") == F.col("__gone"), "left_anti")


#: jaccard_components(documents) for small tables, in DuckDB SQL.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
f AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, u.b FROM r JOIN u ON r.reached = u.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.reached) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
