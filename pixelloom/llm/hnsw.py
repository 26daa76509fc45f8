"""Approximate nearest neighbours by inner product: one HNSW graph per shard.

Vectors are dealt into shards by a hash; each shard becomes a hierarchical navigable
small-world graph, stored as flat arrays: one row per shard with the vectors, and for
each level the members and a rectangular array of neighbours.  Every query searches the
graph of every shard (queries travel in blocks, keyed by shard), and the shards' results
are merged by a ranked window.

* Inner product is turned into distance by one extra dimension (norms are completed to
  the largest norm, a single corpus aggregate), so vectors need no unit length.
* Equal vectors form one node, with the ``k + 1`` smallest ids: no query can need more
  of them, so the answer stays exact about ties and a very common vector is no hot group
  (the window limit is applied before the shuffle as well).
* Within a shard of ``SHARD_ROWS`` nodes candidates for a node's links come from blocked
  exact search, then the usual diversity rule keeps links in different directions; some
  of the nearest stay in any case.  Each level's members are a fixed share of the level
  below, by hash.  Building is linear in the number of shards.
* Search is beam search from the top level down, for all queries of a block at once.

Scores are inner products of the original vectors in double precision; single precision
serves the walk through the graph alone.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of other dimensions are compared among themselves
only; rows that repeat id and vector count once; ties go to the smaller id; with fewer
than ``k`` candidates all are given; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARD_ROWS = 8192
BLOCK_QUERIES = 512
LINKS = 24  # at the lowest level; half of it above
BEAM = 96
LEVEL_SHARE = 16
ENTRY = 64


# ---------------------------------------------------------------- one shard


def _level(x: np.ndarray, links: int, candidates: int) -> np.ndarray:
    """Neighbour array (rows by links) among the rows of ``x``, with reverse links."""
    n = len(x)
    if n <= 1:
        return np.zeros((n, 1), np.int32)
    c = min(candidates, n - 1)
    sq = (x**2).sum(1)
    out = np.zeros((n, min(links, c)), np.int32)
    for a in range(0, n, 512):
        b = min(n, a + 512)
        d = sq[None, :] - 2 * x[a:b] @ x.T
        d[np.arange(b - a), np.arange(a, b)] = np.inf
        near = np.argpartition(d, c - 1, axis=1)[:, :c]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        blocked = x[a:b]
        full = np.concatenate([blocked, x[near.reshape(-1)]])
        local = np.arange(b - a, len(full)).reshape(b - a, c)
        picked = _diverse_local(full, b - a, local, min(links, c))
        out[a:b] = np.take_along_axis(near, picked, 1)
    # Reverse links, so that every node can be reached: up to as many again.
    back: list[list[int]] = [[] for _ in range(n)]
    for j in range(out.shape[1]):
        for i, t in enumerate(out[:, j].tolist()):
            if len(back[t]) < links:
                back[t].append(i)
    both = np.tile(np.arange(n, dtype=np.int32)[:, None], (1, out.shape[1] + links))
    both[:, : out.shape[1]] = out
    for i, r in enumerate(back):
        both[i, out.shape[1] : out.shape[1] + len(r)] = r
    return both


def _diverse_local(full: np.ndarray, n: int, local: np.ndarray, links: int) -> np.ndarray:
    """Places of each row's links among its candidates (ascending distance): a candidate
    is kept unless it is nearer to one kept before it than to the row; the nearest of
    the others fill up."""
    c = local.shape[1]
    kept = np.zeros((n, c), bool)
    v = full[local]
    d0 = ((v - full[:n, None, :]) ** 2).sum(2)
    gram = v @ v.transpose(0, 2, 1)
    sq = (v**2).sum(2)
    kept[:, 0] = True
    for j in range(1, c):
        d = sq[:, :j] + sq[:, j : j + 1] - 2 * gram[:, :j, j]
        kept[:, j] = ~((d < d0[:, j : j + 1]) & kept[:, :j]).any(1)
    return np.argsort(~kept, axis=1, kind="stable")[:, :links]


def build(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, neighbours) per level, lowest first; neighbours are row numbers."""
    n = len(x)
    order = np.argsort(((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11), kind="stable")
    levels = []
    size = n
    while True:
        members = np.sort(order[:size]).astype(np.int32)
        links = LINKS if size == n else LINKS // 2
        levels.append((members, members[_level(x[members], links, 2 * LINKS)]))
        if size <= ENTRY:
            return levels
        size = max(1, size // LEVEL_SHARE)


def search(x: np.ndarray, levels, q: np.ndarray, beam: int, k: int) -> np.ndarray:
    """The ``k`` nearest rows found for each query (-1 where there are fewer)."""
    m = len(q)
    top = levels[-1][0]
    start = top[np.argmax(q @ x[top].T, axis=1)][:, None]
    for depth in range(len(levels) - 1, -1, -1):
        members, near = levels[depth]
        at = np.full(len(x), -1, np.int32)
        at[members] = np.arange(len(members))
        width = beam if depth == 0 else max(8, beam // 8)
        start = _beam(x, at, near, q, start, width)
    found = start[:, :k]
    return found if found.shape[1] == k else np.pad(found, ((0, 0), (0, k - found.shape[1])), constant_values=-1)


def _beam(x, at, near, q, start, width) -> np.ndarray:
    m, s = start.shape
    ids = np.full((m, width), -1, np.int64)
    score = np.full((m, width), -np.inf, np.float32)
    done = np.ones((m, width), bool)
    seen = np.zeros((m, len(x)), bool)
    s = min(s, width)
    ok = start[:, :s] >= 0
    ids[:, :s] = start[:, :s]
    first = np.einsum("mkd,md->mk", x[np.maximum(ids[:, :s], 0)], q)
    score[:, :s] = np.where(ok, first, -np.inf)
    done[:, :s] = ~ok
    r, c = np.nonzero(ok)
    seen[r, ids[r, c]] = True
    live = np.arange(m)
    step = 3  # nodes opened at a time
    while len(live):
        opened = np.argsort(np.where(done[live], np.inf, -score[live]), axis=1, kind="stable")[:, :step]
        rows = np.repeat(live, opened.shape[1])
        cols = opened.reshape(-1)
        fresh = ~done[rows, cols]
        done[rows, cols] = True
        node = np.where(fresh, ids[rows, cols], -1).reshape(len(live), -1)
        next_ = near[at[np.maximum(node, 0)]]
        next_ = np.where((node >= 0)[:, :, None], next_, -1).reshape(len(live), -1)
        next_ = np.sort(next_, axis=1)  # repeats side by side
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
        new = (next_ >= 0) & ~seen[live[:, None], np.maximum(next_, 0)]
        r, c = np.nonzero(new)
        seen[live[r], next_[r, c]] = True
        got = np.full(next_.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("nd,nd->n", x[next_[r, c]], q[live[r]])
        all_ids = np.concatenate([ids[live], next_], 1)
        all_score = np.concatenate([score[live], got], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        keep = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
        keep = np.take_along_axis(keep, np.argsort(-np.take_along_axis(all_score, keep, 1), axis=1, kind="stable"), 1)
        ids[live] = np.take_along_axis(all_ids, keep, 1)
        score[live] = np.take_along_axis(all_score, keep, 1)
        done[live] = np.take_along_axis(all_done, keep, 1)
        ids[live] = np.where(np.isfinite(score[live]), ids[live], -1)
        done[live] |= ids[live] < 0
        live = live[~done[live].all(1)]
    return ids


# ---------------------------------------------------------------- on Spark


def usable(vector):
    """True for vectors that take part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def _points(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    return vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """One row per shard (dim, shard, index as binary), staged, and the number of shards."""
    points = _points(vectors, key, vector)
    size = points.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("m")).first()
    largest = math.sqrt(size["m"]) if size["m"] else 1.0
    shards = max(1, math.ceil(size["n"] / shard_rows))
    same = Window.partitionBy("v").orderBy("vec_id")
    few = points.distinct().withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    nodes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 each
    nodes = nodes.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ids", key=lambda s: s.map(lambda a: a[0]))
        raw = np.stack(frame["v"].to_numpy()).astype(float)
        lists = [np.asarray(a, np.int64) for a in frame["ids"]]
        norm = ((raw / largest) ** 2).sum(1)
        x = np.column_stack([raw / largest, np.sqrt(np.maximum(0, 1 - norm))]).astype(np.float32)
        levels = build(x)
        flat = {"raw": raw, "x": x, "ids": np.concatenate(lists), "at": np.cumsum([0] + [len(a) for a in lists])}
        for i, (members, near) in enumerate(levels):
            flat[f"members{i}"], flat[f"near{i}"] = members, near
        return pd.DataFrame({"dim": [int(frame["dim"].iloc[0])], "shard": [int(frame["shard"].iloc[0])], "index": [_pack(flat)]})

    index = nodes.groupBy("dim", "shard").applyInPandas(one, "dim int, shard int, index binary")
    return stage(index, "hnsw"), shards


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    import io

    with np.load(io.BytesIO(data)) as z:
        return {name: z[name] for name in z.files}


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, beam: int = BEAM, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of ``vectors`` found for each row
    of ``queries``, without the row of the query's own id."""
    index, shards = build_index(vectors, key, vector, k, shard_rows)
    asked = _points(queries, key, vector).distinct()
    blocks = max(1, math.ceil(asked.count() / block))
    asked = asked.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    # Blocks of about ``block`` queries, once for each shard of their dimension.
    packed = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    jobs = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    jobs = jobs.join(index, ["dim", "shard"]).select("dim", "shard", "q", "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, z, levels = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                shard = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if shard != held:
                    held, z = shard, _unpack(batch.column(3)[i].as_py())
                    levels = [(z[f"members{j}"], z[f"near{j}"]) for j in range(sum(n.startswith("near") for n in z))]
                asks = batch.column(2)[i].as_py()
                own = np.array([a["vec_id"] for a in asks], np.int64)
                raw = np.array([a["v"] for a in asks], float)
                length = np.abs(raw).max(1, keepdims=True)  # a query's length does not change its order
                q = np.column_stack([raw / length, np.zeros(len(raw))]).astype(np.float32)
                yield _merge(z, search(z["x"], levels, q, max(beam, k + 1), max(beam, k + 1)), own, raw, k)

    found = jobs.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _merge(z, found, own, raw, k) -> pa.RecordBatch:
    """The block's candidates with exact scores, the ``k`` best of each query."""
    r, c = np.nonzero(found >= 0)
    node = found[r, c]
    score = np.einsum("nd,nd->n", raw[r], z["raw"][node])
    n = (z["at"][node + 1] - z["at"][node]).astype(np.int64)
    total = int(n.sum())
    at = np.repeat(z["at"][node] - (np.cumsum(n) - n), n) + np.arange(total)
    who, ids, s = np.repeat(r, n), z["ids"][at], np.repeat(score, n)
    other = ids != own[who]
    who, ids, s = who[other], ids[other], s[other]
    order = np.lexsort((ids, -s, who))
    who, ids, s = who[order], ids[order], s[order]
    first = np.searchsorted(who, who, "left")
    keep = np.arange(len(who)) - first < k
    return pa.RecordBatch.from_arrays([pa.array(own[who[keep]]), pa.array(ids[keep]), pa.array(s[keep])], names=["query_id", "vec_id", "score"])
