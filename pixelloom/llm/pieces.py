"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text is escaped as SentencePiece does it (a space becomes U+2581) and falls into
chunks: no piece crosses a space or a line end, so the piece lattice of a text is a
chain of the lattices of its chunks, and each can be sampled on its own.

*Forward filtering* gives each lattice node the sum of the weights of all paths that
lead to it; it is done once for each distinct chunk and kept in a table of bounded
size.  *Backward sampling* walks from the end of a chunk to its start and takes an
incoming edge with the probability of its share; it runs over all chunks of a slice of
texts at once with numpy.  The random numbers are hashes of (row key, chunk number,
step), so a row's segmentation depends on its key and text alone.

The weight of a piece is its rank's: ``1 / (rank + 10) ** alpha``.  Characters
without a piece become their bytes' pieces.  Decoding joins the pieces' bytes, and
gives the exact text back, literal U+2581 included.

Memory is bounded by ``MAX_EDGES`` cached edges, the slice and the longest text.
Nothing is shuffled.

Defined results: a null text counts as empty (no pieces); a null key has its own fixed
seed; rows with the same key and text get the same pieces; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581; no chunk of a text can look like this.
LITERAL = "\x00" + SPACE
ALPHA = 0.7
MAX_EDGES = 3_000_000
SLICE = 1 << 20
#: Chunks up to SHORT characters are filtered together, GROUP characters at a time.
SHORT, GROUP = 64, 30_000
HASH = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, n_pieces long, lossless boolean, ids array<int>"


class Lattice:
    """Forward-filtered chunks.  Node 0 is the start; each other node has its edges side
    by side, most likely first, with running shares that end at 1."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes: list[bytes] = []
        self.piece: dict[str, tuple[float, int]] = {}
        self.byte_id = [0] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(p.replace(SPACE, " ").encode())
                rank = min(max(0.0, -sp.get_score(i)), float(sp.get_piece_size()))
                if SPACE not in p[1:]:  # runs of spaces would cross chunks
                    self.piece[p] = ((rank + 10) ** -alpha, i)
        self.longest = max(map(len, self.piece))
        for b in range(128):  # an ASCII character without a piece has one byte: an edge like any other
            if chr(b) not in self.piece and b != 0:
                self.piece[chr(b)] = (1e-6, self.byte_id[b])
        # Every proper prefix of a piece, so that the search for longer ones can stop.
        self.stem = {p[:i] for p in self.piece for i in range(1, len(p))}
        self._trie()
        self.reset()

    def _trie(self) -> None:
        """The pieces as a trie in arrays: character classes, piece and weight of each
        trie node, and a hash table from (node, class) to node."""
        strings = sorted(self.stem | self.piece.keys())
        number = {s: k + 1 for k, s in enumerate(strings)}
        letters = sorted({c for s in strings for c in s})
        self.cls = np.zeros(0x110000, np.int64)
        self.cls[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.weight, self.at = np.zeros(len(strings) + 1), np.zeros(len(strings) + 1, np.int32)
        for s, (w, i) in self.piece.items():
            self.weight[number[s]], self.at[number[s]] = w, i
        self.root = np.zeros(self.width, np.int64)
        self.bits = max(4, (4 * len(strings)).bit_length())
        self.slot, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        for s in strings:
            if len(s) == 1:
                self.root[self.cls[ord(s)]] = number[s]
            else:
                key = number[s[:-1]] * self.width + int(self.cls[ord(s[-1])])
                h = (key * HASH % 2**64) >> (64 - self.bits)
                while self.slot[h] >= 0:
                    h = (h + 1) & ((1 << self.bits) - 1)
                self.slot[h], self.to[h] = key, number[s]

    def _next(self, key: np.ndarray) -> np.ndarray:
        h = ((key.astype(np.uint64) * np.uint64(HASH)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.slot[h] == key, self.to[h], 0)
        late = np.flatnonzero((self.slot[h] != key) & (self.slot[h] >= 0))
        while len(late):
            h[late] = (h[late] + 1) & ((1 << self.bits) - 1)
            got = self.slot[h[late]]
            hit = got == key[late]
            out[late[hit]] = self.to[h[late[hit]]]
            late = late[~hit & (got >= 0)]
        return out

    def add_many(self, new: list[str]) -> None:
        """Forward filtering of many chunks: array operations for short ones whose
        characters all have pieces, ``add`` for the others."""
        group: list[str] = []
        size = 0
        for c in new:
            if len(c) > SHORT or c[:1] == "\x00":
                self.add(c)
                continue
            group.append(c)
            size += len(c)
            if size > GROUP:
                self._add_group(group)
                group, size = [], 0
        if group:
            self._add_group(group)

    def _add_group(self, group: list[str]) -> None:
        length = np.array([len(c) for c in group])
        code = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self.cls[code]
        known = np.minimum.reduceat(self.weight[self.root[cls]] > 0, np.cumsum(length) - length)
        if not known.all():
            for c, ok in zip(group, known):
                if not ok:
                    self.add(c)
            group = [c for c, ok in zip(group, known) if ok]
            if group:
                self._add_group(group)
            return
        n, most = len(code), self.longest
        start = np.repeat(np.cumsum(length) - length, length)
        place = np.arange(n) - start
        left = np.repeat(length, length) - place
        weight, ids = np.zeros((n, most)), np.zeros((n, most), np.int32)
        who, node = np.arange(n), self.root[cls]
        for size in range(1, most + 1):
            w = self.weight[node]
            ok = w > 0
            weight[who[ok] + size - 1, size - 1] = w[ok]
            ids[who[ok] + size - 1, size - 1] = self.at[node[ok]]
            go = left[who] > size
            who, node = who[go], node[go]
            node = self._next(node * self.width + cls[who + size])
            who, node = who[node > 0], node[node > 0]
            if not len(who):
                break
        sums = np.zeros(n)
        order = np.argsort(place, kind="stable")
        bound = np.cumsum(np.bincount(place))
        for j in range(len(bound)):
            rows = order[bound[j - 1] if j else 0 : bound[j]]
            k = min(j + 1, most)
            before = np.ones((len(rows), k))
            for size in range(1, min(j, most) + 1):
                before[:, size - 1] = sums[rows - size]
            weight[rows, :k] *= before
            sums[rows] = weight[rows, :k].sum(1)
        weight, ids = weight[:, ::-1], ids[:, ::-1]  # the longest piece first: mostly the likeliest
        mask = weight > 0
        row, col = np.nonzero(mask)
        share = (np.cumsum(weight, 1) / sums[:, None])[mask]
        count = mask.sum(1)
        stop = np.cumsum(count)
        share[stop - 1] = 1.0
        size = most - col
        base, edge = len(self.first), len(self.id)
        self.share.frombytes(share.tobytes())
        self.id.frombytes(ids[mask].tobytes())
        self.prev.frombytes(np.where(size == place[row] + 1, 0, base + row - size).astype(np.int32).tobytes())
        self.first.frombytes((edge + stop - count).astype(np.int32).tobytes())
        self.end.update(zip(group, (base + np.cumsum(length) - 1).tolist()))

    def reset(self) -> None:
        self.share, self.id, self.prev = array("d", [2.0]), array("i", [0]), array("i", [0])
        self.first = array("i", [0])
        self.end: dict[str, int] = {"": 0}

    def _edge(self, share: float, piece: int, prev: int) -> None:
        self.share.append(share)
        self.id.append(piece)
        self.prev.append(prev)

    def _chain(self, data: bytes, prev: int) -> int:
        """Nodes for a run of byte pieces that have no choice."""
        for b in data:
            self.first.append(len(self.id))
            self._edge(1.0, self.byte_id[b], prev)
            prev = len(self.first) - 1
        return prev

    def add(self, chunk: str) -> int:
        """Forward filtering; returns the chunk's end node."""
        if chunk == LITERAL:
            self.end[chunk] = node = self._chain(SPACE.encode(), 0)
            return node
        n, get, stem = len(chunk), self.piece.get, self.stem
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            found = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                s = chunk[i:j]
                p = get(s)
                if p:
                    into[j].append((i, *p))
                    found |= j == i + 1
                if s not in stem:
                    break
            if not found:  # no piece of one character: its bytes
                into[i + 1].append((i, 1e-6, -1))
        sums, node = [1.0], [0] * (n + 1)
        share, ids, prev, first = self.share, self.id, self.prev, self.first
        for j in range(1, n + 1):
            edges = into[j]
            if len(edges) == 1:
                i, w, p = edges[0]
                total = sums[i] * w
                if p < 0:
                    c = chunk[i]
                    node[j] = self._chain(b" " if c == SPACE else c.encode("utf-8", "surrogatepass"), node[i])
                else:
                    node[j] = len(first)
                    first.append(len(ids))
                    share.append(1.0)
                    ids.append(p)
                    prev.append(node[i])
            else:
                edges = sorted(((sums[i] * w, i, p) for i, w, p in edges), reverse=True)
                total = sum([e[0] for e in edges])
                branch = []
                for a, i, p in edges:
                    if p < 0:  # a bytes edge among others: its last byte is the edge, the rest a chain
                        data = b" " if chunk[i] == SPACE else chunk[i].encode("utf-8", "surrogatepass")
                        branch.append((a, self.byte_id[data[-1]], self._chain(data[:-1], node[i])))
                    else:
                        branch.append((a, p, node[i]))
                node[j] = len(first)
                first.append(len(ids))
                run = 0.0
                for a, p, q in branch:
                    run += a
                    share.append(run / total)
                    ids.append(p)
                    prev.append(q)
                share[-1] = 1.0
            sums.append(total)
            if total < 1e-150:  # only ratios within the longest piece matter
                for k in range(max(0, j - self.longest), j + 1):
                    sums[k] *= 1e150
        self.end[chunk] = node[n]
        return node[n]

    def arrays(self):
        return np.frombuffer(self.share, float), np.frombuffer(self.id, np.int32), np.frombuffer(self.prev, np.int32), np.frombuffer(self.first, np.int32)


@lru_cache(maxsize=2)
def lattice(model: str = MODEL, alpha: float = ALPHA) -> Lattice:
    return Lattice(model, alpha)


def chunks(text: str) -> list[str]:
    """The text's chunks; empty ones carry nothing."""
    parts = text.split(SPACE)
    out: list[str] = []
    for k, part in enumerate(parts):
        if k:
            out.append(LITERAL)
        out += part.replace(" ", " " + SPACE).replace("\n", " \n ").split(" ")
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = np.uint64(0x9E3779B97F4A7C15)


def sample(lat: Lattice, ends: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling for all chunks at once: (ids in order, pieces per chunk)."""
    share, ids, prev, first = lat.arrays()
    live = np.flatnonzero(ends)
    node, state = ends[live], seeds[live]
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(ends), np.int32)
    while len(live):
        edge = first[node]
        state = state + STEP
        u = (mix(state) >> np.uint64(11)).astype(float) * 2.0**-53
        late = np.flatnonzero(share[edge] <= u)
        while len(late):
            edge[late] += 1
            late = late[share[edge[late]] <= u[late]]
        taken.append((live, ids[edge]))
        count[live] += 1
        node = prev[edge]
        go = node != 0
        live, node, state = live[go], node[go], state[go]
    out = np.zeros(int(count.sum()), np.int32)
    at = np.cumsum(count, dtype=np.int64)
    for k, (who, piece) in enumerate(taken):  # the last piece of a chunk was drawn first
        out[at[who] - 1 - k] = piece
    return out, count


def encode(texts: list[str], keys: list[int | None], model: str = MODEL, alpha: float = ALPHA) -> list[np.ndarray]:
    lat = lattice(model, alpha)
    if len(lat.id) > MAX_EDGES:
        lat.reset()
    flat: list[str] = []
    size: list[int] = []
    for t in texts:
        row = chunks(t)
        flat += row
        size.append(len(row))
    lat.add_many(sorted(set(flat).difference(lat.end)))
    ends = list(map(lat.end.__getitem__, flat))
    number = np.concatenate([np.arange(n, dtype=np.uint64) for n in size]) if size else np.zeros(0, np.uint64)
    key = np.array([0x5EED if k is None else (k * 2 + 1) & (2**64 - 1) for k in keys], np.uint64)
    seeds = mix(np.repeat(mix(key), size) + number * np.uint64(0xD1342543DE82EF95))
    ids, count = sample(lat, np.array(ends, np.int32), seeds)
    total = np.add.reduceat(count, np.cumsum([0] + size[:-1])) if size else []
    return np.split(ids, np.cumsum(total)[:-1]) if len(texts) else []


def decode(ids, model: str = MODEL, alpha: float = ALPHA) -> str:
    table = lattice(model, alpha).bytes
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_pieces, lossless (decoding gives the text back), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, n = 0, batch.num_rows
            while i < n:
                texts, size, first = [], 0, i
                while i < n and (not texts or size < SLICE):
                    texts.append(batch.column(1)[i].as_py() or "")
                    size += len(texts[-1])
                    i += 1
                keys = batch.column(0).slice(first, len(texts))
                ids = encode(texts, keys.to_pylist(), model, alpha)
                ok = [decode(x, model, alpha) == t for x, t in zip(ids, texts)]
                counts = np.array([len(x) for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(ok), lists], names=["doc_id", "n_pieces", "lossless", "ids"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    return rows.mapInArrow(run, SCHEMA)
