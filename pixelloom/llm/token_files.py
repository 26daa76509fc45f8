r"""Token counts from flat, unindexed token files.

A token file is nothing but little-endian ``uint16`` or ``uint32`` ids, document
after document, each closed by the end-of-document id.  ``count_documents`` reads
such files in blocks of ``block_tokens`` ids:

1. each block is searched for the separator with one vectorised comparison; it
   gives one row for each *piece* between separators (ids, whether a separator
   closes the piece, the first ids of the piece);
2. a prefix scan over the blocks of a file (a running count of separators, one
   small row a block) numbers the documents, so that the last, open piece of a
   block meets the first piece of the next; a document may span many blocks.

Only the open and first pieces of a block take part in the stitching; pieces that
lie inside a block are final.  A file is one input row (``binaryFile``), so a file
must stay below 2 GiB; ``write_token_files`` makes files of about the size of an
input partition and never buffers more than a batch.

To tell documents apart in an unindexed stream, ``write_token_files`` puts a header
of ``HEADER`` ids in front of each document: a sign or null mark and five digits of
the key to the base of the vocabulary.  Headers do not count as tokens.

Defined results: a null text counts as empty (0 tokens); a null key is kept; a last
document without a separator counts; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, new_path, stage
from .secret_scan import encoding

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The first id that the vocabulary leaves free closes a document.
SEPARATOR = 50256
DIGITS, HEADER = 5, 6
BLOCK_TOKENS = 1 << 20


def header(key: int | None) -> list[int]:
    if key is None:
        return [2] + [0] * DIGITS
    n, digits = abs(key), []
    for _ in range(DIGITS):
        n, d = divmod(n, SEPARATOR)
        digits.append(d)
    return [int(key < 0), *digits]


def write_token_files(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> str:
    """Encode whole texts and write them as flat token files, one for each input
    partition, into a new folder of the shared place; returns the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            parts, size = [], 0

            def flush(parts):
                # A string column whose bytes are ids: the text sink writes them as they are.
                data = b"".join(parts)
                offsets = np.cumsum([0] + [len(p) for p in parts], dtype=np.int32)
                column = pa.StringArray.from_buffers(len(parts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
                return pa.RecordBatch.from_arrays([column], names=["value"])

            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode_to_numpy(t.as_py() or "").astype("<u2")
                parts.append(np.array(header(k), "<u2").tobytes() + ids.tobytes())
                size += len(parts[-1])
                if size > 4 << 20:
                    yield flush(parts)
                    parts, size = [], 0
            if parts:
                yield flush(parts)

    path = new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    # The separator's two bytes, as the sink's line end: 0x50 0xC4 is 50256.
    end = SEPARATOR.to_bytes(2, "little").decode("latin-1")
    rows.mapInArrow(run, "value string").write.option("encoding", "ISO-8859-1").option("lineSep", end).text(path)
    return path


def scan_block(ids: np.ndarray, separator: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces among the first ``n`` ids."""
    at = np.flatnonzero(ids[:n] == separator)
    return np.concatenate(([0], at + 1)), np.append(at, n)


def count_documents(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = 2, block_tokens: int = BLOCK_TOKENS, header_ids: int = HEADER) -> DataFrame:
    """(file, document, n_ids, head) for every document in the files below ``path``:
    its number in the file, its ids without the separator, its first ids."""
    step = block_tokens * width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    blocks = files.filter("length > 0").select(
        F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / step).cast("int"))).alias("block")
    ).select("file", "block", F.expr(f"substring(content, block * {step} + 1, {step + header_ids * width})").alias("bytes"))  # a halo, so that a piece's first ids are whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = f"<u{width}"
        for batch in batches:
            for i in range(batch.num_rows):
                file, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), kind)
                start, end = scan_block(ids, separator, min(len(ids), block_tokens))
                head = np.zeros((len(start), header_ids), np.int32)
                for j in range(header_ids):
                    ok = start + j < len(ids)
                    head[ok, j] = ids[start[ok] + j]
                n = len(start)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * header_ids, max(header_ids, 1), dtype=np.int32)[: n + 1]), pa.array(head.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n), pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n, dtype=np.int64)), pa.array((end - start).astype(np.int64)), pa.array(np.append(np.zeros(n - 1, bool), True) if n else []), lists],
                    names=["file", "block", "piece", "n", "open", "head"],
                )

    # A block's pieces are a few numbers each; they are read three times, the files once.
    pieces = stage(blocks.mapInArrow(run, "file string, block int, piece long, n long, open boolean, head array<int>"), "pieces")
    # Prefix scan: separators before each block, over one row a block.
    sums = pieces.groupBy("file", "block").agg(F.max("piece").alias("seps"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("file", "block", F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("carry"))
    placed = pieces.join(carry, ["file", "block"]).withColumn("document", F.col("carry") + F.col("piece"))
    inner = placed.filter("piece > 0 and not open").select("file", "document", "n", "head")
    # First pieces and open pieces: at most two rows a block.
    edges = placed.filter("piece = 0 or open").groupBy("file", "document").agg(F.sum("n").alias("n"), F.min_by("head", "block").alias("head"), F.max((~F.col("open")).cast("int")).alias("closed"))
    edges = edges.filter("closed = 1 or n > 0").select("file", "document", "n", "head")
    return inner.unionByName(edges).withColumnRenamed("n", "n_ids")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of whole texts, by way of flat token files."""
    path = write_token_files(docs, key, text, vocabulary)
    found = count_documents(docs.sparkSession, path)
    delete(docs.sparkSession, path)  # its pieces are kept
    value = F.lit(0).cast("long")
    for j in range(DIGITS, 0, -1):  # wraps like two's complement only beyond the key range of a long
        value = value * F.lit(SEPARATOR).cast("long") + F.col("head")[j]
    mark = F.col("head")[0]
    doc = F.when(mark == 0, value).when(mark == 1, -value)
    return found.select(doc.alias("doc_id"), (F.col("n_ids") - HEADER).alias("n_tokens"))
