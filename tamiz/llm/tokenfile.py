"""Token ids of documents in files of coded blocks.

A file is a Parquet container (written by Spark's committer, so a lost task
leaves nothing half done) of one row per block. The column ``block`` holds a
block in a format of its own, which needs nothing else to be read (the others
let readers choose blocks; ``whole`` tells that all its documents are in it):

======  ======================================================================
bytes   content
======  ======================================================================
4       ``TZK1``
4       CRC-32 of all that follows
8       position of the first id among the ids of the file range
4 4 4   number of documents, of ids and of lanes
4 4     ids of the first document in earlier blocks; 1 if the last one goes on
n       documents' ids (64-bit) and null marks, and numbers of ids here (32-bit)
m       words per lane (32-bit), then the words (16-bit) of ``rangecoder``
======  ======================================================================

Numbers are little-endian. Blocks are coded independently: the model starts
anew in each, and a damaged block is noticed and harms no other.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tamiz.llm import rangecoder
from tamiz.llm.packing import in_order
from tamiz.llm.tokens import default_path, encoder
from tamiz.llm.workers import frugal
from tamiz.session import new_folder

MAGIC = b"TZK1"
BLOCK_IDS = 1 << 20
_HEAD = "<QIIIII"

BLOCK_SCHEMA = "part int, block_no int, n_ids long, whole boolean, block binary"


def write_block(first: int, keys: list, before: int, goes_on: bool, counts: list[int], ids: np.ndarray) -> bytes:
    words, per_lane = rangecoder.encode(ids)
    body = b"".join(
        [
            struct.pack(_HEAD, first, len(keys), len(ids), len(per_lane), before, int(goes_on)),
            np.array([0 if k is None else k for k in keys], "<i8").tobytes(),
            np.array([k is None for k in keys], np.uint8).tobytes(),
            np.array(counts, "<u4").tobytes(),
            per_lane.astype("<u4").tobytes(),
            words.astype("<u2").tobytes(),
        ]
    )
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def read_block(block: bytes) -> tuple[int, list, int, bool, np.ndarray, np.ndarray]:
    """(first, keys, before, goes_on, counts, ids) of a block; ValueError if it
    is not one or was damaged."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    body = memoryview(block)[8:]
    if zlib.crc32(body) != struct.unpack_from("<I", block, 4)[0]:
        raise ValueError("damaged block of token ids")
    first, docs, n, lanes, before, goes_on = struct.unpack_from(_HEAD, body)
    at = struct.calcsize(_HEAD)

    def numbers(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(body, kind, count, at)
        at += found.nbytes
        return found

    keys, null, counts = numbers("<i8", docs), numbers("u1", docs), numbers("<u4", docs)
    per_lane = numbers("<u4", lanes).astype(np.int64)
    words = numbers("<u2", int(per_lane.sum())).astype(np.uint16)
    ids = rangecoder.decode(words, per_lane, n)
    return first, [None if z else int(k) for k, z in zip(keys, null)], before, bool(goes_on), counts, ids


class _Blocks:
    """Cuts the documents of a file range into blocks, at documents where they fit."""

    def __init__(self, size: int):
        self.size, self.first, self.number = size, 0, 0
        self.keys, self.counts, self.ids, self.n = [], [], [], 0

    def _row(self, before: int = 0, goes_on: bool = False):
        ids = np.concatenate(self.ids)
        block = write_block(self.first, self.keys, before, goes_on, self.counts, ids)
        row = (self.number, len(ids), not before and not goes_on, block)
        self.first += len(ids)
        self.number += 1
        self.keys, self.counts, self.ids, self.n = [], [], [], 0
        return row

    def add(self, key, ids: np.ndarray):
        if self.n and self.n + len(ids) > self.size:
            yield self._row()
        before = 0
        while len(ids) - before > self.size:
            self.keys, self.counts, self.ids = [key], [self.size], [ids[before : before + self.size]]
            yield self._row(before, True)
            before += self.size
        if before:
            self.keys, self.counts, self.ids = [key], [len(ids) - before], [ids[before:]]
            yield self._row(before)
            return
        self.keys.append(key)
        self.counts.append(len(ids))
        self.ids.append(ids)
        self.n += len(ids)

    def flush(self):
        if self.keys:
            yield self._row()


def write_token_files(
    docs: DataFrame,
    folder: str,
    document: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of all documents, in ascending order of their ids (nulls
    first), to files of blocks in ``folder``. Ids of a document are those of
    its whole text (null: empty) and ``end_id``.

    Document ids are 64-bit integers or null; rows with a null or repeated id
    are documents of their own. A text longer than a block spans several. No
    rows give files without blocks. Other columns are ignored.
    """
    path = tokenizer or default_path()

    def blocks(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        cut, encode = _Blocks(block_ids), encoder(path)

        def batch(rows):
            numbers, sizes, whole, raw = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array(numbers, pa.int32()),
                    pa.array(sizes, pa.int64()),
                    pa.array(whole, pa.bool_()),
                    pa.array(raw, pa.binary()),
                ],
                ["part", "block_no", "n_ids", "whole", "block"],
            )

        for b in batches:
            keys = b.column("doc").to_pylist()
            for lo, ids, at in encode.encode(b.column("text")):
                for i in range(len(at) - 1):
                    rows = list(cut.add(keys[lo + i], np.append(ids[at[i] : at[i + 1]], np.uint32(end_id))))
                    if rows:
                        yield batch(rows)
        rows = list(cut.flush())
        if rows:
            yield batch(rows)

    ordered = in_order(docs.withColumn(document, F.col(document).cast("long")), document, text)
    ordered.select("doc", "text").mapInArrow(frugal(blocks), BLOCK_SCHEMA).write.option("compression", "none").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, document: str = "doc_id") -> DataFrame:
    """One row per document: ``document``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit). A damaged
    block fails the read."""
    files = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    # One row per file range: where its ids begin among all.
    ranges = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def documents(batches):
        for b in batches:
            for base, block in zip(b.column("base").to_pylist(), b.column("block").to_pylist()):
                first, keys, earlier, goes_on, counts, ids = read_block(block)
                raw = ids.astype("<u4").tobytes()
                end = np.cumsum(counts.astype(np.int64))
                start = end - counts
                starts = base + first + start
                begins = starts.copy()
                begins[0] -= earlier
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array(begins, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array([raw[4 * s : 4 * e] for s, e in zip(start.tolist(), end.tolist())], pa.binary()),
                    ],
                    ["doc", "start", "at", "ids"],
                )

    def read(blocks: DataFrame) -> DataFrame:
        based = blocks.join(F.broadcast(bases), "part").select("base", "block")
        return based.mapInArrow(frugal(documents), "doc long, start long, at long, ids binary")

    whole = read(files.where("whole")).select("doc", "start", "ids")

    def joined(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("at")
        ids = b"".join(pieces.column("ids").to_pylist())
        return pa.table(
            [pieces.column("doc").slice(0, 1), pieces.column("start").slice(0, 1), pa.array([ids], pa.binary())],
            ["doc", "start", "ids"],
        )

    long = read(files.where("NOT whole")).groupBy("start").applyInArrow(joined, "doc long, start long, ids binary")
    return whole.unionByName(long).select(
        F.col("doc").alias(document), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids"
    )


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write documents to a new folder of the shared directory and read them."""
    folder = new_folder(docs.sparkSession, "token-files")
    write_token_files(docs, folder, **options)
    return read_token_files(docs.sparkSession, folder, options.get("document", "doc_id"))
