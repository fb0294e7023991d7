"""Questions about hashes between groups of documents, without shipping documents.

Documents are dealt to chunks, hashes to buckets.  A chunk sends every distinct
hash once, packed per bucket; the bucket compares what all chunks sent and
answers with one bit per hash.  The chunk finds the bits again by sorting the
same hashes, so the answer needs no keys.  A hash that a third of all documents
hold reaches its bucket once per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import shuffle_partitions

DOCS_PER_CHUNK = 2048
CHUNKS_PER_BUCKET = 4
QUESTION = "bucket int, chunk int, kind int, keys binary, more binary, ids binary"
ANSWER = "chunk int, kind int, bucket int, bits binary"


def sizes(docs: DataFrame, docs_per_chunk: int = DOCS_PER_CHUNK) -> tuple[int, int]:
    """Numbers of chunks and buckets; both follow the number of documents."""
    chunks = max(1, -(-docs.count() // docs_per_chunk))
    return chunks, max(shuffle_partitions(docs.sparkSession), -(-chunks // CHUNKS_PER_BUCKET))


def chunked(docs: DataFrame, chunks: int, *columns: str) -> DataFrame:
    """``doc_id``, the columns and a chunk; rows that share an id are spread by their text."""
    key = F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64(*columns)))
    return docs.select(F.col("doc_id").cast("long"), *columns, F.pmod(key, F.lit(chunks)).cast("int").alias("chunk"))


#: A kind whose ``ids`` are counts; the answer is the level of the sum, one byte per key.
COUNTED = 9


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the leading 32 bits, so sorted keys lie in bucket order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers by place, so that equal leading bytes compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def spans(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    if len(keys):
        bucket = bucket_of(keys, buckets).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for low, high in zip(np.concatenate(([0], cut)), np.append(cut, len(keys))):
            yield int(bucket[low]), int(low), int(high)


def questions(chunk: int, kind: int, buckets: int, keys: np.ndarray, more: np.ndarray | None = None,
              ids: np.ndarray | None = None) -> list[tuple]:
    """Rows of ``QUESTION`` for sorted distinct keys; ``more`` lengthens the key, ``ids`` go along."""
    return [(b, chunk, kind, keys[low:high].astype("<u8").tobytes(),
             more[low:high].astype("<u4").tobytes() if more is not None else None,
             _planes(ids[low:high]) if ids is not None else None)
            for b, low, high in spans(keys, buckets)]


_TYPES = {"bucket": pa.int32(), "chunk": pa.int32(), "kind": pa.int32()}


def as_table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows as an Arrow table of a DDL schema."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _answer(table: pa.Table) -> pa.Table:
    """Bits of one bucket.  Kind with ids: a smaller id was sent.  Else: another chunk sent it too.

    ``COUNTED`` keys get the level of their summed counts instead.
    """
    out = []
    for kind in sorted(set(table.column("kind").to_pylist())):
        rows = table.filter(pc.equal(table.column("kind"), kind)).to_pylist()
        key = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in rows])
        if rows[0]["more"] is not None:
            more = np.concatenate([np.frombuffer(r["more"], "<u4") for r in rows])
            order = np.lexsort((more, key))
            new = np.append(True, (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1]))
        else:
            order = np.argsort(key, kind="stable")
            new = np.append(True, key[order][1:] != key[order][:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        if kind == COUNTED:
            counts = np.concatenate([_from_planes(r["ids"]) for r in rows]).astype(np.int64)[order]
            total = np.add.reduceat(counts, first)
            level = np.where(total > 1, np.minimum(255, 8 * np.log2(total) - 6).astype(np.int64), 0)[group]
            back = np.empty(len(key), np.uint8)
            back[order] = level
            at = 0
            for r in rows:
                n = len(r["keys"]) // 8
                out.append((r["chunk"], kind, r["bucket"], back[at:at + n].tobytes()))
                at += n
            continue
        if rows[0]["ids"] is not None:
            ids = np.concatenate([_from_planes(r["ids"]) for r in rows]).astype(np.int64)[order]
            bit = ids > np.minimum.reduceat(ids, first)[group]
        else:
            bit = (np.diff(np.append(first, len(key))) > 1)[group]
        back = np.empty(len(key), dtype=bool)
        back[order] = bit
        at = 0
        for r in rows:
            n = len(r["keys"]) // 8
            if back[at:at + n].any():
                out.append((r["chunk"], kind, r["bucket"], np.packbits(back[at:at + n]).tobytes()))
            at += n
    return as_table(out, ANSWER)


def answers(asked: DataFrame) -> DataFrame:
    """One row of bits per chunk, kind and bucket in which any bit is set."""
    return asked.groupBy("bucket").applyInArrow(_answer, ANSWER)


def bits_for(replies: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of a chunk's sorted distinct keys."""
    out = np.zeros(len(keys), dtype=bool)
    own = {r["bucket"]: r["bits"] for r in replies.to_pylist() if r["kind"] == kind}
    for b, low, high in spans(keys, buckets):
        if b in own:
            out[low:high] = np.unpackbits(np.frombuffer(own[b], np.uint8), count=high - low).astype(bool)
    return out


def levels_for(replies: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """How common a chunk's sorted distinct keys are: 0 for one holder, more in eighths of powers of two."""
    out = np.zeros(len(keys), np.uint8)
    own = {r["bucket"]: r["bits"] for r in replies.to_pylist() if r["kind"] == kind}
    for b, low, high in spans(keys, buckets):
        out[low:high] = np.frombuffer(own[b], np.uint8)
    return out


def ask(chunks: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str = QUESTION) -> DataFrame:
    """``fn`` on every chunk."""
    return chunks.groupBy("chunk").applyInArrow(fn, schema)


def tell(chunks: DataFrame, replies: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` on every chunk together with the answers it got."""
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(fn, schema)
