"""Token ids in files with a shared zstandard dictionary.

A data set is a folder with three tables that Spark writes and reads:

- ``dictionary``: one row with the dictionary, its SHA-256 and the id width;
- ``shards``: one row per shard of consecutive documents with the dictionary's
  hash, the documents' ids, the offset index (places of the compressed
  documents, numbers of ids) and the compressed documents, each on its own;
- ``index``: one row per shard with its first document and its ids before.

A document is read by its shard's offset index alone, without decompressing
its neighbours.  The dictionary is trained on the serialized ids of a bounded
sample; ids read back do not depend on it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import shared_folder, table
from tallyforge.llm.tokens import UnitEncoder

END_ID = 2
#: The dictionary's sample: whole documents, so many at most, of so many bytes in all.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8 << 20, 64 << 10
DOCS_PER_RANGE = 8192
SHARD_DOCS, SHARD_BYTES = 2048, 8 << 20
LEVEL = 3
SHARD = ("part int, shard int, dictionary_hash string, first_doc_id long, n_docs int, n_ids long, "
         "doc_ids binary, places binary, counts binary, payload binary")


def _sample_ids(docs: DataFrame, tokenizer_path: str) -> list[bytes]:
    # Ids and lengths come first, by the ids' hashes, so that no task sends more texts than the sample has.
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text <> ''")
    heads = (some.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("n"))
             .orderBy("h", "doc_id", "n").limit(SAMPLE_DOCS).collect())
    chosen, size = set(), 0
    for head in heads:
        # A document that does not fit in any more is left out whole.
        if size + head["n"] <= SAMPLE_BYTES:
            chosen.add(head["doc_id"])
            size += head["n"]
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame([(d,) for d in chosen], "chosen_id long")
    sample = some.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("chosen_id")))
    # Rows may share a chosen id: again whole texts, in order, up to the same number of bytes.
    texts, size = [], 0
    for row in sample.select(F.xxhash64("doc_id").alias("h"), "text").orderBy("h", "text").limit(len(heads)).collect():
        if size + len(row["text"].encode()) <= SAMPLE_BYTES:
            texts.append(row["text"])
            size += len(row["text"].encode())
    encoder = UnitEncoder.get(tokenizer_path)
    width = id_width(encoder)
    out = []
    for _, ids, count in encoder.slices(pa.array(texts, pa.string())):
        out += [part.astype(width).tobytes() for part in np.split(ids, np.cumsum(count)[:-1])]
    return [x for x in out if x]


def id_width(encoder: UnitEncoder) -> str:
    return "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or no bytes where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes, level: int | None = None):
    """The dictionary, digested once for a compression level if one is given."""
    if not dictionary:
        return None
    codec = zstandard.ZstdCompressionDict(dictionary)
    if level is not None:
        codec.precompute_compress(level=level)
    return codec


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID,
                      docs_per_range: int = DOCS_PER_RANGE) -> None:
    """Write the ids of all documents, in ascending order of doc_id, to ``folder``.

    Ranges of doc_id are sorted each by one task; their bounds come from the
    ids alone.  Rows that share a doc_id follow each other by their compressed
    bytes; null ids come first.  Null and empty texts hold the end id alone.
    An empty table gives files without shards.  Other columns are not read.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(_sample_ids(docs, tokenizer_path))
    name = hashlib.sha256(dictionary).hexdigest()
    width = id_width(UnitEncoder.get(tokenizer_path))
    spark.createDataFrame([(name, width, bytearray(dictionary))],
                          "dictionary_hash string, width string, dictionary binary").coalesce(1).write.parquet(
        f"{folder}/dictionary")

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n_ranges = -(-ids.count() // docs_per_range)
    cuts = [i / n_ranges for i in range(1, n_ranges)]
    # Eight bytes for every range of documents; a row finds its range by binary search.
    bounds = np.array(sorted(set(ids.approxQuantile("doc_id", cuts, 0.2 / n_ranges))) if cuts else [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.get(tokenizer_path)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(dictionary, LEVEL), write_checksum=True)
        end = np.array([end_id], width).tobytes()
        for batch in batches:
            for low, ids, count in encoder.slices(batch.column(1)):
                ids, ends = ids.astype(width), np.cumsum(count)
                packed = [packer.compress(ids[e - n:e].tobytes() + end) for e, n in zip(ends.tolist(), count.tolist())]
                part = batch.column(0).slice(low, len(count))
                at = np.searchsorted(bounds, part.fill_null(np.iinfo(np.int64).min).to_numpy(), side="left")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), part, pa.array(count + 1), pa.array(packed, pa.binary())],
                    names=["part", "doc_id", "n_ids", "packed"])
        encoder.release()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, at, number = 0, None, 0

        def shard() -> pa.RecordBatch:
            doc_ids = [h[0] for h in held]
            blobs = [h[2] for h in held]
            present = np.array([d is not None for d in doc_ids], np.uint8)
            numbers = np.array([d or 0 for d in doc_ids], "<i8")
            places = np.concatenate(([0], np.cumsum([len(b) for b in blobs]))).astype("<u8")
            counts = np.array([h[1] for h in held], "<u8")
            row = (at, number, name, doc_ids[0], len(held), int(counts.sum()), present.tobytes() + numbers.tobytes(),
                   places.tobytes(), counts.tobytes(), b"".join(blobs))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              names=[f.split()[0] for f in SHARD.split(", ")])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for p, doc, n, blob in zip(*columns):
                if held and (p != at or len(held) >= SHARD_DOCS or size + len(blob) > SHARD_BYTES):
                    yield shard()
                    number, held, size = (number + 1 if p == at else 0), [], 0
                at = p
                held.append((doc, n, blob))
                size += len(blob)
        if held:
            yield shard()

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        encode, "part int, doc_id long, n_ids long, packed binary")
    (coded.repartition(max(1, n_ranges), "part").sortWithinPartitions("part", "doc_id", "packed")
     .mapInArrow(shards, SHARD).write.parquet(f"{folder}/shards"))
    head = spark.read.parquet(f"{folder}/shards").select("part", "shard", "first_doc_id", "n_docs", "n_ids")
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    across = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = head.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(across), F.lit(0)).alias("before_part"))
    (head.join(parts, "part")
     .withColumn("before", F.col("before_part") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
     .select("part", "shard", "first_doc_id", "n_docs", "n_ids", "before").write.parquet(f"{folder}/index"))


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["dictionary_hash"]:
        raise ValueError(f"dictionary of {folder} is damaged")
    return row["dictionary_hash"], row["width"], dictionary


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None,
                     with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document in the files.

    With ``doc_ids``, only these documents are decompressed: shards whose range
    cannot hold them are left out by the index, others by their offset index.
    """
    name, width, dictionary = _dictionary(spark, folder)
    index = spark.read.parquet(f"{folder}/index").select("part", "shard", "before")
    rows = spark.read.parquet(f"{folder}/shards").join(index, ["part", "shard"])
    wanted = None
    if doc_ids is not None:
        wanted = np.unique(np.array(doc_ids, np.int64))
        rows = rows.filter(F.expr("first_doc_id IS NULL") | (F.col("first_doc_id") <= int(wanted.max()))) if len(wanted) else rows.limit(0)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))
        for batch in batches:
            # Shard by shard: a batch may hold many megabytes of them.
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if r["dictionary_hash"] != name:
                    raise ValueError("shard was written with another dictionary")
                n = r["n_docs"]
                present = np.frombuffer(r["doc_ids"][:n], np.uint8)
                docs = np.frombuffer(r["doc_ids"][n:], "<i8")
                places, counts = np.frombuffer(r["places"], "<u8"), np.frombuffer(r["counts"], "<u8")
                starts = r["before"] + np.cumsum(counts) - counts
                use = range(n) if wanted is None else np.flatnonzero((present == 1) & np.isin(docs, wanted)).tolist()
                out: list[list] = [[], [], [], [], []]
                for i in use:
                    raw = reader.decompress(r["payload"][int(places[i]):int(places[i + 1])])
                    ids = np.frombuffer(raw, width).astype("<u4").tobytes()
                    if len(ids) != 4 * counts[i]:
                        raise ValueError("a document has another length than its index says")
                    for column, value in zip(out, (int(docs[i]) if present[i] else None, int(starts[i]), len(ids) // 4,
                                                   zlib.crc32(ids), ids)):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.binary()]
                keep = 5 if with_ids else 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in list(zip(out, kinds))[:keep]],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:keep])

    needed = ["dictionary_hash", "n_docs", "doc_ids", "places", "counts", "payload", "before"]
    return rows.select(*needed).mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def word_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op10_token_files(spark, sf_dir):
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, word_tokenizer())
    return read_token_files(spark, folder, with_ids=False)
