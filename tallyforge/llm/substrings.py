"""Removal of passages that stand in an earlier document, found by difference-cover anchors.

Anchors of 7 words are hashed only at word positions that are 1, 2 or 4 modulo
7.  For any two positions there is a shift below 7 that brings both to such a
place, so two equal windows of 13 words share an aligned anchor.  Anchors held
by one document alone rule out all other places; only windows around shared
anchors are extended to 13 words, hashed with 96 bits and compared.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import ask, words
from tallyforge.llm.common import table

WINDOW = 13
#: The perfect difference cover modulo 7.
PERIOD, COVER = 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
ANCHORS, WINDOWS = 0, 1
LAST_ID = np.iinfo(np.int64).max
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Chunk:
    """Documents of one chunk in a fixed order, with word hashes and windows."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.append_column("known", rows.column("text").is_valid())
        rows = rows.set_column(rows.column_names.index("text"), "text", pc.fill_null(rows.column("text"), ""))
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.rows = rows
        text = rows.column("text").combine_chunks()
        self.text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        ids = rows.column("doc_id").fill_null(LAST_ID)
        self.ids = ids.to_numpy()
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for w in words.words_of(self.text):
            hashes.append(w.hash)
            counts.append(w.count)
        self.hash, self.count = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.cumsum(self.count) - self.count

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Position (over all words of the chunk) and hash of every anchor."""
        document, position = words.window_positions(self.count, ANCHOR)
        place = (position - self.first[document]) % PERIOD
        position = position[np.isin(place, COVER)]
        return position, words.windows(self.hash, ANCHOR, 21)[position]

    def candidates(self, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and position of the windows that hold a shared anchor."""
        position, key = self.anchors()
        distinct, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        shared = (ask.bits_for(replies, ANCHORS, distinct, buckets) | (n > 1))[inverse]
        reach = np.zeros(len(self.hash) + 1, np.int64)
        np.add.at(reach, position[shared] + 1, -1)
        np.add.at(reach, np.maximum(position[shared] - (PERIOD - 1), 0), 1)
        near = np.cumsum(reach[:-1]) > 0
        document, start = words.window_positions(self.count, WINDOW)
        keep = near[start]
        return document[keep], start[keep]

    def window_keys(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (words.windows(self.hash, WINDOW, 22)[start],
                (words.windows(self.hash, WINDOW, 23)[start] >> np.uint64(32)).astype(np.uint32))


def _distinct(key: np.ndarray, more: np.ndarray, ids: np.ndarray):
    """Sorted distinct windows, their smallest document, and each window's place among them."""
    order = np.lexsort((ids, more, key))
    k, m = key[order], more[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return k[new], m[new], ids[order][new], inverse


def removed_words(docs: DataFrame, docs_per_chunk: int = ask.DOCS_PER_CHUNK, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256; with ``with_text`` also kept_text and the column rest.

    A word is removed if a window of 13 words over it also starts in a document
    with a smaller doc_id.  Windows are judged on the texts as given.  Null and
    empty texts have no words; kept words are joined by one blank.  Rows that
    share a doc_id do not remove each other's words; a null doc_id counts as
    larger than all others.  An empty table gives no rows.  Other columns are
    not read.  ``kept_text`` is the text itself where nothing is removed.
    """
    chunks, buckets = ask.sizes(docs, docs_per_chunk)
    own_rest = ["rest"] if with_text else []
    texts = ask.chunked(docs, chunks, "text", *own_rest)

    def ask_anchors(rows: pa.Table) -> pa.Table:
        _, key = Chunk(rows).anchors()
        chunk = rows.column("chunk")[0].as_py()
        return ask.as_table(ask.questions(chunk, ANCHORS, buckets, np.unique(key)), ask.QUESTION)

    def ask_windows(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(rows):
            return ask.as_table([], ask.QUESTION)
        own = Chunk(rows)
        document, start = own.candidates(replies, buckets)
        key, more, ids, _ = _distinct(*own.window_keys(start), own.ids[document])
        return ask.as_table(ask.questions(rows.column("chunk")[0].as_py(), WINDOWS, buckets, key, more, ids),
                            ask.QUESTION)

    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        own = Chunk(rows)
        removed = np.zeros(len(own.hash), dtype=bool)
        if len(own.hash):
            document, start = own.candidates(replies, buckets)
            key, _, ids, inverse = _distinct(*own.window_keys(start), own.ids[document])
            earlier = ask.bits_for(replies, WINDOWS, key, buckets)[inverse] | (own.ids[document] > ids[inverse])
            edge = np.zeros(len(own.hash) + 1, np.int64)
            np.add.at(edge, start[earlier], 1)
            np.add.at(edge, start[earlier] + WINDOW, -1)
            removed = np.cumsum(edge[:-1]) > 0
        gone = np.concatenate(([0], np.cumsum(removed)))
        ends = own.first + own.count
        n_removed = gone[ends] - gone[own.first]
        digest, kept_text = [], []
        for i, text in enumerate(own.text):
            parts = text.as_py().encode().split()
            if n_removed[i]:
                parts = compress(parts, (~removed[own.first[i]:ends[i]]).tolist())
            kept = b" ".join(parts)
            digest.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append(kept.decode() if n_removed[i] else text.as_py())
        columns = [own.rows.column("doc_id"), pa.array(own.count), pa.array(n_removed), pa.array(digest)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            present = own.rows.column("known").to_pylist()
            columns += [pa.array([t if k else None for t, k in zip(kept_text, present)], pa.string()),
                        own.rows.column("rest")]
            names += ["kept_text", "rest"]
        return pa.table(columns, names=names)

    first = ask.answers(ask.ask(texts, ask_anchors))
    second = ask.answers(ask.tell(texts, first, ask_windows, ask.QUESTION))
    more = f", kept_text string, rest {docs.schema['rest'].dataType.simpleString()}" if with_text else ""
    return ask.tell(texts, first.unionByName(second), finish, RESULT + more)


def without_repeats(docs: DataFrame, docs_per_chunk: int = ask.DOCS_PER_CHUNK) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text``.

    Texts without any stay as they are.  A text of which nothing is left is
    dropped; one that had no words stays.  Other columns are kept; ``n_chars``
    follows the text where there is one.  The columns travel with the text, so
    no join brings them back.
    """
    packed = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest"))
    cleaned = removed_words(packed, docs_per_chunk, with_text=True)
    out = cleaned.filter("n_removed = 0 OR n_removed < n_words")
    columns = [F.col("kept_text").alias(c) if c == "text"
               else F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(
                   F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars"
               else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)


def op1_substrings(spark, sf_dir):
    return removed_words(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
firsts AS (SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT windows.doc_id, unnest(range(i, i + 13)) AS p
    FROM windows JOIN firsts ON windows.k = firsts.k WHERE first_id < windows.doc_id)),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(counted.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
