"""Keyword search through an index of character grams.

The index names, per ticker, the chunks that hold a gram: three characters in
a row, and one or two for words that are shorter.  A query word can only be in
the chunks of its rarest gram, so one list of chunks is read per word.  These
lists give an upper bound of every chunk's score; texts are read for the chunks
with the best bounds first, and then only for those that would come before the
last result by then if their score were their bound.

Chunks are numbered within blocks of a few million characters of one ticker.  A
gram has one row per block with the numbers of its chunks, packed, and a block
has one row without a gram that names its chunks.  The rows of a block are
written by the task that reads its texts, so no list is shuffled to be written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import let, query_words
from tallyforge.operators.documents import EXCERPT_CHARS, TOP_PASSAGES
from tallyforge.sources.tables import BUCKETS, bucket_of, layout, replace_by_key, staged, write_table

GRAM = 3
#: Characters whose chunks are numbered together, and what the number of a gram and a chunk must stay below.
BLOCK_CHARS, KEYS = 1 << 22, 1 << 63
#: Chunks verified at first, as a multiple of the results wanted.
FIRST = 4
CHUNK = ["accession_number", "chunk_id"]
POSTINGS = ("ticker STRING, block BIGINT, gram STRING, n_chunks BIGINT, places BINARY, "
            "accession_numbers ARRAY<STRING>, chunk_ids ARRAY<INT>")
COUNTS = "ticker STRING, gram STRING, n_chunks BIGINT"
CHUNKS = "ticker STRING, form STRING, filing_date DATE, accession_number STRING, chunk_id INT, chunk_text STRING"
LAST = "struct<score: bigint, filing_date: date, accession_number: string, chunk_id: int>"
#: The index is written once and read a few times.
_FILES = {"compression": "zstd"}


def grams(text: Column, up_to: int = GRAM) -> Column:
    """The distinct runs of 1 to ``up_to`` characters of a text; empty for null."""
    def runs(c: Column, n: int) -> Column:
        last = F.size(c) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))

    # An empty pattern cuts a text into its characters.
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return let(chars, lambda c: F.array_distinct(F.concat(*[runs(c, n) for n in range(1, up_to + 1)])))


def word_grams(word: Column) -> Column:
    """The grams that a chunk with the word must hold: the longest that fit."""
    n = F.least(F.length(word), F.lit(GRAM))
    return F.filter(grams(word), lambda g: F.length(g) == n)


@dataclass(frozen=True)
class SearchIndex:
    """Chunks, postings and chunk counts per gram, each laid out by ticker."""

    root: str

    def path(self, part: str) -> str:
        return f"{self.root}/{part}"

    def build(self, chunks: DataFrame, buckets: int = BUCKETS) -> None:
        """Write the index of all chunks anew."""
        spark = chunks.sparkSession
        write_table(_upper(chunks), self.path("chunks"), "ticker", buckets, options=_FILES)
        write_table(_postings(self.chunks(spark)), self.path("postings"), "ticker", buckets, rebalance=False,
                    options=_FILES)
        write_table(_counts(self.postings(spark)), self.path("counts"), "ticker", buckets)

    def refresh(self, chunks: DataFrame, tickers: DataFrame) -> None:
        """Replace the entries of ``tickers`` by those of their chunks; other tickers are not read."""
        mine = tickers.select(F.upper("ticker").alias("ticker")).distinct()
        replace_by_key(_upper(chunks), mine, self.path("chunks"), ddl=CHUNKS)
        kept = self.chunks(chunks.sparkSession).join(mine, "ticker", "left_semi")
        # The rows of a block come out of one attempt of one task; only then are they dealt.
        replace_by_key(staged(_postings(kept), _name()), mine, self.path("postings"), ddl=POSTINGS)
        posted = self.postings(chunks.sparkSession).join(mine, "ticker", "left_semi")
        replace_by_key(_counts(posted), mine, self.path("counts"), ddl=COUNTS)

    def _read(self, spark: SparkSession, part: str, ddl: str) -> DataFrame:
        return spark.read.schema(f"{ddl}, bucket INT").parquet(self.path(part))

    def chunks(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "chunks", CHUNKS)

    def postings(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "postings", POSTINGS)

    def counts(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "counts", COUNTS)

    def buckets(self, spark: SparkSession) -> int:
        return layout(spark, self.path("chunks"))[1]


def _upper(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.upper("ticker").alias("ticker"), "form", F.col("filing_date").cast("date"),
                         "accession_number", F.col("chunk_id").cast("int"), "chunk_text")


def _postings(chunks: DataFrame) -> DataFrame:
    return chunks.select("ticker", *CHUNK, F.lower("chunk_text").alias("text")).mapInArrow(_posted, POSTINGS)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    block, size = TaskContext.get().partitionId() << 32, 0
    held: dict[str | None, list[tuple]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        nonlocal block
        for ticker, mine in held.items():
            for part in _countable([text for *_, text in mine]):
                yield _block(ticker, block, mine[part], *gram_lists([text for *_, text in mine[part]]))
                block += 1

    for batch in batches:
        for ticker, *key, text in zip(*(column.to_pylist() for column in batch.columns)):
            if not text:
                continue
            held.setdefault(ticker, []).append((*key, text))
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def _countable(texts: list[str]) -> Iterator[slice]:
    """Parts of the texts in which every gram of every text has a number."""
    parts = [slice(0, len(texts))]
    while parts:
        part = parts.pop()
        n = part.stop - part.start
        if n > 1 and len(set().union(*texts[part])) ** GRAM * n >= KEYS:
            middle = part.start + n // 2
            parts += [slice(middle, part.stop), slice(part.start, middle)]
        else:
            yield part


def gram_lists(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct grams of 1 to ``GRAM`` characters, where the list of each begins, and the lists: places of texts, rising."""
    n, length = len(texts), np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    number = np.zeros(int(code.max()) + 1, np.int64)
    number[code] = 1
    letters = np.flatnonzero(number).astype(np.uint32)
    number[letters] = np.arange(len(letters))
    size = len(letters)
    kind = np.uint32 if size ** GRAM * n < 1 << 32 else np.int64
    letter, place, ends = number[code].astype(kind), np.repeat(np.arange(n, dtype=kind), length), np.cumsum(length)

    def keys(at: np.ndarray, k: int) -> np.ndarray:
        key = letter[at]
        for i in range(1, k):
            key = key * kind(size) + letter[at + i]
        return key * kind(n) + place[at]

    names, begins, lists, ahead = [], [], [], 0
    longer = keys(np.flatnonzero(place[GRAM - 1:] == place[:1 - GRAM]), GRAM)
    for k in range(GRAM, 0, -1):
        # A gram is the beginning of a longer one or ends its text.
        key = longer if k == GRAM else np.concatenate((longer // kind(n * size) * kind(n) + longer % kind(n),
                                                       keys(ends[length >= k] - k, k)))
        key.sort()
        longer = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        gram = longer // kind(n)
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
        spelt = np.stack([letters[gram[first].astype(np.int64) // size ** i % size] for i in range(k - 1, -1, -1)], 1)
        joined = np.ascontiguousarray(spelt).tobytes().decode("utf-32-le")
        names += [joined[i:i + k] for i in range(0, len(joined), k)]
        begins.append(first + ahead)
        lists.append((longer % kind(n)).astype(np.int64))
        ahead += len(longer)
    return names, np.concatenate(begins), np.concatenate(lists)


def _packed(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in bytes of seven bits, the lowest first, and the bytes of each; a byte below 128 ends a number."""
    size = np.ones(len(steps), np.int64)
    for bits in range(7, int(steps.max(initial=0)).bit_length(), 7):
        size += steps >= 1 << bits
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > i)
        out[begin[has] + i] = (steps[has] >> 7 * i) & 127 | np.where(size[has] > i + 1, 128, 0)
    return out, size


def _block(ticker: str | None, block: int, chunks: list[tuple], names: list[str], begin: np.ndarray,
           places: np.ndarray) -> pa.RecordBatch:
    """A block's rows: its grams with their chunks as steps from one to the next, and the row that names the chunks."""
    before = np.concatenate(([-1], places[:-1]))
    before[begin] = -1
    data, size = _packed(places - before - 1)
    ends = np.append(begin[1:], len(places))
    at = np.concatenate(([0], np.cumsum(size)[ends - 1], [len(data)])).astype(np.int32)
    rows, none = len(names) + 1, [None] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array([ticker] * rows, pa.string()), pa.array(np.full(rows, block)), pa.array([*names, None], pa.string()),
         pa.array(np.append(ends - begin, 0)),
         pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(at), pa.py_buffer(data)]),
         pa.array([*none, [a for a, _, _ in chunks]], pa.list_(pa.string())),
         pa.array([*none, [c for _, c, _ in chunks]], pa.list_(pa.int32()))],
        names=["ticker", "block", "gram", "n_chunks", "places", *("accession_numbers", "chunk_ids")])


def listed(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The places in packed lists, and which list each is from."""
    data = np.frombuffer(b"".join(lists), np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    bits = 7 * (np.arange(len(data)) - np.repeat(first, last - first + 1))
    total = np.cumsum(np.add.reduceat((data & 127).astype(np.int64) << bits, first) + 1)
    of = np.searchsorted(np.cumsum([len(x) for x in lists]), last, side="right")
    n = np.bincount(of, minlength=len(lists))
    ahead = np.concatenate(([0], total))[np.cumsum(n) - n]
    return total - ahead[of] - 1, of


def _counts(postings: DataFrame) -> DataFrame:
    return (postings.filter("gram IS NOT NULL").groupBy("ticker", "gram")
            .agg(F.sum("n_chunks").alias("n_chunks")))


def _asked(requests: DataFrame, buckets: int) -> DataFrame:
    """(request_id, ticker, bucket, word, times) of the words of every request."""
    rows = requests.select("request_id", F.upper("ticker").alias("ticker"),
                           F.explode(query_words(F.col("query"))).alias("word"))
    return (rows.groupBy("request_id", "ticker", "word").agg(F.count(F.lit(1)).alias("times"))
            .withColumn("bucket", bucket_of(F.col("ticker"), buckets)))


def _rarest(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(ticker, bucket, word, gram, n_chunks): the rarest gram of every word whose grams all occur."""
    need = (asked.select("ticker", "bucket", "word").distinct()
            .withColumn("need", word_grams(F.col("word")))
            .withColumn("n_need", F.size("need")).withColumn("gram", F.explode("need")).drop("need"))
    key = ["ticker", "bucket", "gram"]
    met = need.join(counts, key).groupBy("ticker", "bucket", "word").agg(
        F.min(F.struct("n_chunks", "gram")).alias("rare"), F.count(F.lit(1)).alias("n_met"), F.max("n_need").alias("n_need"))
    return met.filter("n_met = n_need").select("ticker", "bucket", "word", "rare.gram", "rare.n_chunks")


def _bounded(asked: DataFrame, rare: DataFrame, postings: DataFrame) -> DataFrame:
    """(request_id, ticker, bucket, accession_number, chunk_id, bound, lists) of the chunks in the words' lists."""
    key = ["request_id", "ticker", "bucket", "block"]
    sums = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.select(*key[:-1]).schema) + (
        ", block bigint, places array<int>, bounds array<bigint>, lists array<bigint>")

    def summed(lists: pa.Table) -> pa.Table:
        """The sums of a request in a block: few lists of a few thousand chunks."""
        place, of = listed(lists.column("places").to_pylist())
        times = lists.column("times").to_numpy()
        n = np.bincount(place)
        at = np.flatnonzero(n)
        bound = np.bincount(place, weights=times[of])[at]
        arrays = (at.astype(np.int32), bound.astype(np.int64), n[at].astype(np.int64))
        return pa.table([*(lists.column(c).slice(0, 1) for c in key),
                         *(pa.ListArray.from_arrays([0, len(at)], pa.array(a)) for a in arrays)],
                        names=[*key, "places", "bounds", "lists"])

    holds = (postings.filter("gram IS NOT NULL").select("ticker", "bucket", "block", "gram", "places")
             .join(rare.select("ticker", "bucket", "word", "gram"), ["ticker", "bucket", "gram"])
             .join(asked, ["ticker", "bucket", "word"]).select(*key, "times", "places"))
    named = postings.filter("gram IS NULL").select(*key[1:], "accession_numbers", "chunk_ids")
    entries = F.transform(F.arrays_zip("places", "bounds", "lists"), lambda x: F.struct(
        F.get("accession_numbers", x["places"]).alias("accession_number"),
        F.get("chunk_ids", x["places"]).alias("chunk_id"), x["bounds"].alias("bound"), x["lists"].alias("lists")))
    rows = (holds.groupBy(*key).applyInArrow(summed, sums).join(named, key[1:])
            .select(*key[:-1], F.inline(entries)))
    return rows.groupBy(*key[:-1], *CHUNK).agg(F.sum("bound").alias("bound"), F.sum("lists").alias("lists"))


def _near(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted chunks and a few others: a bit per hash, so that other texts stay where they are."""
    slot = F.pmod(F.xxhash64("ticker", *CHUNK), F.lit(64 * (wanted.count() // 8 + 1)))
    word, bit = F.shiftright(slot, 6), F.pmod(slot, F.lit(64)).cast("int")
    bits = (wanted.select(word.alias("word"), bit.alias("bit")).selectExpr("word", "shiftleft(1L, bit) AS bit")
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    return (texts.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(bits), "word")
            .filter("shiftleft(1L, bit) & bits != 0").drop("word", "bit", "bits"))


def _verified(bounded: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The true scores of some (request, chunk) pairs, and the excerpts of those that come before their ``last``."""
    words = asked.groupBy("request_id").agg(F.collect_list(F.struct("word", "times")).alias("words"))
    texts = _near(chunks.select("ticker", "bucket", *CHUNK, "chunk_text"), bounded)
    found = bounded.join(texts, ["ticker", "bucket", *CHUNK]).join(words, "request_id")
    score = let(F.lower("chunk_text"), lambda t: F.aggregate(
        "words", F.lit(0).cast("bigint"), lambda s, w: s + F.when(F.contains(t, w["word"]), w["times"]).otherwise(0)))
    scored = found.withColumn("score", score)
    excerpt = F.when(F.col("last").isNull() | _precedes("score", F.col("last")),
                     F.substring("chunk_text", 1, EXCERPT_CHARS))
    return scored.select("request_id", "filing_date", *CHUNK, "bound", "score", excerpt.alias("excerpt"))


def _first(rows: DataFrame, by: list[Column], n: int, rank: str) -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy("request_id").orderBy(*by))).filter(
        F.col(rank) <= n)


def _order(score: str) -> list[Column]:
    return [F.col(score).desc(), F.col("filing_date").desc_nulls_last(), F.col("chunk_id"), F.col("accession_number")]


def _precedes(score: str, last: Column) -> Column:
    """Whether a chunk comes before ``last`` with this score."""
    day, its = (F.coalesce(c, F.lit("0001-01-01").cast("date")) for c in (F.col("filing_date"), last["filing_date"]))
    return (F.col(score) > last["score"]) | ((F.col(score) == last["score"]) & (
        (day > its) | ((day == its) & ((F.col("chunk_id") < last["chunk_id"]) | (
            (F.col("chunk_id") == last["chunk_id"]) & (F.col("accession_number") < last["accession_number"]))))))


def search(requests: DataFrame, index: SearchIndex, top: int = TOP_PASSAGES) -> tuple[DataFrame, DataFrame]:
    """Best passages for requests (request_id, ticker, query), and what finding them took.

    The passages are those of a search through all chunks: the score is the
    number of query words that the passage contains, repeated words counted
    again; ties go to the newer filing, the smaller chunk, the smaller accession.
    The second frame has one row per request with a possible result: posted (list
    entries read for its words), candidates (chunks with a bound above zero) and
    verified (chunks whose text was read).
    """
    spark = requests.sparkSession
    chunks = index.chunks(spark)
    asked = staged(_asked(requests, index.buckets(spark)), _name())
    rare = staged(_rarest(asked, index.counts(spark)), _name())
    # Dates are few bytes; they take part in the order, so they come before any text.
    dates = chunks.select("ticker", "bucket", *CHUNK, "filing_date")
    bounded = staged(_bounded(asked, rare, index.postings(spark)).join(dates, ["ticker", "bucket", *CHUNK]), _name())
    # Staged, so that Spark knows how few they are and leaves the texts and bounds where they are.
    early = staged(_first(bounded, _order("bound"), FIRST * top, "at").drop("at"), _name())
    place = F.struct(F.col("score"), "filing_date", *CHUNK)
    first = staged(_verified(early.withColumn("last", F.lit(None).cast(LAST)), asked, chunks), _name())
    last = staged(_first(first.filter("score > 0"), _order("score"), top, "at").filter(F.col("at") == top)
                  .select("request_id", place.alias("last")), _name())
    later = staged(bounded.join(last, "request_id", "left")
                   .filter(F.col("last").isNull() | _precedes("bound", F.col("last")))
                   .join(early.select("request_id", *CHUNK), ["request_id", *CHUNK], "left_anti"), _name())
    seen = staged(first.unionByName(_verified(later, asked, chunks)), _name())
    best = _first(seen.filter("score > 0"), _order("score"), top, "rank")
    found = best.select("request_id", F.col("rank").cast("bigint").alias("rank"), "filing_date", "score",
                        "accession_number", "chunk_id", "excerpt")
    cost = (bounded.groupBy("request_id").agg(F.sum("lists").alias("posted"), F.count(F.lit(1)).alias("candidates"))
            .join(seen.groupBy("request_id").agg(F.count(F.lit(1)).alias("verified")), "request_id"))
    return found, cost


def _name() -> str:
    import uuid
    return f"search-{uuid.uuid4().hex}"
