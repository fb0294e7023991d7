"""Frequent phrases and how strongly their words attract each other.

Documents are dealt to shards of bounded size.  A shard counts its words and
sends them, packed per bucket; the words that are frequent in all shards get ids
there, and the shard builds a bidirectional FM-index over these.  What a shard
holds stays in its bucket on disk; only questions and answers are shuffled.  Then phrases grow by one word a round: every shard
extends the intervals of its frequent phrases to both sides, the counts of all
shards are summed, and the shards go on with the phrases that are frequent in
total.  A phrase is named by the ids of its beginning and its end, so no
phrase travels as text and none is mistaken for another.

Most pairs of frequent words are rare, so the pairs of the text are asked about
before it is indexed: a shard sends their hashes and counts, packed per bucket,
and gets a bit for each.  Hashes that fall together only let a rare pair pass
this first look.  The text is cut where a pair did not pass, the index is built
over what is left, and the pairs it holds are counted by their ids.

The larger the corpus, the more of a shard's pairs are frequent, up to all of
them.  What a shard holds is therefore compressed before it leaves a worker and
is its file's only row in a row group, so that a task has one shard at hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyforge.llm import words
from tallyforge.llm.ask import bucket_of
from tallyforge.llm.common import ROW_BY_ROW, give_back, shuffle_partitions, stage, stage_by, table, unstage
from tallyforge.llm.fm_index import FmIndex, Grown, Intervals
from tallyforge.operators.top import top_per_key

MIN_COUNT, MAX_WORDS, PER_LANG = 100, 5, 2000
SHARD_WORDS = 1 << 20
#: What ends a piece, and what stands between its words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
SHARD = "shard long, langs array<string>, lang binary, words binary, n binary, places binary, tokens binary"
WORDS = "bucket int, shard long, langs array<string>, lang binary, words binary, n binary"
NAMED = ("shard long, bucket int, ranks binary, frequent array<struct<id: long, lang: string, word: string, f: long>>, "
         "sizes array<struct<lang: string, n: long>>")
TEXT = "shard long, ids binary, text binary"
ASKED = "bucket int, shard long, keys binary, counts binary"
ANSWER = "shard long, bucket int, bits binary"
STATE = "shard long, low binary, back binary, n binary, prefix binary, suffix binary, buckets binary, ends binary"
INDEX = f"{STATE}, forward binary, backward binary"
COUNTED = ("shard long, bucket int, ranks binary, "
           "phrases array<struct<id: long, prefix: long, suffix: long, f: long>>")

_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
_OUTSIDE = _ENDS.copy()
_OUTSIDE[list(BLANKS)] = True


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte of their places: the leading bytes are mostly alike and compress."""
    width = numbers.dtype.itemsize
    return np.ascontiguousarray(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, width).T).tobytes()


def _unpacked(raw: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _closed(numbers: np.ndarray | bytes) -> bytes:
    """What stays with a shard, compressed: on its way to a file the JVM copies it several times."""
    raw = numbers if isinstance(numbers, bytes) else _packed(numbers)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(raw: bytes, dtype: type | None = None) -> np.ndarray | bytes:
    size = int.from_bytes(raw[:8], "little")
    plain = pa.decompress(memoryview(raw)[8:], size, "zstd", asbytes=True)
    return _unpacked(plain, dtype) if dtype else plain


def piece_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, opens a piece) of the words of consecutive texts."""
    inside = ~_OUTSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])) | inside & edge[:-1])
    end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    # A word opens a piece where an end of a piece or a text's first byte lies since the word before.
    marks = np.cumsum(_ENDS[data] | edge[:-1])
    opens = np.ones(len(start), bool)
    opens[1:] = marks[start[1:]] > marks[start[:-1]]
    return start, end, opens


class _Shard:
    """Words of documents as numbers of a vocabulary; 0 stands between pieces."""

    def __init__(self) -> None:
        self.number: dict[tuple[str, bytes], int] = {}
        self.tokens: list[np.ndarray] = []
        self.n_words = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> None:
        start, end, opens = piece_words(data, offsets)
        if not len(start):
            return
        kinds = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        lang = np.array([kinds[x] for x in langs])[np.searchsorted(offsets, start, side="right") - 1]
        place = _same_words(data, start, end, lang)
        names, first = list(kinds), np.unique(place, return_index=True)[1]
        keys = [(names[k], data[a:b].tobytes())
                for k, a, b in zip(lang[first].tolist(), start[first].tolist(), end[first].tolist())]
        number = np.array([self.number.setdefault(key, len(self.number) + 1) for key in keys], np.int32)
        out = np.zeros(len(start) + int(opens.sum()), np.int32)
        out[np.arange(len(start)) + np.cumsum(opens)] = number[place]
        self.tokens.append(out)
        self.n_words += len(start)

    def row(self, shard: int) -> pa.RecordBatch:
        """The words in the order of their hashes, so that those of a bucket follow each other."""
        keys = list(self.number)
        length = np.array([len(word) for _, word in keys])
        data = np.frombuffer(b"".join(word for _, word in keys), np.uint8)
        place = words.mix(_sums(data, np.arange(len(data)), length)) >> np.uint64(32)
        order = np.argsort(place, kind="stable")
        number = np.zeros(len(keys) + 1, np.int32)
        number[order + 1] = np.arange(1, len(keys) + 1)
        tokens = number[np.concatenate([*self.tokens, np.zeros(1, np.int32)])]
        n = np.bincount(tokens, minlength=len(keys) + 1)[1:]
        langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in keys))}
        lang = np.array([langs[lang] for lang, _ in keys], np.int32)[order]
        # No word holds a blank.
        joined = b" ".join(keys[i][1] for i in order.tolist())
        return pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([list(langs)], pa.list_(pa.string()))]
            + [pa.array([raw], pa.binary()) for raw in map(_closed, (
                lang, joined, n.astype(np.uint32), place[order].astype(np.uint32), tokens))],
            names=[f.split()[0] for f in SHARD.split(", ")])


def _sums(data: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A sum over the bytes of every word; ``place`` has the bytes' places, word by word."""
    ahead = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(ahead, length)
    value = words._BYTE[data[place]] * words._powers(int(length.max()))[within]
    value ^= value >> np.uint64(29)
    return np.add.reduceat(value, ahead) + length.astype(np.uint64) * words._GOLDEN


def _same_words(data, start, end, lang) -> np.ndarray:
    """A number for every word, equal for equal bytes of one lang: by hash, then compared byte by byte."""
    length = end - start
    place = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    key = words.mix(_sums(data, place, length)) ^ words.mix(lang.astype(np.uint64) + np.uint64(1))
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    model = first[number]
    same = (length == length[model]) & (lang == lang[model])
    n = np.where(same, length, 0)
    differ = data[place[np.repeat(same, length)]] != data[np.repeat(start[model] - (np.cumsum(n) - n), n)
                                                         + np.arange(int(n.sum()))]
    same[np.repeat(np.arange(len(n)), n)[differ]] = False
    others: dict[tuple[int, bytes], int] = {}
    for i in np.flatnonzero(~same).tolist():
        number[i] = len(first) + others.setdefault((int(lang[i]), data[start[i]:end[i]].tobytes()), len(others))
    return number


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Documents as rows of ``SHARD``: words in lower case (A to Z), per lang, null langs as ``und``.

    A shard holds about ``shard_words`` words, or one longer document.
    """
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        held = _Shard()
        for batch in batches:
            data, offsets = words._buffers(batch.column(0))
            langs, low = batch.column(1).to_pylist(), 0
            while low < len(langs):
                high = int(np.searchsorted(offsets, offsets[low] + words.SLICE_BYTES, side="right")) - 1
                high = min(max(high, low + 1), len(langs))
                held.add(words.lower_ascii(data[offsets[low]:offsets[high]]), offsets[low:high + 1] - offsets[low],
                         langs[low:high])
                if held.n_words >= shard_words:
                    yield held.row(number)
                    number, held = number + 1, _Shard()
                low = high
        if held.n_words:
            yield held.row(number)

    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).mapInArrow(deal, SHARD)


def _ask_words(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of every shard and their counts, packed per bucket."""
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                place = _opened(row["places"], np.uint32).astype(np.uint64) << np.uint64(32)
                bucket = bucket_of(place, buckets).astype(np.int32)
                lang, n = _opened(row["lang"], np.int32), _opened(row["n"], np.uint32)
                word = _opened(row["words"]).split(b" ")
                cuts = _cuts(bucket)
                parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                columns = [pa.array(bucket[cuts[:-1]]), pa.array([row["shard"]] * len(parts), pa.int64()),
                           pa.array([row["langs"]] * len(parts), pa.list_(pa.string())),
                           pa.array([_packed(lang[a:b]) for a, b in parts], pa.binary()),
                           pa.array([b" ".join(word[a:b]) for a, b in parts], pa.binary()),
                           pa.array([_packed(n[a:b]) for a, b in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in WORDS.split(", ")])
    return ask


def _name_words(min_count: int):
    kinds = to_arrow_schema(StructType.fromDDL(NAMED))

    def name(key: tuple, asked: pa.Table) -> pa.Table:
        """Places of the frequent words of a bucket: per shard, -1 for others, and one row with the words themselves."""
        bucket, number, place, each = key[0].as_py(), {}, [], []
        for langs, lang, raw in zip(*(asked.column(c).to_pylist() for c in ("langs", "lang", "words"))):
            of = _unpacked(lang, np.int32).tolist()
            place.append(np.array([number.setdefault((langs[i], word), len(number))
                                   for i, word in zip(of, raw.split(b" "))]))
            each.append(len(of))
        place, n = np.concatenate(place), np.concatenate([_unpacked(x, np.uint32) for x in asked.column("n").to_pylist()])
        total = np.bincount(place, weights=n).astype(np.int64)
        enough = total >= min_count
        rank = np.where(enough, np.cumsum(enough) - 1, -1).astype(np.int32)
        sizes: dict[str, int] = {}
        for (lang, _), count in zip(number, total.tolist()):
            sizes[lang] = sizes.get(lang, 0) + count
        frequent = [{"id": (bucket << 40) + r, "lang": lang, "word": word.decode(), "f": f}
                    for (lang, word), r, f in zip(number, rank.tolist(), total.tolist()) if r >= 0]
        rest = [[]] * len(each)
        blobs = [_packed(part) for part in np.split(rank[place], np.cumsum(each)[:-1])]
        return pa.table([pa.array([None, *asked.column("shard").to_pylist()], pa.int64()),
                         pa.array([bucket] * (len(each) + 1), pa.int32()), pa.array([None, *blobs], pa.binary()),
                         pa.array([frequent, *rest], kinds.field("frequent").type),
                         pa.array([[{"lang": k, "n": v} for k, v in sizes.items()], *rest], kinds.field("sizes").type)],
                        schema=kinds)
    return name


def _ids(ranks: dict[int, np.ndarray]) -> np.ndarray:
    """Ids by bucket and place in it; -1 for what is not frequent."""
    return np.concatenate([np.where(r >= 0, (b << 40) + r.astype(np.int64), -1) for b, r in ranks.items()])


def _text(key: tuple, shard: pa.Table, named: pa.Table) -> pa.Table:
    """The text of a shard over its frequent words, numbered from 1; other words end a piece."""
    tokens = _opened(shard.column("tokens")[0].as_py(), np.int32)
    ranks = {b: _unpacked(raw, np.int32) for b, raw in zip(named.column("bucket").to_pylist(),
                                                           named.column("ranks").to_pylist())}
    ids = _ids({b: ranks[b] for b in sorted(ranks)})
    at = np.flatnonzero(ids >= 0)
    symbol = np.zeros(int(tokens.max(initial=0)) + 1, np.int32)
    symbol[at + 1] = np.arange(1, len(at) + 1)
    text = symbol[tokens]
    # One separator between pieces is enough.
    text = text[np.concatenate(([True], (text[1:] > 0) | (text[:-1] > 0)))]
    return _row(TEXT, key[0].as_py(), [ids[at], text])


def _row(schema: str, shard: int, arrays: list[np.ndarray]) -> pa.Table:
    """One row of a shard and its numbers."""
    return pa.table([pa.array([shard], pa.int64())] + [pa.array([_closed(a)], pa.binary()) for a in arrays],
                    names=[f.split()[0] for f in schema.split(", ")])


def _of_text(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return _opened(row["ids"], np.int64), _opened(row["text"], np.int32)


def _adjacent(text: np.ndarray, size: int) -> np.ndarray:
    """A number for every place: its word and the next one, or 0 where a piece ends."""
    key = np.zeros(len(text), np.int64)
    key[:-1] = text[:-1].astype(np.int64) * size + text[1:]
    key[:-1][(text[:-1] == 0) | (text[1:] == 0)] = 0
    return key


def _questions(begin: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket, key in the bucket) of pairs of ids, by bucket and key."""
    key = words.mix(words.mix(begin.astype(np.uint64) + np.uint64(1)) * words._GOLDEN + end.astype(np.uint64))
    bucket = bucket_of(key, buckets).astype(np.int64)
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(bucket << 32 | low, kind="stable")
    return order, bucket[order], low[order]


def _cuts(bucket: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))


def _ask(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, text = _of_text(row)
                size = len(ids) + 1
                key, n = np.unique(_adjacent(text, size), return_counts=True)
                key, n = key[key > 0], n[key > 0]
                if not len(key):
                    continue
                order, bucket, low = _questions(ids[key // size - 1], ids[key % size - 1], buckets)
                cuts, n = _cuts(bucket), n[order]
                parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                columns = [pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([row["shard"]] * len(parts), pa.int64()),
                           pa.array([_packed(low[a:b].astype(np.uint32)) for a, b in parts], pa.binary()),
                           pa.array([_packed(n[a:b].astype(np.uint32)) for a, b in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "shard", "keys", "counts"])
    return ask


def _answer(min_count: int):
    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        """Whether the counts of all shards for a key reach ``min_count``, a bit per key and shard."""
        keys, counts = ([_unpacked(raw, np.uint32) for raw in asked.column(c).to_pylist()] for c in ("keys", "counts"))
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts))
        enough = np.split(total[place] >= min_count, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table([asked.column("shard"), pa.array([key[0].as_py()] * len(keys), pa.int32()),
                         pa.array([np.packbits(e).tobytes() for e in enough], pa.binary())],
                        names=["shard", "bucket", "bits"])
    return answer


def _linked(text: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The text cut between the words that ``links`` does not hold together; single words go."""
    keep = links.copy()
    keep[1:] |= links[:-1]
    opens = keep.copy()
    opens[1:] &= ~links[:-1]
    out = np.zeros(int(keep.sum()) + int(opens.sum()) + 1, np.int32)
    out[np.arange(int(keep.sum())) + np.cumsum(opens)[keep]] = text[keep]
    return out


def _index(buckets: int):
    def index(key_: tuple, shard: pa.Table, answers: pa.Table) -> pa.Table:
        """The index over what is left of a shard's text, and its pairs that may be frequent."""
        ids, text = _of_text(shard.select(["ids", "text"]).to_pylist()[0])
        size = len(ids) + 1
        place = _adjacent(text, size)
        key = np.unique(place[place > 0])
        order, bucket, _ = _questions(ids[key // size - 1], ids[key % size - 1], buckets)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
        cuts = _cuts(bucket)
        passed = np.zeros(len(key) + 1, bool)
        passed[order] = np.concatenate(
            [np.unpackbits(np.frombuffer(bits[int(bucket[a])], np.uint8), count=b - a).astype(bool)
             for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
        links = passed[np.where(place > 0, np.searchsorted(key, place), len(key))]
        rest = FmIndex.of(_linked(text, links))
        grown = rest.grow(rest.words())
        return _row(INDEX, key_[0].as_py(), [*_state(grown, ids, buckets), rest.forward, rest.backward])
    return index


def _state(grown: Grown, ids: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Phrases by the bucket of their ids: intervals, ids of beginning and end, the buckets and where they end."""
    begin, end = ids[grown.prefix], ids[grown.suffix]
    order, bucket, _ = _questions(begin, end, buckets)
    cuts = _cuts(bucket) if len(bucket) else np.zeros(1, np.int64)
    return [*(a[order].astype(np.int32) for a in grown.intervals), begin[order], end[order],
            bucket[cuts[:-1]].astype(np.int32), cuts[1:].astype(np.int32)]


_PHRASES = "bucket int, shard long, prefix binary, suffix binary, n binary"


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of every shard, packed per bucket."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            bucket, ends = (_opened(row[c], np.int32) for c in ("buckets", "ends"))
            parts = list(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()))
            columns = [_opened(row[c], kind) for c, kind in (("prefix", np.int64), ("suffix", np.int64), ("n", np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array([row["shard"]] * len(parts), pa.int64())]
                + [pa.array([_packed(c[a:b]) for a, b in parts], pa.binary()) for c in columns],
                names=[f.split()[0] for f in _PHRASES.split(", ")])


def _count(min_count: int):
    def count(key: tuple, asked: pa.Table) -> pa.Table:
        """Places of the frequent phrases of a bucket: per shard, -1 for others, and one row with the phrases themselves."""
        bucket = key[0].as_py()
        begin, end = ([_unpacked(raw, np.int64) for raw in asked.column(c).to_pylist()] for c in ("prefix", "suffix"))
        n = [_unpacked(raw, np.int32) for raw in asked.column("n").to_pylist()]
        each = np.cumsum([len(part) for part in n])
        begin, end, n = (np.concatenate(parts) for parts in (begin, end, n))
        order = np.lexsort((end, begin))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(begin[order]) != 0) | (np.diff(end[order]) != 0)
        total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
        enough = total >= min_count
        number = np.where(enough, np.cumsum(enough) - 1, -1).astype(np.int32)
        ranks = np.empty(len(order), np.int32)
        ranks[order] = number[np.cumsum(new) - 1]
        first = order[new][enough]
        entries = pa.StructArray.from_arrays(
            [pa.array(a) for a in ((bucket << 40) + np.arange(len(first)), begin[first], end[first], total[enough])],
            names=["id", "prefix", "suffix", "f"])
        blobs = [_packed(part) for part in np.split(ranks, each[:-1])]
        return pa.table(
            [pa.array([None, *asked.column("shard").to_pylist()], pa.int64()),
             pa.array([bucket] * (len(blobs) + 1), pa.int32()), pa.array([None, *blobs], pa.binary()),
             pa.ListArray.from_arrays(pa.array([0] + [len(entries)] * (len(blobs) + 1), pa.int32()), entries)],
            names=["shard", "bucket", "ranks", "phrases"])
    return count


def _longer(buckets: int):
    def longer(key: tuple, shard: pa.Table, counted: pa.Table) -> pa.Table:
        """Phrases one word longer than the frequent ones of the shard."""
        row = shard.to_pylist()[0]
        answers = dict(zip(counted.column("bucket").to_pylist(), counted.column("ranks").to_pylist()))
        ids = _ids({b: _unpacked(answers[b], np.int32) for b in _opened(row["buckets"], np.int32).tolist()})
        known = Intervals(*(_opened(row[c], np.int32)[ids >= 0] for c in ("low", "back", "n")))
        grown = FmIndex(*(_opened(row[c], np.int32) for c in ("forward", "backward"))).grow(known)
        return _row(STATE, key[0].as_py(), _state(grown, ids[ids >= 0], buckets))
    return longer


def _by_shard(left: DataFrame, right: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over the rows of every shard that both frames have."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def both(key: tuple, mine: pa.Table, other: pa.Table) -> pa.Table:
        found = fn(key, mine, other) if mine.num_rows and other.num_rows else kinds.empty_table()
        give_back()
        return found

    other = right.withColumnRenamed("shard", "of")
    return left.groupBy("shard").cogroup(other.groupBy("of")).applyInArrow(both, schema)


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
            shard_words: int = SHARD_WORDS) -> DataFrame:
    """All phrases of 2 to ``max_words`` words that occur at least ``min_count`` times in their lang.

    lang, words, a (occurrences), n (words of the lang), begins and ends
    (occurrences of the phrase's first and last 1, 2, ... words), left and right
    (occurrences of the most frequent phrase with one more word in front or
    behind; 0 if none is frequent).  Occurrences lie within pieces and may
    overlap.  Null texts are empty; ids and other columns are not read, repeated
    rows count again.
    """
    dealt = stage(shards(docs, shard_words), ROW_BY_ROW)
    # A bucket sums what one shard or so asks, whatever their number.
    buckets = max(shuffle_partitions(docs.sparkSession), dealt.count())
    named = stage(dealt.mapInArrow(_ask_words(buckets), WORDS).groupBy("bucket")
                  .applyInArrow(_name_words(min_count), NAMED))
    sizes = named.filter("shard IS NULL").select(F.inline("sizes")).groupBy("lang").agg(F.sum("n").alias("n"))
    level = (named.filter("shard IS NULL").select(F.inline("frequent"))
             .select("id", "lang", F.array("word").alias("words"), "f",
                     F.array().cast("array<bigint>").alias("begins"), F.array().cast("array<bigint>").alias("ends")))
    texts = stage_by(_by_shard(dealt.select("shard", "tokens"),
                               named.filter("shard IS NOT NULL").select("shard", "bucket", "ranks"), _text, TEXT),
                     "shard", buckets, ROW_BY_ROW)
    unstage(dealt)
    answers = (texts.mapInArrow(_ask(buckets), ASKED).groupBy("bucket")
               .applyInArrow(_answer(min_count), ANSWER))
    index = stage_by(_by_shard(texts, answers, _index(buckets), INDEX), "shard", buckets, ROW_BY_ROW)
    unstage(texts)
    state, levels = index, []
    for size in range(2, max_words + 1):
        counted = stage(state.select("shard", "prefix", "suffix", "n", "buckets", "ends").mapInArrow(_exact, _PHRASES)
                        .groupBy("bucket").applyInArrow(_count(min_count), COUNTED))
        total = counted.filter("shard IS NULL").select(F.inline("phrases"))
        begin = level.select(F.col("id").alias("prefix"), "lang", F.col("words").alias("begin_words"),
                             F.concat("begins", F.array("f")).alias("begins"))
        end = level.select(F.col("id").alias("suffix"), F.slice("words", -1, 1).alias("last_word"),
                           F.concat("ends", F.array("f")).alias("ends"))
        level = stage(total.join(begin, "prefix").join(end, "suffix").select(
            "id", "prefix", "suffix", "lang",
            F.concat("begin_words", "last_word").alias("words"), "f", "begins", "ends"))
        levels.append(level)
        known = state
        if size < max_words:
            here = state if size == 2 else state.join(index.select("shard", "forward", "backward"), "shard")
            here = here.select("shard", "low", "back", "n", "buckets", "forward", "backward")
            state = stage_by(_by_shard(here, counted.filter("shard IS NOT NULL").select("shard", "bucket", "ranks"),
                                       _longer(buckets), STATE), "shard", buckets, ROW_BY_ROW)
        unstage(counted)
        if known is not index:
            unstage(known)
    unstage(index)
    out = None
    for k, level in enumerate(levels):
        one = level.select("id", "lang", "words", F.col("f").alias("a"), "begins", "ends")
        for side, name in (("suffix", "left"), ("prefix", "right")):
            if k + 1 < len(levels):
                most = levels[k + 1].groupBy(F.col(side).alias("id")).agg(F.max("f").alias(name))
                one = one.join(most, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
            else:
                one = one.withColumn(name, F.lit(0).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out.drop("id").join(sizes, "lang")


def scored(found: DataFrame) -> DataFrame:
    """Phrases with the score of their weakest cut, without those that a longer one explains.

    A phrase goes if a longer one that holds it occurs as often.  A longer one
    by several words is never more frequent than those between, so one word
    more on either side decides.
    """
    weakest = F.expr(
        "array_min(transform(begins, (l, k) -> named_struct('score',"
        " cast(1000 as decimal(4,0)) * cast(a as decimal(18,0)) * cast(n as decimal(18,0))"
        " div (cast(l as decimal(18,0)) * cast(ends[size(ends) - 1 - k] as decimal(18,0))),"
        " 'k', k, 'l', l, 'r', ends[size(ends) - 1 - k])))")
    return (found.filter(F.greatest("left", "right") < F.col("a")).withColumn("cut", weakest)
            .select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score",
                    "left", "right"))


def collocations(docs: DataFrame, per_lang: int = PER_LANG, **options) -> DataFrame:
    """The ``per_lang`` best phrases of each lang: rank, phrase, a, l, r, n, score, left, right."""
    best = top_per_key(scored(phrases(docs, **options)), ["lang"],
                       [F.desc("score"), F.desc("a"), F.asc("phrase")], per_lang, "rank", deal_by=["phrase"])
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
                       "left", "right")


#: The same result in SQL: every phrase spelt out, counted and compared.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w FROM split WHERE len(w) > 0),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM sized GROUP BY lang),
numbered AS (SELECT row_number() OVER () AS piece, lang, w FROM sized),
each AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM numbered),
ahead AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4,
         lead(w1, 4) OVER p AS w5
  FROM each WINDOW p AS (PARTITION BY piece ORDER BY i)),
spelt AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM ahead
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM ahead WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM ahead WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, 5, concat_ws(' ', w1, w2, w3, w4, w5) FROM ahead WHERE w5 IS NOT NULL),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM spelt GROUP BY ALL HAVING count(*) >= 100),
held AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS w, k, f FROM counts WHERE k > 1),
covered AS (
  SELECT DISTINCT long.lang, array_to_string(long.w[i.i:i.i + m.m - 1], ' ') AS phrase, max(long.f) AS f
  FROM held AS long, range(2, 5) AS m(m), LATERAL (SELECT unnest(range(1, long.k - m.m + 2)) AS i) AS i
  WHERE m.m < long.k GROUP BY ALL),
cuts AS (
  SELECT h.lang, h.phrase, h.f AS a, c.c AS cut, p.f AS l, s.f AS r, t.n,
         (1000::HUGEINT * h.f * t.n) // (p.f::HUGEINT * s.f) AS score
  FROM held AS h JOIN totals AS t USING (lang), range(1, 5) AS c(c), counts AS p, counts AS s
  WHERE c.c < h.k AND p.lang = h.lang AND p.k = c.c AND p.phrase = array_to_string(h.w[1:c.c], ' ')
    AND s.lang = h.lang AND s.k = h.k - c.c AND s.phrase = array_to_string(h.w[c.c + 1:], ' ')),
weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT w.* FROM weakest AS w LEFT JOIN covered AS v ON v.lang = w.lang AND v.phrase = w.phrase
  WHERE v.f IS NULL OR v.f < w.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
