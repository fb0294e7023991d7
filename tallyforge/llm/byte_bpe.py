"""Byte-level BPE by ranks, encoded and decoded through a sentencepiece model made from the rank file.

Every token of the rank file becomes a piece: its bytes are written as one
letter each, and its score is the negative rank, so that the model merges in
the order of the ranks.  The model normalises nothing.  Texts are split by the
vocabulary's pattern; every match is encoded on its own, once per worker as
long as it is remembered.  Ids decode by the letters of their pieces.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

#: Texts taken at once, characters cut out of a long text at once, characters of matches remembered.
SLICE_BYTES, CUT_CHARS, REMEMBERED_CHARS = 1 << 20, 1 << 20, 8 << 20
#: Longer matches are encoded without being remembered.
LONGEST_REMEMBERED = 64
CODED = "doc_id long, ids array<int>, decoded binary"
#: A text may be cut here: no match reaches from another character into white space.
_CUT = regex.compile(r"(?<=\S)(?=\s)")


def _letters() -> list[str]:
    """A letter for every byte: printable Latin-1 characters stand for themselves."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


LETTERS = _letters()
_TO_LETTERS = dict(enumerate(LETTERS))
_BYTE_OF = {letter: b for b, letter in enumerate(LETTERS)}


def read_ranks(path: str) -> list[tuple[int, bytes]]:
    """(rank, token) in the order of ranks: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def model_bytes(ranks: list[tuple[int, bytes]]) -> bytes:
    """A serialised sentencepiece BPE model; piece i is the i-th token, the unknown piece comes last.

    Field numbers and kinds are those of sentencepiece's public model format.
    """
    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece(as_letters(token), -rank, normal) for rank, token in ranks]
    trainer = (_number(3, bpe) + _number(4, len(ranks) + 1) + _number(40, len(ranks))
               + b"".join(_number(field, -1) for field in (41, 42, 43)))
    # No blank in front, no blanks removed, none escaped.
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + piece("<unk>", 0.0, unknown) + _block(2, trainer) + _block(3, normalizer)


def as_letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_LETTERS)


def from_letters(text: str) -> bytes:
    return bytes(map(_BYTE_OF.__getitem__, text))


class ByteBpe:
    """Encoder and decoder of one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        if max((rank for rank, _ in ranks), default=0) >= 1 << 24:
            raise ValueError("a score of 32 bits holds ranks below 2^24 only")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.pattern = regex.compile(pattern)
        self.rank_of = np.array([rank for rank, _ in ranks] + [-1], "<i4")
        self.token_of = {rank: from_letters(self.model.id_to_piece(i)) for i, (rank, _) in enumerate(ranks)}
        # A match that is a token is that token, also where merging does not lead to it.
        texts = [as_letters(token) for _, token in ranks]
        reached = self.model.encode(texts, num_threads=1)
        self.whole = {text: i for i, (text, got) in enumerate(zip(texts, reached)) if len(got) != 1}
        self.known: dict[str, bytes] = {}
        self.known_chars = 0

    def _learn(self, matches: list[str]) -> None:
        """Add the ids of new matches to the known ones, all by one call of the model."""
        texts = [as_letters(m.encode()) for m in matches]
        pieces = self.model.encode(texts, num_threads=1)
        for at, text in enumerate(texts if self.whole else ()):
            if text in self.whole:
                pieces[at] = [self.whole[text]]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.rank_of[np.fromiter(chain.from_iterable(pieces), np.int64, int(size.sum()))]
        if (ids < 0).any():
            raise ValueError("the rank file lacks a byte that the texts hold")
        raw, ends = ids.tobytes(), (4 * np.cumsum(size)).tolist()
        self.known.update(zip(matches, (raw[a:b] for a, b in zip([0, *ends], ends))))
        self.known_chars += sum(map(len, matches))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, as 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for at, text in enumerate(texts):
            for part in _parts(text):
                held.append((at, part))
                size += len(part)
                if size >= CUT_CHARS:
                    self._encode_parts(held, out)
                    held, size = [], 0
        self._encode_parts(held, out)
        return [np.frombuffer(b"".join(ids), "<i4") for ids in out]

    def _encode_parts(self, parts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        matches = [self.pattern.findall(part) for _, part in parts]
        if self.known_chars > REMEMBERED_CHARS:
            self.known, self.known_chars = {}, 0
        new = list(set().union(*matches).difference(self.known))
        if new:
            self._learn(new)
        for (at, _), found in zip(parts, matches):
            out[at].append(b"".join(map(self.known.__getitem__, found)))
        for match in new:
            if len(match) > LONGEST_REMEMBERED:
                del self.known[match]
                self.known_chars -= len(match)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, by the letters of their pieces."""
        return b"".join(map(self.token_of.__getitem__, ids.tolist()))


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that are split alike alone and together."""
    low = 0
    while len(text) - low > CUT_CHARS:
        cut = _CUT.search(text, low + CUT_CHARS)
        if cut is None:
            break
        yield text[low:cut.start()]
        low = cut.start()
    yield text[low:] if low else text


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about ``SLICE_BYTES`` each, or one longer text."""
    ends = np.cumsum(pc.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(column):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield low, column.slice(low, high - low).to_pylist()
        low = high


def encoded(docs: DataFrame, path: str, pattern: str, decode: bool = True) -> DataFrame:
    """doc_id, the ids of the whole text and, unless left out, the bytes that the ids decode to.

    Null and empty texts have no ids.  Rows that share a doc_id, or have none,
    stay rows of their own; other columns are not read.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for low, texts in _slices(batch.column(1)):
                ids = bpe.encode_all([t or "" for t in texts])
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                raw = [bpe.decode(i) if decode else None for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(texts)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                     pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, CODED)


def decoded(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of ``ids``; null ids are none."""
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            raw = [bpe.decode(np.array(i or [], "<i4")) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())],
                                             names=["doc_id", "decoded"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        back, "doc_id long, decoded binary")


def byte_ranks() -> tuple[str, str]:
    """The public rank file and the pattern that goes with it."""
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoded(table(spark, sf_dir, "documents"), *byte_ranks())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
