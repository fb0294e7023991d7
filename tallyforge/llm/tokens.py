"""Token ids of whole Arrow batches of texts, by a public tokenizer file.

A text is cut before every run of white space that follows a word.  Such a
unit is encoded alike wherever it stands, so each distinct unit is encoded
once per worker and looked up afterwards, all units of a slice in one numpy
pass.  A lookup compares the bytes, not only the hash.  The memory of known
units is bounded; when it is full it starts anew.  Documents that hold an added
token of the file go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from tallyforge.llm import words

MAX_UNITS = 1_000_000
#: Longer units are encoded without being remembered.
MAX_UNIT_BYTES = 256
PARTS_AT_ONCE = 2000
#: Units of these characters are split here; all others by the library. \0 stands between units.
_PLAIN = regex.compile(r"[\0\t\n\r\x20-\x7e¡-ɏ]*")
#: The splitting patterns stored in the two tokenizer files, with \0 as end of text.
BYTE_PATTERN = r"\0|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\0]+|\s+(?![^\s\0])|\s+"
WORD_PATTERN = r"\0|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}\0]+"
#: The second one as it stands in its file.
WORD_IN_FILE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


class UnitEncoder:
    """Ids of texts by one tokenizer file; one instance per worker and file."""

    _instances: dict[str, UnitEncoder] = {}

    @classmethod
    def get(cls, path: str) -> UnitEncoder:
        if path not in cls._instances:
            cls._instances[path] = cls(path)
        return cls._instances[path]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = spec["pre_tokenizer"]
        self.lower = spec.get("normalizer") is not None
        #: In lower case, because an added token may be matched after the normalizer.
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = splits.get("pretokenizers", [splits])
        known = {"byte": parts[0].get("use_regex"),
                 "word": parts[0].get("pattern", {}).get("Regex") == WORD_IN_FILE}
        #: Other files are encoded whole, unit by unit, by the library alone.
        self.pattern = regex.compile(BYTE_PATTERN if known["byte"] else WORD_PATTERN) if any(known.values()) else None
        self.letters = _byte_letters()
        #: Between parts stands byte 0, which no part holds: its token marks the gaps.
        self.letters[0] = f" {self.letters[0]} "
        self.model_only = Tokenizer(self.tokenizer.model)
        self.model_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        gap = self.model_only.encode(self.letters[0], add_special_tokens=False).ids
        self.gap_id = gap[0]
        if len(gap) != 1:
            self.pattern = None
        self.reset()

    def release(self) -> None:
        """Give the memory of the known units back: a worker goes on to other stages."""
        self.reset()
        pa.default_memory_pool().release_unused()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.used = 0
        self.id_at, self.id_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.byte_at, self.byte_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per unit)."""
        joined = "\0".join(units)
        if self.pattern is not None and _PLAIN.fullmatch(joined) and not joined.endswith("\0"):
            return self._encode_plain(joined, len(units))
        plain = [bool(u) and "\0" not in u and self.pattern is not None and _PLAIN.fullmatch(u) is not None
                 for u in units]
        whole = iter(self.tokenizer.encode_batch_fast([u for u, p in zip(units, plain) if not p],
                                                      add_special_tokens=False))
        easy = [u for u, p in zip(units, plain) if p]
        ids, count = self._encode_plain("\0".join(easy), len(easy)) if easy else (np.zeros(0, np.uint32), [])
        simple = iter(np.split(ids, np.cumsum(count)[:-1]) if easy else [])
        each = [next(simple) if p else np.array(next(whole).ids, np.uint32) for p in plain]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def _encode_plain(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        parts = self.pattern.findall(joined.lower() if self.lower else joined)
        index: dict[str, int] = {"\0": -1}
        place = np.fromiter((index.setdefault(p, len(index) - 1) for p in parts), np.int64, len(parts))
        distinct = list(index)[1:]
        count = np.zeros(len(distinct), np.int64)
        ids: list[np.ndarray] = []
        for low in range(0, len(distinct), PARTS_AT_ONCE):
            text = "\0".join(distinct[low:low + PARTS_AT_ONCE]).encode().decode("latin-1").translate(self.letters)
            coded = np.array(self.model_only.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            between = np.flatnonzero(coded == self.gap_id)
            some = np.diff(np.concatenate(([-1], between, [len(coded)]))) - 1
            count[low:low + len(some)] = some
            ids.append(np.delete(coded, between))
        flat = np.concatenate(ids)
        gaps = place < 0
        unit = np.cumsum(gaps)[~gaps]
        place = place[~gaps]
        part_n = count[place]
        ahead = np.cumsum(part_n) - part_n
        first = np.cumsum(count) - count
        out = flat[np.arange(int(part_n.sum())) + np.repeat(first[place] - ahead, part_n)]
        return out, np.bincount(unit, weights=part_n, minlength=n).astype(np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def slices(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, ids, ids per document) of consecutive documents."""
        data, offsets = words._buffers(column)
        n, low = len(column), 0
        while low < n:
            high = int(np.searchsorted(offsets, offsets[low] + words.SLICE_BYTES, side="right")) - 1
            high = min(max(high, low + 1), n)
            ids, count = self._slice(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            yield low, ids, count
            low = high

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        blank = words._BLANK[data]
        opens = np.empty(len(data), dtype=bool)
        opens[0] = True
        np.logical_and(blank[1:], ~blank[:-1], out=opens[1:])
        opens[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(opens)
        length = np.diff(np.append(start, len(data)))
        within = np.arange(len(data)) - np.repeat(start, length)
        value = words._BYTE[data] * words._powers(int(length.max()))[within]
        value ^= value >> np.uint64(29)
        key = words.mix(np.add.reduceat(value, start) + length.astype(np.uint64) * words._GOLDEN)
        del value, within
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        slot = self._slots(data, unique, start[first], length[first])
        unit_n = self.id_n[slot]
        owner = np.searchsorted(offsets, start, side="right") - 1
        n_ids = unit_n[inverse]
        count = np.bincount(owner, weights=n_ids, minlength=len(offsets) - 1).astype(np.int64)
        total = int(n_ids.sum())
        ahead = np.cumsum(n_ids) - n_ids
        ids = self.ids[np.arange(total) + np.repeat(self.id_at[slot][inverse] - ahead, n_ids)]
        odd = np.union1d(self._odd_documents(data, start, length, owner, blank), self._with_added(data, offsets))
        if len(odd):
            ends = np.cumsum(count)
            pieces, last = [], 0
            for d in odd:
                whole = self._whole(data[offsets[d]:offsets[d + 1]].tobytes().decode("utf-8"))
                pieces += [ids[last:ends[d] - count[d]], whole]
                last, count[d] = ends[d], len(whole)
            ids = np.concatenate([*pieces, ids[last:]])
        return ids, count

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents that hold an added token's content in any case."""
        raw, found = data.tobytes().lower(), []
        for content in filter(None, self.added):
            at = raw.find(content)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, side="right")) - 1
                found.append(d)
                at = raw.find(content, max(at + 1, int(offsets[d + 1]) - len(content) + 1))
        return np.array(found, np.int64)

    @staticmethod
    def _odd_documents(data, start, length, owner, blank) -> np.ndarray:
        """Documents in which a word that may end in a non-ASCII blank stands before a longer run of blanks."""
        later = start[1:][blank[start[1:]] & (owner[1:] == owner[:-1])]
        before = data[later - 1]
        follows = np.append(blank, True)[later + 1]
        risky = later[((before > 0x7E) | (before < 0x20)) & follows]
        return np.unique(owner[np.searchsorted(start, risky)])

    def _slots(self, data, unique, start, length) -> np.ndarray:
        """A slot of the tables for every distinct unit, new ones included."""
        if self.used + len(unique) > MAX_UNITS:
            self.reset()
        at = np.searchsorted(self.keys, unique)
        hit = np.zeros(len(unique), dtype=bool)
        slot = np.zeros(len(unique), np.int64)
        if self.used:
            at_most = np.minimum(at, len(self.keys) - 1)
            hit = self.keys[at_most] == unique
            slot[hit] = self.slots[at_most[hit]]
            hit[hit] = self._same(data, start[hit], length[hit], slot[hit])
        new = np.flatnonzero(~hit)
        if len(new):
            units = [data[s:s + n].tobytes() for s, n in zip(start[new].tolist(), length[new].tolist())]
            flat, ids_n = self._encode_units([u.decode("utf-8") for u in units])
            self.id_at = np.append(self.id_at, len(self.ids) + np.cumsum(ids_n) - ids_n)
            self.id_n = np.append(self.id_n, ids_n)
            self.byte_at = np.append(self.byte_at, len(self.bytes) + np.cumsum(length[new]) - length[new])
            self.byte_n = np.append(self.byte_n, length[new])
            self.ids = np.append(self.ids, flat)
            self.bytes = np.append(self.bytes, np.frombuffer(b"".join(units), np.uint8))
            slot[new] = self.used + np.arange(len(new))
            self.used += len(new)
            place = at[new]
            self.keys = np.insert(self.keys, place, unique[new])
            self.slots = np.insert(self.slots, place, slot[new])
        return slot

    def _same(self, data, start, length, slot) -> np.ndarray:
        """Whether each unit has the bytes its slot was made from."""
        same = self.byte_n[slot] == length
        n = np.where(same, length, 0)
        ahead = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        differ = data[step + np.repeat(start - ahead, n)] != self.bytes[step + np.repeat(self.byte_at[slot] - ahead, n)]
        wrong = np.add.reduceat(np.append(differ, False), ahead) if len(ahead) else ahead
        return same & ~(np.where(n > 0, wrong, 0) > 0)
