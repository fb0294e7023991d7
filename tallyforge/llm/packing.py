"""Best-fit packing of documents into token sequences by linear grouping.

The work on rows is Spark's: token ids and pieces, the count of pieces per
length, and a rank of every piece among those of its length.  The plan needs
only the counts, at most one number per length up to the capacity, so it is
made on the driver at any size of the corpus:

1. large lengths are sorted, cut into groups of equal cardinality, and rounded
   up to the group's largest;
2. a few sizes remain; their configurations are optimised by column generation;
3. actual lengths are put in the place of the rounded ones;
4. what is left, the small pieces above all, goes where it fits best.

Bins that hold the same lengths are one class, so steps 3 and 4 work on classes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import stage, table
from tallyforge.llm.tokens import UnitEncoder

CAPACITY = 2048
END_ID = 0
#: A length is large above the capacity divided by this; the best of the resulting plans is taken.
LARGE_PARTS = (2, 3, 4, 8)
GROUPS = 64
PIECES_PER_BUCKET = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """Pieces of the token ids of every document, the end id included.

    Returns doc_id, piece (from 0), start, length, ids_crc32 and, if asked for,
    ids (binary, little-endian unsigned 32-bit).  A document longer than
    ``capacity`` is cut into full pieces; the first piece takes the rest.
    A null or empty text gives one piece with the end id alone.
    """
    names = PIECES.split(", ") + (["ids binary"] if with_ids else [])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.get(tokenizer_path)
        for batch in batches:
            ids_of = batch.column(0)
            for low, ids, count in encoder.slices(batch.column(1)):
                ids = ids.astype("<u4", copy=False)
                ends = np.cumsum(count)
                rows: dict[str, list] = {n.split()[0]: [] for n in names}
                for doc, end, n in zip(ids_of.slice(low, len(count)).to_pylist(), ends.tolist(), count.tolist()):
                    raw = ids[end - n:end].tobytes() + end_id.to_bytes(4, "little")
                    total = n + 1
                    at, k = 0, 0
                    while at < total:
                        size = (total - 1) % capacity + 1 if at == 0 else capacity
                        part = raw[4 * at:4 * (at + size)]
                        rows["doc_id"].append(doc)
                        rows["piece"].append(k)
                        rows["start"].append(at)
                        rows["length"].append(size)
                        rows["ids_crc32"].append(zlib.crc32(part))
                        if with_ids:
                            rows["ids"].append(part)
                        at, k = at + size, k + 1
                types = {"piece": pa.int32(), "ids": pa.binary()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, types.get(c, pa.int64())) for c, v in rows.items()], names=list(rows))
        encoder.release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, ", ".join(names))


def _best_configuration(value: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity that is worth most."""
    most = capacity // int(sizes.min())
    best = np.zeros(capacity + 1)
    choices = []
    for _ in range(most):
        nxt = best.copy()
        choice = np.full(capacity + 1, -1)
        for g, s in enumerate(sizes.tolist()):
            with_g = np.full(capacity + 1, -1.0)
            with_g[s:] = best[:capacity + 1 - s] + value[g]
            better = with_g > nxt + 1e-12
            nxt[better] = with_g[better]
            choice[better] = g
        choices.append(choice)
        best = nxt
    out = np.zeros(len(sizes))
    c = capacity
    for choice in reversed(choices):
        if choice[c] >= 0:
            out[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                   rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, near the optimum of the linear programme.

    Revised simplex over the demand of every size; the column to enter is the
    configuration worth most at the current prices.
    """
    n = len(sizes)
    columns = [np.eye(n)[g] * (capacity // sizes[g]) for g in range(n)]
    inverse = np.diag([1.0 / columns[g][g] for g in range(n)])
    amount = inverse @ demand
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        entering = _best_configuration(prices, sizes, capacity)
        if prices @ entering <= 1 + 1e-9:
            break
        direction = inverse @ entering
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        step = ratio[leave]
        amount = amount - step * direction
        amount[leave] = step
        inverse[leave] /= direction[leave]
        others = np.arange(n) != leave
        inverse[others] -= np.outer(direction[others], inverse[leave])
        columns[leave] = entering
    return [(c, float(x)) for c, x in zip(columns, amount) if x > 1e-9]


def plan_bins(count: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS,
              large_parts: tuple[int, ...] = LARGE_PARTS) -> list[tuple[int, list[int]]]:
    """Classes of bins: how many bins, and the lengths that each of them holds.

    ``count[length]`` is the number of pieces of that length.  The classes use
    every piece once, and their number depends on the capacity only.
    """
    plans = [_grouped_plan(count, capacity, groups, part) for part in large_parts]
    return min(plans, key=lambda classes: sum(m for m, _ in classes))


def _grouped_plan(count: np.ndarray, capacity: int, groups: int, large_part: int) -> list[tuple[int, list[int]]]:
    left = count.astype(np.int64).copy()
    classes: list[tuple[int, list[int]]] = []
    if left[capacity]:
        classes.append((int(left[capacity]), [capacity]))
        left[capacity] = 0
    large = np.arange(capacity // large_part + 1, capacity)
    total = int(left[large].sum())
    if total:
        per_group = -(-total // groups)
        order = large[::-1]
        below = np.cumsum(left[order])
        runs: list[list[list[int]]] = []
        for low in range(0, total, per_group):
            high = min(low + per_group, total)
            inside = np.minimum(below, high) - np.maximum(below - left[order], low)
            runs.append([[int(s), int(k)] for s, k in zip(order, inside) if k > 0])
        by_size: dict[int, list[list[int]]] = defaultdict(list)
        for run in runs:
            by_size[run[0][0]] += run
        sizes = np.array(list(by_size))
        members = list(by_size.values())
        demand = np.array([float(sum(k for _, k in run)) for run in members])
        for pattern, amount in configurations(sizes, demand, capacity):
            times = int(amount + 1e-6)
            slots = [g for g in range(len(sizes)) for _ in range(int(round(pattern[g])))]
            have = [sum(k for _, k in members[g]) // slots.count(g) for g in set(slots)]
            times = min([times, *have])
            if not times or not slots:
                continue
            taken = [_take(members[g], times) for g in slots]
            for s, k in (x for run in taken for x in run):
                left[s] -= k
            classes += _aligned(taken, times)
    return _best_fit(classes, left, capacity)


def _take(run: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The first ``n`` lengths of a run-length list, taken out of it."""
    out = []
    while n:
        size, k = run[0]
        use = min(k, n)
        out.append((size, use))
        n -= use
        run[0][1] -= use
        if not run[0][1]:
            run.pop(0)
    return out


def _aligned(slots: list[list[tuple[int, int]]], times: int) -> list[tuple[int, list[int]]]:
    """Bins whose slots are run-length lists, as classes of equal bins."""
    edges = sorted({0, times, *(int(e) for slot in slots for e in np.cumsum([k for _, k in slot]))})
    ends = [np.cumsum([k for _, k in slot]) for slot in slots]
    return [(b - a, [slot[int(np.searchsorted(end, a, side="right"))][0] for slot, end in zip(slots, ends)])
            for a, b in zip(edges, edges[1:])]


def _best_fit(classes: list[tuple[int, list[int]]], left: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Put the remaining pieces, longest first, where the least room stays."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for m, held in classes:
        room[capacity - sum(held)].append((m, held))
    for size in range(capacity, 0, -1):
        n = int(left[size])
        free = size
        while n:
            while free <= capacity and not room.get(free):
                free += 1
            if free > capacity:
                room[capacity].append((-(-n // (capacity // size)), []))
                free = capacity
            m, held = room[free].pop()
            each = free // size
            full = min(m, n // each)
            if full:
                room[free - each * size].append((full, held + [size] * each))
                n -= full * each
            if full < m and n:
                room[free - n * size].append((1, held + [size] * n))
                n, full = 0, full + 1
            if full < m:
                room[free].append((m - full, held))
    return [c for same in room.values() for c in same if c[0] and c[1]]


class Layout:
    """Place of the r-th piece of a length: sequence and offset, from the plan's classes."""

    def __init__(self, classes: list[tuple[int, list[int]]], count: np.ndarray) -> None:
        entries = []
        base = 0
        for m, held in classes:
            at, k = 0, 0
            while k < len(held):
                again = k
                while again < len(held) and held[again] == held[k]:
                    again += 1
                entries.append((held[k], m, again - k, base, at))
                at += held[k] * (again - k)
                k = again
            base += m
        entries.sort()
        table_ = np.array(entries, dtype=np.int64).reshape(-1, 5)
        self.size, self.bins, self.times, self.base, self.at = table_.T
        self.begin = np.cumsum(self.bins * self.times) - self.bins * self.times
        self.before = np.cumsum(count) - count

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        position = self.before[length] + rank
        entry = np.searchsorted(self.begin, position, side="right") - 1
        x = position - self.begin[entry]
        return self.base[entry] + x % self.bins[entry], self.at[entry] + x // self.bins[entry] * length


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS,
         pieces_per_bucket: int = PIECES_PER_BUCKET) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``pieces``.

    Each sequence is filled from offset 0 without gaps and never over the
    capacity.  Rows with the same doc_id, also null, are pieces of their own.
    Every row must have a length from 1 to ``capacity``, as ``pieces`` gives
    them.  An empty table gives no rows.  Other columns are kept.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        count[size] = n
    layout = Layout(plan_bins(count, capacity, groups), count)
    buckets = max(1, -(-int(count.sum()) // pieces_per_bucket))
    placed = cut.withColumn("pack_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy("length", "pack_bucket").agg(F.count(F.lit(1)).alias("pack_n"))
    earlier = W.partitionBy("length").orderBy("pack_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "pack_bucket",
                         F.coalesce(F.sum("pack_n").over(earlier), F.lit(0)).alias("pack_before"))
    inside = W.partitionBy("length", "pack_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = placed.join(sizes, ["length", "pack_bucket"]).withColumn(
        "pack_rank", F.col("pack_before") + F.row_number().over(inside) - 1)
    out = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = layout.place(batch.column("length").to_numpy(), batch.column("pack_rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in out] + [pa.array(sequence), pa.array(offset)],
                names=[*out, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*out, "pack_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   groups: int = GROUPS) -> DataFrame:
    """Pieces of all documents with their places; see ``pieces`` and ``pack``."""
    return pack(stage(pieces(docs, tokenizer_path, capacity, end_id)), capacity, groups)


def byte_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op9_pack(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), byte_tokenizer())
