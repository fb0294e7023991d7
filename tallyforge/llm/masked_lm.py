"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Every token is predicted from the two tokens before it and the two after it;
the sum of the log-probabilities is the document's score.  The vocabulary is
counted over all documents.  The frequent words have ids of their own, all
other words share hashed ids.  Probabilities are exact over all ids: an id is a
class and a place in the class, each with a softmax of its own.  A word with a
shared id has its id's probability times its own share of the id's words in the
corpus, where a word that the corpus does not hold counts as one seen once.

Training is spread over the cluster: every task trains the current weights on
the windows of its documents, and the weights of all tasks are averaged by
their numbers of windows, for a few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import words
from tallyforge.llm.common import stage, table

CLASSES, PLACES = 64, 80
IDS = CLASSES * PLACES
RARE_IDS = 1024
REACH = 2
WIDTH = 32
#: One of so many windows trains, chosen by the hash of its words; 1 trains on all of them.
TRAIN_SHARE = 1
ROUNDS = 2
BATCH = 2048
RATE = 0.15
GATHERERS = 8
_SHAPES = {"embed": (IDS + 1, WIDTH), "place": (2 * REACH, WIDTH), "bias": (WIDTH,), "class_w": (CLASSES, WIDTH),
           "class_b": (CLASSES,), "word_w": (CLASSES, PLACES, WIDTH), "word_b": (CLASSES, PLACES)}


class Vocabulary:
    """Ids of hashed words: the frequent ones their own, others one of ``RARE_IDS``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rare: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.sorted, self.rank = hashes[order], order
        self.counts = np.ones(IDS)
        self.counts[RARE_IDS:RARE_IDS + len(counts)] += counts
        self.counts[:RARE_IDS] += rare
        #: (word, n) of all words of the corpus; stays on the driver.
        self.counted: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counted": None}

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = (hashes % np.uint64(RARE_IDS)).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            known = self.sorted[at] == hashes
            out[known] = RARE_IDS + self.rank[at[known]]
        return out


def learn_vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts over all words of all documents; the most frequent ones and the rare ids' sums come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [w.hash for w in words.words_of(batch.column(0), lower=True)]
            key, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["word", "n"])

    counted = stage(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counted.orderBy(F.desc("n"), "word").limit(IDS - RARE_IDS).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], float)
    rare = np.zeros(RARE_IDS)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.sort(hashes), np.zeros(RARE_IDS)
        for batch in batches:
            word = batch.column(0).to_numpy().view(np.uint64)
            other = ~np.isin(word, known)
            total += np.bincount((word[other] % np.uint64(RARE_IDS)).astype(np.int64),
                                 weights=batch.column(1).to_numpy()[other], minlength=RARE_IDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RARE_IDS)), pa.array(total)], names=["id", "n"])

    for r in counted.mapInArrow(rest, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).collect():
        rare[r["id"]] = r["n"]
    vocabulary = Vocabulary(hashes, n, rare)
    vocabulary.counted = counted
    return vocabulary


def start_weights(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Random inputs; outputs that begin at the corpus frequencies."""
    rng = np.random.default_rng(seed)
    w = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    w["embed"][:] = rng.normal(0, 0.3, _SHAPES["embed"])
    w["embed"][IDS] = 0
    w["place"][:] = rng.normal(0, 1.0, _SHAPES["place"])
    w["class_w"][:] = rng.normal(0, 0.05, _SHAPES["class_w"])
    w["word_w"][:] = rng.normal(0, 0.05, _SHAPES["word_w"])
    by = np.zeros((CLASSES, PLACES))
    by[np.arange(IDS) % CLASSES, np.arange(IDS) // CLASSES] = vocabulary.counts
    w["class_b"][:] = np.log(by.sum(axis=1) / by.sum())
    w["word_b"][:] = np.log(by / by.sum(axis=1, keepdims=True))
    return w


def contexts(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ids around every token, ``IDS`` beyond the ends of its document."""
    owner = np.repeat(np.arange(len(count)), count)
    out = np.full((len(ids), 2 * REACH), IDS)
    for k, step in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        at = np.arange(len(ids)) + step
        inside = (at >= 0) & (at < len(ids))
        inside[inside] = owner[at[inside]] == owner[inside]
        out[inside, k] = ids[at[inside]]
    return out


def hidden(w: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    total = np.broadcast_to(w["bias"], (len(around), WIDTH)).copy()
    for k in range(2 * REACH):
        total += w["embed"][around[:, k]] * w["place"][k]
    return np.tanh(total)


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of one place of every row; ``z`` is overwritten."""
    z -= z.max(axis=1, keepdims=True)
    chosen = z[np.arange(len(z)), at]
    return chosen - np.log(np.exp(z, out=z).sum(axis=1))


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the ids by class, and (class, from, to) of those that occur."""
    group = ids % CLASSES
    # Small numbers are sorted by counting.
    order = np.argsort(group.astype(np.uint8), kind="stable")
    cut = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=CLASSES)))).tolist()
    return order, [(c, cut[c], cut[c + 1]) for c in range(CLASSES) if cut[c] < cut[c + 1]]


def _row_sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of every row number below ``n``."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    held = rows[order]
    first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    out = np.zeros((n, values.shape[1]), values.dtype)
    out[held[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def log_probabilities(w: dict[str, np.ndarray], ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of every token given the tokens around it."""
    out = np.zeros(len(ids))
    for low in range(0, len(ids), 1 << 16):
        some = ids[low:low + (1 << 16)]
        h = hidden(w, around[low:low + (1 << 16)])
        part = _log_softmax_at(h @ w["class_w"].T + w["class_b"], some % CLASSES).astype(float)
        order, spans = _by_class(some)
        h, place, inner = h[order], some[order] // CLASSES, np.zeros(len(some))
        for c, a, b in spans:
            inner[a:b] = _log_softmax_at(h[a:b] @ w["word_w"][c].T + w["word_b"][c], place[a:b])
        part[order] += inner
        out[low:low + len(some)] = part
    return out


def gradients(w: dict[str, np.ndarray], ids: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log-probability."""
    n = len(ids)
    h = hidden(w, around)
    g = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    d = _softmax(h @ w["class_w"].T + w["class_b"])
    d[np.arange(n), ids % CLASSES] -= 1
    d /= n
    g["class_w"], g["class_b"] = d.T @ h, d.sum(axis=0)
    d_h = d @ w["class_w"]
    order, spans = _by_class(ids)
    sorted_h, place, inner = h[order], ids[order] // CLASSES, np.empty_like(h)
    for c, a, b in spans:
        here = sorted_h[a:b]
        d = _softmax(here @ w["word_w"][c].T + w["word_b"][c])
        d[np.arange(b - a), place[a:b]] -= 1
        d /= n
        g["word_w"][c], g["word_b"][c] = d.T @ here, d.sum(axis=0)
        inner[a:b] = d @ w["word_w"][c]
    d_h[order] += inner
    d_z = d_h * (1 - h * h)
    g["bias"] = d_z.sum(axis=0)
    for k in range(2 * REACH):
        g["place"][k] = (d_z * w["embed"][around[:, k]]).sum(axis=0)
    # Adding row by row in place would take three times as long as summing sorted rows.
    g["embed"] = _row_sums(around.ravel(), (d_z[:, None, :] * w["place"]).reshape(-1, WIDTH), IDS + 1)
    g["embed"][IDS] = 0
    return g


class Trainer:
    """Adagrad over windows that arrive in any portions."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        self.w = {k: v.copy() for k, v in w.items()}
        self.square = {k: np.full(s, 1e-6, np.float32) for k, s in _SHAPES.items()}
        self.windows = 0
        self.ids, self.around = np.zeros(0, np.int64), np.zeros((0, 2 * REACH), np.int64)

    def add(self, ids: np.ndarray, around: np.ndarray) -> None:
        self.ids, self.around = np.concatenate([self.ids, ids]), np.concatenate([self.around, around])
        while len(self.ids) >= BATCH:
            self._step(self.ids[:BATCH], self.around[:BATCH])
            self.ids, self.around = self.ids[BATCH:], self.around[BATCH:]

    def finish(self) -> None:
        if len(self.ids):
            self._step(self.ids, self.around)

    def _step(self, ids: np.ndarray, around: np.ndarray) -> None:
        self.windows += len(ids)
        for k, grad in gradients(self.w, ids, around).items():
            self.square[k] += grad * grad
            self.w[k] -= RATE * grad / np.sqrt(self.square[k])


def _pack(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in _SHAPES)


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[k] = np.frombuffer(raw, "<f4", n, at).reshape(shape).copy()
        at += 4 * n
    return out


def _mean(rows: pa.Table) -> pa.Table:
    """Weights averaged by numbers of windows, one row at a time."""
    n = np.array(rows.column("n").to_pylist(), float)
    total = None
    for raw, k in zip(rows.column("weights"), n):
        part = np.frombuffer(raw.as_py(), "<f4").astype(float) * k
        total = part if total is None else total + part
    return pa.table([pa.array([int(n.sum())]), pa.array([(total / n.sum()).astype("<f4").tobytes()], pa.binary())],
                    names=["n", "weights"])


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, share: int = TRAIN_SHARE) -> dict[str, np.ndarray]:
    """Weights after some rounds of training in all tasks and averaging."""
    weights = start_weights(vocabulary)
    for round_ in range(rounds):
        now = weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(now)
            for batch in batches:
                for w in words.words_of(batch.column(0), lower=True):
                    ids = vocabulary.ids(w.hash)
                    around = contexts(ids, w.count)
                    mixed = words.mix(w.hash + words.mix(around.astype(np.uint64)).sum(axis=1, dtype=np.uint64))
                    use = mixed % np.uint64(share * rounds) // np.uint64(share) == np.uint64(round_)
                    use &= mixed % np.uint64(share) == np.uint64(0)
                    trainer.add(ids[use], around[use])
            trainer.finish()
            if trainer.windows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([trainer.windows]), pa.array([_pack(trainer.w)], pa.binary())], names=["n", "weights"])

        # A few gatherers average the tasks' weights, so the driver gets as many whatever the input.
        local = docs.select("text").mapInArrow(run, "n long, weights binary")
        means = (local.withColumn("gatherer", F.pmod(F.xxhash64("weights"), F.lit(GATHERERS)))
                 .groupBy("gatherer").applyInArrow(_mean, "n long, weights binary").collect())
        if means:
            total = sum(r["n"] for r in means)
            mean = sum(np.frombuffer(r["weights"], "<f4").astype(float) * (r["n"] / total) for r in means)
            weights = _unpack(mean.astype("<f4").tobytes())
    return weights


def score_documents(docs: DataFrame, vocabulary: Vocabulary | None = None,
                    weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, log_prob (sum over the tokens) and mean_log_prob.

    Words are compared with A-Z as a-z.  Null texts and texts without words
    have no tokens, the sum 0 and a null mean.  Repeated rows are scored each.
    An empty table gives no rows.  Other columns are not read.  A word with a
    shared id has the id's probability times its count over the id's count plus
    one; the counts are joined by word.
    """
    vocabulary = vocabulary or learn_vocabulary(docs)
    weights = weights or train(docs, vocabulary)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words.words_of(batch.column(1), lower=True):
                n = len(w.count)
                ids = vocabulary.ids(w.hash)
                p = log_probabilities(weights, ids, contexts(ids, w.count))
                rare = ids < RARE_IDS
                p[rare] -= np.log(vocabulary.counts[ids[rare]])
                owner = np.repeat(np.arange(n), w.count)
                total = np.bincount(owner, weights=p, minlength=n).astype(float)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner[rare], minlength=n))))
                shared = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(w.hash[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(w.first, n), batch.column(0).slice(w.first, n), pa.array(w.count), pa.array(total),
                     shared], names=["row", "doc_id", "n_tokens", "log_prob", "rare"])

    scored = stage(docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row")).mapInArrow(
        score, "row long, doc_id long, n_tokens long, log_prob double, rare array<long>"))
    out = scored.select("row", "doc_id", "n_tokens", "log_prob")
    if vocabulary.counted is not None:
        # Words seen once, like those never seen, add log 1.
        often = vocabulary.counted.filter("n > 1").select("word", F.log(F.col("n").cast("double")).alias("more"))
        more = (scored.select("row", F.explode("rare").alias("word")).join(often, "word")
                .groupBy("row").agg(F.sum("more").alias("more")))
        out = out.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_prob", F.when(
        F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def op8_masked_lm(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))
