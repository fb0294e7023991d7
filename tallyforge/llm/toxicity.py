"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, end of clause)
by an acceptor over bytes.  Transducers for negation, reported speech, targets
and for insults and threats themselves are composed into one machine that runs
over the symbols of a clause and emits a label per match, for example "insult,
aimed at someone, not negated, not reported".  A document's score comes from
its labels, with weights fitted to labelled rows.  Clauses without an insult
or threat are never run.

The acceptor's insult stems are a short seed list and stems learned from the
labelled rows: beginnings of words that stand in many toxic and almost no
other documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import words
from tallyforge.llm.common import stage, table

#: At most so many labelled rows of each class are used for fitting.
TRAIN_PER_CLASS = 5000
#: A learned stem stands in so many toxic training documents, at least this share of them ...
MIN_SUPPORT, MIN_SHARE = 4, 0.01
#: ... and is so many times as frequent there as in the others.
MIN_RATIO = 50.0
STEM_CHARS = range(3, 13)
THRESHOLD = 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: Seed words per symbol; a star marks a stem.
SEEDS = {
    INSULT: "idiot* moron* imbecil* stupid* loser* scum* worthless* pathetic* disgusting* trash dumbass* "
            "bastard* asshole* dummkopf* arschloch* connard* estúpid* imbécil*",
    THREAT: "kill* murder* hurt* destroy* strangle* töte* umbring* tuer tuerai matar* mataré",
    TARGET: "you your you're yourself he she they them him her du dich dir ihr euch tu toi te vous ellos tú usted",
    NEGATION: "not never isn't aren't wasn't don't kein* niemals jamais nunca",
    REPORT: "said says wrote claimed reported quoted called sagte schrieb dit déclaré dijo escribió",
}
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: Marks outside ASCII: inverted marks, guillemets, quotes, dashes, dots, CJK and full-width ones.
_MARKS = "¡¿«»·§¶‐‑‒–—―‘’‚‛“”„‟†‡•…‹›‼⁇⁈⁉、。〈〉《》「」『』【】！（），．：；？"
_MARK_BYTES = [m.encode() for m in _MARKS]
_ASCII_MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?;:")] = True


def _mark_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, last: bool) -> np.ndarray:
    """Bytes of the mark that stands first (or last) in every span; 0 where none does or nothing else is left."""
    out = np.zeros(len(start), np.int64)
    edge = data[end - 1] if last else data[start]
    out[_PUNCTUATION[edge]] = 1
    wide = np.flatnonzero(edge >= 128)
    if len(wide):
        for mark in _MARK_BYTES:
            n = len(mark)
            some = wide[end[wide] - start[wide] > n]
            at = end[some] - n if last else start[some]
            same = np.ones(len(some), dtype=bool)
            for k, byte in enumerate(mark):
                same &= data[at + k] == byte
            out[some[same]] = n
    out[out >= end - start] = 0
    return out


class Acceptor:
    """Bytes of a word to its symbol: a trie with whole-word and stem ends as a transition table."""

    def __init__(self, entries: dict[str, int]) -> None:
        step: list[dict[int, int]] = [{}]
        whole, stem = [OTHER], [OTHER]
        for text, symbol in entries.items():
            state = 0
            for byte in text.rstrip("*").encode():
                if byte not in step[state]:
                    step[state][byte] = len(step)
                    step.append({})
                    whole.append(OTHER)
                    stem.append(OTHER)
                state = step[state][byte]
            if text.endswith("*"):
                stem[state] = symbol
            whole[state] = symbol
        self.next = np.full((len(step), 256), -1, dtype=np.int32)
        for state, row in enumerate(step):
            for byte, to in row.items():
                self.next[state, byte] = to
        self.whole, self.stem = np.array(whole, np.int8), np.array(stem, np.int8)

    def symbols(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Symbol of every span, punctuation around it left out."""
        start, end = start.copy(), end.copy()
        left = np.arange(len(start))
        while len(left):
            lead = _mark_bytes(data, start[left], end[left], False)
            start[left] += lead
            tail = _mark_bytes(data, start[left], end[left], True)
            end[left] -= tail
            left = left[(lead > 0) | (tail > 0)]
        out = np.zeros(len(start), np.int8)
        alive = np.arange(len(start))
        state = np.zeros(len(start), np.int32)
        at = start
        while len(alive):
            state = self.next[state, data[at]]
            keep = state >= 0
            alive, state, at = alive[keep], state[keep], at[keep] + 1
            done = at >= end[alive]
            found = np.where(done, self.whole[state], self.stem[state])
            out[alive] = np.where(found != OTHER, found, out[alive])
            alive, state, at = alive[~done], state[~done], at[~done]
        return out


def _countdown(symbol: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A transducer that is on for ``reach`` words after a symbol."""
    step = np.zeros((reach + 1, 7), np.int64)
    for state in range(reach + 1):
        step[state] = max(state - 1, 0)
        step[state, symbol] = reach
        step[state, END] = 0
    return step, np.repeat(np.arange(reach + 1)[:, None] > 0, 7, axis=1).astype(np.int64)


def _latch(symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """A transducer that is on from a symbol to the end of the clause."""
    step = np.array([[0] * 7, [1] * 7])
    step[0, symbol], step[1, END] = 1, 0
    return step, np.array([[0] * 7, [1] * 7])


def _match() -> tuple[np.ndarray, np.ndarray]:
    """Emits 1 for an insult, 2 for a threat."""
    out = np.zeros((1, 7), np.int64)
    out[0, INSULT], out[0, THREAT] = 1, 2
    return np.zeros((1, 7), np.int64), out


def compose(machines: list[tuple[np.ndarray, np.ndarray]], bases: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """One machine that runs all of them; its output has a digit per machine."""
    step, out = np.zeros((1, 7), np.int64), np.zeros((1, 7), np.int64)
    for (next_, emit), base in zip(machines, bases):
        n = len(next_)
        step = (step[:, None, :] * n + next_[None, :, :]).reshape(-1, 7)
        out = (out[:, None, :] * base + emit[None, :, :]).reshape(-1, 7)
    return step, out


MACHINE = compose([_match(), _countdown(NEGATION, 3), _latch(REPORT), _countdown(TARGET, 4)], [3, 2, 2, 2])
LABELS = 3 * 2 * 2 * 2


def clause_labels(symbol: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Label that the composed machine emits at every word (0 to 7: none).

    ``ends`` marks the last word of a clause.  Only clauses with an insult or
    threat are run, all of them side by side.
    """
    out = np.zeros(len(symbol), np.int64)
    hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    if not len(hits):
        return out
    begin = np.concatenate(([0], np.flatnonzero(ends) + 1))
    chosen = np.unique(np.searchsorted(begin, hits, side="right") - 1)
    at = begin[chosen]
    stop = np.append(begin, len(symbol))[chosen + 1]
    step, emit = MACHINE
    state = np.zeros(len(at), np.int64)
    while len(at):
        s = symbol[at]
        out[at] = emit[state, s]
        state = step[state, s]
        at = at + 1
        keep = at < stop
        at, stop, state = at[keep], stop[keep], state[keep]
    return out


def features(column: pa.Array, acceptor: Acceptor) -> np.ndarray:
    """Per document: log counts of matched clauses per label, of all of them, and their density."""
    rows = []
    for w in words.words_of(column, lower=True):
        n = len(w.count)
        x = np.zeros((n, LABELS - 8 + 2))
        if len(w.start):
            owner = np.repeat(np.arange(n), w.count)
            ends = _ENDS[w.data[w.end - 1]]
            ends[np.cumsum(w.count)[w.count > 0] - 1] = True
            label = clause_labels(acceptor.symbols(w.data, w.start, w.end), ends)
            hit = np.flatnonzero(label >= 8)
            np.add.at(x, (owner[hit], label[hit] - 8), 1.0)
            x[:, -2] = x[:, :LABELS - 8].sum(axis=1)
            x[:, -1] = 20 * x[:, -2] / np.maximum(w.count, 20)
            x = np.log1p(x)
        rows.append(x)
    return np.concatenate(rows) if rows else np.zeros((0, LABELS - 6))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """(text, toxic) of a bounded number of labelled documents; of equal texts of a class one is kept.

    Texts are equal if they have the same words, A-Z as a-z.  Of them the row
    with the smallest hash of its id stays; the bound is taken after that, by
    the same hash.  Rows whose crc32(doc_id) mod 3 is 1 are held out.  The
    bound makes the broadcast of the chosen ids safe.
    """
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    words_ = F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " "))
    # Only ids and digests of the labelled texts are sorted; the texts of the chosen ids are read again.
    digest = (docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
              .select("doc_id", F.when(words_ != "", F.sha2(words_, 256)).alias("digest")).filter("digest is not null")
              .join(known, "doc_id").groupBy("digest", "toxic")
              .agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("first")))
    digest = stage(digest.select("digest", "toxic", "first.h", "first.doc_id"))
    chosen = None
    for value in (0, 1):
        some = digest.filter(F.col("toxic") == value).orderBy("h", "doc_id", "digest").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = chosen.select(F.col("doc_id").alias("label_doc_id"), F.col("digest").alias("label_digest"), "toxic")
    found = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_doc_id"))
             .filter(F.sha2(words_, 256) == F.col("label_digest")))
    # Rows that repeat an id and, but for case and white space, its text.
    return found.groupBy("label_digest", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lowered = words.lower_ascii(np.frombuffer(text.encode(), np.uint8)).tobytes().decode()
            seen = {w.strip(_ASCII_MARKS + _MARKS) for w in lowered.split()}
            counts[toxic].update({w[:k] for w in seen for k in STEM_CHARS if len(w) >= k})
    stems = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(stems, pa.string()), pa.array([counts[1][s] for s in stems], pa.int64()),
         pa.array([counts[0][s] for s in stems], pa.int64())], names=["stem", "toxic", "clean"])


def learn_stems(train: DataFrame) -> list[str]:
    """Beginnings of words that mark toxic training documents, as specific as their counts allow."""
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return []
    support = max(MIN_SUPPORT, MIN_SHARE * n_toxic)
    rate = F.col("clean") / F.lit(float(n_clean)) + F.lit(1.0 / (MIN_RATIO * 20 * n_toxic))
    found = (train.mapInArrow(_stem_counts, "stem string, toxic long, clean long")
             .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .filter(F.col("toxic") >= support)
             .filter(F.col("toxic") / F.lit(float(n_toxic)) >= F.lit(MIN_RATIO) * rate).collect())
    toxic = {r["stem"]: r["toxic"] for r in found}
    longer: dict[str, str] = {}
    for s in sorted(toxic, key=lambda s: toxic[s]):
        longer[s[:-1]] = s
    kept = set()
    for s in toxic:
        if s[:-1] in toxic and toxic[s] < 0.97 * toxic[s[:-1]]:
            continue
        if s in longer and toxic[longer[s]] >= 0.97 * toxic[s]:
            continue
        kept.add(s)
    return sorted(s for s in kept if not any(s[:k] in kept for k in range(1, len(s))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps; the classes count alike; the bias comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = ridge / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + penalty * w
        hessian = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Used where no labelled rows of both classes exist: any match counts, density and number decide.
_DEFAULT = np.concatenate([np.full(LABELS - 8, 0.5), [1.5, 1.0, -2.0]])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> tuple[dict[str, int], np.ndarray]:
    """The grammar's entries and the weights of its labels."""
    train = stage(training_rows(docs, labels, per_class))
    entries = {w: symbol for symbol, text in SEEDS.items() for w in text.split()}
    entries |= {f"{s}*": INSULT for s in learn_stems(train)}

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acceptor = Acceptor(entries)
        for batch in batches:
            x = features(batch.column(0), acceptor)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)],
                                             names=["x", "toxic"])

    rows = train.mapInArrow(described, "x array<double>, toxic int").collect()
    y = np.array([r["toxic"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return entries, _DEFAULT
    return entries, fit_logistic(np.array([r["x"] for r in rows]), y)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                   per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    The score depends on the text alone.  Null and empty texts get the score
    of a text without matches.  Repeated rows are scored each; a null doc_id
    counts as the empty text for ``held_out``.  Without labelled rows of both
    classes, the seed lists and fixed weights are used.  An empty table gives
    no rows.  Other columns are not read.
    """
    entries, weights = fit(docs, labels, per_class)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acceptor = Acceptor(entries)
        for batch in batches:
            z = features(batch.column(1), acceptor) @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")
            .select("doc_id", held_out.alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text does not reach the threshold; texts go through Arrow once."""
    entries, weights = fit(docs, labels)
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acceptor = Acceptor(entries)
        for batch in batches:
            z = features(batch.column(names.index("text")), acceptor) @ weights[:-1] + weights[-1]
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return docs.mapInArrow(kept, docs.schema)


def op5_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
