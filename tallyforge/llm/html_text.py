"""Main text of web pages by a recurrent block labeller.

The leaf blocks of a page form a sequence.  A block is described by hashed
vectors of its tag path and of its words and by a few numbers; a bidirectional
LSTM in numpy reads the sequence from both ends, so every block is classified
with the whole page as context.  It is fitted on pages of the input itself,
labelled by what their own tags say, and on pages put together from their texts
in many layouts, whose labels are known.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import words
from tallyforge.llm.blocks import Block, leaf_blocks, made_page, weak_label
from tallyforge.llm.common import table

#: At most so many pages of the input are fitted on, each of them whole.
TRAIN_PAGES = 300
MADE_PAGES = 900
EPOCHS = 7
PATH_BUCKETS, PATH_DIM = 2048, 16
WORD_BUCKETS, WORD_DIM = 1024, 8
NUMBERS, HIDDEN = 7, 16
INPUT = PATH_DIM + WORD_DIM + NUMBERS
#: Sequences run side by side, up to so many cells of blocks.
CELLS = 16_384


def _path_bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_BUCKETS


class Described:
    """Blocks of many pages as arrays: sparse path and word buckets, numbers, blocks per page."""

    def __init__(self, pages: list[list[Block]]) -> None:
        flat = [b for page in pages for b in page]
        self.per_page = np.array([len(p) for p in pages], np.int64)
        known: dict[tuple[str, ...], list[int]] = {}
        paths = []
        for b in flat:
            got = known.get(b.path)
            if got is None:
                tail = [t for t in b.path if not t.startswith(".")][-2:]
                got = known[b.path] = [_path_bucket(t) for t in dict.fromkeys((*b.path, ">".join(tail), "^"))]
            paths.append(got)
        self.path_n = np.fromiter(map(len, paths), np.int64, len(paths))
        self.path = np.fromiter((t for p in paths for t in p), np.int64, int(self.path_n.sum()))
        word_n, word, letters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for w in words.words_of(pa.array([b.text for b in flat], pa.string()), lower=True):
            word_n.append(w.count)
            word.append((w.hash % np.uint64(WORD_BUCKETS)).astype(np.int64))
            ends = np.isin(w.data[w.end - 1], np.frombuffer(b".,;:!?", np.uint8)) if len(w.end) else np.zeros(0)
            owner = np.repeat(np.arange(len(w.count)), w.count)
            letters.append(np.bincount(owner, weights=ends, minlength=len(w.count)))
        self.word_n, self.word = np.concatenate(word_n), np.concatenate(word)
        length = np.array([len(b.text) for b in flat], float)
        linked = np.array([b.linked for b in flat], float)
        depth = np.array([sum(not t.startswith(".") for t in b.path) for b in flat], float)
        place = np.concatenate([np.arange(n) / max(n - 1, 1) for n in self.per_page]) if len(flat) else np.zeros(0)
        marks = np.array([b.text[:1] in "©®" for b in flat], float)
        self.numbers = np.column_stack([
            np.log1p(length) / 6, np.log1p(self.word_n) / 4, linked / np.maximum(length, 1),
            np.concatenate(letters) / np.maximum(self.word_n, 1), place, depth / 8, marks]) if len(flat) else np.zeros(
                (0, NUMBERS))

    def some(self, pages: np.ndarray) -> np.ndarray:
        """Positions of the pages' blocks, page by page."""
        first = np.cumsum(self.per_page) - self.per_page
        n = self.per_page[pages]
        return np.arange(int(n.sum())) + np.repeat(first[pages] - (np.cumsum(n) - n), n)


def _bag(buckets: np.ndarray, n: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Mean vector of every block's buckets; none gives zeros."""
    out = np.zeros((len(n), table_.shape[1]))
    some = n > 0
    if some.any():
        first = (np.cumsum(n) - n)[some]
        out[some] = np.add.reduceat(table_[buckets], first, axis=0) / n[some, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of steps x (time, pages, inputs); ``keep`` gets what the backward pass needs."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out = np.empty((steps, pages, HIDDEN))
    from_input = x @ w + b
    for t in range(steps):
        z = from_input[t] + h @ u
        gate = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out


def lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: list, d_out: np.ndarray):
    """Gradients of inputs, w, u and b from those of the hidden states."""
    steps, pages, _ = x.shape
    d_x, d_w, d_u, d_b = np.zeros_like(x), np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN)
    d_h, d_c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, tc = keep[t]
        d_h = d_h + d_out[t]
        d_c = d_c + d_h * o * (1 - tc * tc)
        d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * tc * o * (1 - o),
                              d_c * i * (1 - g * g)], axis=1)
        d_w += x[t].T @ d_z
        d_u += h.T @ d_z
        d_b += d_z.sum(axis=0)
        d_x[t] = d_z @ w.T
        d_h, d_c = d_z @ u.T, d_c * f
    return d_x, d_w, d_u, d_b


class Labeller:
    """Bidirectional LSTM over blocks; parameters are plain arrays."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        def weight(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        bias = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p = {
            "path": rng.normal(0, 0.5, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)),
            "wf": weight(INPUT, 4 * HIDDEN), "uf": weight(HIDDEN, 4 * HIDDEN), "bf": bias.copy(),
            "wb": weight(INPUT, 4 * HIDDEN), "ub": weight(HIDDEN, 4 * HIDDEN), "bb": bias.copy(),
            "out": weight(2 * HIDDEN + INPUT, 1), "bias": np.zeros(1),
        }

    def _layout(self, d: Described, pages: np.ndarray):
        n = d.per_page[pages]
        rows = d.some(pages)
        page = np.repeat(np.arange(len(pages)), n)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        return rows, page, step, n[page] - 1 - step, int(n.max())

    def _inputs(self, d: Described, rows: np.ndarray) -> tuple:
        starts_p, starts_w = np.cumsum(d.path_n) - d.path_n, np.cumsum(d.word_n) - d.word_n
        def pick(starts, n):
            k = n[rows]
            return np.arange(int(k.sum())) + np.repeat(starts[rows] - (np.cumsum(k) - k), k), k
        at_p, n_p = pick(starts_p, d.path_n)
        at_w, n_w = pick(starts_w, d.word_n)
        bags = d.path[at_p], n_p, d.word[at_w], n_w
        return np.concatenate([_bag(bags[0], n_p, self.p["path"]), _bag(bags[2], n_w, self.p["word"]),
                               d.numbers[rows]], axis=1), bags

    def _forward(self, d: Described, pages: np.ndarray, keep: tuple[list, list] | None = None):
        rows, page, step, back, steps = self._layout(d, pages)
        flat, bags = self._inputs(d, rows)
        x, y = (np.zeros((steps, len(pages), INPUT)) for _ in range(2))
        x[step, page], y[back, page] = flat, flat
        f = lstm(x, self.p["wf"], self.p["uf"], self.p["bf"], keep and keep[0])
        b = lstm(y, self.p["wb"], self.p["ub"], self.p["bb"], keep and keep[1])
        seen = np.concatenate([f[step, page], b[back, page], flat], axis=1)
        return rows, page, step, back, x, y, bags, seen, _sigmoid(seen @ self.p["out"] + self.p["bias"])[:, 0]

    def batches(self, d: Described) -> Iterator[np.ndarray]:
        """Pages of like length side by side."""
        order = np.argsort(d.per_page, kind="stable")
        order = order[d.per_page[order] > 0]
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * d.per_page[order[at + n]] <= CELLS:
                n += 1
            yield order[at:at + n]
            at += n

    def predict(self, d: Described) -> np.ndarray:
        out = np.zeros(int(d.per_page.sum()))
        for pages in self.batches(d):
            got = self._forward(d, pages)
            out[got[0]] = got[-1]
        return out

    def fit(self, d: Described, label: np.ndarray, epochs: int = EPOCHS, pages_at_once: int = 24, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        slow = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = np.argsort(d.per_page, kind="stable")
        order = order[d.per_page[order] > 0]
        groups = [order[i:i + pages_at_once] for i in range(0, len(order), pages_at_once)]
        t = 0
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for g in rng.permutation(len(groups)):
                t += 1
                for k, grad in self._gradients(d, groups[g], label).items():
                    slow[k] += 0.1 * (grad - slow[k])
                    square[k] += 0.01 * (grad * grad - square[k])
                    self.p[k] -= rate * (slow[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)

    def _gradients(self, d: Described, pages: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        keep: tuple[list, list] = ([], [])
        rows, page, step, back, x, y, bags, seen, p = self._forward(d, pages, keep)
        d_z = ((p - label[rows]) / len(rows))[:, None]
        grad = {"out": seen.T @ d_z, "bias": d_z.sum(axis=0)}
        d_seen = d_z @ self.p["out"].T
        d_f, d_b = (np.zeros(x.shape[:2] + (HIDDEN,)) for _ in range(2))
        d_f[step, page], d_b[back, page] = d_seen[:, :HIDDEN], d_seen[:, HIDDEN:2 * HIDDEN]
        d_x, grad["wf"], grad["uf"], grad["bf"] = lstm_back(x, self.p["wf"], self.p["uf"], keep[0], d_f)
        d_y, grad["wb"], grad["ub"], grad["bb"] = lstm_back(y, self.p["wb"], self.p["ub"], keep[1], d_b)
        d_flat = d_seen[:, 2 * HIDDEN:] + d_x[step, page] + d_y[back, page]
        for name, buckets, n, columns in (("path", bags[0], bags[1], slice(0, PATH_DIM)),
                                          ("word", bags[2], bags[3], slice(PATH_DIM, PATH_DIM + WORD_DIM))):
            grad[name] = np.zeros_like(self.p[name])
            np.add.at(grad[name], buckets, np.repeat(d_flat[:, columns] / np.maximum(n, 1)[:, None], n, axis=0))
        return grad


def fit_labeller(pages: DataFrame, n_pages: int = TRAIN_PAGES, n_made: int = MADE_PAGES) -> Labeller:
    """A labeller fitted on a bounded sample: the pages with the smallest hashes of their ids."""
    # Ids are chosen first, so that no task sends more pages than the sample has.
    some_html = pages.filter(F.length("html") > 0)
    chosen = (some_html.select(F.col("page_id").alias("chosen_id"), F.xxhash64("page_id").alias("chosen_hash"))
              .orderBy("chosen_hash", "chosen_id").limit(n_pages).distinct())
    sample = (some_html.join(F.broadcast(chosen), F.col("page_id").eqNullSafe(F.col("chosen_id")))
              .select("chosen_hash", "html").orderBy("chosen_hash", "html").limit(2 * n_pages).collect())
    own = [[(b, weak_label(b)) for b in leaf_blocks(r["html"])] for r in sample]
    own = [page for page in own if any(label for _, label in page)]
    rng = random.Random(11)
    some = [b.text for page in own for b, label in page if label] or [
        " ".join(rng.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split())
                 for _ in range(rng.randint(4, 60))) + "." for _ in range(60)]
    other = [b.text for page in own for b, label in page if not label] or some
    train = own + [made_page(rng, some, other) for _ in range(n_made)]
    labeller = Labeller()
    labeller.fit(Described([[b for b, _ in page] for page in train]),
                 np.array([label for page in train for _, label in page], float))
    return labeller


def main_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """Per row: page_id, url, text and n_chars of the main text.

    Blocks that the labeller takes for main text, in page order, joined by a
    line feed.  Null and empty pages, and pages without such blocks, give an
    empty text.  Repeated rows are extracted each; an empty table gives no
    rows.  Other columns are not read.
    """
    model = labeller or fit_labeller(pages)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                blocks = [leaf_blocks(h) for h in part.column(2).to_pylist()]
                chosen = model.predict(Described(blocks)) >= 0.5
                text, at = [], 0
                for page in blocks:
                    text.append("\n".join(b.text for b, use in zip(page, chosen[at:at + len(page)]) if use))
                    at += len(page)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text])],
                    names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
            .mapInArrow(extract, "page_id long, url string, text string, n_chars long"))


def op7_html_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
