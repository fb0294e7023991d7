import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import collocations as co
from tallyforge.llm.common import stage, stage_by
from tallyforge.llm.fm_index import FmIndex

SCHEMA = "doc_id long, text string, lang string, n string, phrase string, shard int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_count, max_words, per_lang):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= min_count}
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1}
    gone = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= 100 * f[lang, w[i:i + k]]:
                    gone.add((lang, w[i:i + k]))
    out = []
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, at = [], Counter()
    for r in out:
        at[r[0]] += 1
        if at[r[0]] <= per_lang:
            ranked.append((r[0], at[r[0]], *r[1:]))
    return sorted(ranked)


def made(n, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "Dé", "dÉ", "e-f", "日", "\x00x", "g"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", " "])
                       for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice([i, 7, None]), text, rng.choice(["en", "en", "de", None])))
    return rows + [(1, None, "en"), (2, "", None), (3, " .,; ", "fr"), (4, "x y z x y z", "fr")] + [
        (5, "only here now", "it")] * 6


def run(spark, rows, parts=3, **options):
    docs = spark.createDataFrame([(d, t, lang, "x", None, 1) for d, t, lang in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, co.collocations(docs, **options).drop("left", "right").collect()))


@pytest.mark.parametrize("shard_words, per_lang, max_words", [(1 << 20, 2000, 5), (150, 9, 4)])
def test_equals_brute_force(spark, shard_words, per_lang, max_words):
    rows = made(150, 4) + [(9, "a b " * 3000, "en")]
    got = run(spark, rows, min_count=5, shard_words=shard_words, per_lang=per_lang, max_words=max_words)
    want = brute(rows, 5, max_words, per_lang)
    assert want and got == want


def test_words_of_equal_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(co.words, "mix", lambda x: x & np.uint64(3))
    rows = made(60, 5)
    assert run(spark.newSession(), rows, parts=1, min_count=3) == brute(rows, 3, 5, 2000)
    data = np.frombuffer(b"ab cd ab ef cd", np.uint8)
    start, end, _ = co.piece_words(data, np.array([0, len(data)]))
    number = co._same_words(data, start, end, np.zeros(5, int))
    assert len(set(number.tolist())) == 3 and number[0] == number[2] and number[1] == number[4]


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", "en")], [(1, "a b", "en")] * 3])
def test_nothing_frequent(spark, rows):
    assert run(spark, rows) == []


def test_extensions_on_both_sides(spark):
    docs = spark.createDataFrame([(i, "u a b v. w a b v. a b", "en", "x", None, 1) for i in range(10)], SCHEMA)
    rows = {" ".join(r.words): r for r in co.phrases(docs, min_count=5).collect()}
    assert (rows["a b"].a, rows["a b"].left, rows["a b"].right) == (30, 10, 20)
    assert list(rows["u a b v"].begins) == [10, 10, 10] and list(rows["u a b v"].ends) == [20, 20, 20]


def test_intervals_count_phrases():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = FmIndex.of(text)
    known = [(1,), (2,), (3,)]
    intervals = index.words()
    for k in range(2, 7):
        grown = index.grow(intervals)
        mine = {known[p] + known[s][-1:]: n for p, s, n in zip(grown.prefix, grown.suffix, grown.intervals.n.tolist())}
        want = Counter(w for w in zip(*[text[i:].tolist() for i in range(k)]) if 0 not in w)
        assert mine == want
        known, intervals = list(mine), grown.intervals


def test_only_answers_are_shuffled(spark):
    """What a shard holds stays in its bucket on disk; the words' ranks come to it."""
    docs = spark.createDataFrame([(d, t, lang, "x", None, 1) for d, t, lang in made(40, 6)], SCHEMA).repartition(3)
    dealt = stage_by(co.shards(docs, 150), "shard", 7)
    named = stage(dealt.mapInArrow(co._ask_words(7), co.WORDS).groupBy("bucket").applyInArrow(co._name_words(3), co.NAMED))
    texts = co._by_shard(dealt.select("shard", "tokens"),
                         named.filter("shard IS NOT NULL").select("shard", "bucket", "ranks"), co._text, co.TEXT)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert texts.count() == dealt.count() > 1
    f = Counter()
    for _, text, lang in made(40, 6):
        f.update((lang or "und", w) for w in re.findall("[^ \t.,;:!?\n-\r]+", lower(text or "")))
    rows = named.filter("shard IS NULL").selectExpr("inline(frequent)").collect()
    assert {(r.lang, r.word): r.f for r in rows} == {k: n for k, n in f.items() if n >= 3}
    assert len({r.id for r in rows}) == len(rows)


def test_a_task_has_one_shard_at_hand(spark, monkeypatch):
    """Shards dealt by one task are rows of megabytes; each is a row group, and what it holds is compressed."""
    import glob
    import pyarrow.parquet as pq
    seen, unstage = [], co.unstage

    def looked_at(staged):
        if staged.columns[0] == "shard" and "bucket" not in staged.columns:
            for path in glob.glob(f"{staged.staged_in.removeprefix('file:')}/*.parquet"):
                found = pq.ParquetFile(path)
                seen.extend((found.metadata.row_group(i).num_rows, staged.columns) for i in range(found.num_row_groups))
        unstage(staged)

    monkeypatch.setattr(co, "unstage", looked_at)
    rows = made(80, 8)
    assert run(spark, rows, parts=1, min_count=3, shard_words=150) == brute(rows, 3, 5, 2000)
    assert len({tuple(columns) for _, columns in seen}) == 4 and {n for n, _ in seen} == {1}
    numbers = np.arange(1 << 16, dtype=np.int64)
    assert len(co._closed(numbers)) < numbers.nbytes / 3
    assert (co._opened(co._closed(numbers), np.int64) == numbers).all() and co._opened(co._closed(b"")) == b""
