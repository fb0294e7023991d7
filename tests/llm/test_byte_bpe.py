import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyforge.llm import byte_bpe as bb

SCHEMA = "doc_id long, text string, source string, ids string, decoded int"


def library():
    path, pattern = bb.byte_ranks()
    return tiktoken.Encoding("own", pat_str=pattern, special_tokens={},
                             mergeable_ranks={token: rank for rank, token in bb.read_ranks(path)})


def texts():
    rng = random.Random(5)
    letters = "aeinrstlo'  \n\t 　éßñ日本ا😀0123.,;!?<|>\x00\x1c\x85"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    return made + [None, "", " ", "   ", "\n\n a", "<|endoftext|>", "it's  we'll I'M", "b" * 3000, "ab " * 4000,
                   "x  " * 200 + "y", "日" * 700]


def expected(rows):
    enc = library()
    out = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def digests(coded):
    return sorted(map(tuple, coded.select(
        "doc_id", F.size("ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
        F.sha2("decoded", 256)).collect()), key=str)


@pytest.mark.parametrize("cut, slices, remembered", [(1 << 20, 1 << 20, 8 << 20), (7, 50, 40)])
def test_equals_the_library(spark, monkeypatch, cut, slices, remembered):
    rows = list(enumerate(texts())) + [(3, "again"), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    assert digests(bb.encoded(docs, *bb.byte_ranks())) == expected(rows)
    monkeypatch.setattr(bb, "CUT_CHARS", cut)
    monkeypatch.setattr(bb, "REMEMBERED_CHARS", remembered)
    bpe, enc = bb.ByteBpe(*bb.byte_ranks()), library()
    for _, t in rows:
        ids = bpe.encode(t or "")
        assert ids.tolist() == enc.encode_ordinary(t or "") and bpe.decode(ids) == (t or "").encode()
    monkeypatch.setattr(bb, "SLICE_BYTES", slices)
    import pyarrow as pa
    column = pa.array([t for _, t in rows], pa.string())
    assert [t for _, part in bb._slices(column) for t in part] == column.to_pylist()


def test_decoding_alone(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA)
    coded = bb.encoded(docs, *bb.byte_ranks(), decode=False)
    assert coded.filter("decoded is not null").count() == 0
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bb.decoded(coded, *bb.byte_ranks()).collect()}
    assert got == {d: (t or "").encode() for d, t in rows}


def test_empty_table(spark):
    assert bb.encoded(spark.createDataFrame([], SCHEMA), *bb.byte_ranks()).collect() == []


def test_every_character_of_the_basic_plane():
    bpe, enc = bb.ByteBpe(*bb.byte_ranks()), library()
    for low in range(0, 0x10000, 64):
        text = "".join(f"a{c}{c}1 {c} b" for c in map(chr, range(low, low + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert bpe.encode(text).tolist() == enc.encode_ordinary(text)


def test_tokens_that_merging_does_not_reach_and_missing_bytes(tmp_path):
    """Ranks with gaps; 'abc' has no merge that leads to it, 'd' no token at all."""
    tokens = {b"a": 3, b"b": 1, b"c": 2, b" ": 0, b"abc": 9, b"bc": 7}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in tokens.items() if t != b"bc"))
    bpe = bb.ByteBpe(str(path), bb.byte_ranks()[1])
    enc = tiktoken.Encoding("own", pat_str=bb.byte_ranks()[1], special_tokens={},
                            mergeable_ranks={t: r for t, r in tokens.items() if t != b"bc"})
    for text in ("abc", "abcabc", " abc", "a b c", "cba"):
        assert bpe.encode(text).tolist() == enc.encode_ordinary(text)
        assert bpe.decode(np.array(enc.encode_ordinary(text))) == text.encode()
    with pytest.raises(ValueError):
        bpe.encode("d")
