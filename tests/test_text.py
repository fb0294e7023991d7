import html
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import conversations as conv
from tallyforge.operators import documents, segments

HEAD, TAIL = "Item 7. Management's Discussion", "Item 7A. Quantitative Disclosures"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


def plain(spark, markup, **kw):
    df = spark.createDataFrame([(markup,)], "html string")
    return text.with_text(df, "html", **kw).first()["text"]


def section(spark, body, form="10-K"):
    return one(spark, body, text.extract_section(F.col("t"), F.lit(form)))


def test_markup_to_text(spark):
    markup = ("<html><head><title>x</title></head><script>var a='<p>';</script><p>One&nbsp;&amp; two</p>"
              "\n\n\n<DIV class='a'>It&rsquo;s&#8217;\tfine</DIV><b>bold</b>&lt;tag&gt; &Eacute;&#x41;&amp;lt;")
    assert plain(spark, markup) == "One & two\n\nIt's'\tfine\nbold <tag> ÉA&lt;".replace("\t", " ")


@pytest.mark.parametrize("raw", ["a & b &amp;amp; &quot", "&notit; &copy &copy; &;&&amp;", "&#150;&#xD83D;x&AMP;",
                                 "R&D &bull;&ndash;&mdash;&ldquo;x&rdquo;", "no entity", "&", ""])
def test_entities_as_the_standard_library(spark, raw):
    want = html.unescape(raw).replace("’", "'").strip()
    assert plain(spark, raw) == want


def test_common_entities_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("<p>a &amp; b&copy;</p>",)], "html string")
    assert text.with_text(df, "html", full_entities=False).first()["text"] == "a & b©"


def test_strip_covers_every_white_space(spark):
    for ch in text.WS_CHARS:
        assert ch.isspace()
    assert one(spark, " \x1f a b 　\n", text.strip(F.col("t"))) == "a b"


def test_section_takes_latest_long_start(spark):
    body = "Revenue grew. " * 200
    doc = f"{HEAD}\n\nItem 8. Financial Statements\n\n{HEAD}\n\n{body}\n\n{TAIL}\n\nmore"
    assert section(spark, doc) == f"{HEAD}\n\n{body.strip()}"


def test_section_none_short_and_quarterly(spark):
    assert section(spark, "nothing here") is None
    assert section(spark, f"{HEAD} short {TAIL}") is None
    doc = "ITEM 2 – Management " + "x" * 2500 + " Item 4: Controls and more"
    assert section(spark, doc, "10-Q").endswith("x")
    assert section(spark, doc, "8-K") is None


@pytest.mark.parametrize("ending", ["", TAIL])
def test_section_size_limit(spark, ending):
    doc = f"{HEAD} " + "y" * 399_000 + " " * 5_000 + "z" * 200_000 + ending
    found = section(spark, doc)
    if ending:
        assert len(found) == 400_000 and found.endswith(" ")
    else:
        assert len(found) == len(HEAD) + 1 + 399_000 and found.endswith("y")


def test_chunks_keep_the_text_and_the_bound(spark):
    rng = random.Random(7)
    docs = ["", "\n\n \n\n", "é" * 95]
    for _ in range(150):
        docs.append("\n\n".join("wé🙂 x"[rng.randrange(4)] * rng.choice([0, 3, 9, 15, 19, 20, 21, 40, 41, 77, 130])
                                for _ in range(rng.randrange(12))))
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", text.chunk_text(F.col("t"), 20).alias("c")).collect()}
    for i, doc in enumerate(docs):
        kept = "".join(doc.split())
        assert "".join("".join(got[i]).split()) == kept, doc
        assert all(c for c in got[i]) and all(len(c) <= 40 for c in got[i]), doc
        # Two neighbours that would have fitted together are one chunk, unless the first is a cut.
        for first, second in zip(got[i], got[i][1:]):
            assert len(first) == 20 or len(first) + 2 + len(second.split("\n\n")[0]) > 20, doc


@pytest.mark.parametrize("doc, want", [
    ("aaaa\n\nbbbb", ["aaaa\n\nbbbb"]), ("a" * 12 + "\n\n" + "b" * 7, ["a" * 12, "b" * 7]),
    ("a" * 12 + "\n\n" + "b" * 6, ["a" * 12 + "\n\n" + "b" * 6]), ("c" * 40, ["c" * 40]),
    ("d" * 41, ["d" * 20, "d" * 21]), ("x\n\n \n\n y ", ["x\n\ny"])])
def test_chunk_examples(spark, doc, want):
    assert one(spark, doc, text.chunk_text(F.col("t"), 20)) == want


def test_chunks_keep_the_text_and_the_bound(spark):
    doc = "\n\n".join(f"Paragraph {i} " + "word " * (i % 40) for i in range(300))
    chunks = one(spark, doc, text.chunk_text(F.col("t")))
    assert all(len(c) <= 2800 for c in chunks) and len(chunks) > 1
    assert "\n\n".join(chunks) == "\n\n".join(p.strip() for p in doc.split("\n\n"))


def test_large_document(spark):
    doc = "<p>" + HEAD + "</p>" + "<p>Sales &amp; costs rose.</p>" * 60_000 + f"<p>{TAIL}</p>"
    df = spark.createDataFrame([("T", 1, "10-K", "a", doc)],
                               "ticker string, cik int, form string, accession_number string, html string")
    row = documents.mdna_table(df.withColumn("filing_date", F.current_date())).first()
    assert row.extraction_ok and row.char_count == 400_000


# ---- segments ---------------------------------------------------------------------

AXIS = "srt:ProductOrServiceAxis"


def ctx(cid, member, start="2024-10-01", end="2025-09-27", axis=AXIS):
    return (f'<xbrli:context id="{cid}"><xbrldi:explicitMember dimension="{axis}">{member}'
            f"</xbrldi:explicitMember><xbrli:startDate>{start}</xbrli:startDate>"
            f"<xbrli:endDate>{end}</xbrli:endDate></xbrli:context>")


def num(cid, value, attrs='scale="6"', name="us-gaap:Revenues"):
    return f'<ix:nonFraction name="{name}" contextRef="{cid}" {attrs}>{value}</ix:nonFraction>'


def segs(spark, *parts):
    df = spark.createDataFrame([("d", "".join(parts))], "doc string, html string")
    # In the document's arrays, and joined by key as in a large document.
    both = [segments.ordered_segments(segments.segment_revenue(df, "html", ("doc",), large)).collect()
            for large in (segments.LARGE, -1)]
    assert both[0] == both[1]
    return [(r.label, r.value) for r in both[0]]


def test_segments_of_newest_year(spark):
    assert segs(spark, ctx("p", "us-gaap:ProductMember"), ctx("s", "us-gaap:ServiceMember"),
                ctx("old", "us-gaap:ProductMember", "2023-10-02", "2024-09-28"),
                num("p", "294,866"), num("s", "<b>96,169</b>"), num("old", "280,000")) == \
        [("Product", 294_866e6), ("Service", 96_169e6)]


def test_segment_edge_cases(spark):
    assert segs(spark, "<html>no markup</html>") == []
    # Sign, missing scale, unreadable text, other tag, unknown context.
    assert segs(spark, ctx("a", "x:NorthAmericaSegmentMember"), ctx("b", "x:Member"),
                num("a", "5", 'sign="-"'), num("b", "(7)"), num("b", "1", name="us-gaap:Assets"),
                num("zz", "3"), num("b", "2.5", 'scale="" data-scale="9"')) == \
        [("x:Member", 2.5), ("North America", -5.0)]
    # The last definition of a context counts, also if it is not annual.
    assert segs(spark, ctx("a", "x:OneMember"), ctx("a", "x:TwoMember"), num("a", "1", "")) == [("Two", 1.0)]
    assert segs(spark, ctx("a", "x:OneMember"), ctx("a", "x:TwoMember", "2025-07-01"), num("a", "1", "")) == []
    # The first fact of a member counts; the product axis comes first.
    business = ctx("s", "x:CloudMember", axis="us-gaap:StatementBusinessSegmentsAxis")
    assert segs(spark, business, num("s", "4", ""), num("s", "9", "")) == [("Cloud", 4.0)]
    assert segs(spark, business, ctx("a", "x:OneMember"), num("s", "4", ""), num("a", "1", "")) == [("One", 1.0)]


def test_segments_of_a_large_document_and_of_repeated_keys(spark):
    n = 20_000
    large = "".join(ctx(f"c{i % (n - 1)}", f"x:M{i}Member") for i in range(n)) + "".join(
        num(f"c{i}", i, "") for i in range(1, n - 1))
    small = ctx("c1", "x:OtherMember") + num("c1", 7, "")
    df = spark.createDataFrame([("d", large), ("d", small), ("e", small), ("f", "")], "doc string, html string")
    start = time.monotonic()
    rows = segments.segment_revenue(df, "html", ("doc",)).collect()
    # Arrays in the row would compare 400 million pairs of entries.
    assert time.monotonic() - start < 60
    got = sorted((r.doc, r.member, r.value) for r in rows)
    want = [("d", f"x:M{i}Member", float(i)) for i in range(1, n - 1)] + [("d", "x:OtherMember", 7.0),
                                                                         ("e", "x:OtherMember", 7.0)]
    assert got == sorted(want)


def test_segments_need_no_exchange(spark):
    df = spark.createDataFrame([("d", "")], "doc string, html string")
    plan = segments.segment_revenue(df, "html", ("doc",))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_context_parts_in_any_order_and_twice(spark):
    member = f'<xbrldi:explicitMember a="1" dimension="{AXIS}"> {{}} </xbrldi:explicitMember>'
    start, end = "<xbrli:startDate>{}</xbrli:startDate>", "<XBRLI:endDate>{}</xbrli:endDate>"
    one = '<xbrli:context x="y" id="{}">' + "{}</xbrli:context>"
    parts = [end.format("2024-12-31"), start.format("2024-01-01"), member.format("x:OneMember")]
    later = [end.format("2023-12-31"), start.format("2023-01-01")]
    assert segs(spark, one.format("a", " t ".join(parts + later)), num("a", "1", "")) == [("One", 1.0)]
    assert segs(spark, one.format("a", "".join(parts + [member.format("x:TwoMember")])), num("a", "1", "")) == []
    assert segs(spark, one.format("a", "".join(parts[1:])), num("a", "1", "")) == []


# ---- search ---------------------------------------------------------------------------

def test_search_looks_words_up_in_batches(spark):
    """No scan by Spark for each word and chunk, which took most of the time; blanks of other kinds stay in words."""
    chunks = spark.createDataFrame([("T", "2024-01-01", "a1", 0, "One\ttwo Öre"), ("T", "2024-01-01", "a1", 1, "")],
                                   "ticker string, filing_date string, accession_number string, chunk_id int, chunk_text string")
    asked = spark.createDataFrame([(1, "t", "ONE\tT öre  öre x"), (2, "t", " "), (3, "t", None)],
                                  "request_id int, ticker string, query string")
    found = documents.search_passages(asked, chunks)
    assert [(r.request_id, r.chunk_id, r.score) for r in found.collect()] == [(1, 0, 3)]
    assert "contains(" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_search_against_brute_force(spark):
    rng = random.Random(3)
    words = ["cash", "flow", "Receivables", "growth", "debt", "a", "tax"]
    chunks = [(rng.choice("AB"), f"2024-0{rng.randrange(1, 9)}-01", f"acc{i // 4}", i % 4,
               " ".join(rng.choice(words) for _ in range(6))) for i in range(120)]
    requests = [(i, rng.choice("ab"), " ".join(rng.choice(words + [""]) for _ in range(4))) for i in range(40)]
    requests.append((99, "a", "unknownword"))
    df = spark.createDataFrame(chunks, "ticker string, filing_date string, accession_number string, "
                                       "chunk_id int, chunk_text string") \
        .withColumn("filing_date", F.col("filing_date").cast("date"))
    asked = spark.createDataFrame(requests, "request_id int, ticker string, query string")
    got = {}
    for r in documents.search_passages(asked, df, batch=4).collect():
        got.setdefault(r.request_id, {})[r["rank"]] = (r.score, str(r.filing_date), r.chunk_id, r.accession_number)
    for rid, ticker, query in requests:
        terms = [t for t in query.lower().split(" ") if t]
        scored = [(sum(t in c[4].lower() for t in terms), c) for c in chunks if c[0] == ticker.upper()]
        scored = sorted((s for s in scored if s[0] > 0), key=lambda s: (s[1][3], s[1][2]))
        scored = sorted(sorted(scored, key=lambda s: s[1][3]), key=lambda s: s[1][3])
        order = sorted(scored, key=lambda s: (-s[0], [-ord(x) for x in s[1][1]], s[1][3], s[1][2]))[:6]
        want = {i + 1: (s, c[1], c[3], c[2]) for i, (s, c) in enumerate(order)}
        assert got.get(rid, {}) == want


# ---- conversations ----------------------------------------------------------------------

TURNS = "conv_id int, turn int, role string, text string, tool_calls string, tool_call_id string"


def test_narrated_calls(spark):
    hits = ["[get_ratios(p_ticker=X)]", "search_mdna  (", "/ipython", "<|python_tag|>", "<|eom|>"]
    misses = ["get_ratios without call", "my_get (x)", "", None]
    df = spark.createDataFrame([(t,) for t in hits + misses], "t string")
    assert [r[0] for r in df.select(conv.narrates_calls(F.col("t"))).collect()] == [True] * 5 + [False] * 4


def test_context_is_cut_before_it_is_cleaned(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "get_ratios(" if i == 5 else f"t{i}", None, None)
            for i in range(9)]
    kept = conv.usable_context(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(r.turn for r in kept) == [2, 3, 4, 6, 7]


def test_audit_trail_and_summary(spark):
    calls = ('[{"id":"c1","function":{"name":"get_ratios","arguments":"{\\"p_ticker\\": \\" aapl \\"}"}},'
             '{"id":"c2","function":{"name":"get_ratios","arguments":"{bad"}}]')
    rows = [(1, 0, "user", "hi", None, None), (1, 1, "assistant", "", calls, None),
            (1, 2, "tool", "[1]", None, "c1"), (1, 3, "tool", "", None, "c2"), (2, 0, "user", "x", None, None)]
    df = spark.createDataFrame(rows, TURNS)
    trail = {r.call_id: r for r in conv.audit_trail(df).collect()}
    assert trail["c1"].arguments == {"p_ticker": " aapl "} and trail["c1"].result == "[1]"
    assert trail["c2"].arguments == {} and trail["c2"].result == "[]" and trail["c2"].pos == 1
    assert (trail["c1"].status, trail["c2"].status) == ("ok", "unreadable")
    summary = {r.conv_id: r for r in conv.conversation_summary(df).collect()}
    assert (summary[1].n_tool_calls, summary[1].focus_ticker) == (2, "AAPL")
    assert (summary[2].n_tool_calls, summary[2].focus_ticker) == (0, None)


def test_calls_with_repeated_ids_are_matched_in_order(spark):
    def call(*ids):
        return "[" + ",".join(f'{{"id":"{i}","function":{{"name":"f{k}","arguments":""}}}}'
                              for k, i in enumerate(ids)) + "]"

    rows = [(1, 0, "tool", "early", None, "a"), (1, 1, "assistant", "", call("a", "a", "b"), None),
            (1, 2, "tool", "a1", None, "a"), (1, 3, "tool", "a2", None, "a"), (1, 4, "tool", "a again", None, "a"),
            (1, 5, "assistant", "", call("a"), None), (1, 6, "assistant", "", call("a"), None),
            (1, 7, "tool", '{"error": "no such company"}', None, "a"), (1, 8, "tool", "no id", None, None),
            (2, 1, "assistant", "", '[{"function":{"name":"f0","arguments":"{}"}}]', None),
            (2, 2, "tool", "other conversation", None, "b")]
    trail = conv.audit_trail(spark.createDataFrame(rows, TURNS)).collect()
    got = sorted((r.conv_id, r.turn, r.pos, r.call_id or "", r.result, r.status) for r in trail)
    assert got == [(1, 1, 0, "a", "a1", "ok"), (1, 1, 1, "a", "a2", "ok"), (1, 1, 2, "b", None, "unanswered"),
                   (1, 5, 0, "a", None, "unanswered"), (1, 6, 0, "a", '{"error": "no such company"}', "error"),
                   (2, 1, 0, "", None, "unanswered")]


@pytest.mark.parametrize("raw, want", [
    (None, ""), ('"plain"', "plain"), ('"[1, 2]"', "[1, 2]"), ('"[]"', "[]"), ("12", "12"), ('{"a":1}', '{"a":1}'),
    ('["a", {"type":"text","text":"b"}, {"type":"reasoning","text":"no"}, {"text":"c"}, {"text":5}, {"text":""}]',
     "a\nb\nc"), ("[]", ""), ('["\\t a \\n"]', "a")])
def test_content_text(spark, raw, want):
    assert one(spark, raw, conv.content_text(F.parse_json(F.col("t")))) == want
