import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from airloom.llm import chat_format as C, top_search as T, url_filter as U

ROWS = "vec_id long, embedding array<double>, label int"


def brute_top(rows, k, scale):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in whole:
        if i % 50 == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        met = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w)))), i)
                     for i, w in whole if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(met[:k], 1)]
    return sorted(out)


def run_top(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], ROWS)
    return sorted(map(tuple, T.top_k_products(df.where("vec_id % 50 = 0"), df, **more).collect()))


def test_top_search_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.standard_normal(4), 1).tolist()) for i in range(130)]
    rows += [(200, None), (250, [1.0, None, 2.0, 0.0]), (300, [float("nan"), 0, 0, 0.0]), (301, [float("inf"), 0, 0, 0.0]),
             (None, [1.0, 1, 1, 1]), (350, [0.0] * 4), (400, [1.0, 2.0]), (7, rows[7][1]), (50, rows[51][1]), (450, [])]
    assert run_top(spark, rows) == brute_top(rows, 5, 256)
    assert run_top(spark, rows, batch=1, k=3) == brute_top(rows, 3, 256)
    assert run_top(spark, []) == []
    assert run_top(spark, [(0, [1.0])]) == []


@pytest.mark.parametrize("size", [1e3, 1e7, 3e12, 1e30])
def test_top_search_large_numbers(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(3) * size).tolist()) for i in range(60)]
    assert run_top(spark, rows, k=60) == brute_top(rows, 60, 256)


def test_top_search_several_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 3), -1.0]) for i in range(300)]
    monkeypatch.setattr(T, "BLOCK_ROWS", 16)
    assert run_top(spark, rows) == brute_top(rows, 5, 256)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), (None, "/", "block")]


def test_url_filter(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    urls = ["http://A.EXAMPLE.org/es/x?y", "https://example.org/en/12", "http://notexample.org/es/", "x://org/", "x://org",
            None, "", "example.org/es/", "http://example.org?/es/", "http://example.org#a", "http://example.org/es/", "a://b://c",
            "http://example.org:80/es/", "http://example.org/es/" + "y" * 50_000]
    df = spark.createDataFrame([(i, u, "clash", "clash", 1) for i, u in enumerate([*urls, urls[0]])],
                               "page_id long, url string, rule string, host string, action int")
    got = {r.page_id: r for r in U.filter_urls(df, rules, keep=("page_id",)).collect()}
    assert len(got) == len(urls) + 1
    assert [got[i].rule for i in range(13)] == [
        "example.org/es/", "example.org/en/1", "org/", "org/", None, None, None, None, None, None, "example.org/es/", None, None]
    assert [got[i].verdict for i in (0, 2, 5)] == ["block", "allow", "allow"]
    assert (got[0].host, got[0].path, got[8].host, got[8].path) == ("a.example.org", "/es/x", "example.org", "")
    assert got[13].rule == "example.org/es/" and got[14] == got[0] or got[14].rule == got[0].rule
    assert (got[5].host, got[5].path) == ("", "")
    assert U.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in U.filter_urls(df, rules.limit(0), default="block").collect()} == {"block"}


MARKS = st.lists(st.sampled_from(["\\", "#", "### ", "</turn>", ":", ":\n", "\n", "<", "a", " ", "é", "😀"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(MARKS, MARKS), max_size=5))
def test_chat_round_trip(turns):
    rendered = [C.render(*t) for t in turns]
    whole = "".join(r for r, _, _ in rendered)
    assert [t[:2] for t in C.parse(whole)] == turns
    for (_, text), (r, start, end) in zip(turns, rendered):
        assert C._field(r[start:end] + C.TURN_END, 0, C.TURN_END)[0] == text


def test_chat_parser_refuses():
    for broken in ("x", "### a", "### a:\n", "### a:\nb", "### a:\nb</turn>", "### a:\nb### </turn>\n", "### a</turn>:\n</turn>\n"):
        assert C.parse(broken) is None


def test_chat_rows(spark):
    schema = "text string, turn long, conv_id long, role string, rendered string"
    rows = [("b", 1, 1, "assistant", "x"), ("a", 0, 1, "user", "x"), (None, None, 1, "assistant", "x"), ("z", 0, None, None, "x"),
            ("same", 2, 1, "assistant", "x"), ("same", 2, 1, "assistant", "x"), ("long " * 40_000, 0, 2, "assistant", "x")]
    got = {r.conv_id: r for r in C.read_back(C.format_turns(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].n_turns == 5 and got[1].loss_chars == 9
    assert got[1].turns_sha256 == hashlib.sha256(b"assistant\n\nuser\na\nassistant\nb\nassistant\nsame\nassistant\nsame\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"bsamesame").hexdigest()
    assert got[None].n_turns == 1 and got[None].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].loss_chars == 200_000
    assert C.read_back(C.format_turns(spark.createDataFrame([], schema))).count() == 0


def test_chat_loss_span_lies_in_the_whole_text(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "q"), ("assistant", r"\### a </turn>"), ("user", "w"), ("assistant", "e")])]
    got = sorted(C.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.n)
    whole = "".join(r.rendered for r in got)
    assert [whole[r.loss_start:r.loss_end] for r in got if r.loss_start is not None] == [r"\\\### a \</turn>", "e"]
    assert [r.start for r in got] == np.cumsum([0, *(len(r.rendered) for r in got[:-1])]).tolist()
