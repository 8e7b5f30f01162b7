import base64
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from airloom.llm import byte_bpe as B, quality as Q, shards as S
from airloom.llm.common import read

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TRICKY = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", " ", "  ", "\n", "\t", "1", "²", "é", "😀", "!", "#", "\xa0", "\u3000", "\x1c", "S", "'s", "字"]


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x, _ in B.encode_texts(texts, B.class_table(), PATH)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(TRICKY), max_size=40).map("".join)), min_size=1, max_size=6))
def test_encoding_is_the_librarys(texts):
    assert ids(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 5000, "#" * 700 + " " * 900 + "x", "é'" * 400, " ", "'", "\n\n", "ab" * 300])
def test_long_pieces(text):
    assert ids([text, "", text]) == [LIBRARY.encode_ordinary(text), [], LIBRARY.encode_ordinary(text)]


def test_pieces_side_by_side(monkeypatch):
    monkeypatch.setattr(B, "TOGETHER", 7)
    merger, names = B._vocabulary(PATH)
    rng = np.random.default_rng(4)
    pieces = [bytes(rng.choice(np.frombuffer(b"aeinst\0\xc3\xa9", np.uint8), n)) for n in rng.integers(1, 90, 300)] + names[::997]
    library = tiktoken.Encoding("pieces", pat_str=r"(?s).+", special_tokens={}, mergeable_ranks=merger.ranks)
    want = [library._encode_single_piece(p) for p in pieces]
    ids, sizes = merger.flat(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in merger.split(pieces)] == want and merger.split([]) == []


def test_scan_agrees_with_stepping():
    rng = np.random.default_rng(1)
    of_symbol, product, function, _, identity = B._monoid()
    s = rng.integers(0, 10, 3 * B.BLOCK * B.BLOCK // 2)
    states = function[:, 0][B._scan(of_symbol[s], product, identity)]
    state = 0
    for x, got in zip(s.tolist(), states.tolist()):
        state = B._step(state, x)[0]
        assert state == got


def test_encode_rows(spark):
    rows = [(1, "it's 12\n\n ok", "x"), (1, "it's 12\n\n ok", "x"), (None, None, "x"), (2, "", None), (3, "wörd " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    for r in B.encode(df, PATH, extra="decoded").collect():
        text = {1: rows[0][1], 3: rows[4][1]}.get(r.doc_id, "")
        assert np.frombuffer(r.ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
        assert bytes(r.decoded).decode() == text and r.n_tokens == len(r.ids) // 4
    some = B.encode(df, PATH, extra="offsets")
    assert [r.offsets for r in some.where("doc_id = 1").collect()] == [[0, 2, 4, 7, 9, 12]] * 2
    assert {bytes(r.decoded).decode() for r in B.decode(some, PATH).collect()} == {rows[0][1], "", rows[4][1]}
    assert B.encode(df.limit(0), PATH).count() == 0


def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    scored = Q.score(docs, Q.train(docs, labels.where(~Q.held_out()))).select("doc_id", "score", "predicted")
    rows = scored.join(labels, "doc_id").where(Q.held_out()).collect()
    right = Counter((r.quality, r.quality == r.predicted) for r in rows)
    assert right[1, True] / (right[1, True] + right[1, False]) > 0.97
    assert right[0, True] / (right[0, True] + right[0, False]) > 0.85
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "#### %%%% ####"), (3, None), (4, ""), (1, "good words here")],
                                 "doc_id long, text string").withColumn("score", F.lit("clash"))
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs, Q.train(docs, no_labels)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None), (3, 0)], "doc_id long, quality int")
    got = Q.score(docs, Q.train(docs, one)).collect()
    assert len(got) == 5 and all(r.score > 0.5 for r in got)
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.score(docs, Q.train(docs, both)).collect())
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), both)).count() == 0


def test_quality_reads_all_of_a_text():
    model = Q.fit([(["Plain words of a sentence. " * 5 + str(i)], 1) for i in range(40)] + [(["NO!! YES!! | | " * 9 + str(i)], 0) for i in range(40)])
    head = "Plain words of a sentence. " * 50
    tailed = head + "NO!! YES!! | | " * 2000
    assert Q.features(head.encode(), model.dictionaries)[0] > 0 > Q.features(tailed.encode(), model.dictionaries)[0]
    assert Q.score_of(head, model) != Q.score_of(tailed, model)


def brute_shards(rows, shards, tolerance):
    """The same tree by sorting rows in memory."""
    total = sum(r["size"] for r in rows)
    dims = [c for c in rows[0] if c[0] == "d" and c[1:].isdigit()]
    span = {d: max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in dims}
    out = {}

    def place(part, first, m):
        if m == 1:
            out.update({r["u"]: first for r in part})
            return
        if part:
            d = max(dims, key=lambda d: ((max(r[d] for r in part) - min(r[d] for r in part)) / span[d], -dims.index(d)))
            part = sorted(part, key=lambda r: (r[d], r["g"], r["i"], r["u"]))
        goal = sum(r["size"] for r in part) * (m // 2) / m
        out_of = [0, *np.cumsum([r["size"] for r in part])]
        cut = min(range(len(out_of)), key=lambda k: abs(out_of[k] - goal))
        place(part[:cut], first, m // 2)
        place(part[cut:], first + m // 2, m - m // 2)

    place(rows, 0, shards)
    return out, total


def test_shards_against_brute_force(spark, small):
    docs = read(spark, small, "documents")
    rows = [r.asDict() for r in S.points(docs, "doc_id", "text", ("doc_id", "source", "lang")).collect()]
    want, _ = brute_shards(rows, 24, 0)
    pts = S.store(spark.createDataFrame(rows))
    dims = ["d0", "d1", "d2", "d3"]
    tree = S.grow(pts, dims, 24, 0.0)
    got = {r.u: r.shard for r in pts.select("u", F.get(S._table(n.first for n in tree), S._descend(tree, dims)).alias("shard")).collect()}
    assert got == want


def test_shards_law(spark):
    texts = [("abc " * (1 + i % 50)) + str(i) for i in range(3000)] + ["copy of a text"] * 40 + ["hot text " * 20] * 1500
    rows = [(i, t, "l" if i % 3 else None, f"s{i % 5}", 1) for i, t in enumerate(texts)] + [(None, None, None, None, 1), (5, texts[5], "l", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    got = S.kd_shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    bytes_of, slots = Counter(), {}
    for r in got:
        bytes_of[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(bytes_of.values()) / 24
    assert set(bytes_of) == set(range(24)) and all(abs(b - mean) < 0.03 * mean for b in bytes_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"copy of a text")}) <= 2


def test_shards_small_tables(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert S.kd_shards(spark.createDataFrame([], schema)).count() == 0
    got = S.kd_shards(spark.createDataFrame([(1, "a", None, None)] * 3, schema)).collect()
    assert len(got) == 3 and all(0 <= r.shard < 24 for r in got)


def test_slots_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "SLOT_ROWS", 7)
    docs = spark.createDataFrame([(i, str(i), "a", "b") for i in range(200)], "doc_id long, text string, lang string, source string")
    slots = {}
    for r in S.kd_shards(docs, shards=3).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
