import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloom import constants as K
from airloom.functions import prompts as PR, scoring as SC, text as T
from airloom.operators import chunking as CH, evaluation as EV, ingest as IN, memory as M, retrieval as RT
from airloom.operators import scoring_block as SB
from airloom.sources.tables import documents_as_pages


def one(spark, value):
    return spark.createDataFrame([(value,)], "t string")


@pytest.mark.parametrize("question,intent", [
    ("Please show the live readings for our ward right now", "live_data"), ("Should asthma patients wear a mask this evening", "health_advice"),
    ("Sing a song", "general"), ("Which regulation covers firecrackers", "policy")])
def test_intents(spark, question, intent):
    r = one(spark, question).select(T.intent(F.col("t")).alias("i"), T.intent_config(T.intent(F.col("t"))["intent"]).alias("c")).first()
    assert r.i.intent == intent and r.c.top_k == K.INTENT_CONFIG[intent][2]
    assert (r.i.confidence == 0.3) == (intent == "general")


def test_topic_year_ties(spark):
    r = one(spark, "1999 2001 wind health 2001 1999 asthma wind").select(T.topic(F.col("t")).alias("p"), T.year(F.col("t")).alias("y")).first()
    assert (r.p, r.y) == ("historical_data", 1999)
    r = one(spark, "wind lung").select(T.topic(F.col("t")).alias("p"), T.year(F.col("t")).alias("y")).first()
    assert (r.p, r.y) == ("health", None)


def test_tokens_and_keys(spark):
    r = one(spark, "  Étion, ÑO_1 été ").select(T.tokens(F.col("t")).alias("w"), T.cache_key(F.col("t")).alias("k"), T.token_estimate(F.lit("")).alias("e")).first()
    assert r.w == ["étion", "ño_1", "été"] and r.e == 1
    assert r.k == hashlib.sha256("étion, ño_1 été".encode()).hexdigest()[:24]


# --- Chunks against a plain packer ----------------------------------------------------------

def plain_chunks(text, max_tokens, overlap, far=()):
    sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n{2,}", text.replace("\r", "")) if s.strip()]
    if len(sents) <= 3:
        return [text.strip()] if sents else []
    est = [max(1, int(len(s.split()) * 1.3)) for s in sents]
    out, first, used = [], 0, 0
    for i in range(len(sents)):
        if i > first and (used + est[i] > max_tokens or i in far):
            out.append(sents[first:i])
            keep, spent = i, 0
            while keep > first and spent + est[keep - 1] <= overlap:
                keep -= 1
                spent += est[keep]
            first, used = keep, spent
        used += est[i]
    return [" ".join(g) for g in out + [sents[first:]]]


@pytest.mark.parametrize("max_tokens,overlap", [(512, 200), (40, 15), (20, 0)])
def test_chunks_match_plain_packer(spark, small, max_tokens, overlap):
    pages = documents_as_pages(spark, small)
    got = {}
    for r in CH.chunk_pages(pages, max_tokens, overlap).orderBy("doc_name", "chunk").collect():
        got.setdefault(r.doc_name, []).append(r.text)
    want = {r.doc_name: plain_chunks(r.text, max_tokens, overlap) for r in pages.collect() if len(r.text.strip()) >= 40}
    assert got == {k: v for k, v in want.items() if v}


def test_semantic_breaks(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(8))
    vectors = [[1.0, 0.0]] * 4 + [[0.0, 1.0]] * 4
    df = spark.createDataFrame([("d", 1, text, "text", vectors)], "doc_name string, page int, text string, source_type string, v array<array<float>>")
    got = [r.text for r in CH.chunk_pages(df, 512, 0, vectors="v").orderBy("chunk").collect()]
    assert got == plain_chunks(text, 512, 0, far={4})


def test_short_and_empty_pages(spark):
    df = spark.createDataFrame([("a", 1, "too short", "text"), ("b", 1, "x" * 45, "pdf"), ("c", None, None, "text")],
                               "doc_name string, page int, text string, source_type string")
    rows = CH.chunk_pages(df).collect()
    assert [(r.doc_name, r.topic, r.year, r.credibility_score) for r in rows] == [("b", "general", None, 0.85)]


# --- Retrieval ------------------------------------------------------------------------------

DOCS = [(1, "red apple red"), (2, "green apple"), (3, "blue sky and the sea"), (4, ""), (5, "green apple"), (6, "!!!")]


def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def plain_bm25(query):
    toks = {d: re.findall(r"\w+", t.lower()) for d, t in DOCS}
    n, avg = len(DOCS), sum(map(len, toks.values())) / len(DOCS)
    out = {}
    for d, words in toks.items():
        s = 0.0
        for q in re.findall(r"\w+", query.lower()):
            df = sum(q in w for w in toks.values())
            if df:
                tf = words.count(q)
                s += math.log((n - df + .5) / (df + .5) + 1) * tf * 2.5 / (tf + 1.5 * (.25 + .75 * len(words) / avg))
        out[d] = s
    return out


def test_bm25_small(spark):
    q = spark.createDataFrame([(1, "apple red apple"), (2, "nothing here"), (3, "the sea")], "query_id bigint, text string")
    got = RT.bm25_search(corpus(spark), q, 5).collect()
    for qid, text in ((1, "apple red apple"), (3, "the sea")):
        want = sorted(((-round(s, 9), d) for d, s in plain_bm25(text).items() if s > 0))
        mine = [(r.doc_id, r.bm25_score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == qid]
        assert [m[0] for m in mine] == [d for _, d in want]
        assert mine[0][1] == pytest.approx(1.0)
    assert not [r for r in got if r.query_id == 2]


def test_nearest_far_from_the_origin(spark):
    """The order of close vectors survives a common offset, for any number of queries in a block."""
    import random

    rng = random.Random(3)
    points = [[1e7 + rng.random(), -1e7 + rng.random()] for _ in range(300)]
    vec = spark.createDataFrame(list(enumerate(points)), "vec_id bigint, embedding array<double>")
    qv = spark.createDataFrame(list(enumerate(points[:5])), "query_id bigint, embedding array<double>")
    want = {q: [i for _, i in sorted((round(sum((a - b) ** 2 for a, b in zip(p, points[q])), 9), i) for i, p in enumerate(points))[:5]] for q in range(5)}
    for block in (1, 2, 100):
        rows = RT.flat_search(vec, qv, 5, block=block).orderBy("query_id", "rank").collect()
        assert {q: [r.vec_id for r in rows if r.query_id == q] for q in range(5)} == want
        assert all(str(r.distance) != "-0.0" for r in rows)


def test_searches_agree_beyond_the_bounds(spark, monkeypatch):
    """The shuffled way for large batches gives the same lists as the matrix way."""
    q = spark.createDataFrame([(1, "apple red apple"), (3, "the sea"), (4, "???")], "query_id bigint, text string")
    vec = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(40)], "vec_id bigint, embedding array<float>")
    qv = spark.createDataFrame([(0, [3.0, 2.0]), (1, [20.0, 1.0])], "query_id bigint, embedding array<float>")

    def run():
        key = lambda rows: sorted((r.query_id, r["rank"], r[1]) for r in rows)
        return (key(RT.bm25_search(corpus(spark), q, 3).collect()), key(RT.tfidf_search(corpus(spark), q, 4).collect()),
                key(RT.flat_search(vec, qv, 4).collect()))

    small_way = run()
    flat = RT.flat_search(vec, qv, 4, block=1).collect()
    assert sorted((r.query_id, r["rank"], r[1]) for r in flat) == small_way[2]
    monkeypatch.setattr(SB, "MAX_MATRIX_BYTES", 0)
    monkeypatch.setattr(RT, "is_small", lambda df: False)
    monkeypatch.setattr(RT, "MAX_BATCH", 0)
    assert run() == small_way
    assert len([r for r in small_way[1] if r[0] == 4]) == 4  # a query outside the space still gets its k nearest


def test_knn_brute_force(spark):
    rng = np.random.default_rng(0)
    e, q = rng.normal(size=(300, 8)).astype("float32"), rng.normal(size=(3, 8)).astype("float32")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id bigint, embedding array<float>").repartition(5)
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id bigint, embedding array<float>")
    for r in RT.flat_search(v, qs, 7).collect():
        d = ((e.astype(float) - q[r.query_id].astype(float)) ** 2).sum(axis=1)
        assert r.vec_id == np.argsort(d)[r["rank"] - 1] and r.distance == pytest.approx(d[r.vec_id], abs=1e-6)


def test_fusion_collapses_equal_texts(spark):
    dense = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id bigint, doc_id bigint, rank int")
    sparse = spark.createDataFrame([(1, 5, 1), (1, 1, 2)], "query_id bigint, doc_id bigint, rank int")
    got = RT.fuse(dense, sparse, corpus(spark)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 3, 1]
    assert got[0].hybrid_score == pytest.approx(0.6 / 61 + 0.4 / 61, abs=1e-6)


def test_rerank_floor_and_fallback(spark):
    rows = [(1, 1, 0.1, -9.0), (1, 2, 0.05, -9.0), (2, 3, None, 2.0), (2, 4, 0.9, None)]
    c = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, credibility_score double, cross_encoder_score double")
    got = {(r.query_id, r["rank"]): r for r in RT.rerank(c).collect()}
    assert set(got) == {(1, 1), (2, 1), (2, 2)} and got[(1, 1)].doc_id == 1
    assert got[(2, 1)].final_score == pytest.approx(0.85 / (1 + math.exp(-2)) + 0.15 * 0.75, abs=1e-4)
    assert RT.rerank(c, has_model=False).where("query_id = 1").count() == 2


def test_elbow(spark):
    df = spark.createDataFrame([("a", s, i) for i, s in enumerate([1.0, .95, .9, .4, .39])] + [("b", .5, 0)], "k string, s double, i int")
    got = {r["k"]: r[1] for r in RT.adaptive_k(df, ["k"], "s", [F.col("i")]).toDF("key", "n").withColumnRenamed("key", "k").collect()}
    assert got == {"a": 3, "b": 1}


def test_cache(spark):
    fresh = spark.createDataFrame([("k1", [1.0], 2), ("k2", [2.0], 3), ("k1", [9.0], 5)], "key string, embedding array<double>, used_at int")
    kept = RT.cache_merge(fresh.limit(0), fresh, max_size=1).collect()
    assert [(r.key, r.embedding) for r in kept] == [("k1", [9.0])]


# --- Scoring --------------------------------------------------------------------------------

def test_answer_scores(spark):
    df = spark.createDataFrame([("", "what is it"), ("some words", "what is it"), ("alpha beta gamma", "alpha delta")], "a string, q string")
    got = df.select(SC.answer_relevancy(F.col("a"), F.col("q")), SC.answer_correctness(F.col("a"), F.col("q"))).collect()
    assert [round(r[0], 4) for r in got] == [0.0, 0.5, 0.53] and [round(r[1], 4) for r in got] == [0.0, 0.0, 0.4]


def test_array_and_long_forms_agree(spark):
    cases = spark.createDataFrame([(1, "q", "Lungs are hurt by dust badly. Short. Nothing to see in here."), (2, "q", "")], "case_id int, question string, text string")
    ctx = spark.createDataFrame([(1, 1, "dust hurt lungs", "x"), (1, 2, "badly", "x")], "case_id int, context_id int, text string, topic string")
    long = {r.case_id: r.f for r in EV.supported_share(cases, ctx, 0.4, "f").collect()}
    arr = cases.select("case_id", SC.faithfulness(F.col("text"), F.when(F.col("case_id") == 1, F.array(F.lit("dust hurt lungs"), F.lit("badly"))).otherwise(F.array().cast("array<string>"))).alias("f"))
    assert {r.case_id: r.f for r in arr.collect()} == long == {1: 0.5, 2: 0.0}


def test_cases_share_contexts(spark):
    cases = spark.createDataFrame([(1, 7, "dust hurts", "Lungs are hurt by dust badly. Nothing to see in here."), (2, 7, "lungs badly", "Lungs are fine badly."),
                                   (3, 8, "dust", "Lungs are hurt by dust badly."), (1, 8, "other words", "Other words for eight.")],
                                  "case_id int, conv int, question string, text string").withColumn("expected_topics", F.array(F.lit("health")))
    ctx = spark.createDataFrame([(7, 1, "dust hurt lungs", "x"), (7, 2, "badly", None), (8, 3, "other words", "health"), (9, 4, "dust", "x")],
                                "conv int, context_id int, text string, topic string")
    long = ctx.join(cases.select("conv", "case_id"), "conv")
    sort = lambda df: sorted(tuple(r) for r in df.collect())
    for by_conv, by_case in ((EV.supported_share(cases, ctx, 0.4, "f", "conv"), EV.supported_share(cases, long, 0.4, "f")),
                             (EV.context_precision(cases, ctx, "conv"), EV.context_precision(cases, long))):
        assert sort(by_conv) == sort(by_case) and len(sort(by_conv)) == 4
    assert sort(EV.supported_share(cases, ctx, 0.4, "f", "conv")) == [(1, 2 / 3), (1, 2 / 3), (2, 1.0), (3, 0.0)]


def test_risk_escalation(spark):
    def risk(text, n):
        return one(spark, text).select(SC.answer_risk(F.col("t"), F.lit(n)).alias("r")).first().r

    assert risk("fine [Ref 1]", 3).hallucination_risk == "low"
    assert risk("plain", 1).hallucination_risk == "medium"
    r = risk("100 200 300 4000", 1)
    assert r.hallucination_risk == "high" and r.should_regenerate and len(r.reasons) == 2
    assert risk("maybe probably possibly", 0).hallucination_risk == "medium"
    assert risk("see [a](https://b.c)", 3).hallucination_risk == "medium"


def test_confidence_without_chunks(spark):
    none = F.array().cast("array<struct<final_score:double,rerank_score:double,credibility_score:double>>")
    parts = SC.confidence_parts(F.col("t"), F.lit("what is it"), none)
    r = one(spark, "short answer").select(*[c.alias(k) for k, c in parts.items()]).first()
    assert tuple(r) == (0.2, 0.5, 0.5, 0.3)
    badge = spark.range(1).select(SC.confidence_badge(F.lit(0.786), F.lit("high"))).first()[0]
    assert badge == "[HIGH] Confidence: 78% (high)"


def test_prompts(spark):
    chunk = F.array(F.struct(F.lit("d").alias("doc_name"), F.lit("health").alias("topic"), F.lit(0.5).alias("final_score"),
                             F.lit(None).cast("double").alias("rerank_score"), F.lit("body").alias("text")))
    snap = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    p = spark.range(1).select(PR.build_prompt(F.lit("why?"), chunk, snap, F.lit("factual"), F.lit(0.6)).alias("p"),
                              PR.regeneration_prompt(F.lit("why?"), chunk).alias("r")).first()
    assert p.p.startswith("**My question:** why?\n\n*[Query intent: factual (conf=60%)]*")
    assert p.p.index("  • a: 1") < p.p.index("  • b: 2") and "\n[Ref 1] (d | topic=health | relevance=0.50):\nbody" in p.p
    assert "\n[Ref 1] (d): body\n" in p.r


# --- Memory and ingestion -------------------------------------------------------------------

def plain_compact(msgs, max_tokens, keep):
    head = msgs[:1] if msgs[0][0] == "system" else []
    chat = msgs[len(head):]
    tok = sum(max(1, int(len(t.split()) * 1.3)) for _, t in chat)
    if tok <= max_tokens and len(chat) <= 2 * keep:
        return msgs
    k = min(keep, len(chat))
    old, recent = chat[:len(chat) - k], chat[len(chat) - k:]
    out = list(head)
    if old:
        lines = [f"User asked: {t[:100]}" if r == "user" else f"Assistant discussed: {t[:80]}" for r, t in old]
        if len(lines) > 6:
            lines = lines[:3] + ["..."] + lines[-2:]
        out.append(("system", f"[Conversation Summary — {len(old)} earlier messages]\n" + " | ".join(lines)))
    return out + recent


@pytest.mark.parametrize("max_tokens,keep", [(6000, 6), (40, 6), (10, 2)])
def test_compaction_matches_plain(spark, max_tokens, keep):
    convs = {}
    for c, n in enumerate([1, 2, 5, 11, 12, 13, 14, 19, 40]):
        msgs = [("user" if i % 2 == 0 else "assistant", f"word{i} " * (1 + i * 7 % 30)) for i in range(n)]
        convs[c] = ([("system", "rules")] if c % 2 else []) + msgs
    rows = [(c, t, r, x) for c, msgs in convs.items() for t, (r, x) in enumerate(msgs)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = {}
    for r in M.compact(df, max_tokens, keep).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: plain_compact(m, max_tokens, keep) for c, m in convs.items()}


def test_new_documents_by_name(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 50, "text"), ("b", 1, "y" * 50, "text")], "doc_name string, page int, text string, source_type string")
    known = pages.where("doc_name = 'a'")
    assert [r.doc_name for r in IN.new_chunks(pages, known).collect()] == ["b"]
    assert IN.new_chunks(pages, known, force=True).count() == 2
    assert IN.snippet_chunks(spark.createDataFrame([("n", "z" * 50)], "name string, text string")).count() == 1


def test_term_stats(spark):
    got = {r.token: (r.df, r.cf) for r in RT.term_stats(corpus(spark)).collect()}
    counts = Counter(w for _, t in DOCS for w in re.findall(r"\w+", t))
    assert {k: v[1] for k, v in got.items() if k} == dict(counts) and got["apple"][0] == 3 and got[""][0] == 6


def test_blocks_are_counted_without_python_strings():
    import pyarrow as pa

    part = pa.RecordBatch.from_arrays([pa.array([["z"], ["a", "b", "a"], [], ["b", "x"]])], ["w"]).slice(1)
    counts, sizes = SB.count_block(part, pa.array(["b", "a"]))
    assert counts.tolist() == [[1, 2], [0, 0], [1, 0]] and sizes.tolist() == [3, 0, 2]
    known, word, row, n = SB.pair_counts(part.column("w"))
    assert sorted(zip([known[int(i)].as_py() for i in word], row, n)) == [("a", 0, 2), ("b", 0, 1), ("b", 2, 1), ("x", 2, 1)]


def test_blocks_of_wide_rows_are_small(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(part):
        seen.add(1)
        return np.ones((part.num_rows, 1))

    rows = spark.range(0, 100, 1, 1).select(F.col("id").alias("doc_id"))
    got = SB.best_per_task(rows, score, [5], 3, width=SB.BLOCK_CELLS // 10).collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(5, 0), (5, 1), (5, 2)] and seen.value == 10


def test_statistics_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(RT, "STATS_BLOCK", 2)
    got = {r.token: (r.df, r.cf, r.dl_sum) for r in RT.term_stats(corpus(spark).coalesce(1)).collect()}
    words = [re.findall(r"\w+", t) for _, t in DOCS]
    want = {w: (sum(w in t for t in words), sum(t.count(w) for t in words), sum(len(t) for t in words if w in t)) for t in words for w in t}
    assert got == want | {"": (6, 6, sum(map(len, words)))}


def test_marks_are_of_found_documents_only(spark):
    """A mark that cannot be computed for a document that nobody found."""
    docs = spark.createDataFrame([(1, "7"), (2, "not a number")], "doc_id bigint, text string")
    found = spark.createDataFrame([(1, 1), (2, 1)], "query_id bigint, doc_id bigint")
    got = RT.with_marks(found, docs, F.expr("CAST(text AS INT)").alias("n")).collect()
    assert sorted((r.query_id, r.doc_id, r.n) for r in got) == [(1, 1, 7), (2, 1, 7)]


def test_topic_equals_scores(spark, small):
    texts = documents_as_pages(spark, small).select("doc_id", "text")
    odd = ["sub index sub\nindex sub\rindex sub\u0085index sub\u2028index sub\U0001f600index wind", "NAQI aqi İndex", "urban ban run", "",
           None, "1999 ١٩٩٩ year", "12345678 trend health disease asthma lung", "who whoever epa run runs jog jogging"]
    rows = texts.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(odd, 1)], "doc_id bigint, text string"))
    names = [n for n, _ in K.TOPICS]
    got = rows.select(T.topic(F.col("text")).alias("t"), T.topic_scores(F.col("text")).alias("s")).collect()
    for r in got:
        if None in r.s:
            assert r.t is None
        else:
            assert r.t == (names[r.s.index(max(r.s))] if max(r.s) else "general")
    plan = rows.select(T.topic(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_" not in plan  # not in the JVM's interpreter
