"""The stored keyword index and the embedding cache."""
import pytest
from pyspark.sql import functions as F

from airloom.operators import retrieval as RT
from airloom.sources import cache_store as C, term_index as X
from airloom.sources.tables import questions, table


@pytest.fixture(scope="module")
def chunks(spark, small):
    d = table(spark, small, "documents").select("doc_id", F.concat(F.lit("n"), (F.col("doc_id") / 5).cast("int")).alias("doc_name"), "text")
    return d.withColumn("text", F.when(F.col("doc_id") != 3, F.col("text")))  # one without text


def key(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.bm25_score, 7)) for r in df.collect())


def test_search_equals_the_direct_one(spark, small, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_DOCS", 8)
    path, q = str(tmp_path), questions(spark, small)
    assert X.search(spark, path, q).count() == 0
    X.add(chunks.where("doc_id % 3 = 0"), path, "a")
    X.add(chunks.where("doc_id % 3 > 0"), path, "b")
    X.add(chunks.where("doc_id % 3 > 0"), path, "b")  # again
    want = key(RT.bm25_search(chunks, q, 4))
    assert key(X.search(spark, path, q, 4)) == want
    monkeypatch.setattr(X, "PUSHED_TOKENS", 2)
    assert key(X.search(spark, path, q, 4)) == want
    X.compact(spark, path)
    state = X.manifest(spark, path)
    assert len(state["batches"]) == 1 and state["batches"][0]["docs"] == chunks.count()
    assert key(X.search(spark, path, q, 4)) == want
    assert len(X.vacuum(spark, path)) == 3 and key(X.search(spark, path, q, 4)) == want


def test_search_reads_its_own_terms_and_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_DOCS", 4)
    texts = [(i, "common word here") for i in range(400)] + [(1000 + i, "rare common word") for i in range(6)]
    path = str(tmp_path)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    X.add(df, path, "a")
    q = spark.createDataFrame([(1, "rare common")], "query_id bigint, text string")
    terms = X._of_tokens(spark, path, "terms", X.manifest(spark, path), RT.query_terms(q))
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token, [" in plan or "PushedFilters: [Or(" in plan, plan
    opened, plain = [], RT.top_k

    def watched(frame, keys, order, k, rank="rank"):
        if "score" in frame.columns:
            opened.append(frame.count())  # documents that were scored
        return plain(frame, keys, order, k, rank)

    monkeypatch.setattr(X, "top_k", watched)
    assert key(X.search(spark, path, q, 3)) == key(RT.bm25_search(df, q, 3))
    assert opened[0] < 100  # of 406


def test_blocks_are_counted_where_chunks_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_DOCS", 16)
    path = str(tmp_path)
    texts = [(i, f"same word w{i % 7} w{i % 7}") for i in range(500)] + [(900, None), (901, "..")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    with monkeypatch.context() as m:
        m.setattr(X, "cut_lineage", lambda df: pytest.fail("postings are written apart from the index"))
        X.add(df, path, "a")
    blocks = X.read(spark, path, "blocks")
    sizes = {(r.batch, r.block): len(r.docs) for r in blocks.where("token = 'same'").collect()}
    assert max(sizes.values()) <= 16 and sum(sizes.values()) == 500
    assert {(p.docs, p.tfs, p.dls) for p in blocks.where("token = 'w3'").selectExpr("inline(arrays_zip(docs, tfs, dls))").collect()} == {
        (i, 2, 4) for i in range(500) if i % 7 == 3}
    assert X.manifest(spark, path)["batches"][0]["docs"] == 502
    q = spark.createDataFrame([(1, "same"), (2, "w5 word"), (3, "none")], "query_id bigint, text string")
    want, seen, plain = key(RT.bm25_search(df, q, 3)), [], RT.top_k

    def watched(frame, keys, order, k, rank="rank"):
        if "score" in frame.columns:
            seen.append(frame.count())
        return plain(frame, keys, order, k, rank)

    monkeypatch.setattr(X, "top_k", watched)
    assert key(X.search(spark, path, q, 3)) == want and seen[0] <= 8 * 2 * 3  # tasks, queries, k; not a row per hit
    monkeypatch.setattr(RT.SB, "MAX_MATRIX_BYTES", 0)
    assert key(X.search(spark, path, q, 3)) == want


def test_blocks_go_on_over_batches(spark, tmp_path):
    path, size = str(tmp_path), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(9))) for i in range(60)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "w1 w2 w3 w4"), (2, "w0 w5")], "query_id bigint, text string")
    X.add(df, path, "a")
    want = key(RT.bm25_search(df, q, 5))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert key(X.search(spark, path, q, 5)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_rebuild_is_one_step(spark, chunks, tmp_path, monkeypatch):
    path = str(tmp_path)
    X.add(chunks.where("doc_id < 100"), path, "a")
    X.add(chunks.where("doc_id >= 100"), path, "b")
    before = X.manifest(spark, path)
    new = chunks.where("doc_name = 'n2'").withColumn("text", F.lit("zebra quagga"))
    q = spark.createDataFrame([(1, "quagga")], "query_id bigint, text string")
    with monkeypatch.context() as m:
        m.setattr(X, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            X.rebuild(new, path)
    assert X.manifest(spark, path) == before and X.search(spark, path, q).count() == 0
    X.rebuild(new, path)
    assert sorted(r.doc_id for r in X.search(spark, path, q, 9).collect()) == sorted(r.doc_id for r in new.collect())
    assert X.manifest(spark, path)["batches"][0]["docs"] == chunks.count()
    with pytest.raises(RuntimeError):
        X.commit(spark, path, before["generation"], [])


def test_cache(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    monkeypatch.setattr(C, "MOST_FOLDERS", 3)
    assert C.read(spark, path).count() == 0
    for i in range(7):
        C.append(spark.createDataFrame([(f"k{i}", [float(i)], i), (f"k{i}", [9.0], i - 1)], C.SCHEMA), path)
        assert len(X.manifest(spark, path)["batches"]) <= 3
    C.append(spark.createDataFrame([("k0", None, 50)], C.SCHEMA), path)  # a use
    got = {r.key: (r.embedding, r.used_at) for r in C.read(spark, path).collect()}
    assert got == {"k0": ([0.0], 50)} | {f"k{i}": ([float(i)], i) for i in range(1, 7)}
    C.evict(spark, path, 3)
    assert sorted(r.key for r in C.read(spark, path).collect()) == ["k0", "k5", "k6"]
    X.vacuum(spark, path)
    assert C.read(spark, path).count() == 3


def test_first_rows_are_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 13).alias("u"))
    want = sorted(((r.u, r.id) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    for n in (0, 1, 77, 500, 999, 1000, 2000):
        got = RT.keep_first_rows(df, n, [F.col("u").desc(), F.col("id")]).collect()
        assert sorted((r.u, r.id) for r in got) == sorted(want[:n])
