"""Queries on documents, questions and conversations: text, chunking, retrieval, scoring, memory, ingestion."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions import prompts as PR
from ..functions import scoring as SC
from ..functions import text as T
from ..operators import chunking as CH
from ..operators import evaluation as EV
from ..operators import ingest as IN
from ..operators import memory as M
from ..operators import retrieval as RT
from ..sources.tables import documents_as_pages, questions, table, texts
from . import sql_parts as S
from .catalog import ORACLES, near, query


def docs(spark, sf) -> DataFrame:
    return texts(spark, sf, "documents").select("doc_id", "text")


# --- Text -----------------------------------------------------------------------------------

@query("txt_sentences", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, s[1] AS first, s[len(s)] AS last FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents) WHERE len(s) > 0")
def txt_sentences(spark, sf):
    s = docs(spark, sf).withColumn("s", T.sentences(F.col("text"))).where(F.size("s") > 0)
    return s.select("doc_id", F.size("s").alias("sentences"), F.element_at("s", 1).alias("first"), F.element_at("s", -1).alias("last"))


@query("txt_token_counts", f"SELECT doc_id, CAST(len({S.tokens('text')}) AS INTEGER) AS tokens, CAST(len(list_distinct({S.tokens('text')})) AS INTEGER) AS distinct_tokens, {S.token_estimate('text')} AS estimate FROM documents")
def txt_token_counts(spark, sf):
    d = docs(spark, sf).withColumn("t", T.tokens(F.col("text")))
    return d.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"),
                    T.token_estimate(F.col("text")).alias("estimate"))


@query("txt_cache_key", r"SELECT doc_id, substr(sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))), 1, 24) AS key FROM documents")
def txt_cache_key(spark, sf):
    return docs(spark, sf).select("doc_id", T.cache_key(F.col("text")).alias("key"))


@query("txt_topic_argmax", f"SELECT doc_id, {S.topic('text')} AS topic FROM documents")
def txt_topic_argmax(spark, sf):
    return docs(spark, sf).select("doc_id", T.topic(F.col("text")).alias("topic"))


@query("txt_year_mode", r"""WITH y AS (SELECT doc_id, unnest(f) AS y, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text || ' ' || (1980 + doc_id % 45) || ', ' || (1990 + n_chars % 30), '\b(20[0-2]\d|19[89]\d)\b', 1) AS f FROM documents)),
c AS (SELECT doc_id, y, count(*) AS n, min(i) AS i FROM y GROUP BY 1, 2)
SELECT doc_id, CAST(arg_max(y, (n, -i)) AS INTEGER) AS year FROM c GROUP BY 1""")
def txt_year_mode(spark, sf):
    """The texts hold hardly any year, so two are appended to each."""
    d = table(spark, sf, "documents")
    t = F.concat("text", F.lit(" "), (1980 + F.col("doc_id") % 45).cast("string"), F.lit(", "), (1990 + F.col("n_chars") % 30).cast("string"))
    return d.select("doc_id", T.year(t).alias("year")).where("year IS NOT NULL")


PAGES = """pages_in AS (SELECT doc_id, source || '-' || CASE lang WHEN 'fr' THEN 'research' WHEN 'de' THEN 'official' WHEN 'es' THEN 'historical' ELSE 'notes' END || '-' || doc_id AS doc_name,
  1 AS page, text, CASE WHEN lang = 'en' THEN 'pdf' ELSE 'text' END AS source_type FROM documents)"""
CRED = ("CASE WHEN regexp_matches(lower(doc_name), 'research|study|paper|journal|pubmed') THEN 0.95::DOUBLE WHEN regexp_matches(lower(doc_name), 'government|cpcb|who|epa|official') THEN 0.92::DOUBLE "
        "WHEN regexp_matches(lower(doc_name), 'comprehensive|methodology|guide') THEN 0.88::DOUBLE WHEN source_type = 'pdf' THEN 0.85::DOUBLE WHEN regexp_matches(lower(doc_name), 'historical|data') THEN 0.82::DOUBLE ELSE 0.75::DOUBLE END")


@query("txt_credibility", f"WITH {PAGES} SELECT doc_name, {CRED} AS credibility FROM pages_in")
def txt_credibility(spark, sf):
    p = documents_as_pages(spark, sf)
    return p.select("doc_name", T.credibility(F.col("doc_name"), F.col("source_type")).alias("credibility"))


HEADS = [
    "Please show the live readings for our ward right now. ",
    "Should asthma patients wear a mask this evening? ",
    "Did winter smog grow between 2015 and 2023? ",
    "Is PM10 higher in Mumbai versus Pune? ",
    "Explain what ozone is and how it forms. ",
    "Which regulation covers firecrackers? ",
]
INTENT_TEXT = "(CASE item_id % 8 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS)) + " ELSE '' END || text)"
_SCORES = "[" + ", ".join("1.5::DOUBLE * (" + " + ".join(S.count_matches("q", p) for p in pats) + ")" for _, pats in K.INTENTS) + "]"
_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in K.INTENTS) + "]"
INTENT = f"""qs AS (SELECT item_id, {INTENT_TEXT} AS question, lower({INTENT_TEXT}) AS q FROM benchmark),
sc AS (SELECT item_id, question, {_SCORES} AS s FROM qs),
it AS (SELECT item_id, question, list_sum(s) AS total, list_max(s) AS best, ({_NAMES})[list_position(s, list_max(s))] AS name FROM sc),
intents AS (SELECT item_id, question, CASE WHEN weak THEN 'general' ELSE name END AS intent, CASE WHEN weak THEN 0.3::DOUBLE ELSE least(best / (total + 1e-9), 1) END AS confidence
  FROM (SELECT *, total = 0 OR best / (total + 1e-9) < 0.2 OR best < 1 AS weak FROM it))"""


def asked(spark, sf) -> DataFrame:
    """Benchmark texts, most with a question in front."""
    m = F.col("query_id") % 8
    lead = F.coalesce(F.try_element_at(F.lit(HEADS), (m + 1).cast("int")), F.lit(""))
    return questions(spark, sf).withColumn("text", F.concat(lead, "text"))


@query("txt_intent_classify", f"""WITH {INTENT}
SELECT item_id, intent, round(confidence + 1e-9, 4) AS confidence, intent IN ('live_data', 'health_advice', 'comparison') AS needs_api, intent NOT IN ('live_data', 'general') AS needs_rag,
  CASE intent WHEN 'live_data' THEN 3 WHEN 'general' THEN 3 WHEN 'historical' THEN 7 WHEN 'comparison' THEN 6 ELSE 5 END AS top_k FROM (SELECT item_id, intent, round_even(confidence, 3) AS confidence FROM intents)""")
def txt_intent_classify(spark, sf):
    q = asked(spark, sf).withColumn("i", T.intent(F.col("text")))
    cfg = T.intent_config(F.col("i.intent"))
    return q.select(F.col("query_id").alias("item_id"), F.col("i.intent").alias("intent"), near("i.confidence", 4).alias("confidence"),
                    cfg["needs_api"].alias("needs_api"), cfg["needs_rag"].alias("needs_rag"), cfg["top_k"].alias("top_k"))


@query("txt_tool_dispatch", f"""WITH {INTENT}
SELECT item_id, CASE WHEN intent NOT IN ('live_data', 'health_advice', 'comparison') THEN 'none' WHEN item_id < 20 THEN 'cached_snapshot' ELSE 'get_current_aqi' END AS tool FROM intents""")
def txt_tool_dispatch(spark, sf):
    """Which tool a question triggers; a session with a snapshot uses it instead of fetching."""
    has_snapshot = F.col("query_id") < 20
    return asked(spark, sf).select(F.col("query_id").alias("item_id"), F.when(~T.needs_live_api(F.col("text")), "none").when(
        has_snapshot, "cached_snapshot").otherwise("get_current_aqi").alias("tool"))


@query("txt_latin1", r"""SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(text || ' – “α” ≥ µ 漢', '–', '-'), '“', '"'), '”', '"'), 'α', 'alpha'), '≥', '>='), 'µ', 'u'), '[^\x00-\x{FF}]', '?', 'g') AS t
FROM documents""")
def txt_latin1(spark, sf):
    return docs(spark, sf).select("doc_id", T.latin1(F.concat("text", F.lit(" – “α” ≥ µ 漢"))).alias("t"))


# --- Chunks ---------------------------------------------------------------------------------

def pages(spark, sf) -> DataFrame:
    return documents_as_pages(spark, sf)


@query("chk_chunks")
def chk_chunks(spark, sf):
    """Annotated chunks of every document; checked against a plain Python packer in the tests."""
    c = CH.chunk_pages(pages(spark, sf))
    return c.select("doc_name", "page", "chunk", "source_type", "topic", "year", "credibility_score", "token_count", F.sha2("text", 256).alias("digest"))


@query("chk_chunk_limits", rf"""WITH {PAGES}, s AS (SELECT doc_name, {S.sentences('text')} AS s, text FROM pages_in WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 40)
SELECT count(*) FILTER (len(s) BETWEEN 1 AND 3) AS single_chunk_pages, count(*) FILTER (len(s) > 3) AS packed_pages, sum(len(s))::BIGINT AS sentences FROM s""")
def chk_chunk_limits(spark, sf):
    p = pages(spark, sf).where(F.length(T.strip(F.col("text"))) >= K.MIN_PAGE_CHARS).select(F.size(T.sentences(F.col("text"))).alias("n"))
    return p.agg(F.count_if(F.col("n").between(1, 3)).alias("single_chunk_pages"), F.count_if(F.col("n") > 3).alias("packed_pages"), F.sum("n").alias("sentences"))


def _recursive_chunks(max_tokens: int, overlap: int) -> str:
    est = S.token_estimate("s")
    return f"""WITH RECURSIVE {PAGES},
ss AS (SELECT doc_name, {S.sentences('text')} AS l FROM pages_in WHERE length(text) >= 40),
st AS (SELECT doc_name, len(l)::INTEGER AS n, list_transform(l, lambda s: {est}) AS t FROM ss WHERE len(l) > 3),
walk AS (
  SELECT doc_name, 1 AS i, 1 AS s, t[1] AS tok, 0 AS cuts, n, t FROM st
  UNION ALL
  SELECT doc_name, i + 1, CASE WHEN cut THEN i + 1 - kept ELSE s END, CASE WHEN cut THEN coalesce(list_sum(t[i + 1 - kept : i]), 0)::INTEGER + t[i + 1] ELSE tok + t[i + 1] END, cuts + cut::INTEGER, n, t
  FROM (SELECT *, tok + t[i + 1] > {max_tokens} AS cut,
          coalesce(len(list_filter(range(s, i + 1), lambda j: list_sum(t[j : i]) <= {overlap})), 0)::INTEGER AS kept FROM walk WHERE i < n))
SELECT doc_name, max(cuts) + 1 AS chunks, max(s) AS last_start FROM walk GROUP BY 1"""


@query("chk_greedy_bounds", _recursive_chunks(60, 20))
def chk_greedy_bounds(spark, sf):
    """Number of chunks and first sentence (from 1) of the last one, packing to 60 tokens with an overlap of 20."""
    p = pages(spark, sf).where(F.length("text") >= 40).withColumn("l", T.sentences(F.col("text"))).where(F.size("l") > 3)
    runs = CH.runs(F.transform("l", T.token_estimate), None, 60, 20)
    r = p.select("doc_name", runs.alias("r"))
    return r.select("doc_name", F.size("r").alias("chunks"), (F.element_at("r", -1)["s"] + 1).alias("last_start"))


@query("agg_topic_histogram", f"SELECT topic, count(*) AS chunks FROM (SELECT {S.topic('text')} AS topic FROM documents) GROUP BY 1")
def agg_topic_histogram(spark, sf):
    return IN.topic_histogram(docs(spark, sf).withColumn("topic", T.topic(F.col("text"))))


@query("inc_new_documents", f"""WITH {PAGES} SELECT doc_name, {S.topic('text')} AS topic, {CRED} AS credibility FROM pages_in WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def inc_new_documents(spark, sf):
    """Documents that the index (here: the labelled ones) does not know."""
    p = pages(spark, sf)
    indexed = p.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    fresh = IN.new_pages(p, indexed)
    return fresh.select("doc_name", T.topic(F.col("text")).alias("topic"), T.credibility(F.col("doc_name"), F.col("source_type")).alias("credibility"))


@query("inc_ingest_chunks")
def inc_ingest_chunks(spark, sf):
    p = pages(spark, sf)
    indexed = p.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return IN.new_chunks(p, indexed).groupBy("doc_name").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))


@query("cache_lookup_split", r"""WITH k AS (SELECT doc_id, substr(sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))), 1, 24) AS key FROM documents),
c AS (SELECT DISTINCT key FROM k JOIN labels USING (doc_id))
SELECT count(*) FILTER (c.key IS NOT NULL) AS hits, count(*) FILTER (c.key IS NULL) AS misses, round_even(count(*) FILTER (c.key IS NOT NULL) / count(*)::DOUBLE, 3) AS hit_rate FROM k LEFT JOIN c USING (key)""")
def cache_lookup_split(spark, sf):
    d = docs(spark, sf)
    known = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(T.cache_key(F.col("text")).alias("key")).distinct()
    return RT.cache_stats(RT.cache_lookup(d, known.withColumn("embedding", F.array(F.lit(1.0)))))


# --- Retrieval ------------------------------------------------------------------------------

@query("agg_term_stats", f"""WITH t AS (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM documents)
SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1""")
def agg_term_stats(spark, sf):
    return RT.term_stats(docs(spark, sf)).where("token <> ''").select("token", "df", "cf")


BM25 = f"""t AS (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2),
dl AS (SELECT doc_id, len({S.tokens('text')}) AS dl FROM documents),
st AS (SELECT count(*) AS n, sum(dl) / count(*)::DOUBLE AS avg_dl FROM dl),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({S.tokens('text')}) AS token FROM benchmark) GROUP BY 1, 2),
bm AS (SELECT query_id, tf.doc_id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 9) AS score
  FROM qt JOIN tf USING (token) JOIN df USING (token) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY 1, 2)"""


@query("topk_bm25", f"""WITH {BM25},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM bm WHERE score > 0)
SELECT query_id, doc_id, round(score / (top + 1e-9) + 1e-9, 5) AS bm25_score, rank FROM r WHERE rank <= 10""")
def topk_bm25(spark, sf):
    return RT.bm25_search(docs(spark, sf), questions(spark, sf), 10).withColumn("bm25_score", near("bm25_score", 5))


@query("topk_knn_l2", """WITH c AS (SELECT label, [""" + ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, 65)) + """] AS q FROM embeddings GROUP BY 1),
d AS (SELECT label AS query_id, vec_id, round(list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, round(distance + 1e-9, 6) AS distance, round(1 / (1 + distance) + 1e-9, 6) AS dense_score, rank FROM r WHERE rank <= 10""")
def topk_knn_l2(spark, sf):
    """The ten vectors nearest to the mean of each label."""
    e = table(spark, sf, "embeddings")
    means = e.groupBy(F.col("label").alias("query_id")).agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("embedding"))
    out = RT.flat_search(e.select("vec_id", "embedding"), means, 10)
    return out.select("query_id", "vec_id", near("distance").alias("distance"), near("dense_score").alias("dense_score"), "rank")


@query("prj_cosine_to_mean", """WITH m AS (SELECT label, [""" + ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, 65)) + """] AS q FROM embeddings GROUP BY 1)
SELECT vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)) + 1e-9) + 1e-9, 6) AS similarity FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) JOIN m USING (label)""")
def prj_cosine_to_mean(spark, sf):
    from ..functions.numeric import cosine

    e = table(spark, sf, "embeddings")
    means = e.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)]).alias("q"))
    return e.join(means, "label").select("vec_id", near(cosine(F.col("embedding"), F.col("q"))).alias("similarity"))


TFIDF = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM documents),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
vocab AS (SELECT token, ln((1 + n) / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM w, n GROUP BY token, n ORDER BY count(*) DESC, token LIMIT 768),
dw AS (SELECT doc_id, token, count(*) * max(idf) AS x FROM w JOIN vocab USING (token) GROUP BY 1, 2),
dn AS (SELECT doc_id, token, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM dw),
qw0 AS (SELECT query_id, token, count(*) * max(idf) AS x FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM benchmark) JOIN vocab USING (token) GROUP BY 1, 2),
qn AS (SELECT query_id, token, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS qw FROM qw0),
dots AS (SELECT query_id, doc_id, sum(w * qw) AS dot FROM dn JOIN qn USING (token) GROUP BY 1, 2),
unit AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM dn) AS u FROM documents),
dist AS (SELECT b.item_id AS query_id, unit.doc_id, round(CASE WHEN u AND qu THEN 2 - 2 * coalesce(dot, 0) WHEN u OR qu THEN 1 ELSE 0 END, 9)::DOUBLE AS distance
  FROM (SELECT item_id, item_id IN (SELECT query_id FROM qn) AS qu FROM benchmark) b CROSS JOIN unit LEFT JOIN dots ON dots.query_id = b.item_id AND dots.doc_id = unit.doc_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM dist)"""


@query("topk_tfidf", f"WITH {TFIDF} SELECT query_id, doc_id, round(distance + 1e-9, 5) AS distance, rank FROM dense WHERE rank <= 20")
def topk_tfidf(spark, sf):
    out = RT.tfidf_search(docs(spark, sf), questions(spark, sf), 20)
    return out.select("query_id", "doc_id", near("distance", 5).alias("distance"), "rank")


FUSED = f"""{BM25}, {TFIDF},
sparse AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0),
lists AS (SELECT query_id, doc_id, rank, 0 AS src, 0.6::DOUBLE / (60 + rank) AS s FROM dense WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 1, 0.4::DOUBLE / (60 + rank) FROM sparse WHERE rank <= 20),
fu AS (SELECT query_id, text, round(sum(s), 6) AS hybrid_score, arg_min(lists.doc_id, (src, rank)) AS doc_id FROM lists JOIN documents USING (doc_id) GROUP BY 1, 2),
fused AS (SELECT query_id, doc_id, hybrid_score, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, doc_id) AS rank FROM fu)"""


@query("fus_weighted_rrf", f"WITH {FUSED} SELECT query_id, doc_id, hybrid_score, rank FROM fused WHERE rank <= 20")
def fus_weighted_rrf(spark, sf):
    return RT.hybrid_search(docs(spark, sf), questions(spark, sf), 20)


CROSS = "ln(hybrid_score * 60) * 4"


def _candidates(spark, sf) -> DataFrame:
    """Fused candidates with topic, credibility and a stand-in model score derived from the fused score."""
    found = RT.hybrid_search(docs(spark, sf), questions(spark, sf), 20).drop("rank")
    marked = RT.with_marks(found, pages(spark, sf), T.topic(F.col("text")).alias("topic"),
                           T.credibility(F.col("doc_name"), F.col("source_type")).alias("credibility_score"))
    return marked.withColumn("cross_encoder_score", F.log(F.col("hybrid_score") * 60.0) * 4.0)


META = f"meta AS (SELECT doc_id, {S.topic('text')} AS topic, {CRED} AS credibility_score FROM pages_in)"


@query("rer_reliability_floor", f"""WITH {FUSED}, {PAGES}, {META},
f AS (SELECT query_id, fused.doc_id, round_even(0.85::DOUBLE / (1 + exp(-({CROSS}))) + 0.15::DOUBLE * credibility_score, 4) AS final_score FROM fused JOIN meta USING (doc_id) WHERE rank <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, round(final_score, 4) AS final_score, rank FROM r WHERE rank <= 5 AND (rank = 1 OR final_score >= 0.15)""")
def rer_reliability_floor(spark, sf):
    return RT.rerank(_candidates(spark, sf), 5).select("query_id", "doc_id", "final_score", "rank")


@query("rer_topic_boost", f"""WITH {FUSED}, {PAGES}, {META}, {INTENT.replace(INTENT_TEXT, "text")}
SELECT query_id, fused.doc_id, round(hybrid_score * CASE WHEN (intent = 'health_advice' AND topic IN ('health', 'exercise_outdoor')) OR (intent = 'historical' AND topic = 'historical_data')
  OR (intent = 'comparison' AND topic = 'aqi_methodology') OR (intent = 'policy' AND topic = 'policy') THEN 1.3::DOUBLE ELSE 1 END + 1e-9, 7) AS hybrid_score
FROM fused JOIN meta USING (doc_id) JOIN intents ON intents.item_id = query_id WHERE rank <= 20""")
def rer_topic_boost(spark, sf):
    cfg = questions(spark, sf).select("query_id", T.intent_config(T.intent(F.col("text"))["intent"])["preferred_topics"].alias("pt"))
    out = RT.boost_topics(_candidates(spark, sf).join(cfg, "query_id"), F.col("pt"))
    return out.select("query_id", "doc_id", near("hybrid_score", 7).alias("hybrid_score"))


@query("rer_no_model", f"""WITH {FUSED}, {PAGES}, {META},
r AS (SELECT query_id, fused.doc_id, credibility_score AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY credibility_score DESC, fused.doc_id) AS rank FROM fused JOIN meta USING (doc_id) WHERE rank <= 20)
SELECT query_id, doc_id, final_score, rank FROM r WHERE rank <= 5""")
def rer_no_model(spark, sf):
    """The whole retrieval pipeline without a cross encoder."""
    d = pages(spark, sf).withColumns({"topic": T.topic(F.col("text")), "credibility_score": T.credibility(F.col("doc_name"), F.col("source_type"))})
    return RT.retrieve(d, questions(spark, sf), 5).select("query_id", "doc_id", "final_score", "rank")


@query("win_score_elbow", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT *, (lag(value) OVER (PARTITION BY user_id ORDER BY rn) - value) / (first_value(value) OVER (PARTITION BY user_id ORDER BY rn) + 1e-9) AS gap FROM r),
c AS (SELECT user_id, max(n) AS n, min(rn - 1) FILTER (gap > 0.2 AND rn - 1 >= 2 AND rn <= 10) AS cut FROM g GROUP BY 1)
SELECT user_id, CAST(CASE WHEN n <= 2 THEN n ELSE coalesce(cut, least(n, 10)) END AS INTEGER) AS k FROM c""")
def win_score_elbow(spark, sf):
    return RT.adaptive_k(table(spark, sf, "events"), ["user_id"], "value", [F.col("event_id")], gap=0.2)


# --- Answers --------------------------------------------------------------------------------

def exchanges(spark, sf) -> DataFrame:
    """(case_id, conv_id, question, answer): each assistant turn with the turn before it, and some marks for the
    citation rules that the synthetic texts lack."""
    c = texts(spark, sf, "conversations")
    q = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    a = c.where("role = 'assistant'").join(q, ["conv_id", "turn"])
    marks = F.when(F.col("turn") % 4 == 1, " See [Ref 1] and [Ref 2].").when(
        F.col("conv_id") % 5 == 0, " Maybe 1234, probably 2345, possibly 3456 or 4567.").when(
        F.col("conv_id") % 5 == 1, "\n- item [a](https://b.org/c)\n# Head").otherwise("")
    return a.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), "conv_id", "turn", "question", F.concat("text", marks).alias("answer"))


EXCH = """ex AS (SELECT a.conv_id * 1000 + a.turn AS case_id, a.conv_id, a.turn, q.text AS question,
  a.text || CASE WHEN a.turn % 4 = 1 THEN ' See [Ref 1] and [Ref 2].' WHEN a.conv_id % 5 = 0 THEN ' Maybe 1234, probably 2345, possibly 3456 or 4567.' WHEN a.conv_id % 5 = 1 THEN chr(10) || '- item [a](https://b.org/c)' || chr(10) || '# Head' ELSE '' END AS answer
  FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant')"""
_AW, _QW = S.word_set("answer", S.STOP_EVAL), S.word_set("question", S.STOP_EVAL)


@query("scr_answer_relevancy", f"""WITH {EXCH}, w AS (SELECT case_id, answer, {_QW} AS q, {_AW} AS a FROM ex)
SELECT case_id, round(CASE WHEN len(q) = 0 THEN 0.5 ELSE least(len(list_intersect(q, a)) / len(q)::DOUBLE + least(len({S.words('answer')}) / 100.0::DOUBLE, 0.2), 1) END + 1e-9, 6)::DOUBLE AS relevancy FROM w""")
def scr_answer_relevancy(spark, sf):
    return exchanges(spark, sf).select("case_id", near(SC.answer_relevancy(F.col("answer"), F.col("question"))).alias("relevancy"))


@query("scr_word_f1", f"""WITH {EXCH}, w AS (SELECT case_id, {_QW} AS q, {_AW} AS a FROM ex), h AS (SELECT case_id, len(list_intersect(q, a))::DOUBLE AS h, len(a) AS na, len(q) AS nq FROM w)
SELECT case_id, round(CASE WHEN na = 0 OR nq = 0 OR h = 0 THEN 0 ELSE 2 * (h / na) * (h / nq) / (h / na + h / nq) END + 1e-9, 6)::DOUBLE AS f1 FROM h""")
def scr_word_f1(spark, sf):
    return exchanges(spark, sf).select("case_id", near(SC.answer_correctness(F.col("answer"), F.col("question"))).alias("f1"))


def contexts(spark, sf) -> DataFrame:
    """(conv_id, context_id, text, topic): every document is a context of all cases of the conversation it maps to."""
    n = table(spark, sf, "conversations").agg((F.max("conv_id") + 1).alias("n")).scalar()
    d = docs(spark, sf).withColumn("conv_id", F.col("doc_id") % n).withColumn("topic", T.topic(F.col("text")))
    return d.select("conv_id", F.col("doc_id").alias("context_id"), "text", "topic")


CTX = f"""ctx AS (SELECT case_id, doc_id AS context_id, text, {S.topic('text')} AS topic FROM documents JOIN ex ON ex.conv_id = doc_id % (SELECT max(conv_id) + 1 FROM conversations)),
cw AS (SELECT DISTINCT case_id, unnest({S.tokens('text')}) AS word FROM ctx)"""


def _share_sql(column: str, floor: str, out: str) -> str:
    return f"""WITH {EXCH}, {CTX},
st AS (SELECT case_id, unnest(s) AS s, unnest(range(len(s))) AS i FROM (SELECT case_id, {S.long_sentences(column)} AS s FROM ex)),
wd AS (SELECT case_id, i, {S.word_set('s', S.STOP_EVAL)} AS w FROM st),
hit AS (SELECT u.case_id, u.i, count(*) AS h FROM (SELECT case_id, i, unnest(w) AS word FROM wd) u JOIN cw ON cw.case_id = u.case_id AND cw.word = u.word GROUP BY 1, 2),
sh AS (SELECT wd.case_id, avg(CASE WHEN len(w) = 0 OR coalesce(h, 0) / len(w)::DOUBLE > {floor} THEN 1 ELSE 0 END) AS v FROM wd LEFT JOIN hit ON hit.case_id = wd.case_id AND hit.i = wd.i GROUP BY 1)
SELECT ex.case_id, round(CASE WHEN ex.case_id IN (SELECT case_id FROM ctx) THEN coalesce(v, 0) ELSE 0 END + 1e-9, 6)::DOUBLE AS {out} FROM ex LEFT JOIN sh USING (case_id)"""


@query("scr_faithfulness", _share_sql("answer", "0.4", "faithfulness"))
def scr_faithfulness(spark, sf):
    cases = exchanges(spark, sf).select("case_id", "conv_id", F.col("answer").alias("text"))
    return EV.supported_share(cases, contexts(spark, sf), 0.4, "faithfulness", "conv_id").withColumn("faithfulness", near("faithfulness"))


@query("scr_context_recall", _share_sql("question", "0.35", "context_recall"))
def scr_context_recall(spark, sf):
    cases = exchanges(spark, sf).select("case_id", "conv_id", F.col("question").alias("text"))
    return EV.supported_share(cases, contexts(spark, sf), 0.35, "context_recall", "conv_id").withColumn("context_recall", near("context_recall"))


@query("scr_context_precision", f"""WITH {EXCH}, {CTX},
q AS (SELECT case_id, {_QW} AS q FROM ex),
f AS (SELECT ctx.case_id, len(list_intersect(q, {S.word_set('text')})) / greatest(len(q), 1)::DOUBLE > 0.3 OR topic = 'policy' AS ok FROM ctx JOIN q USING (case_id)),
p AS (SELECT case_id, avg(ok::INTEGER) AS v FROM f GROUP BY 1)
SELECT ex.case_id, round(coalesce(v, 0) + 1e-9, 6)::DOUBLE AS context_precision FROM ex LEFT JOIN p USING (case_id)""")
def scr_context_precision(spark, sf):
    cases = exchanges(spark, sf).withColumn("expected_topics", F.array(F.lit("policy")))
    return EV.context_precision(cases, contexts(spark, sf), "conv_id").withColumn("context_precision", near("context_precision"))


_PARTS = {"faithfulness": "scr_faithfulness", "answer_relevancy": "scr_answer_relevancy", "context_precision": "scr_context_precision",
          "context_recall": "scr_context_recall", "answer_correctness": "scr_word_f1"}


@query("scr_run_evaluation", "WITH " + ", ".join(
    f"{m}_of AS (SELECT round_even(avg(round_even({'f1' if m == 'answer_correctness' else 'relevancy' if m == 'answer_relevancy' else m}, 3)), 3) AS {m} FROM ({ORACLES[q]}))"
    for m, q in _PARTS.items()) + " SELECT *, round_even((" + " + ".join(_PARTS) + ") / 5, 3) AS overall FROM " + ", ".join(f"{m}_of" for m in _PARTS))
def scr_run_evaluation(spark, sf):
    """All five metrics and their means."""
    cases = exchanges(spark, sf).select("case_id", "conv_id", "question", "answer", F.col("question").alias("reference_answer"),
                                        F.array(F.lit("policy")).alias("expected_topics"))
    return EV.aggregate_metrics(EV.evaluate(cases, contexts(spark, sf), "conv_id"))


def _scored(spark, sf) -> DataFrame:
    """Exchanges with up to four chunks each, scores derived from the position."""
    n = (F.col("conv_id") % 5).cast("int")
    chunk = lambda i: F.struct(
        (0.9 - 0.2 * i).alias("final_score"), F.lit(None).cast("double").alias("rerank_score"),
        F.when(i == 1, F.lit(None)).otherwise(0.95 - 0.1 * i).cast("double").alias("credibility_score"))
    chunks = F.slice(F.transform(F.sequence(F.lit(0), F.lit(3)), chunk), F.lit(1), n)
    return exchanges(spark, sf).withColumns({"chunks": chunks, "n_chunks": n})


_REF, _LINK = S.count_matches("answer", r"\[Ref\s*\d+\]"), S.count_matches("answer", r"\[.*?\]\(https?://.*?\)")
_AR, _QR = (f"list_filter(list_distinct({S.words('lower(' + c + ')')}), lambda w: NOT list_contains({S.STOP_REL}, w))" for c in ("answer", "question"))
CONF = rf"""{EXCH},
b AS (SELECT case_id, answer, question, (conv_id % 5)::INTEGER AS n, {_REF} + {_LINK} AS cites, {_AR} AS a, {_QR} AS q, len({S.words('answer')}) AS words FROM ex),
sq AS (SELECT 0 AS n, 0.2::DOUBLE AS source UNION ALL SELECT m, least(sum(s * pow(0.9::DOUBLE, i)) / (sum(pow(0.9::DOUBLE, i)) + 1e-9), 1) FROM (SELECT unnest(range(1, 5)) AS m),
   (SELECT i, 0.7::DOUBLE * (0.9::DOUBLE - 0.2::DOUBLE * i) + 0.3::DOUBLE * CASE WHEN i = 1 THEN 0.75::DOUBLE ELSE 0.95::DOUBLE - 0.1::DOUBLE * i END AS s FROM (SELECT unnest(range(0, 4)) AS i)) WHERE i < m GROUP BY 1),
p AS (SELECT case_id, answer, b.n, source, CASE WHEN b.n = 0 THEN 0.5::DOUBLE WHEN cites > 0 THEN greatest(least(cites / b.n::DOUBLE, 1), 0.4) ELSE 0 END AS citation,
   CASE WHEN len(q) = 0 THEN 0.5::DOUBLE ELSE least(len(list_intersect(q, a)) / len(q)::DOUBLE + CASE WHEN length(answer) > 200 THEN 0.1::DOUBLE ELSE 0 END, 1) END AS relevance,
   least(0.3::DOUBLE + CASE WHEN words > 50 AND words < 800 THEN 0.2::DOUBLE WHEN words >= 800 THEN 0.15::DOUBLE WHEN words > 20 THEN 0.1::DOUBLE ELSE 0 END
     + CASE WHEN regexp_matches(answer, '(?m)^\s*[-*•]') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(answer, '(?m)^#+\s') THEN 0.1::DOUBLE ELSE 0 END
     + CASE WHEN regexp_matches(answer, '\b\d+\.?\d*\b') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN {_LINK} > 0 THEN 0.1::DOUBLE ELSE 0 END, 1) AS quality FROM b JOIN sq ON sq.n = b.n)"""


_INTENTS = list(K.CONFIDENCE_WEIGHTS)
_W = [f"(CASE conv_id % 7 {' '.join(f'WHEN {i} THEN {K.CONFIDENCE_WEIGHTS[n][j]}' for i, n in enumerate(_INTENTS))} END)::DOUBLE" for j in range(4)]
GRADED = f"""{CONF},
c AS (SELECT p.*, {_W[0]} * source + {_W[1]} * citation + {_W[2]} * relevance + {_W[3]} * quality AS raw FROM p JOIN ex USING (case_id)),
g AS (SELECT *, round_even(least(greatest(raw, 0), 1), 3) AS score, CASE WHEN raw >= 0.7 THEN 'high' WHEN raw >= 0.4 THEN 'medium' ELSE 'low' END AS grade FROM c)"""


def _combined(spark, sf) -> DataFrame:
    """Answers with their parts and the confidence under each of the seven intents in turn."""
    s = _scored(spark, sf).withColumns(SC.confidence_parts(F.col("answer"), F.col("question"), F.col("chunks")))
    names = ["source_quality", "citation_coverage", "relevance", "response_quality"]
    intent = F.array(*[F.lit(n) for n in _INTENTS])[(F.col("conv_id") % 7).cast("int")]
    return s.withColumn("c", SC.combine_confidence(*[F.col(x) for x in names], F.col("n_chunks"), intent))


@query("scr_confidence_composite", f"""WITH {GRADED}
SELECT case_id, round(source + 1e-9, 5) AS source_quality, round(citation + 1e-9, 5)::DOUBLE AS citation_coverage, round(relevance + 1e-9, 5) AS relevance, round(quality + 1e-9, 5) AS response_quality,
  round(score + 1e-9, 5) AS score, grade FROM g""")
def scr_confidence_composite(spark, sf):
    return _combined(spark, sf).select(
        "case_id", *[near(x, 5).alias(x) for x in ("source_quality", "citation_coverage", "relevance", "response_quality")],
        near(F.col("c.score"), 5).alias("score"), "c.grade")


@query("scr_confidence_badges", f"""WITH {GRADED}
SELECT case_id, CASE grade WHEN 'high' THEN '[HIGH]' WHEN 'medium' THEN '[MED]' ELSE '[LOW]' END || ' Confidence: ' || CAST(trunc(score * 100) AS INTEGER) || '% (' || grade || ')' AS badge, coalesce(nullif(concat_ws('; ',
  CASE WHEN source > 0.7 THEN 'Strong source material available' WHEN source < 0.3 THEN 'Limited source material' END,
  CASE WHEN citation > 0.6 THEN 'Well-cited response' WHEN citation < 0.2 AND n > 0 THEN 'Response lacks source citations' END,
  CASE WHEN relevance > 0.6 THEN 'Directly addresses the query' WHEN relevance < 0.3 THEN 'Response may not fully address the query' END), ''), 'Standard confidence') AS explanation FROM g""")
def scr_confidence_badges(spark, sf):
    return _combined(spark, sf).select("case_id", SC.confidence_badge(F.col("c.score"), F.col("c.grade")).alias("badge"), "c.explanation")


@query("scr_risk_rules", rf"""WITH {EXCH},
b AS (SELECT case_id, conv_id % 5 AS n, {_REF} AS cites, {_LINK} > 0 AS linked, {S.count_matches('lower(answer)', K.HEDGING)} AS hedges, {S.count_matches('answer', K.NUMERIC_CLAIM)} AS claims FROM ex),
r1 AS (SELECT *, CASE WHEN n > 0 AND cites = 0 THEN 'medium' ELSE 'low' END AS a FROM b),
r2 AS (SELECT *, CASE WHEN claims > 3 AND cites = 0 AND NOT linked THEN CASE WHEN a = 'medium' THEN 'high' ELSE 'medium' END ELSE a END AS b FROM r1),
r3 AS (SELECT *, CASE WHEN hedges > 2 AND b = 'low' THEN 'medium' ELSE b END AS c FROM r2),
r4 AS (SELECT *, CASE WHEN n >= 3 AND cites = 0 AND NOT linked THEN 'high' ELSE c END AS risk FROM r3)
SELECT case_id, cites AS citation_count, linked AS has_links, risk, risk = 'high' AND n > 0 AS should_regenerate,
  CAST((n > 0 AND cites = 0)::INTEGER + (claims > 3 AND cites = 0 AND NOT linked)::INTEGER + (hedges > 2)::INTEGER + (n >= 3 AND cites = 0 AND NOT linked)::INTEGER AS INTEGER) AS reasons FROM r4""")
def scr_risk_rules(spark, sf):
    r = _scored(spark, sf).select("case_id", SC.answer_risk(F.col("answer"), F.col("n_chunks")).alias("r"))
    return r.select("case_id", F.col("r.citation_count").cast("bigint").alias("citation_count"), "r.has_links", F.col("r.hallucination_risk").alias("risk"),
                    "r.should_regenerate", F.size("r.reasons").alias("reasons"))


@query("agg_geometric_decay", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS i FROM events)
SELECT user_id, round(sum(value * pow(0.9::DOUBLE, i)) / (sum(pow(0.9::DOUBLE, i)) + 1e-9) + 1e-9, 6) AS decayed FROM r GROUP BY 1""")
def agg_geometric_decay(spark, sf):
    """Decayed mean of all values of a user, highest first."""
    from ..operators.readings import decayed_by_key

    events = table(spark, sf, "events").select("user_id", "event_id", "value")
    return decayed_by_key(events, ["user_id"], "value", ["event_id"]).select("user_id", near("decayed").alias("decayed"))


@query("agg_eval_means", "WITH m AS (SELECT " + ", ".join(
    f"round_even(avg((event_id * {p}) % 1000 / 1000.0::DOUBLE), 3) AS {m}" for m, p in zip(EV.METRICS, (7, 11, 13, 17, 19))) + f""" FROM events)
SELECT *, round_even(({" + ".join(EV.METRICS)}) / 5, 3) AS overall FROM m""")
def agg_eval_means(spark, sf):
    """Means of five metrics per case, one case per event."""
    cases = table(spark, sf, "events").select(*[
        ((F.col("event_id") * p) % 1000 / F.lit(1000.0)).alias(m) for m, p in zip(EV.METRICS, (7, 11, 13, 17, 19))])
    return EV.aggregate_metrics(cases)


@query("join_left_semi_labels", "SELECT lang, count(*) AS docs FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1")
def join_left_semi_labels(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").join(good, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query("txt_prompt_assembly", f"""WITH {EXCH}
SELECT case_id, md5(array_to_string(['**My question:** ' || question, chr(10) || '*[Query intent: factual (conf=' || (50 + conv_id % 50) || '%)]*',
  {_quoted(PR.LIVE_HEADER)}, '  • AQI: ' || conv_id, '  • pm25: 12.5', {_quoted(PR.SOURCES_HEADER)},
  chr(10) || '[Ref 1] (notes | topic=general | relevance=0.50):' || chr(10) || substr(answer, 1, 1200),
  chr(10) || '[Ref 2] (unknown):' || chr(10) || substr(question, 1, 1200), {_quoted(PR.GUIDANCE)}], chr(10))) AS prompt_md5 FROM ex""")
def txt_prompt_assembly(spark, sf):
    """The whole prompt: question, intent, live values, two excerpts (one without name, topic and score), guidance."""
    ex = exchanges(spark, sf)
    kind = "struct<doc_name:string,topic:string,final_score:double,rerank_score:double,text:string>"
    none = F.lit(None)
    chunks = F.array(
        F.struct(F.lit("notes"), F.lit("general"), F.lit(0.5), none, F.col("answer")).cast(kind),
        F.struct(none, none, none, none, F.col("question")).cast(kind))
    p = PR.build_prompt(
        F.col("question"), chunks, F.create_map(F.lit("pm25"), F.lit("12.5"), F.lit("AQI"), F.col("conv_id").cast("string")),
        F.lit("factual"), (F.lit(50) + F.col("conv_id") % 50) / 100.0)
    return ex.select("case_id", F.md5(p).alias("prompt_md5"))


# --- Conversations --------------------------------------------------------------------------

_MEM = f"""m AS (SELECT *, {S.token_estimate('text')} AS tok FROM conversations),
f AS (SELECT conv_id, arg_min(role, turn) = 'system' AS has_system, min(turn) AS t0 FROM m GROUP BY 1),
ch AS (SELECT m.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, sum(tok) OVER (PARTITION BY conv_id) AS total FROM m JOIN f USING (conv_id) WHERE NOT (has_system AND turn = t0)),
cs AS (SELECT *, total <= 150 AND n <= 4 AS short, n - least(n, 2) AS n_old FROM ch),
ol AS (SELECT conv_id, pos, n_old, CASE WHEN role = 'user' THEN 'User asked: ' || substr(text, 1, 100) ELSE 'Assistant discussed: ' || substr(text, 1, 80) END AS line FROM cs WHERE NOT short AND pos < n_old),
sm AS (SELECT conv_id, max(n_old) AS n_old, list(line ORDER BY pos) AS l FROM ol GROUP BY 1)"""


@query("mem_compact_history", f"""WITH {_MEM}
SELECT conv_id, pos AS position, role, text FROM cs WHERE short OR pos >= n_old
UNION ALL SELECT m.conv_id, -1, m.role, m.text FROM m JOIN f USING (conv_id) WHERE has_system AND turn = t0
UNION ALL SELECT conv_id, 0, 'system', '[Conversation Summary — ' || n_old || ' earlier messages]' || chr(10) || array_to_string(CASE WHEN n_old > 6 THEN l[1:3] || ['...'] || l[n_old - 1 : n_old] ELSE l END, ' | ') FROM sm""")
def mem_compact_history(spark, sf):
    """Compaction at 150 tokens or more than four messages, keeping two."""
    return M.compact(texts(spark, sf, "conversations"), 150, 2)


@query("agg_message_tokens", f"SELECT conv_id, sum({S.token_estimate('text')})::BIGINT AS tokens FROM conversations GROUP BY 1")
def agg_message_tokens(spark, sf):
    return M.message_tokens(table(spark, sf, "conversations"))


@query("topk_recent_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def topk_recent_messages(spark, sf):
    from ..operators.readings import last_n

    return last_n(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], 3, "turn").drop("_rn")
