"""Answer scoring on columns of one row (the answer, its question, its retrieved chunks).

``chunks`` is an array column of at most top-k retrieved chunks, so its size is bounded by the query configuration.
Scoring against contexts of any number is relational and lives in ``operators.evaluation``.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from . import text as T
from .numeric import let


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def answer_relevancy(answer: Column, question: Column) -> Column:
    def score(q):
        share = T.overlap(q, T.word_set(answer, K.EVAL_STOP)) / F.size(q)
        bonus = F.least(T.word_count(answer) / 100.0, F.lit(0.2))
        return F.when(F.size(q) == 0, 0.5).otherwise(F.least(share + bonus, F.lit(1.0)))

    return F.when((answer == "") | (question == ""), 0.0).otherwise(let(T.word_set(question, K.EVAL_STOP), score))


def answer_correctness(answer: Column, reference: Column) -> Column:
    """F1 of the two word sets."""
    def f1(s):
        hits, n_a, n_r = T.overlap(s["a"], s["r"]), F.size(s["a"]), F.size(s["r"])
        precision, recall = hits / n_a, hits / n_r
        return F.when((n_a == 0) | (n_r == 0) | (hits == 0), 0.0).otherwise(
            2.0 * precision * recall / (precision + recall))

    sets = F.struct(T.word_set(answer, K.EVAL_STOP).alias("a"), T.word_set(reference, K.EVAL_STOP).alias("r"))
    return let(sets, f1)


def _supported_share(text: Column, context_words: Column, floor: float) -> Column:
    def share(s):
        def supported(words):
            return (F.size(words) == 0) | (T.overlap(words, s["context"]) / F.size(words) > floor)

        n = F.size(s["parts"])
        return F.when(n == 0, 0.0).otherwise(F.size(F.filter(s["parts"], supported)) / n)

    parts = F.transform(T.long_sentences(text), lambda sentence: T.word_set(sentence, K.EVAL_STOP))
    return let(F.struct(parts.alias("parts"), context_words.alias("context")), share)


def faithfulness(answer: Column, chunk_texts: Column) -> Column:
    words = T.word_set(F.array_join(chunk_texts, " "))
    return F.when(F.size(chunk_texts) == 0, 0.0).otherwise(_supported_share(answer, words, 0.4))


def context_recall(reference: Column, chunk_texts: Column) -> Column:
    words = T.word_set(F.array_join(chunk_texts, " "))
    return F.when(F.size(chunk_texts) == 0, 0.0).otherwise(_supported_share(reference, words, 0.35))


def context_precision(question: Column, chunks: Column, expected_topics: Column) -> Column:
    """``chunks``: ARRAY<STRUCT<text, topic>>."""
    def count(q):
        def relevant(c):
            share = T.overlap(q, T.word_set(c["text"])) / F.greatest(F.size(q), F.lit(1))
            return (share > 0.3) | F.coalesce(F.array_contains(expected_topics, c["topic"]), F.lit(False))

        return F.size(F.filter(chunks, relevant))

    n = F.size(chunks)
    return F.when(n == 0, 0.0).otherwise(let(T.word_set(question, K.EVAL_STOP), count) / n)


def decayed_mean(scores: Column, ratio: float = 0.9) -> Column:
    """Mean of the scores in falling order with weights ratio^0, ratio^1, ..."""
    ordered = F.sort_array(scores, asc=False)
    weights = F.transform(ordered, lambda _, i: F.pow(F.lit(ratio), i))
    top = F.aggregate(F.zip_with(ordered, weights, lambda s, w: s * w), F.lit(0.0), lambda a, v: a + v)
    return top / (F.aggregate(weights, F.lit(0.0), lambda a, v: a + v) + 1e-9)


def source_quality(chunks: Column) -> Column:
    """``chunks``: ARRAY<STRUCT<final_score, rerank_score, credibility_score, ...>>."""
    scores = F.transform(
        chunks,
        lambda c: 0.7 * F.coalesce(c["final_score"], c["rerank_score"], F.lit(0.0))
        + 0.3 * F.coalesce(c["credibility_score"], F.lit(K.CREDIBILITY_MISSING)),
    )
    return F.when(F.size(chunks) == 0, 0.2).otherwise(F.least(decayed_mean(scores), F.lit(1.0)))


def citation_coverage(response: Column, n_chunks: Column) -> Column:
    cites = _count(response, K.CITATION) + _count(response, K.LINK)
    share = F.least(cites / F.greatest(n_chunks, F.lit(1)), F.lit(1.0))
    return F.when(n_chunks == 0, 0.5).otherwise(F.when(cites > 0, F.greatest(share, F.lit(0.4))).otherwise(share))


def response_relevance(response: Column, query: Column) -> Column:
    def score(q):
        share = T.overlap(q, T.space_word_set(response, K.RELEVANCE_STOP)) / F.size(q)
        boosted = share + F.when(F.length(response) > 200, 0.1).otherwise(0.0)
        return F.when(F.size(q) == 0, 0.5).otherwise(F.least(boosted, F.lit(1.0)))

    return F.when((response == "") | (query == ""), 0.3).otherwise(
        let(T.space_word_set(query, K.RELEVANCE_STOP), score))


def response_quality(response: Column) -> Column:
    length = let(T.word_count(response), lambda words: (
        F.when((words > 50) & (words < 800), 0.2).when(words >= 800, 0.15).when(words > 20, 0.1).otherwise(0.0)))
    score = F.lit(0.3) + length
    for pattern in (K.BULLET_LINE, K.HEADING_LINE, K.ANY_NUMBER, K.LINK):
        score = score + F.when(response.rlike(pattern), 0.1).otherwise(0.0)
    return F.when(response == "", 0.0).otherwise(F.least(score, F.lit(1.0)))


def _weights(intent_name: Column) -> Column:
    rows = {k: F.array(*[F.lit(x) for x in v]) for k, v in K.CONFIDENCE_WEIGHTS.items()}
    chain = None
    for name, value in rows.items():
        if name != "general":
            chain = F.when(intent_name == name, value) if chain is None else chain.when(intent_name == name, value)
    return chain.otherwise(rows["general"])


def grade_of(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def confidence_parts(response: Column, query: Column, chunks: Column) -> dict[str, Column]:
    return {
        "source_quality": source_quality(chunks),
        "citation_coverage": citation_coverage(response, F.size(chunks)),
        "relevance": response_relevance(response, query),
        "response_quality": response_quality(response),
    }


def combine_confidence(source: Column, citation: Column, relevance: Column, quality: Column, n_chunks: Column,
                       intent_name: Column) -> Column:
    """STRUCT<score, grade, source_quality, citation_coverage, relevance, response_quality, explanation>.

    Takes the parts as columns so that a plan can compute each once in a projection below.
    """
    w = _weights(intent_name)
    raw = w[0] * source + w[1] * citation + w[2] * relevance + w[3] * quality
    score = F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))
    notes = F.concat_ws(
        "; ",
        F.when(source > 0.7, "Strong source material available").when(source < 0.3, "Limited source material"),
        F.when(citation > 0.6, "Well-cited response").when(
            (citation < 0.2) & (n_chunks > 0), "Response lacks source citations"),
        F.when(relevance > 0.6, "Directly addresses the query").when(
            relevance < 0.3, "Response may not fully address the query"),
    )
    return F.struct(
        F.bround(score, 3).alias("score"),
        grade_of(score).alias("grade"),
        F.bround(source, 3).alias("source_quality"),
        F.bround(citation, 3).alias("citation_coverage"),
        F.bround(relevance, 3).alias("relevance"),
        F.bround(quality, 3).alias("response_quality"),
        F.when(notes == "", "Standard confidence").otherwise(notes).alias("explanation"),
    )


def confidence_badge(score: Column, grade: Column) -> Column:
    tag = F.when(grade == "high", "[HIGH]").when(grade == "medium", "[MED]").otherwise("[LOW]")
    percent = (score * 100).cast("int").cast("string")
    return F.concat(tag, F.lit(" Confidence: "), percent, F.lit("% ("), grade, F.lit(")"))


def answer_risk(response: Column, n_chunks: Column) -> Column:
    """STRUCT of the citation check. The rules apply in order; each may raise the level reached so far."""
    cites = _count(response, K.CITATION)
    cited = cites > 0
    linked = response.rlike(K.LINK)
    hedges = _count(F.lower(response), K.HEDGING)
    claims = _count(response, K.NUMERIC_CLAIM)
    has_rag = n_chunks > 0
    uncited = has_rag & ~cited
    unsourced = (claims > 3) & ~cited & ~linked
    ignored = has_rag & (n_chunks >= 3) & ~cited & ~linked
    level = (
        F.when(ignored | (uncited & unsourced), "high")
        .when(uncited | unsourced | (hedges > 2), "medium")
        .otherwise("low")
    )
    reasons = F.array_compact(F.array(
        F.when(uncited, "RAG context provided but no [Ref N] citations in response"),
        F.when(unsourced, F.concat(F.lit("Contains "), claims.cast("string"),
                                   F.lit(" numeric claims without source attribution"))),
        F.when(hedges > 2, F.concat(F.lit("High hedging language ("), hedges.cast("string"), F.lit(" instances)"))),
        F.when(ignored, "Multiple relevant sources available but none cited"),
    ))
    return F.struct(
        cited.alias("has_citations"), cites.alias("citation_count"), linked.alias("has_links"),
        has_rag.alias("expected_citations"), level.alias("hallucination_risk"),
        ((level == "high") & has_rag).alias("should_regenerate"), reasons.alias("reasons"),
    )
