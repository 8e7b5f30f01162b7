"""Answer evaluation against contexts of any number, in long form.

A case with very many contexts is a set of rows, not one array: of each context, the words that the case asks for.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions import scoring as S, text as T
from ..session import cut_lineage

METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness"]


def context_sets(contexts: DataFrame, by: str = "case_id") -> DataFrame:
    """(``by``, words, topic) per context: its distinct words, taken once however many cases share the context."""
    topic = "topic" if "topic" in contexts.columns else F.lit(None).cast("string").alias("topic")
    return contexts.select(by, F.array_distinct(T.tokens(F.col("text"))).alias("words"), topic)


def supported_share(texts: DataFrame, contexts: DataFrame, floor: float, out: str, by: str = "case_id") -> DataFrame:
    """Share of sentences of ``texts.text`` whose words occur in the contexts of the case by more than ``floor``.

    A case without contexts or sentences scores 0; a sentence of stop words only counts as supported. ``by`` is the column
    of both sides that tells which contexts a case has; several cases may share theirs.
    """
    return _supported_share(texts, context_sets(contexts, by), floor, out, by)


def _supported_share(texts: DataFrame, sets: DataFrame, floor: float, out: str, by: str) -> DataFrame:
    """Of a context only the words that the case asks for become rows."""
    sentences = F.transform(T.long_sentences(F.col("text")), lambda s: T.word_set(s, K.EVAL_STOP))
    cases = texts.select(*dict.fromkeys(["case_id", by]), sentences.alias("_sentences"))
    parts = cases.select("case_id", F.posexplode_outer("_sentences").alias("i", "w")).where("w IS NOT NULL")
    # Rows of one case_id (mostly one) are one case, with the words and the contexts of all of them.
    wanted = cases.groupBy(F.col("case_id").alias("_case")).agg(
        F.collect_set(by).alias("_bys"), F.array_distinct(F.flatten(F.flatten(F.collect_list("_sentences")))).alias("_wanted")).select(
        "_case", F.explode("_bys").alias("_by"), "_wanted")
    met = sets.select(F.col(by).alias("_by"), "words").join(wanted, "_by").select(
        F.col("_case").alias("case_id"), F.explode_outer(F.array_intersect("words", "_wanted")).alias("word"))
    found = (
        parts.select("case_id", "i", F.explode_outer("w").alias("word")).where("word IS NOT NULL")
        .join(met.where("word IS NOT NULL").distinct(), ["case_id", "word"], "left_semi")
        .groupBy("case_id", "i").agg(F.count(F.lit(1)).alias("hits"))
    )
    sized = parts.select("case_id", "i", F.size("w").alias("n")).join(found, ["case_id", "i"], "left")
    ok = (F.col("n") == 0) | (F.coalesce("hits", F.lit(0)) / F.col("n") > floor)
    share = sized.groupBy("case_id").agg(F.avg(ok.cast("double")).alias(out))
    has_context = texts.select(*dict.fromkeys(["case_id", by])).join(sets.select(by).distinct(), by, "left_semi").select("case_id").distinct()
    return has_context.join(share, "case_id").join(texts.select("case_id"), "case_id", "right").select("case_id", out).na.fill(0.0, [out])


def context_precision(cases: DataFrame, contexts: DataFrame, by: str = "case_id") -> DataFrame:
    """Share of contexts that share over 30 % of the question words or have an expected topic."""
    return _context_precision(cases, context_sets(contexts, by), by)


def _context_precision(cases: DataFrame, sets: DataFrame, by: str) -> DataFrame:
    asked = F.struct("expected_topics", T.word_set(F.col("question"), K.EVAL_STOP).alias("q")).alias("asked")
    q = cases.select("case_id", F.col(by).alias("_by"), asked).groupBy(F.col("case_id").alias("_case")).agg(
        F.collect_list("_by").alias("_bys"), F.collect_list("asked").alias("_asked")).select("_case", F.explode("_bys").alias("_by"), "_asked")
    pairs = sets.withColumnRenamed(by, "_by").join(q, "_by").select(
        F.col("_case").alias("case_id"), "words", "topic", F.explode("_asked").alias("asked")).select("case_id", "words", "topic", "asked.*").select(
        "case_id",
        (T.overlap(F.col("q"), F.col("words")) / F.greatest(F.size("q"), F.lit(1))).alias("share"),
        F.coalesce(F.array_contains("expected_topics", F.col("topic")), F.lit(False)).alias("on_topic"))
    ok = (F.col("share") > 0.3) | F.col("on_topic")
    share = pairs.groupBy("case_id").agg(F.avg(ok.cast("double")).alias("context_precision"))
    return cases.select("case_id").join(share, "case_id", "left").na.fill(0.0, ["context_precision"])


def evaluate(cases: DataFrame, contexts: DataFrame, by: str = "case_id") -> DataFrame:
    """Five metrics per case. ``cases``: (case_id, question, answer, reference_answer, expected_topics). Three of them read the
    words of the contexts, which are written once."""
    keys = list(dict.fromkeys(["case_id", by]))
    answers = cases.select(*keys, F.col("answer").alias("text"))
    references = cases.select(*keys, F.col("reference_answer").alias("text"))
    sets = cut_lineage(context_sets(contexts, by))
    out = cases.select(
        "case_id",
        S.answer_relevancy(F.col("answer"), F.col("question")).alias("answer_relevancy"),
        S.answer_correctness(F.col("answer"), F.col("reference_answer")).alias("answer_correctness"))
    for part in (_supported_share(answers, sets, 0.4, "faithfulness", by), _context_precision(cases, sets, by),
                 _supported_share(references, sets, 0.35, "context_recall", by)):
        out = out.join(part, "case_id")
    return out.select("case_id", *[F.bround(m, 3).alias(m) for m in METRICS])


def aggregate_metrics(per_case: DataFrame) -> DataFrame:
    """Mean of each metric, rounded, and the mean of those means."""
    means = per_case.agg(*[F.bround(F.avg(m), 3).alias(m) for m in METRICS])
    total = sum((F.col(m) for m in METRICS[1:]), F.col(METRICS[0]))
    return means.withColumn("overall", F.bround(total / len(METRICS), 3))
