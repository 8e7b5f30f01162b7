"""Text expressions: splitting, counting, classifying."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .. import constants as K
from .numeric import let

SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_count(c: Column) -> Column:
    return let(strip(c), lambda s: F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, SPACE))))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), (word_count(c) * F.lit(1.3)).cast("int"))


def sentences(c: Column) -> Column:
    """Sentences of a page: break after ``.!?`` and at blank lines."""
    parts = F.split(F.replace(c, F.lit("\r"), F.lit("")), r"(?U)(?<=[.!?])\s+|\n{2,}")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def long_sentences(c: Column) -> Column:
    """Sentences of an answer, those of more than ten characters."""
    parts = F.split(c, r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 10)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(K.WORD), F.lit(0))


def word_set(c: Column, stop: list[str] | None = None) -> Column:
    words = F.array_distinct(tokens(c))
    return F.array_except(words, F.lit(stop)) if stop else words


def space_word_set(c: Column, stop: list[str] | None = None) -> Column:
    s = strip(F.lower(c))
    words = F.array_distinct(F.filter(F.split(s, SPACE), lambda w: w != ""))
    return F.array_except(words, F.lit(stop)) if stop else words


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def cache_key(c: Column) -> Column:
    return F.substring(F.sha2(F.lower(strip(c)), 256), 1, 24)


def first_best(names: list[str], scores: Column) -> Column:
    """Name of the highest score; the earlier name wins a tie."""
    return F.element_at(F.lit(names), F.array_position(scores, F.array_max(scores)).cast("int"))


def topic_scores(c: Column) -> Column:
    return let(F.lower(c), lambda low: F.array(*[F.regexp_count(low, F.lit(p)) for _, p in K.TOPICS]))


def topic(c: Column) -> Column:
    """First topic with the highest of ``topic_scores``. Arrow counts the matches, an automaton's step per character; the
    regular expressions of the JVM try every word at every character."""
    names = [n for n, _ in K.TOPICS] + ["general"]
    # A dot leaves out the line ends of the JVM.
    patterns = [p.replace(".", "[^\n\r\u0085\u2028\u2029]") for _, p in K.TOPICS]

    def best(low: pa.Array) -> pa.Array:
        counts = np.stack([pc.fill_null(pc.count_substring_regex(low, pattern=p), 0).to_numpy(zero_copy_only=False) for p in patterns])
        at = np.where(counts.any(axis=0), counts.argmax(axis=0), len(patterns))
        return pa.array(names).take(pa.array(at, mask=low.is_null().to_numpy(zero_copy_only=False)))

    return F.arrow_udf(best, "string")(F.lower(c))


def year(c: Column) -> Column:
    """Most frequent year 1980-2029, the first seen on a tie."""
    def mode(found):
        counts = F.transform(F.array_distinct(found), lambda y: F.size(F.filter(found, lambda z: z == y)))
        best = let(counts, lambda n: F.array_position(n, F.array_max(n)).cast("int"))
        return F.when(F.size(found) > 0, F.element_at(F.array_distinct(found), best).cast("int"))

    return let(F.regexp_extract_all(c, F.lit("(?U)" + K.YEAR_PATTERN), F.lit(1)), mode)


def credibility(doc_name: Column, source_type: Column) -> Column:
    name = F.lower(F.coalesce(doc_name, F.lit("")))
    out = None
    for words, score in K.CREDIBILITY:
        hit = name.rlike("|".join(words))
        out = F.when(hit, score) if out is None else out.when(hit, score)
    words, score = K.CREDIBILITY_DATA
    return (
        out.when(source_type == "pdf", K.CREDIBILITY_PDF)
        .when(name.rlike("|".join(words)), score)
        .otherwise(K.CREDIBILITY_DEFAULT)
    )


def intent_scores(question: Column) -> Column:
    return let(strip(F.lower(question)), lambda q: F.array(*[
        F.lit(1.5) * sum((F.regexp_count(q, F.lit(p)) for p in patterns[1:]), F.regexp_count(q, F.lit(patterns[0])))
        for _, patterns in K.INTENTS
    ]))


def intent(question: Column) -> Column:
    """STRUCT<intent, confidence, scores>."""
    def pick(scores):
        total = F.aggregate(scores, F.lit(0.0), lambda a, v: a + v)
        best = F.array_max(scores)
        confidence = F.least(best / (total + 1e-9), F.lit(1.0))
        weak = (total == 0) | (confidence < 0.2) | (best < 1.0)
        return F.struct(
            F.when(weak, "general").otherwise(first_best([n for n, _ in K.INTENTS], scores)).alias("intent"),
            F.when(weak, F.lit(0.3)).otherwise(F.bround(confidence, 3)).alias("confidence"),
            scores.alias("scores"),
        )

    return let(intent_scores(question), pick)


def intent_config(intent_name: Column) -> Column:
    """STRUCT<needs_api, needs_rag, top_k, preferred_topics, description> of an intent; unknown means general."""
    def row(cfg):
        api, rag, k, topics, text = cfg
        return F.struct(
            F.lit(api).alias("needs_api"), F.lit(rag).alias("needs_rag"), F.lit(k).alias("top_k"),
            F.array(*[F.lit(t) for t in topics]).cast("array<string>").alias("preferred_topics"),
            F.lit(text).alias("description"),
        )

    chain = None
    for name, cfg in K.INTENT_CONFIG.items():
        if name == "general":
            continue
        chain = F.when(intent_name == name, row(cfg)) if chain is None else chain.when(intent_name == name, row(cfg))
    return chain.otherwise(row(K.INTENT_CONFIG["general"]))


def needs_live_api(question: Column) -> Column:
    return intent_config(intent(question)["intent"])["needs_api"]


def needs_rag(question: Column) -> Column:
    return intent_config(intent(question)["intent"])["needs_rag"]


def latin1(c: Column) -> Column:
    """Spell out the listed characters; anything else outside Latin-1 becomes '?'."""
    out = c
    for char, text in K.LATIN1_SUBSTITUTES.items():
        out = F.replace(out, F.lit(char), F.lit(text))
    return F.regexp_replace(out, r"[^\x{0}-\x{FF}]", "?")
