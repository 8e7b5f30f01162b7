"""Sentence chunking: greedy packing with an overlap, as one fold over the sentences of a page."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.numeric import cosine, let


def runs(counts: Column, breaks: Column | None, max_tokens: int, overlap: int) -> Column:
    """ARRAY<STRUCT<s, e>>: half-open sentence ranges."""
    if breaks is None:
        return let(counts, lambda t: _runs(t, None, max_tokens, overlap))
    both = F.struct(counts.alias("t"), breaks.alias("b"))
    return let(both, lambda x: _runs(x["t"], x["b"], max_tokens, overlap))


def _runs(token_counts: Column, breaks: Column | None, max_tokens: int, overlap: int) -> Column:
    """The fold of ``runs`` over bound arrays.

    A chunk is always a run of consecutive sentences, since the overlap is the tail of the chunk before; so the fold
    carries two indices and a token sum instead of texts.
    """
    n = F.size(token_counts)
    start = F.struct(
        F.array().cast("array<struct<s:int,e:int>>").alias("done"), F.lit(0).alias("s"), F.lit(0).alias("tok"))

    def tail(s, e):
        """Longest tail of sentences [s, e) within the overlap budget: STRUCT<n, tok, open>."""
        backwards = F.reverse(F.slice(token_counts, s + 1, e - s))
        return F.aggregate(
            backwards,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("tok"), F.lit(True).alias("open")),
            lambda a, t: F.when(
                a["open"] & (a["tok"] + t <= overlap),
                F.struct((a["n"] + 1).alias("n"), (a["tok"] + t).alias("tok"), F.lit(True).alias("open")),
            ).otherwise(F.struct(a["n"].alias("n"), a["tok"].alias("tok"), F.lit(False).alias("open"))))

    def step(acc, i):
        t = F.element_at(token_counts, i + 1)
        full = acc["tok"] + t > max_tokens
        if breaks is not None:
            full = full | F.coalesce(F.element_at(breaks, i + 1), F.lit(False))

        def cut():
            return let(tail(acc["s"], i), lambda kept: F.struct(
                F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), i.alias("e")))).alias("done"),
                (i - kept["n"]).alias("s"), (kept["tok"] + t).alias("tok")))

        grow = F.struct(acc["done"].alias("done"), acc["s"].alias("s"), (acc["tok"] + t).alias("tok"))
        return F.when((i > acc["s"]) & full, cut()).otherwise(grow)

    return F.aggregate(
        F.sequence(F.lit(0), n - 1), start, step,
        lambda a: F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), n.alias("e")))))


def with_chunks(pages: DataFrame, max_tokens: int = K.CHUNK_MAX_TOKENS, overlap: int = K.CHUNK_OVERLAP_TOKENS,
                vectors: str | None = None, threshold: float = K.CHUNK_SIMILARITY) -> DataFrame:
    """Add ``chunks`` ARRAY<STRING>.

    Up to three sentences stay one chunk (the page text). ``vectors`` names an ARRAY<ARRAY<FLOAT>> column, one vector
    per sentence; with it, pages of more than five sentences also break where neighbours differ.
    """
    rows = pages.withColumn("_sents", T.sentences(F.col("text")))
    rows = rows.withColumn("_tok", F.transform("_sents", T.token_estimate))
    breaks = None
    if vectors is not None:
        v = F.col(vectors)
        far = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1),
                         lambda a, b: cosine(a, b) < threshold)
        rows = rows.withColumn("_brk", F.when(F.size("_sents") > 5, F.concat(F.array(F.lit(False)), far)).otherwise(
            F.array().cast("array<boolean>")))
        breaks = F.transform("_sents", lambda s, i: F.coalesce(F.try_element_at(F.col("_brk"), i + 1), F.lit(False)))
        rows = rows.withColumn("_b", breaks)
        breaks = F.col("_b")
    n = F.size("_sents")
    rows = rows.withColumn("_runs", F.when(n > 3, runs(F.col("_tok"), breaks, max_tokens, overlap)))
    packed = let(F.struct(F.col("_sents").alias("s"), F.col("_runs").alias("r")), lambda x: F.transform(
        x["r"], lambda r: F.array_join(F.slice(x["s"], r["s"] + 1, r["e"] - r["s"]), " ")))
    whole = F.array(T.strip(F.col("text")))
    none = F.array().cast("array<string>")
    out = rows.withColumn("chunks", F.when(n == 0, none).when(n <= 3, whole).otherwise(packed))
    return out.drop("_sents", "_tok", "_brk", "_b", "_runs")


def chunk_pages(pages: DataFrame, max_tokens: int = K.CHUNK_MAX_TOKENS, overlap: int = K.CHUNK_OVERLAP_TOKENS,
                vectors: str | None = None) -> DataFrame:
    """Pages (doc_name, page, text, source_type) to annotated chunks; pages under 40 characters are dropped."""
    long_enough = F.length(T.strip(F.coalesce(F.col("text"), F.lit("")))) >= K.MIN_PAGE_CHARS
    rows = with_chunks(pages.where(long_enough), max_tokens, overlap, vectors)
    # The outer form: the plain one would add a filter on ``chunks`` and so evaluate the whole fold a second time.
    rows = rows.select("doc_name", "page", "source_type", F.posexplode_outer("chunks").alias("chunk", "text"))
    return annotate(rows.where(F.col("text").isNotNull()))


def annotate(chunks: DataFrame) -> DataFrame:
    t = F.col("text")
    return chunks.withColumns({
        "page": F.coalesce(F.col("page"), F.col("chunk") + 1),
        "topic": T.topic(t), "year": T.year(t),
        "credibility_score": T.credibility(F.col("doc_name"), F.col("source_type")),
        "token_count": T.token_estimate(t),
    })
