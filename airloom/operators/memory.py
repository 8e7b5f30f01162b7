"""Conversation compaction.

A conversation of any length needs only its first few and last few messages plus two totals. Those come from rank
limits that apply before the shuffle and from a combinable aggregate, so one huge conversation is no hot group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import text as T


def _line(role: Column, text: Column) -> Column:
    return F.when(role == "user", F.concat(F.lit("User asked: "), F.substring(text, 1, 100))).otherwise(
        F.concat(F.lit("Assistant discussed: "), F.substring(text, 1, 80)))


def message_tokens(messages: DataFrame, keys: list[str] = ("conv_id",)) -> DataFrame:
    return messages.groupBy(*keys).agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


def conversation_totals(messages: DataFrame) -> DataFrame:
    """(conv_id, has_system, n_chat, tokens): a leading system message is not counted."""
    m = messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(T.token_estimate(F.col("text"))).cast("bigint").alias("t"),
        F.min_by(F.struct("role", T.token_estimate(F.col("text")).alias("t")), "turn").alias("f"))
    system = F.col("f.role") == "system"
    return m.select("conv_id", system.alias("has_system"), (F.col("n") - system.cast("int")).alias("n_chat"),
                    (F.col("t") - F.when(system, F.col("f.t")).otherwise(0)).alias("tokens"))


def compact(messages: DataFrame, max_tokens: int = K.MEMORY_MAX_TOKENS,
            keep_recent: int = K.MEMORY_KEEP_RECENT) -> DataFrame:
    """(conv_id, position, role, text): short conversations unchanged, long ones as system + summary + recent.

    The summary is extractive: the first three and the last two old messages when there are more than six.
    """
    first_n, last_n = 7, max(2 * keep_recent, keep_recent + 6) + 1
    asc = W.partitionBy("conv_id").orderBy("turn")
    desc = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    cols = ["conv_id", "turn", "role", "text"]
    head = messages.select(*cols).withColumn("up", F.row_number().over(asc)).where(F.col("up") <= first_n)
    tail = messages.select(*cols).withColumn("down", F.row_number().over(desc)).where(F.col("down") <= last_n)
    totals = conversation_totals(messages)
    n, keep = F.col("n_chat"), F.least(F.col("n_chat"), F.lit(keep_recent))
    short = (F.col("tokens") <= max_tokens) & (n <= 2 * keep_recent)
    # Chat position 0 .. n-1 (the system message gets -1), from either end.
    head = head.join(totals, "conv_id").withColumn("pos", F.col("up") - 1 - F.col("has_system").cast("int"))
    tail = tail.join(totals, "conv_id").withColumn("pos", n - F.col("down"))
    # Short conversations have at most 2 * keep_recent + 1 rows, so the tail holds them whole.
    kept = tail.where(short | (F.col("pos") >= n - keep)).select("conv_id", F.col("pos").alias("order"), "role", "text")
    system = head.where(~short & (F.col("pos") == -1)).select(
        "conv_id", F.lit(-1).cast("bigint").alias("order"), "role", "text")
    n_old = n - keep
    old = (
        head.drop("up").unionByName(tail.drop("down"))
        .where(~short & (F.col("pos") >= 0) & (F.col("pos") < n_old))
        .where((n_old <= 6) | (F.col("pos") < 3) | (F.col("pos") >= n_old - 2))
        .dropDuplicates(["conv_id", "pos"])
    )
    lines = old.groupBy("conv_id").agg(  # at most six rows per conversation
        F.array_sort(F.collect_list(F.struct("pos", _line(F.col("role"), F.col("text")).alias("line")))).alias("l"),
        F.first(n_old).alias("n_old"))
    texts = F.transform("l", lambda x: x["line"])
    shown = F.when(F.col("n_old") > 6, F.concat(
        F.slice(texts, 1, 3), F.array(F.lit("...")), F.slice(texts, 4, 2))).otherwise(texts)
    summary = lines.select(
        "conv_id", F.lit(0).cast("bigint").alias("order"), F.lit("system").alias("role"),
        F.concat(F.lit("[Conversation Summary — "), F.col("n_old").cast("string"), F.lit(" earlier messages]\n"),
                 F.array_join(shown, " | ")).alias("text"))
    every = kept.unionByName(system).unionByName(summary)
    return every.select("conv_id", F.col("order").cast("bigint").alias("position"), "role", "text")


def summary_prompt(messages: DataFrame) -> DataFrame:
    """Text handed to a language model for a summary: one row per message, its leading 500 characters as the format
    asks for; a caller with a model joins the rows of one (already limited) list."""
    return messages.withColumn("line", F.concat(F.upper("role"), F.lit(": "), F.substring("text", 1, 500)))
