"""Passages of a benchmark inside documents, by a positional index.

A window is ``length`` consecutive words of a benchmark item (all words of a shorter item). The rarest term of a window
in the corpus is its anchor. The stored index holds the postings of the anchor terms: document, position, and the words
around that position. Offset-adjusted, a posting says where the window would have to start; the words stored with it
decide whether the window (exactly, or all of its words near to each other) is there.

Only anchors are indexed, since a window can only be where its rarest term is. They are looked up in blocks of a bounded
number of terms, so the benchmark may be of any size.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.bounds import broadcast_if_small
from .common import LOWER, UPPER, store

NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERM_BLOCK = 20_000  # anchor terms that one scan of the documents looks for


def words_of(text):
    """A-Z lower-cased; runs of characters that are letters, digits or beyond ASCII."""
    split = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NOT_WORDS)
    return F.filter(split, lambda w: w != "")


def windows(items: DataFrame, item: str, text: str, length: int) -> DataFrame:
    """item, window (array of words), distinct. Items without words have none; rows of one id add up."""
    words = items.select(F.col(f"`{item}`").alias("item"), words_of(F.col(f"`{text}`")).alias("words")).where(
        "item is not null and size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1)))
    return words.select("item", F.explode(starts).alias("at"), "words").select(
        "item", F.slice("words", F.col("at"), F.lit(length)).alias("window")).distinct()


def tokenised(docs: DataFrame, key: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """row, id (the key and the kept columns), words."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(F.col(f"`{key}`").alias("own"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep))).alias("id"),
        words_of(F.col(f"`{text}`")).alias("words"))


def _blocks(terms: DataFrame):
    """The stored terms as lists for an IN, a bounded number at a time; together they are all terms."""
    n = -(-terms.count() // TERM_BLOCK)
    for b in range(n):
        part = terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == b).collect()
        if part:
            yield ", ".join("'" + r.term.replace("\\", "\\\\").replace("'", "\\'") + "'" for r in part)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the stored terms stands in all documents."""
    return _union([
        rows.select(F.explode("words").alias("term")).where(f"term in ({block})").groupBy("term").agg(F.count("*").alias("n"))
        for block in _blocks(terms)])


def anchors(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """item, window, anchor (its rarest term, of equally rare ones the first in order), offset (its first place in the
    window). A window with a word that no document has cannot occur and is left out."""
    each = wins.withColumn("id", F.xxhash64("item", "window")).select("*", F.explode(F.array_distinct("window")).alias("term"))
    met = each.join(broadcast_if_small(counts), "term", "left")
    rarest = met.groupBy("item", "window").agg(
        F.min(F.struct("n", "term")).alias("least"), F.bool_and(F.col("n").isNotNull()).alias("possible"))
    return rarest.where("possible").select(
        "item", "window", F.col("least.term").alias("anchor"),
        (F.array_position("window", F.col("least.term")) - 1).cast("int").alias("offset"))


def postings(rows: DataFrame, block: str, reach: int) -> DataFrame:
    """The stored index of one block of terms: row, id, n_words, and hits (term, pos from 0, first (the position that
    ``around`` starts at), around (the words up to ``reach`` before and behind)); a row per document, with no hits if it
    has none of the terms."""
    at = F.expr(f"filter(transform(words, (w, i) -> if(w in ({block}), i, null)), i -> i is not null)")

    def hit(i):
        first = F.greatest(i - reach, F.lit(0))
        return F.struct(F.get("words", i).alias("term"), i.alias("pos"), first.alias("first"),
                        F.slice("words", first + 1, i + reach + 1 - first).alias("around"))

    return store(rows.select("row", "id", F.size("words").cast("long").alias("n_words"), "words", at.alias("at")).select(
        "row", "id", "n_words", F.transform("at", hit).alias("hits")))


def matches(index: DataFrame, anchored: DataFrame, slack: int = 0) -> DataFrame:
    """row, item, start, size: where windows occur. With ``slack`` 0 a match is the exact phrase; otherwise every stretch of
    at most its length plus ``slack`` words that holds all words of the window, as often as it has them and in any order,
    and begins and ends with one of them."""
    hits = index.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    met = hits.join(broadcast_if_small(anchored), F.col("term") == F.col("anchor"))
    n = F.size("window")
    start = F.col("pos") - F.col("offset")
    if not slack:
        there = F.slice("around", start - F.col("first") + 1, n) == F.col("window")
        return met.where(start >= F.col("first")).where(there).select("row", "item", start.alias("start"), n.alias("size"))
    starts = F.sequence(F.greatest(F.col("first"), F.col("pos") - (n + slack - 1)), F.col("pos"))
    word = lambda i: F.get("around", i - F.col("first"))
    stretch = lambda i: F.slice("around", i - F.col("first") + 1, n + slack)
    often = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    holds = lambda i: F.forall(F.array_distinct("window"), lambda w: often(stretch(i), w) >= often("window", w))
    behind = lambda i: F.array_position(F.reverse(F.transform(stretch(i), lambda x: F.array_contains("window", x))), True) - 1
    places = F.transform(
        F.filter(starts, lambda i: F.array_contains("window", word(i)) & holds(i)),
        lambda i: F.struct(i.alias("start"), (F.size(stretch(i)) - behind(i)).cast("int").alias("size")))
    return met.select("row", "item", F.explode(places).alias("p")).select("row", "item", "p.start", "p.size")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", length: int = 13, share: int = 20, slack: int = 0,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep`` columns, n_words, n_hit, n_items, items (sorted texts of the ids), contaminated: a row per
    document.

    A word is hit if it lies in an occurrence of a window; a document is contaminated if share * n_hit >= n_words and
    any word is hit. Null texts have no words; documents and items without words have no hits. Repeated rows and rows
    with null keys are judged each; an item with a null id is left out. An empty benchmark hits nothing, an empty table
    gives an empty result. Further columns do not matter.
    """
    wins = store(windows(items, item, item_text, length))
    terms = store(wins.select(F.explode("window").alias("term")).distinct())
    rows = tokenised(docs, key, text, keep)
    named = [F.col("id.own").alias(key), *(F.col(f"id.k{i}").alias(c) for i, c in enumerate(keep))]
    if terms.count() > TERM_BLOCK:  # several scans need the same row numbers
        rows = store(rows)
    indexes = []
    if terms.count():
        anchored = store(anchors(wins, term_counts(rows, terms)))
        chosen = store(anchored.select(F.col("anchor").alias("term")).distinct())
        indexes = [postings(rows, block, length - 1 + slack) for block in _blocks(chosen)]
    none = F.array().cast("array<string>")
    if not indexes:
        return rows.select(
            *named, F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
            F.lit(0).cast("long").alias("n_items"), none.alias("items"), F.lit(False).alias("contaminated"))
    base = indexes[0].select("row", "id", "n_words")
    found = _union([matches(i, anchored, slack) for i in indexes]).distinct()
    # Covered words of a document: each occurrence adds what lies behind the ends of those before it.
    before = W.partitionBy("row").orderBy("start", "size").rowsBetween(W.unboundedPreceding, -1)
    spans = found.select("row", "start", "size").distinct().withColumn(
        "done", F.coalesce(F.max(F.col("start") + F.col("size")).over(before), F.lit(0)))
    own = F.greatest(F.col("start") + F.col("size") - F.greatest("start", "done"), F.lit(0))
    hit = spans.groupBy("row").agg(F.sum(own).alias("n_hit"))
    which = found.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    out = base.join(hit.join(which, "row"), "row", "left")
    n_hit = F.least(F.coalesce(F.col("n_hit"), F.lit(0)), F.col("n_words")).cast("long")
    return out.select(
        *named, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))
