"""URL rules by hashed host-suffix and path-prefix expressions.

Each url becomes the set of expressions (host suffix + path prefix) that a rule could name; expressions meet the rules
in an equi-join on the first 32 bits of their SHA-256, the full digest confirms, and the longest rule wins.

Only suffixes with as many labels, and prefixes as long, as some rule has are made: all other expressions cannot match.
The number of those shapes, not of rules, bounds what a url expands to.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.bounds import broadcast_if_small
from .common import lower_ascii

SHORT = 8  # hex digits of the digest in the join key


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url):
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with host, path, rule and verdict, one row per row of ``urls``.

    ``rules``: host, path, action. A rule fits its host and all subdomains where the url's path starts with the rule's
    path; the longest rule (host and path together) wins, of equally long ones the first in order of its text. A url
    without a rule gets ``default`` and a null rule. Null urls and urls without ``://`` have an empty host and path;
    they match no rule. Repeated rows are judged each; empty tables give empty results; rules with a null are ignored.
    Columns of ``urls`` that are not named in ``keep`` do not appear, so no name can clash.
    """
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action").dropna()
    shapes = (
        rules.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars"))
        .distinct().collect()
    )
    rule = F.concat("rule_host", "rule_path")
    digest = F.sha2(rule, 256)
    sides = rules.select(
        digest.substr(1, SHORT).alias("rule_short"), digest.alias("rule_digest"), rule.alias("rule"),
        "action").distinct()

    parts = urls.select(
        *(F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)),
        F.monotonically_increasing_id().alias("key"), host_of(F.col(f"`{url}`")).alias("host"),
        path_of(F.col(f"`{url}`")).alias("path"))
    labels = F.size(F.split("host", r"\."))
    made = F.array(*(
        F.when((labels >= s.labels) & (F.length("path") >= s.chars),
               F.concat(F.substring_index("host", ".", -s.labels), F.substring("path", 1, s.chars)))
        for s in shapes)) if shapes else F.array().cast("array<string>")
    each = (
        parts.select("*", F.explode_outer(F.array_distinct(F.array_compact(made))).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.col("digest").substr(1, SHORT))
    )
    met = each.join(broadcast_if_small(sides), F.col("short") == F.col("rule_short"), "left")
    # The full digest decides; of two prefixes that merely begin alike only the true one remains.
    fits = F.when(F.col("digest") == F.col("rule_digest"),
                  F.struct((-F.length("rule")).alias("order"), "rule", "action"))
    kept = [f"kept_{i}" for i in range(len(keep))]
    best = met.groupBy("key").agg(*(F.first(c).alias(c) for c in [*kept, "host", "path"]), F.min(fits).alias("best"))
    return best.select(
        *(F.col(c).alias(name) for c, name in zip(kept, keep)), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
