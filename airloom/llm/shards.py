"""Shards of nearly equal bytes by a k-d tree over metadata.

A node that stands for m shards is cut along its widest metadata dimension at the weighted quantile floor(m/2)/m of its
bytes, until each leaf is one shard and so has the target bytes. Quantiles are found by distributed histograms: each
round sums the bytes per bin of all nodes of a level in one job and goes on in the bin where the quantile lies, so the
driver sees bins, never rows.

Rows of equal texts share their coordinates (the least metadata of the group), so that a cut leaves them together. Ties
on the dimension are cut between groups; only inside a group that outweighs the tolerance are they cut between rows.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.bounds import broadcast_if_small
from .common import store

BINS = 512
SLOT_ROWS = 20_000  # rows numbered by one task at a time
HASH_BITS = 61


TIES = ("g", "i", "u")  # what orders rows of equal coordinate: their group, then hashes of their own
LOWEST = -(2 ** 62)


@dataclass
class Node:
    first: int                 # its first shard
    shards: int
    dim: int = 0               # cut: rows whose (coordinate dim, g, i, u) lies below ``at`` go left
    at: tuple = ()
    left: int = -1             # positions in the list of nodes; -1 at a leaf
    right: int = -1
    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    weight: int = 0


def points(docs: DataFrame, key: str, text: str, metadata: tuple[str, ...]) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, and its coordinates d0..dn, group hash g, own hashes i and u."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.select(
        F.col(f"`{key}`").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body, F.lit(1)).alias("group"),
        *(_number(docs, c).alias(f"m{i}") for i, c in enumerate(metadata)),
        F.monotonically_increasing_id().alias("row"))
    least = base.groupBy("group").agg(*(F.min(f"m{i}").alias(f"d{i + 1}") for i in range(len(metadata))))
    return base.join(least, "group").select(
        "doc_id", "size", "text_crc32", F.col("size").alias("d0"), *(f"d{i + 1}" for i in range(len(metadata))),
        _spread("group").alias("g"), _spread("doc_id").alias("i"), _spread("row").alias("u"))


def _number(docs: DataFrame, name: str):
    """A dimension as a whole number of at most 62 bits: numbers in their order, words by a hash, nulls below all."""
    kind, c = dict(docs.dtypes)[name], F.col(f"`{name}`")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        value = F.shiftright(c.cast("long"), 1)
    else:
        value = F.crc32(F.encode(c.cast("string"), "UTF-8"))
    return F.coalesce(value, F.lit(LOWEST).cast("long"))


def _spread(c: str):
    return F.shiftrightunsigned(F.xxhash64(c), 64 - HASH_BITS)


def _table(values, suffix: str = ""):
    """Whole numbers as one literal array."""
    return F.expr(f"array({', '.join(f'{v}{suffix}' for v in values)})")


def _descend(nodes: list[Node], dims: list[str]):
    """The position of the node that a row has come to: a fold over the levels, the tree as literal arrays."""
    left, right = _table(n.left for n in nodes), _table(n.right for n in nodes)
    dim = _table(n.dim + 1 for n in nodes)
    at = [_table(((n.at or (0, 0, 0, 0))[c] for n in nodes), "L") for c in range(4)]

    def step(n, _):
        own = F.struct(F.element_at(F.array(*dims), F.get(dim, n)).alias("x"), *TIES)
        cut = F.struct(*(F.get(a, n).alias(c) for a, c in zip(at, ("x", *TIES))))
        return F.when(F.get(left, n) < 0, n).when(own < cut, F.get(left, n)).otherwise(F.get(right, n))

    return F.aggregate(F.array_repeat(F.lit(0), len(nodes).bit_length() + 1), F.lit(0), step)


def grow(pts: DataFrame, dims: list[str], shards: int, tolerance: float) -> list[Node]:
    """The tree, root first. ``tolerance``: how far, in shares of the target bytes, a cut may lie from the quantile so
    that it need not divide a group of equal texts."""
    nodes = [Node(0, shards)]
    spans, total = None, 0
    while True:
        open_nodes = [k for k, n in enumerate(nodes) if n.left < 0 and n.shards > 1]
        if not open_nodes:
            return nodes
        at_node = pts.withColumn("node", _descend(nodes, dims))
        stats = at_node.groupBy("node").agg(
            F.sum("size").alias("weight"), F.array(*(F.min(d) for d in dims)).alias("low"),
            F.array(*(F.max(d) for d in dims)).alias("high")).collect()
        for row in stats:
            nodes[row.node].weight, nodes[row.node].low, nodes[row.node].high = row.weight, row.low, row.high
        if spans is None:
            spans = [max(1, h - x) for x, h in zip(nodes[0].low, nodes[0].high)]
            total = nodes[0].weight
        _cut_level(pts, nodes, open_nodes, dims, spans, tolerance * total / shards)
        for k in open_nodes:
            n = nodes[k]
            half = n.shards // 2
            n.left, n.right = len(nodes), len(nodes) + 1
            nodes += [Node(n.first, half), Node(n.first + half, n.shards - half)]


def _cut_level(pts, nodes, open_nodes, dims, spans, slack):
    """Sets the cut of each open node by rounds of histograms over all of them."""
    search = {}
    for k in open_nodes:
        n = nodes[k]
        if not n.weight:
            n.at = (0, 0, 0, 0)  # no rows: any cut will do
            continue
        n.dim = max(range(len(dims)), key=lambda d: ((n.high[d] - n.low[d]) / spans[d] if spans else 0, -d))
        search[k] = {"fixed": (), "low": n.low[n.dim], "high": n.high[n.dim], "below": 0,
                     "goal": n.weight * (n.shards // 2) / n.shards}
    while search:
        found: dict[int, dict[int, int]] = {}
        for row in _histogram(pts, nodes, search, dims).collect():
            found.setdefault(row.node, {})[row.bin] = (row.weight, row.rows)
        for k in list(search):
            if _narrow(search[k], found.get(k, {}), slack):
                at = search.pop(k)["cut"]
                nodes[k].at = (*at, *[LOWEST] * (4 - len(at)))


def _histogram(pts, nodes, search, dims) -> DataFrame:
    """node, bin, weight of the rows that lie in the range which each node still searches."""
    closed = {"fixed": (), "low": 1, "high": 0}
    ranges = [search.get(k, closed) for k in range(len(nodes))]
    for s in ranges:
        s["step"] = (s["high"] - s["low"]) // BINS + 1
    dim, n_fixed = _table(n.dim + 1 for n in nodes), _table(len(s["fixed"]) for s in ranges)
    low, high, step = (_table((s[c] for s in ranges), "L") for c in ("low", "high", "step"))
    fixed = [_table(((*s["fixed"], 0, 0, 0)[c] for s in ranges), "L") for c in range(3)]

    def place(n):
        own = F.array(F.element_at(F.array(*dims), F.get(dim, n)), *TIES)
        x = F.get(own, F.get(n_fixed, n))
        same = F.slice(own, F.lit(1), F.get(n_fixed, n)) == F.slice(
            F.array(*(F.get(f, n) for f in fixed)), F.lit(1), F.get(n_fixed, n))
        bin_ = F.when(same & x.between(F.get(low, n), F.get(high, n)),
                      F.call_function("div", x - F.get(low, n), F.get(step, n)))
        return F.struct(n.alias("node"), bin_.alias("bin"))

    placed = pts.select("size", F.inline(F.transform(F.array(_descend(nodes, dims)), place)))
    return placed.where("bin is not null").groupBy("node", "bin").agg(F.sum("size").alias("weight"), F.count("*").alias("rows"))


def _narrow(s: dict, bins: dict[int, tuple[int, int]], slack: float) -> bool:
    """One step of the search; true when it has ended with ``s["cut"]``."""
    below, where = s["below"], None
    for where in sorted(bins):
        if below + bins[where][0] >= s["goal"]:
            break
        below += bins[where][0]
    if where is None:  # nothing here: cut before it
        s["cut"] = (*s["fixed"], s["low"])
        return True
    weight, rows = bins[where]
    start = s["low"] + where * s["step"]
    end = min(s["high"], start + s["step"] - 1)
    if weight <= slack or rows == 1 or (start == end and len(s["fixed"]) == len(TIES)):
        nearer_after = below + weight - s["goal"] < s["goal"] - below
        s["cut"] = (*s["fixed"], end + 1 if nearer_after else start)
        return True
    s["below"] = below
    if start == end:
        s["fixed"] = (*s["fixed"], start)
        s["low"], s["high"] = 0, 2 ** HASH_BITS - 1
    else:
        s["low"], s["high"] = start, end
    return False


def kd_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text",
              metadata: tuple[str, ...] = ("doc_id", "source", "lang"), tolerance: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row in one of ``shards`` shards of nearly equal bytes.

    Size is the text's UTF-8 bytes plus 8. Dimensions of the tree are the size and ``metadata``; numbers keep their
    order, other types go by a hash, nulls lie below all values. A null text is an empty one. Shards differ from their
    share by the tolerance and the size of a row at most; rows of equal texts stay in one shard unless they outweigh the
    tolerance together. Repeated rows are placed each. Fewer rows than shards leave some shards empty. Slots number the
    rows of a shard from 0 without gaps, in order of hashed buckets of doc_id and of doc_id within. An empty table gives
    an empty result; further columns do not matter.
    """
    pts = store(points(docs, key, text, metadata))
    dims = [f"d{i}" for i in range(len(metadata) + 1)]
    tree = grow(pts, dims, shards, tolerance)
    placed = pts.select("doc_id", "size", "text_crc32", "i", "u",
                        F.get(_table(n.first for n in tree), _descend(tree, dims)).alias("shard"))
    return number_slots(placed, pts.count(), shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def number_slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Rows are numbered in hashed buckets of a bounded size, and each bucket starts where those before it end."""
    n = max(1, rows // (shards * SLOT_ROWS) + 1)
    bucketed = placed.withColumn("bucket", F.pmod(F.xxhash64("i", "u"), F.lit(n)).cast("int"))
    counts = bucketed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "u")
    numbered = bucketed.withColumn("at", F.row_number().over(order) - 1)
    return numbered.join(broadcast_if_small(starts), ["shard", "bucket"]).withColumn(
        "slot", (F.col("start") + F.col("at")).cast("long"))
