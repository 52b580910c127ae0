"""Sharding by a k-d tree over document metadata.

The tree splits a node that is to give ``k`` shards into nodes for ``k // 2`` and the rest,
along the dimension in which the node's rows spread widest (relative to the whole table),
at the weighted quantile that gives each side its part of the bytes. All nodes of a level
are split by the same jobs: the spread is one aggregation, and the quantile is found digit
by digit in a histogram of an order-preserving 60-bit key, so each job returns at most
``nodes * 4096`` sums. Ties in a dimension (a hot source, equal sizes) are ordered by a hash
of the id within the same key, so no value is too frequent to be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.llm.common import materialise, text_of, with_slots

#: The key: 20 bits of the dimension, 28 of the id's hash, 12 that part repeated rows.
VALUE_BITS, HASH_BITS, ROW_BITS = 20, 28, 12
DIGIT_BITS = 12
KEY_BITS = VALUE_BITS + HASH_BITS + ROW_BITS


def _unit(column):
    """A category as a place in [0, 1): equal values share it, nulls are at 0."""
    return F.coalesce(F.pmod(F.xxhash64(column), F.lit(1 << 30)).cast("double") / float(1 << 30), F.lit(0.0))


def default_dimensions(columns: list[str]) -> dict:
    """Logarithm of the size, and whichever of source, lang and doc_id the table has."""
    out = {"log_size": F.log1p(F.col("size").cast("double"))}
    for name in ("source", "lang"):
        if name in columns:
            out[name] = _unit(F.col(name))
    out["doc_id"] = F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))
    return out


def metadata(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the tree needs of each document; the text itself is never shuffled."""
    text = text_of(text_col)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        *[c for c in ("source", "lang") if c in df.columns],
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    dims = default_dimensions(rows.columns)
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 << HASH_BITS))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.array(*dims.values()).alias("dims"),
        (tie * (1 << ROW_BITS) + F.pmod(F.monotonically_increasing_id(), F.lit(1 << ROW_BITS))).alias("tie"),
    )


class _Node:
    """A subtree that still has ``leaves`` shards from ``first`` on."""

    def __init__(self, first: int, leaves: int):
        self.first, self.leaves = first, leaves
        self.dim, self.low, self.width = 0, 0.0, 1.0
        self.left_bytes = 0.0
        self.prefix = 0  # the digits of the split key so far


def _of_node(nodes: dict, leaves: int, value, kind: str):
    """A value of the row's node, looked up in a constant array."""
    values = [F.lit(value(nodes.get(k) or _Node(k, 1))).cast(kind) for k in range(leaves)]
    return F.element_at(F.array(*values), F.col("node") + 1)


def _spreads(n_dims: int):
    return [f(F.col("dims")[i]).alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]


def kd_split(meta: DataFrame, leaves: int) -> DataFrame:
    """``meta`` (materialised) with the column ``shard``.

    The driver keeps the tree, a few numbers a node. A level is a table again, so that no
    plan grows with the depth.
    """
    first_row = meta.head(1)
    if not first_row:
        return meta.withColumn("shard", F.lit(0))
    n_dims = len(first_row[0]["dims"])
    root = meta.agg(*_spreads(n_dims)).first()
    spread = [max(root[f"hi{i}"] - root[f"lo{i}"], 1e-300) for i in range(n_dims)]
    top = (1 << VALUE_BITS) - 1
    nodes, current = [_Node(0, leaves)], meta.withColumn("node", F.lit(0))
    while any(x.leaves > 1 for x in nodes):
        split = {x.first: x for x in nodes if x.leaves > 1}
        is_open = _of_node(split, leaves, lambda x: x.leaves > 1, "boolean")
        stats = current.filter(is_open).groupBy("node").agg(F.sum("size").alias("bytes"), *_spreads(n_dims)).collect()  # one row a node
        for r in stats:
            x = split[r["node"]]
            x.dim = max(range(n_dims), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / spread[i], -i))
            x.low, x.width = float(r[f"lo{x.dim}"]), float(r[f"hi{x.dim}"] - r[f"lo{x.dim}"]) or 1.0
            x.left_bytes = r["bytes"] * (x.leaves // 2) / x.leaves
        value = F.element_at("dims", _of_node(split, leaves, lambda x: x.dim + 1, "int"))
        scaled = F.floor((value - _of_node(split, leaves, lambda x: x.low, "double")) / _of_node(split, leaves, lambda x: x.width, "double") * top)
        key = F.least(F.lit(top), F.greatest(F.lit(0), scaled)).cast("long") * (1 << (HASH_BITS + ROW_BITS)) + F.col("tie")
        keyed = current.filter(is_open).select("node", "size", key.alias("key"))
        shift, unresolved = KEY_BITS, {r["node"] for r in stats}
        while unresolved:
            shift -= DIGIT_BITS
            sought = {k: split[k] for k in unresolved}
            inside = F.shiftright("key", shift + DIGIT_BITS) == _of_node(sought, leaves, lambda x: x.prefix if x.first in sought else -1, "long")
            digit = F.shiftright("key", shift).bitwiseAND((1 << DIGIT_BITS) - 1)
            bars = keyed.filter(inside).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
            for first in sought:
                x, below = split[first], 0
                mine = sorted((r["digit"], r["bytes"], r["rows"]) for r in bars if r["node"] == first)
                for d, size, rows in mine:
                    if below + size >= x.left_bytes or d == mine[-1][0]:
                        break
                    below += size
                x.prefix = (x.prefix << DIGIT_BITS) | d
                x.left_bytes -= below
                if rows == 1 or not shift:  # this row goes to the side that comes nearer
                    x.prefix = ((x.prefix + 1) << shift) - 1 if size - x.left_bytes < x.left_bytes else (x.prefix << shift) - 1
                    unresolved.discard(first)
        right = key > _of_node(split, leaves, lambda x: x.prefix, "long")
        moved = F.when(is_open & right, F.col("node") + _of_node(split, leaves, lambda x: x.leaves // 2, "int")).otherwise(F.col("node"))
        current = materialise(current.withColumn("node", moved), "kd-level")
        halves = [(x, x.leaves // 2) for x in split.values()]
        nodes = [x for x in nodes if x.leaves <= 1] + [_Node(x.first, h) for x, h in halves] + [_Node(x.first + h, x.leaves - h) for x, h in halves]
    return current.withColumnRenamed("node", "shard")


def kd_shards(df: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``df``.

    ``leaves`` shards, or as many as bring a shard to ``target_bytes``. The law is ``bytes``:
    every split is at the exact weighted quantile, so shards differ by about one document a
    level. Null texts weigh 8 bytes; null sources, languages and ids are a value of their
    own; repeated rows are told apart by their place, so they can be split too. An empty
    table gives an empty result; with fewer rows than shards some shards are empty.
    """
    meta = materialise(metadata(df), "kd-metadata")
    if leaves is None:
        total = meta.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, -(-total // int(target_bytes)))
    sharded = materialise(kd_split(meta, leaves).select("doc_id", "size", "text_crc32", "shard", "tie"), "kd-shards")
    most = sharded.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    return with_slots(sharded, "shard", ["doc_id", "tie"], most).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
