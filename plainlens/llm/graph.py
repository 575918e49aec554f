"""Connected components by alternating stars, with bounded work per row and no neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


#: A key with more rows than one in HUBS is a hub. There are at most HUBS of them, so what belongs to them is broadcast.
HUBS = 1000


def joined_per_key(rows: DataFrame, per_key: DataFrame, key: str | list[str], n_rows: int) -> DataFrame:
    """Rows with the columns of per_key, which has one row for each key and its number of rows as n.

    Keys of more than a part of all rows take a broadcast, so no task gets all rows of such a key.
    """
    bound = max(10, n_rows // HUBS)
    keys = [key] if isinstance(key, str) else key
    names = [c for c in per_key.columns if c not in (*keys, "n")]
    hubs = per_key.filter(F.col("n") > bound).select(*keys, F.struct(*names).alias("_hub"))
    tagged = rows.join(F.broadcast(hubs), keys, "left")
    rest = tagged.filter("_hub IS NULL").drop("_hub").join(per_key.filter(F.col("n") <= bound).drop("n"), keys)
    return tagged.filter("_hub IS NOT NULL").select(*rows.columns, *[F.col("_hub")[c].alias(c) for c in names]).unionByName(rest)


def _with_least(rows: DataFrame, n_links: int) -> DataFrame:
    """Rows (u, v) with m, the least v of each u."""
    return joined_per_key(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", n_links)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links of any comparable type to (node, root): root is the least node of node's component.

    Each round is two aggregations with map-side combining and two joins, of which the hubs' part is a broadcast of bounded
    size; its edges are checkpointed to the shared folder, so a lost executor costs one round. Rows with u = v and repeated
    rows are allowed; no edges give no rows.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    edges = edges.select(big.alias("u"), small.alias("v")).filter("u <> v").distinct().checkpoint()
    before = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _with_least(both, 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        near = _with_least(wide, before[0])
        pairs = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = near.select(pairs.alias("e")).select("e.u", "e.v").filter("u <> v").distinct().checkpoint()
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
