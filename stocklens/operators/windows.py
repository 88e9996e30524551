"""Per-client window building blocks that stay parallel when one client is huge.

* ``top_k``: ``row_number() <= k`` per client. Spark plans a partial
  ``WindowGroupLimit`` before the shuffle, so each map task ships at most k rows
  per client; no task ever holds a whole client.
* ``running_sum``: exact running totals per client by a two-stage prefix sum (range
  blocks, per-block totals, offsets).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stocklens.session import settle


def top_k(df: DataFrame, k: int, order: Sequence[Column], keys: Sequence[str] = ("client_id",),
          rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def running_sum(df: DataFrame, values: dict[str, Column], order: Sequence[Column],
                keys: Sequence[str] = ("client_id",), n_blocks: int | None = None,
                totals: Sequence[str] = ()) -> DataFrame:
    """Add ``running`` columns: for each name -> value, the sum of value over all rows of
    the same key up to and including this one in ``order`` (which must be total).
    For each name in ``totals`` also add ``{name}_total``, the key's grand total.

    One plan for every size: contiguous range blocks of the (key, order) sequence, sums
    inside each block, and offsets from the totals of earlier blocks, so no task holds a
    whole key. Block ids are pinned in ``spark.checkpoint.dir`` with the rows (Parquet, of which
    later steps read the columns they need); the values are made again from them."""
    spark = df.sparkSession
    n = n_blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    vals = {f"_v_{name}": v for name, v in values.items()}
    ranged = settle(df.repartitionByRange(n, *[F.col(c) for c in keys], *order)
                      .withColumn("_blk", F.spark_partition_id()), "running").select("*", *[v.alias(n_) for n_, v in vals.items()])
    # running sums inside each (key, block): a block holds about 1/n of the data
    w_in = (Window.partitionBy(*keys, "_blk").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0))
    local = ranged.withColumns({f"_loc{vname}": F.sum(vname).over(w_in) for vname in vals})
    # offsets: totals of all earlier blocks of the same key (at most n rows per key)
    tot = ranged.groupBy(*keys, "_blk").agg(*[F.sum(v).alias(f"_tot{v}") for v in vals])
    w_pre = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*keys, "_blk", *[F.sum(f"_tot{v}").over(w_pre).alias(f"_off{v}") for v in vals])
    out = local.join(offs, [*keys, "_blk"])
    if totals:
        grand = tot.groupBy(*keys).agg(*[F.sum(f"_tot_v_{n}").alias(f"{n}_total") for n in totals])
        out = out.join(grand, list(keys))
    out = out.withColumns({name: F.col(f"_loc_v_{name}") + F.coalesce(F.col(f"_off_v_{name}"), F.lit(0))
                           for name in values})
    drop = ["_blk"] + [c for v in vals for c in (v, f"_loc{v}", f"_off{v}")]
    return out.drop(*drop)
