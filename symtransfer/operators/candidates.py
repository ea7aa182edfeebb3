"""Pairs (u, t) of left and right entities that are worth scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import size_bucket, within_twice

SIZES = ("n_methods", "n_fields")
#: Entities of a tile at most, and parts that each side of a block is dealt into.
TILE, GRID = 128, 4


def _similar_sizes(a: str, b: str):
    return within_twice(F.col(f"{a}.n_methods"), F.col(f"{b}.n_methods")) & within_twice(F.col(f"{a}.n_fields"), F.col(f"{b}.n_fields"))


def ratio_band_rows(left: DataFrame, right: DataFrame, block: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """All pairs whose member counts are within twice of each other, equal in the columns `block`: u, t, and the sides' other columns as l_ and r_.

    An equi-join on binary logarithms instead of a product: the right side goes to its own and the neighbouring
    buckets of both counts, the left one to its own. What is computed from the columns of a pair needs no shuffle of pairs.
    partitions: of the join, if adaptive execution shall not choose.
    """
    block = block or []
    named = lambda df, own, mark: df.select(F.col("entity_id").alias(own), *block, *[F.col(c).alias(f"{mark}{c}") for c in df.columns if c not in ("entity_id", *block)])
    l = named(left, "u", "l_").withColumns({f"b_{c}": size_bucket(F.col(f"l_{c}")) for c in SIZES})  # noqa: E741
    r = named(right, "t", "r_")
    for c in SIZES:
        own = size_bucket(F.col(f"r_{c}"))
        buckets = F.when(own < 0, F.array(own)).otherwise(F.array(own - 1, own, own + 1))
        r = r.withColumn(f"b_{c}", F.explode(buckets))
    on = [*block, *[f"b_{c}" for c in SIZES]]
    joined = (l if partitions is None else l.repartition(partitions, *on)).join(r if partitions is None else r.repartition(partitions, *on), on)
    return joined.where(within_twice(F.col("l_n_methods"), F.col("r_n_methods")) & within_twice(F.col("l_n_fields"), F.col("r_n_fields")))


def ratio_band_pairs(left: DataFrame, right: DataFrame, block: list[str] | None = None) -> DataFrame:
    """u, t of ratio_band_rows."""
    few = lambda df: df.select("entity_id", *SIZES, *(block or []))
    return ratio_band_rows(few(left), few(right), block).select("u", "t")


def tiles(entities: DataFrame, size: int = TILE) -> DataFrame:
    """Entities that are equal in all other columns, up to `size` of them a row: those columns, and entity_id as an array."""
    what = [c for c in entities.columns if c != "entity_id"]
    place = F.row_number().over(Window.partitionBy(*what).orderBy("entity_id")) - 1
    rows = entities.withColumn("_tile", F.floor(place / size))
    return rows.groupBy(*what, "_tile").agg(F.sort_array(F.collect_list("entity_id")).alias("entity_id")).drop("_tile")


def ratio_band_tiles(left: DataFrame, right: DataFrame, block: list[str] | None = None, size: int = TILE) -> DataFrame:
    """ratio_band_rows of tiles: u and t are arrays, and each of u is a pair with each of t. `untiled` makes pairs of them.

    What is computed from a row's columns is computed once for all its pairs. A block is dealt out as a grid: each tile of one side
    goes to one of its rows, each of the other to one of its columns, so large blocks are shared by several tasks.
    """
    block = block or []
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(F.element_at("entity_id", 1)), F.lit(GRID)).cast("int")
    every = F.explode(F.array(*[F.lit(i) for i in range(GRID)]))
    l = tiles(left, size).withColumn("_row", part).withColumn("_column", every)  # noqa: E741
    r = tiles(right, size).withColumn("_column", part).withColumn("_row", every)
    # the number is given, as tiles are few bytes and much work: adaptive execution would put them into a few tasks
    return ratio_band_rows(l, r, [*block, "_row", "_column"], n)


def untiled(rows: DataFrame) -> DataFrame:
    """Pairs of rows with arrays u and t, which are columns 1 and 2. A tile's pairs stay together, so a columnar file of them is small."""
    rest = rows.columns[2:]
    return rows.select(F.explode("u").alias("u"), "t", *rest).select("u", F.explode("t").alias("t"), *rest)


def lsh_pairs(left_bands: DataFrame, right_bands: DataFrame) -> DataFrame:
    """Pairs that share a band, once each."""
    l = left_bands.select(F.col("entity_id").alias("u"), "band", "band_hash")  # noqa: E741
    r = right_bands.select(F.col("entity_id").alias("t"), "band", "band_hash")
    return l.join(r, ["band", "band_hash"]).select("u", "t").distinct()


def lsh_arity_pairs(left_bands: DataFrame, right_bands: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """lsh_pairs of similar sizes. The sizes ride along, so pairs that they reject never reach a shuffle."""
    l = left_bands.join(left.select("entity_id", *SIZES), "entity_id").withColumnRenamed("entity_id", "u").alias("l")  # noqa: E741
    r = right_bands.join(right.select("entity_id", *SIZES), "entity_id").withColumnRenamed("entity_id", "t").alias("r")
    on = (F.col("l.band") == F.col("r.band")) & (F.col("l.band_hash") == F.col("r.band_hash"))
    return l.join(r, on & _similar_sizes("l", "r")).select("u", "t").distinct()


def with_fallback(pairs: DataFrame, left: DataFrame, right: DataFrame, block: list[str] | None = None) -> DataFrame:
    """pairs, and for left entities that have none all pairs of similar sizes."""
    alone = left.join(pairs.select(F.col("u").alias("entity_id")).distinct(), "entity_id", "left_anti")
    return pairs.unionByName(ratio_band_pairs(alone, right, block))
