"""Names by mapping: exact, then unique by name, then unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_class(queries: DataFrame, classes: DataFrame, column: str = "name", out: str = "mapped") -> DataFrame:
    """Adds to_name of the class with that from_name, or the name itself."""
    known = classes.select(F.col("from_name").alias(column), F.col("to_name").alias("_to"))
    return queries.join(known, column, "left").withColumn(out, F.coalesce("_to", column)).drop("_to")


def map_member(queries: DataFrame, members: DataFrame) -> DataFrame:
    """queries: owner, kind, name, desc, and more -> the same with mapped.

    The member with that descriptor; else the only one of that name in the owner; else the name.
    """
    exact = members.select(F.col("from_class").alias("owner"), "kind", F.col("from_name").alias("name"), "desc", F.col("to_name").alias("_exact"))
    unique = members.groupBy(F.col("from_class").alias("owner"), "kind", F.col("from_name").alias("name")).agg(F.count("*").alias("_n"), F.max("to_name").alias("_only"))
    unique = unique.where("_n = 1").drop("_n")
    found = queries.join(exact, ["owner", "kind", "name", "desc"], "left").join(unique, ["owner", "kind", "name"], "left")
    return found.withColumn("mapped", F.coalesce("_exact", "_only", "name")).drop("_exact", "_only")
