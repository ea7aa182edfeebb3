"""Names of members carried over to matched entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transfer_methods(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """u, ord, name, desc, to_name of all methods of matched entities.

    left, right: entity_id, ord, name, desc, fine (right also to_name, its mapped name). A method takes the name of the
    last target method with its descriptor and fingerprint, else keeps its own.
    """
    known = right.groupBy(F.col("entity_id").alias("t"), "desc", "fine").agg(F.max_by(F.coalesce("to_name", "name"), "ord").alias("to"))
    mine = left.withColumnRenamed("entity_id", "u").join(matches.select("u", "t"), "u")
    return mine.join(known, ["t", "desc", "fine"], "left").select("u", "ord", "name", "desc", F.coalesce("to", "name").alias("to_name"))


def transfer_fields(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """u, ord, name, desc, to_name of all fields of matched entities, by greedy assignment.

    left: entity_id, ord, name, desc, access, init_tag; right: entity_id, ord, to_name, desc, access, init_tag (the
    fields that the mapping names). Per descriptor, each field in order takes the first free candidate with the same
    non-zero access and the same initial value's kind, else with the same non-zero access, else the first one free,
    else keeps its name. One fold per entity and descriptor, so its state is that entity's fields of one type.
    """
    mine = left.groupBy(F.col("entity_id").alias("u"), "desc").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "access", "init_tag"))).alias("fields"))
    theirs = right.groupBy(F.col("entity_id").alias("t"), "desc").agg(F.array_sort(F.collect_list(F.struct("ord", "to_name", "access", "init_tag"))).alias("queue"))
    rows = matches.select("u", "t").join(mine, "u").join(theirs, ["t", "desc"], "left")
    queue_type = "array<struct<ord: long, to_name: string, access: int, init_tag: int>>"
    out_type = "array<struct<ord: long, name: string, to_name: string>>"
    rows = rows.withColumn("queue", F.coalesce(F.col("queue").cast(queue_type), F.array().cast(queue_type)))

    def step(acc, f):
        free = acc["queue"]
        same = F.filter(free, lambda c: (c["access"] == f["access"]) & (f["access"] != 0))
        alike = F.filter(same, lambda c: c["init_tag"] == f["init_tag"])
        best = F.coalesce(F.get(alike, F.lit(0)), F.get(same, F.lit(0)), F.get(free, F.lit(0)))
        rest = F.filter(free, lambda c: best.isNull() | (c["ord"] != best["ord"]))
        done = F.concat(acc["out"], F.array(F.struct(f["ord"].cast("long").alias("ord"), f["name"].alias("name"), F.coalesce(best["to_name"], f["name"]).alias("to_name"))))
        return F.struct(rest.alias("queue"), done.cast(out_type).alias("out"))

    start = F.struct(F.col("queue"), F.array().cast(out_type).alias("out"))
    folded = rows.select("u", "desc", F.explode(F.aggregate("fields", start, step, lambda a: a["out"])).alias("f"))
    return folded.select("u", "f.ord", "f.name", "desc", "f.to_name")
