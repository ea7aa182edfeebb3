"""The tab-separated mapping file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import escape_name


def _joined(*columns: Column) -> Column:
    return F.concat_ws("\t", *columns)


def class_line(name: Column, to: Column) -> Column:
    return _joined(F.lit("c"), escape_name(name), escape_name(to))


def member_line(kind: Column, name: Column, desc: Column, to: Column) -> Column:
    return F.concat(F.lit("\t"), _joined(kind, escape_name(name), escape_name(desc), escape_name(to)))


def lines(classes: DataFrame, members: DataFrame) -> DataFrame:
    """line with class_ord, kind_ord (class, methods, fields) and ord; classes without a name, and their members, are left out."""
    named = classes.where("trim(from_name) != ''").select("from_name", "to_name", F.col("ord").alias("class_ord"))
    head = named.select("class_ord", F.col("from_name").alias("owner"), F.lit(0).alias("kind_ord"), F.lit(0).cast("long").alias("ord"), class_line(F.col("from_name"), F.col("to_name")).alias("line"))
    rows = members.join(named.select(F.col("from_name").alias("from_class"), "class_ord"), "from_class")
    kind_ord = F.when(F.col("kind") == "m", 1).otherwise(2)
    rows = rows.select("class_ord", F.col("from_class").alias("owner"), kind_ord.alias("kind_ord"), "ord", member_line(F.col("kind"), F.col("from_name"), F.col("desc"), F.col("to_name")).alias("line"))
    return head.unionByName(rows)


def write_tiny(classes: DataFrame, members: DataFrame, path: str, namespaces: tuple[str, str] = ("obfuscated", "named")) -> dict[str, int]:
    """One file, written by the driver from a sorted stream of lines. Returns the counts of classes, methods and fields."""
    escape = str.maketrans({"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"})
    count = [0, 0, 0]
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    ordered = lines(classes, members).orderBy("class_ord", "owner", "kind_ord", "ord").select("kind_ord", "line")
    with target.open("w", encoding="utf-8", newline="\n") as f:
        f.write("\t".join(["tiny", "2", "0", *(n.translate(escape) for n in namespaces)]) + "\n")
        for row in ordered.toLocalIterator():
            f.write(row.line + "\n")
            count[row.kind_ord] += 1
    return dict(zip(("classes", "methods", "fields"), count, strict=True))
