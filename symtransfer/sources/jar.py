"""JAR archives as entities and members."""

from __future__ import annotations

import io
import re
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import PLATFORM, category_histogram, fine_fingerprint, reference_set
from ..plans.frontends import Side, with_sizes
from .classfile import ClassFormatError, decode

ROWS = (
    "entity_id string, ord long, access int, super string, interfaces array<string>, error string, "
    "members array<struct<kind: string, ord: long, name: string, desc: string, access: int, init_tag: int, max_stack: int, max_locals: int, ops: array<int>, tags: array<string>>>"
)
_MEMBER = pa.struct([
    ("kind", pa.string()), ("ord", pa.int64()), ("name", pa.string()), ("desc", pa.string()), ("access", pa.int32()), ("init_tag", pa.int32()),
    ("max_stack", pa.int32()), ("max_locals", pa.int32()), ("ops", pa.list_(pa.int32())), ("tags", pa.list_(pa.string())),
])
_SCHEMA = pa.schema([("entity_id", pa.string()), ("ord", pa.int64()), ("access", pa.int32()), ("super", pa.string()), ("interfaces", pa.list_(pa.string())), ("error", pa.string()), ("members", pa.list_(_MEMBER))])


def _class_row(name: str, ord_: int, data: bytes, drop_dynamic: bool) -> dict:
    try:
        c = decode(data, drop_dynamic)
    except ClassFormatError as e:
        return {"entity_id": name.removesuffix(".class"), "ord": ord_, "access": None, "super": None, "interfaces": None, "error": str(e), "members": []}
    members = []
    for kind, found in (("f", c["fields"]), ("m", c["methods"])):
        for i, ((n, d), x) in enumerate(found.items()):
            members.append({"kind": kind, "ord": i, "name": n, "desc": d, "access": x["access"], "init_tag": x.get("init_tag", 0), "max_stack": x.get("max_stack", 0), "max_locals": x.get("max_locals", 0), "ops": x.get("ops", []), "tags": x.get("tags", [])})
    return {"entity_id": c["name"], "ord": ord_, "access": c["access"], "super": c["super"], "interfaces": c["interfaces"], "error": None, "members": members}


def scan(spark: SparkSession, path: str, drop_dynamic: bool = False) -> DataFrame:
    """One row per class entry, in order, of a JAR (or several, by a pattern). Unreadable ones have an error and no members; a file that is no archive is one such row without a name."""

    def run(batches):
        for batch in batches:
            for content in batch["content"].to_pylist():
                rows = []
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, OSError, ValueError, struct.error) as e:
                    yield pa.RecordBatch.from_pylist([{"entity_id": None, "ord": -1, "error": f"no archive: {e}", "members": []}], schema=_SCHEMA)
                    continue
                with archive as z:
                    for i, entry in enumerate(z.infolist()):
                        if not entry.filename.endswith(".class"):
                            continue
                        try:
                            row = _class_row(entry.filename, i, z.read(entry), drop_dynamic)
                        except Exception as e:  # noqa: BLE001 - damaged, encrypted or of an unknown method: whatever is wrong with one entry, the others are read
                            row = {"entity_id": entry.filename.removesuffix(".class"), "ord": i, "error": f"{type(e).__name__}: {e}", "members": []}
                        rows.append(row)
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ROWS)


def read_jar(spark: SparkSession, path: str, drop_dynamic: bool = False, canonical_descriptors: bool = False) -> Side:
    """Entities and members of all readable classes; of classes with one name the last one.

    canonical_descriptors: class names outside the platform count as one in descriptors and operand tags of fingerprints.
    """
    rows = scan(spark, path, drop_dynamic).where("error IS NULL")
    columns = [c for c in rows.columns if c not in ("entity_id", "error")]
    rows = rows.groupBy("entity_id").agg(F.max_by(F.struct(*columns), "ord").alias("r")).select("entity_id", "r.*")
    member = rows.select("entity_id", F.explode("members").alias("m")).select("entity_id", "m.*")
    tags, desc = F.col("tags"), F.col("desc")
    if canonical_descriptors:
        other = "L(?!" + "|".join(re.escape(p) for p in PLATFORM) + ")[^;]+;"
        plain = lambda x: F.regexp_replace(x, other, "Lx;")
        tags, desc = F.transform(tags, plain), plain(desc)
    member = member.select(
        "entity_id", "kind", "ord", "name", desc.alias("desc"), "access", fine_fingerprint(F.col("ops"), tags).alias("fine"), category_histogram(F.col("ops")).alias("coarse"),
        "init_tag", F.size("ops").alias("insn_count"), "max_stack", "max_locals",
    )
    entity = rows.select("entity_id", "ord", F.col("access").alias("flags"), "super", "interfaces", reference_set(F.col("super"), F.col("interfaces")).alias("refs"))
    return Side(with_sizes(entity, member), member)


def in_order(side: Side) -> DataFrame:
    """Entities in the archive's order."""
    return side.entity.orderBy("ord")


def read_entry(spark: SparkSession, path: str, name: str) -> DataFrame:
    """data of the entry with that name: one row, or none."""

    def run(batches):
        for batch in batches:
            for content in batch["content"].to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if name in z.namelist():
                        yield pa.RecordBatch.from_arrays([pa.array([z.read(name)], pa.binary())], names=["data"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "data binary")
