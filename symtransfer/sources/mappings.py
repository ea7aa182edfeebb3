"""Symbol-mapping text files: six formats, told apart by their first lines.

A file becomes two frames: classes (from_name, to_name, identity, ord) and members (from_class, kind m or f, from_name,
desc, to_name, ord). Lines of all formats but one are read by column expressions: a window carries the class of a member
line down. The arrow format's nested classes depend on a stack of lines, so one Python pass over each file reads those.
A mapping file describes one archive, so it is bounded, and its lines stay in order in one task. `register` adds readers.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import PRIMITIVES, looks_like_descriptor, looks_like_integer, unescape_name
from ..operators.merge import last_wins, reset_members

LOG = logging.getLogger(__name__)
HEAD = 8
NO_METHOD, NO_FIELD = "()V", "I"

# Source names of primitive types, and their letters.
PRIMITIVE_NAMES = {"int": "I", "long": "J", "short": "S", "byte": "B", "char": "C", "boolean": "Z", "float": "F", "double": "D", "void": "V"}


def _starts(line: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | line.startswith(p)
    return out


# The marks that formats start with.
_TINY2, _TINY1, _TSRG2, _SRG, _ARROW_NOTE = ("tiny\t2\t", "tiny 2 "), ("tiny\t1\t", "tiny 1 "), ("tsrg2\t", "tsrg2 "), ("CL:", "FD:", "MD:"), "# mapping file"


def _first(head: Column) -> Column:
    return F.coalesce(F.get(head, F.lit(0)), F.lit(""))


def _fits_tsrg1(head: Column) -> Column:
    first, second = _first(head), F.get(head, F.lit(1))
    return first.contains("\t") & ~_starts(first, *_TSRG2, "tiny\t", "tiny ", *_SRG, "#") & (second.isNull() | second.startswith("\t"))


def _fits_srg(head: Column) -> Column:
    some = F.filter(F.transform(head, F.trim), lambda x: (x != "") & ~x.startswith("#"))
    return _starts(F.get(some, F.lit(0)), *_SRG)


def _fits_arrow(head: Column) -> Column:
    return F.exists(head, lambda x: (x.contains(" -> ") & F.trim(x).endswith(":")) | x.startswith(_ARROW_NOTE))


def line_format(head: Column) -> Column:
    """The first registered format that the first lines (an array) show; null for none."""
    return F.get(fitting_formats(head), F.lit(0))


def fitting_formats(head: Column) -> Column:
    """All registered formats that the first lines fit, in the order of registration."""
    return F.array_compact(F.array(*[F.when(F.coalesce(r.fits(head), F.lit(False)), F.lit(r.format)) for r in _READERS.values()]))


def guess_by_name(path: Column) -> Column:
    """What a file's name suggests; only to be shown."""
    low = F.lower(path)
    return F.when(low.endswith(".tiny"), "tiny").when(low.endswith(".tsrg"), "tsrg").when(low.endswith(".srg"), "srg").when(low.endswith(".txt"), "mojang").otherwise("unknown")


def owner_and_member(name: Column) -> tuple[Column, Column]:
    """Cut at the last slash; without one, the name is both."""
    cut = name.contains("/")
    return F.when(cut, F.regexp_extract(name, "(?s)^(.*)/([^/]*)$", 1)).otherwise(name), F.when(cut, F.regexp_extract(name, "(?s)^(.*)/([^/]*)$", 2)).otherwise(name)


def strip_generics(text: Column, nested: bool = False) -> Column:
    """Without what is in angle brackets: from the first < to the last >, or (nested) each bracket on its own."""
    if nested:
        for _ in range(8):
            text = F.regexp_replace(text, "<[^<>]*>", "")
        return text
    return F.regexp_replace(F.regexp_replace(text, "(?s)<.*>", ""), "(?s)<.*$", "")


def field_descriptor(name: Column, nested: bool = False) -> Column:
    """A source type name as a descriptor; empty is the root class."""
    bare = F.trim(strip_generics(name, nested))
    dims = F.regexp_extract(bare, r"((?:\s*\[\])*)$", 1)
    depth = F.expr("0") + F.length(F.regexp_replace(dims, r"\s", "")) / 2
    base = F.trim(F.regexp_replace(bare, r"(?:\s*\[\])+$", ""))
    letter = F.when(F.lit(False), "")
    for word, mark in PRIMITIVE_NAMES.items():
        letter = letter.when(base == word, mark)
    letter = letter.otherwise(F.concat(F.lit("L"), F.replace(base, F.lit("."), F.lit("/")), F.lit(";")))
    return F.when(bare == "", F.lit("Ljava/lang/Object;")).otherwise(F.concat(F.repeat(F.lit("["), depth.cast("int")), letter))


def method_descriptor(returns: Column, params: Column, nested: bool = False) -> Column:
    inner = strip_generics(F.regexp_replace(F.regexp_replace(params, r"^\(", ""), r"\)$", ""), nested)
    args = F.filter(F.transform(F.split(inner, ","), F.trim), lambda x: x != "")
    return F.concat(F.lit("("), F.array_join(F.transform(args, lambda x: field_descriptor(x, nested)), ""), F.lit(")"), field_descriptor(returns, nested))


@dataclass
class Mapping:
    classes: DataFrame
    members: DataFrame
    namespaces: tuple[str, str] = ("obfuscated", "named")
    format: str = ""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("ord", "line"))


def _parts(line: Column) -> Column:
    """Columns of a tab-separated line; empty ones at its end don't count."""
    return F.split(F.regexp_replace(line, "\t+$", ""), "\t")


_NONE = "CAST(NULL AS STRING)"


def _class_row(ok: Column, frm: Column, to: Column):
    return F.when(ok, F.struct(F.lit("c").alias("kind"), F.expr(_NONE).alias("owner"), F.expr(_NONE).alias("owner_to"), frm.alias("name"), F.expr(_NONE).alias("desc"), to.alias("to")))


def _member_row(ok: Column, kind: Column, name: Column, desc: Column, to: Column, owner: Column | None = None, owner_to: Column | None = None):
    owner = F.expr(_NONE) if owner is None else owner
    owner_to = F.expr(_NONE) if owner_to is None else owner_to
    return F.when(ok, F.struct(kind.alias("kind"), owner.alias("owner"), owner_to.alias("owner_to"), name.alias("name"), desc.alias("desc"), to.alias("to")))


def _kind_of(desc: Column) -> Column:
    return F.when(desc.startswith("("), "m").otherwise("f")


def _tiny_v2(line: Column):
    p, n = _parts(line), F.size(_parts(line))
    at = lambda i: F.get(p, F.lit(i))
    full = (n >= 5) & looks_like_descriptor(at(3))
    fallback = F.when(at(1) == "m", NO_METHOD).otherwise(NO_FIELD)
    member = (at(0) == "") & at(1).isin("m", "f") & (n >= 4)
    return F.coalesce(_class_row((n >= 3) & (at(0) == "c"), at(1), at(2)), _member_row(member, at(1), at(2), F.when(full, at(3)).otherwise(fallback), F.when(full, at(4)).otherwise(at(3))))


def _plain(line: Column, described: int):
    """Class lines of two columns; indented member lines of name, new name and a descriptor that may be missing."""
    p, n = _parts(line), F.size(_parts(line))
    at = lambda i: F.get(p, F.lit(i))
    desc = F.when(n >= described, at(3)).otherwise(NO_METHOD)
    indented = line.startswith("\t")
    return F.coalesce(_class_row(~indented & (n >= 2), at(0), at(1)), _member_row(indented & (n >= 3), _kind_of(desc), at(1), desc, at(2)))


def _tsrg_v2(line: Column):
    p, n = _parts(line), F.size(_parts(line))
    at = lambda i: F.get(p, i)
    one = F.lit(1)
    c = F.when(at(F.lit(0)) == "c", 1).otherwise(0)
    indented = line.startswith("\t")
    marked = F.coalesce(at(one).isin("m", "f"), F.lit(False))
    i = F.when(marked, 2).otherwise(1)
    follow, third, fourth = at(i + 1), at(i + 2), at(i + 3)
    # without a descriptor an unmarked member counts as a field, a marked one as its mark says
    placeholder = F.when(at(one) == "m", NO_METHOD).otherwise(NO_FIELD)
    numbered = looks_like_integer(follow) & (n >= i + 3)
    after = (n >= i + 3) & looks_like_descriptor(third)
    before = (n >= i + 3) & looks_like_descriptor(follow)
    to = F.when(numbered, third).when(after, follow).when(before, third).otherwise(follow)
    desc = F.when(numbered, F.coalesce(fourth, placeholder)).when(after, third).when(before, follow).otherwise(placeholder)
    kind = F.when(marked, at(one)).otherwise(_kind_of(desc))
    return F.coalesce(_class_row(~indented & (n >= c + 2), at(c), at(c + 1)), _member_row(indented & (n >= 3) & (n >= i + 2), kind, at(i), desc, to))


def _srg(line: Column):
    p = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")
    n = F.size(p)
    at = lambda i: F.get(p, F.lit(i))
    fd, md = (at(0) == "FD:") & (n >= 3), (at(0) == "MD:") & (n >= 5)
    owner, name = owner_and_member(at(1))
    owner_to, to = owner_and_member(F.when(fd, at(2)).otherwise(at(3)))
    kind = F.when(fd, "f").otherwise("m")
    desc = F.when(fd, NO_FIELD).otherwise(at(2))
    return F.coalesce(_class_row((at(0) == "CL:") & (n >= 3), at(1), at(2)), _member_row(fd | md, kind, name, desc, to, owner, owner_to))


def arrow_rows(text: str) -> list[tuple]:
    """ord, kind, owner, owner_to, name, return or field type, parameters (null for fields and classes), to; of one arrow-format file.

    Nested classes are told by $ in the original name; an obfuscated one that doesn't start with its outer's name is
    appended to it.
    """
    out, stack = [], []

    def chain(names: list[str]) -> str:
        path = ""
        for name in names:
            path = name if not path or name.startswith(path) else f"{path}${name.rpartition('.')[2]}"
        return path.replace(".", "/")

    for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        body = line.strip()
        if not body or line.startswith("#"):
            continue
        if not line[0].isspace():
            head, arrow, to = body.removesuffix(":").strip().partition(" -> ")
            if not body.endswith(":") or not arrow:
                continue
            del stack[head.count("$") :]
            stack.append((head.strip(), to.strip()))
            out.append((i, "c", None, None, chain([s[1] for s in stack]), None, None, chain([s[0] for s in stack])))
            continue
        digits, colon, rest = body.partition(":")
        if colon and digits.isdigit():
            more, colon, tail = rest.partition(":")
            body = (tail if colon and more.isdigit() else rest).strip()
        left, arrow, to = body.partition(" -> ")
        left, to = left.strip(), to.strip()
        if not arrow or not left or not to or not stack:
            continue
        owner, owner_to = chain([s[1] for s in stack]), chain([s[0] for s in stack])
        head, paren, args = left.partition("(")
        kind, _, name = head.rpartition(" ")
        if paren:
            out.append((i, "m", owner, owner_to, to, kind.strip() or "void", paren + args, name.strip()))
        elif kind:
            out.append((i, "f", owner, owner_to, to, kind.strip(), None, name.strip()))
    return out


_ARROW = "ord int, kind string, owner string, owner_to string, name string, type string, params string, to string"


def _arrow(spark: SparkSession, path: str, nested: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [r for t in batch["value"].to_pylist() for r in arrow_rows(t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int32()), *(pa.array(list(c), pa.string()) for c in columns[1:])], names=[x.split()[0] for x in _ARROW.split(", ")])

    rows = spark.read.text(path, wholetext=True).mapInArrow(run, _ARROW)
    desc = F.when(F.col("kind") == "m", method_descriptor(F.col("type"), F.col("params"), nested)).when(F.col("kind") == "f", field_descriptor(F.col("type"), nested))
    return rows.select("ord", "kind", "owner", "owner_to", "name", desc.alias("desc"), "to")


@dataclass(frozen=True)
class Reader:
    """fits: a column of the first lines (an array) -> whether they show this format.

    rows: (session, path, lines with ord and line, nested_generics) -> ord, kind (c, f or m), owner, owner_to (null for
    classes), name, desc, to.
    """

    format: str
    display: str
    fits: Callable[[Column], Column]
    rows: Callable[[SparkSession, str, DataFrame, bool], DataFrame]


_READERS: dict[str, Reader] = {}


def register(reader: Reader) -> None:
    """Adds a reader after the others; one of a known format takes that one's place."""
    _READERS[reader.format] = reader


def unregister(format: str) -> None:
    _READERS.pop(format, None)


def readers() -> list[Reader]:
    return list(_READERS.values())


def _by_line(parse: Callable[[Column], Column], header: bool = True):
    """Class lines and, below them, member lines that a window gives their class; after the header, if there is one."""

    def rows(spark: SparkSession, path: str, lines: DataFrame, nested: bool) -> DataFrame:
        body = lines.where("line != ''").where(F.col("ord") > (0 if header else -1))
        found = body.select("ord", parse(F.col("line")).alias("r")).where("r IS NOT NULL").select("ord", "r.*")
        before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        carry = lambda c: F.last(F.when(F.col("kind") == "c", F.col(c)), ignorenulls=True).over(before)
        return found.withColumn("owner", carry("name")).withColumn("owner_to", carry("to")).where("kind = 'c' OR owner IS NOT NULL")

    return rows


def _srg_rows(spark: SparkSession, path: str, lines: DataFrame, nested: bool) -> DataFrame:
    body = lines.where("line != ''").where(~F.trim("line").startswith("#"))
    return body.select("ord", _srg(F.col("line")).alias("r")).where("r IS NOT NULL").select("ord", "r.*")


register(Reader("tiny-v2", "Tiny v2", lambda head: _starts(_first(head), *_TINY2), _by_line(_tiny_v2)))
register(Reader("tiny-v1", "Tiny v1", lambda head: _starts(_first(head), *_TINY1), _by_line(lambda x: _plain(x, 4))))
register(Reader("tsrg-v2", "TSRG v2", lambda head: _starts(_first(head), *_TSRG2), _by_line(_tsrg_v2)))
register(Reader("tsrg-v1", "TSRG v1", _fits_tsrg1, _by_line(lambda x: _plain(x, 4), header=False)))
register(Reader("srg", "SRG", _fits_srg, _srg_rows))
register(Reader("mojang", "ProGuard", _fits_arrow, lambda spark, path, lines, nested: _arrow(spark, path, nested)))
FORMATS = tuple(_READERS)


def _namespaces(kind: str, header: str) -> tuple[str, str]:
    h = header.rstrip("\t").split("\t")
    at = {"tiny-v2": 3, "tiny-v1": 2}.get(kind)
    if kind == "tsrg-v2":
        at = 2 if len(h) > 1 and h[1].isdigit() else 1
    if at is None or len(h) <= at:
        return "obfuscated", "named"
    return h[at], h[at + 1] if len(h) > at + 1 else "named"


def read_mapping(spark: SparkSession, path: str, unescape: bool = False, nested_generics: bool = False, format: str | None = None) -> Mapping:
    """One mapping file. Unless a format is given, readers whose format the first lines fit are tried in order; one that
    fails is logged and passed over. ValueError if none fits or all fail; a member without a name is a failure.

    A later class row replaces the class with its members; later members replace earlier ones, at the earlier place.
    """
    lines = _lines(spark, path)
    head = [r.line for r in lines.where(F.col("ord") < HEAD).orderBy("ord").collect()]
    if format is not None:
        return _read(spark, path, lines, head, _READERS[format], unescape, nested_generics)
    failed = []
    for name in spark.createDataFrame([(head,)], "head array<string>").select(fitting_formats(F.col("head"))).first()[0]:
        try:
            return _read(spark, path, lines, head, _READERS[name], unescape, nested_generics)
        except Exception as e:  # noqa: BLE001 - whatever a reader, registered ones included, can't read is left to the next
            LOG.warning("reader %s rejected %s: %s", name, path, e)
            failed.append(f"{name}: {e}")
    raise ValueError("; ".join([f"could not auto-detect the format of {path}; supported: {', '.join(r.display for r in readers())}", *failed]))


def _read(spark: SparkSession, path: str, lines: DataFrame, head: list[str], reader: Reader, unescape: bool, nested_generics: bool) -> Mapping:
    rows = reader.rows(spark, path, lines, nested_generics)
    if unescape:
        for c in ("owner", "owner_to", "name", "to"):
            rows = rows.withColumn(c, unescape_name(F.col(c)))
    rows = rows.withColumn("ord", F.col("ord").cast("long"))
    put = rows.where("kind = 'c'").select(F.col("name").alias("from_name"), F.col("to").alias("to_name"), "ord")
    touched = rows.where("kind != 'c'").select(F.col("owner").alias("from_name"), F.col("owner_to").alias("to_name"), "ord")
    classes = last_wins(put.unionByName(touched), ["from_name"], "ord", "first").select("from_name", "to_name", F.lit(False).alias("identity"), F.col("first").alias("ord"))
    members = rows.where("kind != 'c'").select(F.col("owner").alias("from_class"), "kind", F.col("name").alias("from_name"), "desc", F.col("to").alias("to_name"), "ord")
    if not members.where("from_name = '' OR from_name IS NULL").isEmpty():
        raise ValueError(f"{path} has a member without a name")
    members = last_wins(reset_members(put, members), ["from_class", "kind", "from_name", "desc"], "ord", "first")
    members = members.select("from_class", "kind", "from_name", "desc", "to_name", F.col("first").alias("ord"))
    return Mapping(classes, members, _namespaces(reader.format, head[0] if head else ""), reader.format)


assert set(PRIMITIVE_NAMES.values()) == set(PRIMITIVES)
