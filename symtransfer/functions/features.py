"""Features of entities and members, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JVM opcodes by category; every other opcode is category OTHER.
CATEGORY_OPCODES = {
    0: [*range(1, 19), *range(21, 26), *range(46, 54), 190],  # load
    1: [*range(54, 59), *range(79, 87)],  # store
    2: [*range(96, 153)],  # arithmetic
    3: [*range(153, 172), 198, 199],  # branch
    4: [*range(172, 178)],  # return
    5: [*range(182, 187)],  # invoke
    6: [*range(178, 182)],  # field
    7: [187, 188, 189, 192, 193],  # new and types
    8: [191],  # throw
    9: [194, 195, 197],  # monitor, multianewarray
}
OTHER, CATEGORIES = 10, 11
# Prefixes of the platform's own class names.
PLATFORM = ("java/", "javax/", "sun/", "com/sun/", "jdk/")
PRIMITIVES = "IJSBCZFDV"


def opcode_table() -> list[int]:
    """Category of each opcode from 0 to 255."""
    table = [OTHER] * 256
    for category, opcodes in CATEGORY_OPCODES.items():
        for op in opcodes:
            table[op] = category
    return table


def opcode_category(op: Column) -> Column:
    table = F.array(*[F.lit(c) for c in opcode_table()])
    return F.when((op >= 0) & (op <= 255), F.element_at(table, op.cast("int") + 1)).otherwise(F.lit(OTHER))


def category_histogram(ops: Column) -> Column:
    """Coarse fingerprint: how many opcodes of each category, as one text."""
    categories = F.transform(ops, opcode_category)
    counts = F.transform(F.sequence(F.lit(0), F.lit(CATEGORIES - 1)), lambda c: F.size(F.filter(categories, lambda x: x == c)))
    return F.array_join(F.transform(counts, lambda n: n.cast("string")), ",")


def fine_fingerprint(ops: Column, tags: Column) -> Column:
    """Hash of the opcodes in order with their operand tags; 0 without opcodes. Only its equality counts."""
    return F.when(F.size(ops) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(ops, tags))


def profile_hash(n_params: Column, insn_count: Column, max_stack: Column, max_locals: Column) -> Column:
    """Hash of a method's outline."""
    return F.xxhash64(n_params, insn_count, max_stack, max_locals)


def fold32(h: Column) -> Column:
    """A 64-bit hash folded to 32 bits, as an unsigned long."""
    return h.bitwiseXOR(F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(0xFFFFFFFF))


def flag_overlap(a: Column, b: Column) -> Column:
    """Shared bits over all bits; 1 if neither has any. 32-bit flags."""
    mask = F.lit(0xFFFFFFFF)
    both = F.bit_count(a.cast("long").bitwiseAND(b.cast("long")).bitwiseAND(mask))
    any_ = F.bit_count(a.cast("long").bitwiseOR(b.cast("long")).bitwiseAND(mask))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def is_platform(name: Column) -> Column:
    out = F.lit(False)
    for p in PLATFORM:
        out = out | name.startswith(p)
    return F.coalesce(out, F.lit(False))


def reference_set(super_name: Column, interfaces: Column) -> Column:
    """S: and I: names that belong to the platform."""
    own = F.when(is_platform(super_name), F.array(F.concat(F.lit("S:"), super_name))).otherwise(F.array().cast("array<string>"))
    others = F.transform(F.filter(F.coalesce(interfaces, F.array().cast("array<string>")), is_platform), lambda x: F.concat(F.lit("I:"), x))
    return F.array_distinct(F.concat(own, others))


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; 1 if both are 0, 0 if one is."""
    return F.when((a == 0) & (b == 0), F.lit(1.0)).when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))


def dice(overlap: Column, a: Column, b: Column) -> Column:
    """1 if both sides are empty."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise(2.0 * overlap / (a + b))


def set_dice(a: Column, b: Column, neutral: float = 0.5) -> Column:
    """Of two sets; `neutral` if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(neutral)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def within_twice(a: Column, b: Column) -> Column:
    """The larger is at most twice the smaller; 0 goes with 0 alone."""
    return F.least(a, b) * 2 >= F.greatest(a, b)


def size_bucket(n: Column) -> Column:
    """Whole binary logarithm; -9 for 0. Sizes within twice of each other are in the same or neighbouring buckets."""
    return F.when(n <= 0, F.lit(-9)).otherwise(F.length(F.bin(n.cast("long"))) - 1).cast("int")


def percent(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100.0)


def status(score: Column, target_from: Column, target_to: Column) -> Column:
    return F.when(score <= 0, "Unmatched").when(target_from == target_to, "Identity").otherwise("Matched")


def escape_name(name: Column) -> Column:
    """Backslash, tab, newline and carriage return as two characters; null is empty."""
    out = F.coalesce(name, F.lit(""))
    for plain, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out


def unescape_name(name: Column) -> Column:
    hidden = F.replace(name, F.lit("\\\\"), F.lit("\x00"))
    for plain, mark in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        hidden = F.replace(hidden, F.lit(mark), F.lit(plain))
    return F.replace(hidden, F.lit("\x00"), F.lit("\\"))


def internal_name(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit("/"))


def looks_like_descriptor(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[(\[L]|\A[" + PRIMITIVES + r"]\z"), F.lit(False))


def looks_like_integer(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A-?[0-9]+\z"), F.lit(False))


def base_hash(text: Column) -> Column:
    """A signed 32-bit hash that other engines have too."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") - F.lit(2147483648)
