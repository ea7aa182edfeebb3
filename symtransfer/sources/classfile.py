"""Class files: their structure decoded, and their names rewritten, from bytes alone."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

# Bytes of a constant after its tag, by tag (1, text, has its own length).
_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
# Kind of a loaded constant by its tag.
_LOADED = {3: 1, 4: 2, 5: 3, 6: 4, 8: 5, 7: 6, 16: 6, 15: 7, 17: 8}
#: Kind of a field's initial constant by its tag.
INITIAL = {3: 1, 4: 2, 5: 3, 6: 4, 8: 5}


class ClassFormatError(ValueError):
    pass


def operand_sizes() -> list[int]:
    """Operand bytes of each opcode; -1 for those with a size of their own, and for reserved ones."""
    size = [0] * 202 + [-1] * 54
    for ops, n in (([16, 18, 188, *range(21, 26), *range(54, 59), 169], 1), ([17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199], 2), ([197], 3), ([185, 186, 200, 201], 4), ([170, 171, 196], -1)):
        for op in ops:
            size[op] = n
    return size


_OPERANDS = operand_sizes()


def plain_opcode(op: int) -> int:
    """Short forms as their long ones: load_n, store_n, wide constants and wide jumps."""
    if 26 <= op <= 45:
        return 21 + (op - 26) // 4
    if 59 <= op <= 78:
        return 54 + (op - 59) // 4
    return {19: 18, 20: 18, 200: 167, 201: 168}.get(op, op)


def _text(raw: bytes) -> str:
    """Modified UTF-8."""
    return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")


def _raw(text: str) -> bytes:
    units = text.encode("utf-16-be", "surrogatepass")
    return "".join(chr(u) for (u,) in struct.iter_unpack(">H", units)).encode("utf-8", "surrogatepass").replace(b"\0", b"\xc0\x80")


@dataclass
class Attribute:
    name: str
    start: int  # of its contents
    size: int


@dataclass
class Member:
    access: int
    name: int
    desc: int
    at: int  # where its three indices start
    attributes: list[Attribute]


@dataclass
class ClassFile:
    data: bytes
    pool: list[tuple[int, int]] = field(default_factory=list)  # tag and place of what follows it
    body: int = 0

    def __post_init__(self) -> None:
        try:
            self._read()
        except (struct.error, IndexError, UnicodeDecodeError) as e:
            raise ClassFormatError(f"truncated or malformed class: {e}") from e

    def u2(self, at: int) -> int:
        return struct.unpack_from(">H", self.data, at)[0]

    def u4(self, at: int) -> int:
        return struct.unpack_from(">I", self.data, at)[0]

    def _read(self) -> None:
        if self.u4(0) != 0xCAFEBABE:
            raise ClassFormatError("no class file")
        count, at = self.u2(8), 10
        self.pool = [(0, 0)]
        while len(self.pool) < count:
            tag = self.data[at]
            self.pool.append((tag, at + 1))
            at += 3 + self.u2(at + 1) if tag == 1 else 1 + _SIZES.get(tag, -1)
            if tag != 1 and tag not in _SIZES:
                raise ClassFormatError(f"constant of kind {tag}")
            if tag in (5, 6):
                self.pool.append((0, 0))
        self.body = at
        self.access, self.this, self.super_ = self.u2(at), self.u2(at + 2), self.u2(at + 4)
        n = self.u2(at + 6)
        self.interfaces = [self.u2(at + 8 + 2 * i) for i in range(n)]
        at += 8 + 2 * n
        self.fields, at = self._members(at)
        self.methods, at = self._members(at)
        self.attributes, at = self._attributes(at)
        if at > len(self.data):
            raise ClassFormatError("truncated class")

    def _attributes(self, at: int) -> tuple[list[Attribute], int]:
        out = []
        for _ in range(self.u2(at)):
            size = self.u4(at + 4)
            out.append(Attribute(self.utf8(self.u2(at + 2)), at + 8, size))
            at += 6 + size
        return out, at + 2

    def _members(self, at: int) -> tuple[list[Member], int]:
        out, n = [], self.u2(at)
        at += 2
        for _ in range(n):
            start = at
            attributes, at = self._attributes(at + 6)
            out.append(Member(self.u2(start), self.u2(start + 2), self.u2(start + 4), start, attributes))
        return out, at

    def utf8(self, i: int) -> str:
        tag, at = self.pool[i]
        if tag != 1:
            raise ClassFormatError(f"constant {i} is no text")
        return _text(self.data[at + 2 : at + 2 + self.u2(at)])

    def name(self, i: int) -> str | None:
        """Of a class constant; 0 has none."""
        return self.utf8(self.u2(self.pool[i][1])) if i else None

    def name_and_type(self, i: int) -> tuple[str, str]:
        """Of the member or dynamic constant i."""
        at = self.pool[self.u2(self.pool[i][1] + 2)][1]
        return self.utf8(self.u2(at)), self.utf8(self.u2(at + 2))

    def instructions(self, start: int, size: int):
        """Opcode and place of each instruction of a code attribute's contents."""
        at, end = start, start + size
        while at < end:
            op = self.data[at]
            yield op, at
            if op == 196:
                at += 6 if self.data[at + 1] == 132 else 4
            elif op in (170, 171):
                fixed = at + 1 + (3 - (at - start)) % 4
                n = self.u4(fixed + 8) - self.u4(fixed + 4) + 1 if op == 170 else 2 * self.u4(fixed + 4)
                at = fixed + (12 if op == 170 else 8) + 4 * (n & 0xFFFFFFFF)
            elif (n := _OPERANDS[op]) < 0:
                raise ClassFormatError(f"opcode {op}")
            else:
                at += 1 + n


def _code(c: ClassFile, m: Member) -> tuple[int, int, list[int], list[str], bool]:
    """Most stack, most locals, opcodes, their operand tags, and whether there is a dynamic call."""
    for a in m.attributes:
        if a.name == "Code":
            ops, tags, dynamic = [], [], False
            for op, at in c.instructions(a.start + 8, c.u4(a.start + 4)):
                plain = plain_opcode(c.data[at + 1]) if op == 196 else plain_opcode(op)
                tag = ""
                if plain == 18:
                    index = c.data[at + 1] if op == 18 else c.u2(at + 1)
                    tag = f"k{_LOADED.get(c.pool[index][0], 9)}"
                elif 178 <= op <= 186:
                    tag = c.name_and_type(c.u2(at + 1))[1]
                    dynamic |= op == 186
                elif op in (187, 189, 192, 193, 197):
                    tag = c.name(c.u2(at + 1)) or ""
                ops.append(plain)
                tags.append(tag)
            return c.u2(a.start), c.u2(a.start + 2), ops, tags, dynamic
    return 0, 0, [], [], False


def decode(data: bytes, drop_dynamic: bool = False) -> dict:
    """Name, access, super name, interfaces, fields and methods of a class.

    A member that repeats a name and descriptor replaces the earlier one, at its place. drop_dynamic raises on dynamic calls.
    """
    c = ClassFile(data)
    fields, methods = {}, {}
    for m in c.fields:
        initial = next((INITIAL.get(c.pool[c.u2(a.start)][0], 0) for a in m.attributes if a.name == "ConstantValue"), 0)
        fields[c.utf8(m.name), c.utf8(m.desc)] = {"access": m.access, "init_tag": initial}
    for m in c.methods:
        stack, locals_, ops, tags, dynamic = _code(c, m)
        if dynamic and drop_dynamic:
            raise ClassFormatError("dynamic call")
        methods[c.utf8(m.name), c.utf8(m.desc)] = {"access": m.access, "max_stack": stack, "max_locals": locals_, "ops": ops, "tags": tags}
    return {"name": c.name(c.this), "access": c.access, "super": c.name(c.super_), "interfaces": [c.name(i) for i in c.interfaces], "fields": fields, "methods": methods}


class Names:
    """New names of classes and members; both functions return the name itself where nothing is known."""

    def __init__(self, classes: dict[str, str], members: dict[tuple[str, str], dict[tuple[str, str], str]]) -> None:
        """members: by class and kind, names by (name, descriptor)."""
        self.classes, self.members = classes, members

    def of_class(self, name: str) -> str:
        return self.classes.get(name, name)

    def of_member(self, owner: str, kind: str, name: str, desc: str) -> str:
        known = self.members.get((owner, kind), {})
        if (name, desc) in known:
            return known[name, desc]
        same = [v for (n, _), v in known.items() if n == name]
        return same[0] if len(same) == 1 else name

    def in_type(self, text: str) -> str:
        """Of a class constant, which may be an array's descriptor."""
        return self.in_descriptor(text) if text.startswith("[") else self.of_class(text)

    def in_descriptor(self, text: str) -> str:
        return re.sub(r"L([^;<>]+);", lambda m: f"L{self.of_class(m[1])};", text)

    def in_signature(self, text: str) -> str:
        """Class names of a generic signature; an inner one, after a dot, keeps its last part of the new name."""
        out, i = [], 0
        while i < len(text):
            if text[i] == "L":
                i, piece = self._class_type(text, i)
                out.append(piece)
            elif text[i] == "T":
                end = text.index(";", i) + 1
                out.append(text[i:end])
                i = end
            else:
                out.append(text[i])
                i += 1
        return "".join(out)

    def _class_type(self, text: str, i: int) -> tuple[int, str]:
        end = i + 1
        while text[end] not in "<;.":
            end += 1
        name = text[i + 1 : end]
        out = ["L", self.of_class(name)]
        while text[end] != ";":
            if text[end] == "<":
                depth, start = 0, end
                while True:
                    depth += (text[end] == "<") - (text[end] == ">")
                    end += 1
                    if not depth:
                        break
                out.append("<" + self.in_signature(text[start + 1 : end - 1]) + ">")
            else:
                start = end + 1
                end = start
                while text[end] not in "<;.":
                    end += 1
                whole = f"{name}${text[start:end]}"
                new = self.of_class(whole)
                out.append("." + (text[start:end] if new == whole else new.rpartition("$")[2]))
                name = whole
        return end + 1, "".join(out) + ";"

    def of_signature(self, text: str) -> str:
        """With formal type parameters in front, whose names stay."""
        if not text.startswith("<"):
            return self.in_signature(text)
        out, i = ["<"], 1
        while text[i] != ">":
            colon = text.index(":", i)
            out.append(text[i:colon])
            i = colon
            while text[i] == ":":
                out.append(":")
                i += 1
                if text[i] not in ":>" and (text[i] in "LT["):
                    end = self._end(text, i)
                    out.append(self.in_signature(text[i:end]))
                    i = end
        return "".join(out) + ">" + self.in_signature(text[i + 1 :])

    @staticmethod
    def _end(text: str, i: int) -> int:
        depth = 0
        while True:
            depth += (text[i] == "<") - (text[i] == ">")
            i += 1
            if text[i - 1] == ";" and not depth or text[i - 1] in "BCDFIJSZ" and text[i - 2] == "[" and not depth:
                return i


def rewrite(data: bytes, names: Names) -> tuple[str, bytes]:
    """The class's new name, and its bytes with names of classes, members, descriptors and signatures replaced.

    Texts are never changed in place, as a name may also be a string literal: new ones are appended to the pool and the
    indices that are names are pointed to them. Names of dynamic calls stay.
    """
    c = ClassFile(data)
    out = bytearray(data)
    extra, number, count = bytearray(), {}, len(c.pool)

    def text(new: str) -> int:
        nonlocal count
        if new not in number:
            raw = _raw(new)
            extra.extend(struct.pack(">BH", 1, len(raw)) + raw)
            number[new] = count
            count += 1
        return number[new]

    def pair(name: int, desc: int) -> int:
        nonlocal count
        key = (name, desc)
        if key not in number:
            extra.extend(struct.pack(">BHH", 12, name, desc))
            number[key] = count
            count += 1
        return number[key]

    def point(at: int, new: Callable[[str], str]) -> None:
        old = c.utf8(c.u2(at))
        if (now := new(old)) != old:
            struct.pack_into(">H", out, at, text(now))

    def element(at: int) -> int:
        kind = chr(data[at])
        if kind == "e":
            point(at + 1, names.in_descriptor)
            return at + 5
        if kind == "c":
            point(at + 1, names.in_descriptor)
            return at + 3
        if kind == "@":
            return annotation(at + 1)
        if kind == "[":
            n, at = c.u2(at + 1), at + 3
            for _ in range(n):
                at = element(at)
            return at
        return at + 3

    def annotation(at: int) -> int:
        point(at, names.in_descriptor)
        n, at = c.u2(at + 2), at + 4
        for _ in range(n):
            at = element(at + 2)
        return at

    def type_annotation(at: int) -> int:
        """Its target's size depends on the first byte; its path on the next."""
        target = data[at]
        at += 1
        at += {0x00: 1, 0x01: 1, 0x10: 2, 0x11: 2, 0x12: 2, 0x13: 0, 0x14: 0, 0x15: 0, 0x16: 1, 0x17: 2, 0x42: 2, 0x43: 2, 0x44: 2, 0x45: 2, 0x46: 2}.get(target, 3 if target >= 0x47 else 2 + 6 * c.u2(at))
        return annotation(at + 1 + 2 * data[at])

    me = c.name(c.this)

    def attributes(found: list[Attribute]) -> None:
        for a in found:
            at = a.start
            if a.name == "Signature":
                point(at, names.of_signature)
            elif a.name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations", "RuntimeVisibleTypeAnnotations", "RuntimeInvisibleTypeAnnotations"):
                one = type_annotation if "Type" in a.name else annotation
                at += 2
                for _ in range(c.u2(a.start)):
                    at = one(at)
            elif a.name in ("RuntimeVisibleParameterAnnotations", "RuntimeInvisibleParameterAnnotations"):
                at += 1
                for _ in range(data[a.start]):
                    n, at = c.u2(at), at + 2
                    for _ in range(n):
                        at = annotation(at)
            elif a.name == "AnnotationDefault":
                element(at)
            elif a.name == "Code":
                size = c.u4(at + 4)
                at += 8 + size
                at += 2 + 8 * c.u2(at)
                attributes(c._attributes(at)[0])
            elif a.name in ("LocalVariableTable", "LocalVariableTypeTable"):
                for i in range(c.u2(at)):
                    point(at + 2 + 10 * i + 6, names.in_descriptor if a.name == "LocalVariableTable" else names.of_signature)
            elif a.name == "Record":
                n, at = c.u2(at), at + 2
                for _ in range(n):
                    name, desc = c.utf8(c.u2(at)), c.utf8(c.u2(at + 2))
                    point(at, lambda _, name=name, desc=desc: names.of_member(me, "f", name, desc))
                    point(at + 2, names.in_descriptor)
                    inner, at = c._attributes(at + 4)
                    attributes(inner)
            elif a.name == "InnerClasses":
                for i in range(c.u2(at)):
                    place = at + 2 + 8 * i
                    if c.u2(place + 4):
                        whole = c.name(c.u2(place))
                        new = names.of_class(whole)
                        if new != whole:
                            point(place + 4, lambda _, new=new: re.split(r"[$/]", new)[-1])
            elif a.name == "EnclosingMethod" and c.u2(at + 2):
                owner = c.name(c.u2(at))
                p = c.pool[c.u2(at + 2)][1]
                name, desc = c.utf8(c.u2(p)), c.utf8(c.u2(p + 2))
                struct.pack_into(">H", out, at + 2, pair(text(names.of_member(owner, "m", name, desc)), text(names.in_descriptor(desc))))

    for tag, at in c.pool:
        if tag == 7:
            point(at, names.in_type)
        elif tag == 16:
            point(at, names.in_descriptor)
        elif tag in (9, 10, 11):
            owner = c.name(c.u2(at))
            p = c.pool[c.u2(at + 2)][1]
            name, desc = c.utf8(c.u2(p)), c.utf8(c.u2(p + 2))
            new = names.of_member(owner, "f" if tag == 9 else "m", name, desc)
            if (new, names.in_descriptor(desc)) != (name, desc):
                struct.pack_into(">H", out, at + 2, pair(text(new), text(names.in_descriptor(desc))))
        elif tag in (17, 18):
            p = c.pool[c.u2(at + 2)][1]
            desc = c.utf8(c.u2(p + 2))
            if names.in_descriptor(desc) != desc:
                struct.pack_into(">H", out, at + 2, pair(c.u2(p), text(names.in_descriptor(desc))))
    for kind, members in (("f", c.fields), ("m", c.methods)):
        for m in members:
            name, desc = c.utf8(m.name), c.utf8(m.desc)
            point(m.at + 2, lambda _, kind=kind, name=name, desc=desc: names.of_member(me, kind, name, desc))
            point(m.at + 4, names.in_descriptor)
            attributes(m.attributes)
    attributes(c.attributes)
    if count > 0xFFFF:
        raise ClassFormatError("the constant pool has no room for new names")
    struct.pack_into(">H", out, 8, count)
    return names.of_class(me), bytes(out[: c.body]) + bytes(extra) + bytes(out[c.body :])
