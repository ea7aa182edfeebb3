"""A small writer of class files, for tests."""

import struct
import zipfile


class Builder:
    def __init__(self, name, super_="java/lang/Object", interfaces=(), access=0x21):
        self.pool, self.count, self.known = b"", 1, {}
        self.head = struct.pack(">HHH", access, self.cls(name), self.cls(super_)) + struct.pack(">H", len(interfaces)) + b"".join(struct.pack(">H", self.cls(i)) for i in interfaces)
        self.name, self.super, self.fields, self.methods, self.attributes = name, super_, [], [], []

    def _add(self, raw, slots=1):
        if raw not in self.known:
            self.pool += raw
            self.known[raw] = self.count
            self.count += slots
        return self.known[raw]

    def text(self, s):
        raw = s.encode()
        return self._add(struct.pack(">BH", 1, len(raw)) + raw)

    def cls(self, s):
        return self._add(struct.pack(">BH", 7, self.text(s)))

    def string(self, s):
        return self._add(struct.pack(">BH", 8, self.text(s)))

    def int(self, n):
        return self._add(struct.pack(">Bi", 3, n))

    def long(self, n):
        return self._add(struct.pack(">Bq", 5, n), 2)

    def pair(self, name, desc):
        return self._add(struct.pack(">BHH", 12, self.text(name), self.text(desc)))

    def ref(self, tag, owner, name, desc):
        return self._add(struct.pack(">BHH", tag, self.cls(owner), self.pair(name, desc)))

    def attr(self, name, data):
        return struct.pack(">HI", self.text(name), len(data)) + data

    def field(self, name, desc, access=1, constant=None, signature=None):
        attrs = [self.attr(n, struct.pack(">H", i)) for n, i in (("ConstantValue", constant), ("Signature", signature and self.text(signature))) if i is not None]
        self.fields.append(struct.pack(">HHHH", access, self.text(name), self.text(desc), len(attrs)) + b"".join(attrs))

    def method(self, name, desc, code=None, access=1, stack=2, locals_=4):
        attrs = [] if code is None else [self.attr("Code", struct.pack(">HHI", stack, locals_, len(code)) + code + b"\0\0\0\0")]
        self.methods.append(struct.pack(">HHHH", access, self.text(name), self.text(desc), len(attrs)) + b"".join(attrs))

    def init(self):
        self.method("<init>", "()V", b"\x2a\xb7" + struct.pack(">H", self.ref(10, self.super, "<init>", "()V")) + b"\xb1", stack=1, locals_=1)

    def bytes(self):
        tail = b"".join([struct.pack(">H", len(self.fields)), *self.fields, struct.pack(">H", len(self.methods)), *self.methods, struct.pack(">H", len(self.attributes)), *self.attributes])
        return struct.pack(">IHHH", 0xCAFEBABE, 0, 49, self.count) + self.pool + self.head + tail


def sample(name, ints, extra=()):
    """A class with int fields and methods ()I that return 42, and others that return nothing."""
    b = Builder(name)
    for i in range(ints):
        b.field(f"f{i}", "I")
    b.init()
    for method, desc in extra:
        b.method(method, desc, b"\x10\x2a\xac" if desc.endswith("I") else b"\xb1")
    return b.bytes()


def write_jar(path, classes, others=()):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in [*((f"{n}.class", d) for n, d in classes), *others]:
            z.writestr(name, data)
    return str(path)
