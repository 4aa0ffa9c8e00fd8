"""Assemblies made row by row, for bindings and for the tests of their reader. Of what metadata can say this writes what the reader reads."""

from __future__ import annotations

import struct

from ..sources import pe

VOID, BOOL, BYTE, INT, LONG, TEXT, OBJECT = b"\x01", b"\x02", b"\x05", b"\x08", b"\x0a", b"\x0e", b"\x1c"


def packed(n):
    return bytes([n]) if n < 0x80 else struct.pack(">H", 0x8000 | n) if n < 0x4000 else struct.pack(">I", 0xC0000000 | n)


def coded(row):
    return packed(row[1] << 2 | ("TypeDef", "TypeRef", "TypeSpec").index(row[0]))


def cls(row):
    return b"\x12" + coded(row)


def val(row):
    return b"\x11" + coded(row)


def var(i):
    return b"\x13" + packed(i)


def mvar(i):
    return b"\x1e" + packed(i)


def of(row, *arguments, value=False):
    return b"\x15" + (b"\x11" if value else b"\x12") + coded(row) + packed(len(arguments)) + b"".join(arguments)


def ref(t):
    return b"\x10" + t


def vector(t):
    return b"\x1d" + t


def grid(t, rank=2):
    return b"\x14" + t + packed(rank) + packed(0) + packed(rank) + b"\0" * rank


def required(row, t):
    return b"\x1f" + coded(row) + t


def signature(returns, *parameters, static=False, generic=0, kind=0):
    head = kind | (0 if static else 0x20) | (0x10 if generic else 0)
    return bytes([head]) + (packed(generic) if generic else b"") + packed(len(parameters)) + returns + b"".join(parameters)


def said(text):
    return b"\xff" if text is None else packed(len(text.encode())) + text.encode()


class Builder:
    def __init__(self, name="Lib"):
        self.strings, self.blobs = bytearray(b"\0"), bytearray(b"\0")
        self.tables = {n: [] for n, _ in pe.TABLES.values()}
        self.row("Module", 0, self.string("Lib.dll"), 0, 0, 0)
        self.row("Assembly", 0, 1, 0, 0, 0, 0, 0, self.string(name), 0)
        self.core = self.row("AssemblyRef", 4, 0, 0, 0, 0, 0, self.string("mscorlib"), 0, 0)
        self.refs, self.constructors = {}, {}
        self.type("<Module>", "", 0)

    def string(self, s):
        at = len(self.strings)
        self.strings += s.encode() + b"\0"
        return at

    def blob(self, b):
        at = len(self.blobs)
        self.blobs += packed(len(b)) + b
        return at

    def row(self, table, *values):
        self.tables[table].append(values)
        return (table, len(self.tables[table]))

    def outer(self, name):
        """A type of another assembly."""
        if name not in self.refs:
            space, _, simple = name.rpartition(".")
            self.refs[name] = self.row("TypeRef", self.core, self.string(simple), self.string(space))
        return self.refs[name]

    def type(self, name, space="Lib", flags=1, base=("TypeDef", 0), within=None, parameters=(), interfaces=()):
        n = self.row("TypeDef", flags, self.string(name), self.string(space), base, len(self.tables["Field"]) + 1, len(self.tables["MethodDef"]) + 1)
        if within:
            self.row("NestedClass", n[1], within[1])
        for i, p in enumerate(parameters):
            self.parameter(n, i, *(p if isinstance(p, tuple) else (p,)))
        self.implemented = [self.row("InterfaceImpl", n[1], i) for i in interfaces]
        return n

    def parameter(self, owner, i, name, flags=0, *constraints):
        n = self.row("GenericParam", i, flags, owner, self.string(name))
        for c in constraints:
            self.row("GenericParamConstraint", n[1], c)
        return n

    def method(self, name, blob, flags=6, parameters=(), returned=None, generic=()):
        """``parameters``: (name, flags) of each; ``returned``: flags of what is returned, if it has a row."""
        first = len(self.tables["Param"]) + 1
        n = self.row("MethodDef", 0, 0, flags, self.string(name), self.blob(blob), first)
        if returned is not None:
            self.row("Param", returned, 0, self.string(""))
        for i, (p, f) in enumerate(parameters, 1):
            self.row("Param", f, i, self.string(p))
        for i, p in enumerate(generic):
            self.parameter(n, i, *(p if isinstance(p, tuple) else (p,)))
        return n

    def param(self, back=0):
        return ("Param", len(self.tables["Param"]) - back)

    def field(self, name, t, flags=6, constant=None):
        n = self.row("Field", flags, self.string(name), self.blob(b"\x06" + t))
        if constant:
            self.row("Constant", constant[0], n, self.blob(constant[1]))
        return n

    def property(self, holder, name, blob, getter=None, setter=None, first=False):
        n = self.row("Property", 0, self.string(name), self.blob(blob))
        if first:
            self.row("PropertyMap", holder[1], n[1])
        for meaning, m in ((2, getter), (1, setter)):
            if m:
                self.row("MethodSemantics", meaning, m[1], n)
        return n

    def event(self, holder, name, of, add, remove):
        n = self.row("Event", 0, self.string(name), of)
        self.row("EventMap", holder[1], n[1])
        for meaning, m in ((8, add), (16, remove)):
            self.row("MethodSemantics", meaning, m[1], n)
        return n

    def attribute(self, row, holder, types, value, named=b"", n_named=0):
        """``types`` is the signature of the constructor's parameters, ``value`` its encoded arguments."""
        key = (holder, types)
        if key not in self.constructors:
            self.constructors[key] = self.row("MemberRef", holder, self.string(".ctor"), self.blob(signature(VOID, *types)))
        return self.row("CustomAttribute", row, self.constructors[key], self.blob(b"\1\0" + value + struct.pack("<H", n_named) + named))

    def nullable(self, row, flags):
        t = self.outer("System.Runtime.CompilerServices.NullableAttribute")
        if isinstance(flags, int):
            self.attribute(row, t, (BYTE,), bytes([flags]))
        else:
            self.attribute(row, t, (vector(BYTE),), struct.pack("<I", len(flags)) + bytes(flags))

    def build(self):
        counts = {t: len(rows) for t, rows in self.tables.items() if rows}
        width = pe.widths(counts, 0)
        out = struct.pack("<IBBBBQQ", 0, 2, 0, 0, 1, sum(1 << pe.NUMBERS[t] for t in counts), 0) + b"".join(struct.pack("<I", counts[t]) for t in sorted(counts, key=pe.NUMBERS.get))
        for t in sorted(counts, key=pe.NUMBERS.get):
            columns = pe.TABLES[pe.NUMBERS[t]][1].split()
            for row in self.tables[t]:
                for c, v in zip(columns, row, strict=True):
                    if c in pe.CODED_TABLES:
                        v = 0 if v == 0 else v[1] << pe.CODED_BITS[c] | pe.CODED_TABLES[c].index(v[0])
                    out += v.to_bytes(width[c], "little")
        streams = [(b"#~\0\0", out), (b"#Strings\0\0\0\0", bytes(self.strings)), (b"#Blob\0\0\0", bytes(self.blobs))]
        root = b"BSJB" + struct.pack("<HHII", 1, 1, 0, 12) + b"v4.0.30319\0\0" + struct.pack("<HH", 0, len(streams))
        at = len(root) + sum(8 + len(n) for n, _ in streams)
        heads, bodies = b"", b""
        for name, body in streams:
            body += b"\0" * (-len(body) % 4)
            heads += struct.pack("<II", at + len(bodies), len(body)) + name
            bodies += body
        metadata = root + heads + bodies
        section = struct.pack("<IHHII", 72, 2, 5, 0x2000 + 72, len(metadata)).ljust(72, b"\0") + metadata
        optional = struct.pack("<H", 0x10B).ljust(92, b"\0") + struct.pack("<I", 16) + b"\0" * 112 + struct.pack("<II", 0x2000, 72) + b"\0" * 8
        head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 0x2102) + optional
        head += b".text\0\0\0" + struct.pack("<IIII", len(section), 0x2000, len(section), 0x200) + b"\0" * 16
        return head.ljust(0x200, b"\0") + section
