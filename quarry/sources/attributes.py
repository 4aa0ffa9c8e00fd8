"""Values of custom attributes: decoded from their blobs, and said as C#."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QueryError
from .pe import Assembly, Bytes, Row, malformed
from .signatures import PRIMITIVES, Decoder, Names, Type, csharp, type_names

# fixed values: how wide enumerations of the platform are in a value, by struct's letters; all others of other assemblies are unknown
_INT = """System.AttributeTargets System.ComponentModel.EditorBrowsableState System.Diagnostics.CodeAnalysis.DynamicallyAccessedMemberTypes System.Diagnostics.DebuggerBrowsableState
System.Diagnostics.Tracing.EventActivityOptions System.Diagnostics.Tracing.EventCommand System.Diagnostics.Tracing.EventLevel System.Diagnostics.Tracing.EventManifestOptions
System.Diagnostics.Tracing.EventOpcode System.Diagnostics.Tracing.EventTask System.Reflection.MethodImplAttributes System.Runtime.CompilerServices.CompilationRelaxations
System.Runtime.CompilerServices.MethodCodeType System.Runtime.CompilerServices.MethodImplOptions System.Runtime.ConstrainedExecution.Cer System.Runtime.ConstrainedExecution.Consistency
System.Runtime.InteropServices.CallingConvention System.Runtime.InteropServices.CharSet System.Runtime.InteropServices.ClassInterfaceType System.Runtime.InteropServices.ComInterfaceType
System.Runtime.InteropServices.DllImportSearchPath System.Runtime.InteropServices.GCHandleType System.Runtime.InteropServices.LayoutKind System.Runtime.InteropServices.UnmanagedType
System.Runtime.InteropServices.VarEnum"""
PLATFORM_ENUMS = dict.fromkeys(_INT.split(), "i") | {"System.Diagnostics.Tracing.EventChannel": "B", "System.Diagnostics.Tracing.EventKeywords": "q", "System.Security.SecurityRuleSet": "B"}
# fixed values: the flags of System.AttributeTargets, from the lowest bit
TARGETS = "Assembly Module Class Struct Enum Constructor Method Property Field Event Interface Parameter Delegate ReturnValue GenericParameter".split()
# fixed values: attributes that only encode what a signature says already
ENCODINGS = {f"System.Runtime.CompilerServices.{n}Attribute" for n in "AsyncStateMachine CompilerGenerated IsReadOnly IsUnmanaged IteratorStateMachine Nullable NullableContext TupleElementNames".split()}
_FORMS = {"System.SByte": "b", "System.Byte": "B", "System.Int16": "h", "System.UInt16": "H", "System.Int32": "i", "System.UInt32": "I", "System.Int64": "q", "System.UInt64": "Q", "System.Single": "f", "System.Double": "d"}
_STRING, _TYPE, _OBJECT = Type("named", "System.String"), Type("named", "System.Type"), Type("named", "System.Object")


@dataclass(frozen=True)
class Value:
    type: Type
    value: object  # a number, a string, a Type, a list of Values, or none


class Attributes:
    """Decodes the attributes of an assembly's rows."""

    def __init__(self, names: Names):
        self.names, self.assembly = names, names.assembly

    def name(self, constructor: Row) -> str:
        return self.names.of(self._holder(constructor))

    def _holder(self, constructor: Row) -> Row:
        table, n = constructor
        if table == "MemberRef":
            return self.assembly.row(table, n)[0]
        if table != "MethodDef" or n not in self._owners:
            raise malformed("an attribute without a constructor")
        return ("TypeDef", self._owners[n])

    @property
    def _owners(self) -> dict[int, int]:
        if not hasattr(self, "_methods"):
            a = self.assembly
            self._methods = {m: t for t in range(1, a.counts.get("TypeDef", 0) + 1) for m in a.owned("MethodDef", "TypeDef", 5, t)}
        return self._methods

    def shown(self, constructor: Row) -> str:
        """The attribute's type in C#."""
        holder = self._holder(constructor)
        return csharp(Decoder(self.names, (), ()).row(holder))

    def find(self, row: Row, name: str) -> list[Value] | None:
        """The fixed arguments of the attribute of this name that a row has."""
        for constructor, at in self.assembly.attributes.get(row, ()):
            if self.name(constructor) == name:
                return self.decode(constructor, at)[0]
        return None

    def has(self, row: Row, name: str) -> bool:
        return any(self.name(c) == name for c, _ in self.assembly.attributes.get(row, ()))

    def decode(self, constructor: Row, at: int) -> tuple[list[Value], list[tuple[str, Value]]]:
        """(fixed arguments, named arguments)."""
        a, (table, n) = self.assembly, constructor
        blob = a.row(table, n)[4 if table == "MethodDef" else 2]
        holder = self._holder(constructor)
        arguments = Decoder(self.names, (), ()).row(holder).inner if holder[0] == "TypeSpec" else ()
        signature = Decoder(self.names, tuple(f"T{i}" for i in range(len(arguments))), ()).method(a.blob(blob))
        if not at:
            return [], []
        r = Bytes(a.blob(at))
        if r.number("H") != 1:
            raise malformed("an attribute's value")
        fixed = [self._value(r, arguments[t.place] if t.kind == "parameter" else t) for t in signature.parameters]
        named = []
        for _ in range(r.number("H")):
            if r.byte() not in (0x53, 0x54):
                raise malformed("a named argument")
            kind = self._kind(r)
            named.append((r.text() or "", self._value(r, kind)))
        return fixed, named

    def _kind(self, r: Bytes) -> Type:
        """A type as values state it."""
        code = r.byte()
        if code == 0x1D:
            return Type("vector", inner=(self._kind(r),))
        if code in (0x50, 0x51):
            return _TYPE if code == 0x50 else _OBJECT
        if code == 0x55:
            return Type("named", parse_name(r.text() or "").name, value=True)
        if code in PRIMITIVES and 0x02 <= code <= 0x0E:
            return Type("named", PRIMITIVES[code], value=code != 0x0E)
        raise malformed(f"an argument of kind 0x{code:02x}")

    def _value(self, r: Bytes, t: Type) -> Value:
        if t.kind == "vector":
            n = r.number("I")
            return Value(t, None if n == 0xFFFFFFFF else [self._value(r, t.inner[0]) for _ in range(n)])
        if t.name == "System.Object":
            return self._value(r, self._kind(r))
        if t.name == "System.String":
            return Value(t, r.text())
        if t.name == "System.Type":
            said = r.text()
            return Value(t, None if said is None else parse_name(said))
        if t.name == "System.Boolean":
            return Value(t, bool(r.byte()))
        if t.name == "System.Char":
            return Value(t, chr(r.number("H")))
        form = _FORMS.get(t.name) or self.width(t.name)
        if form is None:
            raise QueryError("source_invalid", f"the width of '{t.name}' is known to another assembly only")
        return Value(t, r.number(form))

    # -- enumerations

    def local_enum(self, name: str) -> int | None:
        """The row of an enumeration that this assembly defines."""
        if not hasattr(self, "_enums"):
            a = self.assembly
            bases = ((n, row[3]) for n, row in enumerate(a.rows("TypeDef"), 1))
            self._enums = {self.names.of(("TypeDef", n)): n for n, base in bases if base[1] and base[0] != "TypeSpec" and self.names.of(base) == "System.Enum"}
        return self._enums.get(name)

    def width(self, name: str) -> str | None:
        n = self.local_enum(name)
        if n is None:
            return PLATFORM_ENUMS.get(name)
        a = self.assembly
        for f in a.owned("Field", "TypeDef", 4, n):
            flags, _, blob = a.row("Field", f)
            if not flags & 0x10:  # the one field that isn't static holds the value
                return _FORMS.get(Decoder(self.names, (), ()).field(a.blob(blob)).name)
        return None

    def _constants(self, n: int) -> list[tuple[int, str]]:
        """(value as unsigned bits, name) of an enumeration, from the smallest."""
        a, out = self.assembly, []
        for f in a.owned("Field", "TypeDef", 4, n):
            flags, name, _ = a.row("Field", f)
            if flags & 0x40:
                kind, data = a.constants.get(("Field", f), (0, b""))
                form = _FORMS.get(PRIMITIVES.get(kind, ""))
                if form is None:
                    raise QueryError("source_invalid", "a constant of an enumeration has no integer value")
                out.append((Bytes(data).number(form) & (1 << 64) - 1, a.string(name)))
        return sorted(out, key=lambda x: x[0])

    def say_enum(self, name: str, n: int, value: int) -> str:
        """A constant's name; of flags the names that make it up; otherwise a cast."""
        bits, known = value & (1 << 64) - 1, self._constants(n)
        exact = next((c for v, c in known if v == bits), None)
        if exact is not None:
            return f"{name}.{exact}"
        if self.has(("TypeDef", n), "System.FlagsAttribute"):
            left, parts = bits, []
            for v, c in known:
                if v and left & v == v:
                    parts.append(f"{name}.{c}")
                    left &= ~v
            if parts and not left:
                return " | ".join(parts)
        return f"({name}){value}"

    # -- said as C#

    def say(self, v: Value, seen: set[str]) -> str:
        """An argument in C#; the types that it names are added to ``seen``."""
        t, x = v.type, v.value
        if t.name == "System.AttributeTargets" and x is not None:
            seen.add(t.name)
            return say_targets(x)
        if t.name == "System.Type":
            if x is None:
                return "null"
            seen.update(type_names(x))
            return f"typeof({csharp(x)})"
        if t.kind == "named" and (n := self.local_enum(t.name)) is not None:
            seen.add(t.name)
            return self.say_enum(t.name, n, x)
        if isinstance(x, list):
            return f"new[] {{ {', '.join(self.say(y, seen) for y in x)} }}"
        if t.name in PLATFORM_ENUMS:
            seen.add(t.name)
        return literal(t.name, x)


def say_targets(value: int) -> str:
    if value == (1 << len(TARGETS)) - 1:
        return "System.AttributeTargets.All"
    parts = [f"System.AttributeTargets.{n}" for i, n in enumerate(TARGETS) if value >> i & 1]
    if not parts or value >> len(TARGETS):
        raise QueryError("source_invalid", f"targets {value} that no name is known for")
    return " | ".join(parts)


_ESCAPES = {"\\": "\\\\", "\r": "\\r", "\n": "\\n", "\t": "\\t"}


def literal(kind: str, x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        quote = "'" if kind == "System.Char" else '"'
        return quote + "".join(_ESCAPES.get(c, "\\" + c if c == quote else c) for c in x) + quote
    if isinstance(x, float):
        import numpy as np

        said = repr(float(x)) if kind == "System.Double" else str(np.float32(x))
        said = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}.get(said, said.removesuffix(".0"))
        return said.replace("e", "E") + ("D" if kind == "System.Double" else "F")
    return str(x)


def without_suffix(name: str) -> str:
    """``Ns.FooAttribute<int>`` becomes Ns.Foo<int>."""
    return re.sub(r"Attribute(?=$|<)", "", name, count=1) if re.search(r"Attribute(?=$|<)", name) else name


_NAME = re.compile(r"[^\[\],&*\s]+")


def parse_name(text: str) -> Type:
    """A type as reflection writes it: Outer+Inner`1[[A, assembly],[B]][], assembly. Whether it is a value type isn't told there."""
    t, at = _parse(text, 0)
    if text[at : at + 1] not in ("", ","):
        raise QueryError("source_invalid", f"a type name that can't be read: {text[:200]!r}")
    return t


def _parse(text: str, at: int) -> tuple[Type, int]:
    m = _NAME.match(text, at)
    if not m:
        raise QueryError("source_invalid", f"a type name that can't be read: {text[:200]!r}")
    name, at = m[0].replace("\\", "").replace("+", "."), m.end()
    t = Type("named", name)
    if re.match(r"\[\[?[^\],\[]", text[at:]):
        arguments, at = [], at + 1
        while True:
            whole = text[at] == "["
            inner, at = _parse(text, at + whole)
            if whole:
                at = text.find("]", at) + 1
            arguments.append(inner)
            if at <= 0 or text[at : at + 1] not in (",", "]"):
                raise QueryError("source_invalid", f"a type name that can't be read: {text[:200]!r}")
            at += 1
            if text[at - 1] == "]":
                break
            at = at + len(text[at:]) - len(text[at:].lstrip())
        t = Type("generic", name, tuple(arguments))
    while m := re.match(r"\[(,*)\]|\*", text[at:]):
        rank = len(m[1] or "") + 1
        t = Type("pointer", inner=(t,)) if m[0] == "*" else Type("vector", inner=(t,)) if rank == 1 else Type("array", inner=(t,), shape=((), (0,) * rank, rank))
        at += m.end()
    return t, at
