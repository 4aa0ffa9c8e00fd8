"""Types in metadata signatures: decoded to trees, and said as C#, as declaration ids, and as the names that they hold."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from ..errors import QueryError
from ..functions.matching import KEYWORDS
from .pe import Assembly, Bytes, Row, malformed

# fixed values (ECMA-335 II.23.1.16): the types that a signature names by one byte
PRIMITIVES = {
    0x01: "System.Void", 0x02: "System.Boolean", 0x03: "System.Char", 0x04: "System.SByte", 0x05: "System.Byte", 0x06: "System.Int16", 0x07: "System.UInt16", 0x08: "System.Int32", 0x09: "System.UInt32",
    0x0A: "System.Int64", 0x0B: "System.UInt64", 0x0C: "System.Single", 0x0D: "System.Double", 0x0E: "System.String", 0x16: "System.TypedReference", 0x18: "System.IntPtr", 0x19: "System.UIntPtr", 0x1C: "System.Object",
}
REFERENCES = {"System.String", "System.Object"}
MAX_DEPTH = 64


@dataclass(frozen=True)
class Type:
    kind: str  # named, generic, parameter, array, vector, pointer, reference, modified
    name: str = ""  # of a type, or of a parameter
    inner: tuple[Type, ...] = ()  # arguments, or the one type that this is made of
    value: bool = False  # whether it is a value type
    shape: tuple[tuple[int, ...], tuple[int, ...], int] = ((), (), 0)  # sizes, lower bounds, rank
    place: int = 0  # of a parameter
    of_method: bool = False
    required: bool = False  # of a modifier

    @property
    def bare(self) -> Type:
        """Without its modifiers."""
        return self.inner[0].bare if self.kind == "modified" else self

    @property
    def modifiers(self) -> set[str]:
        return {self.name} | self.inner[0].modifiers if self.kind == "modified" else set()

    def walk(self) -> Iterator[Type]:
        yield self
        for t in self.inner:
            yield from t.walk()


@dataclass(frozen=True)
class Signature:
    returns: Type
    parameters: tuple[Type, ...]
    generic: int = 0
    instance: bool = False
    explicit: bool = False


class Names:
    """The names of types by row."""

    def __init__(self, assembly: Assembly):
        self.assembly = assembly

    def of(self, row: Row, depth: int = 0) -> str:
        """The dotted name of a definition or reference, arity and all; of a constructed type that of what it is constructed from."""
        table, n = row
        if depth > MAX_DEPTH:
            raise malformed("types nested in a circle")
        a = self.assembly
        if table == "TypeDef":
            _, name, space, *_ = a.row(table, n)
            around = self.of(("TypeDef", a.enclosing[n]), depth + 1) if n in a.enclosing else a.string(space)
        elif table == "TypeRef":
            scope, name, space = a.row(table, n)
            around = self.of(scope, depth + 1) if scope[0] == "TypeRef" and scope[1] else a.string(space)
        elif table == "TypeSpec":
            return Decoder(self, (), ()).specified(n).bare.name
        else:
            raise malformed(f"a type in {table}")
        return f"{around}.{a.string(name)}" if around else a.string(name)


class Decoder:
    """Reads signatures in the context of the generic parameters' names."""

    def __init__(self, names: Names, type_parameters: tuple[str, ...], method_parameters: tuple[str, ...]):
        self.names, self.scopes = names, (type_parameters, method_parameters)

    def specified(self, n: int, depth: int = 0) -> Type:
        a = self.names.assembly
        return self.type(Bytes(a.blob(a.row("TypeSpec", n)[0])), depth + 1)

    def row(self, row: Row, value: bool = False, depth: int = 0) -> Type:
        return self.specified(row[1], depth) if row[0] == "TypeSpec" else Type("named", self.names.of(row), value=value)

    def type(self, r: Bytes, depth: int = 0) -> Type:
        if depth > MAX_DEPTH:
            raise QueryError("source_invalid", f"a type nested more than {MAX_DEPTH} deep")
        code = r.byte()
        inner = lambda: self.type(r, depth + 1)
        if code in PRIMITIVES:
            name = PRIMITIVES[code]
            return Type("named", name, value=name not in REFERENCES)
        if code in (0x11, 0x12):
            return self.row(_coded(r), code == 0x11, depth)
        if code in (0x0F, 0x10, 0x1D):
            return Type({0x0F: "pointer", 0x10: "reference", 0x1D: "vector"}[code], inner=(inner(),))
        if code in (0x13, 0x1E):
            place = r.packed()
            scope = self.scopes[code == 0x1E]
            if place >= len(scope):
                raise malformed("a type parameter that isn't declared")
            return Type("parameter", scope[place], place=place, of_method=code == 0x1E)
        if code in (0x1F, 0x20):
            name = self.names.of(_coded(r))
            return Type("modified", name, (inner(),), required=code == 0x1F)
        if code == 0x14:
            element, rank = inner(), r.packed()
            sizes = tuple(r.packed() for _ in range(r.packed()))
            return Type("array", inner=(element,), shape=(sizes, tuple(r.packed_signed() for _ in range(r.packed())), rank))
        if code == 0x15:
            value = r.byte() == 0x11
            name = self.names.of(_coded(r))
            return Type("generic", name, tuple(inner() for _ in range(r.packed())), value)
        raise QueryError("source_invalid", f"a signature of an unsupported kind (0x{code:02x})")

    def method(self, blob: bytes) -> Signature:
        """A method's or a property's."""
        r = Bytes(blob)
        header = r.byte()
        if header & 0x0F not in (0, 5, 8):
            raise QueryError("source_invalid", f"a calling convention that C# has no words for (0x{header:02x})")
        generic = r.packed() if header & 0x10 else 0
        n = r.packed()
        returns = self.type(r)
        return Signature(returns, tuple(self.type(r) for _ in range(n)), generic, bool(header & 0x20), bool(header & 0x40))

    def field(self, blob: bytes) -> Type:
        r = Bytes(blob)
        if r.byte() != 0x06:
            raise malformed("a field's signature")
        return self.type(r)


def _coded(r: Bytes) -> Row:
    n = r.packed()
    return ("TypeDef", "TypeRef", "TypeSpec", "-")[n & 3], n >> 2


# -- said as text


def without_arity(name: str) -> str:
    return re.sub(r"`\d*", "", name)


def constructed(t: Type, arguments: list[str], around: str, between: str) -> str:
    """A generic name with its arguments dealt to the segments that declare them."""
    left = list(arguments)

    def deal(m: re.Match) -> str:
        n = int(m[1])
        own = [left.pop(0) for _ in range(min(n, len(left)))]
        if len(own) < n:
            raise QueryError("source_invalid", f"'{t.name}' lacks arguments")
        return around[0] + between.join(own) + around[1]

    out = re.sub(r"`(\d+)(?=\.|$)", deal, t.name)
    if left:
        raise QueryError("source_invalid", f"'{t.name}' has arguments that it doesn't declare")
    return out


def declaration_id(t: Type) -> str:
    """A type as in a declaration id."""
    if t.kind == "parameter":
        return ("``" if t.of_method else "`") + str(t.place)
    if t.kind == "named":
        return t.name
    parts = [declaration_id(x) for x in t.inner]
    if t.kind == "generic":
        return constructed(t, parts, "{}", ",")
    if t.kind == "array":
        sizes, lows, rank = t.shape
        at = lambda xs, i: xs[i] if i < len(xs) else 0
        return parts[0] + "[" + ",".join(f"{at(lows, i)}:{at(sizes, i) or ''}" for i in range(rank)) + "]"
    return parts[0] + {"modified": "", "pointer": "*", "reference": "@", "vector": "[]"}[t.kind]


def type_names(t: Type) -> list[str]:
    """The names of all types in a tree, without arity, sorted."""
    return sorted({without_arity(x.name) for x in t.walk() if x.kind in ("named", "generic")})


class Positions:
    """What is stated of a type's positions in order: one value for all, one for each, or a default."""

    def __init__(self, values: list | None, default: object, what: str):
        self.values, self.default, self.what, self.at = values, default, what, 0

    def next(self, n: int = 1) -> list:
        if self.values is None:
            return [self.default] * n
        if self.at + n > len(self.values):
            raise QueryError("source_invalid", f"{self.what} are stated for {len(self.values)} positions, which are too few")
        self.at += n
        return self.values[self.at - n : self.at]

    def done(self) -> None:
        if self.values is not None and self.at != len(self.values):
            raise QueryError("source_invalid", f"{self.what} are stated for {len(self.values)} positions of {self.at}")


def csharp(t: Type, nullable: int | list[int] | None = None, context: int = 0, tuple_names: list[str | None] | None = None) -> str:
    """A type in C#. ``nullable`` is one flag for all positions or a list of them, in the order in which the type is read; ``context`` holds without."""
    flags = Positions(nullable if isinstance(nullable, list) else None, nullable if isinstance(nullable, int) else context, "nullable flags")
    names = Positions(tuple_names, None, "tuple names")
    out = _csharp(t, flags, names)
    flags.done()
    names.done()
    return out


def _csharp(t: Type, flags: Positions, names: Positions) -> str:
    if t.kind == "modified":
        return _csharp(t.inner[0], flags, names)
    if t.kind == "pointer":
        return _csharp(t.inner[0], flags, names) + "*"
    if t.kind == "reference":
        raise QueryError("source_invalid", "a reference inside a type has no C# form")
    if t.kind == "generic" and t.name == "System.Nullable`1" and len(t.inner) == 1:  # has no flag of its own
        return _csharp(t.inner[0], flags, names) + "?"
    if t.kind == "named" and t.value:  # nor has a value type without arguments
        return _named(t.name)
    end = "?" if flags.next()[0] == 2 and not t.value else ""
    if t.kind == "parameter":
        return t.name + end
    if t.kind == "named":
        return _named(t.name) + end
    if t.kind in ("vector", "array"):
        return _csharp(t.inner[0], flags, names) + _brackets(t) + end
    if t.name.startswith("System.ValueTuple`"):
        parts, tails = _elements(t)
        own = names.next(len(parts))
        said = []
        for i, x in enumerate(parts):
            if i and i % 7 == 0 and tails:  # the flag of the tuple that holds the rest
                flags.next()
            said.append(" ".join(filter(None, (_csharp(x, flags, names), own[i]))))
        return f"({', '.join(said)})" + end
    return without_arity(constructed(t, [_csharp(x, flags, names) for x in t.inner], "<>", ", ")) + end


def _named(name: str) -> str:
    return KEYWORDS.get(name) or without_arity(name)


def _elements(t: Type) -> tuple[list[Type], int]:
    """The elements of a tuple, those in the eighth place included, and the number of tuples that hold them."""
    if t.name != "System.ValueTuple`8" or len(t.inner) != 8:
        return list(t.inner), 0
    rest = t.inner[7]
    if rest.kind != "generic" or not rest.name.startswith("System.ValueTuple`"):
        raise QueryError("source_invalid", "the eighth element of a tuple is no tuple")
    parts, tails = _elements(rest)
    return [*t.inner[:7], *parts], tails + 1


def _brackets(t: Type) -> str:
    sizes, lows, rank = t.shape
    if t.kind == "vector":
        return "[]"
    if rank < 2 or rank > 32 or sizes or list(lows) != [0] * rank:
        raise QueryError("source_invalid", f"an array of rank {rank} with sizes {list(sizes)} and lower bounds {list(lows)} has no C# form")
    return "[" + "," * (rank - 1) + "]"
