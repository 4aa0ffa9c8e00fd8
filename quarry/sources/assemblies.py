"""The visible API of a compiled assembly, as the types and members of a stored corpus.

A declaration that has no C# form, or whose metadata contradicts itself, is skipped with the reason, and so is an attribute that can't
be decoded; only bytes that are no assembly, and repeated ids, refuse the whole.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import QueryError
from .attributes import ENCODINGS, Attributes, without_suffix
from .pe import Assembly, Row, malformed
from .signatures import Decoder, Names, Signature, Type, csharp, declaration_id, type_names

# fixed values (ECMA-335 II.23.1): flags of types, methods, fields, parameters, type parameters, and meanings of accessors
STATIC, FINAL, VIRTUAL, NEW_SLOT, ABSTRACT, SPECIAL, RUNTIME_SPECIAL, IMPORTED = 0x10, 0x20, 0x40, 0x100, 0x400, 0x800, 0x1000, 0x2000
INTERFACE, INIT_ONLY, LITERAL, IN, OUT = 0x20, 0x20, 0x40, 0x1, 0x2
NEEDS_CLASS, NEEDS_VALUE, NEEDS_NEW = 0x4, 0x8, 0x10
SETTER, GETTER, OTHER, ADDER, REMOVER, RAISER = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
ACCESS = {6: "public", 5: "protected internal", 4: "protected"}  # of methods and fields; what isn't here isn't visible
VISIBLE_TYPES = {1, 2, 4, 7}
# fixed values: operators of C# by their names in metadata; those of one operand, and those that tell truth
_BINARY = "Addition + Subtraction - Multiply * Division / Modulus % BitwiseAnd & BitwiseOr | ExclusiveOr ^ LeftShift << RightShift >> UnsignedRightShift >>> Equality == Inequality != GreaterThan > LessThan < GreaterThanOrEqual >= LessThanOrEqual <="
_UNARY = "UnaryPlus + UnaryNegation - LogicalNot ! OnesComplement ~ Increment ++ Decrement -- True true False false"
_CHECKED = "Addition Subtraction Multiply Division UnaryNegation Increment Decrement"
_pairs = lambda s: dict(zip(s.split()[::2], s.split()[1::2], strict=True))
OPERATORS = {f"op_{n}": f"operator {s}" for n, s in (_pairs(_BINARY) | _pairs(_UNARY)).items()}
OPERATORS |= {f"op_Checked{n}": OPERATORS[f"op_{n}"].replace("operator", "operator checked") for n in _CHECKED.split()}
CONVERSIONS = {"op_Implicit": "implicit operator", "op_Explicit": "explicit operator", "op_CheckedExplicit": "explicit operator checked"}
STEPS = {f"op_{c}{n}" for n in ("Increment", "Decrement") for c in ("", "Checked")}
TRUTHS = {f"op_{n}" for n in "True False Equality Inequality GreaterThan LessThan GreaterThanOrEqual LessThanOrEqual".split()}
ONE_OPERAND = {f"op_{n}" for n in _pairs(_UNARY)} | {"op_CheckedUnaryNegation", "op_CheckedIncrement", "op_CheckedDecrement"} | set(CONVERSIONS)
# fixed values: modifiers of signatures that C# has a word for
READ_ONLY = {"System.Runtime.InteropServices.InAttribute", "System.Runtime.CompilerServices.IsReadOnlyAttribute"}
VOLATILE, INIT, UNMANAGED = "System.Runtime.CompilerServices.IsVolatile", "System.Runtime.CompilerServices.IsExternalInit", "System.Runtime.InteropServices.UnmanagedType"
_COMPILER = "System.Runtime.CompilerServices."
VOID = Type("named", "System.Void", value=True)
#: What reading rows that point anywhere can end in.
BROKEN = (struct.error, IndexError, KeyError, ValueError, OverflowError, RecursionError)


def refused(why: str) -> QueryError:
    return QueryError("source_invalid", why)


def require(*rules: tuple[bool, str]) -> None:
    """The first rule that doesn't hold is the reason."""
    for holds, otherwise in rules:
        if not holds:
            raise refused(otherwise)


def plain(t: Type, where: str, at_reference: frozenset[str] = frozenset(), at_root: frozenset[str] = frozenset()) -> None:
    """Refuses modifiers other than required ones of the given names: at the root, or around and just inside a reference."""
    outside: list[Type] = []
    while t.kind == "modified":
        outside.append(t)
        t = t.inner[0]
    by_reference = t.kind == "reference"
    allowed = at_root | (at_reference if by_reference else frozenset())
    inside: list[Type] = []
    if by_reference:
        t = t.inner[0]
        while t.kind == "modified":
            inside.append(t)
            t = t.inner[0]
    found = [m for m in outside if m.name not in allowed or not m.required] + [m for m in inside if m.name not in at_reference or not m.required]
    found += [m for m in t.walk() if m.kind == "modified"]
    if found:
        raise refused(f"the modifier '{found[0].name}' on {where} has no C# form")


@dataclass(frozen=True)
class Scope:
    """What a declaration stands in: its type's row and parameters, and the nullable default."""

    row: int
    parameters: tuple[str, ...]
    nullable: int
    methods: tuple[str, ...] = ()


class Reader:
    def __init__(self, content: bytes):
        self.a = Assembly(content)
        self.names = Names(self.a)
        self.attributes = Attributes(self.names)
        self.skipped: list[dict] = []
        maps = lambda name: {t: n for n, (t, _) in enumerate(self.a.rows(name), 1)}
        self.property_maps, self.event_maps = maps("PropertyMap"), maps("EventMap")
        self.interfaces: dict[int, list[tuple[int, Row]]] = {}
        for n, (t, of) in enumerate(self.a.rows("InterfaceImpl"), 1):
            self.interfaces.setdefault(t, []).append((n, of))
        self.constraints: dict[int, list[tuple[int, Row]]] = {}
        for n, (parameter, of) in enumerate(self.a.rows("GenericParamConstraint"), 1):
            self.constraints.setdefault(parameter, []).append((n, of))

    # -- types

    def corpus(self) -> dict:
        types = []
        for n in range(1, self.a.counts.get("TypeDef", 0) + 1):
            if self.a.string(self.a.row("TypeDef", n)[1]) != "<Module>" and self.visible(n):
                self.attempt("type", n, None, lambda n=n: types.append(self.type(n)))
        for what, found in (("type", types), ("member", [m for t in types for m in t["Members"]])):
            keys = [x["EcmaId"] for x in found]
            if len(set(keys)) < len(keys):
                raise refused(f"a {what} id is repeated: {next(k for k in keys if keys.count(k) > 1)}")
        return {"Types": types, "Skipped": self.skipped}

    def attempt(self, kind: str, n: int, name: str | None, do: Callable[[], None]) -> None:
        """The boundary behind which a declaration is lost and not the assembly."""
        try:
            do()
        except (QueryError, *BROKEN) as e:
            reason = str(e) if isinstance(e, QueryError) else f"malformed metadata: {e!r}"
            self.skipped.append({"Kind": kind, "DeclaringType": self.plain_name(n), "Name": name, "Reason": reason})

    def plain_name(self, n: int) -> str:
        _, name, space, *_ = self.a.row("TypeDef", n)
        return ".".join(filter(None, (self.a.string(space), self.a.string(name)))).strip() or "<unknown>"

    def visible(self, n: int, depth: int = 0) -> bool:
        """Public, or for derived types, and all types around it too."""
        if depth > 64:
            raise malformed("types nested in a circle")
        if self.a.row("TypeDef", n)[0] & 7 not in VISIBLE_TYPES:
            return False
        return n not in self.a.enclosing or self.visible(self.a.enclosing[n], depth + 1)

    def parameters(self, owner: Row) -> tuple[str, ...]:
        return tuple(self.a.string(name) for _, _, name, _ in self.a.generic_parameters.get(owner, ()))

    def shown_name(self, n: int, whole: bool) -> str:
        """``Outer<T>.Inner<K>``: each type with the parameters that it adds to those around it."""
        _, name, space, *_ = self.a.row("TypeDef", n)
        bare, _, arity = self.a.string(name).partition("`")
        own = self.parameters(("TypeDef", n))[-int(arity) :] if arity.isdigit() and int(arity) else ()
        said = bare + (f"<{', '.join(own)}>" if own else "")
        if not whole:
            return said
        around = self.shown_name(self.a.enclosing[n], True) if n in self.a.enclosing else self.a.string(space)
        return f"{around}.{said}" if around else said

    def nullable_default(self, row: Row, otherwise: int) -> int:
        found = self.attributes.find(row, _COMPILER + "NullableContextAttribute")
        if found is None:
            return otherwise
        require((len(found) == 1 and found[0].value in (0, 1, 2), "NullableContextAttribute holds no flag"))
        return found[0].value

    def inherited_default(self, n: int) -> int:
        if n in self.a.enclosing:
            around = self.a.enclosing[n]
            return self.nullable_default(("TypeDef", around), self.inherited_default(around))
        return self.nullable_default(("Module", 1), 0)

    def nullable(self, row: Row | None) -> int | list[int] | None:
        """The flags stated at a row: one for all positions, or one for each."""
        found = self.attributes.find(row, _COMPILER + "NullableAttribute") if row else None
        if found is None:
            return None
        require((len(found) == 1, "NullableAttribute holds no flags"))
        value = found[0].value
        flags = [v.value for v in value] if isinstance(value, list) else [value]
        require((all(f in (0, 1, 2) for f in flags), "NullableAttribute holds an unknown flag"))
        return flags if isinstance(value, list) else value

    def tuple_names(self, row: Row | None) -> list[str | None] | None:
        found = self.attributes.find(row, _COMPILER + "TupleElementNamesAttribute") if row else None
        if found is None:
            return None
        require((len(found) == 1 and isinstance(found[0].value, list), "TupleElementNamesAttribute holds no names"))
        return [v.value for v in found[0].value]

    def say(self, t: Type, row: Row | None, default: int) -> str:
        """A type in C# with what is stated of it at a row; without the reference around it."""
        t = t.bare
        return csharp(t.inner[0] if t.kind == "reference" else t, self.nullable(row), default, self.tuple_names(row))

    def use(self, t: Type, row: Row | None, default: int, name: str | None = None, before: str = "") -> dict:
        return {"Name": name, "TypeExpression": before + self.say(t, row, default), "TypeNames": type_names(t)}

    def structural(self, of: Row, at: Row, scope: Scope, where: str) -> dict:
        t = Decoder(self.names, scope.parameters, scope.methods).row(of)
        plain(t, where)
        return self.use(t, at, scope.nullable)

    def type(self, n: int) -> dict:
        row = ("TypeDef", n)
        scope = Scope(n, self.parameters(row), self.nullable_default(row, self.inherited_default(n)))
        base = self.a.row("TypeDef", n)[3]
        return {
            "EcmaId": "T:" + self.names.of(row), "Name": self.shown_name(n, False), "FullName": self.shown_name(n, True),
            "BaseType": self.structural(base, row, scope, "the base type") if base[1] else None,
            "Interfaces": [self.structural(of, ("InterfaceImpl", i), scope, "an interface") for i, of in self.interfaces.get(n, ())],
            "Constraints": self.constraint_uses(row, scope), "Attributes": self.applied(row, n, None), "Members": self.members(n, scope),
        }

    # -- constraints

    def constraint_parts(self, owner: Row, scope: Scope) -> list[tuple[str, list[dict]]]:
        """(parameter, constraints in the order of C#) of each parameter that has any."""
        out = []
        bare = lambda said: {"TypeExpression": said, "TypeNames": []}
        decoder = Decoder(self.names, scope.parameters, scope.methods)
        for _, flags, name, n in self.a.generic_parameters.get(owner, ()):
            row, parts = ("GenericParam", n), []
            unmanaged = self.attributes.has(row, _COMPILER + "IsUnmanagedAttribute")
            if flags & NEEDS_VALUE:
                parts.append(bare("unmanaged" if unmanaged else "struct"))
            elif flags & NEEDS_CLASS:
                stated = self.nullable(row)
                require((not isinstance(stated, list) or len(stated) == 1, "a class constraint has one nullable flag"))
                parts.append(bare("class?" if stated in (2, [2]) else "class"))
            for c, of in self.constraints.get(n, ()):
                t = decoder.row(of)
                if unmanaged:
                    require((bool(t.modifiers) and t.bare.name == "System.ValueType", "an unmanaged constraint without its modifier"))
                plain(t, f"a constraint of '{self.a.string(name)}'", at_root=frozenset({UNMANAGED}) if unmanaged else frozenset())
                if not (flags & NEEDS_VALUE and t.bare.name == "System.ValueType"):
                    parts.append(self.use(t, ("GenericParamConstraint", c), scope.nullable))
            if flags & NEEDS_NEW and not flags & NEEDS_VALUE:
                parts.append(bare("new()"))
            if parts:
                out.append((self.a.string(name), parts))
        return out

    def constraint_uses(self, owner: Row, scope: Scope) -> list[dict]:
        return [p | {"Name": name} for name, parts in self.constraint_parts(owner, scope) for p in parts]

    # -- attributes

    def applied(self, row: Row, n: int, member: str | None) -> list[dict]:
        out: list[dict] = []
        for constructor, at in self.a.attributes.get(row, ()):
            name = self.attributes.name(constructor)
            if name in ENCODINGS:
                continue
            try:
                fixed, named = self.attributes.decode(constructor, at)
                seen: set[str] = set()
                said = [self.attributes.say(v, seen) for v in fixed] + [f"{k} = {self.attributes.say(v, seen)}" for k, v in named]
                shown = without_suffix(self.attributes.shown(constructor))
            except QueryError as e:
                self.skipped.append({"Kind": "attribute", "DeclaringType": self.plain_name(n), "Name": member, "Reason": f"Attribute '{name}' was dropped: {e}"})
                continue
            out.append({"Application": f"[{shown}({', '.join(said)})]" if said else f"[{shown}]", "AttributeType": name, "ArgumentTypeNames": sorted(seen)})
        return out

    # -- members

    def members(self, n: int, scope: Scope) -> list[dict]:
        out: list[dict] = []
        properties = list(self.a.owned("Property", "PropertyMap", 1, self.property_maps[n])) if n in self.property_maps else []
        events = list(self.a.owned("Event", "EventMap", 1, self.event_maps[n])) if n in self.event_maps else []
        accessors = {m for kind, rows in (("Property", properties), ("Event", events)) for r in rows for _, m in self.a.semantics.get((kind, r), ())}

        def read(kind: str, name: int, one: Callable[[], dict | None]) -> None:
            said = self.a.string(name)
            self.attempt(kind, n, said, lambda: out.extend(filter(None, [one()])))

        for m in self.a.owned("MethodDef", "TypeDef", 5, n):
            _, _, flags, name, *_ = self.a.row("MethodDef", m)
            if m not in accessors and flags & 7 in ACCESS:
                read("method", name, lambda m=m: self.method(m, scope))
        for p in properties:
            read("property", self.a.row("Property", p)[1], lambda p=p: self.property(p, scope))
        for e in events:
            read("event", self.a.row("Event", e)[1], lambda e=e: self.event(e, scope))
        for f in self.a.owned("Field", "TypeDef", 4, n):
            if self.a.row("Field", f)[0] & 7 in ACCESS:
                read("field", self.a.row("Field", f)[1], lambda f=f: self.field(f, scope))
        return out

    def member(self, kind: str, n: int, name: str, signature: str, letter: str, suffix: str, scope: Scope, **parts: object) -> dict:
        row = ({"event": "Event", "field": "Field", "property": "Property", "indexer": "Property"}.get(kind, "MethodDef"), n)
        escaped = name.translate(str.maketrans(".<>", "#{}"))
        shown = parts.pop("shown", name)
        ecma = f"{letter}:{self.names.of(('TypeDef', scope.row))}.{escaped}{suffix}"
        empty = {"Parameters": [], "ReturnType": None, "Constraints": []}
        return {"EcmaId": ecma, "Name": shown, "Kind": kind, "Signature": signature, **empty, **parts, "Attributes": self.applied(row, scope.row, name)}

    def is_interface(self, scope: Scope) -> bool:
        return bool(self.a.row("TypeDef", scope.row)[0] & INTERFACE)

    def parameter_rows(self, m: int) -> dict[int, tuple[int, int, str]]:
        """(row, flags, name) of a method's parameters by place, 0 being what it returns."""
        found = {}
        for p in self.a.owned("Param", "MethodDef", 5, m):
            flags, place, name = self.a.row("Param", p)
            found[place] = (p, flags, self.a.string(name))
        return found

    def parameter(self, t: Type, stated: tuple[int, int, str] | None, place: int, default: int, bare: bool = False) -> tuple[str, dict]:
        """(as it is declared, its use). ``bare``: an indexer's, which says no modifier."""
        n, flags, name = stated or (0, 0, "")
        name = name or f"arg{place}"
        row = ("Param", n) if n else None
        plain(t, f"parameter '{name}'", at_reference=frozenset(READ_ONLY))
        word = ""
        if t.bare.kind == "reference":
            require((not bare, f"parameter '{name}' of an indexer is a reference"))
            word = "out" if flags & OUT else "in" if flags & IN or _read_only(t) else "ref"
        elif row and not bare and self.attributes.has(row, "System.ParamArrayAttribute"):
            word = "params"
        use = self.use(t, row, default, name, f"{word} " if word else "")
        return f"{use['TypeExpression']} {name}", use

    def method(self, m: int, scope: Scope) -> dict:
        _, _, flags, name, blob, _ = self.a.row("MethodDef", m)
        name, row = self.a.string(name), ("MethodDef", m)
        scope = Scope(scope.row, scope.parameters, self.nullable_default(row, scope.nullable), self.parameters(row))
        s = Decoder(self.names, scope.parameters, scope.methods).method(self.a.blob(blob))
        constructor = name in (".ctor", ".cctor")
        operator = not constructor and name.startswith("op_") and bool(flags & SPECIAL)
        rows = self.parameter_rows(m)
        if constructor:
            check_constructor(name, flags, s, len(scope.methods))
        elif operator:
            self.check_operator(name, flags, s, scope, rows)
        declared, uses = zip(*(self.parameter(t, rows.get(i + 1), i, scope.nullable) for i, t in enumerate(s.parameters)), strict=True) if s.parameters else ((), ())
        back = rows.get(0)
        at = ("Param", back[0]) if back else None
        plain(s.returns, f"what '{name}' returns", at_reference=frozenset(READ_ONLY))
        before = _returned(s.returns, back[1] if back else 0)
        returned = self.use(s.returns, at, scope.nullable, None, before)
        bare = self.a.string(self.a.row("TypeDef", scope.row)[1]).partition("`")[0]
        if constructor:
            head = bare
        elif name in CONVERSIONS and operator:
            head = f"{CONVERSIONS[name]} {self.say(s.returns, at, scope.nullable)}"
        else:
            said = OPERATORS.get(name, name) if operator else name + (f"<{', '.join(scope.methods)}>" if scope.methods else "")
            head = f"{returned['TypeExpression']} {said}"
        clauses = "".join(f" where {p} : {', '.join(c['TypeExpression'] for c in parts)}" for p, parts in self.constraint_parts(row, scope))
        signature = f"{ACCESS[flags & 7]} {method_words(flags, self.is_interface(scope))}{head}({', '.join(declared)}){clauses};"
        suffix = (f"``{s.generic}" if s.generic else "") + _listed(s.parameters) + (f"~{declaration_id(s.returns)}" if name in CONVERSIONS else "")
        kind = "constructor" if constructor else "operator" if operator else "method"
        none = constructor or s.returns == VOID
        return self.member(
            kind, m, name, signature, "M", suffix, scope, Parameters=list(uses), ReturnType=None if none else returned, Constraints=self.constraint_uses(row, scope), shown=bare if constructor else name
        )

    def check_operator(self, name: str, flags: int, s: Signature, scope: Scope, rows: dict) -> None:
        me = self.names.of(("TypeDef", scope.row))
        is_me = lambda t: (t.name == me and [x.place for x in t.inner if x.kind == "parameter" and not x.of_method] == list(range(len(t.inner))) and len(t.inner) == len(scope.parameters))
        operand = lambda t: t.bare.inner[0] if t.bare.kind == "reference" else t.bare
        read_only = lambda i, t: _read_only(t) or bool(rows.get(i + 1, (0, 0, ""))[1] & IN)
        takes_me = any(is_me(operand(t)) for t in s.parameters)
        conversion = name in CONVERSIONS
        require(
            (name in OPERATORS or conversion, f"operator '{name}' is unknown"),
            (flags & 7 == 6 and bool(flags & STATIC) and not s.instance, f"operator '{name}' must be public and static"),
            (not s.generic and not scope.methods, f"operator '{name}' can't be generic"),
            (s.returns.bare != VOID and s.returns.bare.kind != "reference", f"operator '{name}' must return a value"),
            (all(t.bare.kind != "reference" or read_only(i, t) for i, t in enumerate(s.parameters)), f"operator '{name}' takes a reference that may be written"),
            (len(s.parameters) == (1 if name in ONE_OPERAND else 2), f"operator '{name}' has {len(s.parameters)} operands"),
            (takes_me or conversion and is_me(s.returns.bare), f"operator '{name}' has nothing to do with '{me}'"),
            (not conversion or operand(s.parameters[0]) != s.returns.bare, f"conversion '{name}' must change the type"),
            (name not in STEPS or is_me(s.returns.bare), f"operator '{name}' must return '{me}'"),
            (name not in TRUTHS or s.returns.bare.name == "System.Boolean", f"operator '{name}' must return a Boolean"),
        )

    # -- members with accessors

    def accessors(self, row: Row, name: str, known: tuple[int, ...], others: int) -> tuple[dict[int, tuple[int, int, Signature]], str | None, Callable[[int], Signature]]:
        """{meaning: (method, flags, blob)} of an event's or property's accessors, and the widest access among them, none if it isn't visible."""
        found, widest = {}, 0
        for meaning, m in self.a.semantics.get(row, ()):
            flags = self.a.row("MethodDef", m)[2]
            if meaning & others and flags & 7 in ACCESS:
                raise refused(f"'{name}' has a visible accessor that C# has no word for")
            if meaning in known:
                found[meaning] = (m, flags)
                widest = max(widest, flags & 7 if flags & 7 in ACCESS else 0)
        return found, ACCESS.get(widest)

    def accessor(self, m: int, flags: int, expected: str, scope: Scope) -> Signature:
        """An accessor's signature, if it is one."""
        _, _, _, name, blob, _ = self.a.row("MethodDef", m)
        name = self.a.string(name)
        s = Decoder(self.names, scope.parameters, ()).method(self.a.blob(blob))
        require(
            (name == expected, f"accessor '{name}' should be named '{expected}'"), (bool(flags & SPECIAL), f"accessor '{name}' isn't marked as one"), (not s.generic, f"accessor '{name}' can't be generic"),
            (not s.explicit and s.instance != bool(flags & STATIC), f"accessor '{name}' is called in a way that contradicts it"),
        )
        return s

    def property(self, p: int, scope: Scope) -> dict | None:
        _, name, blob = self.a.row("Property", p)
        name, row = self.a.string(name), ("Property", p)
        found, access = self.accessors(row, name, (GETTER, SETTER), OTHER)
        if access is None:
            return None
        default = self.nullable_default(row, scope.nullable)
        s = Decoder(self.names, scope.parameters, ()).method(self.a.blob(blob))
        words = {}
        if GETTER in found:
            m, flags = found[GETTER]
            g = self.accessor(m, flags, f"get_{name}", scope)
            require((g.returns == s.returns and g.parameters == s.parameters, f"the getter of '{name}' doesn't fit it"))
            words[GETTER] = "get"
        if SETTER in found:
            m, flags = found[SETTER]
            g = self.accessor(m, flags, f"set_{name}", scope)
            plain(g.returns, f"what the setter of '{name}' returns", at_root=frozenset({INIT}))
            require((g.returns.bare == VOID, f"the setter of '{name}' returns a value"), (g.parameters == (*s.parameters, s.returns), f"the setter of '{name}' doesn't fit it"))
            words[SETTER] = "init" if INIT in g.returns.modifiers else "set"
        shown = [f"{'' if ACCESS[found[k][1] & 7] == access else ACCESS[found[k][1] & 7] + ' '}{w};" for k, w in words.items() if found[k][1] & 7 in ACCESS]
        rows = self.parameter_rows(found.get(GETTER, found.get(SETTER))[0])
        declared, uses = zip(*(self.parameter(t, rows.get(i + 1), i, default, True) for i, t in enumerate(s.parameters)), strict=True) if s.parameters else ((), ())
        plain(s.returns, f"the type of '{name}'", at_reference=frozenset(READ_ONLY))
        returned = self.use(s.returns, row, default, None, _returned(s.returns, 0))
        head = f"this[{', '.join(declared)}]" if declared else name
        flags = declared_flags([f for _, f in found.values()], self.is_interface(scope), name)
        signature = f"{access} {accessor_words(flags)}{returned['TypeExpression']} {head} {{ {' '.join(shown)} }}"
        return self.member("indexer" if declared else "property", p, name, signature, "P", _listed(s.parameters), scope, Parameters=list(uses), ReturnType=returned)

    def event(self, e: int, scope: Scope) -> dict | None:
        _, name, of = self.a.row("Event", e)
        name, row = self.a.string(name), ("Event", e)
        found, access = self.accessors(row, name, (ADDER, REMOVER), OTHER | RAISER)
        if access is None:
            return None
        t = Decoder(self.names, scope.parameters, ()).row(of)
        plain(t, f"event '{name}'")
        require((len(found) == 2, f"event '{name}' needs an adder and a remover"))
        require((len({f & 7 for _, f in found.values()}) == 1, f"the accessors of event '{name}' differ in access"))
        for meaning, word in ((ADDER, "add"), (REMOVER, "remove")):
            m, flags = found[meaning]
            s = self.accessor(m, flags, f"{word}_{name}", scope)
            same = len(s.parameters) == 1 and (s.parameters[0].kind, s.parameters[0].name, s.parameters[0].inner) == (t.kind, t.name, t.inner)
            require((s.returns == VOID and same, f"accessor '{word}_{name}' doesn't fit its event"))
        flags = declared_flags([f for _, f in found.values()], self.is_interface(scope), name)
        returned = self.use(t, row, self.nullable_default(row, scope.nullable))
        return self.member("event", e, name, f"{access} {accessor_words(flags)}event {returned['TypeExpression']} {name};", "E", "", scope, ReturnType=returned)

    def field(self, f: int, scope: Scope) -> dict:
        flags, name, blob = self.a.row("Field", f)
        name, row = self.a.string(name), ("Field", f)
        t = Decoder(self.names, scope.parameters, ()).field(self.a.blob(blob))
        plain(t, f"field '{name}'", at_root=frozenset({VOLATILE}))
        words = "const " if flags & LITERAL else "".join(w for holds, w in ((flags & STATIC, "static "), (flags & INIT_ONLY, "readonly "), (VOLATILE in t.modifiers, "volatile ")) if holds)
        returned = self.use(t, row, self.nullable_default(row, scope.nullable))
        return self.member("field", f, name, f"{ACCESS[flags & 7]} {words}{returned['TypeExpression']} {name};", "F", "", scope, ReturnType=returned)


def _read_only(t: Type) -> bool:
    inside = t.bare.inner[0] if t.bare.kind == "reference" else t.bare
    return bool((t.modifiers | inside.modifiers) & READ_ONLY)


def _returned(t: Type, flags: int) -> str:
    return "" if t.bare.kind != "reference" else "ref readonly " if flags & IN or _read_only(t) else "ref "


def _listed(parameters: tuple[Type, ...]) -> str:
    return f"({','.join(map(declaration_id, parameters))})" if parameters else ""


def check_constructor(name: str, flags: int, s: Signature, n_parameters: int) -> None:
    require(
        (flags & (SPECIAL | RUNTIME_SPECIAL) == SPECIAL | RUNTIME_SPECIAL, f"'{name}' isn't marked as a constructor"), (not flags & (ABSTRACT | VIRTUAL | FINAL | NEW_SLOT), f"'{name}' has flags that no constructor has"),
        (s.returns == VOID, f"'{name}' returns a value"), (not s.generic and not n_parameters, f"'{name}' can't be generic"),
    )
    if name == ".ctor":
        require((not flags & STATIC and s.instance, "a constructor must be of an instance"))
    else:
        require((bool(flags & STATIC) and not s.instance and not s.parameters and flags & 7 == 1, "a type's initialiser must be private, static and without parameters"))


_MEANING = STATIC | ABSTRACT | VIRTUAL | FINAL | NEW_SLOT | IMPORTED


def meaning(flags: int, interface: bool) -> int:
    """The flags that a declaration's words depend on. A new slot that is final only implements an interface, which C# has no word for."""
    kept = flags & _MEANING
    return 0 if kept == FINAL | VIRTUAL | NEW_SLOT and not interface else kept


def method_words(flags: int, interface: bool) -> str:
    kept = meaning(flags, interface)
    words = ["static"] if flags & STATIC else []
    if kept & ABSTRACT:
        words.append("abstract")
    elif kept & VIRTUAL:
        words.append("sealed override" if kept & FINAL else "virtual" if kept & NEW_SLOT else "override")
    if flags & IMPORTED:
        words.append("extern")
    return "".join(w + " " for w in words)


def declared_flags(all_flags: list[int], interface: bool, name: str) -> int:
    """What the visible accessors agree on."""
    seen = {meaning(f, interface) for f in all_flags if f & 7 in ACCESS}
    require((len(seen) == 1, f"the accessors of '{name}' differ in their modifiers"))
    kept = seen.pop()
    static, virtual = bool(kept & STATIC), bool(kept & VIRTUAL)
    odd = kept & IMPORTED or kept & (ABSTRACT | FINAL) and not virtual or static and (kept & FINAL or kept & NEW_SLOT and not virtual)
    require((not odd, f"the accessors of '{name}' have modifiers that C# has no words for"), (not (static and virtual) or interface, f"static virtual accessors of '{name}' need an interface"))
    return kept


def accessor_words(kept: int) -> str:
    static, virtual, new = kept & STATIC, kept & VIRTUAL, kept & NEW_SLOT
    if static:
        return "static abstract " if kept & ABSTRACT else "static virtual " if virtual else "static "
    if kept & ABSTRACT:
        return "abstract " if new else "abstract override "
    return "" if not virtual else "sealed override " if kept & FINAL else "virtual " if new else "override "


def read_assembly(content: bytes) -> dict:
    """{"Types": [...], "Skipped": [...]} of an assembly's bytes, without documentation."""
    try:
        return Reader(content).corpus()
    except BROKEN as e:
        raise malformed(repr(e)) from e


def read_named(content: bytes, name: str) -> dict:
    """The same, of an assembly that must bear the name."""
    found = assembly_name(content)
    require((found == name, f"the assembly is named '{found}', not '{name}'"))
    return read_assembly(content)


_ROWS = "path string, type_id string, full_name string, declaration_id string, name string, kind string, signature string, return_type string, skipped string, error string"


def member_rows(files: DataFrame) -> DataFrame:
    """A row of each visible member of assemblies (path, content), of each declaration that is skipped, and of each file that is refused."""
    schema = to_arrow_schema(StructType.fromDDL(_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    got = read_assembly(content.as_py())
                except QueryError as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], schema=schema)
                    continue
                rows = [{"path": path, "full_name": s["DeclaringType"], "name": s["Name"], "kind": s["Kind"], "skipped": s["Reason"]} for s in got["Skipped"]]
                for t in got["Types"]:
                    head = {"path": path, "type_id": t["EcmaId"], "full_name": t["FullName"]}
                    for m in t["Members"]:
                        returned = (m["ReturnType"] or {}).get("TypeExpression")
                        rows.append(head | {"declaration_id": m["EcmaId"], "name": m["Name"], "kind": m["Kind"], "signature": m["Signature"], "return_type": returned})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, _ROWS)


def assembly_name(content: bytes) -> str:
    try:
        a = Assembly(content)
        return a.string(a.row("Assembly", 1)[7])
    except BROKEN as e:
        raise malformed(repr(e)) from e
