import random
import struct

import pytest

from quarry.errors import QueryError
from quarry.plans.assembly_writer import BOOL, BYTE, INT, LONG, OBJECT, TEXT, VOID, Builder, cls, grid, mvar, of, packed, ref, required, said, signature, val, var, vector
from quarry.sources import assemblies, attributes, corpus_rules, packages, pe, signatures

PUBLIC, STATIC, FINAL, VIRTUAL, NEW, ABSTRACT, SPECIAL = 6, 0x10, 0x20, 0x40, 0x100, 0x400, 0x800
CONSTRUCTOR = PUBLIC | SPECIAL | 0x1000


def library():
    """An assembly with a shop in it."""
    b = Builder()
    thing, value, enum = b.outer("System.Object"), b.outer("System.ValueType"), b.outer("System.Enum")
    handler, nullable, list_, tuple_, decimal = (b.outer(n) for n in ("System.EventHandler", "System.Nullable`1", "System.Collections.Generic.List`1", "System.ValueTuple`2", "System.Decimal"))

    item = b.type("IItem", flags=0xA1)
    get = b.method("get_Name", signature(TEXT), PUBLIC | VIRTUAL | NEW | ABSTRACT | SPECIAL)
    b.property(item, "Name", signature(TEXT, kind=8), get, first=True)
    b.nullable(("Property", 1), 2)
    b.method("Make", signature(INT, static=True), PUBLIC | STATIC | VIRTUAL | ABSTRACT)

    kind = b.type("Kind", flags=0x101, base=enum)
    b.field("value__", BYTE, 0x606)
    for name, v in (("None", 0), ("Fresh", 1), ("Frozen", 2)):
        b.field(name, val(kind), 0x8056, (5, bytes([v])))
    b.attribute(kind, b.outer("System.FlagsAttribute"), (), b"")

    marked = b.type("MarkedAttribute", base=b.outer("System.Attribute"))
    b.method(".ctor", signature(VOID, val(kind), cls(b.outer("System.Type")), vector(INT)), CONSTRUCTOR, [("kind", 0), ("type", 0), ("sizes", 0)])
    made = ("MethodDef", len(b.tables["MethodDef"]))

    till = b.type("Till`1", flags=0x81, base=thing, parameters=[("T", 0x14, item)], interfaces=[item])
    b.attribute(till, b.outer("System.Runtime.CompilerServices.NullableContextAttribute"), (BYTE,), b"\1")
    value_bytes = bytes([3]) + said("System.String, mscorlib") + struct.pack("<III", 2, 7, 8)
    b.row("CustomAttribute", till, made, b.blob(b"\1\0" + value_bytes + struct.pack("<H", 2) + b"\x54\x0e" + said("Text") + said('a "b"\n') + b"\x53\x55" + said("Lib.Kind") + said("Other") + b"\x09"))
    b.attribute(till, b.outer("Far.OddAttribute"), (val(b.outer("Far.Enum")),), b"\0\0\0\0")
    b.attribute(till, b.outer("System.AttributeUsageAttribute"), (val(b.outer("System.AttributeTargets")),), struct.pack("<I", 4 | 8))
    self_ = of(till, var(0))
    b.method(".ctor", signature(VOID, INT), CONSTRUCTOR, [("size", 0)])
    b.method(".cctor", signature(VOID, static=True), 1 | STATIC | SPECIAL | 0x1000)
    b.method("Find", signature(mvar(0), ref(INT), ref(TEXT), vector(OBJECT), generic=1), PUBLIC | VIRTUAL | NEW, [("at", 1), ("text", 2), ("rest", 0)], generic=[("K", 0x18, value)])
    b.nullable(b.param(1), 2)
    b.attribute(b.param(), b.outer("System.ParamArrayAttribute"), (), b"")
    b.method("op_Addition", signature(self_, self_, self_, static=True), PUBLIC | STATIC | SPECIAL, [("a", 0), ("b", 0)])
    b.method("op_Explicit", signature(INT, self_, static=True), PUBLIC | STATIC | SPECIAL, [("a", 0)])
    b.method("op_Addition", signature(INT, INT, INT, static=True), PUBLIC | STATIC | SPECIAL, [("a", 0), ("b", 0)])
    b.method("Hidden", signature(VOID), 1)
    b.method("Odd", signature(required(b.outer("Far.Modifier"), INT)), PUBLIC)
    b.method("Peek", signature(ref(required(b.outer("System.Runtime.InteropServices.InAttribute"), INT))), 4 | VIRTUAL)
    b.method("Equals", signature(BOOL, OBJECT), PUBLIC | VIRTUAL | FINAL, [("other", 0)])
    b.nullable(b.param(), 2)
    b.method("Pairs", signature(of(list_, of(tuple_, INT, TEXT, value=True)), of(nullable, INT, value=True), vector(TEXT)), PUBLIC, [("a", 0), ("b", 0)], returned=0)
    back = b.param(2)
    b.nullable(back, [1, 0, 2])
    b.attribute(back, b.outer("System.Runtime.CompilerServices.TupleElementNamesAttribute"), (vector(TEXT),), struct.pack("<I", 2) + said("n") + said(None))
    b.nullable(b.param(), [2, 1])
    accessor = lambda name, s, flags=PUBLIC, parameters=(): b.method(name, s, flags | SPECIAL, parameters)
    name_get, name_set = accessor("get_Name", signature(TEXT), PUBLIC | VIRTUAL | FINAL | NEW), accessor("set_Name", signature(VOID, TEXT), 1, [("value", 0)])
    item_get, item_set = accessor("get_Item", signature(var(0), INT), PUBLIC, [("at", 0)]), accessor("set_Item", signature(VOID, INT, var(0)), 4, [("at", 0), ("value", 0)])
    size_get = accessor("get_Size", signature(val(decimal)), PUBLIC | VIRTUAL)
    size_set = accessor("set_Size", signature(required(b.outer("System.Runtime.CompilerServices.IsExternalInit"), VOID), val(decimal)), PUBLIC | VIRTUAL, [("value", 0)])
    bad_get = accessor("get_Bad", signature(INT))
    add, remove = (accessor(f"{w}_Changed", signature(VOID, cls(handler)), PUBLIC, [("value", 0)]) for w in ("add", "remove"))
    b.property(till, "Name", signature(TEXT, kind=8), name_get, name_set, first=True)
    b.nullable(("Property", len(b.tables["Property"])), 2)
    b.property(till, "Item", signature(var(0), INT, kind=8), item_get, item_set)
    b.property(till, "Size", signature(val(decimal), kind=8), size_get, size_set)
    b.property(till, "Bad", signature(LONG, kind=8), bad_get)
    b.event(till, "Changed", handler, add, remove)
    b.field("Max", INT, 0x8056, (8, struct.pack("<i", 3)))
    b.field("Started", LONG, PUBLIC | STATIC | 0x20)
    b.field("ready", required(b.outer("System.Runtime.CompilerServices.IsVolatile"), BOOL), 5)
    b.field("Grid", grid(vector(INT)))
    b.field("Skewed", b"\x14" + INT + packed(1) + packed(0) + packed(0))

    b.type("Part`1", "", 2, thing, till, ["T", "K"])
    b.field("Both", of(till, var(1)))
    b.type("Secret", flags=0)
    b.type("Inside", "", 2, thing, ("TypeDef", len(b.tables["TypeDef"])))
    return b


def read(b):
    got = assemblies.read_assembly(b.build())
    return {t["FullName"]: t for t in got["Types"]}, got["Skipped"]


def test_types():
    types, _ = read(library())
    assert sorted(types) == ["Lib.IItem", "Lib.Kind", "Lib.MarkedAttribute", "Lib.Till<T>", "Lib.Till<T>.Part<K>"]
    t = types["Lib.Till<T>"]
    assert (t["EcmaId"], t["Name"], t["BaseType"]["TypeExpression"]) == ("T:Lib.Till`1", "Till<T>", "object")
    assert [i["TypeExpression"] for i in t["Interfaces"]] == ["Lib.IItem"] and types["Lib.IItem"]["BaseType"] is None
    assert [(c["Name"], c["TypeExpression"], c["TypeNames"]) for c in t["Constraints"]] == [("T", "class", []), ("T", "Lib.IItem", ["Lib.IItem"]), ("T", "new()", [])]
    assert types["Lib.Till<T>.Part<K>"]["EcmaId"] == "T:Lib.Till`1.Part`1"


def test_members_as_they_are_declared():
    types, _ = read(library())
    said_ = {m["EcmaId"]: m["Signature"] for t in types.values() for m in t["Members"]}
    assert said_ == {
        "P:Lib.IItem.Name": "public abstract string? Name { get; }",
        "M:Lib.IItem.Make": "public static abstract int Make();",
        "F:Lib.Kind.value__": "public byte value__;",
        "F:Lib.Kind.None": "public const Lib.Kind None;", "F:Lib.Kind.Fresh": "public const Lib.Kind Fresh;", "F:Lib.Kind.Frozen": "public const Lib.Kind Frozen;",
        "M:Lib.MarkedAttribute.#ctor(Lib.Kind,System.Type,System.Int32[])": "public MarkedAttribute(Lib.Kind kind, System.Type type, int[] sizes);",
        "M:Lib.Till`1.#ctor(System.Int32)": "public Till(int size);",
        "M:Lib.Till`1.Find``1(System.Int32@,System.String@,System.Object[])": "public virtual K Find<K>(in int at, out string? text, params object[] rest) where K : struct;",
        "M:Lib.Till`1.op_Addition(Lib.Till{`0},Lib.Till{`0})": "public static Lib.Till<T> operator +(Lib.Till<T> a, Lib.Till<T> b);",
        "M:Lib.Till`1.op_Explicit(Lib.Till{`0})~System.Int32": "public static explicit operator int(Lib.Till<T> a);",
        "M:Lib.Till`1.Peek": "protected override ref readonly int Peek();",
        "M:Lib.Till`1.Equals(System.Object)": "public sealed override bool Equals(object? other);",
        "M:Lib.Till`1.Pairs(System.Nullable{System.Int32},System.String[])": "public System.Collections.Generic.List<(int n, string?)> Pairs(int? a, string[]? b);",
        "P:Lib.Till`1.Name": "public string? Name { get; }",
        "P:Lib.Till`1.Item(System.Int32)": "public T this[int at] { get; protected set; }",
        "P:Lib.Till`1.Size": "public override decimal Size { get; init; }",
        "E:Lib.Till`1.Changed": "public event System.EventHandler Changed;",
        "F:Lib.Till`1.Max": "public const int Max;", "F:Lib.Till`1.Started": "public static readonly long Started;", "F:Lib.Till`1.ready": "protected internal volatile bool ready;",
        "F:Lib.Till`1.Grid": "public int[][,] Grid;", "F:Lib.Till`1.Part`1.Both": "public Lib.Till<K> Both;",
    }
    pairs = next(m for m in types["Lib.Till<T>"]["Members"] if m["Name"] == "Pairs")
    assert pairs["ReturnType"]["TypeNames"] == ["System.Collections.Generic.List", "System.Int32", "System.String", "System.ValueTuple"]
    find = next(m for m in types["Lib.Till<T>"]["Members"] if m["Name"] == "Find")
    assert [(p["Name"], p["TypeExpression"]) for p in find["Parameters"]] == [("at", "in int"), ("text", "out string?"), ("rest", "params object[]")]
    assert {m["Kind"] for t in types.values() for m in t["Members"]} == {"constructor", "method", "operator", "property", "indexer", "event", "field"}


def test_attributes_and_what_is_skipped():
    types, skipped = read(library())
    assert [(a["Application"], a["AttributeType"], a["ArgumentTypeNames"]) for a in types["Lib.Till<T>"]["Attributes"]] == [
        ('[Lib.Marked(Lib.Kind.Fresh | Lib.Kind.Frozen, typeof(string), new[] { 7, 8 }, Text = "a \\"b\\"\\n", Other = (Lib.Kind)9)]', "Lib.MarkedAttribute", ["Lib.Kind", "System.String"]),
        ("[System.AttributeUsage(System.AttributeTargets.Class | System.AttributeTargets.Struct)]", "System.AttributeUsageAttribute", ["System.AttributeTargets"]),
    ]
    assert sorted((s["Kind"], s["Name"] or "") for s in skipped) == [("attribute", ""), ("field", "Skewed"), ("method", "Odd"), ("method", "op_Addition"), ("property", "Bad")]
    assert all(s["DeclaringType"] == "Lib.Till`1" and s["Reason"] for s in skipped)


def test_a_corpus_that_the_rules_accept():
    content = library().build()
    docs = {"M:Lib.Till`1.#ctor(System.Int32)": {"summary": "Opens it.", "parameters": [{"name": "size", "text": "How large."}]}}
    text = packages.corpus_json("Lib", "1.0.0", "h", "net8.0", packages.documented(assemblies.read_assembly(content), docs))
    stored = corpus_rules.load(text)
    opened = [m["Documentation"]["Summary"] for t in stored["Corpus"]["Types"] for m in t["Members"] if m["Kind"] == "constructor"]
    assert sorted(opened, key=str) == [None, "Opens it."]
    assert assemblies.assembly_name(content) == "Lib"


@pytest.mark.parametrize("change, reason", [
    (lambda b, t: b.method("op_Addition", signature(INT, cls(t), cls(t), generic=1, static=True), PUBLIC | STATIC | SPECIAL), "generic"),
    (lambda b, t: b.method("op_True", signature(INT, cls(t), static=True), PUBLIC | STATIC | SPECIAL), "Boolean"),
    (lambda b, t: b.method("op_Increment", signature(INT, cls(t), static=True), PUBLIC | STATIC | SPECIAL), "must return"),
    (lambda b, t: b.method("op_Implicit", signature(cls(t), cls(t), static=True), PUBLIC | STATIC | SPECIAL), "change the type"),
    (lambda b, t: b.method("op_Nonsense", signature(INT, cls(t), static=True), PUBLIC | STATIC | SPECIAL), "unknown"),
    (lambda b, t: b.method("op_Division", signature(INT, cls(t), static=True), PUBLIC | STATIC | SPECIAL), "operands"),
    (lambda b, t: b.method("op_Division", signature(INT, ref(cls(t)), INT, static=True), PUBLIC | STATIC | SPECIAL, [("a", 0), ("b", 0)]), "written"),
    (lambda b, t: b.method("op_Division", signature(INT, cls(t), INT), PUBLIC | SPECIAL), "static"),
    (lambda b, t: b.method(".ctor", signature(INT), CONSTRUCTOR), "returns"), (lambda b, t: b.method(".ctor", signature(VOID), PUBLIC), "marked"), (lambda b, t: b.method(".ctor", signature(VOID), CONSTRUCTOR | VIRTUAL), "flags"),
    (lambda b, t: b.method("Points", b"\x20\0\x1b\0\0\1"), "unsupported"), (lambda b, t: b.method("Calls", b"\x23\0\x08"), "convention"),
    (lambda b, t: b.method("Short", b"\x20\x05\x08"), "ends early"), (lambda b, t: b.method("Far", signature(var(3))), "isn't declared"), (lambda b, t: b.method("Inner", signature(vector(ref(INT)))), "reference"),
    (lambda b, t: b.nullable(b.method("Flags", signature(TEXT), returned=0) and b.param(), [1, 2]), "positions"), (lambda b, t: b.nullable(b.method("Flag", signature(TEXT), returned=0) and b.param(), 7), "unknown flag"),
])
def test_members_that_contradict_themselves(change, reason):
    b = Builder()
    t = b.type("Thing", base=b.outer("System.Object"))
    change(b, t)
    got = assemblies.read_assembly(b.build())
    assert got["Types"][0]["Members"] == [] and len(got["Skipped"]) == 1 and reason in got["Skipped"][0]["Reason"], got


@pytest.mark.parametrize("flags, words", [
    (PUBLIC, ""), (PUBLIC | STATIC, "static "), (PUBLIC | VIRTUAL | NEW, "virtual "), (PUBLIC | VIRTUAL, "override "), (PUBLIC | VIRTUAL | FINAL, "sealed override "), (PUBLIC | VIRTUAL | FINAL | NEW, ""), (PUBLIC | VIRTUAL | ABSTRACT | NEW, "abstract "),
    (PUBLIC | STATIC | 0x2000, "static extern "),
])
def test_words_of_methods(flags, words):
    assert assemblies.method_words(flags, False) == words
    if flags & FINAL and flags & NEW:
        assert assemblies.method_words(flags, True) == "sealed override "


@pytest.mark.parametrize("kind, value, text", [
    ("System.String", 'a\\b"\t', '"a\\\\b\\"\\t"'), ("System.Char", "'", "'\\''"), ("System.Boolean", True, "true"), ("System.Int32", -4, "-4"), ("System.Single", 0.5, "0.5F"), ("System.Double", 1e300, "1E+300D"), ("System.Double", 3.0, "3D"), ("System.String", None, "null"),
])
def test_literals(kind, value, text):
    assert attributes.literal(kind, value) == text


@pytest.mark.parametrize("text, shown", [
    ("System.Int32, mscorlib, Version=4.0.0.0", "int"), ("Ns.Outer+Inner", "Ns.Outer.Inner"), ("Ns.Of`2[[System.String, a],[Ns.X`1[[System.Int32]]]][]", "Ns.Of<string, Ns.X<int>>[]"), ("System.Int32[,]", "int[,]"), ("System.Byte*", "byte*"),
])
def test_names_of_reflection(text, shown):
    assert signatures.csharp(attributes.parse_name(text)) == shown
    for bad in ("", "[", "A`1[[B", "A]"):
        with pytest.raises(QueryError):
            attributes.parse_name(bad)


def test_a_tuple_of_nine():
    ints = tuple(signatures.Type("named", "System.Int32", value=True) for _ in range(7))
    rest = signatures.Type("generic", "System.ValueTuple`2", (signatures.Type("named", "System.String"), ints[0]), True)
    t = signatures.Type("generic", "System.ValueTuple`8", (*ints, rest), True)
    assert signatures.csharp(t, [0, 0, 2], 0, [*"abcdefgh", None]) == "(int a, int b, int c, int d, int e, int f, int g, string? h, int)"
    assert signatures.declaration_id(t) == "System.ValueTuple{" + "System.Int32," * 7 + "System.ValueTuple{System.String,System.Int32}}"
    with pytest.raises(QueryError):
        signatures.csharp(t, None, 0, ["a"])


def test_bytes_that_are_no_assembly_are_refused():
    whole = library().build()
    for bad in (b"", b"MZ", b"x" * 2000, whole[:0x300], whole[:-200], whole.replace(b"BSJB", b"XXXX"), whole.replace(b"PE\0\0", b"NE\0\0"), whole.replace(b"#~\0\0", b"#x\0\0")):
        with pytest.raises(QueryError) as e:
            assemblies.read_assembly(bad)
        assert e.value.code == "source_invalid"
    rng = random.Random(1)
    for _ in range(400):  # whatever is changed, it is read, skipped or refused, and never anything else
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(0x200, len(data))] = rng.randrange(256)
        try:
            got = assemblies.read_assembly(bytes(data))
            assert set(got) == {"Types", "Skipped"}
        except QueryError:
            pass


def test_repeated_ids_refuse_the_whole():
    b = Builder()
    b.type("Thing")
    b.type("Thing")
    with pytest.raises(QueryError, match="repeated"):
        assemblies.read_assembly(b.build())


def test_packed_numbers():
    for n in (0, 1, 0x7F, 0x80, 0x3FFF, 0x4000, 0x1FFFFFFF):
        assert pe.Bytes(packed(n)).packed() == n
    for data, n in ((b"\x06", 3), (b"\x7b", -3), (b"\x80\x80", 64), (b"\x01", -64), (b"\xc0\x00\x40\x00", 8192), (b"\x80\x01", -8192)):
        assert pe.Bytes(data).packed_signed() == n


def test_a_package_is_read_whole(spark):
    import io
    import zipfile

    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("lib/net8.0/Lib.dll", library().build())
        z.writestr("lib/net8.0/Lib.xml", '<doc><members><member name="T:Lib.Till`1"><summary>A till.</summary></member></members></doc>')
        z.writestr("lib/net9.0/Lib.dll", b"no assembly")
        z.writestr("lib/net9.0/Lib.xml", "<doc><members/></doc>")
    files = spark.createDataFrame([("p", bytearray(f.getvalue()))], "path string, content binary")
    built = {r.framework: r for r in packages.build_corpora(packages.read_archives(files, "Lib"), "Lib", "1.0.0", "h", assemblies.read_assembly).collect()}
    assert built["net9.0"].corpus is None and "malformed" in built["net9.0"].error
    stored = corpus_rules.load(bytes(built["net8.0"].corpus))
    assert [t["Documentation"]["Summary"] for t in stored["Corpus"]["Types"] if t["EcmaId"] == "T:Lib.Till`1"] == ["A till."] and len(stored["Corpus"]["Skipped"]) == 5
