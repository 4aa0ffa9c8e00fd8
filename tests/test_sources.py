import io
import json
import zipfile

import pytest

from quarry.errors import QueryError
from quarry.plans import docs, service
from quarry.sources import api_xml, catalog, corpus_rules, documents, packages

FAQ = "### YamlMime:FAQ\ntitle: T\nsummary: About it.\nsections:\n  - name: First\n    questions:\n      - question: |\n          Why\n          so?\n        answer: Because.\n      - question: How?\n        answer: Like this.\n"
TYPE = """<Type Name="Box" FullName="Lib.Box&lt;T&gt;"><TypeSignature Language="C#" Value="class Box"/><TypeSignature Language="DocId" Value="T:Lib.Box`1"/>
<TypeParameters><TypeParameter Name="T"><Constraints><InterfaceName>System.IDisposable</InterfaceName></Constraints></TypeParameter></TypeParameters>
<Base><BaseTypeName>System.Object</BaseTypeName></Base><Interfaces><Interface><InterfaceName>Lib.IBox</InterfaceName></Interface></Interfaces>
<Attributes><Attribute><AttributeName Language="C#">[System.Obsolete]</AttributeName><AttributeName Language="F#">x</AttributeName></Attribute></Attributes>
<Docs><summary>Holds a <see cref="T:System.String"/> or <see langword="null"/>, &amp; more.</summary><remarks>To be added.</remarks></Docs>
<Members><Member MemberName="Get"><MemberSignature Language="C#" Value="old"/><MemberSignature Language="C#" Value="public string Get(int index)"/><MemberSignature Language="DocId" Value="M:Lib.Box`1.Get(System.Int32)"/>
<MemberType>Method</MemberType><ReturnValue><ReturnType>System.String</ReturnType></ReturnValue><Parameters><Parameter Name="index" Type="System.Int32"/></Parameters>
<Docs><param name="index">Where <paramref name="index"/> points.</param><summary>Gets it.</summary><returns>The text.</returns><exception cref="T:E">Never.</exception></Docs></Member>
<Member MemberName="Gone"><MemberSignature Language="DocId" Value="bad id"/></Member>
<Member MemberName="Silent"><MemberSignature Language="F#" Value="x"/><MemberSignature Language="DocId" Value="F:Lib.Box`1.Silent"/><ReturnValue><ReturnType>System.String</ReturnType></ReturnValue><Docs><summary>Said all the same.</summary></Docs></Member></Members></Type>"""


def test_document_tree(spark, tmp_path):
    for name, content in {"a.md": "# A\ntext", "sub/b c+d.MD": "x", "f.yml": FAQ, "pipe.yml": "steps: []", "bad.yaml": "### YamlMime:FAQ\ntitle: x", "n.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    d = documents.scan(spark, str(tmp_path), "repo")
    got = {r.path: r for r in d.collect()}
    assert set(got) == {"a.md", "sub/b c+d.MD", "f.yml", "bad.yaml"}
    assert got["f.yml"].text == "About it.\n\n# First\n\n## Why so?\n\nBecause.\n\n## How?\n\nLike this.\n\n" and got["f.yml"].rendered_from == "FAQ"
    assert [r.path for r in documents.skipped(d).collect()] == ["bad.yaml"]
    found = docs.search(documents.readable(d), "Why so")
    assert [(r.path, r.line_no) for r in found.collect()] == [("f.yml", 5)]
    part = docs.get_document(documents.readable(d).select("repo", "path", "text"), "repo", "f.yml", section="First > How?")
    assert part["text"] == "## How?\n\nLike this.\n\n" and part["next"] is None
    for path, section, code in (("../x.md", None, "path_not_found"), ("none.md", None, "path_not_found"), ("a.md", "B", "section_not_found")):
        with pytest.raises(QueryError) as e:
            docs.get_document(documents.readable(d), "repo", path, section)
        assert e.value.code == code


def test_document_pages(spark):
    text = "# T\n" + "\n".join("word " * 20 for _ in range(40)) + "\n```\n" + "\n".join("code " * 20 for _ in range(5)) + "\n```\nend"
    d = spark.createDataFrame([("r", "p.md", text)], "repo string, path string, text string")
    token, parts = None, []
    while True:
        p = docs.get_document(d, "r", "p.md", limit=1000, token=token)
        parts.append(p["text"])
        if (token := p["next"]) is None:
            break
    assert "\n".join(parts) == text and len(parts) > 3 and sum("```" in p for p in parts) == 1
    with pytest.raises(QueryError):
        docs.get_document(d, "r", "p.md", limit=10)


def test_repaired_search(spark):
    d = spark.createDataFrame([("r", "p.md", "a List<int> here")], "repo string, path string, text string")
    page, used, changed = docs.search_repaired(d, "List&lt;int&gt;")
    assert (used, changed, page.count()) == ("List<int>", True, 1)
    assert docs.search_repaired(d, "no&amp;thing")[1:] == ("no&amp;thing", False)


def test_api_tree(spark, tmp_path):
    (tmp_path / "Lib").mkdir()
    (tmp_path / "Lib/Box`1.xml").write_text(TYPE)
    (tmp_path / "Lib/bad.xml").write_text("<Type>")
    (tmp_path / "Lib/other.xml").write_text("<Overview/>")
    (tmp_path / "ns-Lib.xml").write_text('<Namespace Name="Lib"><Docs><summary>A library.</summary></Docs></Namespace>')
    t = api_xml.scan(spark, str(tmp_path))
    assert [tuple(r) for r in t["types"].collect()] == [("T:Lib.Box`1", "Lib", "Box`1", "Lib.Box<T>", "Lib.Box`1")]
    m = t["members"].collect()
    assert len(m) == 1 and m[0].signature == "public string Get(int index)" and m[0].parameters[0].description == "Where index points."
    prose = {(r.symbol, r.element): r.text for r in t["prose"].collect()}
    assert prose[("Lib.Box<T>", "summary")] == "Holds a System.String or null, & more." and ("Lib.Box<T>", "remarks") not in prose and prose[("Lib", "summary")] == "A library."
    assert ("Lib.Box<T>.Get", "exception") in prose and ("Lib.Box<T>.Get", "param:index") in prose
    assert sorted(r.kind for r in t["uses"].collect()) == ["attribute", "base", "constraint", "interface", "parameter", "return", "return"]
    assert prose[("Lib.Box<T>.Silent", "summary")] == "Said all the same."  # no signature, so no member, but prose and uses
    assert sorted(r.path.rsplit("/", 1)[-1] for r in t["skipped"].collect()) in (["Box`1.xml", "bad.xml"], ["Box%601.xml", "bad.xml"]) and api_xml.checked(t)["types"].count() == 1
    staged = api_xml.scan(spark, str(tmp_path), str(tmp_path / "staged"))
    assert all(staged[k].count() == t[k].count() for k in t)
    with pytest.raises(Exception, match="repeated id"):
        api_xml.check_unique(t["types"].unionByName(t["types"])).collect()


def test_compiler_docs():
    good = b'<doc><members><member name="M:A.B(System.Int32)"><summary>  S <c>x</c> </summary><param name="p">P</param><exception cref="T:E">X</exception></member></members></doc>'
    d = api_xml.compiler_docs(good)["M:A.B(System.Int32)"]
    assert d["summary"] == "S x" and d["parameters"] == [{"name": "p", "text": "P"}] and d["exceptions"][0]["name"] == "T:E"
    for bad in (b"<!DOCTYPE doc><doc/>", b"<doc/>", b"<x>", good.replace(b"<param", b'<param name="p">Q</param><param'), good.replace(b"</members>", b'<member name="M:A.B(System.Int32)"/></members>')):
        with pytest.raises(QueryError):
            api_xml.compiler_docs(bad)


def archive(*names, size=10):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for n in names:
            z.writestr(n, b"x" * size)
    return f.getvalue()


def test_archives():
    data = archive("lib/net8.0/Lib.dll", "LIB/net8.0/lib.xml", "lib/net9.0/Lib.dll", "readme.txt")
    assert {k: sorted(v) for k, v in packages.read_archive(data, "Lib").items()} == {"net8.0": ["dll", "xml"], "net9.0": ["dll"]}
    many = archive(*[f"f{i}" for i in range(1025)])
    for bad in (archive("../x"), archive("/x"), archive("a:b"), archive("lib/con/Lib.dll"), archive("A", "a"), archive("x."), many, b"no archive", archive("x", size=(32 << 20) + 1)):
        with pytest.raises(QueryError):
            packages.read_archive(bad, "Lib")
    import base64
    import hashlib

    packages.verify_sha512(data, base64.b64encode(hashlib.sha512(data).digest()).decode())
    with pytest.raises(QueryError):
        packages.verify_sha512(data, "x")


@pytest.mark.parametrize("value, ok", [("1.0", True), ("1.2.3-beta.1+x", True), ("1", False), ("1.2.3.4.5", False), ("1.0-", False), ("1.0+a+b", False), ("1.x", False)])
def test_versions(value, ok):
    assert packages.valid_version(value) is ok


def doc(**kw):
    return {"Summary": None, "Parameters": [], "TypeParameters": [], "Returns": None, "Value": None, "Remarks": None, "Exceptions": []} | kw


def test_corpus_round_trip(spark, tmp_path):
    use = {"Name": "p", "TypeExpression": "string", "TypeNames": ["System.String"]}
    member = {"EcmaId": "M:Lib.A.Run(System.String)", "Name": "Run", "Kind": "Method", "Signature": "void Run(string p)", "Parameters": [use], "ReturnType": None, "Constraints": [], "Attributes": [], "Documentation": doc(Parameters=[{"Name": "p", "Text": "The p."}])}
    a = {"EcmaId": "T:Lib.A", "Name": "A", "FullName": "Lib.A", "BaseType": {"Name": None, "TypeExpression": "object", "TypeNames": ["System.Object"]}, "Interfaces": [], "Constraints": [], "Attributes": [{"Application": "[X]", "AttributeType": "XAttribute", "ArgumentTypeNames": []}], "Documentation": doc(Summary="An A."), "Members": [member]}
    b = a | {"EcmaId": "T:Lib.B", "Name": "B", "FullName": "Lib.B", "Members": []}
    for n, types in enumerate(([a, b], [b, a])):
        packages.write_corpus(str(tmp_path / f"{n}.json"), "Lib", "1.0.0", "h", "net8.0", {"Types": types, "Skipped": [{"Kind": "Method", "DeclaringType": "C", "Name": None, "Reason": "r"}]})
    assert (tmp_path / "0.json").read_bytes() == (tmp_path / "1.json").read_bytes()
    t = packages.corpus_tables(packages.read_corpora(spark, str(tmp_path / "0.json")))
    assert t["types"].count() == 2 and t["skipped"].count() == 1
    m = t["members"].first()
    assert (m.name, m.parameters[0].description, m.type_id) == ("Run", "The p.", "T:Lib.A")
    assert sorted((r.kind, r.type_names[0]) for r in t["uses"].filter("owner = 'Lib.A'").collect()) == [("attribute", "XAttribute"), ("base", "System.Object"), ("parameter", "System.String")]
    assert sorted((r.symbol, r.element, r.text) for r in t["prose"].collect()) == [("Lib.A", "summary", "An A."), ("Lib.A.Run", "param:p", "The p."), ("Lib.B", "summary", "An A.")]
    stored = json.loads((tmp_path / "0.json").read_text())
    (tmp_path / "old.json").write_text(json.dumps(stored | {"SchemaVersion": 2}))
    with pytest.raises(Exception, match="source_invalid"):
        packages.read_corpora(spark, str(tmp_path / "old.json")).collect()


def stored_corpus(**change):
    member = {"EcmaId": "M:Lib.A.Run", "Name": "Run", "Kind": "Method", "Signature": "void Run()", "Parameters": [], "ReturnType": None, "Constraints": [], "Attributes": [], "Documentation": doc()}
    one = {"EcmaId": "T:Lib.A", "Name": "A", "FullName": "Lib.A", "BaseType": None, "Interfaces": [], "Constraints": [], "Attributes": [], "Documentation": doc(), "Members": [member]}
    corpus = {"SchemaVersion": 3, "Types": [one | {k: v for k, v in change.items() if k in one}], "Skipped": change.get("Skipped", [])}
    corpus["Types"][0]["Members"] = [member | change.get("member", {})] + change.get("more", [])
    return {"SchemaVersion": 3, "PackageId": "Lib", "Version": "1.0", "Sha512": "h", "Framework": "net8.0", "Corpus": corpus | change.get("corpus", {})}


@pytest.mark.parametrize("change", [
    {"EcmaId": "Lib.A"}, {"Name": " A"}, {"FullName": ""}, {"Interfaces": None}, {"member": {"EcmaId": "M:Lib.B.Run"}}, {"member": {"Signature": None}}, {"Documentation": None}, {"corpus": {"Types": None}},
    {"member": {"Parameters": [{"Name": None, "TypeExpression": "int", "TypeNames": []}]}}, {"Interfaces": [{"Name": None, "TypeExpression": x, "TypeNames": []} for x in "ba"]},
    {"BaseType": {"Name": None, "TypeExpression": "x", "TypeNames": ["B", "A"]}}, {"BaseType": {"Name": None, "TypeExpression": "x", "TypeNames": ["A", "A"]}}, {"Attributes": [{"Application": "[X]", "AttributeType": "not a name", "ArgumentTypeNames": []}]},
    {"Documentation": doc(Parameters=[{"Name": "p", "Text": "a"}, {"Name": "p", "Text": "b"}])}, {"Documentation": doc(Exceptions=[{"Name": "no id", "Text": "a"}])}, {"Documentation": doc(Summary="x" * 1_048_577)},
    {"Skipped": [{"Kind": "Type", "DeclaringType": "", "Name": None, "Reason": "r"}]}, {"more": [{"EcmaId": "M:Lib.A.Aim", "Name": "Aim", "Kind": "Method", "Signature": "s", "Parameters": [], "ReturnType": None, "Constraints": [], "Attributes": [], "Documentation": doc()}]},
])
def test_corpora_against_the_rules(change):
    corpus_rules.check(stored_corpus())
    with pytest.raises(QueryError) as e:
        corpus_rules.check(stored_corpus(**change))
    assert e.value.code == "source_invalid"


def test_corpora_are_bounded_before_they_are_built():
    whole = json.dumps(stored_corpus()).encode()
    assert corpus_rules.load(whole)["Framework"] == "net8.0"
    for bad in (whole[:-1], whole.replace(b'"Lib"', b'"\\ud800"'), b"[" * 40 + b"]" * 40, b'{"a":"' + b"x" * 1_048_577 + b'"}', whole.replace(b'"Version"', b'"PackageId"'), b" " * (16 << 20) + whole, b"\xff"):
        with pytest.raises(QueryError):
            corpus_rules.load(bad)


def test_nested_types_take_the_namespace_around_them(spark, tmp_path):
    made = [("T:Lib.Out`1", "Out<T>", "Lib.Out<T>"), ("T:Lib.Out`1.In", "In", "Lib.Out<T>.In"), ("T:Lib.Out`1.In.Deep`2", "Deep<K, V>", "Lib.Out<T>.In.Deep<K, V>"), ("T:Bare", "Bare", "Bare"), ("T:Lib.Sub.Other", "Other", "Lib.Sub.Other")]
    empty = {"BaseType": None, "Interfaces": [], "Constraints": [], "Attributes": [], "Documentation": doc(), "Members": []}
    packages.write_corpus(str(tmp_path / "c.json"), "Lib", "1.0", "h", "net8.0", {"Types": [empty | {"EcmaId": i, "Name": n, "FullName": f} for i, n, f in made], "Skipped": []})
    t = packages.corpus_tables(packages.read_corpora(spark, str(tmp_path / "c.json")))["types"]
    assert {r.declaration_id: (r.namespace, r.type_name) for r in t.collect()} == {"T:Lib.Out`1": ("Lib", "Out`1"), "T:Lib.Out`1.In": ("Lib", "Out`1.In"), "T:Lib.Out`1.In.Deep`2": ("Lib", "Out`1.In.Deep`2"), "T:Bare": ("", "Bare"), "T:Lib.Sub.Other": ("Lib.Sub", "Other")}
    c = service.Composition([service.Backend("nuget", "s", "r", {"types": t}, ("Lib",), "net8.0", ("net8.0",))], "net8.0", "net8.0", ("net8.0",))
    named = lambda symbol: sorted(r.declaration_id for r in service.resolve(c, symbol).filter("member is null").collect())
    assert all(named(s) == ["T:Lib.Out`1"] for s in ("Out", "Out<T>", "Out`1", "Lib.Out", "Lib.Out<T>", "Lib.Out`1"))
    assert all(named(s) == ["T:Lib.Out`1.In.Deep`2"] for s in ("Deep", "Deep<K, V>", "Deep`2", "Lib.Out.In.Deep", "Lib.Out`1.In.Deep`2")) and named("Lib.Deep") == []


def test_cohorts():
    text = json.dumps({"tool-9.0": {"A": {"Version": "1.0.0"}}, "tool-10.1": {"A": {"Version": "2.0.0"}, "B": {"Version": "2.0.0"}}, "x": {}})
    assert packages.cohort_version(text, "tool-", ["A", "B"]) == "2.0.0"
    for bad, names in ((json.dumps({}), ["A"]), (text, ["A", "C"]), (json.dumps({"tool-1.0": {}, "tool-01.0": {}}), ["A"])):
        with pytest.raises(QueryError):
            packages.cohort_version(bad, "tool-", names)


SOURCE = {"repository": "o/r", "url": "https://x.example/r", "pin": "a" * 40, "head": "main", "sparse": ["docs"], "purpose": "tests", "markdown": True}


def test_catalog():
    c = catalog.read_catalog(json.dumps({"$comment": ["x"], "schemaVersion": 1, "sources": {"s": SOURCE}}))
    assert c["s"].markdown and c["s"].sparse == ["docs"]
    for change in ({"pin": "z" * 40}, {"sparse": []}, {"sparse": ["../x"]}, {"sparse": ["/x"]}, {"head": "-x"}, {"purpose": " "}, {"apiPackages": [{"packageId": "..", "feed": "https://f", "defaultFramework": "n"}]}):
        with pytest.raises(ValueError):
            catalog.read_catalog(json.dumps({"schemaVersion": 1, "sources": {"s": SOURCE | change}}))
    for bad in ({"schemaVersion": 2, "sources": {"s": SOURCE}}, {"schemaVersion": 1, "sources": {}}, {"schemaVersion": 1, "sources": {"a/b": SOURCE}}):
        with pytest.raises(ValueError):
            catalog.read_catalog(json.dumps(bad))


def test_sync_and_snapshots(spark, tmp_path):
    c = catalog.read_catalog(json.dumps({"schemaVersion": 1, "sources": {"s": SOURCE}}))
    cache = str(tmp_path)
    with pytest.raises(QueryError) as e:
        catalog.snapshot(spark, c, cache, "s")
    assert e.value.code == "source_not_synced" and not catalog.list_sources(spark, c, cache).first().synced
    steps = []
    catalog.sync_source(spark, c, cache, "s", lambda s: {"docs": spark.createDataFrame([("r", "old")], "repo string, text string")}, progress=lambda i, n, what: steps.append(i))
    _, tables = catalog.snapshot(spark, c, cache, "s")
    assert steps == [1, 2, 3, 4, 5] and tables["docs"].first().text == "old" and catalog.list_sources(spark, c, cache).first().commit == "a" * 40

    def fails(s):
        raise RuntimeError("no")

    with pytest.raises(QueryError) as e:
        catalog.sync_source(spark, c, cache, "s", fails)
    assert e.value.code == "sync_failed" and catalog.snapshot(spark, c, cache, "s")[1]["docs"].first().text == "old"
    _, held = catalog.snapshot(spark, c, cache, "s")
    new = lambda s: {"docs": spark.createDataFrame([("r", "new")], "repo string, text string")}
    state = catalog.sync_source(spark, c, cache, "s", new, ref="head")
    assert state["ref"] == "main" and catalog.snapshot(spark, c, cache, "s")[1]["docs"].first().text == "new"
    assert held["docs"].first().text == "old"  # a reader's generation stays for a while
    catalog.sync_source(spark, c, cache, "s", new, ref="head", grace=0)
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("gen-")]) == 1
    for name, ref, code in (("x", None, "unknown_source"), ("s", "v1", "invalid_ref")):
        with pytest.raises(QueryError) as e:
            catalog.sync_source(spark, c, cache, name, fails, ref)
        assert e.value.code == code
    moved = catalog.read_catalog(json.dumps({"schemaVersion": 1, "sources": {"s": SOURCE | {"sparse": ["other"]}}}))
    assert not catalog.list_sources(spark, moved, cache).first().synced
    for v in (tmp_path / "s/versions").glob("*.json"):
        v.write_text("{")
    assert catalog.read_state(spark, cache, "s") is None
    assert catalog.revision_key("git", repo="o/r", fetched_at="t") == catalog.revision_key("git", repo="o/r", fetched_at="u")
    assert catalog.combined_note("A.", None, " ", "B.") == "A. B." and catalog.combined_note(None) is None


def test_an_unfinished_generation_is_taken_up(spark, tmp_path):
    c, cache = catalog.read_catalog(json.dumps({"schemaVersion": 1, "sources": {"s": SOURCE}})), str(tmp_path)
    made = lambda text: spark.createDataFrame([("r", text)], "repo string, text string")

    def broken(s):
        return {"a": made("first"), "b": made("x").selectExpr("raise_error('disk full') AS repo")}

    with pytest.raises(QueryError):
        catalog.sync_source(spark, c, cache, "s", broken)
    state = catalog.sync_source(spark, c, cache, "s", lambda s: {"a": made("not written again"), "b": made("second")})
    _, tables = catalog.snapshot(spark, c, cache, "s")
    assert tables["a"].first().text == "first" and tables["b"].first().text == "second" and len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("gen-")]) == 1
    again = catalog.sync_source(spark, c, cache, "s", lambda s: {"a": made("anew"), "b": made("second")})
    assert again["generation"] != state["generation"] and catalog.snapshot(spark, c, cache, "s")[1]["a"].first().text == "anew"


XML_DOCS = b'<doc><members><member name="T:Lib.A"><summary>An A.</summary></member><member name="M:Lib.A.Run(System.String)"><param name="p">The p.</param></member></members></doc>'


def a_corpus(dll):
    """What a reader of assemblies would give for any bytes."""
    use = {"Name": "p", "TypeExpression": "string", "TypeNames": ["System.String"]}
    member = {"EcmaId": "M:Lib.A.Run(System.String)", "Name": "Run", "Kind": "Method", "Signature": "void Run(string p)", "Parameters": [use], "ReturnType": None, "Constraints": [], "Attributes": []}
    one = {"EcmaId": "T:Lib.A", "Name": "A", "FullName": "Lib.A", "BaseType": None, "Interfaces": [], "Constraints": [], "Attributes": [], "Members": [member]}
    return {"Types": [one], "Skipped": [{"Kind": "Method", "DeclaringType": "Lib.A", "Name": "Gone", "Reason": "The method 'Gone' is strange"}]}


def test_packages_are_built_published_and_asked(spark, tmp_path):
    import base64
    import hashlib

    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for framework in ("net8.0", "net9.0"):
            z.writestr(f"lib/{framework}/Lib.dll", b"MZ")
            z.writestr(f"lib/{framework}/Lib.xml", XML_DOCS)
    content = f.getvalue()
    package = {"packageId": "Lib", "assemblyName": "Lib", "version": "1.0.0", "sha512": base64.b64encode(hashlib.sha512(content).digest()).decode(), "feed": "https://feed.example", "defaultFramework": "net8.0"}
    xml = tmp_path / "tree"
    (xml / "Lib").mkdir(parents=True)
    (xml / "Lib/Box`1.xml").write_text(TYPE)
    source = SOURCE | {"markdown": False, "apiPackages": [package]}
    c, cache, steps = catalog.read_catalog(json.dumps({"schemaVersion": 1, "sources": {"app": source}})), str(tmp_path / "cache"), []
    tree = lambda s: api_xml.checked(api_xml.scan(spark, str(xml)))
    sync = lambda **kw: catalog.sync_source(spark, c, cache, "app", tree, **({"fetch": lambda d: content, "read_metadata": a_corpus} | kw))
    for kw in ({"fetch": lambda d: content + b"x"}, {"read_metadata": lambda dll: a_corpus(dll) | {"Types": [{"EcmaId": "bad", "FullName": "x", "Members": []}]}}):
        with pytest.raises(QueryError):
            sync(**kw)
    assert not catalog.list_sources(spark, c, cache).first().synced
    sync(progress=lambda i, n, what: steps.append((i, n)))
    assert steps == [(i, 8) for i in range(1, 9)]
    row = catalog.list_sources(spark, c, cache).first()
    assert row.synced and row.next_action is None and row.supplements[0].available_frameworks == ["net8.0", "net9.0"]
    behind = catalog.read_catalog(json.dumps({"schemaVersion": 1, "sources": {"app": source | {"apiPackages": [package | {"version": "1.0.1"}]}}}))
    row = catalog.list_sources(spark, behind, cache).first()
    assert not row.synced and not row.supplements[0].synced and row.next_action == "sync_source('app')"

    b = service.snapshot_backends(spark, c, cache)
    found = service.lookup_api(b, "Lib.A.Run", framework="NET9.0")
    assert found["outcome"] == "found" and found["effective_framework"] == "net9.0" and found["types"][0]["members"][0]["parameters"] == [{"name": "p", "description": "The p."}]
    assert found["skipped_declarations"] == {"declarations": 1, "reasons": [{"reason": "The method '<>' is strange", "count": 1}], "reasons_are_partial": False}
    assert service.lookup_api(b, "Lib.A.Walk")["outcome"] == "member_not_found" and service.lookup_api(b, "Lib.No.Walk") | {"outcome": None} == service.lookup_api(b, "Lib.No.Walk") | {"outcome": None}
    short = service.lookup_api(b, "A")
    assert short["types"][0]["detail"] == "signatures" and short["types"][0]["members"][0]["parameters"] is None and '"nextPageToken"' not in service.to_json(short)
    assert [h["symbol"] for h in service.search_api_text(b, "an a.")["hits"]] == ["Lib.A"]
    refs = service.find_api_references(b, "System.String")
    assert refs["totals"]["parameter"] == 1 and refs["totals"]["return"] == 2 and refs["note"] is None
    assert service.search_api(b, "Lib.A.Nothing")["note"].endswith("search_api('Nothing').") and service.search_api(b, "nothing")["note"] is None
    for kw, code in (({"framework": "net1"}, "framework_not_available"), ({"source": "x"}, "invalid_request"), ({"limit": 0}, "invalid_request"), ({"token": "x"}, "invalid_cursor")):
        with pytest.raises(QueryError) as e:
            service.lookup_api(b, "A", **kw)
        assert e.value.code == code
    with pytest.raises(QueryError) as e:
        service.snapshot_backends(spark, behind, cache)
    assert e.value.code == "source_not_synced"


def test_pages_of_a_look_up_make_up_the_whole(spark, small):
    from quarry.plans import bindings

    b = bindings.backends(spark, small)
    whole = service.lookup_api(b, "Supplier7", limit=100)
    parts, token = [], None
    while True:
        page = service.lookup_api(b, "Supplier7", limit=7, token=token)
        parts += [(t["full_name"], m["signature"]) for t in page["types"] for m in t["members"]]
        if (token := page["next_page_token"]) is None:
            break
    assert parts[:100] == [(t["full_name"], m["signature"]) for t in whole["types"] for m in t["members"]] and len(parts) > 7
    with pytest.raises(QueryError):
        service.lookup_api(b, "Supplier7", limit=7, token=cursor_beyond(service, b))


def cursor_beyond(service, b):
    from quarry.operators import cursor

    c = service.compose(b)
    return cursor.encode("lookup", cursor.scope("Supplier7", None, c.framework), 10_000, c.revisions)


def test_a_type_without_members_takes_a_place(spark):
    t = spark.createDataFrame([("T:N.A", "N", "A", "N.A", "N.A")], "declaration_id string, namespace string, type_name string, full_name string, search_name string")
    m = spark.createDataFrame([], "type_id string, declaration_id string, name string, signature string, ord int, summary string")
    found = service.lookup_api([service.Backend("git", "s", "r", {"types": t, "members": m})], "A")
    assert found["outcome"] == "found" and found["types"] == [{"full_name": "N.A", "revision": "r", "detail": "signatures", "members": []}] and found["resolved_types"] == ["N.A"]


def test_packages_must_agree_on_frameworks(spark):
    t = spark.range(0)
    b = lambda name, *f: service.Backend("nuget", "s", name, {"types": t}, (name,), f[0], f)
    with pytest.raises(QueryError) as e:
        service.compose([b("A", "net8.0"), b("B", "net9.0")])
    assert e.value.code == "source_invalid"
    assert [x.revision for x in service.compose([b("B", "net8.0"), b("A", "net8.0"), service.Backend("git", "z", "g", {}), service.Backend("git", "a", "h", {})]).backends] == ["h", "g", "A", "B"]
    with pytest.raises(QueryError):
        service.compose([service.Backend("git", "z", "g", {})], framework="net8.0")


def test_packages_are_matched_by_canonical_names(spark):
    from quarry.plans import api

    rows = [("nuget", 1, "M:A.B", "A.B", "parameter", "p", "string?", "A", ["System.String"]), ("nuget", 1, "M:A.C", "A.C", "return", None, "System.String", "A", ["Other.String"]), ("git", 0, "M:A.D", "A.D", "return", None, "System.String", "A", None), ("nuget", 1, "M:A.E", "A.E", "return", None, "string", "A", ["System.String"])]
    uses = spark.createDataFrame(rows, "origin string, priority int, declaration_id string, symbol string, kind string, parameter_name string, type_expression string, owner string, type_names array<string>")
    got = {r.declaration_id: r.is_exact for r in api.find_references(uses, "System.String").collect()}
    assert got == {"M:A.B": False, "M:A.D": True, "M:A.E": True}
    assert api.reference_totals(api.find_references(uses, "System.String")).first().n_return == 2
    with pytest.raises(QueryError):
        api.filter_references(uses, "verb")


def test_attributes_are_found_by_the_type_they_mean(spark):
    from quarry.plans import api

    said = ["[Ns.Foo(1)]", "[return: Ns.FooAttribute]", "[Ns.Bar]", "[Ns.Baz(typeof(Ns.Foo))]", "Ns.Foo"]
    rows = [("git", 0, f"M:A.{i}", f"A.{i}", "attribute", None, a, "A") for i, a in enumerate(said)] + [("git", 0, "M:A.9", "A.9", "return", None, "Ns.Foo", "A")]
    uses = spark.createDataFrame(rows, "origin string, priority int, declaration_id string, symbol string, kind string, parameter_name string, type_expression string, owner string")
    types = spark.createDataFrame([("Ns.FooAttribute",), ("Ns.Foo",), ("Ns.Bar",), ("Ns.FooAttribute",)], "full_name string")
    find = lambda symbol, types=types: {r.declaration_id[-1]: r.is_exact for r in api.find_references(uses, symbol, types).collect()}
    assert find("Ns.FooAttribute") == find("Ns.FooAttribute", None) == {"0": True, "1": True, "4": True}
    assert find("Ns.Foo") == {"3": False, "9": True}
    assert find("Ns.Bar") == find("Ns.Bar", None) == {"2": True} and find("Ns.BarAttribute") == {}
    assert api.reference_totals(api.find_references(uses, "Ns.FooAttribute", types)).first().n_attribute == 3


def test_a_search_of_all_sources(spark, tmp_path):
    for name, content in {"a.md": "# A\nsome text here\n## B\nmore text", "f.yml": FAQ, "bad.yaml": "### YamlMime:FAQ\ntitle: x"}.items():
        (tmp_path / name).write_text(content)
    c, cache = catalog.read_catalog(json.dumps({"schemaVersion": 1, "sources": {"s": SOURCE, "t": SOURCE, "api": SOURCE | {"markdown": False}}})), str(tmp_path / "cache")
    for name in "st":
        with pytest.raises(QueryError):
            docs.snapshot_documents(spark, c, cache)
        catalog.sync_source(spark, c, cache, name, lambda s, name=name: {"docs": documents.scan(spark, str(tmp_path), name)})
    found, revisions = docs.snapshot_documents(spark, c, cache)
    first = docs.search_docs(found, "text", limit=3, revisions=revisions)
    assert [(h["repo"], h["path"], h["line_no"], h["section_path"]) for h in first["hits"]] == [("s", "a.md", 2, "A"), ("t", "a.md", 2, "A"), ("s", "a.md", 4, "A > B")] and first["is_partial"]
    assert len(first["skipped_documents"]) == 2 and first["note"] == "2 documents could not be read."
    rest = docs.search_docs(found, "text", limit=3, token=first["next_page_token"], revisions=revisions)
    assert [(h["repo"], h["line_no"], h["position"]) for h in rest["hits"]] == [("t", 4, 4)] and rest["next_page_token"] is None
    one, of_one = docs.snapshot_documents(spark, c, cache, "t")
    assert {h["repo"] for h in docs.search_docs(one, "Why so", revisions=of_one)["hits"]} == {"t"}
    assert docs.search_docs(one, "s&#111;me text")["note"].startswith("The query was read as 'some text'.")
    for f in (lambda: docs.snapshot_documents(spark, c, cache, "api"), lambda: docs.search_docs(one, " "), lambda: docs.search_docs(one, "x", limit=0), lambda: docs.search_docs(one, "text", token=first["next_page_token"], revisions=of_one)):
        with pytest.raises(QueryError):
            f()


def test_checkouts(tmp_path):
    from quarry.sources import git

    origin, place = tmp_path / "origin", tmp_path / "here"
    origin.mkdir()
    made = lambda *a: git.run(str(origin), "-c", "user.name=a", "-c", "user.email=a@b.c", *a, seconds=60)
    made("init", "--quiet", "-b", "trunk")
    made("config", "uploadpack.allowAnySHA1InWant", "true")
    made("config", "uploadpack.allowFilter", "true")
    for n in (1, 2):
        for p in ("docs/a.md", "src/b.cs", "README.md"):
            (origin / p).parent.mkdir(exist_ok=True)
            (origin / p).write_text(f"version {n}")
        made("add", "-A")
        made("commit", "--quiet", "-m", f"Version {n}")
    url = f"file://{origin}"
    old = made("rev-parse", "HEAD~1")
    assert git.checkout(url, str(place), ["docs"], commit=old) == old
    assert sorted(str(p.relative_to(place)) for p in place.rglob("*.*") if ".git" not in p.parts) == ["docs/a.md"] and (place / "docs/a.md").read_text() == "version 1"
    tip = git.checkout(url, str(place), ["docs", "README.md"], head="trunk")
    assert tip == made("rev-parse", "HEAD") and (place / "README.md").read_text() == "version 2" and not (place / "src").exists()
    (place / "docs/a.md").write_text("changed")
    with pytest.raises(QueryError, match="changed"):
        git.validate(str(place), url, tip)
    for f in (lambda: git.checkout("file:///elsewhere", str(place), ["docs"], head="trunk"), lambda: git.checkout(url, str(place), ["docs"], head="--upload-pack=x"), lambda: git.checkout(url, str(place), ["docs"]), lambda: git.checkout(url, str(place), ["docs"], head="none")):
        with pytest.raises(QueryError):
            f()
    with pytest.raises(QueryError) as e:
        git.run(str(place), "-c", "alias.wait=!sleep 5", "wait", seconds=1)
    assert e.value.code == "git_timeout"


def test_feeds():
    import base64
    import hashlib

    from quarry.sources import feed

    digest = base64.b64encode(hashlib.sha512(b"archive").digest()).decode()
    package = {"packageId": "Lib.A", "version": "1.0.0-B+c", "sha512": digest, "feed": "https://feed/index.json"}
    index = lambda *bases: (200, {}, json.dumps({"resources": [{"@id": b, "@type": "PackageBaseAddress/3.0.0"} for b in bases] + [{"@id": "x", "@type": "Search"}]}).encode())
    at = "https://files/flat/lib.a/1.0.0-b/lib.a.1.0.0-b.nupkg"
    pages = {"https://feed/index.json": index("https://files/flat/"), at: (302, {"location": "/moved"}, b""), "https://files/moved": (200, {}, b"archive")}
    ask = lambda **change: feed.fetch(package, lambda url, most: ({**pages, **{k.replace("INDEX", "https://feed/index.json").replace("AT", at): v for k, v in change.items()}}).get(url, (404, {}, b"")))
    assert ask() == b"archive"
    for change in (
        {"INDEX": index()}, {"INDEX": index("https://a", "https://b")}, {"INDEX": index("http://files/flat")}, {"INDEX": (200, {}, b"[]")}, {"AT": (404, {}, b"")}, {"AT": (200, {}, b"other")}, {"AT": (302, {"location": "http://files/moved"}, b"")},
        {"AT": (302, {"location": at}, b"")}, {"AT": (200, {"content-length": str(1 << 30)}, b"archive")}, {"INDEX": (200, {}, b" " * ((1 << 20) + 1))},
    ):
        with pytest.raises(QueryError):
            ask(**change)
