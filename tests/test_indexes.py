"""Indexes give supersets: every query has the same rows with them and without."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.plans import api, bindings, docs, service
from quarry.sources import catalog, inverted, skipping

WORDS = "alpha beta gamma Delta ÉCOLE école naïve naive of the 中文 字 x y".split()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("stored")
    rng = random.Random(3)
    rows = [(f"r{i % 3}", f"d/{i}.md", "\n".join(" ".join(rng.choices(WORDS, k=5)) for _ in range(4)) + (f"\nneedle{i % 7}.[x]" if i % 5 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame([*rows, ("r0", "d/none.md", None), ("r0", "d/empty.md", "")], "repo string, path string, text string")
    df.repartitionByRange(8, "path").write.parquet(f"{place}/docs")
    for name, text in (("raw", F.col("text")), ("low", F.lower("text"))):
        skipping.build(spark, f"{place}/docs", f"{place}/{name}", text)
    return skipping.Skipping(spark, f"{place}/docs", f"{place}/raw"), skipping.Skipping(spark, f"{place}/docs", f"{place}/low", folds=True)


@pytest.mark.parametrize("query", ["needle3", "needle", "ÉCOLE", "école", "中文 字", "x y", "no such words", ".[x]", "a", "alpha\nbeta", "e\ud800e"])
def test_a_search_finds_the_same_in_fewer_files(spark, stored, query):
    raw, low = stored
    whole = spark.read.parquet(raw.table)
    found = lambda df, c: sorted(r.path for r in df.filter(c).collect())
    if query.isprintable() or "\n" in query:
        assert found(raw.read([query]), F.col("text").contains(query)) == found(whole, F.col("text").contains(query))
        assert found(low.read([query]), F.lower("text").contains(query.lower())) == found(whole, F.lower("text").contains(query.lower()))
    assert raw.read([query]).schema == whole.schema


def test_files_are_left_out(spark, tmp_path):
    rows = [(f"file {i // 50} {'lorem' if i // 50 % 2 else 'ipsum'} number{i}",) for i in range(400)]
    spark.createDataFrame(rows, "text string").repartitionByRange(8, "text").write.parquet(f"{tmp_path}/t")
    skipping.build(spark, f"{tmp_path}/t", f"{tmp_path}/i", F.col("text"))
    s = skipping.Skipping(spark, f"{tmp_path}/t", f"{tmp_path}/i")
    names = [r[0] for r in spark.read.parquet(s.table).select("_metadata.file_name").distinct().collect()]
    holds = lambda x: {r.file for r in spark.read.parquet(s.table).select("text", F.col("_metadata.file_name").alias("file")).collect() if x in r.text}
    for q in ("number399", "lorem", "file 3"):
        assert holds(q) <= set(s.files([q])) and len(s.files([q])) < len(names)
    assert s.files(["zzz"]) == [] and s.read(["zzz"]).count() == 0 and s.files(["ab"]) is None and s.files(["lorem", "ipsum"]) == []
    plan = s.read(["number399"])._jdf.queryExecution().executedPlan().toString()
    assert "(1 paths)" in plan


def test_literals_that_a_pattern_requires():
    told = {"abc": ["abc"], "ab*c": ["a", "c"], "ab+c": ["ab", "c"], r"a\.b(cd)?e": ["a.b", "e"], "x[abc]yz": ["x", "yz"], "ab{2,3}c": ["a", "c"], "(?i)abc": [], "a|b": [], r"\p{L}abc": ["abc"], r"\pLabc": [], r"^needle\d+$": ["needle"],
            r"[^]x]q": ["q"], r"[\]]q": [], r"\x41b": [], "[[:alpha:]]q": [], "a?": [], ".*": [], r"\bfoo\b": ["foo"]}
    for pattern, literals in told.items():
        assert skipping.required_literals(pattern) == literals, pattern
    rng = random.Random(4)
    for _ in range(3000):  # whatever matches holds them
        pattern = "".join(rng.choices(["a", "b", "c", "a*", "b?", "c+", "[ab]", "(ab)", "(b)*", "(a(b)c)?", ".", r"\.", "a{2}", "b{0,1}", "^", "$", r"\d", r"\w"], k=rng.randrange(1, 7)))
        text = "".join(rng.choices("abc.1", k=8))
        if (m := re.search(pattern, text)) is not None:
            assert all(x in m[0] or x == "" for x in skipping.required_literals(pattern)), (pattern, text)


def test_pattern_search_reads_by_literals(spark, stored):
    raw, _ = stored
    whole = spark.read.parquet(raw.table).filter("text is not null")
    rows = lambda df: sorted((r.path, r.line_no) for r in docs.line_hits(df, r"needle[3-5]\.", regex=True).collect())
    chosen = skipping.literals_of(r"needle[3-5]\.", True)
    assert chosen == ["needle", "."] and rows(raw.read(chosen).filter("text is not null")) == rows(whole) != []


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    rng = random.Random(5)
    parts = ["Sys", "IO", "Net", "Text", "Ünit", "A", "AB"]
    rows = []
    for i in range(150):
        ns = ".".join(rng.choices(parts, k=rng.randrange(0, 4))) or None
        n = rng.choice(["File", "FileInfo", "Http`1", "Map`2", "Straße", "ab", "A.B"]) + rng.choice(["", str(i % 9)])
        full = f"{ns}.{n}" if ns else n
        rows.append((f"T:{i}", ns, n, full, full, n.replace("`1", "<T>")))
    df = spark.createDataFrame(rows, "declaration_id string, namespace string, type_name string, full_name string, search_name string, display_name string")
    return df, inverted.write_names(df, str(tmp_path_factory.mktemp("names") / "i"), 8)


@pytest.mark.parametrize("pattern", ["File", "file", "i", "IO", "sys.io", "IO.File", "net.text.http`1", "Ünit", "ünit.ab", "straße", "SSE", "info", "A.B", "a.b", "Map`2", "no.such", "http`", "b1"])
def test_name_search_from_the_index(names, pattern):
    df, index = names
    order = lambda found: sorted(tuple(r) for r in api.search_names(found, pattern).collect())
    assert order(inverted.types_for(index, pattern)) == order(df)


@pytest.mark.parametrize("symbol", ["File", "Http<T>3", "Http", "Http`1", "Sys.IO.File", "Map`2", "Map", "A.B", "AB", "Nothing", "Net.Map"])
@pytest.mark.parametrize("origin", ["git", "nuget"])
def test_look_up_from_the_index(names, symbol, origin):
    df, index = names
    rows = lambda found: sorted(r.declaration_id for r in found.withColumn("origin", F.lit(origin)).filter(service.selects_type(symbol)).collect())
    assert rows(inverted.types_spelled(index, [symbol])) == rows(df)


def test_references_from_the_index(spark, tmp_path):
    expressions = ["Ns.Foo", "Ns.Foo[]", "List<Ns.Foo>", "Ns.Foo.Inner", "XNs.Foo", "Ns.Foo`1", "[Ns.Foo(1)]", "[assembly: Ns.Foo]", "[Ns.FooAttribute]", "[Ns.Other(typeof(Ns.Foo))]", "Ns.FooAttribute", "string", "Ñs.Foo", "Ns.Foo+Bar", None]
    rows = []
    for i, e in enumerate(expressions * 4):
        kind = "attribute" if e and e[0] == "[" else "parameter"
        origin = "nuget" if i % 2 else "git"
        canonical = ["Ns.Foo", "System.String"] if i % 8 == 1 else ["Ns.FooAttribute"] if i % 8 == 3 else None
        rows.append((origin, int(i % 2), f"M:{i}", f"S{i}", kind, "p", e, "Own" if i % 7 else "Ns.Foo", canonical if origin == "nuget" else None, "Ns.FooAttribute" if kind == "attribute" and i % 8 == 5 else None))
    uses = spark.createDataFrame(rows, "origin string, priority int, declaration_id string, symbol string, kind string, parameter_name string, type_expression string, owner string, type_names array<string>, attribute_type string")
    types = spark.createDataFrame([("Ns.Foo", 0), ("Ns.FooAttribute", 0), ("Ns.Foo", 1)], "full_name string, priority int")
    index = inverted.write_uses(uses, f"{tmp_path}/u", 8)
    for symbol in ("Ns.Foo", "Ns.FooAttribute", "Ns.Foo`1", "System.String", "string", "Ñs.Foo", "Ns.Foo+Bar", "List<Ns.Foo>", "None"):
        rows = lambda df, symbol=symbol: sorted(map(str, api.find_references(df, symbol, types, by=("priority",), siblings=True).collect()))
        found = inverted.uses_of(index, symbol)
        assert rows(found if found is not None else uses) == rows(uses), symbol
    assert inverted.uses_of(index, "<>") is None and inverted.uses_of(index, "Ñs.Foo") is None
    plan = inverted.uses_of(index, "Ns.Foo")._jdf.queryExecution().executedPlan().toString()
    buckets = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert re.search(r"bucket#\d+ = \d", buckets)  # one bucket is listed


def test_composed_queries_are_the_same_without_indexes(spark, small):
    plain, indexed = service.compose(bindings.backends(spark, small)), service.compose(bindings.ingested(spark, small))
    rows = lambda df: sorted(map(str, df.select(*sorted(set(df.columns) - {"package_id", "backend"})).collect()))
    for pattern in ("Supplier", "er1", "corp.europe", "7`1", "Corp.ASIA.CHINA"):
        assert rows(service.search_page(plain, pattern, 50)) == rows(service.search_page(indexed, pattern, 50))
    for query in ("tion", "the ", "no such text"):
        assert rows(service.text_page(plain, query, 50)) == rows(service.text_page(indexed, query, 50))
    for symbol in ("System.ECONOMY", "System.ECONOMYAttribute", "System.Collections.Generic.IEnumerable"):
        assert rows(service.references_page(plain, symbol, limit=50)) == rows(service.references_page(indexed, symbol, limit=50))
        assert rows(service.reference_summary(plain, symbol)) == rows(service.reference_summary(indexed, symbol))
    for symbol in ("Supplier7", "Supplier7<T>", "Supplier7.Part4", "Nothing.Such"):
        assert rows(service.lookup_page(plain, symbol, 50)) == rows(service.lookup_page(indexed, symbol, 50))
        assert rows(service.lookup_outcome(plain, symbol)) == rows(service.lookup_outcome(indexed, symbol))


def test_empty_tables_have_indexes(spark, tmp_path):
    for name, ddl in (("types", "declaration_id string, namespace string, type_name string, full_name string"), ("uses", "kind string, type_expression string, owner string"), ("prose", "text string"), ("docs", "text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}")
        catalog.build_index(spark, f"{tmp_path}/{name}", f"{tmp_path}/i/{name}", name)
        index = catalog.open_index(spark, f"{tmp_path}/{name}", f"{tmp_path}/i/{name}", name)
        assert (index.rows(["rx"]) if name in ("types", "uses") else index.read(["abc"])).count() == 0


def test_answers_take_few_jobs(spark, small, monkeypatch):
    """The page, its totals, outcome and length come from one action; one more counts what packages left out, one looks for a sibling type, and each table with filters is asked which files to read."""
    from pyspark.sql.classic.dataframe import DataFrame

    b, ran = bindings.ingested(spark, small), []
    for name in ("collect", "count", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, _f=getattr(DataFrame, name), **k: ran.append(1) or _f(self, *a, **k))
    for ask, most in ((lambda: service.lookup_api(b, "Supplier7.Part4"), 2), (lambda: service.search_api(b, "Supplier"), 2), (lambda: service.search_api_text(b, "tion", source="app"), 2 + 3), (lambda: service.find_api_references(b, "System.ECONOMY"), 3)):
        ran.clear()
        ask()
        assert len(ran) <= most
