import random

import pytest
from pyspark.sql import functions as F

from quarry.errors import QueryError
from quarry.functions import declaration_ids as ids
from quarry.functions import matching, ranking, text
from quarry.operators import cursor, paging
from quarry.operators.outline import section_paths
from quarry.sources import markdown


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("before, after", [
    ("a\r\nb\rc\fd\u0085e\u2028f\u2029g\nh", "a\nb\nc\nd\ne\nf\ng\nh"), ("v\x0bt", "v\x0bt"), ("\r\r\n\n", "\n\n\n"),
])
def test_line_breaks(spark, before, after):
    assert one(spark, text.normalise_line_breaks(F.col("t")), t=before) == after


@pytest.mark.parametrize("before, after", [
    ("see <xref:System.Box`1?displayProperty=name> now", "see System.Box`1 now"), ("<xref:A.B*>", "A.B"), ("<xref:A%5B%5D>", "A[]"), ("<xref:M%23A+B>", "M#A+B"),
    ("  wrapped\n  line \n\n next ", "wrapped line\n\nnext"), ("To be added.", None), ("  ", None), ("x", "x"),
])
def test_prose(spark, before, after):
    assert one(spark, text.normalise_prose(F.col("t")), t=before) == after


@pytest.mark.parametrize("before, after", [("The 'a' of 'b' is", "The '<>' of '<>' is"), ("an 'open quote", "an '<"), ("none", "none")])
def test_quoted_names(spark, before, after):
    assert one(spark, text.collapse_quoted(F.col("t")), t=before) == after


@pytest.mark.parametrize("before, after", [("List&lt;int&gt;", "List<int>"), ("“x”", '"x"'), ("a\u00a0b", "a b"), ("it&#39;s", "it's"), ("plain", "plain")])
def test_input_repair(spark, before, after):
    assert text.repair_input(before) == (after, before != after)
    assert one(spark, text.repair_column(F.col("t")), t=before) == after


def test_budget(spark):
    for n, cut in ((300, False), (301, True)):
        kept, more = text.within_budget(F.col("t"))
        assert len(one(spark, kept, t="x" * n)) == 300 and one(spark, more, t="x" * n) is cut
    with pytest.raises(ValueError):
        text.within_budget(F.col("t"), 0)


@pytest.mark.parametrize("path, tier", [("proposals/x.md", 0), ("a/spec/x.md", 0), ("openspec/x.md", 2), ("proposal-a.md", 2), ("meetings/x.md", 3), ("docs/release-notes/docs/api/x.md", 3), ("Docs/Reference/x.md", 1), ("docs/wiki/x.md", 2)])
def test_document_tier(spark, path, tier):
    assert one(spark, ranking.document_tier(F.col("p")), p=path) == tier


@pytest.mark.parametrize("expression, hit", [("System.String", True), ("System.String[]", True), ("System.String&", True), ("IEnumerable<System.String>", True), ("System.StringComparer", False), ("My.System.String", False), ("System.String+Inner", False)])
def test_type_boundaries(spark, expression, hit):
    assert one(spark, matching.names_type(F.col("e"), "System.String"), e=expression) is hit


@pytest.mark.parametrize("pattern, want", [("System.Span`1", ("fullName", None)), ("span", ("type", None)), ("System", ("namespace", 0)), ("System.", None), ("Sys", None), ("Buffers", None)])
def test_name_match(spark, pattern, want):
    m = one(spark, matching.match_name(F.col("n"), F.col("t"), pattern), n="System", t="Span`1")
    assert (m and (m.matched_on, m.depth)) == want


def test_namespace_depth(spark):
    m = one(spark, matching.match_name(F.col("n"), F.col("t"), "system"), n="System.Buffers.Text", t="Parser")
    assert (m.matched_on, m.depth) == ("namespace", 2)


@pytest.mark.parametrize("application, name", [("[Ns.Foo(1)]", "Ns.Foo"), ("[return: Ns.FooAttribute]", "Ns.FooAttribute"), ("Ns.Foo", "Ns.Foo")])
def test_applied_attribute(spark, application, name):
    assert one(spark, matching.applied_name(F.col("a")), a=application) == name


@pytest.mark.parametrize("bad", [r"(\w+)\s+\1", "(?=x)", "["])
def test_patterns_that_would_backtrack_are_refused(bad):
    with pytest.raises(QueryError) as e:
        matching.line_matches(F.col("t"), bad)
    assert e.value.code == "invalid_regex"


@pytest.mark.parametrize("symbol", ["/etc", "a..b", "x[", "C:\\x", " "])
def test_symbols_that_are_paths(symbol):
    with pytest.raises(QueryError):
        matching.check_symbol(symbol)


TYPE = "T:Shop.Till`1"


class Maker:
    """Random ids that the grammar allows, and changes after which it doesn't."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def name(self):
        first, rest = "abYZ_éΩж", "abYZ_09éΩж\u0301\u203f"
        return self.rng.choice(first) + "".join(self.rng.choices(rest, k=self.rng.randint(0, 6)))

    def type_name(self):
        parts = [self.name() + (f"`{self.rng.randint(1, 40)}" if self.rng.random() < 0.2 else "") for _ in range(self.rng.randint(1, 4))]
        return ".".join(parts)

    def bounds(self):
        one = lambda: f"{self.rng.choice(['0', '7', '-12', '2147483647', '-2147483648'])}:{self.rng.choice(['', '1', '30'])}"
        return ",".join(one() for _ in range(self.rng.randint(1, 3)))

    def type(self, depth=3):
        kind = self.rng.random()
        if kind < 0.15:
            x = self.rng.choice("` ``".split()) + str(self.rng.randint(0, 12))
        elif kind < 0.2 and depth:
            x = f"=FUNC:{self.type(depth - 1)}({','.join(self.type(depth - 1) for _ in range(self.rng.randint(0, 3)))})"
        else:
            x = self.type_name()
            if depth and self.rng.random() < 0.3:
                x += "{" + ",".join(self.type(depth - 1) for _ in range(self.rng.randint(1, 3))) + "}"
        for _ in range(self.rng.choice([0, 0, 0, 1, 2])):
            x += self.rng.choice(["[]", "*", "@", "^", f"[{self.bounds()}]", f"|{self.type_name()}", f"!{self.type_name()}"])
        return x

    def parameters(self):
        return "(" + ",".join(self.type() for _ in range(self.rng.randint(1, 4))) + ")"

    def method(self):
        if self.rng.random() < 0.15:
            return f"{self.rng.choice(ids.CONVERSIONS)}({self.type()})~{self.type()}"
        head = self.rng.choice(["#ctor", "#cctor", self.name(), f"{self.name()}#{self.name()}", f"<{self.name()}>$"])
        return head + (f"``{self.rng.randint(1, 5)}" if self.rng.random() < 0.2 else "") + (self.parameters() if self.rng.random() < 0.7 else "")

    def broken(self):
        """A good method id with one fault."""
        head, good = self.name(), self.type(1)
        return self.rng.choice([
            f"{head}()", f"{head}({good},)", f"{head}(,{good})", f"{head}({good}", f"{head}{good})", f"{head} {good}", f"{head}({good} )", f"{head}\t", "", f"9{head}", f"{head}.{head}", f"{head}``", f"{head}``0", f"{head}``01({good})",
            f"{head}({good})~{good}", f"op_Explicit({good})~", f"op_Implicit~{good}", f"op_Implicit({good},{good})~{good}", f"{head}({{{good}}})", f"{head}({self.name()}{{{good})", f"{head}({self.name()}{{{good},}})", f"{head}({good}])",
            f"{head}({good}[)", f"{head}({self.name()}[:])", f"{head}({self.name()}[5])", f"{head}({self.name()}[01:])", f"{head}({self.name()}[-0:])", f"{head}({self.name()}[2:0])", f"{head}({self.name()}[9999999999:])", f"{head}({self.name()}[0:,])",
            f"{head}({self.name()}`x)", f"{head}(`)", f"{head}(=FUNC:{good})", f"{head}({good}|)", f"{head}({self.name()}..{self.name()})", f"{head}/{head}", f"{head}({good})({good})", f"{head}\u0000", f"#{head}#",
        ])


def test_made_ids_are_canonical_and_broken_ones_are_not():
    make = Maker(4)
    for _ in range(1500):
        good, bad = f"M:Shop.Till`1.{make.method()}", f"M:Shop.Till`1.{make.broken()}"
        assert ids.is_member_id(good, TYPE), good
        assert not ids.is_member_id(bad, TYPE), bad
        assert not ids.is_member_id(good, "T:Shop.Other") and not ids.is_member_id("T" + good[1:], TYPE) and not ids.is_member_id(good[2:], TYPE)


def test_fields_events_properties_and_names():
    make = Maker(5)
    for _ in range(300):
        n, t = make.name(), make.type_name()
        assert ids.is_identifier(n) and ids.is_type_name(t) and ids.is_type_id(f"T:{t}") and ids.is_type_id(f"T:{t}.{n}`2")
        assert ids.is_namespace_name(t) is ("`" not in t)
        for kind in "FEP":
            assert ids.is_member_id(f"{kind}:Shop.Till`1.{n}", TYPE) and not ids.is_member_id(f"{kind}:Shop.Till`1.{n}~{t}", TYPE)
            assert ids.is_member_id(f"{kind}:Shop.Till`1.{n}{make.parameters()}", TYPE) is (kind == "P")
        for fault in ("", ".", f"{n}.", f".{n}", f"{n}..{n}", f"{n} ", f"{n}-", f"7{n}", f"{n}`", f"{n}`0", f"{n}`03", f"{n}`5{n}", f"`1{n}", f"{n}`99999999999"):
            assert not ids.is_type_name(fault) and not ids.is_type_id("T:" + fault) and not ids.is_namespace_name(fault)


def test_limits_of_ids():
    nested = lambda n: f"M:Shop.Till`1.A({'L{' * n}X{'}' * n})"
    assert ids.is_member_id(nested(ids.MAX_DEPTH - 1), TYPE) and not ids.is_member_id(nested(ids.MAX_DEPTH + 1), TYPE)
    ranks = lambda n: f"M:Shop.Till`1.A(X[{','.join(['0:'] * n)}])"
    assert ids.is_member_id(ranks(ids.MAX_RANK), TYPE) and not ids.is_member_id(ranks(ids.MAX_RANK + 1), TYPE)
    assert not ids.is_type_name("<" * 80 + "a" + ">" * 80)


def test_conversions_prefer_the_named_result():
    plain, named = "M:Shop.Till`1.op_Implicit(A)", "M:Shop.Till`1.op_Implicit(A)~B"
    assert ids.choose_member_id([plain, named], TYPE) == named and ids.choose_member_id([plain, plain], TYPE) == plain
    with pytest.raises(QueryError):
        ids.choose_member_id(["M:Shop.Till`1.A", "M:Shop.Till`1.B"], TYPE)


def test_pages_equal_a_walk_line_by_line():
    rng = random.Random(2)
    for _ in range(400):
        lengths = [rng.randint(0, 12) for _ in range(rng.randint(1, 30))]
        n = len(lengths)
        cuts = sorted(rng.sample(range(1, n + 2), min(n + 1, 2 * rng.randint(0, 3)) // 2 * 2))
        blocks = list(zip(cuts[::2], cuts[1::2], strict=True))
        start = rng.randint(1, n)
        bound, budget = rng.randint(start + 1, n + 1), rng.randint(1, 60)
        end, spent = start, 0
        while end < bound and (end == start or spent + lengths[end - 1] + 1 <= budget):
            spent += lengths[end - 1] + 1
            end += 1
        while inside := [b for a, b in blocks if a < end < b <= bound]:
            end = inside[0]
        cost = paging.np.concatenate([[0], paging.np.cumsum([x + 1 for x in lengths])])
        assert paging.page_end(cost, blocks, start, bound, budget) == end, (lengths, blocks, start, bound, budget)


@pytest.mark.parametrize("name, stripped", [("Pair<A, B>", "Pair"), ("Out<T>.In<List<K>>", "Out.In"), ("Plain", "Plain"), ("A<B", "A")])
def test_type_arguments_are_stripped(spark, name, stripped):
    assert one(spark, text.strip_arguments(F.col("t")), t=name) == stripped


def test_small_text_forms(spark):
    assert one(spark, text.strip_all_arity(F.col("t")), t="Out`1.In`22") == "Out.In" and one(spark, text.strip_id_prefix(F.col("t")), t="T:A.B") == "A.B"
    assert text.longest_token("a longer word, longest") == "longest" and text.longest_token("same size") == "same" and text.longest_token("  ") == "  "
    assert text.decode_entities("&amp; &ampx &amp &nothing; &#x26;lt; &copy") == "& &ampx &amp &nothing; &lt; &copy"
    assert one(spark, text.repair_column(F.col("t")), t="&eacute;&#x41;&hellip;&nbsp;&lt;b&gt; & c") == "éA… <b> & c" and one(spark, text.repair_column(F.lit(None).cast("string"))) is None


def test_cursors():
    here = cursor.scope("q", None, 20)
    token = cursor.encode("lang-search", here, 40, ["r1"])
    assert cursor.decode(token, "lang-search", here, ["r1"]) == 40 and cursor.decode(None, "lang-search", here, []) == 0
    for args in ((token, "lookup", here, ["r1"]), (token, "lang-search", cursor.scope("other"), ["r1"]), (token, "lang-search", here, ["r2"]), ("!!", "lang-search", here, []), ("", "lang-search", here, [])):
        with pytest.raises(QueryError) as e:
            cursor.decode(*args)
        assert e.value.code == "invalid_cursor"


DOC = "# Top\n\n## A\ntext\n### B\nx\n\n## C\n```\n# decoy\n```\n## A\nend\n### B\n\nlast"


def test_outline(spark):
    d = markdown.structured(spark.createDataFrame([("r", "p.md", DOC)], "repo string, path string, text string"))
    got = [(r.section_path, r.start_line, r.end_line) for r in section_paths(markdown.heading_rows(d)).orderBy("start_line").collect()]
    assert got == [("Top", 1, 17), ("Top > A", 3, 8), ("Top > A > B", 5, 8), ("Top > C", 8, 12), ("Top > A (2)", 12, 17), ("Top > A > B (2)", 14, 17)]


@pytest.mark.parametrize("source, headings, blocks, body", [
    ("---\na: b\n---\n\n# T", [(1, "T", 5)], [("front_matter", 1, 4)], 4), ("---\n---\n# T", [(1, "T", 3)], [], 1), ("Title\n===\nSub\n---\n", [(1, "Title", 1), (2, "Sub", 3)], [], 1),
    ("> # In a quote\n- ## In an item", [(1, "In a quote", 1), (2, "In an item", 2)], [], 1), ("# `code` and *bold* [link](x) #", [(1, "code and bold link", 1)], [], 1),
    ("| a | b |\n|---|---|\n| 1 | 2 |\n\nx", [], [("table", 1, 4)], 1), ("~~~~\n```\n# no\n~~~~\nx", [], [("fence", 1, 5)], 1), ("```\nopen", [], [("fence", 1, 4)], 1), ("    # code\n#no", [], [], 1),
])
def test_scanner(source, headings, blocks, body):
    s = markdown.scan(source)
    assert [(h["level"], h["text"], h["start_line"]) for h in s["headings"]] == headings
    assert [(b["kind"], b["start_line"], b["end_line"]) for b in s["blocks"]] == blocks and s["body_start"] == body
