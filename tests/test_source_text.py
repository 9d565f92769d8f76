import random

import pytest
from pyspark.sql import functions as F

from ratertrail.operators import source_text as T

OUTER = '''package demo;
/** mentions { and "a } here" */
public class Shape {
    private int size;
    // stray { in a remark
    public int getSize() { return size; }
    public void setSize(int size) { this.size = size; }
    static class Part { void show() { print("{"); } }
}
class Rest { }
'''


def test_class_span_ignores_braces_in_text():
    span = T.class_span(OUTER, "Shape")
    assert (span["start_line"], span["end_line"]) == (3, 9)
    assert T.class_span(OUTER, "Part")["start_line"] == 8
    assert T.class_span(OUTER, "Missing") is None


def test_type_words():
    assert T.class_span("subclass Foo { }", "Foo") is None and T.class_span("class Food { }", "Foo") is None
    for word in ("class", "interface", "enum", "record", "@interface", "@ interface"):
        assert T.class_span(f"\npublic {word} Foo (int a) {{\n}}", "Foo")["start_line"] == 2
    assert T.class_span("x@\ninterface Foo { }", "Foo")["start_line"] == 1


def test_function_span_and_overloads():
    assert "return size" in T.function_span(OUTER, "getSize", 0)["body"]
    src = "class C {\n void m() { zero(); }\n void m(int a) { one(); }\n void m(Map<A, B> a, int b) { two(); }\n}"
    for n, word in enumerate(("zero", "one", "two")):
        assert word in T.function_span(src, "m", n)["body"]
    assert "zero" in T.function_span(src, "m", 7)["body"], "falls back to the first of that name"
    assert "zero" in T.function_span(src, "m", None)["body"]


def test_calls_and_bodiless_declarations_are_not_found():
    src = "class C {\n int a() { x.run(1); Type::run(2); return run(3); }\n abstract int run(int z);\n int run(int z) throws IOException, X<Y> { return 1; }\n}"
    assert T.function_span(src, "run", 1)["start_line"] == 4
    assert T.function_span("interface I { int run(int z); }", "run", 1) is None


def test_unbalanced_literals():
    src = 'class F {\n String s = "open { only";\n char c = \'{\';\n String q = "a\\"{";\n void m() { say("ok"); }\n}'
    assert T.class_span(src, "F")["end_line"] == 6
    assert T.class_span("class G { int x;", "G") is None


def test_mask_keeps_length_lines_and_quotes():
    src = 'a // b { "\nc /* { \n } */ d "x\\"{" e \'}\' "open'
    mask = T.masked(src)
    assert len(mask) == len(src) and mask.count("\n") == src.count("\n")
    assert mask == 'a  /      \nc      \n      d "    " e \' \' "    '
    assert T.masked('"x\\') == '"  ' and T.masked('"a\\"') == '"   ' and T.masked("//") == " /" and T.masked("/*") == "  "


def test_function_list():
    body = "class C {\n C() { if (a) { b(); } }\n void f(int x) { while (x > 0) { x--; } new T() { }; }\n}"
    assert [f["name"] for f in T.function_list(body)] == ["C", "f", "T"]
    far = "void f()" + " " * 298 + "{ }"
    assert [f["name"] for f in T.function_list(far)] == ["f"] and T.function_list("void f()" + " " * 299 + "{ }") == []


def _class(n_functions, n_lines, function="    int g() { return a; }"):
    lines = ["class Big {"] + [function] * n_functions
    return "\n".join(lines + ["    int pad;"] * (n_lines - len(lines) - 1) + ["}"])


def _method(n_lines):
    return "class E {\n  void big() {\n" + "    int v;\n" * (n_lines - 2) + "  }\n}"


CALLS = "class H {\n void go() {\n  this.a(); this.b = 1; this.e = 2;\n  x.c(); y.d();\n%s }\n}"
CASES = [
    ("long method", "E#big", _method(120), True, True), ("long method", "E#big", _method(100), True, True), ("long method", "E#big", _method(99), True, False),
    ("blob", "p.Big", _class(20, 200), True, True), ("blob", "p.Big", _class(19, 200), True, False), ("blob", "p.Big", _class(20, 199), True, False),
    # Two of three functions are accessors; a call on "this" counts as internal and as external.
    ("data class", "p.Shape", OUTER, True, False),
    ("data class", "p.Big", _class(3, 9), True, True),
    ("data class", "p.Big", "class Big { int a; }", True, False),
    ("data class", "p.Big", "class Big {\n int g() { return a; }\n void s() { if (a) { b(); } }\n}", True, False),
    ("feature envy", "H#go", CALLS % "", True, False), ("feature envy", "H#go", CALLS % "  z.e();", True, True),
    ("feature envy", "H#gone", CALLS % "", False, None), ("blob", "p.Other", OUTER, False, None),
]


def test_entity_status(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, smell string, code_name string, content string")
    got = {r.i: (r.alive, r.holds) for r in T.entity_status(df, "content", "smell", "code_name").collect()}
    assert got == {i: (c[3], c[4]) for i, c in enumerate(CASES)}


def test_trivial_fraction_at_the_threshold(spark):
    # Functions far apart, so that no accessor is seen from a neighbour.
    gap = "\n" + "    // filler line of forty characters .....\n" * 9
    src = lambda trivial: "class D {" + gap.join(["int g() { return a; }"] * trivial + ["int h() { return a + b; }"] * (10 - trivial)) + "}"
    df = spark.createDataFrame([(7, src(7)), (6, src(6))], "n int, content string").withColumns({"smell": F.lit("data class"), "code_name": F.lit("D")})
    assert {r.n: r.holds for r in T.entity_status(df, "content", "smell", "code_name").collect()} == {7: True, 6: False}


def test_own_condition(spark):
    df = spark.createDataFrame([("tiny", "p.Shape", OUTER)], "smell string, code_name string, content string")
    got = T.entity_status(df.withColumn("smell", F.lit("blob")), "content", "smell", "code_name", {"blob": lambda span, functions: T.span_lines(span) > 2}).first()
    assert got.holds is True


def test_functions_of_a_class_equal_those_of_its_lines_alone():
    """Looked up in the declarations of the whole text, and found by reading the lines of the class again."""
    rnd = random.Random(4)
    parts = ["class ", "@interface ", "x@\ninterface ", "Foo", "bar", "foo", " ", "\n", "{", "}", "(", ")", ",", "//", "/*", "*/", '"', "'", "\\", "\r\n", "if", "return", ".", ":", "int a", "void "]
    seen = 0
    for k in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(5, 60)))
        if k % 2:
            text = f"/* {text.replace('*/', '')} */ class Foo {{ {text.replace(chr(34), '')} void foo(int a) {{ bar(); }} }}\n}}"
        known = T.Declarations(text)
        span = known.class_span("Foo")
        if span:
            assert known.class_functions("Foo", span["body"]) == T.function_list(span["body"]), text
            seen += len(T.function_list(span["body"])) > 0
    assert seen > 300


def test_many_entities_of_one_content(spark, monkeypatch):
    monkeypatch.setattr(T, "ENTITIES_AT_ONCE", 3)
    names = [("blob", "p.Shape"), ("data class", "p.Rest"), ("blob", "p.Gone"), *[("long method", f"p.Shape#f{i}") for i in range(20)], ("feature envy", "p.Shape#getSize"), ("long method", "p.Shape.Part#show"), (None, None)]
    revisions = spark.createDataFrame([("r", sha, "a", s, c) for sha in ("1", "2", "3") for s, c in names], "repo string, sha string, path string, smell string, code_name string")
    blobs = spark.createDataFrame([("r", "1", "a", OUTER), ("r", "2", "a", OUTER), ("r", "3", "a", None)], "repo string, sha string, path string, content string")
    out = T.status_by_revision(revisions, blobs).collect()
    assert len(out) == 3 * len(names)
    alive = {("blob", "p.Shape"), ("data class", "p.Rest"), ("feature envy", "p.Shape#getSize"), ("long method", "p.Shape.Part#show")}
    for r in out:
        assert r.readable == (r.sha != "3")
        if r.readable and r.smell:
            assert r.alive == ((r.smell, r.code_name) in alive)


@pytest.mark.parametrize("name", ["getSize", "setSize"])
def test_null_inputs(spark, name):
    df = spark.createDataFrame([(None, name), (OUTER, None), (OUTER, name)], "t string, n string")
    found = df.select(T.find_function_span(F.col("t"), F.col("n"), F.lit(None).cast("int")).alias("s")).collect()
    assert [r.s is None for r in found] == [True, True, False]


def test_texts_are_masked_and_listed_in_slices(spark, monkeypatch):
    import pyarrow as pa

    texts = ["a // b", None, "", "int f() { g(\"}\"); }" * 40, "x" * 500, None, "void h(int a) { }"]
    monkeypatch.setattr(T, "TEXT_AT_ONCE", 300)
    parts = list(T._portions(pa.array(texts)))
    assert len(parts) > 2 and [t for p in parts for t in p.to_pylist()] == texts
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = df.select("i", T.mask_source("t").alias("m"), T.list_functions("t").alias("f")).orderBy("i").collect()
    assert [r["m"] for r in got] == [None if t is None else T.masked(t) for t in texts]
    assert [r["f"] and [f.asDict() for f in r["f"]] for r in got] == [None if t is None else T.function_list(t) for t in texts]


def test_nested_and_far_parentheses_pair_as_on_a_stack():
    text = "int a(@B(1) int x) { } int b(" + "int y, " * 100 + "int z) { } c(d() { }) { } ) { } .e() { } (f) {"
    mask, pairs = T.masked(text), {}
    stack = []
    for i, ch in enumerate(mask):
        if ch == "(":
            stack.append(i)
        elif ch == ")" and stack:
            pairs[stack.pop()] = i
    found = [(f[0], f[2]) for f in T.Declarations(text).functions]
    assert [n for n, _ in found] == ["a", "b", "c", "d"] and found[0][1] == "@B(1) int x"
    for name, args in found:
        start = next(s for s in pairs if text[:s].endswith(name))
        assert text[start + 1 : pairs[start]] == args


def test_names_need_no_pattern_each(monkeypatch):
    def refuse(*_):
        raise AssertionError("a pattern for a name")

    monkeypatch.setattr(T.re, "finditer", refuse)
    assert T.class_span("class Ab { } class A { }", "A")["body"] == "class Ab { } class A { }"


def test_texts_spread_by_their_length(spark, monkeypatch):
    monkeypatch.setattr(T, "TEXT_A_TASK", 1000)
    monkeypatch.setattr(T, "LISTS_TO_MERGE", 30)
    blobs = spark.createDataFrame([("r", str(i), "p", f"class A{i} {{ }}" + " " * 985) for i in range(40)], "repo string, sha string, path string, content string")
    lists = T.content_digests(blobs).select("digest", "repo", "sha", "path")
    joined = T._with_texts(lists, blobs)
    # Blanks compress to nothing, yet no task gets many of them.
    assert joined.rdd.getNumPartitions() >= 40
    assert joined.count() == 40 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
