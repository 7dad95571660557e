import difflib
import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import arrow
from quarry.functions import text as T
from quarry.functions import vector as V


def one(spark, column, **values):
    """A column's value over one row of literals."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(column.alias("x")).first().x


def test_statement(spark):
    src = 'lemma countable_union_of_Union [simp]:\n  "countable union_of P ⟹ ⋃ A ∈ X"\nproof -'
    assert one(spark, T.statement(F.col("s")), s=src) == '"countable union_of P ⟹ ⋃ A ∈ X"'
    assert one(spark, T.statement(F.col("s")), s="lemma proofs: \"P\" by x") == '"P" by x'
    assert one(spark, T.strip_proof(F.col("s")), s="a proof_x 'proof proof b") == "a proof_x 'proof "
    assert one(spark, T.strip_command(F.col("s")), s="  functions f") == "  functions f"


def test_mentions(spark):
    s = '"countable union_of P ⟹ ⋃ A ∈ X"'
    symbols = {"\\<Union>": "⋃", "\\<Inter>": "⋂"}
    cases = [("countable", s, True), ("union", s, False), ("countable", '"uncountable A"', False), ("countable", '"Set.countable A"', True), ("Set.countable", '"Set.countable A"', True), ("\\<Union>", s, True), ("⋃", s, True), ("\\<Inter>", s, False)]
    for token, text, want in cases:
        assert one(spark, T.mentions(F.col("s"), token, symbols), s=text) is want, token


def test_template(spark):
    out = one(spark, T.template("{{{a}}} and {b}{{}}", a=F.col("a"), b=F.col("b")), a="x{b}", b="y")
    assert out == "{x{b}} and y{}"
    for bad in ("{c}", "{a", "a}"):
        with pytest.raises(ValueError):
            T.template(bad, a=F.lit("x"))


@pytest.mark.parametrize(("raw", "want"), [("x<BEGIN> a <END> b", "a"), ("a<END>b", "a"), (" plain ", "plain"), ("x<BEGIN>y<BEGIN>z", "y<BEGIN>z")])
def test_marked(spark, raw, want):
    assert one(spark, T.marked(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("VERDICT: duplicate because\nit is", ("DUPLICATE", "because\nit is")), ("VERDICT: maybe x", ("UNKNOWN", "VERDICT: maybe x")), ("none", ("UNKNOWN", "none")), ("a <BEGIN>VERDICT : Variant.<END>", ("VARIANT", "."))])
def test_verdict(spark, raw, want):
    word, reason = T.verdict(F.col("s"))
    assert (one(spark, word, s=raw), one(spark, reason, s=raw)) == want


def test_qualifier(spark):
    strings = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    cases = [("Groebner_Bases.Reduced_GB", [], ["Reduced_GB.gd_term.is_reduced_GB_unique"], "gd_term"), ("HOL.List", [], ["List.set_map"], None), ("Regular-Sets.Pi", ["Pi.embed.rderiv"], [], "embed"), ("Regular-Sets.Derivatives", ["Derivatives.deriv_graph", "Derivatives.deriv"], ["Derivatives.deriv_graph.intros(1)"], None), ("A.B", [], [], None)]
    for theory, declared, facts, want in cases:
        assert one(spark, T.qualifier(F.col("t"), strings(declared), strings(facts)), t=theory) == want


def test_names(spark):
    few, more = T.names(F.array(F.lit("f.simps(1)"), F.lit("f.simps(2)"), F.lit("g")), F.array(F.lit("g"), F.lit("h")), most=2)
    assert one(spark, few, z=1) == ["f.simps", "g"] and one(spark, more, z=1) == 1


def test_url_parameters(spark):
    got = one(spark, T.url_parameters(F.col("q")), q="a=1&b&a=x+y%21&c=")
    assert got == {"b": "", "a": "x y!", "c": ""}
    p = T.url_parameters(F.col("q"))
    assert one(spark, T.int_parameter(p, "n", 5), q="n=12") == 12 and one(spark, T.int_parameter(p, "n", 5), q="") == 5 and one(spark, T.int_parameter(p, "n", 5), q="n=x") is None
    assert one(spark, T.bool_parameter(p, "n", True), q="n=false") is False and one(spark, T.bool_parameter(p, "n", True), q="n=no") is None


@pytest.mark.parametrize(("header", "want"), [("Example.ORG:8080", "example.org"), (" [::1]:80 ", "[::1]"), ("localhost", "localhost")])
def test_host_name(spark, header, want):
    assert one(spark, T.host_name(F.col("h")), h=header) == want


def test_prompts(spark):
    p = T.describe_prompt("{title}|{abstract}|{theorem_content}", F.col("s"), F.col("t"), F.col("a"), limit=20)
    assert one(spark, p, s=" lemma x proof y ", t="", a="") == "-- no title --|-- no abstract --|lemma x"
    assert one(spark, p, s="x", t="Great Title", a="some abstract words here") == "great title|abstra...|x"
    assert one(spark, T.embedding_input("E: {doc_src}", F.lit("d"), F.lit(" s ")), z=1) == "E: d\n\ns"
    assert [one(spark, T.combine_query(m, F.lit("a"), F.lit("b")), z=1) for m in ("original", "expanded", "combined")] == ["a", "b", "a\n\nb"]


def test_identity_links_revisions(spark):
    assert one(spark, T.identity(F.lit("i"), F.lit("f"), F.lit("")), z=1) == "i" and one(spark, T.identity(F.lit("i"), F.lit("f"), F.lit("e")), z=1) == "f|e"
    assert one(spark, T.relative_to(F.lit("/b/c/x.y"), ["/a", "/b/"]), z=1) == "c/x.y" and one(spark, T.relative_to(F.lit("/z"), ["/a"]), z=1) is None
    for a, b, want in (("abc", "ab", True), ("ab", "abc", True), ("", "a", False), ("ab", "ac", False)):
        assert one(spark, T.same_revision(F.lit(a), F.lit(b)), z=1) is want
    assert [one(spark, T.entry_of_changed_path(F.lit(p)), z=1) for p in ("thys/A/B.thy", "metadata/entries/C.toml", "x/y")] == ["A", "C", "x/y"]
    base, number = T.release_tag(F.lit("rel2026-3"), "rel")
    assert (one(spark, base, z=1), one(spark, number, z=1)) == ("2026", 3)
    assert one(spark, T.location_label(F.lit(""), F.lit("HOME/x/y|1"), "HOME/", "Lib/"), z=1) == "Lib/x/y"


def test_distances(spark):
    array = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    assert one(spark, V.cosine_distance(array([1, 0]), array([1, 0])), z=1) == 0
    assert abs(one(spark, V.cosine_distance(array([1, 0]), array([1, 1])), z=1) - (1 - 2**-0.5)) < 1e-12
    assert one(spark, V.squared_l2(array([1, 2]), array([4, 6])), z=1) == 25
    assert one(spark, V.relative_squared_error(array([1, 1]), array([1, 0])), z=1) == 1
    with pytest.raises(ValueError):
        V.distance(F.lit(1), F.lit(2), "l3")
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), (None,), ([None, 1.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r.x for r in df.select(V.valid(F.col("v"), 2).alias("x")).collect()] == [True] + [False] * 6
    assert df.select(V.valid(F.col("v"), 2, "l2").alias("x")).collect()[1].x is True


def test_arrow_functions(spark):
    df = spark.createDataFrame([("abcd", "bcde", '{"b":1,"a":[2]}', 1), (None, "x", "no", 2), ("", "", "[]", 3)], "a string, b string, j string, n int")
    rows = df.select(arrow.adler32("a").alias("s"), arrow.ratio("a", "b").alias("r"), arrow.similarity("a", "b").alias("y"), arrow.canonical_json("j").alias("j")).collect()
    assert [r.s for r in rows] == [zlib.adler32(b"abcd"), None, 1]
    assert [r.r for r in rows] == [0.75, None, 1.0] and [r.y for r in rows] == [0.0, 0.0, 0.0]
    assert [r.j for r in rows] == ['{"a":[2],"b":1}', None, "[]"]
    lines = spark.createDataFrame([("a\nx\nb\nx\nx", "x", 4), ("a", "z", 1), ("x", "x", None)], "t string, p string, n int")
    assert [r.x for r in lines.select(arrow.nearest_line("t", "p", "n").alias("x")).collect()] == [4, None, 1]
    v = spark.createDataFrame([([1.5, -2.0],)], "v array<float>").select(arrow.bytes_of_floats("v").alias("b")).select("b", arrow.floats_of_bytes("b").alias("v")).first()
    assert bytes(v.b) == np.array([1.5, -2], "<f4").tobytes() and list(v.v) == [1.5, -2.0]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab c", max_size=30), st.text(alphabet="ab c", max_size=30))
def test_ratio_is_the_definition(a, b):
    assert arrow.sequence_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_canonical_forms():
    from quarry.operators import report

    assert report.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert report.public_values({"my_API_key": 1, "Token": 2, "tokens": 3, "x": [{"password2": 1, "y": 2}]}) == {"tokens": 3, "x": [{"y": 2}]}
    assert report.fence("a ``` b").startswith("````\n") and report.link("a_b", "http://x/ y") == "[a\\_b](<http://x/%20y>)"
    assert json.loads(report.canonical([1, 2])) == [1, 2]
