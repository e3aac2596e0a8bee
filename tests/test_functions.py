"""Text, path and URL expressions on single values."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import stats, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path,want", [("./src/a.py", "src/a.py"), ("\"a\\b.py\"", "a/b.py"), ("/x/y?z=1#f", "x/y"), ("repo/a.py", "a.py"), ("  `t.md` ", "t.md"), ("././src/a.py", "./src/a.py"), ("`./x`", "x"), ("//a", "a"), ("", None), (None, None), ("''", None), ("#x", None), ("/data/arb/repo/f00/lib/a.py", "lib/a.py"), ("x/arb/repo/only", "only")])
def test_normal_path(spark, path, want):
    assert value(spark, text.normal_path(F.lit(path).cast("string"), F.lit("repo"))) == want


@pytest.mark.parametrize("url,want", [("https://h.com/o/r/blob/main/src/a%20b.py#L3", "src/a b.py"), ("http://h.com/docs/x.html?q=1", "docs/x.html"), ("./lib/a.py", "lib/a.py"), ("https://h.com/a%23b", "a"), ("lib/a%3Fb.py", "lib/a"), ("a%20b+c", "a b+c"), ("100%", "100%"), ("https://h.com/", None), (None, None), ("`src\\x.py`", "src/x.py"), ("https://h.com/x/blob/r/d/blob/e", "d/blob/e")])
def test_path_of_url(spark, url, want):
    assert value(spark, text.path_of_url(F.lit(url).cast("string"))) == want


def test_urls(spark):
    got = value(spark, text.urls(F.lit("see https://a.org/x/., (http://b.org/y#z) and https://a.org/x then <https://c.org>")))
    assert got == ["https://a.org/x", "http://b.org/y", "https://c.org"]
    assert value(spark, text.urls(F.lit("none"))) == []
    assert value(spark, text.urls(F.lit("[https://y.org/c] https://x.org/a_(b) 'http://z.org/q'"))) == ["https://y.org/c", "https://x.org/a_(b", "http://z.org/q"]


def test_url_of_a_repository(spark):
    own = lambda url: value(spark, text.path_of_url(F.lit(url), F.lit("o/r"), F.lit("main")))
    assert own("https://h.com/o/r/blob/main/a/b.py#L1") == "a/b.py" and own("https://h.com/o/r/blob/other/a.py") == "a.py" and own("o/r/c.py") == "c.py"


PATCH = "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -3,4 +3,5 @@ def f\n x\n@@ -20 +21,2 @@\n y\ndiff --git a/n.md b/n.md\n--- /dev/null\n+++ b/n.md\n@@ -0,0 +1,3 @@\n+z\n"


def test_patches(spark):
    assert value(spark, text.patch_files(F.lit(PATCH))) == ["src/a.py", "n.md"]
    assert [tuple(r) for r in value(spark, text.patch_hunks(F.lit(PATCH)))] == [("src/a.py", 3, 6), ("src/a.py", 20, 20), ("n.md", 0, 0)]
    assert [tuple(r) for r in value(spark, text.sections(F.lit("### a/b.py (lines 1-40)\ntext\n### c (lines 5-6)")))] == [("a/b.py", 1, 40), ("c", 5, 6)]
    renamed = "@@ -1 +1 @@\n--- a/old.py\n+++ b/new.py\n@@ -5,2 +5,3 @@ x\n@@ no @@\n--- plain.c\n+++ plain.c\n@@ -7,0 +8 @@\n"
    assert [tuple(r) for r in value(spark, text.patch_hunks(F.lit(renamed)))] == [("old.py", 5, 6), ("plain.c", 7, 7)]
    assert value(spark, text.patch_files(F.lit("diff --git a/x y b/z w\ndiff --git a/p b/q"))) == ["q"]
    block = "### out (lines 1-2)\n<retrieved_context>\n### a\n### b (lines 3-4)\n### a (lines 5-6)\n### c d\n### b"
    assert [tuple(r) for r in value(spark, text.sections(F.lit(block)))] == [("a", 5, 6), ("b", None, None)]


@pytest.mark.parametrize("path,kind,source", [("tests/a.py", "test", True), ("src/contest.py", "test", True), ("docs/a.py", "python_source", False), ("docs/x.rst", "docs", False), ("README.md", "docs", False), ("src/a.go", "other", True), (".py", "python_source", False), ("src/.py", "python_source", False), ("a/Benchmarks/b.PYI", "other", False)])
def test_kinds(spark, path, kind, source):
    assert value(spark, text.path_kind(F.lit(path))) == kind
    assert value(spark, text.is_source_path(F.lit(path))) is source


def test_messages_and_leaks(spark):
    assert value(spark, text.clean_message(F.lit("\n fix it\nSigned-off-by: a\nCo-authored-by: b\n"))) == "fix it"
    assert value(spark, text.clean_message(F.lit("a \t\r\n  Change-Id: z\r\nb\n\n"))) == "a\nb" and value(spark, text.clean_message(F.lit("ab  cd"), 3)) == "ab"
    assert value(spark, text.is_low_value(F.lit("Docs(api): x"))) and not value(spark, text.is_low_value(F.lit("Documents: x")))
    paths = F.array(F.lit("src/Client.py"))
    assert value(spark, text.leaks(F.lit("break in client.PY"), paths)) and not value(spark, text.leaks(F.lit("break in clients"), paths))
    assert not value(spark, text.is_text_candidate(F.lit("a/b.PNG"))) and value(spark, text.is_text_candidate(F.lit("Makefile")))


def test_compact_query(spark):
    prompt = "Problem:\nHow do I sort these things well?\n>>> import x\nimport numpy as np\nx = [1, 2, 3]\ntwo words\nresult = f(a, b, c, d)\nIt   should keep the order.\n A:\nanswer text that goes on"
    assert value(spark, text.compact_query(F.lit(prompt))) == "How do I sort these things well? It should keep the order."
    assert value(spark, text.compact_query(F.lit("x=1\ny=2"))) == "x=1\ny=2"


@pytest.mark.parametrize("term,weight", [("a.b", 1.2), ("a_b", 1.0), ("ABC", 1.0), ("camelCase", 1.0), ("Word", 0.5), ("word", 0.5)])
def test_identifier_weight(spark, term, weight):
    assert value(spark, text.identifier_weight(F.lit(term))) == weight


def test_identities_and_replies(spark):
    lit = F.lit
    none = lit(None).cast("string")
    rest = F.create_map(lit("url"), lit('a"b'), lit("rank"), lit("1"), lit("content"), none)
    own = lambda raw, path=none: value(spark, text.item_identity(lit(raw).cast("string"), path, rest))
    assert own("{'metadata': {'file_path': 'a.py', 'start_line': 3, 'end_line': 9}}") == "a.py:3:9" and own('{"metadata": {"sourceURL": "u"}}') == "u::"
    assert own("{broken") == "{broken" and own("id7", lit("p")) == "id7" and own(None, lit("p")) == "p" and own("", lit("p")) == "p"
    assert own(None) == '{"content": null, "url": "a\\"b"}'
    for reply, code in [("x BEGIN SOLUTION\n<code>\ny = 1\n</code> z", "y = 1"), ("```y```", "y"), ("```python y\n``` ```z```", "y"), ("a # SOLUTION START\nb\n# SOLUTION END c", "b"), ("a\n<code>b</code>", "b"), ("``````", "")]:
        assert value(spark, text.generated_code(lit(reply))) == code
    assert value(spark, text.selected_ids(lit("XE001 E0012345 E002_ (E003)"), F.array(lit("E001"), lit("E002"), lit("E003")), 5)) == ["E003"]
    assert value(spark, text.generated_code(lit("say\n```python\nx = 1\n```\nmore"))) == "x = 1" and value(spark, text.generated_code(lit(" y "))) == "y"
    assert value(spark, text.selected_ids(lit("E003, E001 E003 E9 E999"), F.array(lit("E001"), lit("E002"), lit("E003")), 5)) == ["E003", "E001"]
    empty = F.array().cast("array<string>")
    assert value(spark, text.gold_target(empty, F.array(lit("t")), F.array(lit("c")), empty)) == ["t"] and value(spark, text.gold_target(empty, empty, empty, empty)) == []


def test_vectors(spark):
    zero, one = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert value(spark, stats.cosine(zero, one)) == 0.0 and value(spark, stats.cosine(one, one)) == pytest.approx(1.0)
    assert value(spark, stats.jaccard(F.array(), F.array())) == 1.0
