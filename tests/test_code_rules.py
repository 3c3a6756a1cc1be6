"""X02/X07 goldens (FIXTURES §4) and a few more line rules."""


def _corpus(spark, path, text):
    return spark.createDataFrame([("r", path, text)], "repo string, path string, content string")


def test_x02_python_scopes(spark):
    from tessera.operators.code import definitions
    c = _corpus(spark, "m.py", "class A:\n  def f(self):\ndef g():")
    got = {(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in definitions(c).collect()}
    assert got == {("A", "class", 1, 2), ("f", "method", 2, 2), ("g", "function", 3, 3)}


def test_x07_python_calls(spark):
    from tessera.operators.code import call_edges
    c = _corpus(spark, "m.py", "def f():\n  g(1)\nh()")
    got = [(r["caller_name"], r["callee_name"], r["line"]) for r in call_edges(c).collect()]
    assert got == [("f", "g", 2)]


def test_x01_go_and_x04_signature(spark):
    from tessera.operators.code import definitions
    src = "package x\n\ntype Repo struct {\n  n int\n}\n\nfunc (r *Repo) Map() int {\n  return 1\n}\n\nfunc New() *Repo {\n  return nil\n}"
    got = {(r["name"], r["kind"], r["start_line"]) for r in definitions(_corpus(spark, "x.go", src)).collect()}
    assert got == {("Repo", "struct", 3), ("Map", "method", 7), ("New", "function", 11)}
    long_sig = "def " + "a" * 250 + "():\n  pass"
    s = definitions(_corpus(spark, "l.py", long_sig)).first()["signature"]
    assert len(s) == 203 and s.endswith("...")


def test_x06_python_imports(spark):
    from tessera.operators.code import python_imports
    c = _corpus(spark, "m.py", "import os.path as p, sys\nfrom pkg.mod import x as y, z")
    got = sorted(r["name"] for r in python_imports(c).collect())
    assert got == ["os", "sys", "x", "z"]


def test_x05_references(spark):
    from tessera.operators.code import references
    c = _corpus(spark, "m.py", "import os\nx = RepoMap(self)\ndef f():\n  y = Cache()\n")
    allr = {(r["symbol_name"], r["line"]) for r in references(c).collect()}
    assert allr == {("RepoMap", 2), ("self", 2), ("Cache", 4)}
    top = {(r["symbol_name"], r["line"]) for r in references(c, top_level_only=True).collect()}
    assert top == {("RepoMap", 2), ("self", 2)}


def test_j07_call_context(spark):
    from tessera.operators.calls import with_call_context
    from tessera.operators.code import call_edges
    c = _corpus(spark, "m.py", "def f():\n  g(1)\n  h(2)")
    got = sorted((r["callee_name"], r["context"]) for r in with_call_context(call_edges(c), c).collect())
    assert got == [("g", "g(1)"), ("h", "h(2)")]
