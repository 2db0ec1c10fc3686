"""Chunkers and symbol extraction on small sources."""

import pytest

from quarry.operators import code

PYTHON = '''import os
from a.b import find as seek

LIMIT = 3


class Box(Base):
    """Holds things."""

    @property
    def size(self) -> int:
        return os.path.getsize("x")


async def load(path, *, depth=1):
    return seek(path)
'''


def test_python_chunks_and_imports():
    chunks = code.python_chunks("x/a.py", "x", PYTHON)
    assert [(c[5], c[6], c[7], c[8]) for c in chunks] == [("class_complete", "Box", 7, 12), ("function_definition", "load", 15, 16)]
    assert chunks[0][3].startswith("import os\nfrom a.b import find as seek\n\nclass Box")


def test_python_symbols():
    symbols, imports = code.python_symbols("a.py", PYTHON)
    assert [(s[1], s[2], s[3]) for s in symbols] == [("LIMIT", "variable", ""), ("Box", "class", ""), ("size", "method", "Box"), ("load", "function", "")]
    assert [(i[1], i[2]) for i in imports] == [("os", "os"), ("a.b", "find")]


@pytest.mark.parametrize(
    ("suffix", "text", "expected"),
    [
        ("js", 'class A { m() { return "}"; } }\nfunction f(a) { /* } */ return 1; }\nconst g = (x) => { return x; };\n', [("class_declaration", "A"), ("function_declaration", "f"), ("function_declaration", "g")]),
        ("java", "import a.b;\npublic class A {\n  public int f() { return 1; }\n}\ninterface B { }\n", [("class_declaration", "A"), ("interface_declaration", "B")]),
        ("kt", "data class A(val x: Int) { fun f() = 1 }\nobject B { }\nfun g(x: Int): Int { return x }\n", [("class_declaration", "A"), ("object_declaration", "B"), ("function_declaration", "g")]),
        ("scala", "case class A(x: Int)\ntrait T { def f: Int }\nobject O { }\n", [("class_declaration", "A"), ("trait_declaration", "T"), ("object_declaration", "O")]),
    ],
)
def test_brace_languages(suffix, text, expected):
    assert [(c[5], c[6]) for c in code.brace_chunks(f"a.{suffix}", "p", text, suffix) if c[5] != "module"] == expected


def test_fallback_for_broken_and_unknown_files():
    broken = code.chunk_text("a.py", "p", "def f(:\n" * 60)
    assert [(c[5], c[7], c[8]) for c in broken] == [("text", 1, 50), ("text", 41, 61)]
    assert code.chunk_text("a.go", "p", "")[0][5] == "text"


def test_paired_and_semantic_pieces():
    text = "import x\ndef a():\n  pass\ndef b():\n  pass\n"
    assert code.paired_pieces(text)[0].startswith("import x\ndef a()")
    windows = code.semantic_windows("import x\n" + "".join(f"def f{k}():\n    return {'1 + ' * 200}1\n" for k in range(20)), 500)
    assert len(windows) > 1 and all(w.startswith("import x") for w in windows)


def test_semantic_windows_of_the_query(spark):
    """The registered query's windows: they hold every line, within the budget where a segment allows it."""
    from quarry.plans import code_plans

    data = "/root/testdata/sf0.001"
    texts = {r["file_path"]: r["content"] for r in code_plans.code_files(spark, data, "py").collect()}
    found = {}
    for r in code_plans.t13(spark, data).orderBy("file_path", "ord").collect():
        found.setdefault(r["file_path"], []).append(r["content"])
    assert set(found) == set(texts)
    for path, windows in found.items():
        imports = [x for x in texts[path].split("\n") if x.startswith(("import ", "from "))]
        first, *more = windows
        assert first + "".join(w.split("\n", len(imports))[-1] for w in more) == texts[path]
        assert all(w.split("\n")[: len(imports)] == imports for w in windows)


@pytest.mark.parametrize(
    ("suffix", "text", "expected"),
    [
        ("ts", "interface Shape<T> {\n  area(): number;\n}\nexport default class A extends B {\n  private m<T>(x: T): T { return x; }\n}\nexport const f = async (a: number) => {\n  return a;\n};\n", [("interface_declaration", "Shape"), ("class_declaration", "A")]),
        ("java", "package a;\n// class Hidden { }\n/* class Other { } */\npublic final class A<T extends B> extends C<T> implements D {\n  static class Inner { }\n  void m() { String s = \"} class X {\"; }\n}\nrecord P(int x) { }\n", [("class_declaration", "A"), ("class_declaration", "P")]),
        ("kt", "sealed class A {\n  class B : A()\n  companion object { val x = 1 }\n}\nfun <T> List<T>.second(): T {\n  return this[1]\n}\nfun short(x: Int) = x + 1\n", [("class_declaration", "A"), ("function_declaration", "second"), ("function_declaration", "short")]),
        ("scala", "sealed trait T {\n  def a: Int\n}\ncase object O extends T { def a = 1 }\ndef top(x: Int): Int = {\n  x\n}\n", [("trait_declaration", "T"), ("object_declaration", "O"), ("function_declaration", "top")]),
    ],
)
def test_declarations_in_real_shapes(suffix, text, expected):
    """Generics, nested types, comments and strings that look like code, extension functions: nothing inside a container is cut twice."""
    found = [(c[5], c[6]) for c in code.brace_chunks(f"a.{suffix}", "p", text, suffix) if c[5] != "module"]
    assert [x for x in found if x in expected] == expected and not {"Inner", "B", "Hidden", "Other", "X", "m", "area"} & {n for _, n in found}
