"""Queries over source code, written from the parts table: one file a part, of five languages and of many shapes.

``code_sql`` gives a file's text as an expression that both engines read (``~`` is
a line's end until the last step), so oracles can work out every name, line and
text of a chunk by arithmetic: k is the part's key, b its key modulo 7, m (1 to
4) the number of methods and f (1 to 3) the number of functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import code, embedding
from quarry.plans.base import query, table
from quarry.sources.files import EMBED_EXTENSIONS, INDEX_EXTENSIONS

SUFFIXES = ("py", "java", "js", "kt", "scala")
#: Columns of a part's file: k, b, m, f, odd (its key is) and big (its size is odd).
SHAPE = "p_partkey AS k, p_partkey % 7 AS b, p_size % 4 + 1 AS m, p_partkey % 3 + 1 AS f, p_partkey % 2 = 1 AS odd, p_size % 2 = 1 AS big, p_partkey % 5 AS language_no, p_partkey % 40 AS constants"


def _spark_repeat(item: str, n: str, first: int = 1) -> str:
    return f"array_join(transform(filter(sequence({first}, greatest({n}, {first})), i -> i <= {n}), i -> {item}), '')"


def _duck_repeat(item: str, n: str, first: int = 1) -> str:
    return f"array_to_string(list_transform(range({first}, CAST({n} AS BIGINT) + 1), lambda i: {item}), '')"


def pieces(repeat) -> dict[str, dict[str, str]]:
    """For each language the parts of its files, in order, as SQL expressions."""
    when = lambda test, text: f"CASE WHEN {test} THEN {text} ELSE '' END"
    return {
        "py": {
            "imports": "'import os~from lib' || b || ' import find' || b || '~'",
            "module": "'~LIMIT = ' || k || '~~'",
            "class": when("odd", "'@decorate~'") + " || 'class Part' || k || " + when("big", "'(Base' || b || ')'") + " || ':~    \"\"\"About ' || k || '.\"\"\"'",
            "methods": repeat("'~    def method_' || i || '(self, key: int = 1) -> str:~        return os.path.join(\"x\", find' || b || '(key))' || CASE WHEN i < m THEN '~' ELSE '' END", "m"),
            "functions": "'~~' || " + repeat("'def make_' || i || '(key, name=\"x\"):~    return ' || CASE WHEN i % 2 = 0 THEN 'find' || b ELSE 'Part' || k END || '(key)~~'", "f"),
            "constants": repeat("'NAME_' || i || ' = 1~'", "constants"),
        },
        "java": {
            "imports": "'package p' || b || ';~import java.util.List;~~'",
            "class": "'public class Part' || k || ' {~  private int key = ' || k || ';~' || " + repeat("'  public int get' || i || '() { return key; } // }~'", "m") + " || '  String t = \"}\";~}'",
            "interface": when("big", "'~~interface Has' || k || ' { int key(); }'"),
            "enum": when("odd", "'~~enum Kind' || k || ' { A, B }'"),
            "end": "'~'",
        },
        "js": {
            "imports": "'import { find } from \"./lib' || b || '\";~~'",
            "class": "'export class Part' || k || ' {~  key() { return \"}\"; }~' || " + repeat("'  get' || i || '(a) { return a; }~'", "m") + " || '}'",
            "functions": "'~' || " + repeat("'~export function make' || i || '(a) {~  return a; // }~}~'", "f"),
            "arrow": when("odd", "'~const go' || k || ' = async (a) => {~  return a;~};'"),
            "end": "'~'",
        },
        "kt": {
            "imports": "'import x.y' || b || '~~'",
            "class": "'data class Part' || k || '(val key: Int) {~' || " + repeat("'  fun get' || i || '() = key~'", "m") + " || '}'",
            "interface": when("big", "'~~interface Has' || k || ' {~  fun size(): Int~}'"),
            "functions": "'~' || " + repeat("'~fun <T> make' || i || '(a: T): T {~  return a~}~'", "f"),
            "object": when("odd", "'~object Only' || k || ' {~  val x = 1~}'"),
            "end": "'~'",
        },
        "scala": {
            "imports": "'import x.y' || b || '~~'",
            "class": "'case class Part' || k || '(key: Int) {~' || " + repeat("'  def get' || i || ' = key~'", "m") + " || '}'",
            "trait": when("big", "'~~trait Has' || k || ' {~  def size: Int~}'"),
            "functions": "'~' || " + repeat("'~def make' || i || '(a: Int): Int = {~  a~}~'", "f"),
            "object": when("odd", "'~object Only' || k || ' {~  val x = 1~}'"),
            "end": "'~'",
        },
    }


def code_sql(repeat) -> str:
    texts = [" || ".join(parts.values()) for parts in pieces(repeat).values()]
    return "replace(CASE language_no " + " ".join(f"WHEN {n} THEN {text}" for n, text in enumerate(texts)) + " END, '~', chr(10))"


_PATH = "'src/part_' || k || '.' || " + "CASE language_no " + " ".join(f"WHEN {n} THEN '{s}'" for n, s in enumerate(SUFFIXES)) + " END"


def code_files(spark, sf_dir, suffix: str | None = None):
    """Source files: file_path, project_path, content."""
    shaped = table(spark, sf_dir, "part").selectExpr(*SHAPE.split(", "))
    rows = shaped.select(F.expr(_PATH).alias("file_path"), F.lit("parts").alias("project_path"), F.expr(code_sql(_spark_repeat)).alias("content"))
    return rows if suffix is None else rows.where(F.endswith("file_path", F.lit(f".{suffix}")))


#: The same as DuckDB CTEs, with the shape beside the text and the part's name in upper bits of nothing.
CODE = f"""
shaped AS (SELECT {SHAPE} FROM part),
code_files AS (SELECT *, {_PATH} AS file_path, {code_sql(_duck_repeat)} AS content FROM shaped)"""

_D = pieces(_duck_repeat)
_LINES = lambda text: f"len(string_split({text}, '~')) - 1"  # noqa: E731  line ends in a piece


def _chunk_rows(language: str) -> str:
    """(file_path, chunk_type, name, start_line, end_line, body): the declarations of a language's files, by arithmetic."""
    d, at = _D[language], _LINES(_D[language]["imports"])
    shape = f"FROM code_files WHERE language_no = {SUFFIXES.index(language)}"
    row = lambda kind, name, start, body, more="": f"SELECT file_path, '{kind}' AS chunk_type, {name} AS name, CAST({start} AS INTEGER) AS start_line, CAST({start} + {_LINES(body)} AS INTEGER) AS end_line, replace({body}, '~', chr(10)) AS body, k, b, f, m {shape}{more}"
    after = lambda *names: " + ".join([f"({_LINES(d[n])})" for n in names])
    each = lambda kind, name, start, body: f"SELECT file_path, '{kind}', {name}, CAST({start} AS INTEGER), CAST({start} + {_LINES(body)} AS INTEGER), replace({body}, '~', chr(10)), k, b, f, m FROM (SELECT *, unnest(range(1, f + 1)) AS i {shape})"
    if language == "py":
        body = f"({d['class']} || {d['methods']})"
        top = f"1 + {after('imports', 'module')}"
        one = "('def make_' || i || '(key, name=\"x\"):~    return ' || CASE WHEN i % 2 = 0 THEN 'find' || b ELSE 'Part' || k END || '(key)')"
        return row("class_complete", "'Part' || k", top, body) + " UNION ALL " + each("function_definition", "'make_' || i", f"{top} + {_LINES(body)} + 2 + 3 * (i - 1)", one)
    start = f"1 + ({at})"
    out = [row("class_declaration", "'Part' || k", start, f"({d['class']})")]
    done = ["imports", "class"]
    if language == "java":
        here = f"1 + {after(*done)} + 2"
        out.append(row("interface_declaration", "'Has' || k", here, "('interface Has' || k || ' { int key(); }')", " AND big"))
        out.append(row("class_declaration", "'Kind' || k", f"1 + {after('imports', 'class', 'interface')} + 2", "('enum Kind' || k || ' { A, B }')", " AND odd"))
    if language == "js":
        out.append(each("function_declaration", "'make' || i", f"1 + {after(*done)} + 2 + 4 * (i - 1)", "('export function make' || i || '(a) {~  return a; // }~}')"))
        out.append(row("function_declaration", "'go' || k", f"1 + {after('imports', 'class', 'functions')} + 1", "('const go' || k || ' = async (a) => {~  return a;~}')", " AND odd"))
    if language in ("kt", "scala"):
        held, text = ("interface", "('interface Has' || k || ' {~  fun size(): Int~}')") if language == "kt" else ("trait", "('trait Has' || k || ' {~  def size: Int~}')")
        out.append(row(f"{held}_declaration", "'Has' || k", f"1 + {after(*done)} + 2", text, " AND big"))
        one = "('fun <T> make' || i || '(a: T): T {~  return a~}')" if language == "kt" else "('def make' || i || '(a: Int): Int = {~  a~}')"
        out.append(each("function_declaration", "'make' || i", f"1 + {after(*done, held)} + 2 + 4 * (i - 1)", one))
        out.append(row("object_declaration", "'Only' || k", f"1 + {after(*done, held, 'functions')} + 1", "('object Only' || k || ' {~  val x = 1~}')", " AND odd"))
    return " UNION ALL ".join(out)


#: The import lines that stand before a chunk's body, by language.
_HEAD = {
    "py": "'import os' || chr(10) || 'from lib' || b || ' import find' || b || chr(10) || chr(10)",
    "java": "'import java.util.List;' || chr(10) || chr(10)",
    "js": "'import { find } from \"./lib' || b || '\";' || chr(10) || chr(10)",
    "kt": "'import x.y' || b || chr(10) || chr(10)",
    "scala": "'import x.y' || b || chr(10) || chr(10)",
}


def _declared(spark, sf_dir, suffix):
    found = code.chunk_files(code_files(spark, sf_dir, suffix)).where("chunk_type <> 'module'")
    return found.select("file_path", "chunk_type", "name", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("digest"))


def _declared_sql(language: str) -> str:
    head = f"CASE WHEN contains(body, 'os.') OR contains(body, 'find' || b) THEN {_HEAD['py']} ELSE '' END" if language == "py" else _HEAD[language]
    return f"WITH {CODE}, c AS ({_chunk_rows(language)}) SELECT file_path, chunk_type, name, start_line, end_line, md5({head} || body) AS digest FROM c"


def _register(name: str, language: str) -> None:
    @query(name, _declared_sql(language))
    def run(spark, sf_dir):
        return _declared(spark, sf_dir, language)


for _name, _language in (("t2_python_chunks", "py"), ("t6_script_chunks", "js"), ("t7_java_chunks", "java"), ("t8_kotlin_chunks", "kt"), ("t8_scala_chunks", "scala")):
    _register(_name, _language)


def _by_suffix(spark, sf_dir, extensions):
    suffix = F.regexp_extract("file_path", r"(\.[a-z]+)$", 1)
    return code_files(spark, sf_dir).where(suffix.isin(*extensions)).groupBy(suffix.alias("suffix")).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


def _suffix_sql(extensions) -> str:
    return f"WITH {CODE} SELECT regexp_extract(file_path, '(\\.[a-z]+)$', 1) AS suffix, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars FROM code_files WHERE suffix IN ({', '.join(repr(e) for e in extensions)}) GROUP BY 1"


@query("s2_scan_by_patterns", _suffix_sql(INDEX_EXTENSIONS))
def s2(spark, sf_dir):
    return _by_suffix(spark, sf_dir, INDEX_EXTENSIONS)


@query("s4_scan_for_index", _suffix_sql(EMBED_EXTENSIONS))
def s4(spark, sf_dir):
    return _by_suffix(spark, sf_dir, EMBED_EXTENSIONS)


@query("s3_scan_and_parse", f"WITH {CODE} SELECT file_path, CAST(CASE language_no WHEN 0 THEN 2 + m + f + constants WHEN 1 THEN 1 + big::INT + odd::INT WHEN 2 THEN 1 + f + odd::INT ELSE 1 + big::INT + f + odd::INT END AS BIGINT) AS symbols FROM code_files")
def s3(spark, sf_dir):
    symbols, _ = code.extract_symbols(code_files(spark, sf_dir))
    return symbols.groupBy("file_path").agg(F.count("*").alias("symbols"))


@query("t1_dispatch", f"WITH {CODE} SELECT regexp_extract(file_path, '([a-z]+)$', 1) AS language, count(*) AS files FROM code_files GROUP BY 1 UNION ALL SELECT 'text', count(*) FROM code_files")
def t1(spark, sf_dir):
    """Five parsers by suffix; the same files under a suffix without one are cut by lines."""
    rows = code_files(spark, sf_dir)
    other = rows.withColumn("file_path", F.regexp_replace("file_path", r"\.[a-z]+$", ".zig"))
    return code.chunk_files(rows.unionByName(other)).groupBy("language").agg(F.countDistinct("file_path").alias("files"))


@query("t3_class_chunks", f"WITH {CODE}, c AS ({_chunk_rows('py')}) SELECT file_path, name, end_line - start_line + 1 AS body_lines, end_line - start_line + 4 AS chunk_lines FROM c WHERE chunk_type = 'class_complete'")
def t3(spark, sf_dir):
    found = code.chunk_files(code_files(spark, sf_dir, "py")).where("chunk_type = 'class_complete'")
    return found.select("file_path", "name", (F.col("end_line") - F.col("start_line") + 1).alias("body_lines"), F.size(F.split("content", "\n")).alias("chunk_lines"))


@query("t4_code_imports", f"WITH {CODE} SELECT file_path, CASE language_no WHEN 0 THEN 'lib' || b || ',os' WHEN 1 THEN 'java.util.List' WHEN 2 THEN './lib' || b ELSE 'x.y' || b END AS modules FROM code_files")
def t4(spark, sf_dir):
    _, imports = code.extract_symbols(code_files(spark, sf_dir))
    return imports.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"))


_MODULE = f"('LIMIT = ' || k || CASE WHEN constants > 0 THEN '~' ELSE '' END || rtrim({_D['py']['constants']}, '~'))"


@query("t5_module_chunks", f"WITH {CODE} SELECT file_path, md5('import os' || chr(10) || 'from lib' || b || ' import find' || b || chr(10) || chr(10) || replace({_MODULE}, '~', chr(10))) AS digest FROM code_files WHERE language_no = 0 AND length({_MODULE}) // 4 >= 50")
def t5(spark, sf_dir):
    found = code.chunk_files(code_files(spark, sf_dir, "py")).where("chunk_type = 'module'")
    return found.select("file_path", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    "t17_code_symbols",
    f"""WITH {CODE}, p AS (SELECT *, 1 + {_LINES(_D['py']['imports'])} + {_LINES(_D['py']['module'])} + odd::INT AS top FROM code_files WHERE language_no = 0)
    SELECT file_path, 'Part' || k AS name, 'class' AS type, '' AS scope, CAST(top AS INTEGER) AS start_line, '' AS parameters, '' AS returns FROM p
    UNION ALL SELECT file_path, 'method_' || i, 'method', 'Part' || k, CAST(top + 2 + 3 * (i - 1) AS INTEGER), 'key', 'str' FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM p)
    UNION ALL SELECT file_path, 'make_' || i, 'function', '', CAST(top + 1 + 3 * m + 2 + 3 * (i - 1) - 1 AS INTEGER), 'key,name', '' FROM (SELECT *, unnest(range(1, f + 1)) AS i FROM p)""",
)
def t17(spark, sf_dir):
    symbols, _ = code.extract_symbols(code_files(spark, sf_dir, "py"))
    return symbols.where("type <> 'variable'").select("file_path", "name", "type", "scope", "start_line", F.array_join("parameters", ",").alias("parameters"), F.coalesce("return_type", F.lit("")).alias("returns"))


@query("p8_class_structure", f"WITH {CODE} SELECT file_path, 'Part' || k AS name, array_to_string(list_transform(range(1, m + 1), lambda i: 'method_' || i), ',') AS methods, CASE WHEN big THEN 'Base' || b ELSE '' END AS bases FROM code_files WHERE language_no = 0")
def p8(spark, sf_dir):
    s = embedding.class_structure(F.col("content"))
    return code_files(spark, sf_dir, "py").select("file_path", s["name"].alias("name"), F.array_join(s["methods"], ",").alias("methods"), F.array_join(s["bases"], ",").alias("bases"))


@query("p9_function_structure", f"WITH {CODE} SELECT file_path, 'method_1' AS name, 'key' AS parameters, 'str' AS returns FROM code_files WHERE language_no = 0 UNION ALL SELECT file_path, 'make_' || f, 'key,name', 'value' FROM code_files WHERE language_no = 0")
def p9(spark, sf_dir):
    """Of every file the first method and the last function."""
    first = F.regexp_extract("content", r"(?s)(def method_1.*?\n.*?)\n", 1)
    last = F.regexp_extract("content", r"(?s).*(def make_.*)$", 1)
    bodies = code_files(spark, sf_dir, "py").select("file_path", F.explode(F.array(first, last)).alias("body"))
    s = embedding.function_structure(F.col("body"))
    return bodies.select("file_path", s["name"].alias("name"), F.array_join(s["parameters"], ",").alias("parameters"), s["returns"].alias("returns"))


@query("p10_import_structure", f"WITH {CODE} SELECT file_path, 'lib' || b || ',os' AS modules, 'find' || b AS names FROM code_files WHERE language_no = 0")
def p10(spark, sf_dir):
    s = embedding.import_structure(F.col("content"))
    return code_files(spark, sf_dir, "py").select("file_path", F.array_join(s["modules"], ",").alias("modules"), F.array_join(s["names"], ",").alias("names"))


@query(
    "p6_symbols_by_pattern",
    f"""WITH {CODE}, mk AS (SELECT *, list_transform(range(1, f + 1), lambda i: 'make' || i) AS makes FROM code_files)
    SELECT file_path, array_to_string(CASE language_no
        WHEN 0 THEN list_concat(['Part' || k], list_transform(range(1, m + 1), lambda i: 'method_' || i), list_transform(range(1, f + 1), lambda i: 'make_' || i))
        WHEN 1 THEN list_concat(['Part' || k], CASE WHEN big THEN ['Has' || k] ELSE [] END, CASE WHEN odd THEN ['Kind' || k] ELSE [] END, list_transform(range(1, m + 1), lambda i: 'get' || i))
        WHEN 2 THEN list_concat(['Part' || k], makes, CASE WHEN odd THEN ['go' || k] ELSE [] END) ELSE [] END, ',') AS names FROM mk""",
)
def p6(spark, sf_dir):
    language = F.regexp_extract("file_path", r"([a-z]+)$", 1)
    return code_files(spark, sf_dir).select("file_path", F.array_join(embedding.symbols_by_pattern(F.col("content"), language), ",").alias("names"))


@query("p18_class_name", rf"WITH {CODE} SELECT file_path, trim(regexp_extract(content, 'class ([^(:\n]*)', 1)) AS class_name FROM code_files")
def p18(spark, sf_dir):
    return code_files(spark, sf_dir).select("file_path", embedding.class_name(F.col("content")).alias("class_name"))


@query("p11_parent_summary", f"WITH {CODE} SELECT file_path, 'class Part' || k || ' with ' || array_to_string(list_transform(range(1, m + 1), lambda i: 'method_' || i), ', ') AS summary FROM code_files WHERE language_no = 0")
def p11(spark, sf_dir):
    found = code.chunk_files(code_files(spark, sf_dir, "py")).where("chunk_type = 'class_complete'")
    return found.select("file_path", embedding.parent_summary(F.col("chunk_type"), F.col("content")).alias("summary"))


_T11_BODY = f"(substring({_D['py']['class']}, 1 + CASE WHEN odd THEN 10 ELSE 0 END) || {_D['py']['methods']})"
_T11_TOP = f"(1 + {_LINES(_D['py']['imports'])} + {_LINES(_D['py']['module'])} + 2 * odd::INT)"
_T11_METHOD = "('def method_' || i || '(self, key: int = 1) -> str:~        return os.path.join(\"x\", find' || b || '(key))')"
_T11_FUNCTION = "('def make_' || i || '(key, name=\"x\"):~    return ' || CASE WHEN i % 2 = 0 THEN 'find' || b ELSE 'Part' || k END || '(key)')"


@query(
    "t11_basic_chunks",
    f"""WITH {CODE}, p AS (SELECT *, CASE WHEN odd THEN 'import sys' || chr(10) ELSE '' END || 'import os' || chr(10) || 'from lib' || b || ' import find' || b AS head FROM code_files WHERE language_no = 0),
    c AS (SELECT file_path, head, 'class_definition' AS chunk_type, {_T11_TOP} AS start_line, {_T11_BODY} AS body FROM p
          UNION ALL SELECT file_path, head, 'function_definition', {_T11_TOP} + 2 + 3 * (i - 1), {_T11_METHOD} FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM p)
          UNION ALL SELECT file_path, head, 'function_definition', {_T11_TOP} + {_LINES(_T11_BODY)} + 2 + 3 * (i - 1), {_T11_FUNCTION} FROM (SELECT *, unnest(range(1, f + 1)) AS i FROM p))
    SELECT '' AS id, file_path, chunk_type, CAST(start_line AS INTEGER) AS start_line, CAST(start_line + {_LINES('body')} AS INTEGER) AS end_line, md5(head || chr(10) || chr(10) || replace(body, '~', chr(10))) AS digest FROM c
    UNION ALL SELECT '', file_path, 'imports', 1, 3, md5(head) FROM p WHERE odd""",
)
def t11(spark, sf_dir):
    """The basic chunker; files of odd parts have a third import."""
    rows = code_files(spark, sf_dir)
    odd = F.regexp_extract("file_path", r"(\d+)\.", 1).cast("long") % 2 == 1
    found = code.chunk_files(rows.withColumn("content", F.when(odd, F.concat(F.lit("import sys\n"), "content")).otherwise(F.col("content"))), code.basic_chunks)
    return found.select("id", "file_path", "chunk_type", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    "t12_paired_pieces",
    f"""WITH {CODE}, cuts AS (SELECT file_path, list_filter(string_split(replace(replace(content, chr(10) || 'def ', chr(10) || chr(1) || 'def '), chr(10) || 'class ', chr(10) || chr(1) || 'class '), chr(1)), lambda x: x <> '') AS p FROM code_files WHERE language_no = 0),
    pairs AS (SELECT file_path, unnest(range(1, len(p))) AS n, p FROM cuts),
    rows AS (SELECT file_path, n, string_split(p[n] || p[n + 1], chr(10)) AS r FROM pairs),
    blocks AS (SELECT file_path, n, unnest(range(0, len(r), 50)) AS pos, r FROM rows)
    SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY n, pos) - 1 AS INTEGER) AS ord, md5(array_to_string(r[pos + 1 : pos + 50], chr(10))) AS digest FROM blocks""",
)
def t12(spark, sf_dir):
    return code.text_pieces(code_files(spark, sf_dir, "py"), code.paired_pieces).select("file_path", "ord", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("t13_semantic_windows")
def t13(spark, sf_dir):
    """A greedy fold with a head in every window; tests hold it against a plain version."""
    return code.text_pieces(code_files(spark, sf_dir, "py"), code.semantic_windows)
