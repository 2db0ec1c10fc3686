"""Cutting source code into classes, functions and modules, and extracting its symbols.

Python is parsed with the standard library's ``ast``; languages with braces are
scanned: a pattern finds a head, and the matching brace ends the body (strings
and comments are skipped).  What no parser takes is cut by lines.  All of it
runs file by file in Arrow batches; rows come out as plain chunk and symbol tables.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CHUNKS = "id string, file_path string, project_path string, content string, language string, chunk_type string, name string, start_line int, end_line int, ord int"
SYMBOLS = "file_path string, name string, type string, scope string, start_line int, end_line int, parameters array<string>, return_type string, docstring string"
IMPORTS = "file_path string, module string, name string, import_text string"

#: Heads of declarations in languages with braces: kind and pattern (fixed values).
HEADS = {
    "js": [("class_declaration", r"\bclass\s+([A-Za-z_$][\w$]*)"), ("interface_declaration", r"\binterface\s+([A-Za-z_$][\w$]*)"), ("function_declaration", r"\bfunction\s*\*?\s+([A-Za-z_$][\w$]*)\s*\("), ("function_declaration", r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>\s*(?=\{)")],
    "java": [("class_declaration", r"\b(?:class|enum|record)\s+([A-Za-z_]\w*)"), ("interface_declaration", r"\binterface\s+([A-Za-z_]\w*)"), ("method_declaration", r"(?:public|private|protected|static|final|abstract|synchronized)\s+(?:[\w<>\[\],.?]+\s+)+([a-z_]\w*)\s*\([^)]*\)\s*(?:throws\s+[\w\s,.]+)?(?=\{)")],
    "kt": [("object_declaration", r"\bobject\s+([A-Za-z_]\w*)"), ("class_declaration", r"\bclass\s+([A-Za-z_]\w*)"), ("interface_declaration", r"\binterface\s+([A-Za-z_]\w*)"), ("function_declaration", r"\bfun\s+(?:<[^>]*>\s*)?(?:[A-Za-z_][\w.]*(?:<[^>]*>)?\??\.)?([A-Za-z_]\w*)\s*\(")],
    "scala": [("trait_declaration", r"\btrait\s+([A-Za-z_]\w*)"), ("object_declaration", r"\bobject\s+([A-Za-z_]\w*)"), ("class_declaration", r"\bclass\s+([A-Za-z_]\w*)"), ("function_declaration", r"\bdef\s+([A-Za-z_]\w*)")],
}
#: Which table a suffix uses, and the kinds that hold other declarations (fixed values).
TABLES = {"js": "js", "jsx": "js", "ts": "js", "tsx": "js", "java": "java", "kt": "kt", "scala": "scala"}
CONTAINERS = {"class_declaration", "interface_declaration", "object_declaration", "trait_declaration"}
_IMPORT_LINE = {"js": r"^\s*(?:import\b.*|(?:const|let|var)\s+.*\brequire\(.*)$", "java": r"^\s*import\s.*$", "kt": r"^\s*import\s.*$", "scala": r"^\s*import\s.*$"}


#: What a declaration's head may go on with on the next line (fixed values).
_HEAD_GOES_ON = re.compile(r"\s*(?:\{|extends\b|implements\b|with\b|where\b|throws\b|:|=>|->|\()")


def suffix_of(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "text"


def _chunk(path: str, project: str, language: str, kind: str, name: str, content: str, start: int, end: int) -> tuple:
    key = f"{path}_{name}_{kind}_{start}_{end}"
    return (hashlib.md5(key.encode()).hexdigest(), path, project, content, language, kind, name, start, end)


def body_end(text: str, at: int) -> int | None:
    """Where the block that opens next after ``at`` ends (past its brace); None if none opens before the statement ends."""
    depth, parens, k, n = 0, text.count("(", max(0, at - 1), at), at, len(text)
    while k < n:
        c = text[k]
        if c in "\"'`":
            end = k + 1
            while end < n and text[end] != c:
                end += 2 if text[end] == "\\" else 1
            k = end
        elif text.startswith("//", k):
            k = n if (e := text.find("\n", k)) < 0 else e
        elif text.startswith("/*", k):
            k = n if (e := text.find("*/", k)) < 0 else e + 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return k + 1 if depth == 0 else None
        elif c in "()" and depth == 0:
            parens += 1 if c == "(" else -1
        elif depth == 0 and (c == ";" or c == "\n" and parens <= 0 and not _HEAD_GOES_ON.match(text, k)):
            return None
        k += 1
    return None


#: Comments and strings of languages with braces.
_UNSPOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.DOTALL)


def masked(text: str) -> str:
    """The text with its comments and strings blanked out; lines and offsets stay."""
    return _UNSPOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def brace_declarations(text: str, table: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, start, end) of declarations; of heads at one place the first pattern's, and none inside a container twice."""
    text, found = masked(text), []
    for kind, pattern in HEADS[table]:
        for m in re.finditer(pattern, text):
            line = text.rfind("\n", 0, m.start()) + 1
            end = body_end(text, m.end())
            if end is None:
                stop = text.find("\n", m.end())
                end = len(text) if stop < 0 else stop
            found.append((line, end, kind, m.group(1)))
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[str, str, int, int]] = []
    held: list[tuple[int, int]] = []
    for start, end, kind, name in found:
        if any(s <= start < e for s, e in held):
            continue  # methods and inner types stay with what holds them
        out.append((kind, name, start, end))
        held.append((start, end))
    return out


def _import_block(text: str, table: str) -> str:
    return "\n".join(re.findall(_IMPORT_LINE[table], text, re.MULTILINE))


def relevant_imports(imports: list[str], names: list[str], body: str) -> list[str]:
    """All imports if any imported name occurs in the body, else none."""
    return imports if any(re.search(rf"\b{re.escape(n)}\b", body) for n in names) else []


def python_chunks(path: str, project: str, text: str, context_lines: int = 0, least_module_tokens: int = 50) -> list[tuple]:
    """Classes with their methods, then functions, then the module's own statements.  Raises SyntaxError."""
    tree, rows = ast.parse(text), text.split("\n")
    imports, names = [], []
    for node in tree.body:
        if isinstance(node, ast.Import | ast.ImportFrom):
            imports.append("\n".join(rows[node.lineno - 1 : node.end_lineno]))
            names += [(a.asname or a.name).split(".")[0] for a in node.names]
    first = lambda node: min([node.lineno, *(d.lineno for d in node.decorator_list)])
    classes = [n for n in tree.body if isinstance(n, ast.ClassDef)]
    functions = [n for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    out = []
    for kind, nodes in (("class_complete", classes), ("function_definition", functions)):
        for node in nodes:
            start, end = first(node), node.end_lineno
            body = "\n".join(rows[start - 1 : end])
            before, after = rows[max(0, start - 1 - context_lines) : start - 1], rows[end : end + context_lines]
            shown = ["# ... context before ...", *before] * bool(before) + [body] + [*after, "# ... context after ..."] * bool(after)
            head = relevant_imports(imports, names, body)
            out.append(_chunk(path, project, "py", kind, node.name, "\n".join([*head, ""] * bool(head) + shown), start, end))
    own = [n for n in tree.body if not isinstance(n, ast.Import | ast.ImportFrom | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
    module = "\n".join("\n".join(rows[n.lineno - 1 : n.end_lineno]) for n in own)
    if len(module) // 4 >= least_module_tokens:
        out.append(_chunk(path, project, "py", "module", "module", "\n".join([*imports, "", module]), own[0].lineno, own[-1].end_lineno))
    return out


def basic_chunks(path: str, project: str, text: str) -> list[tuple]:
    """The plain form: every Python class and function, nested ones too, in order, each behind all imports.

    Chunks have no id.  More than two imports are a chunk of their own, the last.  Other languages, and
    what cannot be parsed, give nothing.
    """
    if suffix_of(path) != "py":
        return []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    place = lambda node: (node.lineno, node.col_offset)
    segment = lambda node: ast.get_source_segment(text, node) or ""
    nodes = sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=place)
    imports = [segment(n) for n in nodes if isinstance(n, ast.Import | ast.ImportFrom)]
    head, out = "\n".join(imports), []
    for node in nodes:
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            out.append(("", path, project, f"{head}\n\n{segment(node)}".strip(), "py", kind, node.name, node.lineno, node.end_lineno))
    if len(imports) > 2:
        out.append(("", path, project, head, "py", "imports", "imports", 1, head.count("\n") + 1))
    return out


def brace_chunks(path: str, project: str, text: str, suffix: str, least_module_tokens: int = 30) -> list[tuple]:
    table = TABLES[suffix]
    imports, out, left, at = _import_block(text, table), [], [], 0
    for kind, name, start, end in brace_declarations(text, table):
        body = text[start:end]
        first, last = text.count("\n", 0, start) + 1, text.count("\n", 0, end) + 1
        out.append(_chunk(path, project, suffix, kind, name, f"{imports}\n\n{body}" if imports else body, first, last))
        left.append(text[at:start])
        at = end
    module = "".join([*left, text[at:]]).strip()
    if out and len(module) // 4 >= least_module_tokens:
        out.append(_chunk(path, project, suffix, "module", "module", module, 1, text.count("\n") + 1))
    return out


def line_chunks(path: str, project: str, text: str, size: int = 50, ratio: float = 0.2) -> list[tuple]:
    rows, step = text.split("\n"), max(1, size - int(size * ratio))
    return [_chunk(path, project, "text", "text", f"lines_{k + 1}", "\n".join(rows[k : k + size]), k + 1, min(k + size, len(rows))) for k in range(0, len(rows), step)]


def chunk_text(path: str, project: str, text: str) -> list[tuple]:
    """By the file's suffix; by lines where no parser takes it or it finds nothing."""
    suffix = suffix_of(path)
    try:
        found = python_chunks(path, project, text) if suffix == "py" else brace_chunks(path, project, text, suffix) if suffix in TABLES else []
    except (SyntaxError, ValueError, RecursionError):
        found = []
    return found or line_chunks(path, project, text)


def semantic_windows(text: str, most_tokens: int = 1000) -> list[str]:
    """Python text packed by segments (each def or class at a line's start) up to a token budget; imports lead each window."""
    pieces = re.split(r"(?m)^(?=(?:def|class|async def)\s|@)", text)
    head = "\n".join(re.findall(r"(?m)^(?:import|from)\s.*$", pieces[0])) if pieces else ""
    out, now = [], ""
    for piece in pieces:
        if now and (len(now) + len(piece)) // 4 > most_tokens:
            out.append(now)
            now = head + "\n" if head else ""
        now += piece
    return [*out, now] if now.strip() else out


def paired_pieces(text: str, most_lines: int = 50) -> list[str]:
    """Pieces that begin at a def or class; each with its follower, cut into blocks of lines."""
    pieces = re.split(r"(?m)(?=^(?:def|class)\s)", text)
    joined = [a + b for a, b in zip(pieces, pieces[1:], strict=False)] or pieces
    return ["\n".join(rows[k : k + most_lines]) for p in joined for rows in [p.split("\n")] for k in range(0, len(rows), most_lines)]


def python_symbols(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    symbols, imports = [], []

    def walk(nodes: list, scope: str) -> None:
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                symbols.append((path, node.name, "class", scope, node.lineno, node.end_lineno, [], None, ast.get_docstring(node)))
                walk(node.body, f"{scope}.{node.name}" if scope else node.name)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                arguments = [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if a.arg not in ("self", "cls")]
                symbols.append((path, node.name, "method" if scope else "function", scope, node.lineno, node.end_lineno, arguments, ast.unparse(node.returns) if node.returns else None, ast.get_docstring(node)))
            elif isinstance(node, ast.Import):
                imports.extend((path, a.name, a.asname or a.name, f"import {a.name}") for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                module = "." * node.level + (node.module or "")
                imports.extend((path, module, a.name, f"from {module} import {a.name}") for a in node.names)
            elif isinstance(node, ast.Assign) and not scope:
                symbols.extend((path, t.id, "variable", scope, node.lineno, node.end_lineno, [], None, None) for t in node.targets if isinstance(t, ast.Name))

    walk(ast.parse(text).body, "")
    return symbols, imports


def text_symbols(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols and imports of a file; none where it cannot be parsed."""
    suffix = suffix_of(path)
    if suffix == "py":
        try:
            return python_symbols(path, text)
        except (SyntaxError, ValueError, RecursionError):
            return [], []
    if suffix not in TABLES:
        return [], []
    table = TABLES[suffix]
    found = [(path, name, kind.split("_")[0], "", text.count("\n", 0, s) + 1, text.count("\n", 0, e) + 1, [], None, None) for kind, name, s, e in brace_declarations(text, table)]
    imports = []
    for line in _import_block(text, table).split("\n"):
        if m := re.search(r"""from\s+['"]([^'"]+)['"]|require\(['"]([^'"]+)['"]\)|^\s*import\s+(?:static\s+)?['"]?([\w./@-]+)""", line):
            module = next(g for g in m.groups() if g)
            imports.append((path, module, module.rsplit("/", 1)[-1].rsplit(".", 1)[-1], line.strip()))
    return found, imports


def _table(rows: list[tuple], schema: str, numbered: bool = False) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def chunk_files(files: DataFrame, cut=chunk_text) -> DataFrame:
    """All chunks of all files, by language; ``files`` has file_path, project_path and content."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, project, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(*c, k) for k, c in enumerate(cut(path or "", project or "", text or ""))]
            yield _table(rows, CHUNKS)

    return files.select("file_path", "project_path", "content").mapInArrow(run, CHUNKS)


def extract_symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, imports) of all files."""

    def run(which: int, schema: str):
        def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _table([r for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in text_symbols(path or "", text or "")[which]], schema)

        return go

    source = files.select("file_path", "content")
    return source.mapInArrow(run(0, SYMBOLS), SYMBOLS), source.mapInArrow(run(1, IMPORTS), IMPORTS)


def text_pieces(files: DataFrame, cut) -> DataFrame:
    """(file_path, ord, content): the pieces that ``cut`` makes of each file's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([(path, k, piece) for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, piece in enumerate(cut(text or ""))], "file_path string, ord int, content string")

    return files.select("file_path", "content").mapInArrow(run, "file_path string, ord int, content string")
