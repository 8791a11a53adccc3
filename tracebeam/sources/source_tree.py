"""Source trees: which files to read, and the code structure of Python files."""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracebeam import schemas
from tracebeam.functions.texts import glob_regex

# File types, folders and file names that are never read.
EXTENSIONS = {
    "python": (".py",),
    "typescript": (".ts",),
    "tsx": (".tsx",),
    "javascript": (".js", ".mjs", ".cjs"),
    "go": (".go",),
    "ruby": (".rb",),
    "java": (".java",),
    "rust": (".rs",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"),
    "php": (".php",),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
}
SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", ".env", "node_modules", "__pycache__",
    ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", ".nox", "dist", "build", ".next",
    ".nuxt", ".turbo", ".cache", "target", "out", "site-packages", ".idea", ".vscode",
)
FILES_AT_ONCE = 200
SKIPPED_FILES = ("*.min.js", "*.min.css", "*.map", "*.pyc", "*.pyo", "*.so", "*.dylib", "*.dll")


def language_of(path: Column) -> Column:
    """Language by file extension; null when it is not a known one."""
    suffix = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return F.coalesce(
        *[F.when(suffix.isin(*suffixes), F.lit(name)) for name, suffixes in EXTENSIONS.items()]
    )


def module_name(path: Column) -> Column:
    """``pkg/sub/mod.py`` to ``pkg.sub.mod``."""
    return F.translate(F.regexp_replace(path, r"\.[^./]+$", ""), "/", ".")


def select_source_files(files: DataFrame, languages: Sequence[str] = ("python",)) -> DataFrame:
    """Keep files (repo_key, path, source) of the languages outside skipped folders and names."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    name = F.substring_index("path", "/", -1)
    skipped = F.lit(False)
    for pattern in SKIPPED_FILES:
        skipped = skipped | name.rlike(glob_regex(pattern))
    return (
        files.withColumn("language", language_of(F.col("path")))
        .where(F.col("language").isin(*languages) & ~skipped)
        .where(~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in SKIPPED_FOLDERS])))
        .withColumn("module_name", module_name(F.col("path")))
    )


def scan_source_tree(
    spark: SparkSession, root: str, repo_key: str, languages: Sequence[str] = ("python",)
) -> DataFrame:
    """Source files under ``root`` with text, language, module name and path inside the tree."""
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.instr(F.col("path"), base)
    files = raw.select(
        F.lit(repo_key).alias("repo_key"),
        F.col("path").substr(at + F.lit(len(base)), F.length("path")).alias("path"),
        "content",
    )
    picked = select_source_files(files, languages)
    return picked.withColumn(
        "source", F.make_valid_utf8(F.col("content").cast("string"))
    ).drop("content")


def _text(node: ast.AST | None, source: str) -> str:
    return (ast.get_source_segment(source, node) or "") if node is not None else ""


def _calls(body: Sequence[ast.AST], source: str) -> list[dict]:
    """Every call in the body, outer before inner, in order of the text."""
    found: list[dict] = []
    todo = list(reversed(body))
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Call):
            found.append({"callee": _text(node.func, source), "line": node.lineno})
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    return found


def _docstring(node: ast.AST) -> str | None:
    return ast.get_docstring(node, clean=False)


def _function(node, source: str, scope: str, parent: str | None) -> dict:
    head = _text(node, source)
    start = head.find("(", head.find(node.name))
    if node.returns is not None:
        end = head.find(_text(node.returns, source), start) + len(_text(node.returns, source))
        signature = head[start:end]
    else:
        depth = 0
        end = start
        for end in range(start, len(head)):
            depth += {"(": 1, ")": -1}.get(head[end], 0)
            if depth == 0:
                break
        signature = head[start : end + 1]
    return {
        "qualified_name": f"{scope}.{node.name}",
        "name": node.name,
        "signature": signature,
        "start_line": node.lineno,
        "end_line": node.end_lineno,
        "docstring": _docstring(node),
        "is_async": isinstance(node, ast.AsyncFunctionDef),
        "is_method": parent is not None,
        "parent_class": parent,
        "decorators": [_text(d, source) for d in node.decorator_list],
        "calls": _calls(node.body, source),
    }


def _structure(source: str, module: str) -> dict:
    """Structure of one file; a file that does not parse has an error and nothing else."""
    out: dict = {
        "imports": [], "parse_errors": [], "functions": [], "classes": [], "symbols": []
    }
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as problem:
        out["parse_errors"] = [f"{type(problem).__name__}: {problem}"]
        return out

    def symbol(name: str, kind: str, line: int) -> None:
        out["symbols"].append(
            {"qualified_name": f"{module}.{name}", "name": name, "kind": kind, "line": line}
        )

    for node in tree.body:
        if isinstance(node, ast.Import):
            for item in node.names:
                alias = [(item.asname, item.name)] if item.asname else []
                out["imports"].append(
                    {"module": item.name, "names": [], "alias_of": alias, "line": node.lineno,
                     "is_relative": False}
                )
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append(
                {"module": "." * node.level + (node.module or ""),
                 "names": [item.name for item in node.names],
                 "alias_of": list({i.asname: i.name for i in node.names if i.asname}.items()),
                 "line": node.lineno, "is_relative": node.level > 0}
            )
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["functions"].append(_function(node, source, module, None))
            symbol(node.name, "function", node.lineno)
        elif isinstance(node, ast.ClassDef):
            name = f"{module}.{node.name}"
            methods = [
                _function(m, source, name, name)
                for m in node.body
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))
            ]
            out["functions"].extend(methods)
            out["classes"].append(
                {"qualified_name": name, "name": node.name, "start_line": node.lineno,
                 "end_line": node.end_lineno, "docstring": _docstring(node),
                 "decorators": [_text(d, source) for d in node.decorator_list],
                 "base_classes": [_text(b, source) for b in node.bases],
                 "method_qnames": [m["qualified_name"] for m in methods]}
            )
            symbol(node.name, "class", node.lineno)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            if isinstance(targets[0], ast.Name):
                name = targets[0].id
                symbol(name, "constant" if name.isupper() else "variable", node.lineno)
    return out


def parse_sources(files: DataFrame) -> DataFrame:
    """Add the structure of each Python file as nested columns (the source text stays)."""
    columns = list(schemas_of_structure())

    shape = StructType.fromDDL(schemas.CODE_STRUCTURE)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {f.name: f.type for f in to_arrow_schema(shape)}
        for batch in batches:
            # few files at a time: their parsed structure is many times their text
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                part = batch.slice(at, FILES_AT_ONCE)
                source, module = (part.column(part.schema.get_field_index(c)) for c in ("source", "module_name"))
                found = [_structure(s or "", m) for s, m in zip(source.to_pylist(), module.to_pylist())]
                made = [pa.array([f[c] for f in found], types[c]) for c in columns]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *columns])

    return files.mapInArrow(convert, f"{kept}, {schemas.CODE_STRUCTURE}")


def schemas_of_structure() -> tuple[str, ...]:
    return ("imports", "parse_errors", "functions", "classes", "symbols")


def structure_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Tables files, functions (methods included), classes, symbols of parsed files."""
    files = parsed.select(
        "repo_key", "path", "language", "module_name", "imports", "parse_errors",
        (F.length("source") - F.length(F.replace("source", F.lit("\n"), F.lit(""))) + 1).alias("loc"),
        F.size("functions").alias("n_functions"),
        F.size("classes").alias("n_classes"),
        F.size(F.filter("functions", lambda f: f["is_method"])).alias("n_methods"),
        F.size("symbols").alias("n_symbols"),
    )
    rows = lambda name: parsed.select(
        "repo_key", F.col("path").alias("file_path"), F.explode(name).alias("x")
    ).select("repo_key", "file_path", "x.*")
    return {
        "files": files,
        "functions": rows("functions").withColumn("n_calls", F.size("calls")),
        "classes": rows("classes").withColumn("n_methods", F.size("method_qnames")),
        "symbols": rows("symbols"),
    }


def extract_code_structure(files: DataFrame) -> dict[str, DataFrame]:
    return structure_tables(parse_sources(files))
