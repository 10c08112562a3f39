"""Source-code rules: (path, content) to issues (path, line, rule, severity, message).

Python files are parsed in Arrow batches (a syntax tree is what built-in functions can't give); other files are matched
line by line with built-in patterns. Unparsable and null files give a syntax error and nothing, respectively.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, line int, rule string, severity string, message string"
_CALLS_THAT_CHANGE = {"append", "add", "pop", "remove", "update", "clear", "write", "insert", "extend", "discard", "setdefault"}
_TODO = re.compile(r"\b(?:TODO|FIXME|XXX|HACK)\b")
_BACKDOOR = re.compile(r"(?i)(?:^|_)(?:for_test(?:ing)?|test_only|backdoor|mock_mode)(?:_|$)")


def _names(node: ast.AST) -> Iterator[ast.AST]:
    """Names and attributes within an annotation, those in quoted ones too."""
    for x in ast.walk(node):
        if isinstance(x, ast.Constant) and isinstance(x.value, str):
            try:
                yield from _names(ast.parse(x.value, mode="eval").body)
            except SyntaxError:
                continue
        elif isinstance(x, (ast.Name, ast.Attribute)):
            yield x


def _called(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


def _parts(node: ast.AST) -> list[ast.AST]:
    """Members of a | union or of Union[...]."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return _parts(node.left) + _parts(node.right)
    if isinstance(node, ast.Subscript) and _called(node.value) == "Union":
        return list(node.slice.elts) if isinstance(node.slice, ast.Tuple) else [node.slice]
    return [node]


def _is_none(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and node.value is None


def _empty(body: list[ast.stmt]) -> bool:
    """Nothing but a docstring, pass or an ellipsis."""
    return all(isinstance(x, ast.Pass) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and (x.value.value is ... or isinstance(x.value.value, str)) for x in body)


def _functions(tree: ast.AST) -> Iterator[tuple[ast.FunctionDef | ast.AsyncFunctionDef, ast.ClassDef | None]]:
    def walk(node, owner):
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield x, owner
                yield from walk(x, None)
            else:
                yield from walk(x, x if isinstance(x, ast.ClassDef) else owner)

    yield from walk(tree, None)


def complexity(function: ast.AST) -> int:
    """Cyclomatic complexity: one and each branch."""
    n = 1
    for x in ast.walk(function):
        n += isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension))
        n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
        n += len(x.cases) - 1 if isinstance(x, ast.Match) else 0
    return n


def python_issues(content: str) -> list[tuple[int, str, str, str]]:
    """(line, rule, severity, message) of one Python file, by line, then rule."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as e:
        return [(getattr(e, "lineno", None) or 1, "PY-SYNTAX-ERROR", "ERROR", "Can't be parsed")]
    out: set[tuple[int, str, str, str]] = set()
    say = lambda node, rule, what, severity="ERROR": out.add((node.lineno, rule, severity, what))
    try:
        for t in tokenize.generate_tokens(io.StringIO(content).readline):
            if t.type == tokenize.COMMENT and _TODO.search(t.string):
                out.add((t.start[0], "SABOTAGE-TODO-COMMENT", "ERROR", "Unfinished work"))
    except (tokenize.TokenError, IndentationError):
        pass
    annotations = []
    for x in ast.walk(tree):
        if isinstance(x, ast.AnnAssign):
            annotations.append(x.annotation)
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            args = [*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs, *filter(None, (x.args.vararg, x.args.kwarg))]
            annotations += [a.annotation for a in args if a.annotation] + ([x.returns] if x.returns else [])
        elif isinstance(x, ast.Assert):
            for y in ast.walk(x.test):
                if isinstance(y, ast.NamedExpr) or isinstance(y, ast.Call) and isinstance(y.func, ast.Attribute) and y.func.attr in _CALLS_THAT_CHANGE:
                    say(x, "PY-ASSERT-SIDE-EFFECT", "An assertion changes something")
        elif isinstance(x, ast.Raise):
            say(x, "PY-FORBIDDEN-RAISE", "An exception is raised")
        elif isinstance(x, ast.Call) and _called(x.func) in ("isinstance", "issubclass", "type") and len(x.args) > (_called(x.func) == "type") - 1 and x.args:
            say(x, "PY-FORBIDDEN-RTTI", "A type is asked for at run time")
        elif isinstance(x, ast.Call) and _called(x.func) in ("getattr", "setattr", "hasattr", "delattr") and len(x.args) > 1 and isinstance(x.args[1], ast.Constant):
            say(x, "PY-FORBIDDEN-STRING-MEMBER", "A member is named by text")
        elif isinstance(x, ast.BoolOp) and isinstance(x.op, ast.Or) and isinstance(x.values[-1], (ast.Constant, ast.List, ast.Dict)) and isinstance(x.values[0], ast.Name):
            say(x, "PY-FORBIDDEN-NONE-DEFAULT-FILL", "A missing value is filled in")
    for a in annotations:
        for n in _names(a):
            if _called(n) == "Any":
                say(a, "PY-FORBIDDEN-TYPING-ANY", "Any in an annotation")
            elif isinstance(n, ast.Name) and n.id == "object":
                say(a, "PY-FORBIDDEN-OBJECT-TYPE", "object in an annotation")
        for n in ast.walk(a):
            if len([p for p in _parts(n) if not _is_none(p)]) > 1:
                say(a, "PY-FORBIDDEN-NON-NONE-UNION", "A union of several types")
    for f, owner in _functions(tree):
        bases = {_called(b.value if isinstance(b, ast.Subscript) else b) for b in owner.bases} if owner else set()
        marks = {_called(d.func if isinstance(d, ast.Call) else d) for d in f.decorator_list}
        if _empty(f.body) and "Protocol" not in bases and not marks & {"overload", "abstractmethod"}:
            say(f, "SABOTAGE-EMPTY-FUNCTION", f"{f.name} does nothing")
        if _BACKDOOR.search(f.name):
            say(f, "PY-TEST-CODE-IN-PRODUCT", f"{f.name} serves tests")
        plain = [*f.args.posonlyargs, *f.args.args][: len(f.args.posonlyargs) + len(f.args.args) - len(f.args.defaults)]
        for a in plain:
            if a.annotation and any(map(_is_none, _parts(a.annotation))):
                out.add((a.lineno, "PY-REQUIRED-ARGUMENT-NULLABLE", "ERROR", f"{a.arg} is required and may be None"))
    return sorted(out)


def python_rules(files: DataFrame) -> DataFrame:
    """Issues of Python files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *x) for p, c in zip(part["path"], part["content"], strict=True) if c is not None for x in python_issues(c)]
            yield pd.DataFrame(rows, columns=["path", "line", "rule", "severity", "message"])

    return files.filter("endswith(path, '.py')").select("path", "content").mapInPandas(run, SCHEMA)


def functions(files: DataFrame) -> DataFrame:
    """(path, function, line, ccn) of Python files that can be parsed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, c in zip(part["path"], part["content"], strict=True):
                try:
                    rows += [(p, f.name, f.lineno, complexity(f)) for f, _ in _functions(ast.parse(c))] if c is not None else []
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "function", "line", "ccn"])

    return files.filter("endswith(path, '.py')").select("path", "content").mapInPandas(run, "path string, function string, line int, ccn int")


def complexity_issues(measured: DataFrame, allowed: DataFrame, threshold: int) -> DataFrame:
    """(path, function, ccn, baseline, rule): measured functions over the threshold against an allow-list (path, function, baseline)."""
    both = measured.groupBy("path", "function").agg(F.max("ccn").alias("ccn")).join(allowed, ["path", "function"], "full_outer")
    rule = (
        F.when(F.col("ccn").isNull() | (F.col("baseline").isNotNull() & (F.col("ccn") <= threshold)), "SRC-COMPLEXITY-ALLOWLIST-STALE")
        .when(F.col("baseline").isNull() & (F.col("ccn") > threshold), "SRC-COMPLEXITY")
        .when(F.col("ccn") > F.col("baseline"), "SRC-COMPLEXITY-RATCHET")
    )
    return both.select("path", "function", "ccn", "baseline", rule.alias("rule")).filter("rule IS NOT NULL")


def imports(files: DataFrame) -> DataFrame:
    """(path, line, module) of Python files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, c in zip(part["path"], part["content"], strict=True):
                try:
                    tree = ast.parse(c or "")
                except (SyntaxError, ValueError):
                    continue
                for x in ast.walk(tree):
                    if isinstance(x, ast.Import):
                        rows += [(p, x.lineno, a.name) for a in x.names]
                    elif isinstance(x, ast.ImportFrom) and x.module and not x.level:
                        rows.append((p, x.lineno, x.module))
            yield pd.DataFrame(rows, columns=["path", "line", "module"])

    return files.filter("endswith(path, '.py')").select("path", "content").mapInPandas(run, "path string, line int, module string")


def import_direction(found: DataFrame, tiers: DataFrame) -> DataFrame:
    """Imports from a module's tier to a higher number; tiers (module, tier) also hold for submodules, the longest name first."""
    module = F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", ".")
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda n: F.array_join(F.slice(F.split(c, r"\."), 1, n), "."))

    def with_tier(df: DataFrame, col: str, name: str) -> DataFrame:
        each = df.select("path", "line", "module", F.explode(prefixes(F.col(col))).alias("_p"))
        hit = each.join(tiers.select(F.col("module").alias("_p"), F.col("tier").alias(name)), "_p")
        return hit.groupBy("path", "line", "module").agg(F.max_by(name, F.length("_p")).alias(name))

    own = with_tier(found.withColumn("_own", module), "_own", "tier")
    to = with_tier(found, "module", "imported")
    rows = own.join(to, ["path", "line", "module"]).filter("tier < imported")
    return rows.select("path", "line", F.lit("PYSIM-IMPORT-DIRECTION").alias("rule"), F.lit("ERROR").alias("severity"), F.concat(F.lit("Imports a lower tier: "), "module").alias("message"))


# Patterns of C++ lines.
CPP_RULES = (
    ("CPP-FORBIDDEN-MALLOC", r"\b(?:malloc|calloc|realloc|free)\s*\("),
    ("CPP-FORBIDDEN-NEW", r"\bnew\s+[A-Za-z_]|\bdelete\b(?!\s*;)(?:\s*\[\])?\s+[A-Za-z_]"),
    ("CPP-FORBIDDEN-EXCEPTIONS", r"\b(?:throw|try|catch)\b"),
    ("CPP-FORBIDDEN-RTTI", r"\b(?:dynamic_cast|typeid)\b"),
    ("SABOTAGE-TODO-COMMENT", r"\b(?:TODO|FIXME|XXX|HACK)\b"),
    ("SABOTAGE-EMPTY-FUNCTION", r"\)\s*(?:const\s*)?(?:noexcept\s*)?\{\s*\}"),
)


def cpp_rules(files: DataFrame, namespace: str | None = None) -> DataFrame:
    """Issues of C++ files by line; comments count for unfinished work only. With a namespace, files without it too."""
    own = files.filter(F.col("path").rlike(r"\.(?:c|cc|cpp|h|hpp)$") & F.col("content").isNotNull())
    lines = own.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    code = F.regexp_replace(F.regexp_replace("text", r"//.*$", ""), r'"(?:\\.|[^"\\])*"', '""')
    hits = F.array(*(F.when((F.col("text") if "TODO" in p else code).rlike(p), F.lit(r)) for r, p in CPP_RULES))
    found = lines.select("path", (F.col("n") + 1).alias("line"), F.explode(F.array_compact(hits)).alias("rule"))
    if namespace:
        missing = own.filter(~F.col("content").rlike(rf"\bnamespace\s+{re.escape(namespace)}\b")).select("path", F.lit(1).alias("line"), F.lit("CPP-MISSING-NAMESPACE").alias("rule"))
        found = found.unionByName(missing)
    return found.select("path", "line", "rule", F.lit("ERROR").alias("severity"), F.col("rule").alias("message"))
