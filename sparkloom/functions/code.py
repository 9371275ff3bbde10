"""Python snippets as data: shape checks on the syntax tree, rewrites, and limited execution.

Trees and processes cannot be expressed in SQL, so these are Arrow-batched functions.  Execution runs untrusted text in a
separate interpreter with limits and is off unless asked for.
"""

from __future__ import annotations

import ast
import subprocess
import sys
import tempfile
import textwrap
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Limits:
    """What a snippet may use when it is run: modules, CPU seconds, bytes of memory and of one file, open files."""

    imports: tuple[str, ...] = ()
    seconds: int = 4
    memory: int = 512 << 20
    file: int = 1 << 20
    open_files: int = 32


UNSAFE_NAMES = ("eval", "exec", "open", "compile", "input", "__import__", "globals", "locals", "getattr", "setattr", "breakpoint", "exit", "quit")


def _tree(code: str | None):
    try:
        return ast.parse(textwrap.dedent(code or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def unsafe_reason(code: str | None, imports: tuple[str, ...] = ()) -> str | None:
    """Why a snippet must not be run; None if nothing speaks against it.  It may import the listed modules only."""
    tree = _tree(code)
    if tree is None:
        return "syntax"
    for node in ast.walk(tree):
        if isinstance(node, ast.Import) and any(a.name.split(".")[0] not in imports for a in node.names):
            return "import"
        if isinstance(node, ast.ImportFrom) and (node.level or (node.module or "").split(".")[0] not in imports):
            return "import"
        if isinstance(node, ast.Name) and node.id in UNSAFE_NAMES:
            return "name"
        if isinstance(node, ast.Attribute) and node.attr.startswith("__"):
            return "attribute"
    return None


def shape_reason(code: str | None) -> str | None:
    """None for exactly one plain top-level function with a return and no class, else the first thing that differs."""
    tree = _tree(code)
    if tree is None:
        return "syntax"
    body = [n for n in tree.body if not (isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant))]
    functions = [n for n in body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    rest = [n for n in body if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Import, ast.ImportFrom))]
    rules = [
        ("no_function", not functions), ("many_functions", len(functions) > 1), ("class", any(isinstance(n, ast.ClassDef) for n in body)), ("statements", bool(rest)),
        ("async", any(isinstance(n, ast.AsyncFunctionDef) for n in functions)), ("decorated", any(n.decorator_list for n in functions)),
        ("star_arguments", any(n.args.vararg or n.args.kwarg for n in functions)),
        ("generator", any(isinstance(x, (ast.Yield, ast.YieldFrom)) for n in functions for x in ast.walk(n))),
        ("no_return", not any(isinstance(x, ast.Return) and x.value is not None for n in functions for x in ast.walk(n))),
        ("global", any(isinstance(x, (ast.Global, ast.Nonlocal)) for x in ast.walk(tree))),
    ]
    return next((name for name, hit in rules if hit), None)


def tests_reason(name: str, tests: list[str] | None, least: int) -> str | None:
    """What is wrong with the tests of a function: too few, no Python, no assertion, or no call of the function."""
    if tests is None or len(tests) < least:
        return "few_tests"
    trees = [_tree(t) if isinstance(t, str) and t.strip() else None for t in tests]
    if any(t is None for t in trees):
        return "invalid_tests"
    nodes = [list(ast.walk(t)) for t in trees]
    if not all(any(isinstance(n, ast.Assert) for n in x) for x in nodes):
        return "test_without_assertion"
    called = {n.func.id for x in nodes for n in x if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return None if name in called else "function_not_called"


def exercise_reason(prompt: str | None, code: str | None, tests: list[str] | None, verified: bool | None, longest_prompt: int, longest_code: int, least_tests: int, imports: tuple[str, ...] = ()) -> str | None:
    """The first reason to leave out a programming exercise, None for a good one.

    In order: a missing part, lengths, the shape of the code, what it may not use, a function that the prompt does not name,
    its tests, and whether a run has confirmed it.
    """
    if not (prompt or "").strip() or not (code or "").strip():
        return "missing"
    if len(prompt) > longest_prompt:
        return "prompt_length"
    if len(code) > longest_code:
        return "code_length"
    if reason := shape_reason(code):
        return reason
    if reason := unsafe_reason(code, imports):
        return "unsafe_" + reason
    name = function_name(code)
    if name not in prompt:
        return "name_not_in_prompt"
    return tests_reason(name, tests, least_tests) or (None if verified else "not_verified")


def exercises(df: DataFrame, key: str, prompt: str, code: str, tests: str, verified: str, longest_prompt: int, longest_code: int, least_tests: int, imports: tuple[str, ...] = ()) -> DataFrame:
    """(key, reason) of each exercise, in one Arrow pass."""

    def run(frames):
        for f in frames:
            made = [exercise_reason(p, c, list(t) if t is not None else None, v, longest_prompt, longest_code, least_tests, imports) for p, c, t, v in zip(*(f.iloc[:, i] for i in range(1, 5)))]
            yield pd.DataFrame({key: f.iloc[:, 0], "reason": pd.Series(made, dtype=object)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt, code, tests, verified).mapInPandas(run, f"{key} {kind}, reason string")


def function_name(code: str | None) -> str | None:
    tree = _tree(code)
    return next((n.name for n in tree.body if isinstance(n, ast.FunctionDef)), None) if tree else None


def function_body(code: str | None) -> str | None:
    """The source of the first function's body without its doc string, without outer indentation."""
    tree = _tree(code)
    f = next((n for n in tree.body if isinstance(n, ast.FunctionDef)), None) if tree else None
    if f is None:
        return None
    body = f.body[1:] if isinstance(f.body[0], ast.Expr) and isinstance(f.body[0].value, ast.Constant) and len(f.body) > 1 else f.body
    lines = textwrap.dedent(code).split("\n")
    return textwrap.dedent("\n".join(lines[body[0].lineno - 1 : body[-1].end_lineno]))


def with_signature(signature: str, body: str | None) -> str | None:
    """A function from a header line and a body of any indentation."""
    return None if body is None else signature.rstrip().rstrip(":") + ":\n" + textwrap.indent(textwrap.dedent(body).strip("\n"), "    ")


def repaired(code: str | None) -> str | None:
    """The text, dedented or with its tail indented once if only that makes it parse; None if nothing does."""
    if code is None:
        return None
    head, _, tail = code.partition("\n")
    for option in (code, textwrap.dedent(code), head.strip() + "\n" + textwrap.indent(textwrap.dedent(tail), "    ")):
        if _tree_exact(option):
            return option
    return None


def _tree_exact(code: str) -> bool:
    try:
        ast.parse(code)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def run_limited(code: str, tests: list[str], limits: Limits = Limits()) -> str:
    """passed, failed, timeout, unsafe or invalid_tests; a separate isolated interpreter in an empty folder of its own.

    The limits are set by the new interpreter itself before the snippet is compiled, so nothing runs between fork and start in
    a worker that may have threads.
    """
    if not tests or any(not isinstance(t, str) or not _tree_exact(t) for t in tests):
        return "invalid_tests"
    if unsafe_reason(code, limits.imports):
        return "unsafe"
    tops = [("CPU", limits.seconds), ("AS", limits.memory), ("FSIZE", limits.file), ("NOFILE", limits.open_files)]
    guard = "import resource as _r\n" + "\n".join(f"_r.setrlimit(_r.RLIMIT_{k}, ({n}, {n}))" for k, n in tops) + "\ndel _r\n"
    body = "\n".join([textwrap.dedent(code), *tests])
    with tempfile.TemporaryDirectory() as empty:
        try:
            done = subprocess.run(
                [sys.executable, "-I", "-S", "-c", guard + f"exec(compile({body!r}, 'snippet', 'exec'), {{'__name__': 'snippet'}})"],
                timeout=limits.seconds + 2, capture_output=True, env={}, cwd=empty, start_new_session=True,
            )
        except subprocess.TimeoutExpired:
            return "timeout"
    return "passed" if done.returncode == 0 else "failed"


def code_checks(df: DataFrame, key: str, code: str, imports: tuple[str, ...] = ()) -> DataFrame:
    """(key, unsafe, shape, name, body) of each snippet, in one Arrow pass."""

    def run(frames):
        for f in frames:
            texts = f.iloc[:, 1]
            yield pd.DataFrame({key: f.iloc[:, 0], **{n: texts.map(g).astype(object).where(lambda s: s.notna(), None) for n, g in (("unsafe", lambda c: unsafe_reason(c, imports)), ("shape", shape_reason), ("name", function_name), ("body", function_body))}})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, code).mapInPandas(run, f"{key} {kind}, unsafe string, shape string, name string, body string")


def execute(df: DataFrame, key: str, code: str, tests: str, rows_per_task: int = 200, limits: Limits = Limits()) -> DataFrame:
    """(key, status) of each snippet run against its tests (array of strings); many small tasks, as each row is a process."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f.iloc[:, 0], "status": [run_limited(c or "", list(t) if t is not None else [], limits) for c, t in zip(f.iloc[:, 1], f.iloc[:, 2])]})

    kind = df.schema[key].dataType.simpleString()
    tasks = max(1, -(-df.count() // rows_per_task))
    return df.select(key, code, tests).repartition(tasks).mapInPandas(run, f"{key} {kind}, status string")


def reward(df: DataFrame, key: str, signature: str, body: str, tests: str, limits: Limits = Limits()) -> DataFrame:
    """(key, reward): 1.0 if the body under its signature passes, else 0.0."""
    wrap = F.pandas_udf(lambda s, b: pd.Series([with_signature(x, y) if x else None for x, y in zip(s, b)]), "string")
    whole = df.select(key, wrap(signature, body).alias("_code"), F.col(tests).alias("_tests"))
    return execute(whole, key, "_code", "_tests", limits=limits).select(key, F.when(F.col("status") == "passed", 1.0).otherwise(0.0).alias("reward"))
