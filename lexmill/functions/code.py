"""Python source columns: structure, signature text, compacted literals and canonical form.

Each is one Arrow function over a batch of sources; a source that doesn't parse has a
defined value. Trees are walked with an explicit stack, so deep nesting can't overflow it.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _list_of(*names: str) -> T.ArrayType:
    whole = {"line", "depth"}
    return T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in whole else T.StringType()) for n in names]))


_WORDS, _DEPTHS = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.IntegerType())
#: A type and no DDL string, since workers load this module without a session to parse one.
METADATA = T.StructType(
    [
        T.StructField("parsed", T.BooleanType()),
        T.StructField("functions", _list_of("name", "line", "class")),
        T.StructField("classes", _list_of("name", "line")),
        T.StructField("imports", _list_of("name", "line")),
        T.StructField("calls", _list_of("name", "line", "function", "class")),
        T.StructField("identifiers", _WORDS),
        T.StructField("recursive_functions", _WORDS),
        T.StructField("loops", _list_of("type", "line", "depth", "function", "class")),
        T.StructField("loop_count", T.IntegerType()),
        T.StructField("max_loop_depth", T.IntegerType()),
        T.StructField("class_loop_depths", _DEPTHS),
        T.StructField("function_loop_depths", _DEPTHS),
    ]
)
MOST_IDENTIFIERS = 300
_LOOPS = {ast.For: "for", ast.AsyncFor: "async_for", ast.While: "while"}
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse(code: str | None) -> ast.AST | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code or "")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None


def dotted(node: ast.AST) -> str | None:
    """a.b.c of names and attributes; what follows anything else stands alone."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts)) or None


def walk(tree: ast.AST) -> Iterator[tuple[ast.AST, str | None, str | None, int]]:
    """Nodes in pre-order with the names of the innermost function and class and the loop depth around each.

    A definition's decorators and defaults count as inside it. Depth goes on through definitions.
    """
    stack: list[tuple[ast.AST, str | None, str | None, int]] = [(tree, None, None, 0)]
    while stack:
        node, function, cls, depth = stack.pop()
        yield node, function, cls, depth
        if isinstance(node, _DEFS):
            function = node.name
        elif isinstance(node, ast.ClassDef):
            cls = node.name
        depth += type(node) in _LOOPS
        stack += [(child, function, cls, depth) for child in reversed(list(ast.iter_child_nodes(node)))]


def describe(code: str | None) -> dict:
    """The structural record of one source."""
    out: dict = {k: [] for k in ("functions", "classes", "imports", "calls", "loops")}
    tree, names, recursive = parse(code), set(), set()
    if tree is None:
        names = set(re.findall(r"\b[A-Za-z_][A-Za-z0-9_.]*\b", code or ""))
    for node, function, cls, depth in walk(tree) if tree is not None else ():
        line = getattr(node, "lineno", None)
        if isinstance(node, _DEFS):
            out["functions"].append({"name": node.name, "line": line, "class": cls})
        elif isinstance(node, ast.ClassDef):
            out["classes"].append({"name": node.name, "line": line})
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            prefix = f"{node.module}." if isinstance(node, ast.ImportFrom) and node.module else ""
            out["imports"] += [{"name": prefix + a.name, "line": line} for a in node.names]
        elif type(node) in _LOOPS:
            out["loops"].append({"type": _LOOPS[type(node)], "line": line, "depth": depth + 1, "function": function, "class": cls})
        elif isinstance(node, ast.Call) and (name := dotted(node.func)):
            out["calls"].append({"name": name, "line": line, "function": function, "class": cls})
            if function and name.rpartition(".")[2] == function:
                recursive.add(function)
        elif isinstance(node, (ast.Name, ast.Attribute)) and (name := dotted(node)):
            names.add(name)

    def deepest(scope: str) -> dict:
        held: dict[str, int] = {}
        for x in out["loops"]:
            if x[scope]:
                held[x[scope]] = max(x["depth"], held.get(x[scope], 0))
        return held

    return {"parsed": tree is not None, **out, "identifiers": sorted(names)[:MOST_IDENTIFIERS], "recursive_functions": sorted(recursive), "loop_count": len(out["loops"]), "max_loop_depth": max((x["depth"] for x in out["loops"]), default=0), "class_loop_depths": deepest("class"), "function_loop_depths": deepest("function")}


def words_of(name: str) -> str:
    return " ".join(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).replace("_", " ").lower().split())


def _first(names: list[str], most: int) -> str:
    return ", ".join(list(dict.fromkeys(w for w in map(words_of, names) if w))[:most])


# What each kind of node is called in a signature.
STRUCTURES = {
    "FunctionDef": "function", "AsyncFunctionDef": "async function", "ClassDef": "class", "For": "for loop",
    "AsyncFor": "async for loop", "While": "while loop", "If": "conditional", "ListComp": "list comprehension",
    "SetComp": "set comprehension", "DictComp": "dictionary comprehension", "GeneratorExp": "generator expression",
    "Lambda": "lambda", "Try": "exception handling", "With": "context manager",
}
# Sections in order, with the most names each shows.
SECTIONS = {"classes": 10, "functions": 15, "parameters": 20, "imports": 15, "calls": 30, "attributes": 20, "identifiers": 30}


def signature(code: str | None) -> str:
    """One line on a source's names, structure and operators. Recursive functions stand in alphabetical order."""
    tree = parse(code)
    if tree is None:
        return "unparsed python code"
    names: dict[str, list[str]] = {k: [] for k in SECTIONS}
    shapes: Counter = Counter()
    operators: Counter = Counter()
    recursive = set()
    for node, function, _, _ in walk(tree):
        kind = type(node).__name__
        if kind in STRUCTURES:
            shapes[STRUCTURES[kind]] += 1
        if isinstance(node, _DEFS):
            names["functions"].append(node.name)
            names["parameters"] += [a.arg for a in node.args.args]
        elif kind == "ClassDef":
            names["classes"].append(node.name)
        elif kind == "Import":
            names["imports"] += [a.name for a in node.names]
        elif kind == "ImportFrom":
            names["imports"] += [x for x in (node.module, *(a.name for a in node.names)) if x]
        elif kind == "Call":
            called = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
            if called:
                names["calls"].append(called)
                if called == function:
                    recursive.add(called)
        elif kind == "Attribute":
            names["attributes"].append(node.attr)
        elif kind == "Name":
            names["identifiers"].append(node.id)
        elif kind == "BinOp":
            operators[type(node.op).__name__] += 1
        elif kind == "Compare":
            operators.update(type(op).__name__ for op in node.ops)
    parts = [(k, _first(v, SECTIONS[k])) for k, v in names.items()]
    parts.append(("structure", ", ".join(f"{k} x{n}" for k, n in shapes.items())))
    parts.append(("operators", ", ".join(f"{words_of(k)} x{n}" for k, n in operators.items())))
    parts.append(("recursive functions", _first(sorted(recursive), 10)))
    return " | ".join(f"{k}: {v}" for k, v in parts if v) or "simple python code"


#: Longest literals that stay, and what is shown of longer ones.
ELEMENTS, SHOWN_ELEMENTS, CHARS, SHOWN_CHARS = 50, 8, 1000, 120


def compact(code: str | None) -> str | None:
    """The source formatted anew with long lists, tuples and strings cut short; unparsable ones stay as they are."""
    if code is None or (tree := parse(code)) is None:
        return code
    try:
        for node in list(ast.walk(tree)):
            if isinstance(node, (ast.List, ast.Tuple)) and len(node.elts) > ELEMENTS:
                kind = type(node).__name__.upper()
                node.elts = [*node.elts[:SHOWN_ELEMENTS], ast.Constant(f"<LONG_{kind}:{len(node.elts)}_ITEMS>")]
                node.ctx = ast.Load()
            elif isinstance(node, ast.Constant) and isinstance(node.value, str) and len(node.value) > CHARS:
                node.value = f"{node.value[:SHOWN_CHARS]}...<LONG_STRING:{len(node.value)}_CHARS>"
        return ast.unparse(ast.fix_missing_locations(tree))
    except (RecursionError, ValueError):
        return code


def canonical(code: str | None) -> str:
    """Equal for sources with equal syntax trees; otherwise the text with white space collapsed."""
    tree = parse(code)
    try:
        return ast.dump(tree) if tree is not None else " ".join((code or "").split())
    except RecursionError:
        return " ".join((code or "").split())


@F.pandas_udf(METADATA)
def metadata(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([describe(x) for x in code])


@F.pandas_udf(T.StringType())
def code_signature(code: pd.Series) -> pd.Series:
    return code.map(signature)


@F.pandas_udf(T.StringType())
def compact_literals(code: pd.Series) -> pd.Series:
    return pd.Series([compact(x) for x in code])


@F.pandas_udf(T.StringType())
def canonical_code(code: pd.Series) -> pd.Series:
    return pd.Series([canonical(x) for x in code])


# Results only depend on the code; said to vary, these are evaluated once a row, and not again for each filter on what they return.
metadata = metadata.asNondeterministic()
canonical_code = canonical_code.asNondeterministic()


def code_fingerprint(code: Column) -> Column:
    return F.sha2(canonical_code(code), 256)
