"""Source files to code nodes: the one place that needs Python's parser.

Each file is parsed once.  A node row carries its source segment and a list of
syntax events, and every metric afterwards is a DataFrame expression over them.
"""

from __future__ import annotations

import ast
import contextlib
import gc
import itertools
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = (
    "struct<kind:string,name:string,depth:int,n:int,params:int,"
    "documented:boolean,decorated:boolean,singleton:boolean>"
)
PARSED = (
    "path string, code_id string, kind string, name string, parent_id string, "
    f"line int, code string, events array<{EVENT}>"
)
_EVENT_ARROW = pa.struct(
    [
        ("kind", pa.string()),
        ("name", pa.string()),
        ("depth", pa.int32()),
        ("n", pa.int32()),
        ("params", pa.int32()),
        ("documented", pa.bool_()),
        ("decorated", pa.bool_()),
        ("singleton", pa.bool_()),
    ]
)
_ROW_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("code_id", pa.string()),
        ("kind", pa.string()),
        ("name", pa.string()),
        ("parent_id", pa.string()),
        ("line", pa.int32()),
        ("code", pa.string()),
        ("events", pa.list_(_EVENT_ARROW)),
    ]
)
_BRANCH = (ast.If, ast.While, ast.For, ast.ExceptHandler)
_SOURCES = (
    *_BRANCH,
    ast.BoolOp,
    ast.FunctionDef,
    ast.ClassDef,
    ast.Import,
    ast.ImportFrom,
)
_LEAVES = {ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Break, ast.Continue}
# Expressions, and statements that hold nothing else.
_EXPRESSIONS = (
    ast.expr,
    ast.Expr,
    ast.Assign,
    ast.AugAssign,
    ast.AnnAssign,
    ast.Return,
    ast.Delete,
    ast.Raise,
    ast.Assert,
)
# Fields, in order, that hold statements, and the nodes that can have them.
_BLOCKS = ("cases", "body", "handlers", "orelse", "finalbody")
_NESTING = (
    ast.ClassDef,
    ast.FunctionDef,
    ast.AsyncFunctionDef,
    ast.If,
    ast.For,
    ast.AsyncFor,
    ast.While,
    ast.With,
    ast.AsyncWith,
    ast.Try,
    ast.TryStar,
    ast.ExceptHandler,
    ast.Match,
    ast.match_case,
)
_ROWS_PER_BATCH = 512


def _event(kind: str, name: str | None = None, depth: int = 0, n: int = 0, **more) -> dict:
    return {"kind": kind, "name": name, "depth": depth, "n": n, **more}


def _is_singleton(node: ast.ClassDef) -> bool:
    for item in node.body:
        if isinstance(item, ast.FunctionDef) and item.name == "__new__":
            return True
        if isinstance(item, ast.Assign):
            if any(getattr(target, "id", None) == "_instance" for target in item.targets):
                return True
    return False


def _events_of(node: ast.AST, own_decorators: bool) -> Iterator[dict]:
    """Events of a single syntax node."""
    if isinstance(node, _BRANCH):
        yield _event("branch")
    elif isinstance(node, ast.BoolOp):
        yield _event("bool", n=len(node.values) - 1)
    elif isinstance(node, (ast.FunctionDef, ast.ClassDef)):
        facts = {
            "documented": bool(ast.get_docstring(node)),
            "decorated": own_decorators and bool(node.decorator_list),
        }
        if isinstance(node, ast.FunctionDef):
            params = len(node.args.args)
            yield _event("function", node.name, n=len(node.body), params=params, **facts)
        else:
            methods = sum(isinstance(item, ast.FunctionDef) for item in node.body)
            single = _is_singleton(node)
            yield _event("class", node.name, n=methods, singleton=single, **facts)
    elif isinstance(node, ast.Import):
        for alias in node.names:
            yield _event("import", alias.name.partition(".")[0])
    elif isinstance(node, ast.ImportFrom) and node.module:
        yield _event("import", node.module.partition(".")[0])


class _Scope:
    """A file, class or function on the way down, and the events inside it."""

    def __init__(self, node: ast.AST, depth: int = 0, level: int = 0):
        self.node, self.depth, self.level = node, depth, level
        self.found: list[tuple[int, dict]] = []

    def add(self, event: dict, depth: int, level: int) -> None:
        self.found.append((level - self.level, {**event, "depth": depth - self.depth}))

    def events(self) -> list[dict]:
        """Events level by level, left to right within a level."""
        return [event for _, event in sorted(self.found, key=lambda pair: pair[0])]


def _scopes(tree: ast.Module) -> Iterator[ast.AST]:
    """The file and its classes, which stand in blocks of statements only, in order."""
    waiting: list[ast.AST] = [tree]
    while waiting:
        node = waiting.pop()
        if node is tree or isinstance(node, ast.ClassDef):
            yield node
        blocks = [getattr(node, name, None) for name in _BLOCKS]
        inner = [child for block in blocks if type(block) is list for child in block]
        waiting.extend(child for child in reversed(inner) if isinstance(child, _NESTING))


def _operators_upto(lines: list[bytes]) -> list[int]:
    """How many of the first lines may hold a boolean operator, by number of lines."""
    return [0, *itertools.accumulate(b"and" in line or b"or" in line for line in lines)]


def _told(node: ast.AST, upto: list[int]) -> list[ast.AST]:
    """The children that may tell an event, or have a descendant that may."""
    found = []
    for name in node._fields:
        value = getattr(node, name, None)
        for child in value if type(value) is list else (value,):
            if isinstance(child, _EXPRESSIONS):
                first, last = child.lineno, child.end_lineno
            elif isinstance(child, ast.arguments):  # has no lines of its own
                first, last = node.lineno, node.body[0].lineno if type(node.body) is list else node.end_lineno
            elif isinstance(child, ast.AST) and type(child) not in _LEAVES:
                found.append(child)
                continue
            else:
                continue
            if upto[first - 1] < upto[last]:
                found.append(child)
    return found


def syntax_events(tree: ast.Module, lines: list[bytes]) -> dict[ast.AST, list[dict]]:
    """Events of the file and of every class, method and module-level function.

    One walk over the tree serves all of them: an event goes to each enclosing
    scope, its depth counted in branches from there.  Decorators lie outside the
    segment of the node they decorate.  Boolean operators are all that expressions can
    tell, so those on ``lines`` without a trace of one are passed by.
    """
    upto = _operators_upto(lines)
    top = _Scope(tree)
    scopes = [top]
    # (node, enclosing branches, level, scopes around it, parent)
    waiting: list[tuple] = [(tree, 0, 0, (top,), None)]
    while waiting:
        node, depth, level, around, parent = waiting.pop()
        outer, scope = around, None
        if isinstance(node, ast.ClassDef) or (
            isinstance(node, ast.FunctionDef)
            and isinstance(parent, (ast.ClassDef, ast.Module))
        ):
            scope = _Scope(node, depth, level)
            scopes.append(scope)
            around = (*around, scope)
        if isinstance(node, _SOURCES):
            for event in _events_of(node, own_decorators=True):
                for each in outer:
                    each.add(event, depth, level)
                if scope is not None:
                    scope.add({**event, "decorated": False}, depth, level)
        inner = depth + isinstance(node, _BRANCH)
        outside = node.decorator_list if scope is not None else ()
        for child in reversed(_told(node, upto)):
            scopes_here = outer if child in outside else around
            waiting.append((child, inner, level + 1, scopes_here, node))
    return {scope.node: scope.events() for scope in scopes}


def _segment(lines: list[bytes], node: ast.stmt) -> str:
    """Source of a node; columns of the parser count UTF-8 bytes."""
    taken = lines[node.lineno - 1 : node.end_lineno]
    taken[-1] = taken[-1][: node.end_col_offset]
    taken[0] = taken[0][node.col_offset :]
    return b"\n".join(taken).decode()


def _file_rows(path: str, content: str | None, qualified: bool, told: bool = True) -> Iterator[dict]:
    try:
        if content is None:
            raise ValueError("not valid UTF-8")
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        yield {"path": path, "kind": "error", "name": str(error)}
        return
    lines = content.encode().split(b"\n")
    events = syntax_events(tree, lines) if told else dict.fromkeys(_scopes(tree))
    inside = f"{path}::" if qualified else ""

    def row(kind: str, name: str, parent: str, node: ast.stmt) -> dict:
        return {
            "path": path,
            "code_id": f"{kind}:{inside}{name}",
            "kind": kind,
            "name": name,
            "parent_id": parent,
            "line": node.lineno,
            "code": _segment(lines, node),
            "events": events.get(node),
        }

    base = os.path.basename(path)
    file_id = f"file:{path if qualified else base}"
    yield {
        "path": path,
        "code_id": file_id,
        "kind": "file",
        "name": base,
        "parent_id": None,
        "line": 1,
        "code": content,
        "events": events[tree],
    }
    for node in events:
        if isinstance(node, ast.ClassDef):
            made = row("class", node.name, file_id, node)
            yield made
            for item in node.body:
                if isinstance(item, ast.FunctionDef):
                    yield row("method", f"{node.name}.{item.name}", made["code_id"], item)
    for node in tree.body:
        if isinstance(node, ast.FunctionDef):
            yield row("func", node.name, file_id, node)


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """No search for reference cycles: a tree has none and consists of many small objects."""
    running = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if running:
            gc.enable()


def parse_files(
    files: DataFrame,
    qualified_ids: bool = False,
    partitions: int | None = None,
    events: bool = True,
) -> DataFrame:
    """Node rows of ``(path, content)`` files, and one ``error`` row per unreadable file.

    Ids use file base names, so equal names in different folders collide;
    ``qualified_ids`` keys them by the full path.  Parsing costs far more than
    moving the text, so files are first spread evenly over ``partitions`` (the
    session's shuffle partitions unless given).  Without ``events`` the syntax trees are
    not walked for them and the column is null; metrics need it, hashes of code do not.
    """
    spark = files.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                with _uncollected():
                    rows.extend(_file_rows(path.as_py(), content.as_py(), qualified_ids, events))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROW_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW_ARROW)

    text = files.select("path", F.regexp_replace("content", "\r\n?", "\n").alias("content"))
    return text.repartition(partitions, "path").mapInArrow(parse, PARSED)


def code_nodes(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("kind") != "error")


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("kind") == "error").select("path", F.col("name").alias("error"))
