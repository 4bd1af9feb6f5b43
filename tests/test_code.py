"""Golden snippets for the code metrics, each worked out by hand."""

import ast
import textwrap

import pytest
from pyspark.sql import functions as F
from tallyglass.operators import code_metrics, graph
from tallyglass.operators.code_nodes import code_nodes, parse_errors, parse_files, syntax_events


def analyse(spark, *sources, qualified=False):
    files = spark.createDataFrame(
        [(p, textwrap.dedent(c).lstrip("\n") if c is not None else None) for p, c in sources],
        "path string, content string",
    )
    parsed = parse_files(files, qualified_ids=qualified)
    return code_metrics.with_metrics(code_nodes(parsed)), parse_errors(parsed)


def by_id(df):
    return {r.code_id: r for r in df.collect()}


def one_file(spark, code):
    return by_id(analyse(spark, ("shop.py", code))[0])


def test_one_branch_counts_once(spark):
    nodes = one_file(
        spark,
        """
        def price(order, *, gift=False):
            total = sum(order)
            while total > 100:
                total -= 5
            return total
        """,
    )
    assert (nodes["func:price"].cyclomatic, nodes["func:price"].cognitive) == (2, 1)


def test_security_messages_in_order(spark):
    # The order of the calls in the text does not matter.
    nodes = one_file(
        spark,
        """
        def restore(blob, plan):
            state = pickle.loads(blob)
            os.system(plan.command)
            exec(plan.setup, state)
            return eval(plan.result, state)
        """,
    )
    assert nodes["func:restore"].security_issues == [
        "Use of eval() is dangerous",
        "Use of exec() is dangerous",
        "Pickle deserialization can be unsafe",
        "os.system() can be vulnerable to injection",
    ]


def test_parameters_and_nesting(spark):
    nodes = one_file(
        spark,
        """
        def ship(order, address, carrier, weight, insured, express):
            if order:
                while weight:
                    for parcel in order:
                        weight -= parcel
        """,
    )
    node = nodes["func:ship"]
    assert node.code_smells == ["Function 'ship' has too many parameters (6)"]
    # One each, and one more for every level of nesting.
    assert (node.cyclomatic, node.cognitive) == (1 + 3, 1 + 2 + 3)


def test_a_call_of_itself_is_no_edge(spark):
    measured, _ = analyse(
        spark,
        (
            "tree.py",
            """
            class Node:
                def depth(self):
                    return 1 + max((c.depth() for c in self.children), default=0)

            def walk(node):
                for child in node.children:
                    walk(child)
            """,
        ),
    )
    assert set(by_id(measured)) == {"file:tree.py", "class:Node", "method:Node.depth", "func:walk"}
    assert graph.contains_edges(measured).count() == 3
    assert graph.call_edges(measured).count() == 0


def test_structure_rules(spark):
    nodes = by_id(
        analyse(
            spark,
            (
                "a.py",
                """
                import os, json.decoder
                from x.y import z

                def chain(a, b):
                    if a and b or a:
                        pass
                    elif a:
                        pass
                    try:
                        pass
                    except ValueError:
                        if b:
                            pass

                async def never_a_node():
                    for i in []:
                        pass

                @decorate(1 if 2 else 3)
                class Outer:
                    _instance = None

                    @staticmethod
                    def create_one(x):
                        return [y for y in x if y]

                    class Inner:
                        def __new__(cls):
                            return 1
                """,
            ),
        )[0]
    )
    assert set(nodes) == {
        "file:a.py",
        "func:chain",
        "class:Outer",
        "method:Outer.create_one",
        "class:Inner",
        "method:Inner.__new__",
    }
    chain = nodes["func:chain"]
    # if, elif, except, if + two boolean operators
    assert chain.cyclomatic == 1 + 4 + 2
    # if 1, elif 2, except 1, inner if 2, booleans 2
    assert chain.cognitive == 8
    outer = nodes["class:Outer"]
    assert sorted(outer.design_patterns) == ["Decorator", "Factory", "Singleton"]
    assert outer.code.startswith("class Outer")
    assert nodes["method:Outer.create_one"].code.startswith("def create_one")
    assert nodes["method:Outer.create_one"].doc_score == 0.0
    assert nodes["class:Inner"].design_patterns == ["Singleton"]
    smells = nodes["file:a.py"].code_smells
    assert smells == [f"Possibly unused import: {n}" for n in ("os", "json")]


def test_empty_and_unreadable_files(spark):
    measured, errors = analyse(
        spark, ("empty.py", ""), ("bad.py", "def ("), ("binary.py", None), ("null.py", "a\0")
    )
    empty = by_id(measured)["file:empty.py"]
    assert (empty.loc, empty.cyclomatic, empty.maintainability) == (0, 1, 100.0)
    assert {r.path for r in errors.collect()} == {"bad.py", "binary.py", "null.py"}


def test_line_ends_and_unicode_segments(spark):
    source = "# é\r\nclass Ü:\r\n    def ñ(self): return 'é'  # x\r\n"
    measured, _ = analyse(spark, ("dir/u.py", source))
    nodes = by_id(measured)
    assert nodes["method:Ü.ñ"].code == "def ñ(self): return 'é'"
    assert nodes["file:u.py"].code == source.replace("\r\n", "\n")
    assert nodes["file:u.py"].loc == 2


def test_colliding_names_keep_the_last_path(spark):
    sources = [("a/m.py", "def f():\n    return 1"), ("b/m.py", "def f():\n    return 2")]
    latest = by_id(graph.node_latest(analyse(spark, *sources)[0]))
    assert latest["func:f"].path == "b/m.py"
    assert len(latest) == 2
    apart = graph.node_latest(analyse(spark, *sources, qualified=True)[0])
    assert apart.count() == 4


def test_calls_reach_every_callee_of_the_short_name(spark):
    measured, _ = analyse(
        spark,
        (
            "a.py",
            """
            def run(x):
                return helper (x) + xhelper(x)

            def helper(x):
                return x

            class A:
                def helper(self):
                    return 1
            """,
        ),
    )
    edges = {(r.src, r.dst) for r in graph.call_edges(measured).collect()}
    assert edges == {
        ("func:run", "func:helper"),
        ("func:run", "method:A.helper"),
        # a definition reads like a call of its own short name
        ("func:helper", "method:A.helper"),
        ("method:A.helper", "func:helper"),
    }


def test_changes_and_test_results(spark):
    old, _ = analyse(spark, ("a.py", "def f():\n    return 1\ndef g():\n    return 1"))
    new, _ = analyse(spark, ("a.py", "def f():\n    return 2\ndef g():\n    return 1"))
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    changes = graph.node_changes(old, new, at, "fix")
    assert {r.code_id for r in changes.collect()} == {"file:a.py", "func:f"}
    assert graph.apply_changes(old, new).count() == 3
    results = spark.createDataFrame(
        [("func:f", True), ("func:g", False)], "node_id string, passed boolean"
    )
    kept = graph.valid_test_results(results, changes).collect()
    assert [r.node_id for r in kept] == ["func:g"]
    totals = graph.test_totals(graph.test_rollup(results)).first()
    assert (totals.total, totals.passed, totals.failed, totals.coverage) == (2, 1, 1, 0.5)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("éeval(x)", []),
        ("EVAL (x)", ["Use of eval() is dangerous"]),
        ("medieval(x)", []),
        ("paſſword = 'x'", ["Hardcoded credentials detected"]),
        ("toKen = \"x\"", ["Hardcoded credentials detected"]),
        ("key = 'a b'", ["Hardcoded credentials detected"]),
        ("key = 'a\nb'", []),
        ("subprocess.run(x, shell=True)", ["Shell injection vulnerability possible"]),
    ],
)
def test_security_unicode(spark, text, expected):
    from tallyglass.functions.text import security_issues

    row = spark.createDataFrame([(text,)], "t string").select(security_issues(F.col("t"))).first()
    assert row[0] == expected


def test_calls_are_found_once(spark):
    """With more names than a lookup takes, the calls are read several times, their code is not."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def source(name):
        seen.add(1)
        return f"def {name}():\n    fn_7()\n"

    name = F.concat(F.lit("fn_"), F.col("id"))
    nodes = spark.range(100_001).select(
        F.concat(F.lit("func:"), name).alias("code_id"), F.lit("func").alias("kind"), name.alias("name"), source(name).alias("code")
    )
    edges = graph.call_edges(nodes)
    assert edges.where("dst = 'func:fn_7'").count() == edges.count() == 100_000
    assert seen.value == 100_001


def test_every_boolean_operator_is_told():
    """Passing by what cannot hold one loses none, wherever it stands."""
    source = """import os, json
@wrap(a or b)
def one(x=c and d, *, y: (e or f) = 1) -> (g and h):
    '''Doc.'''
    if 1or 2:
        z = [i for i in range(9) if i and not i % 2]
    elif x: z = lambda q=r or s: t and u
    while v \\
            and w: pass
    with open(j or k) as n, m: return f"{o or
        p}"
    match x:
        case 1 if y or z: assert a, b and c
    try: raise d or e
    except (f or g): del h[i and j]
class Two(k or l, meta=m and n):
    o: p or q = r
    def three(self): return [
        s,
        t and u and v,
    ]
"""
    tree = ast.parse(source)
    events = syntax_events(tree, source.encode().split(b"\n"))
    for scope in events:
        inside = [n for n in ast.walk(scope) if isinstance(n, ast.BoolOp)]
        outside = [n for d in getattr(scope, "decorator_list", ()) for n in ast.walk(d) if isinstance(n, ast.BoolOp)]
        told = sum(e["n"] for e in events[scope] if e["kind"] == "bool")
        assert told == sum(len(n.values) - 1 for n in inside) - sum(len(n.values) - 1 for n in outside)
    assert sum(e["n"] for e in events[tree] if e["kind"] == "bool") == 21


def test_nodes_without_events_are_the_same_nodes(spark):
    code = """import os
if os.name:
    class A:
        def m(self): return 1 and 2
else:
    class B:
        class C: pass
def f():
    try:
        class D: pass
    except* OSError:
        class E: pass
    finally:
        async def g():
            match f:
                case 1:
                    class F: pass
class A:
    def m(self): pass
"""
    files = spark.createDataFrame([("/r/a.py", code), ("/r/b.py", "def ("), ("/r/c.py", None)], "path string, content string")
    plain, bare = parse_files(files), parse_files(files, events=False)
    assert sorted(plain.drop("events").collect(), key=str) == sorted(bare.drop("events").collect(), key=str)
    assert bare.where("events IS NOT NULL").count() == 0 and bare.where("kind = 'class'").count() == 7


def test_only_changes_with_results_are_looked_up(spark, monkeypatch):
    asked = []
    look_up = graph.lookup_join
    monkeypatch.setattr(graph, "lookup_join", lambda l, r, *a: asked.append(r.count()) or look_up(l, r, *a))
    results = spark.createDataFrame([("func:1", True), ("func:2", False), (None, True), ("func:2", True)], "node_id string, passed boolean")
    changes = spark.range(2, 500).select(F.concat(F.lit("func:"), F.col("id")).alias("code_id"))
    kept = graph.valid_test_results(results, changes).collect()
    assert sorted((str(r.node_id), r.passed) for r in kept) == [("None", True), ("func:1", True)]
    assert asked == [1]
