"""Metrics of code nodes, as expressions over source text and syntax events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

LONG_FUNCTION, MANY_PARAMS, LARGE_CLASS = 50, 5, 20


def _of_kind(*kinds: str) -> Column:
    return F.filter("events", lambda e: e["kind"].isin(*kinds))


def _total(events: Column, amount) -> Column:
    return F.aggregate(events, F.lit(0), lambda acc, e: acc + amount(e))


def cyclomatic() -> Column:
    """One, plus branches, plus the extra operands of boolean operators."""
    return F.lit(1) + F.size(_of_kind("branch")) + _total(_of_kind("bool"), lambda e: e["n"])


def cognitive() -> Column:
    """Branches weighted by nesting, plus the extra boolean operands."""
    nested = _total(_of_kind("branch"), lambda e: e["depth"] + 1)
    return nested + _total(_of_kind("bool"), lambda e: e["n"])


def maintainability(complexity: Column, loc: Column) -> Column:
    index = (
        F.lit(171.0)
        - F.log(F.greatest(complexity, F.lit(1))) * 5.2
        - complexity * 0.23
        - F.log(F.greatest(loc, F.lit(1))) * 16.2
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), index))


def _number(value: Column) -> Column:
    return value.cast("string")


def long_functions() -> Column:
    found = F.filter(_of_kind("function"), lambda e: e["n"] > LONG_FUNCTION)
    return F.transform(found, _long_message)


def _long_message(e: Column) -> Column:
    return F.concat(
        F.lit("Function '"), e["name"], F.lit("' is too long ("), _number(e["n"]), F.lit(" lines)")
    )


def _params_message(e: Column) -> Column:
    count = _number(e["params"])
    return F.concat(
        F.lit("Function '"), e["name"], F.lit("' has too many parameters ("), count, F.lit(")")
    )


def many_params() -> Column:
    found = F.filter(_of_kind("function"), lambda e: e["params"] > MANY_PARAMS)
    return F.transform(found, _params_message)


def large_classes() -> Column:
    found = F.filter(_of_kind("class"), lambda e: e["n"] > LARGE_CLASS)
    return F.transform(
        found,
        lambda e: F.concat(
            F.lit("Class '"),
            e["name"],
            F.lit("' has too many methods ("),
            _number(e["n"]),
            F.lit(")"),
        ),
    )


def unused_imports() -> Column:
    """Imported names that occur nowhere once unindented import lines are blanked.

    The blanked text rides in the accumulator, so it is built once per node.
    """
    names = F.array_distinct(F.transform(_of_kind("import"), lambda e: e["name"]))
    blanked = F.regexp_replace("code", r"(?md)^(import|from).*$", "")
    start = F.struct(
        blanked.alias("rest"), F.array().cast("array<string>").alias("unused")
    )

    def step(acc: Column, name: Column) -> Column:
        grown = F.concat(acc["unused"], F.array(name))
        unused = F.when(acc["rest"].contains(name), acc["unused"]).otherwise(grown)
        return F.struct(acc["rest"].alias("rest"), unused.alias("unused"))

    unused = F.aggregate(names, start, step, lambda acc: acc["unused"])
    return F.transform(unused, lambda n: F.concat(F.lit("Possibly unused import: "), n))


def repeated_line_message() -> Column:
    at = _number(t.repeated_line(F.col("code")))
    message = F.concat(F.lit("Duplicated code detected at line "), at)
    return F.filter(F.array(message), lambda m: m.isNotNull())


def code_smells() -> Column:
    """All smell messages of a node, in reporting order."""
    per_function = F.flatten(
        F.transform(
            _of_kind("function"),
            lambda e: F.array(
                F.when(e["n"] > LONG_FUNCTION, _long_message(e)),
                F.when(e["params"] > MANY_PARAMS, _params_message(e)),
            ),
        )
    )
    everything = F.concat(
        per_function, large_classes(), unused_imports(), repeated_line_message()
    )
    return F.filter(everything, lambda m: m.isNotNull())


def doc_score() -> Column:
    """Mean of documented share and comment ratio, at most 1; methods have none."""
    definitions = _of_kind("function", "class")
    documented = F.size(F.filter(definitions, lambda e: e["documented"]))
    share = F.when(F.size(definitions) > 0, documented / F.size(definitions)).otherwise(0.0)
    score = F.least(F.lit(1.0), (share + t.comment_ratio(F.col("code"))) / 2)
    return F.when(F.col("kind") == "method", F.lit(0.0)).otherwise(score)


def design_patterns() -> Column:
    """Patterns hinted at by a file or class."""
    lowered = F.lower("code")
    observer = (
        lowered.contains("subscribe") | lowered.contains("observer") | lowered.contains("notify")
    )
    makes = F.exists(
        _of_kind("function"),
        lambda e: F.lower(e["name"]).contains("create") | F.lower(e["name"]).contains("factory"),
    )
    found = F.array(
        F.when(F.exists(_of_kind("class"), lambda e: e["singleton"]), F.lit("Singleton")),
        F.when(makes, F.lit("Factory")),
        F.when(observer, F.lit("Observer")),
        F.when(
            F.exists(_of_kind("function", "class"), lambda e: e["decorated"]), F.lit("Decorator")
        ),
    )
    named = F.filter(found, lambda p: p.isNotNull())
    return F.when(F.col("kind").isin("file", "class"), named).otherwise(
        F.array().cast("array<string>")
    )


def with_metrics(nodes: DataFrame) -> DataFrame:
    """All metric columns of each node; one projection, no shuffle."""
    return nodes.withColumns(
        {
            "code_hash": t.content_hash(F.col("code")),
            "cyclomatic": cyclomatic(),
            "cognitive": cognitive(),
            "loc": t.code_lines(F.col("code")),
            "comment_ratio": t.comment_ratio(F.col("code")),
            "security_issues": t.security_issues(F.col("code")),
            "code_smells": code_smells(),
            "doc_score": doc_score(),
            "design_patterns": design_patterns(),
        }
    ).withColumn("maintainability", maintainability(F.col("cyclomatic"), F.col("loc")))
