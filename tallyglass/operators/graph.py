"""Edges, maps, totals and change history of the code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.skew import lookup_join, newest_rows
from ..session import stored

METRICS = ["cyclomatic", "cognitive", "loc", "comment_ratio", "maintainability"]


def node_latest(nodes: DataFrame) -> DataFrame:
    """One node per id: the last one in path and line order."""
    return newest_rows(nodes, ["code_id"], [F.desc("path"), F.desc("line")])


def contains_edges(nodes: DataFrame) -> DataFrame:
    """File to class, class to method and file to function."""
    return (
        nodes.where(F.col("parent_id").isNotNull())
        .select(F.col("parent_id").alias("src"), F.col("code_id").alias("dst"))
        .distinct()
        .withColumn("kind", F.lit("contains"))
    )


def called_names(code: Column) -> Column:
    """Distinct words directly followed by an opening bracket."""
    pattern = rf"(?<!{t.WORD})({t.WORD}+){t.BLANK}*\("
    return F.array_distinct(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)))


def call_edges(latest: DataFrame) -> DataFrame:
    """Caller to every function or method whose short name it calls.

    An equi-join on the name that stands names called from a large share of all
    nodes.  Both sides are distinct, so an edge comes out once.  The calls are found once
    and stored; the nodes are still read more than once: give it a stored table rather than
    a running parse.
    """
    callables = latest.where(F.col("kind").isin("func", "method"))
    calls = callables.select(
        F.col("code_id").alias("src"), F.explode(called_names(F.col("code"))).alias("short")
    )
    names = callables.select(
        F.col("code_id").alias("dst"),
        F.element_at(F.split("name", r"\."), -1).alias("short"),
    )
    joined = lookup_join(stored(calls, "calls"), names, ["short"])
    return joined.where(F.col("src") != F.col("dst")).select(
        "src", "dst", F.lit("calls").alias("kind")
    )


def impact_map(contains: DataFrame, calls: DataFrame) -> DataFrame:
    """Who is affected when a node changes, one row per pair."""
    down = contains.select(F.col("src").alias("code_id"), F.col("dst").alias("affected"))
    back = calls.select(F.col("dst").alias("code_id"), F.col("src").alias("affected"))
    return down.union(back).distinct()


def module_map(nodes: DataFrame) -> DataFrame:
    """Module to the classes and functions defined in it, one row per pair."""
    base = F.element_at(F.split("path", "/"), -1)
    return (
        nodes.where(F.col("kind").isin("class", "func"))
        .select(F.replace(base, F.lit(".py"), F.lit("")).alias("module"), "code_id")
        .distinct()
    )


def name_map(latest: DataFrame) -> DataFrame:
    """Class and function names to node ids."""
    return latest.where(F.col("kind").isin("class", "func", "method")).select(
        F.when(F.col("kind") == "class", "class").otherwise("function").alias("map"),
        "name",
        "code_id",
    )


def test_rollup(results: DataFrame) -> DataFrame:
    """Coverage per node; the share of passed tests is also its functional state."""
    passed = F.col("passed").cast("int")
    per_node = results.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum(passed).alias("passed")
    )
    return per_node.withColumn("failed", F.col("total") - F.col("passed")).withColumn(
        "coverage", F.col("passed") / F.col("total")
    )


def test_totals(rollup: DataFrame) -> DataFrame:
    totals = rollup.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "passed", "failed")]
    )
    share = F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0)
    return totals.withColumn("coverage", share)


def global_metrics(measured: DataFrame, rollup: DataFrame | None = None) -> DataFrame:
    """Node count, sums and means over all nodes, as one row."""
    nodes = measured.select("code_id", "loc", "cyclomatic", "maintainability", "security_issues")
    if rollup is None:
        nodes = nodes.withColumn("coverage", F.lit(None).cast("double"))
    else:
        covered = rollup.select(F.col("node_id").alias("code_id"), "coverage")
        nodes = nodes.join(covered, "code_id", "left")
    return nodes.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"),
        F.coalesce(F.avg("cyclomatic"), F.lit(0.0)).alias("average_complexity"),
        F.coalesce(F.avg("maintainability"), F.lit(0.0)).alias("average_maintainability"),
        F.coalesce(F.sum(F.size("security_issues")), F.lit(0)).alias("total_security_issues"),
        F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("test_coverage"),
    )


def node_changes(
    old: DataFrame, new: DataFrame, changed_at: Column, reason: str = ""
) -> DataFrame:
    """History rows of nodes whose source changed: the old version and when it ended."""
    before = old.select(
        "code_id",
        F.col("code_hash").alias("old_hash"),
        F.col("code").alias("old_code"),
        F.struct(*METRICS, "security_issues", "code_smells").alias("old_metrics"),
    )
    after = new.select("code_id", "code_hash")
    return (
        before.join(after, "code_id")
        .where(F.col("old_hash") != F.col("code_hash"))
        .drop("code_hash")
        .withColumn("ts", changed_at)
        .withColumn("reason", F.lit(reason))
    )


def changed_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """``code_id`` of the nodes whose ``code_hash`` changed, without their history."""
    before = old.select("code_id", F.col("code_hash").alias("old_hash"))
    both = before.join(new.select("code_id", "code_hash"), "code_id")
    return both.where(F.col("old_hash") != F.col("code_hash")).select("code_id")


def apply_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The node table after an update: new nodes win, others stay."""
    return new.unionByName(old.join(new.select("code_id"), "code_id", "left_anti"))


def valid_test_results(results: DataFrame, changes: DataFrame) -> DataFrame:
    """Test results of nodes that did not change; changes are best a stored table.

    Only changes of nodes that have results are looked up.
    """
    changed = changes.select(F.col("code_id").alias("node_id"))
    tested = stored(changed.join(results.select("node_id").distinct(), "node_id", "left_semi"), "tested")
    return lookup_join(results, tested, ["node_id"], "left_anti")
