"""Code-graph queries over the corpus derived from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import code_metrics, graph, report
from ..operators.code_nodes import code_nodes, parse_errors, parse_files
from ..sources import files as source_files
from ..sources import sinks
from .corpus import NODES_SQL, SMELLS_SQL, corpus_files, write_files
from ..session import stored, work_folder
from .registry import at, query, rounded, table


def nodes(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    return code_nodes(parse_files(corpus_files(spark, sf_dir, version)))


def latest(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    return graph.node_latest(nodes(spark, sf_dir, version))


def measured(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """Metrics first: of a node only its measures and text are sorted, not its syntax events."""
    return graph.node_latest(code_metrics.with_metrics(nodes(spark, sf_dir, version)).drop("events"))


def hashed(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """Only the hash of a node's text is sorted, and no syntax event is made."""
    found = code_nodes(parse_files(corpus_files(spark, sf_dir, version), events=False))
    hashes = found.withColumn("code_hash", t.content_hash(F.col("code"))).drop("code", "events")
    return graph.node_latest(hashes)


@query("code_nodes", f"WITH {NODES_SQL} SELECT code_id, kind, parent_id, path FROM scored")
def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("code_id", "kind", "parent_id", "path")


@query(
    "parse_errors",
    """SELECT DISTINCT '/repo/broken_' || (p_partkey // 500) || '.py' AS path FROM part""",
)
def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_errors(parse_files(corpus_files(spark, sf_dir))).select("path")


@query(
    "node_latest",
    f"WITH {NODES_SQL} SELECT code_id, kind, parent_id, path FROM latest",
)
def node_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select("code_id", "kind", "parent_id", "path")


def _register_measure(name: str, column: str, expression) -> None:
    @query(
        name, f"WITH {NODES_SQL} SELECT code_id, path, round({column}, 8) AS {column} FROM scored"
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = nodes(spark, sf_dir).select("code_id", "path", expression().alias(column))
        return rounded(found, column)


_register_measure("cyclomatic", "cyclomatic", code_metrics.cyclomatic)
_register_measure("cognitive", "cognitive", code_metrics.cognitive)
_register_measure(
    "maintainability",
    "maintainability",
    lambda: code_metrics.maintainability(
        code_metrics.cyclomatic(), t.code_lines(F.col("code"))
    ),
)
_register_measure("doc_score", "doc_score", code_metrics.doc_score)


@query(
    "code_line_counts",
    f"""WITH {NODES_SQL} SELECT code_id, path, loc, comments,
  round(comment_ratio, 8) AS comment_ratio FROM scored""",
)
def code_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    found = nodes(spark, sf_dir).select(
        "code_id",
        "path",
        t.code_lines(code).alias("loc"),
        t.comment_lines(code).alias("comments"),
        t.comment_ratio(code).alias("comment_ratio"),
    )
    return rounded(found, "comment_ratio")


@query(
    "code_security",
    f"""WITH {NODES_SQL} SELECT code_id, path, 'Use of eval() is dangerous' AS issue
FROM scored WHERE issues > 0""",
)
def code_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = t.security_issues(F.col("code"))
    return nodes(spark, sf_dir).select("code_id", "path", F.explode(issues).alias("issue"))


def _register_smell(smell: str, expression) -> None:
    @query(
        f"smell_code_{smell}" if smell == "duplicate_line" else f"smell_{smell}",
        f"WITH {NODES_SQL}, {SMELLS_SQL} SELECT code_id, message FROM smells WHERE smell = '{smell}'",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nodes(spark, sf_dir).select("code_id", F.explode(expression()).alias("message"))


for _smell, _expression in (
    ("long_function", code_metrics.long_functions),
    ("many_params", code_metrics.many_params),
    ("large_class", code_metrics.large_classes),
    ("unused_import", code_metrics.unused_imports),
    ("duplicate_line", code_metrics.repeated_line_message),
):
    _register_smell(_smell, _expression)


@query(
    "code_smells",
    f"""WITH {NODES_SQL}, {SMELLS_SQL} SELECT code_id, message FROM smells""",
)
def all_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    smells = F.explode(code_metrics.code_smells()).alias("message")
    return nodes(spark, sf_dir).select("code_id", smells)


@query(
    "design_patterns",
    """WITH files AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS b, p_partkey // 500 AS bk FROM part),
ids AS (SELECT b, 'file:brand_' || b || '_' || bk || '.py' AS file_id, 'class:Cls_' || b || '_' || bk AS class_id FROM files)
SELECT unnest([file_id, class_id]) AS code_id, 'Singleton' AS pattern FROM ids WHERE b % 3 = 0
UNION ALL SELECT unnest([file_id, class_id]), 'Decorator' FROM ids WHERE b % 4 = 0
UNION ALL SELECT file_id, 'Factory' FROM ids WHERE b % 5 = 0
UNION ALL SELECT file_id, 'Observer' FROM ids WHERE b % 7 = 0""",
)
def design_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = F.explode(code_metrics.design_patterns()).alias("pattern")
    return nodes(spark, sf_dir).select("code_id", patterns)


CONTAINS_SQL = """contains AS (
  SELECT DISTINCT parent_id AS src, code_id AS dst, 'contains' AS kind FROM scored WHERE parent_id IS NOT NULL)"""
CALLS_SQL = """calls AS (
  SELECT 'func:fn_' || k AS src, 'func:fn_' || prev AS dst, 'calls' AS kind FROM fn WHERE prev IS NOT NULL
  UNION ALL SELECT 'method:Cls_' || nm || '.m0_' || nm, 'func:helper', 'calls' FROM fc)"""


@query("contains_edges", f"WITH {NODES_SQL}, {CONTAINS_SQL} SELECT * FROM contains")
def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contains_edges(nodes(spark, sf_dir))


@query("call_edges", f"WITH {NODES_SQL}, {CALLS_SQL} SELECT * FROM calls")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.call_edges(stored(latest(spark, sf_dir).drop("events"), "latest"))


@query(
    "impact_map",
    f"""WITH {NODES_SQL}, {CONTAINS_SQL}, {CALLS_SQL}
SELECT src AS code_id, dst AS affected FROM contains UNION SELECT dst, src FROM calls""",
)
def impact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = stored(nodes(spark, sf_dir).drop("events"), "nodes")
    calls = graph.call_edges(graph.node_latest(every))
    return graph.impact_map(graph.contains_edges(every), calls)


@query(
    "module_map",
    f"""WITH {NODES_SQL} SELECT DISTINCT 'brand_' || nm AS module, code_id
FROM scored WHERE kind IN ('class', 'func')""",
)
def module_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_map(nodes(spark, sf_dir))


@query(
    "name_maps",
    f"""WITH {NODES_SQL} SELECT CASE WHEN kind = 'class' THEN 'class' ELSE 'function' END AS map,
  split_part(code_id, ':', 2) AS name, code_id FROM latest WHERE kind <> 'file'""",
)
def name_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.name_map(latest(spark, sf_dir))


ROLLUP_SQL = """rollup AS (
  SELECT 'func:fn_' || (event_id % 1000) AS node_id, count(*) AS total,
    CAST(sum((value < 50)::INT) AS BIGINT) AS passed, count(*) - CAST(sum((value < 50)::INT) AS BIGINT) AS failed,
    avg((value < 50)::INT) AS coverage FROM events GROUP BY 1)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as test results of the corpus functions."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("func:fn_"), F.pmod("event_id", F.lit(1000))).alias("node_id"),
        (F.col("value") < 50).alias("passed"),
    )


@query(
    "test_rollup",
    f"WITH {ROLLUP_SQL} SELECT node_id, total, passed, failed, round(coverage, 8) AS coverage FROM rollup",
)
def test_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.test_rollup(results(spark, sf_dir)), "coverage")


@query(
    "test_totals",
    f"""WITH {ROLLUP_SQL} SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(passed) AS BIGINT) AS passed,
  CAST(sum(failed) AS BIGINT) AS failed, round(sum(passed) / sum(total), 8) AS coverage FROM rollup""",
)
def test_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.test_totals(graph.test_rollup(results(spark, sf_dir))), "coverage")


SUMMARY = ["average_complexity", "average_maintainability", "test_coverage"]


@query(
    "global_metrics",
    f"""WITH {NODES_SQL}, {ROLLUP_SQL}
SELECT count(*) AS total_nodes, CAST(sum(loc) AS BIGINT) AS total_loc,
  round(avg(cyclomatic), 8) AS average_complexity, round(avg(maintainability), 8) AS average_maintainability,
  CAST(sum(issues) AS BIGINT) AS total_security_issues, round(avg(coverage), 8) AS test_coverage
FROM latest LEFT JOIN rollup ON code_id = node_id""",
)
def global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = graph.test_rollup(results(spark, sf_dir))
    return rounded(graph.global_metrics(measured(spark, sf_dir), rollup), *SUMMARY)


SECTIONS_SQL = f"""{NODES_SQL}, {SMELLS_SQL},
sections AS (
  SELECT 'high_risk_nodes' AS section, code_id AS node_id, maintainability AS m1, cyclomatic AS m2
    FROM latest WHERE maintainability < 50 AND cyclomatic > 10
  UNION ALL SELECT 'security_vulnerabilities', code_id, issues, NULL FROM latest WHERE issues > 0
  UNION ALL SELECT 'code_smells', code_id, count(*), NULL FROM smells GROUP BY code_id
  UNION ALL SELECT 'low_documentation', code_id, doc_score, NULL FROM latest WHERE doc_score < 0.3
  UNION ALL SELECT 'high_complexity', code_id, cognitive, cyclomatic FROM latest WHERE cognitive > 15)"""


@query(
    "quality_sections",
    f"WITH {SECTIONS_SQL} SELECT section, node_id, round(m1, 8) AS m1, m2 FROM sections",
)
def quality_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = report.quality_sections(measured(spark, sf_dir))
    detail = F.from_json(
        "detail",
        "maintainability double, complexity int, issues array<string>, smells array<string>, "
        "score double, cognitive_complexity int, cyclomatic_complexity int",
    )
    found = sections.withColumn("d", detail).select(
        "section",
        "node_id",
        F.coalesce(
            "d.maintainability",
            "d.score",
            F.col("d.cognitive_complexity").cast("double"),
            F.size("d.issues").cast("double"),
            F.size("d.smells").cast("double"),
        ).alias("m1"),
        F.coalesce("d.complexity", "d.cyclomatic_complexity").alias("m2"),
    )
    return rounded(found, "m1")


ADVICE_SQL = """counts AS (
  SELECT count(*) FILTER (section = 'security_vulnerabilities') AS vulnerable,
    count(*) FILTER (section = 'high_risk_nodes') AS risky,
    count(*) FILTER (section = 'low_documentation') AS undocumented FROM sections),
facts AS (SELECT *, (SELECT count(*) FROM latest) AS n, (SELECT avg(cyclomatic) FROM latest) AS cc FROM counts),
advice AS (SELECT [a FOR a IN [
  CASE WHEN vulnerable > 0 THEN 'CRITICAL: Fix ' || vulnerable || ' security vulnerabilities' END,
  CASE WHEN risky > 0 THEN 'HIGH: Refactor ' || risky || ' high-risk components' END,
  CASE WHEN undocumented > n * 0.3 THEN 'MEDIUM: Improve documentation coverage (currently below 30%)' END,
  CASE WHEN cc > 10 THEN 'MEDIUM: Reduce average code complexity' END] IF a IS NOT NULL] AS lines FROM facts)"""


@query(
    "recommendations",
    f"""WITH {SECTIONS_SQL}, {ADVICE_SQL}
SELECT unnest(range(len(lines))) AS position, unnest(lines) AS recommendation FROM advice""",
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(measured(spark, sf_dir).drop("code", "events"), "measured")
    return report.recommendations(report.quality_sections(rows), graph.global_metrics(rows))


@query(
    "report_lines",
    f"""WITH {SECTIONS_SQL}, {ADVICE_SQL},
total AS (SELECT count(*) AS n, sum(loc) AS loc, avg(cyclomatic) AS cc, avg(maintainability) AS mi,
  sum(issues) AS issues FROM latest),
head AS (SELECT ['# Code Quality Report', '', '## Summary', '- Total Nodes: ' || n,
  '- Total Lines of Code: ' || loc, printf('- Average Complexity: %.2f', cc),
  printf('- Average Maintainability: %.2f', mi), '- Security Issues: ' || issues,
  '- Test Coverage: 0.0%', '', '## Recommendations'] AS ls FROM total),
risky AS (SELECT * FROM latest WHERE maintainability < 50 AND cyclomatic > 10),
unsafe AS (SELECT * FROM latest WHERE issues > 0)
SELECT 0 AS block, '' AS node_id, unnest(range(len(ls))) AS position, unnest(ls) AS line FROM head
UNION ALL SELECT 1, '', unnest(range(len(lines))), '- ' || unnest(lines) FROM advice
UNION ALL SELECT 2, '', unnest([0, 1, 2]), unnest(['', '## Security Vulnerabilities', ''])
  FROM (SELECT 1 FROM unsafe LIMIT 1)
UNION ALL SELECT 3, code_id, unnest([0, 1]), unnest(['### ' || code_id, '- Use of eval() is dangerous']) FROM unsafe
UNION ALL SELECT 4, '', unnest([0, 1, 2]), unnest(['', '## High Risk Components', ''])
  FROM (SELECT 1 FROM risky LIMIT 1)
UNION ALL SELECT 5, code_id, 0, printf('- **%s**: Maintainability=%.1f, Complexity=%d', code_id, maintainability, cyclomatic)
  FROM risky""",
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(measured(spark, sf_dir).drop("code", "events"), "measured")
    summary = graph.global_metrics(rows)
    advice = report.recommendations(report.quality_sections(rows), summary)
    return report.markdown_lines(rows, summary, advice)


CHANGED_SQL = """changed AS (
  SELECT code_id, cyclomatic, loc FROM latest WHERE kind = 'func' AND k % 13 = 0
  UNION ALL SELECT l.code_id, l.cyclomatic, l.loc FROM latest l
    WHERE kind = 'file' AND EXISTS (SELECT 1 FROM fn WHERE fn.b = l.b AND fn.bk = l.bk AND fn.k % 13 = 0))"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = measured(spark, sf_dir), measured(spark, sf_dir, version=2)
    return graph.node_changes(old, new, at("2024-02-01 00:00:00"), "release")


@query(
    "node_changes",
    f"""WITH {NODES_SQL}, {CHANGED_SQL}
SELECT code_id, cyclomatic AS old_cyclomatic, loc AS old_loc,
  TIMESTAMP '2024-02-01 00:00:00' AS ts, 'release' AS reason FROM changed""",
)
def node_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select(
        "code_id",
        F.col("old_metrics.cyclomatic").alias("old_cyclomatic"),
        F.col("old_metrics.loc").alias("old_loc"),
        "ts",
        "reason",
    )


@query(
    "valid_test_results",
    f"""WITH {NODES_SQL}, {CHANGED_SQL}, results AS (
  SELECT 'func:fn_' || (event_id % 1000) AS node_id, value < 50 AS passed FROM events)
SELECT node_id, passed FROM results WHERE node_id NOT IN (SELECT code_id FROM changed)""",
)
def valid_test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = hashed(spark, sf_dir), hashed(spark, sf_dir, version=2)
    changed = stored(graph.changed_ids(old, new), "changes")
    return graph.valid_test_results(results(spark, sf_dir), changed)


@query(
    "source_scan",
    f"""WITH {NODES_SQL} SELECT 'brand_' || nm || '.py' AS name, CAST(loc + comments AS INT) AS lines
FROM scored WHERE kind = 'file'
UNION ALL SELECT DISTINCT 'broken_' || (p_partkey // 500) || '.py', 1 FROM part""",
)
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "project")
    write_files(corpus_files(spark, sf_dir), folder)
    scanned = source_files.source_scan(spark, folder)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return scanned.select(name, F.size(t.lines(F.col("content"))).alias("lines"))


@query(
    "archive_scan",
    f"""WITH {NODES_SQL} SELECT 'brand_' || nm || '.zip/src/brand_' || nm || '.py' AS name,
  CAST(loc + comments AS INT) AS lines FROM scored WHERE kind = 'file'
UNION ALL SELECT DISTINCT 'broken_' || b || '.zip/src/broken_' || b || '.py', 1
FROM (SELECT p_partkey // 500 AS b FROM part)""",
)
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "archives")
    write_files(corpus_files(spark, sf_dir), folder, zipped=True)
    scanned = source_files.archive_scan(spark, folder)
    name = F.array_join(F.slice(F.split("path", "/"), -3, 3), "/").alias("name")
    return scanned.select(name, F.size(t.lines(F.col("content"))).alias("lines"))


@query(
    "graph_save_load",
    f"""WITH {NODES_SQL}, {CALLS_SQL} SELECT code_id, kind, loc, cyclomatic,
  (SELECT count(*) FROM calls WHERE src = code_id) AS calls FROM latest""",
)
def graph_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "graph")
    rows = latest(spark, sf_dir)
    sinks.graph_save(folder, nodes=code_metrics.with_metrics(rows))
    loaded = sinks.graph_load(spark, folder, "nodes")
    sinks.graph_save(folder, edges=graph.call_edges(loaded))
    edges = sinks.graph_load(spark, folder, "edges")
    counts = edges.groupBy(F.col("src").alias("code_id")).agg(F.count(F.lit(1)).alias("calls"))
    return loaded.join(counts, "code_id", "left").select(
        "code_id", "kind", "loc", "cyclomatic", F.coalesce("calls", F.lit(0)).alias("calls")
    )


@query(
    "report_sink",
    f"""WITH {SECTIONS_SQL} SELECT section, count(*) AS entries FROM sections GROUP BY section""",
)
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "report")
    rows = stored(measured(spark, sf_dir).drop("code", "events"), "measured")
    summary, sections = graph.global_metrics(rows), report.quality_sections(rows)
    advice = report.recommendations(sections, summary)
    lines = report.markdown_lines(rows, summary, advice)
    sinks.report_sink(folder, summary, sections, advice, lines)
    written = spark.read.schema("section string, node_id string").json(f"{folder}/sections")
    return written.groupBy("section").agg(F.count(F.lit(1)).alias("entries"))
