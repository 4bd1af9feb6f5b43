"""Quality report: sections, recommendations and Markdown lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section names (fixed values) in report order.
SECTIONS = [
    "high_risk_nodes",
    "security_vulnerabilities",
    "code_smells",
    "low_documentation",
    "high_complexity",
]


def quality_sections(measured: DataFrame) -> DataFrame:
    """One row per node and section it belongs to; the detail is JSON."""

    def entry(section: str, test: Column, *detail: Column) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(section).alias("section"), F.to_json(F.struct(*detail)).alias("detail")
            ),
        )

    mi, cc = F.col("maintainability"), F.col("cyclomatic")
    entries = F.array(
        entry(
            "high_risk_nodes",
            (mi < 50) & (cc > 10),
            mi.alias("maintainability"),
            cc.alias("complexity"),
        ),
        entry(
            "security_vulnerabilities",
            F.size("security_issues") > 0,
            F.col("security_issues").alias("issues"),
        ),
        entry("code_smells", F.size("code_smells") > 0, F.col("code_smells").alias("smells")),
        entry("low_documentation", F.col("doc_score") < 0.3, F.col("doc_score").alias("score")),
        entry(
            "high_complexity",
            F.col("cognitive") > 15,
            F.col("cognitive").alias("cognitive_complexity"),
            cc.alias("cyclomatic_complexity"),
        ),
    )
    belongs = F.filter(entries, lambda e: e.isNotNull())
    return measured.select(F.col("code_id").alias("node_id"), F.explode(belongs).alias("e")).select(
        "e.section", "node_id", "e.detail"
    )


def recommendations(sections: DataFrame, summary: DataFrame) -> DataFrame:
    """Advice lines from the section sizes and the one-row summary."""

    def size_of(section: str) -> Column:
        return F.count(F.when(F.col("section") == section, 1)).alias(section)

    facts = sections.agg(*[size_of(s) for s in SECTIONS]).withColumns(
        {c: summary.select(c).scalar() for c in ("total_nodes", "average_complexity")}
    )
    vulnerable, risky = F.col("security_vulnerabilities"), F.col("high_risk_nodes")
    advice = F.array(
        F.when(
            vulnerable > 0, F.format_string("CRITICAL: Fix %d security vulnerabilities", vulnerable)
        ),
        F.when(risky > 0, F.format_string("HIGH: Refactor %d high-risk components", risky)),
        F.when(
            F.col("low_documentation") > F.col("total_nodes") * 0.3,
            F.lit("MEDIUM: Improve documentation coverage (currently below 30%)"),
        ),
        F.when(
            F.col("average_complexity") > 10, F.lit("MEDIUM: Reduce average code complexity")
        ),
    )
    return facts.select(
        F.posexplode(F.filter(advice, lambda a: a.isNotNull())).alias("position", "recommendation")
    )


def markdown_lines(measured: DataFrame, summary: DataFrame, advice: DataFrame) -> DataFrame:
    """Report lines ``(block, node_id, position, line)``; sort by the first three.

    Each block is built where its rows are; nothing is gathered into one row.
    """
    head = F.array(
        F.lit("# Code Quality Report"),
        F.lit(""),
        F.lit("## Summary"),
        F.format_string("- Total Nodes: %d", F.col("total_nodes")),
        F.format_string("- Total Lines of Code: %d", F.col("total_loc")),
        F.format_string("- Average Complexity: %.2f", F.col("average_complexity")),
        F.format_string("- Average Maintainability: %.2f", F.col("average_maintainability")),
        F.format_string("- Security Issues: %d", F.col("total_security_issues")),
        F.format_string("- Test Coverage: %.1f%%", F.col("test_coverage") * 100),
        F.lit(""),
        F.lit("## Recommendations"),
    )

    def block(number: int, rows: DataFrame, node: Column, text: Column) -> DataFrame:
        return rows.select(
            F.lit(number).alias("block"),
            node.alias("node_id"),
            F.posexplode(text).alias("position", "line"),
        )

    def title(number: int, rows: DataFrame, text: str) -> DataFrame:
        wanted = rows.select(F.lit(1).alias("x")).limit(1)
        heading = F.array(F.lit(""), F.lit(f"## {text}"), F.lit(""))
        return block(number, wanted, F.lit(""), heading)

    vulnerable = measured.where(F.size("security_issues") > 0)
    risky = measured.where((F.col("maintainability") < 50) & (F.col("cyclomatic") > 10))
    advised = advice.select(
        F.lit(1).alias("block"),
        F.lit("").alias("node_id"),
        "position",
        F.concat(F.lit("- "), "recommendation").alias("line"),
    )
    issue_lines = F.concat(
        F.array(F.concat(F.lit("### "), "code_id")),
        F.transform("security_issues", lambda i: F.concat(F.lit("- "), i)),
    )
    risk_line = F.format_string(
        "- **%s**: Maintainability=%.1f, Complexity=%d",
        F.col("code_id"),
        F.col("maintainability"),
        F.col("cyclomatic"),
    )
    parts = [
        block(0, summary, F.lit(""), head),
        advised,
        title(2, vulnerable, "Security Vulnerabilities"),
        block(3, vulnerable, F.col("code_id"), issue_lines),
        title(4, risky, "High Risk Components"),
        block(5, risky, F.col("code_id"), F.array(risk_line)),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines
