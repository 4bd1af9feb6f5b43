"""A source-code corpus derived from ``part``, with its true metrics in SQL.

One file per brand and block of 500 part keys, so files stay small however many
parts there are.  A part is one function whose shape follows its key and size.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import open_root
from .registry import table

BLOCK = 500


def corpus_files(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """Files ``(path, content)``; version 2 changes every thirteenth function."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"),
        F.col("p_size").cast("bigint").alias("s"),
        F.expr("cast(substring(p_brand, 7) as bigint)").alias("b"),
        F.expr(f"p_partkey div {BLOCK}").alias("bk"),
    )
    in_file = W.partitionBy("b", "bk").orderBy("k")
    parts = parts.withColumn("prev", F.lag("k").over(in_file))
    end = "'    return ', k" if version == 1 else "'    return ', k, if(k % 13 = 0, ' + 1', '')"
    parts = parts.withColumn(
        "code",
        F.expr(rf"""concat_ws('\n',
          concat('def fn_', k, '(', array_join(transform(filter(sequence(0L, 8L), i -> i < k % 9), i -> concat('a', i)), ', '), '):'),
          if(k % 3 = 0, concat('    \"\"\"Part ', k, '.\"\"\"'), null),
          if(k % 4 = 0, concat('    # note ', k), null),
          case when s % 7 = 0 then null
            when k % 2 = 0 then concat_ws('\n', transform(sequence(1L, s % 7), i -> concat('    if ', i, ' < ', k, ':\n        x = ', i)))
            else concat(concat_ws('\n', transform(sequence(1L, s % 7), i -> concat(repeat('    ', cast(i as int)), 'if ', i, ' < ', k, ':'))),
                        '\n', repeat('    ', cast(s % 7 + 1 as int)), 'x = 0') end,
          if(k % 97 = 0, array_join(array_repeat('    y = 1', 51), '\n'), null),
          if(k % 11 = 0, '    z = eval(\'1\')', null),
          if(s % 5 = 0, concat('    w = ', k, ' and 1 and 2'), null),
          if(prev is not null, concat('    fn_', prev, '()'), null),
          concat({end}))"""),
    )
    files = parts.groupBy("b", "bk").agg(F.array_sort(F.collect_list(F.struct("k", "code"))).alias("fns"))
    name = "b, '_', bk"
    content = F.expr(rf"""concat_ws('\n',
      'import os\nimport json',
      if(b % 5 = 0, array_join(array_repeat('repeated_line_of_code = 1', 3), '\n'), null),
      concat('def helper():\n', if(b % 7 = 0, '    notify = 1\n', ''), '    return os.getcwd()'),
      if(b % 5 = 0, concat('def create_', {name}, '():\n    return 1'), null),
      concat('class Cls_', {name}, ':'),
      if(b % 2 = 0, '    \"\"\"Doc.\"\"\"', null),
      if(b % 3 = 0, '    _instance = None', null),
      if(b % 4 = 0, '    @staticmethod', null),
      concat('    def m0_', {name}, '(self):\n        helper()\n        return 0'),
      concat_ws('\n', transform(sequence(1L, b), i -> concat('    def m', i, '_', {name}, '(self):\n        return 0'))),
      concat_ws('\n', transform(fns, f -> f.code)))""")
    good = files.select(F.expr(f"concat('/repo/brand_', {name}, '.py')").alias("path"), content.alias("content"))
    broken = parts.select("bk").distinct().select(
        F.expr("concat('/repo/broken_', bk, '.py')").alias("path"), F.lit("def (").alias("content")
    )
    return good.union(broken)


def write_files(files: DataFrame, folder: str, zipped: bool = False) -> None:
    """Write each file of ``(path, content)`` below a folder, or as an archive of its own."""

    system, inner, _ = open_root(folder)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, target = content.encode(), inner + path
                if zipped:
                    packed = io.BytesIO()
                    with zipfile.ZipFile(packed, "w") as archive:
                        archive.writestr(f"src/{os.path.basename(path)}", data)
                        archive.writestr("README.txt", "not code")
                    data, target = packed.getvalue(), target.removesuffix(".py") + ".zip"
                system.create_dir(os.path.dirname(target), recursive=True)
                with system.open_output_stream(target) as stream:
                    stream.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([target])], names=["path"])

    files.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode(
        "overwrite"
    ).save()


# True answers of the corpus, one row per raw node.
NODES_SQL = f"""fns AS (
  SELECT *, s % 7 AS m, (k % 2 = 1) AS odd, prev IS NOT NULL AS calls FROM (
    SELECT k, s, b, bk, lag(k) OVER (PARTITION BY b, bk ORDER BY k) AS prev FROM (
      SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s,
        CAST(substr(p_brand, 7) AS BIGINT) AS b, p_partkey // {BLOCK} AS bk FROM part))),
fn AS (
  SELECT b, bk, k, prev, k % 9 AS params, (k % 3 = 0)::INT AS doc, (k % 4 = 0)::INT AS com,
    (k % 11 = 0) AS ev, k % 97 = 0 AS long,
    1 + m + CASE WHEN s % 5 = 0 THEN 2 ELSE 0 END AS cyc,
    CASE WHEN odd THEN m * (m + 1) // 2 ELSE m END + CASE WHEN s % 5 = 0 THEN 2 ELSE 0 END AS cog,
    (k % 3 = 0)::INT + CASE WHEN odd THEN least(m, 1) ELSE m END + 51 * (k % 97 = 0)::INT
      + (k % 11 = 0)::INT + (s % 5 = 0)::INT + calls::INT + 1 AS body,
    2 + (k % 3 = 0)::INT + CASE WHEN odd THEN m + least(m, 1) ELSE 2 * m END
      + 51 * (k % 97 = 0)::INT + (k % 11 = 0)::INT + (s % 5 = 0)::INT + calls::INT AS loc
  FROM fns),
fl AS (
  SELECT b, bk, b || '_' || bk AS nm, sum(loc) AS floc, sum(com) AS fcom, sum(cyc - 1) AS fcyc,
    sum(cog) AS fcog, count(*) AS n, sum(doc) AS fdoc, bool_or(ev) AS ev FROM fn GROUP BY b, bk),
fc AS (SELECT *, 2 * b + 4 + (b % 2 = 0)::INT + (b % 3 = 0)::INT + (b % 4 = 0)::INT AS cloc,
  2 + (b % 7 = 0)::INT AS hloc FROM fl),
raw AS (
  SELECT 'file:brand_' || nm || '.py' AS code_id, 'file' AS kind, NULL AS parent_id, b, bk, nm, NULL::BIGINT AS k,
    1 + fcyc AS cyc, fcog AS cog, 2 + 5 * (b % 5 = 0)::INT + hloc + cloc + floc AS loc, fcom AS com,
    3 + (b % 5 = 0)::INT + b + n AS defs, (b % 2 = 0)::INT + fdoc AS documented, ev FROM fc
  UNION ALL SELECT 'class:Cls_' || nm, 'class', 'file:brand_' || nm || '.py', b, bk, nm, NULL,
    1, 0, cloc, 0, b + 2, (b % 2 = 0)::INT, false FROM fc
  UNION ALL SELECT 'method:Cls_' || nm || '.m' || j || '_' || nm, 'method', 'class:Cls_' || nm, b, bk, nm, NULL,
    1, 0, CASE WHEN j = 0 THEN 3 ELSE 2 END, 0, 1, 0, false
    FROM (SELECT *, unnest(range(0, b + 1)) AS j FROM fc)
  UNION ALL SELECT 'func:helper', 'func', 'file:brand_' || nm || '.py', b, bk, nm, NULL,
    1, 0, hloc, 0, 1, 0, false FROM fc
  UNION ALL SELECT 'func:create_' || nm, 'func', 'file:brand_' || nm || '.py', b, bk, nm, NULL,
    1, 0, 2, 0, 1, 0, false FROM fc WHERE b % 5 = 0
  UNION ALL SELECT 'func:fn_' || k, 'func', 'file:brand_' || b || '_' || bk || '.py', b, bk, b || '_' || bk, k,
    cyc, cog, loc, com, 1, doc, ev FROM fn),
scored AS (
  SELECT code_id, kind, parent_id, '/repo/brand_' || nm || '.py' AS path, b, bk, nm, k,
    CAST(cyc AS INT) AS cyclomatic, CAST(cog AS INT) AS cognitive, CAST(loc AS INT) AS loc,
    CAST(com AS INT) AS comments, com / (loc + com) AS comment_ratio,
    greatest(0.0, least(100.0, 171.0::DOUBLE - 5.2::DOUBLE * ln(greatest(cyc, 1)) - 0.23::DOUBLE * cyc
      - 16.2::DOUBLE * ln(greatest(loc, 1)))) AS maintainability,
    CASE WHEN ev THEN 1 ELSE 0 END AS issues,
    CASE WHEN kind = 'method' THEN 0.0
      ELSE least(1.0, (documented / defs + com / (loc + com)) / 2) END::DOUBLE AS doc_score
  FROM raw),
latest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY code_id ORDER BY path DESC) = 1)"""

# Smells of the raw nodes, one row each.
SMELLS_SQL = """per_fn AS (
  SELECT 'func:fn_' || k AS code_id, 'file:brand_' || b || '_' || bk || '.py' AS file_id, k, body, params, long FROM fn),
smells AS (
  SELECT unnest([code_id, file_id]) AS code_id, 'long_function' AS smell,
    'Function ''fn_' || k || ''' is too long (' || body || ' lines)' AS message FROM per_fn WHERE long
  UNION ALL SELECT unnest([code_id, file_id]), 'many_params',
    'Function ''fn_' || k || ''' has too many parameters (' || params || ')' FROM per_fn WHERE params > 5
  UNION ALL SELECT unnest(['class:Cls_' || nm, 'file:brand_' || nm || '.py']), 'large_class',
    'Class ''Cls_' || nm || ''' has too many methods (' || (b + 1) || ')' FROM fc WHERE b + 1 > 20
  UNION ALL SELECT 'file:brand_' || nm || '.py', 'unused_import', 'Possibly unused import: json' FROM fc
  UNION ALL SELECT 'file:brand_' || nm || '.py', 'duplicate_line',
    'Duplicated code detected at line 3' FROM fc WHERE b % 5 = 0)"""
