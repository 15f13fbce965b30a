"""Corpora derived from the driver's tables, in SQL that Spark and DuckDB both read. Whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import php_corpora as P

COMMENTS = """
SELECT 'src/mod' || CAST(o_custkey % 50 AS VARCHAR(20)) || '.php' AS path, CAST(n - 1 AS INT) AS pos, CAST(n + gap AS INT) AS line,
  CASE k % 11 WHEN 0 THEN '// TODO fix ' || CAST(k AS VARCHAR(20)) WHEN 1 THEN '// @phpstan-ignore-next-line' WHEN 2 THEN '// @phpstan-ignore argument.type (legacy)'
    WHEN 3 THEN '// return transform($x' || CAST(k AS VARCHAR(20)) || ');' WHEN 4 THEN '// étodo hacks' WHEN 5 THEN '/** @psalm-suppress Mixed */' WHEN 6 THEN '# temporary'
    WHEN 7 THEN '// @phpstan-ignore' WHEN 8 THEN '/* @quality-ignore rule.one, rule.two (known) */' WHEN 9 THEN '// if the cache is warm' ELSE '// plain prose' END AS text
FROM (SELECT o_custkey, o_orderkey AS k, row_number() OVER w AS n, sum(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) OVER w AS gap
      FROM orders WINDOW w AS (PARTITION BY o_custkey % 50 ORDER BY o_orderkey))
"""

MD_FILES = """
SELECT source || '/' || lang || '/' || CASE doc_id % 3 WHEN 0 THEN 'summary-' WHEN 1 THEN 'guide-' ELSE 'task_' END || CAST(doc_id AS VARCHAR(20)) || '.md' AS path,
  '# Summary' || chr(10) || '- [x] Updated changes' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '## Notes: follow-up' || chr(10) || '* [ ] Validation' || chr(10) END
  || CASE WHEN doc_id % 7 = 0 THEN 'See `run` in src/app.php and [docs](x.md)' || chr(10) ELSE 'Implemented things' || chr(13) || chr(10) END
  || CASE WHEN doc_id % 4 = 0 THEN text ELSE '```' || chr(10) || text || chr(10) || '```' END || chr(10) || 'Completed work' || chr(10) || '- Plan' AS text
FROM documents
"""

FILES = """
SELECT CASE doc_id % 6 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'src/vendor/' ELSE 'src/' END || source || '/' || lang || CAST(doc_id % 7 AS VARCHAR(20)) || '/f' || CAST(doc_id AS VARCHAR(20))
  || CASE doc_id % 5 WHEN 0 THEN '.PHP' WHEN 1 THEN '.md' WHEN 2 THEN '.generated.php' WHEN 3 THEN '.txt' ELSE '.inc' END AS path, text, doc_id FROM documents
"""

FUNCTIONS = """
SELECT 'src/' || source || '/' || lang || '/' || CAST(doc_id % 3 AS VARCHAR(20)) || '/F' || CAST(doc_id AS VARCHAR(20)) || '.php' AS path, CAST(doc_id % 9 AS INT) AS pos, CAST(doc_id % 200 + 1 AS INT) AS line,
  CASE doc_id % 7 WHEN 0 THEN '__construct' WHEN 1 THEN 'isReady' || CAST(doc_id % 10 AS VARCHAR(20)) WHEN 2 THEN 'get_item_name' WHEN 3 THEN 'Setup' ELSE 'run' || CAST(doc_id % 40 AS VARCHAR(20)) END AS name,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'FakeStore' ELSE 'Store' END AS class_name, CASE doc_id % 5 WHEN 0 THEN 'interface' WHEN 1 THEN 'abstract-class' WHEN 2 THEN NULL ELSE 'class' END AS class_kind,
  CASE doc_id % 3 WHEN 0 THEN 'App' WHEN 1 THEN 'Lib' ELSE NULL END AS namespace_name, CASE WHEN doc_id % 8 = 0 THEN '' ELSE text END AS body,
  CASE doc_id % 6 WHEN 0 THEN 'false' WHEN 1 THEN 'zero' WHEN 2 THEN 'null' WHEN 3 THEN 'empty-string' ELSE NULL END AS constant_return,
  'store::run' || CAST(doc_id % 300 AS VARCHAR(20)) || '(1)' AS signature, doc_id FROM documents
"""

SETUPS = """
SELECT 'tests/T' || CAST(o_custkey % 97 AS VARCHAR(20)) || 'Test.php' AS path, CAST(o_orderkey % 500 + 1 AS INT) AS line,
  CASE o_orderkey % 2 WHEN 0 THEN 'method|willReturn' ELSE 'getMockBuilder|getMock' END AS label,
  CASE o_orderkey % 2 WHEN 0 THEN 'method|willReturn' ELSE 'getMockBuilder|getMock' END || '::' || CAST(o_orderkey % 2003 AS VARCHAR(20)) AS fingerprint FROM orders
"""

CATCHES = """
SELECT 'src/c' || CAST(l_partkey % 300 AS VARCHAR(20)) || '.php' AS path, l_orderkey AS k, l_linenumber AS line, CASE l_suppkey % 4 WHEN 0 THEN 'error_log' WHEN 1 THEN 'handle' WHEN 2 THEN 'echo' ELSE 'retry' END AS call,
  CAST(l_quantity AS INT) % 3 = 0 AS has_throw, l_linenumber % 2 = 0 AS has_return, CAST(l_quantity AS INT) % 5 AS statements FROM lineitem
"""

_FINDINGS = """
SELECT 'rule.' || event_type AS rule_id, 'Found ' || event_type || ' ' || CAST(event_id % 997 AS VARCHAR(20)) AS message, 'src/d' || CAST(user_id % 11 AS VARCHAR(20)) || '/f' || CAST(user_id % 40 AS VARCHAR(20)) || '.php' AS path,
  CAST({line} AS INT) AS line, {evidence} AS item, CAST(event_id % 9 AS DOUBLE) * 0.25 AS score, event_id AS k FROM events {where}
"""
HEAD = _FINDINGS.format(line="event_id % 100000 + 1", evidence="'e=' || CAST(event_id % 3 AS VARCHAR(20))", where="")
BASE = _FINDINGS.format(
    line="CASE WHEN event_id % 7 = 0 THEN event_id % 100000 + 1001 ELSE event_id % 100000 + 1 END",
    evidence="CASE WHEN event_id % 11 = 0 THEN 'e=old' ELSE 'e=' || CAST(event_id % 3 AS VARCHAR(20)) END",
    where="WHERE event_id % 13 <> 0",  # what the head has added since
)

_TABLES = {COMMENTS: ["orders"], MD_FILES: ["documents"], FILES: ["documents"], FUNCTIONS: ["documents"], SETUPS: ["orders"], CATCHES: ["lineitem"], HEAD: ["events"], BASE: ["events"]} | {s: ["documents"] for s in P.PHP_SOURCES}


def spread(table: DataFrame) -> DataFrame:
    """A scan's rows over all cores if it has fewer splits than there are cores, as small tables do; else as it is, unshuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def corpus(spark: SparkSession, sf_dir: str, sql: str, heavy: bool = False) -> DataFrame:
    """The corpus of one of the statements above over a folder's tables; ``heavy`` if each row takes a Python worker long."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _TABLES[sql]}
    if heavy:
        tables = {name: spread(t) for name, t in tables.items()}
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **tables)


def findings(rows: DataFrame) -> DataFrame:
    """Findings of (rule_id, message, path, line, item, score, k) rows."""
    place = F.array(F.struct(F.col("path").alias("path"), F.col("line").alias("line"), F.lit(1).alias("column")))
    order = F.struct(F.lit(0).alias("phase"), F.col("path").alias("unit"), F.lit(0).alias("rule"), F.lit(None).cast("string").alias("key"), F.col("k").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    return rows.select(
        "rule_id", F.lit("events").alias("family"), F.lit("medium").alias("severity"), F.lit("file").alias("scope"), "message", F.array("item").alias("evidence"), "score", place.alias("locations"), "path", order.alias("ord")
    )
