"""Files that the driver's tables are written to, chosen by globs and read back; models among files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintweave.operators import formal
from lintweave.sources import files
from lintweave.sources.tables import table
from lintweave.sources.work import shared_folder

INCLUDE = ["source=src1/**", "**/lang=de/*.txt", "source=src1?/lang=f*/*"]
EXCLUDE = ["*=src12/*"]
PATTERNS = ["src1[45]/lang=(fr|en)"]


def files_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids and digests from the chosen of the files that hold them, a folder for each source and language."""
    root = f"{shared_folder(spark)}/lintweave-tree-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("source", "lang", F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce(F.sha2("text", 256), F.lit("none"))).alias("value"))
    docs.write.partitionBy("source", "lang").text(root)
    found = files.read_files(spark, root, INCLUDE, EXCLUDE, PATTERNS)
    lines = found.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.explode(F.split(F.trim("content", F.lit("\n")), "\n")).alias("line"))
    return lines.select("folder", F.split_part("line", F.lit(" "), F.lit(1)).cast("long").alias("doc_id"), F.split_part("line", F.lit(" "), F.lit(2)).alias("digest"))


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each third customer, in folders of models or others; it names two suppliers' documents."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").filter("k % 3 = 0")
    path = "'n' || (k % 5) || CASE k % 4 WHEN 0 THEN '/formal/m' WHEN 1 THEN '/formal/_m' WHEN 2 THEN '/lib/m' ELSE '/x/formal/m' END || k || '.py'"
    text = "'import x\\nBACKS = [\\n  \"s' || k || '.md\",\\n  ''s' || (k + 1) || '.md'',\\n]\\nBACKS = [''s' || (k + 2) || '.md'']'"
    return rows.selectExpr(f"{path} AS path", f"{text} AS content")


def model_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models among the files, and the documents that they back."""
    return formal.scripts(_scripts(spark, sf_dir)).select("model", F.array_join("backs", ",").alias("backs"))


def model_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged documents of customers that no model names and that have none beside them or above."""
    where = "CASE WHEN c_custkey % 7 = 0 THEN 'n' || (c_custkey % 10) || '/x/s' WHEN c_custkey % 7 = 1 THEN 'n' || (c_custkey % 10) || '/s' ELSE 's' END || c_custkey || '.md'"
    docs = table(spark, sf_dir, "customer").selectExpr(f"{where} AS path", "IF(c_custkey % 2 = 0, array('VERIFY_FORMAL'), array('VERIFY_WIT')) AS tags")
    return formal.missing_models(docs, formal.scripts(_scripts(spark, sf_dir))).select("severity", "path", "line", "rule_code", "message")


QUERIES = {f.__name__: f for f in (files_chosen, model_scripts, model_missing)}
_M = """m AS (SELECT k, 'n' || (k % 5) || CASE k % 4 WHEN 0 THEN '/formal' ELSE '/x/formal' END AS folder FROM (SELECT c_custkey AS k FROM customer) WHERE k % 3 = 0 AND k % 4 IN (0, 3))"""
ORACLE_SQL = {
    "files_chosen": """SELECT 'source=' || source || '/lang=' || lang AS folder, doc_id, coalesce(sha256(text), 'none') AS digest FROM documents
        WHERE (source = 'src1' OR lang = 'de' OR (source LIKE 'src1_' AND lang LIKE 'f%')) AND source <> 'src12' AND NOT (source IN ('src14', 'src15') AND lang IN ('fr', 'en'))""",
    "model_scripts": f"WITH {_M} SELECT folder || '/m' || k || '.py' AS model, 's' || k || '.md,s' || (k + 1) || '.md' AS backs FROM m",
    "model_missing": f"""WITH {_M}, d AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 < 2 THEN 'n' || (c_custkey % 10) END AS top, CASE WHEN c_custkey % 7 = 0 THEN '/x/s' WHEN c_custkey % 7 = 1 THEN '/s' ELSE 's' END || c_custkey || '.md' AS name,
        c_custkey % 7 AS w FROM customer WHERE c_custkey % 2 = 0)
        SELECT 'ERROR' AS severity, coalesce(top, '') || name AS path, CAST(1 AS INTEGER) AS line, 'FORMAL-MODEL-NOT-FOUND' AS rule_code, 'VERIFY_FORMAL without a model' AS message FROM d
        WHERE NOT (w >= 2 AND (k IN (SELECT k FROM m) OR k - 1 IN (SELECT k FROM m)))
        AND NOT (w = 0 AND (top || '/formal' IN (SELECT folder FROM m) OR top || '/x/formal' IN (SELECT folder FROM m))) AND NOT (w = 1 AND top || '/formal' IN (SELECT folder FROM m))""",
}
