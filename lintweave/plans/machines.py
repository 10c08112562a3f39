"""State machines made of customers' orders: cycles and the audit of properties.

A customer's orders, by key, are its machine's states. Each leads to the next, finished ones also to the one after that;
the last order of every other customer leads back to the first. The second order is initial, if there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintweave.operators import ctl
from lintweave.sources.tables import table
from lintweave.sources.work import Work

FORMULAS = {
    "calm": ("AG", ("not", ("and", ("p", "open"), ("p", "urgent")))),
    "finishes": ("AF", ("p", "finished")),
    "can_finish": ("EF", ("p", "finished")),
    "reopens": ("AG", ("EF", ("p", "open"))),
    "never_open": ("EG", ("not", ("p", "open"))),
    "responds": ("AG", ("imply", ("p", "urgent"), ("AF", ("p", "finished")))),
    "stays_open": ("EG", ("p", "open")),
    "not_open": ("not", ("p", "open")),
    "until": ("AU", ("p", "open"), ("p", "finished")),
    "sent_back": ("AG", ("EF", ("p", "returned"))),
}
#: property, kind, expect, note, formula, violation
PROPERTIES = [
    ("calm", "safety", True, None, "calm", None), ("finishes", "liveness", True, None, "finishes", None), ("can_finish", "liveness", True, None, "can_finish", None),
    ("reopens", "safety", True, None, "reopens", "never_open"), ("responds", "response", True, None, "responds", None), ("stays_open", "other", False, "orders may wait", "stays_open", "not_open"),
    ("until", "progress", True, None, "until", None), ("sent_back", "safety", True, None, "sent_back", None), ("shapeless", "mutual_exclusion", True, None, "reopens", None),
]


def _machines(spark: SparkSession, sf_dir: str) -> ctl.Machines:
    work = Work(spark, "machines")
    orders = table(spark, sf_dir, "orders").filter("o_custkey IS NOT NULL")
    own = Window.partitionBy("o_custkey")
    rows = orders.select(F.col("o_custkey").alias("model"), (F.row_number().over(own.orderBy("o_orderkey")) - 1).cast("long").alias("state"), F.count(F.lit(1)).over(own).alias("n"), "o_orderstatus", "o_orderpriority")
    rows = work.put(rows)
    onward = F.array(F.when(F.col("state") + 1 < F.col("n"), F.col("state") + 1), F.when((F.col("state") + 2 < F.col("n")) & (F.col("o_orderstatus") == "F"), F.col("state") + 2), F.when((F.col("state") + 1 == F.col("n")) & (F.col("model") % 2 == 0), F.lit(0).cast("long")))
    edges = rows.select("model", F.col("state").alias("source"), F.explode(onward).alias("target")).filter("target IS NOT NULL")
    said = F.array(F.when(F.col("o_orderstatus") == "F", "finished"), F.when(F.col("o_orderstatus") == "O", "open"), F.when(F.startswith("o_orderpriority", F.lit("1")), "urgent"))
    labels = rows.select("model", "state", F.explode(said).alias("proposition")).filter("proposition IS NOT NULL")
    initial = rows.filter("state = least(1, n - 1)").select("model", "state")
    return ctl.Machines(rows.select("model", "state"), initial, edges, labels, work)


def machine_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each machine's strongly connected components, states on cycles, and the largest component."""
    m = _machines(spark, sf_dir)
    found = ctl.components(m.states, m.transitions, m.work)
    per = found.groupBy("model", "component").agg(F.count(F.lit(1)).alias("n"), F.count_if("cyclic").alias("cyclic"))
    return per.groupBy("model").agg(F.sum("n").alias("states"), F.count(F.lit(1)).alias("components"), F.sum("cyclic").alias("cyclic"), F.max("n").alias("largest"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _machines(spark, sf_dir)
    asked = F.broadcast(spark.createDataFrame(PROPERTIES, "property string, kind string, expect boolean, note string, formula string, violation string"))
    return ctl.audit(m, m.states.select("model").distinct().crossJoin(asked), FORMULAS)


def ctl_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each property of each machine."""
    return _audited(spark, sf_dir).select("model", "property", "status", "reason", F.array_join(F.coalesce("orphans", F.array().cast("array<string>")), ",").alias("orphans"))


QUERIES = {f.__name__: f for f in (machine_cycles, ctl_audit)}
# by transitive closures within sets of states, not by fixpoints
_M = """WITH RECURSIVE o AS (SELECT o_custkey AS model, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS state, count(*) OVER (PARTITION BY o_custkey) AS n,
        o_orderstatus = 'F' AS fin, o_orderstatus = 'O' AS opn, starts_with(o_orderpriority, '1') AS urg FROM orders WHERE o_custkey IS NOT NULL),
    t AS (SELECT model, state AS a, state + 1 AS b FROM o WHERE state + 1 < n UNION SELECT model, state, state + 2 FROM o WHERE fin AND state + 2 < n UNION SELECT model, state, 0 FROM o WHERE state = n - 1 AND model % 2 = 0)"""
ORACLE_SQL = {
    "machine_cycles": _M + """, r AS (SELECT model, a, b FROM t UNION SELECT r.model, r.a, t.b FROM r JOIN t ON t.model = r.model AND t.a = r.b),
        c AS (SELECT o.model, o.state, least(o.state, coalesce(min(r.b) FILTER (WHERE s.a IS NOT NULL), o.state)) AS component, count(*) FILTER (WHERE r.b = o.state) > 0 AS cyclic
              FROM o LEFT JOIN r ON r.model = o.model AND r.a = o.state LEFT JOIN r s ON s.model = o.model AND s.a = r.b AND s.b = o.state GROUP BY o.model, o.state)
        SELECT model, sum(n)::BIGINT AS states, count(*) AS components, sum(k)::BIGINT AS cyclic, max(n) AS largest FROM (SELECT model, component, count(*) AS n, count(*) FILTER (WHERE cyclic) AS k FROM c GROUP BY 1, 2) GROUP BY model""",
    "ctl_audit": _M + """, q AS (SELECT 'all' AS q, model, state FROM o UNION ALL SELECT 'nf', model, state FROM o WHERE NOT fin UNION ALL SELECT 'no', model, state FROM o WHERE NOT opn UNION ALL SELECT 'op', model, state FROM o WHERE opn),
        e AS (SELECT x.q, t.* FROM t JOIN q x ON x.model = t.model AND x.state = t.a JOIN q y ON y.q = x.q AND y.model = t.model AND y.state = t.b),
        r AS (SELECT q, model, a, b FROM e UNION SELECT r.q, r.model, r.a, e.b FROM r JOIN e ON e.q = r.q AND e.model = r.model AND e.a = r.b),
        z AS (SELECT q, model, a, b FROM r UNION ALL SELECT q, model, state, state FROM q),
        dead AS (SELECT model, state FROM o ANTI JOIN t ON t.model = o.model AND t.a = o.state),
        goal AS (SELECT q, model, a AS state FROM r WHERE a = b UNION SELECT q.q, q.model, q.state FROM q JOIN dead USING (model, state)),
        eg AS (SELECT DISTINCT z.q, z.model, z.a AS state FROM z JOIN goal g ON g.q = z.q AND g.model = z.model AND g.state = z.b),
        i AS (SELECT *, EXISTS (SELECT 1 FROM eg WHERE eg.q = 'nf' AND eg.model = o.model AND eg.state = o.state) AS eg_nf, EXISTS (SELECT 1 FROM eg WHERE eg.q = 'op' AND eg.model = o.model AND eg.state = o.state) AS eg_op,
              EXISTS (SELECT 1 FROM eg WHERE eg.q = 'no' AND eg.model = o.model AND eg.state = o.state) AS eg_no FROM o),
        w AS (SELECT i.model, i.state, bool_or(y.opn) AS ef_open FROM i JOIN z ON z.q = 'all' AND z.model = i.model AND z.a = i.state JOIN o y ON y.model = z.model AND y.state = z.b GROUP BY 1, 2),
        u AS (SELECT i.model, i.state, bool_or(NOT y.opn AND NOT y.fin) AS lost FROM i JOIN (SELECT model, a, b FROM r WHERE q = 'nf' UNION ALL SELECT model, state, state FROM o WHERE NOT fin) z ON z.model = i.model AND z.a = i.state JOIN o y ON y.model = z.model AND y.state = z.b GROUP BY 1, 2),
        g AS (SELECT s.model, s.state, s.fin, s.eg_nf, s.eg_op, coalesce(u.lost, FALSE) AS lost, bool_or(y.opn AND y.urg) AS hits, bool_or(y.urg AND y.eg_nf) AS waits, bool_and(w.ef_open) AS reopens
              FROM i s JOIN z ON z.q = 'all' AND z.model = s.model AND z.a = s.state JOIN i y ON y.model = s.model AND y.state = z.b JOIN w ON w.model = y.model AND w.state = y.state LEFT JOIN u ON u.model = s.model AND u.state = s.state
              WHERE s.state = least(1, s.n - 1) GROUP BY ALL),
        m AS (SELECT model, bool_or(fin) AS has_fin, bool_or(opn) AS has_open, bool_or(urg) AS has_urg, bool_or(opn AND urg) AS clash, bool_or(eg_no) AS some_no, bool_or(NOT opn) AS some_closed FROM i GROUP BY model),
        p AS (SELECT m.*, g.* EXCLUDE (model), unnest(['calm', 'finishes', 'can_finish', 'reopens', 'responds', 'stays_open', 'until', 'sent_back', 'shapeless']) AS property FROM m JOIN g USING (model)),
        orph AS (SELECT *, list_sort(list_filter(CASE property WHEN 'calm' THEN [if(has_open, NULL, 'open'), if(has_urg, NULL, 'urgent')] WHEN 'finishes' THEN [if(has_fin, NULL, 'finished')] WHEN 'can_finish' THEN [if(has_fin, NULL, 'finished')]
              WHEN 'responds' THEN [if(has_urg, NULL, 'urgent'), if(has_fin, NULL, 'finished')] WHEN 'until' THEN [if(has_open, NULL, 'open'), if(has_fin, NULL, 'finished')] WHEN 'sent_back' THEN ['returned'] ELSE [if(has_open, NULL, 'open')] END, lambda x: x IS NOT NULL)) AS orphans FROM p),
        v AS (SELECT *, CASE WHEN len(orphans) > 0 THEN 'INVALID:undefined proposition' WHEN property = 'can_finish' THEN 'INVALID:only possible progress' WHEN property = 'shapeless' THEN 'INVALID:no violation'
              WHEN property = 'calm' THEN CASE WHEN NOT clash THEN 'VACUOUS:impossible violation' WHEN hits THEN 'FAIL:fails' ELSE 'PASS:holds' END
              WHEN property = 'finishes' THEN CASE WHEN eg_nf THEN 'FAIL:fails' ELSE 'PASS:holds' END
              WHEN property = 'reopens' THEN CASE WHEN NOT some_no THEN 'VACUOUS:impossible violation' WHEN reopens THEN 'PASS:holds' ELSE 'FAIL:fails' END
              WHEN property = 'responds' THEN CASE WHEN waits THEN 'FAIL:fails' ELSE 'PASS:holds' END
              WHEN property = 'stays_open' THEN CASE WHEN NOT some_closed THEN 'VACUOUS:impossible violation' WHEN eg_op THEN 'FAIL:holds' ELSE 'REFUTED:fails as expected' END
              ELSE CASE WHEN NOT fin AND (lost OR eg_nf) THEN 'FAIL:fails' ELSE 'PASS:holds' END END AS said FROM orph)
        SELECT model, property, split_part(said, ':', 1) AS status, split_part(said, ':', 2) AS reason, array_to_string(orphans, ',') AS orphans FROM v""",
}
