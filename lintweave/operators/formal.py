"""State machines as tables: soundness, branching temporal properties, mutation of guards.

states and initial (model, state), transitions (model, source, target, guarded), labels (model, state, proposition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reach import reachable


def _edges(transitions: DataFrame) -> DataFrame:
    return transitions.select("model", "source", "target").distinct()


def soundness(states: DataFrame, initial: DataFrame, transitions: DataFrame, min_states: int = 2) -> DataFrame:
    """(model, states, unreachable, branching, verdict); self-loops don't count as branching."""
    seen = reachable(initial, _edges(transitions)).withColumn("seen", F.lit(1))
    per = states.distinct().join(seen, ["model", "state"], "left").groupBy("model").agg(F.count(F.lit(1)).alias("states"), F.count_if(F.col("seen").isNull()).alias("unreachable"))
    ways = _edges(transitions).filter("source <> target").groupBy("model", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("model").agg(F.max("n").alias("branching"))
    rows = per.join(ways, "model", "left").withColumn("branching", F.coalesce("branching", F.lit(0)))
    return rows.withColumn("verdict", F.when((F.col("states") < min_states) | (F.col("unreachable") > 0), "UNSOUND").when(F.col("branching") < 2, "VACUOUS").otherwise("PASS"))


def eventually(holds: DataFrame, transitions: DataFrame) -> DataFrame:
    """(model, state) from which a state of holds can be reached (EF)."""
    back = transitions.select("model", F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    return reachable(holds, back)


def always(states: DataFrame, holds: DataFrame, transitions: DataFrame) -> DataFrame:
    """(model, state) from which every reachable state is in holds (AG)."""
    other = states.distinct().join(holds, ["model", "state"], "left_anti")
    return states.distinct().join(eventually(other, transitions), ["model", "state"], "left_anti")


def inevitable(states: DataFrame, holds: DataFrame, transitions: DataFrame, limit: int = 1000) -> DataFrame:
    """(model, state) from which every path comes to a state of holds (AF): a state joins once all its successors have.

    A state without successors doesn't lead anywhere.
    """
    edges = _edges(transitions)
    degree = edges.groupBy("model", F.col("source").alias("state")).agg(F.count(F.lit(1)).alias("ways"))
    folder = states.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    keep = (lambda df: df.checkpoint()) if folder else (lambda df: df.persist())
    known = keep(holds.select("model", "state").distinct())
    for _ in range(limit):
        into = edges.join(known.withColumnRenamed("state", "target"), ["model", "target"]).groupBy("model", F.col("source").alias("state")).agg(F.count(F.lit(1)).alias("n"))
        new = keep(into.join(degree, ["model", "state"]).filter("n = ways").select("model", "state").join(known, ["model", "state"], "left_anti"))
        if not new.limit(1).count():
            return known
        known = keep(known.unionByName(new))
    raise ValueError(f"more than {limit} rounds")


def mutation(initial: DataFrame, transitions: DataFrame, violations: DataFrame) -> DataFrame:
    """(model, with_guards, without_guards, verdict): whether a violation is reached; a guard works if only without it."""
    hit = lambda t, name: reachable(initial, _edges(t)).join(violations, ["model", "state"], "left_semi").select("model").distinct().withColumn(name, F.lit(True))
    models = initial.select("model").distinct()
    rows = models.join(hit(transitions.filter("NOT guarded"), "with_guards"), "model", "left").join(hit(transitions, "without_guards"), "model", "left").fillna(False)
    verdict = F.when(F.col("with_guards"), "VIOLATED").when(F.col("without_guards"), "EFFECTIVE").otherwise("USELESS")
    return rows.withColumn("verdict", verdict)


def _inside(models: DataFrame, folder: str) -> DataFrame:
    """(model, own) of models in a folder of that name, but for those whose file name begins with an underscore."""
    known = models.filter(~F.substring_index("model", "/", -1).startswith("_"))
    return known.select("model", F.regexp_replace("model", "/?[^/]*$", "").alias("own")).filter(F.substring_index("own", "/", -1) == folder)


def nearest(documents: DataFrame, models: DataFrame, folder: str = "formal") -> DataFrame:
    """(path, own): the deepest folder with models beside a document or beside one that it lies in; one row a document, however many models there are."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.size(parts) - 1, F.lit(0)), lambda i: F.array_join(F.concat(F.slice(parts, 1, i), F.array(F.lit(folder))), "/"))
    asked = documents.select("path", F.explode(above).alias("own"))
    return asked.join(_inside(models, folder).select("own").distinct(), "own").groupBy("path").agg(F.max_by("own", F.size(F.split("own", "/"))).alias("own"))


def backing(documents: DataFrame, models: DataFrame, folder: str = "formal") -> DataFrame:
    """(path, model) of documents (path): the models (model, backs) that name the document, else those of the nearest
    folder of that name, beside the document or beside one of the folders that it lies in.

    Models whose file name begins with an underscore aren't any. Folders are found by an equi-join on each document's own
    folders, of which the deepest that has models counts.
    """
    known = models.filter(~F.substring_index("model", "/", -1).startswith("_"))
    named = known.select("model", F.explode("backs").alias("path")).join(documents.select("path"), "path").select("path", "model").distinct()
    rest = documents.select("path").join(named.select("path").distinct(), "path", "left_anti")
    return named.unionByName(nearest(rest, models, folder).join(_inside(models, folder), "own").select("path", "model"))


def ambiguous_backing(found: DataFrame, models: DataFrame) -> DataFrame:
    """(path, folder, n_documents) of documents that share a folder of models with others and that no model there names."""
    folder = F.regexp_replace("model", "/?[^/]*$", "")
    claims = found.select("path", folder.alias("folder")).distinct()
    shared = claims.groupBy("folder").agg(F.count(F.lit(1)).alias("n_documents")).filter("n_documents > 1")
    named = models.select(folder.alias("folder"), F.explode("backs").alias("path")).distinct()
    return claims.join(shared, "folder").join(named, ["path", "folder"], "left_anti").select("path", "folder", "n_documents")


def scripts(files: DataFrame, folder: str = "formal") -> DataFrame:
    """(model, backs) of files (path, content): Python files in a folder of that name, but for names that begin with an underscore.

    backs are the quoted names of the first list that is assigned to BACKS; the text is read, never run. A null content backs nothing.
    """
    mine = files.filter(F.col("path").rlike(rf"(^|/){folder}/[^/_][^/]*\.py$"))
    listed = F.regexp_extract(F.coalesce("content", F.lit("")), r"(?s)BACKS\s*=\s*\[(.*?)\]", 1)
    return mine.select(F.col("path").alias("model"), F.array_distinct(F.regexp_extract_all(listed, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))).alias("backs"))


def missing_models(documents: DataFrame, models: DataFrame, tag: str = "VERIFY_FORMAL", folder: str = "formal") -> DataFrame:
    """Issues at documents (path, tags) with the tag that no model backs: none names them, none is in a folder beside them or above,
    the folder right under the root not counted."""
    tagged = documents.filter(F.array_contains("tags", tag)).select("path")
    named = models.select(F.explode("backs").alias("path"))
    near = nearest(tagged, models, folder).filter(F.col("own") != folder).select("path")
    lost = tagged.join(named.unionByName(near).distinct(), "path", "left_anti")
    return lost.select(
        F.lit("Formal").alias("gate"), F.lit("ERROR").alias("severity"), "path", F.lit(1).alias("line"), F.lit("FORMAL-MODEL-NOT-FOUND").alias("rule_code"), F.lit(f"{tag} without a model").alias("message")
    )
