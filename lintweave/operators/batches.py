"""Greedy batches under a budget.

A batch ends before the row that would take it over the budget, or after so many rows, and the next begins there: a window
can't say where, since a sum that starts again depends on all batches before. So rows are dealt by key and sorted once, and
a task goes through them in order with the running batch's sum and number; nothing of a key is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int | Column, most: int) -> DataFrame:
    """Adds batch, from 0, to rows; by keys, in order. A row that is larger than the budget is a batch of its own.

    size isn't negative, null is 0; order tells a key's rows apart; a budget may be a column that is the same in all of a
    key's rows. A key's rows go through one task, one Arrow batch at a time.
    """
    own = Window.partitionBy(*keys).orderBy(*order)
    room = F.lit(budget) if isinstance(budget, int) else budget
    sized = rows.select("*", F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("_size"), F.coalesce(room.cast("long"), F.lit(-1).cast("long")).alias("_room"))
    placed = sized.withColumn("_first", F.row_number().over(own) == 1)
    names = rows.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = total = held = 0
        for part in parts:
            out = []
            for n, limit, first in zip(*(part.column(len(names) + i).to_pylist() for i in range(3)), strict=True):
                if first:
                    batch, total, held = 0, n, 1
                elif total + n > limit or held == most:
                    batch, total, held = batch + 1, n, 1
                else:
                    total, held = total + n, held + 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(out, pa.int32())], [*names, "batch"])

    return placed.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())]))


def requests(items: DataFrame, checks: DataFrame, budget: int, most: int) -> DataFrame:
    """(item_id, batch, check_ids, tokens) of items (item_id, mode, tokens) and checks (check_id, mode, enabled, tokens).

    A request holds the item and its checks: as many of them, in order, as fit the budget beside the item's own tokens, one at least.
    """
    both = items.withColumnRenamed("tokens", "item_tokens").join(checks.filter("enabled"), "mode")
    room = both.groupBy("item_id").agg(F.max("item_tokens").alias("item_tokens"))
    sizes = both.drop("item_tokens").join(room, "item_id")
    parts = greedy(sizes, ["item_id"], ["check_id"], F.col("tokens"), F.greatest(F.lit(0), F.lit(budget) - F.col("item_tokens")), most)
    return parts.groupBy("item_id", "batch").agg(F.array_sort(F.collect_list("check_id")).alias("check_ids"), (F.first("item_tokens") + F.sum("tokens")).alias("tokens"))
