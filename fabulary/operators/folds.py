"""Folds over ordered rows: order-dependent steps as one aggregate() over a sorted array.

Every group must be bounded by what a chapter or a book holds; the array of a group is small rows, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def greedy_batches(items: Column, most_chars: int, most_items: int | None = None) -> Column:
    """Batch numbers (from 0) of items struct(ord, n): a batch closes when the next item would pass a bound."""

    def step(acc: Column, x: Column) -> Column:
        full = (acc["size"] > 0) & (acc["chars"] + x["n"] > most_chars)
        if most_items:
            full = full | (acc["size"] >= most_items)
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(
            batch.alias("batch"), F.when(full, x["n"]).otherwise(acc["chars"] + x["n"]).alias("chars"), F.when(full, F.lit(1)).otherwise(acc["size"] + 1).alias("size"),
            F.concat(acc["out"], F.array(F.struct(x["ord"].alias("ord"), batch.alias("batch")))).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("bigint").alias("chars"), F.lit(0).alias("size"), F.expr("cast(array() as array<struct<ord:int,batch:int>>)").alias("out"))
    return F.aggregate(items, zero, step, lambda acc: acc["out"])


def competing(items: Column, proximity: int = 1) -> Column:
    """Of items struct(pid, score) in order: one within `proximity` of the last kept replaces it only if its score is higher."""

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        near = (F.size(acc) > 0) & (x["pid"] - last["pid"] <= proximity)
        return F.when(near & (x["score"] > last["score"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(x))).when(near, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(items, F.expr("cast(array() as array<struct<pid:int,score:double>>)"), step)


def place_track(items: Column, set_at: float = 2.0, shift_at: float = 3.0, carry: int = 1) -> Column:
    """Of frames struct(pid, best, score) in order, best null where nothing was seen: struct(pid, place, place_set, shift_from, shift_to).

    A place is set at `set_at`, changes at `shift_at`, and is carried over `carry` paragraphs without any sight.
    """

    def step(acc: Column, x: Column) -> Column:
        seen, has = x["best"].isNotNull(), acc["place"].isNotNull()
        sets = seen & ~has & (x["score"] >= set_at)
        shifts = seen & has & (x["best"] != acc["place"]) & (x["score"] >= shift_at)
        now = F.when(sets | shifts, x["best"]).otherwise(acc["place"])
        last = F.when(seen, x["pid"]).otherwise(acc["last"])
        shown = F.when(seen, now).when(has & (x["pid"] - acc["last"] <= carry), acc["place"])
        row = F.struct(x["pid"].alias("pid"), shown.alias("place"), F.when(sets, x["best"]).alias("place_set"), F.when(shifts, acc["place"]).alias("shift_from"), F.when(shifts, x["best"]).alias("shift_to"))
        return F.struct(now.alias("place"), last.alias("last"), F.concat(acc["out"], F.array(row)).alias("out"))

    zero = F.expr("named_struct('place', cast(null as string), 'last', cast(null as int), 'out', cast(array() as array<struct<pid:int,place:string,place_set:string,shift_from:string,shift_to:string>>))")
    return F.aggregate(items, zero, step, lambda acc: acc["out"])
