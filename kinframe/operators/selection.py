"""Selections as an append-only log of steps, with undo.

A log has (session, seq, path, checked): the rows of one (session, seq) are a step, whose paths it sets; a step of a null path
is an undo, which takes back the last step of its session that still stands. A session remembers its last 200 steps;
an undo beyond them does nothing. ``seq`` orders a session's steps; a null session is a session like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps that a session can take back.
STEPS = 200
#: Steps of a session are summed in stretches of 2^16 numbers, so that a long session isn't one task.
STRETCH = 16
#: A step may set any number of paths, so its rows meet the undone steps in this many places.
SPREAD = 32


def changes(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, checked) of the wanted rows that differ from the state: what a step logs. If none do, it isn't a step.

    Paths that the state lacks or null paths are left out; of repeated paths that disagree, checked wins.
    """
    asked = wanted.groupBy("path").agg(F.max("checked").alias("checked"))
    now = state.select("path", F.col("checked").alias("_now")).distinct()
    return asked.join(now, "path").where(~F.col("checked").eqNullSafe(F.col("_now"))).select("path", "checked")


def steps(log: DataFrame, keep: int = STEPS) -> DataFrame:
    """(session, seq, undo, undone) of every step: undone ones were taken back.

    Steps and undos are the brackets of a session. The height of a step is how many stand when it is made (undos of
    an empty session don't count), from prefix sums and running minima, in stretches first and then over their totals. A step of
    height h is taken back by the next undo that finds height h, unless a step of height h + keep comes before and
    pushes it out of the memory; so the next row of the same height modulo ``keep`` tells.
    """
    if keep < 1:
        raise ValueError("a session must remember a step")
    rows = log.groupBy("session", "seq").agg(F.every(F.col("path").isNull()).alias("undo"))
    rows = rows.withColumns({"_s": F.shiftright(F.col("seq").cast("long"), STRETCH), "_d": F.when(F.col("undo"), -1).otherwise(1).cast("long")})
    inside = Window.partitionBy("session", "_s").orderBy("seq")
    rows = rows.withColumn("_p", F.sum("_d").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_low", F.coalesce(F.min("_p").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = Window.partitionBy("session").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("session", "_s").agg(F.sum("_d").alias("_t"), F.min("_p").alias("_m"))
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    totals = totals.withColumn("_least", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("_m")).over(before), F.lit(0))))
    t = totals.select(F.col("session").alias("_k"), F.col("_s").alias("_ks"), "_base", "_least")
    rows = rows.join(t, F.col("session").eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_ks")))
    height = F.col("_base") + F.col("_p") - F.least("_least", F.col("_base") + F.col("_low")) + F.col("undo").cast("int")
    rows = rows.withColumn("_h", height)
    same = Window.partitionBy("session", F.pmod("_h", F.lit(keep)), F.col("_h") > 0).orderBy("seq")
    undone = ~F.col("undo") & F.coalesce(F.lead("undo").over(same) & (F.lead("_h").over(same) == F.col("_h")), F.lit(False))
    return rows.select("session", "seq", "undo", undone.alias("undone"))


def selected(log: DataFrame, keep: int = STEPS, until: int | None = None) -> DataFrame:
    """(session, path, checked): what every path that a standing step has set is now, or was after step number ``until``.

    Later steps win; of rows of one step that disagree about a path, checked wins. Paths whose steps were all taken back
    are absent: they are what they were at first.
    """
    log = log if until is None else log.where(F.col("seq") <= until)
    gone = steps(log, keep).where("undone").select(F.col("session").alias("_k"), F.col("seq").alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_at"))
    rows = log.where("path is not null").withColumn("_place", F.pmod(F.xxhash64("path"), F.lit(SPREAD)).cast("int"))
    rows = rows.join(gone, F.col("session").eqNullSafe(F.col("_k")) & (F.col("seq") == F.col("_q")) & (F.col("_place") == F.col("_at")), "left_anti")
    return rows.groupBy("session", "path").agg(F.max(F.struct("seq", "checked"))["checked"].alias("checked"))


def apply_log(items: DataFrame, log: DataFrame, session, keep: int = STEPS, until: int | None = None) -> DataFrame:
    """items (path, checked) as one session's log leaves them."""
    now = selected(log.where(F.col("session").eqNullSafe(F.lit(session))), keep, until)
    now = now.select(F.col("path").alias("_path"), F.col("checked").alias("_checked"))
    return items.join(now, F.col("path") == F.col("_path"), "left").withColumn("checked", F.coalesce("_checked", "checked")).drop("_path", "_checked")
