"""Statements that change rows and say how many: update, delete and merge as frames whose rows carry what becomes of them.

Nothing changes in place: ``write`` puts the new state to a path of its own and counts in the same pass what was changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ACTION = "action__"
KEPT, UPDATED, INSERTED, DELETED = "kept", "updated", "inserted", "deleted"


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that meet ``where`` (null: they do not) get these values, all computed from the old row."""
    hit = F.coalesce(where, F.lit(False))
    new = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns), F.when(hit, UPDATED).otherwise(KEPT).alias(ACTION))


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.withColumn(ACTION, F.when(F.coalesce(where, F.lit(False)), DELETED).otherwise(KEPT))


def merge(base: DataFrame, change: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of ``change`` (one for each key) in the place of those of equal key, and added where there is none.

    Nulls in keys are equal to empty strings and to each other. Base rows of one key are all replaced by the one row.
    """
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    names = [f"key_{i}__" for i in range(len(key))]
    old = base.select("*", *(k.alias(n) for k, n in zip(same, names, strict=True)))
    new = change.select(*base.columns, *(k.alias(n) for k, n in zip(same, names, strict=True)))
    kept = old.join(new.select(*names), names, "left_anti").select(*base.columns, F.lit(KEPT).alias(ACTION))
    there = old.select(*names, F.lit(True).alias("there__")).distinct()
    put = new.join(there, names, "left").select(*base.columns, F.when(F.col("there__"), UPDATED).otherwise(INSERTED).alias(ACTION))
    return kept.unionByName(put)


def result(changed: DataFrame) -> DataFrame:
    """The table after the statement."""
    return changed.where(F.col(ACTION) != DELETED).drop(ACTION)


def counts(changed: DataFrame) -> DataFrame:
    """One row: how many rows were updated, inserted and deleted."""
    return changed.agg(*(F.count_if(F.col(ACTION) == a).alias(a) for a in (UPDATED, INSERTED, DELETED)))


def write(changed: DataFrame, path: str) -> dict[str, int]:
    """Writes the table after the statement as Parquet to ``path``, which must not be there yet, and returns the counts."""
    seen = Observation(f"changes-{uuid.uuid4().hex}")
    counted = changed.observe(seen, *(F.count_if(F.col(ACTION) == a).alias(a) for a in (UPDATED, INSERTED, DELETED)))
    result(counted).write.parquet(path)
    return dict(seen.get)
