"""Keeping the rows of a table that an operator has decided for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def row_hash(id_col: str, text_col: str) -> Column:
    """Tells rows with equal ids and different texts apart."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores as it takes to be none of the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def keep_rows(docs: DataFrame, named: DataFrame, how: str = "left_semi", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose ``(id, row)`` is in ``named``, or isn't (``left_anti``); ``row`` is :func:`row_hash`.

    Columns stay as they are, whatever their names. Rows that repeat stay or go together, a null id is
    a value like others, and an empty table gives no rows.
    """
    own, its_id, its_row = free(docs, "own", "its_id", "its_row")
    its = named.select(F.col(id_col).alias(its_id), F.col("row").alias(its_row)).distinct()
    same = (F.col(own) == F.col(its_row)) & F.col(id_col).eqNullSafe(F.col(its_id))
    return docs.withColumn(own, row_hash(id_col, text_col)).join(its, same, how).drop(own)
