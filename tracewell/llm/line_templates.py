"""Recurring lines by a log-template tree of fixed depth.

Numbers in a line are fields, so digits are masked first. The tree has a fixed depth:
the number of words, then the first ``LEAD`` words; a line of fewer than
``LEAST_WORDS`` words is a leaf by itself. The words after the lead are cut into four
parts, any two of which may be variable fields: lines of a leaf that agree in two parts are of one
template, whatever else lies in the leaf. So a line is of six templates, one for each two of
its parts, besides the one that it is by itself. In a line with numbers, words without a letter are fields too; a
template in which no other word is fixed doesn't recur, so rows of figures stay.

A template that occurs in ``min_docs`` documents or more recurs (``min_long`` for
lines of ``LONG_WORDS`` words or more, which don't recur by chance); lines of fewer than ``SHORT_WORDS`` words
do, and stay. Lines of a recurring template are dropped, but for the first in
the document with the smallest id, so that no content is lost altogether.

DataFrame functions only. What is shuffled are hashes of lines, pre-aggregated, and in
the end the texts once, to meet the positions that their document loses. Tables of recurring lines and
templates are written before they are joined, so Spark can split what a common one brings together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.rows import free, row_hash
from tracewell.scratch import cut, drop

LEAD, LEAST_WORDS, PARTS, LONG_WORDS, SHORT_WORDS = 3, 8, 4, 20, 3
LETTER = r"\p{L}"


def _described(lines: DataFrame) -> DataFrame:
    """``line`` as hash ``h``, word count ``n``, leaf and the hashes of its four parts."""
    words = F.filter(F.split("line", r"[\x09-\x0D\x20]+"), lambda x: x != "")
    figures = F.contains("line", F.lit("<*>")) & ~F.col("line").rlike(LETTER)
    d = lines.filter(~figures).withColumn("w", words).withColumn("n", F.size("w")).filter(F.col("n") >= SHORT_WORDS)
    tail = F.col("n") - LEAD
    cuts = [F.floor(tail * i / PARTS).cast("int") for i in range(PARTS + 1)]
    parts = [
        F.when(F.col("n") >= LEAST_WORDS, F.hash(F.slice("w", LEAD + 1 + cuts[i], cuts[i + 1] - cuts[i]))).otherwise(0)
        for i in range(PARTS)
    ]
    leaf = F.when(F.col("n") >= LEAST_WORDS, F.xxhash64("n", F.slice("w", 1, LEAD)))
    own = F.xxhash64("line")
    spelled = lambda words: F.exists(words, lambda x: x.rlike(LETTER))
    fixed = F.array(spelled(F.slice("w", 1, LEAD)), *[spelled(F.slice("w", LEAD + 1 + cuts[i], cuts[i + 1] - cuts[i])) for i in range(PARTS)])
    return d.select(
        *[c for c in lines.columns if c != "line"], own.alias("h"), "n", F.coalesce(leaf, own).alias("leaf"),
        *[p.alias(f"p{i}") for i, p in enumerate(parts)],
        F.when(F.contains("line", F.lit("<*>")) & (F.col("n") >= LEAST_WORDS), fixed).alias("fixed"),  # null: all are
    )


def _masked(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "[0-9]+", "<*>"), "\n")


def _recurs(docs: Column, n: Column, min_docs: int, min_long: int) -> Column:
    return docs >= F.when(n >= LONG_WORDS, F.lit(min_long)).otherwise(F.lit(min_docs))


def recurring(docs: DataFrame, min_docs: int, min_long: int) -> DataFrame:
    """``(h, first)``: lines of recurring templates, with the smallest id of their template."""
    each = _described(docs.select("id", F.explode(F.array_distinct(_masked(F.col("text")))).alias("line")))
    parts = [f"p{i}" for i in range(PARTS)]
    lines = cut(
        each.groupBy("leaf", "h").agg(
            F.count("*").alias("docs"), F.min("id").alias("first"), F.first("n").alias("n"), *[F.first(p).alias(p) for p in (*parts, "fixed")]
        ),
        "lt-lines",
    )
    has = lambda i: F.col("fixed")[i + 1]
    two = lambda i, j: F.when(
        F.col("fixed").isNull() | F.col("fixed")[0] | has(i) | has(j), F.xxhash64("leaf", F.lit(PARTS * i + j), parts[i], parts[j])
    )
    twos = F.array_compact(F.array(*[two(i, j) for i in range(PARTS) for j in range(i + 1, PARTS)]))
    each = lines.filter(F.col("n") >= LEAST_WORDS).select("h", "n", "docs", "first", F.explode(twos).alias("template"))
    templates = each.groupBy("template").agg(
        F.sum("docs").alias("all"), F.count("*").alias("kinds"), F.min("first").alias("their_first"), F.first("n").alias("n")
    )
    templates = templates.filter((F.col("kinds") > 1) & _recurs(F.col("all"), F.col("n"), min_docs, min_long)).select("template", "their_first")
    templates = cut(templates, "lt-templates")
    grouped = each.select("template", "h").join(templates, "template").select("h", F.col("their_first").alias("first"))
    alone = lines.filter(_recurs(F.col("docs"), F.col("n"), min_docs, min_long)).select("h", "first")
    out = cut(grouped.unionByName(alone).groupBy("h").agg(F.min("first").alias("first")), "lt-recurring")
    for table in (lines, templates):
        drop(table)
    return out


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_docs: int = 3, min_long: int = 2,
) -> DataFrame:
    """``docs`` with its recurring lines dropped; same columns and rows.

    ``chars_col`` is set to the new length where there is such a column. Blank lines stay. Null
    texts stay null, empty ones empty. Documents are rows; rows with the same id keep the first lines of a
    template alike, and rows that repeat lose the same lines. A null id comes after all others. Lines and
    texts may have any length, extra columns any names; an empty table gives no rows.
    """
    return _without(docs, id_col, text_col, chars_col, min_docs, min_long)[0]


def _without(docs, id_col, text_col, chars_col, min_docs, min_long) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
    """``docs`` without its recurring lines; the same with the numbers of lines that a text had and has lost, and their names."""
    own, its, goes, n_lines, n_dropped, split = free(docs, "own", "its", "goes", "n_lines", "n_dropped", "split")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_hash(id_col, text_col).alias("row"))
    found = recurring(src, min_docs, min_long)
    lines = _masked(F.col("text"))
    each = src.select("id", "row", F.posexplode(lines).alias("pos", "line"))
    each = each.filter(F.trim("line") != "").select("id", "row", "pos", F.xxhash64("line").alias("h"))
    hits = each.join(found, "h").withColumn("opens", F.col("id").eqNullSafe(F.col("first"))).repartition("row")
    # bounded by the lines of a document; positions are compared with a column, for a function would be asked again for each
    hits = hits.groupBy("row", "h", "opens").agg(F.collect_set("pos").alias("at"), F.min("pos").alias("low"))
    hits = hits.withColumn("at", F.when(F.col("opens"), F.filter("at", lambda x: x != F.col("low"))).otherwise(F.col("at")))
    lost = hits.filter(F.size("at") > 0).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias(goes))
    out = docs.withColumn(own, row_hash(id_col, text_col)).join(lost.withColumnRenamed("row", its), F.col(own) == F.col(its), "left")
    # split once, behind a generator, and gathered by position
    out = out.select("*", F.explode(F.array(F.split(F.col(text_col), "\n"))).alias(split))
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(goes))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col(split), i)), "\n")
    new = F.when(F.col(goes).isNull(), F.col(text_col)).otherwise(kept)
    counted = F.coalesce(F.size(split), F.lit(0)).cast("long")
    out = out.withColumns({n_lines: counted, n_dropped: F.coalesce(F.size(goes), F.lit(0)).cast("long")}).withColumn(text_col, new)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema[chars_col].dataType))
    return out.drop(own, its, goes, split, n_lines, n_dropped), out, (n_lines, n_dropped)


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document without its recurring lines.

    All rows stay: null texts null, texts that lose all their lines empty. Rows that repeat are treated alike, a null id
    comes after all others. Columns stay as they are, whatever their names; an empty table gives no rows.
    """
    return drop_recurring_lines(docs)


def op5_line_templates(spark, sf_dir):
    """Every document's text without its recurring lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    _, out, counts = _without(docs, "doc_id", "text", "n_chars", 3, 2)
    return out.select("doc_id", *counts, "text")


def _part(i: int) -> str:
    return f"array_to_string(w[4 + (n - 3) * {i} // 4 : 3 + (n - 3) * {i + 1} // 4], ' ')"


def _has(part: str) -> str:
    return f"(NOT contains(line, '<*>') OR regexp_matches({part}, '{LETTER}'))"


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw, string_split(regexp_replace(text, '[0-9]+', '<*>', 'g'), chr(10)) AS m FROM documents),
l AS (SELECT doc_id, unnest(m) AS line, unnest(range(len(m))) AS pos FROM d),
t AS (SELECT DISTINCT doc_id, line, list_filter(regexp_split_to_array(line, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM l),
g AS (SELECT *, len(w) AS n FROM t WHERE len(w) >= 3 AND {_has("line")}),
k AS (SELECT line, n, CASE WHEN n >= 8 THEN CAST(n AS VARCHAR) || ' ' || array_to_string(w[1:3], ' ') ELSE 'own ' || line END AS leaf,
        {", ".join(f"CASE WHEN n >= 8 THEN {_part(i)} ELSE '' END AS p{i}" for i in range(4))},
        {_has("array_to_string(w[1:3], ' ')")} AS lead, count(*) AS docs, min(doc_id) AS first
      FROM g GROUP BY ALL),
q0 AS (SELECT line, n, docs, first, unnest([{", ".join(f"CASE WHEN lead OR {_has(f'p{i}')} OR {_has(f'p{j}')} THEN [leaf, '{i}{j}', p{i}, p{j}] END" for i in range(4) for j in range(i + 1, 4))}]) AS tpl FROM k WHERE n >= 8),
q AS (SELECT * FROM q0 WHERE tpl IS NOT NULL),
f AS (SELECT tpl, min(first) AS their_first FROM q GROUP BY tpl HAVING count(*) > 1 AND sum(docs) >= CASE WHEN any_value(n) >= 20 THEN 2 ELSE 3 END),
r AS (SELECT line, min(first) AS first FROM (SELECT line, their_first AS first FROM q JOIN f USING (tpl)
      UNION ALL SELECT line, first FROM k WHERE docs >= CASE WHEN n >= 20 THEN 2 ELSE 3 END) GROUP BY line),
o AS (SELECT l.*, pos = min(pos) OVER (PARTITION BY doc_id, line) AS opens FROM l),
x AS (SELECT doc_id, list(pos) AS goes FROM o JOIN r USING (line) WHERE NOT (o.doc_id = r.first AND opens) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(raw), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(goes), 0) AS BIGINT) AS n_dropped,
  CASE WHEN goes IS NULL THEN text ELSE array_to_string(list_filter(raw, lambda v, i: NOT list_contains(goes, i - 1)), chr(10)) END AS text
FROM d LEFT JOIN x USING (doc_id)
"""
