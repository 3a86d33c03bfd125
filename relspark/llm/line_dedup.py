"""Boilerplate lines by their frequency on their own site. DataFrame functions only.

A line is boilerplate on a host if more than ``ratio`` of the host's pages contain it.
The pages of a host hold at most (lines of a page, on average) / ratio such lines, so a
host's list is short however large the host is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relspark.llm.common import materialize

RATIO, MIN_PAGES = 0.1, 10


def line_key(line: Column) -> Column:
    """128 bits for a line without the blanks around it; counting by it moves no text."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): for each host with boilerplate the keys of those lines."""
    pages = docs.where(F.col(host).isNotNull() & F.col(text).isNotNull()).select(F.col(host).alias("_host"), F.col(text).alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.trim(x) != "")
    # One row for each page and distinct line. The count adds up in the map tasks first, so a
    # host with a third of all pages is many rows of many tasks, not one group.
    counts = (
        pages.select("_host", F.explode(F.array_distinct(F.transform(lines, line_key))).alias("key"))
        .groupBy("_host", "key.a", "key.b").agg(F.count("*").alias("n"))
        .where(F.col("n") >= max(2, int(ratio * min_pages)))
    )
    totals = pages.groupBy("_host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return (
        counts.join(totals, "_host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("_host").agg(F.collect_list(F.struct("a", "b")).alias("_keys"))
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines gone from their texts, and columns n_lines and n_dropped.

    Lines are compared without the blanks around them; blank lines stay. Hosts with fewer than
    min_pages pages, and rows without a host, lose nothing. A null text stays null, with 0 lines.
    A line that stands twice in a page counts once there, and both go. Rows alike are pages of
    their own. All columns of docs stay; existing columns n_lines or n_dropped are replaced.
    """
    # Written first, so that Spark plans the join by the lists' real size: it broadcasts them below
    # its limit, and no text is shuffled; else it sorts and merges, and splits the hot hosts.
    keys = materialize(boilerplate(docs, host, text, ratio, min_pages))
    # The row travels as one struct, so that no column of docs meets a name used here.
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("_doc"), docs[host].alias("_site"), docs[text].alias("_text"))
    joined = rows.join(keys, F.col("_site") == F.col("_host"), "left")
    lines = F.split("_text", "\n", -1)
    kept = F.when(F.col("_keys").isNull(), lines).otherwise(
        F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_keys"), line_key(x)))
    )
    whole = joined.withColumn("_lines", F.size(lines)).withColumn("_kept", kept)
    count = lambda c: F.coalesce(F.when(F.col("_text").isNotNull(), c), F.lit(0)).cast("long")
    cut = F.when(F.col("_keys").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    return whole.select(
        *((cut if c == text else F.col("_doc")[c]).alias(c) for c in names),
        count(F.col("_lines")).alias("n_lines"), count(F.col("_lines") - F.size("_kept")).alias("n_dropped"),
    )


def oracle(table: str = "documents", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same in DuckDB, on whole lines instead of their keys."""
    return f"""
    WITH pages AS (SELECT {host} AS h, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls
                   FROM {table} WHERE {host} IS NOT NULL AND text IS NOT NULL),
    counts AS (SELECT h, l, count(*) AS n FROM (SELECT h, unnest(list_distinct(ls)) AS l FROM pages) GROUP BY h, l),
    totals AS (SELECT h, count(*) AS p FROM pages GROUP BY h HAVING count(*) >= {min_pages}),
    bad AS (SELECT h, list(l) AS ls FROM counts JOIN totals USING (h) WHERE n >= {max(2, int(ratio * min_pages))} AND n > {ratio}::DOUBLE * p GROUP BY h),
    cut AS (SELECT d.doc_id, d.{host}, d.text, string_split(d.text, chr(10)) AS ls,
                   list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad.ls, []::VARCHAR[]), trim(x))) AS kept
            FROM {table} d LEFT JOIN bad ON d.{host} = bad.h)
    SELECT doc_id, {host}, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
           coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped FROM cut"""
