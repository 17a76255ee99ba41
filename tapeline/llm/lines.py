"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import SPACE, fresh, saved

#: A line is boilerplate of a host when more than this share of its pages has it ...
MAX_RATIO = 0.02
#: ... and at least so many pages do, so that small hosts keep their lines.
MIN_PAGES = 5


def _key(line: Column) -> Column:
    """96 bits of a line without outer white space: what is shuffled instead of texts."""
    trimmed = F.btrim(line, F.lit(SPACE))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.hash(trimmed, F.lit(1)).alias("b"))


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text",
    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Per host the keys of its boilerplate lines: (host, pages, lines).

    A page counts once for a line it repeats, and pages of equal text count as one page,
    so that a page copied often does not make boilerplate of its own lines. The list of
    a host has fewer than (mean distinct lines of its pages) / ``max_ratio`` entries. Hot
    hosts and lines are no hot keys: rows are keyed by line and page first and their
    counts combined before they meet.
    """
    body = F.coalesce(text, F.lit(""))
    page = docs.select(
        F.col(host).alias("host"),
        F.struct(F.xxhash64(body).alias("a"), F.hash(body, F.lit(1)).alias("b")).alias("page"),
        F.split(body, "\n").alias("lines"),
    )
    seen = page.select(
        "host", "page",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.filter("lines", lambda x: F.btrim(x, F.lit(SPACE)) != ""), _key
                )
            )
        ).alias("line"),
    )
    counts = seen.groupBy("host", "line").agg(F.countDistinct("page").alias("n")).filter(F.col("n") >= min_pages)
    pages = page.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    return (
        counts.alias("c")
        .join(pages.alias("p"), F.expr("c.host <=> p.host"))
        .filter(F.col("n") > F.lit(max_ratio) * F.col("pages"))
        .groupBy("p.host", "pages")
        .agg(F.collect_list("line").alias("lines"))
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text",
    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``docs`` without the boilerplate lines of their host, plus n_lines and n_dropped.

    Rows, their order of lines and other columns stay; columns called n_lines or
    n_dropped are replaced. A null text stays null with no lines; a null host is a
    host of its own; lines without a word are never dropped. A text whose lines all
    go becomes empty. Rows of equal text count as one page (a null text as an empty one)
    and are all cleaned alike.
    """
    marks = saved(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate")
    site, gone = fresh(docs, "_site"), fresh(docs, "_gone")
    marks = marks.select(F.col("host").alias(site), F.col("lines").alias(gone))
    all_lines = F.split(F.col(text), "\n")
    kept = F.when(F.col(gone).isNull(), all_lines).otherwise(
        F.filter(all_lines, lambda x: ~F.array_contains(F.col(gone), _key(x)))
    )
    left = fresh(docs, "_left")
    return (
        docs.join(marks, F.col(host).eqNullSafe(F.col(site)), "left")
        .withColumn(left, kept)
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines)).cast("long"))
        .withColumn("n_dropped", F.col("n_lines") - F.when(F.col(text).isNull(), 0).otherwise(F.size(left)))
        .withColumn(text, F.array_join(left, "\n"))
        .drop(site, gone, left)
    )


def query(spark, sf_dir):
    from tapeline.llm.common import read

    docs = read(spark, sf_dir, "documents")
    return drop_boilerplate(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(text, '') AS page,
         string_split(text, chr(10)) AS ls
  FROM documents),
l AS (
  SELECT DISTINCT page, source, k
  FROM (SELECT page, source,
               trim(unnest(ls), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM d)
  WHERE k <> ''),
p AS (SELECT source, count(DISTINCT page) AS pages FROM d GROUP BY source),
f AS (
  SELECT l.source, l.k
  FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source
  GROUP BY l.source, l.k, p.pages
  HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO}::DOUBLE * p.pages),
b AS (SELECT source, list(k) AS ks FROM f GROUP BY source),
c AS (
  SELECT d.doc_id, d.source, d.text, d.ls,
         list_filter(d.ls, lambda x: NOT list_contains(
           coalesce(b.ks, []), trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS kept
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source,
       coalesce(len(ls), 0)::BIGINT AS n_lines,
       coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM c
"""
