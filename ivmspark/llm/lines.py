"""Line dedup by site-relative frequency, in DataFrame operations.

Pages are grouped by host; a line's ratio is the pages of its host that contain it over the pages of that
host. A line whose ratio passes ``RATIO`` is boilerplate and leaves every page of that host. A line of one page
alone repeats nothing, so it never is (``LEAST``): that bears on hosts of fewer than ten pages only, of which
the ratio alone would leave no line.

A page counts a line once. Counts by (host, line) are summed before the shuffle, with the line as its
128-bit digest, so a common line or a hot host is one small row for each task. What passes is small by
arithmetic: a host's boilerplate lines number at most (mean distinct lines a page) / RATIO. It goes back to
the pages as one array for each host: broadcast if the table's measured size is under ``BROADCAST`` bytes,
else by an equi-join on host that adaptive execution may split.

Edge cases: a null text has no lines and stays null; an empty text is one empty line; empty lines are never
boilerplate, as they only set lines apart; a null host is a host of its own; repeated rows are pages of
their own; a text of any length is split as a whole; an empty table gives no rows; other columns are carried
along and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SCRATCH, col, hot_safe_key, materialize, table

RATIO = 0.10
LEAST = 2
BROADCAST = 8_000_000

_HOST, _LINES, _DROP = f"{SCRATCH}host", f"{SCRATCH}lines", f"{SCRATCH}drop"


def _digest(line) -> "F.Column":
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(docs: DataFrame, text_column: str = "text", host_column: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host key, line digest, pages, host_pages) of the lines over the ratio on their host."""
    pages = docs.select(hot_safe_key(host_column).alias("host"), col(text_column).cast("string").alias("text"))
    on_page = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: x != ""))
    seen = pages.select("host", F.explode(on_page).alias("line")).select("host", _digest(F.col("line")).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    hosts = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    return counts.join(hosts, "host").where(F.col("pages") > ratio * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, text_column: str = "text", host_column: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """The pages, columns as they came, less the boilerplate lines of their hosts."""
    found = boilerplate(docs, text_column, host_column, ratio, least)
    by_host = materialize(found.groupBy("host").agg(F.collect_set("line").alias(_DROP)).withColumnRenamed("host", _HOST), "boilerplate")
    digests = by_host.select(F.coalesce(F.sum(F.size(_DROP)), F.lit(0)), F.coalesce(F.sum(F.length(_HOST)), F.lit(0))).first()
    if 48 * digests[0] + digests[1] <= BROADCAST:
        by_host = F.broadcast(by_host)
    joined = docs.withColumn(_HOST, hot_safe_key(host_column)).join(by_host, _HOST, "left")
    lines = F.split(col(text_column).cast("string"), "\n")
    left = F.array_join(F.filter(lines, lambda x: ~F.array_contains(F.col(_DROP), _digest(x)) | (x == "")), "\n")
    text = F.when(F.col(_DROP).isNull(), col(text_column)).otherwise(left)
    return joined.select(*[text.alias(c) if c == text_column else col(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a document's source being its host, less their hosts' boilerplate lines."""
    docs = table(spark, sf_dir, "documents")
    kept = drop_boilerplate(docs.select("doc_id", "text", "source").withColumn("before", F.size(F.split("text", "\n"))))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("before"))
    return kept.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


OP4_SQL = f"""
WITH l AS (SELECT rowid AS page, source, unnest(string_split(text, chr(10))) AS line FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
h AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
c AS (SELECT source, line, count(DISTINCT page) AS pages FROM l WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT page) >= {LEAST}),
b AS (
  SELECT c.source, list(c.line) AS lines FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.pages > {RATIO} * h.host_pages GROUP BY c.source),
k AS (
  SELECT doc_id, text, CASE WHEN b.lines IS NULL THEN text
    ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: x = '' OR NOT list_contains(b.lines, x)), chr(10)) END AS kept
  FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
  coalesce(length(kept), 0) AS kept_chars, md5(coalesce(kept, '')) AS kept_md5 FROM k
"""
