"""Line deduplication by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netaudit.llm.common import Scratch, join_groups

#: Elements whose tags end a line.
_BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: A line is boilerplate of its host beyond this share of the host's pages, if at least this many pages hold it.
RATIO, LEAST_PAGES = 0.2, 3


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def lines_of(html: Column) -> Column:
    """The text lines of a page: comments, scripts and styles go, block tags end a line, other tags go, blanks collapse."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    t = F.regexp_replace(t, r"[\r\n]", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{_BLOCKS})(?:[ \t/][^>]*)?>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"<[A-Za-z/!?][^>]*>", ""), r"[ \t]+", " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_dedup(rows: DataFrame, host: Column, lines: Column, id_col: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(id, host, n_lines, n_dropped, clean_text) for every row of rows: its lines without the boilerplate of its host.

    For each host, the pages that hold a line are counted once each and divided by the pages of the host; lines in at
    least `least_pages` pages and beyond `ratio` of them are dropped wherever they stand on that host. Pages of an empty
    host are a group like any other. Null lines make an empty page, which counts as a page. Rows count as pages one
    by one, also where ids repeat or are null. A very long page is one row like any other, and an empty table gives an empty result. Lines are cut once and written. They meet as 128 bits of three hashes, so texts are not
    shuffled for counting: it moves one small row a line and task, and the lines to drop come back to the rows as lists of places.
    Those lists meet rows by 128 bits over id, host and lines; rows alike in all three get the same answer. Other columns of rows
    don't matter. Hot hosts, lines and rows are broadcast (join_groups)."""
    scratch = Scratch(rows.sparkSession)
    page = rows.select(F.col(id_col).alias("id"), host.alias("host"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    hashed = lambda x: F.struct(F.xxhash64(x).alias("k1"), F.hash(x).alias("k2"), F.crc32(x.cast("binary")).alias("k3"))
    page = page.withColumn("keys", F.transform("lines", hashed))
    page = scratch.write(page.withColumn("r1", F.xxhash64("id", "host", "keys")).withColumn("r2", F.xxhash64(F.lit(1), "keys", "host", "id")))
    total = scratch.write(page.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.size("keys")).alias("held")))
    key = ["host", "k1", "k2", "k3"]
    once = page.select("host", F.explode(F.transform(F.array_distinct("lines"), hashed)).alias("k")).select("host", "k.*").groupBy(*key).agg(F.count("*").alias("with"))
    drop = scratch.write(join_groups(once.where(F.col("with") >= least_pages), total, ["host"], "held").where(F.col("with") > ratio * F.col("pages")).select(*key, "with"))
    each = page.select("host", "r1", "r2", F.posexplode("keys").alias("at", "k")).select("host", "r1", "r2", "at", "k.*")
    gone = join_groups(each, drop, key, "with").groupBy("r1", "r2").agg(F.collect_set("at").alias("gone"))
    whole = scratch.write(page.groupBy("r1", "r2").agg(F.count("*").alias("copies")).join(gone, ["r1", "r2"], "left"))
    at = F.coalesce("gone", F.array().cast("array<int>"))
    places = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.array_except(places, at), lambda i: F.get("lines", i))  # sets of numbers: in proportion to the lines, however many go
    out = join_groups(page, whole, ["r1", "r2"], "copies")
    out = out.select(F.col("id").alias(id_col), "host", F.size("lines").cast("long").alias("n_lines"), F.size(at).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("clean_text"))
    scratch.close(page, whole)
    return out
