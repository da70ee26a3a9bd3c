"""Line dedup: overlapping three-line windows, found again anywhere in the corpus, are removed.

A document's lines with a word are taken in order, trimmed; every three
consecutive ones are a window. The first place of a window (smallest document id,
then smallest line) stays, every later place is removed; lines covered by several
removed windows go once. Lines without a word are never part of a window and stay.

Windows are compared by a 128-bit hash of their lines. Places are combined to one
row per window and task before the shuffle, and only windows seen more than once
are joined back, so a passage in a third of all documents is one row on the small
side of a join whose other side Spark splits at run time.

Defined results: a missing text stays missing and has no lines; a text with fewer
than three lines with words has no window and stays whole; a document without id
takes no part and comes back unchanged; rows that repeat an id and a line share
one place, so repeated rows are all treated alike; an empty table gives an empty
result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.session import written

WINDOW_LINES = 3
BLANKS = " \t\x0b\f\r"


def _numbered_lines(text: Column) -> Column:
    """Array of ``at, line`` for the lines with a word."""
    lines = F.transform(F.split(text, "\n"), lambda line, k: F.struct(k.alias("at"), F.btrim(line, F.lit(BLANKS)).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def windows(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``doc_id, window, first_at, lines`` of all windows; ``lines`` are the line numbers it covers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       _numbered_lines(F.col("text").cast("string")).alias("lines")).filter("doc_id is not null")
    rows = rows.filter(F.size("lines") >= size)

    def window(k: Column) -> Column:
        part = F.slice("lines", k, size)
        return F.struct(F.unhex(F.md5(F.array_join(F.transform(part, lambda x: x["line"]), "\n").cast("binary"))).alias("window"),
                        F.transform(part, lambda x: x["at"]).alias("covered"))

    found = F.transform(F.sequence(F.lit(1), F.size("lines") - (size - 1)), window)
    return rows.select("doc_id", F.explode(found).alias("w")).select(
        "doc_id", F.col("w.window").alias("window"), F.col("w.covered").alias("covered"),
        F.col("w.covered")[0].alias("at"))


def repeated_lines(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``doc_id, removed``: per document with later places, the sorted numbers of the lines they cover."""
    places = written(windows(docs, size), "windows")
    first = places.groupBy("window").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    often = first.filter("n > 1").select("window", "first")
    later = places.join(often, "window").filter(F.struct("doc_id", "at") > F.col("first"))
    return later.select("doc_id", F.explode("covered").alias("at")).distinct().groupBy("doc_id").agg(
        F.sort_array(F.collect_list("at")).alias("removed"))


def without_repeats(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` per row of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(repeated_lines(docs, size), "doc_id", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    # Line numbers are matched by a set operation, not by a search per line.
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(numbers, "removed"), lambda k: F.get("lines", k))
    return joined.select("doc_id", "text", removed.alias("removed"), F.split("text", "\n").alias("lines")).select(
        "doc_id", F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"))
