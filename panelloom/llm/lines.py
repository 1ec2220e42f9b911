"""Line dedup over windows of three consecutive lines, with DataFrame functions only.

Lines are split at \n; lines without a word are kept and skipped when windows are formed, so a window is three
consecutive worded lines. Windows are compared by two independent 64-bit hashes over the whole corpus; every window
but the earliest of its kind marks its three lines, and marked lines go. The order is that of doc_id, then of a hash of
the text (127 bits of it tell rows of one id apart), then of the position. The text itself is shuffled once, to meet its marks. The `HOT` most common windows, a
bounded table, are met by broadcast, so no task has to take all rows of a window that a third of the documents share;
every other window has at most one row in `HOT` of all.

Edge cases: a null text stays null with 0 lines; an empty text has one empty line; texts with fewer than three worded
lines lose none; rows that repeat a doc_id with other texts are documents of their own; rows equal in both count as the
same place, so they do not remove each other; null ids come last; an empty table gives an empty result; extra columns
are ignored unless they are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm._spark import IDENTITY, met_unevenly, quoted, read, row_identity

_WORDED = r"[^\x20\x09-\x0D]"
#: Most common windows that are met by broadcast.
HOT = 1000


def _worded_lines(lines: str = "lines") -> F.Column:
    """Numbers of the lines that hold a word."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.rlike(F.get(lines, i), F.lit(_WORDED)))


def line_windows(texts: DataFrame, window: int = 3) -> DataFrame:
    """(identity of the row, place, h1, h2) of every window of (identity of the row, text); place counts worded lines from 0."""
    lines = texts.where(F.col("text").isNotNull()).select(*IDENTITY, F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(_WORDED))).alias("lines"))
    hashed = lines.where(F.size("lines") >= window).select(*IDENTITY, F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))).alias("h"))
    # The element first, then its field: the field of the whole array would be taken anew for every window.
    part = lambda field, i: [F.get("h", i + k).getField(field) for k in range(window)]
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - window), lambda i: F.struct(i.cast("long").alias("place"), F.xxhash64(*part("a", i)).alias("h1"), F.xxhash64(*part("b", i)).alias("h2")))
    return hashed.select(*IDENTITY, F.explode(windows).alias("w")).select(*IDENTITY, "w.*")


def remove_repeated_lines(docs: DataFrame, window: int = 3, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row without the lines of repeated windows.

    carry: columns to hand through, packed in a struct column `row`.
    """
    own, text = F.col(id_column).cast("long"), F.col(text_column)
    texts = docs.select(*row_identity(own, text), own.alias("doc_id"), text.alias("text"), *([F.struct(*[F.col(quoted(c)) for c in carry]).alias("row")] if carry else []))
    windows = line_windows(texts, window)
    at = F.struct(*IDENTITY, "place")
    first = windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = met_unevenly(windows, first, ["h1", "h2"], "first", [*IDENTITY, "place"], HOT).where(F.col("first") != at)
    marks = later.groupBy(*IDENTITY).agg(F.collect_set("place").alias("places"))
    covered = F.flatten(F.transform("places", lambda p: F.sequence(p, p + window - 1)))
    marks = marks.select(*IDENTITY, F.array_distinct(covered).alias("covered"))
    joined = texts.join(marks, list(IDENTITY), "left").withColumn("lines", F.split("text", "\n", -1)).withColumn("worded", F.when(F.col("covered").isNotNull(), _worded_lines()))
    gone = joined.withColumn("gone", F.transform("covered", lambda c: F.get("worded", c.cast("int"))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    return gone.select("doc_id", n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), *(["row"] if carry else []))


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-line windows removed from all documents."""
    return remove_repeated_lines(read(spark, sf_dir, "documents"))


ORACLE = r"""
with s as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from s),
b as (select *, row_number() over (partition by doc_id order by i) - 1 as r from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
w as (
  select doc_id, r, line || chr(10) || lead(line, 1) over d || chr(10) || lead(line, 2) over d as window_text
  from b window d as (partition by doc_id order by r)
), t as (
  select doc_id, r from (select *, row_number() over (partition by window_text order by doc_id, r) as n from w where window_text is not null) where n > 1
), c as (select distinct doc_id, r + k as r from t, (values (0), (1), (2)) v(k)),
g as (select b.doc_id, b.i from b join c using (doc_id, r)),
k as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) filter (where g.i is null) as kept, count(*) as n_lines, count(g.i) as n_removed
  from l left join g using (doc_id, i) group by l.doc_id
)
select s.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed,
       case when s.text is null then null else coalesce(k.kept, '') end as text
from s left join k using (doc_id)
"""


def queries() -> dict:
    return {"op1_lines": op1_lines}


def oracle_sql() -> dict[str, str]:
    return {"op1_lines": ORACLE}
