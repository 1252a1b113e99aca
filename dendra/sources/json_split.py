"""JSON arrays (and nested run objects) read in splits.

Spark reads a JSON array as one document: one task a file, however large.
Here the file is read as text records that end at ``}``, which Spark splits by
byte ranges, and the records are put together again:

1. every record is looked at on its own: how many quotes it holds, and how its
   braces and brackets change the depth, once for a start outside a string and
   once for a start inside one (a record starts right after ``}``, which cannot
   be the second half of an escape, so one bit is all it needs to know);
2. these are added up per split, and a window over the splits of a file gives
   each split its state at entry;
3. within a split, running sums give each record its state; records of one
   element are joined, and elements that cross splits are joined in the end.

One split is one task's work; a file has no upper size.  Strings may hold any
of the characters above, escaped quotes and line breaks.

Defined results: a file without elements has no rows; the same element twice
gives two rows; text that is not JSON gives null fields, as ``from_json`` does;
compressed files can't be split and are read by one task each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPLIT = ["file", "split_at"]


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Text between closing braces, with its split and its place in it.  Escape
    pairs are blanked in ``plain``, so every quote there is a real one."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_at"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"),
        F.regexp_replace("value", r"(?s)\\.", "  ").alias("plain"))


def _count(col, char: str):
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def _structure(plain, in_string):
    """``plain`` with the inside of strings blanked; lengths stay the same."""
    parts = F.transform(F.split(plain, '"'), lambda s, i: F.when(
        (i + in_string) % 2 == 0, s).otherwise(F.repeat(F.lit(" "), F.length(s))))
    return F.array_join(parts, " ")


def _ends_open(plain, in_string):
    """Is the text's end outside a string, so that its brace closes something?"""
    return (_count(plain, '"') + in_string) % 2 == 0


def _brace_change(plain, in_string):
    return (_count(_structure(plain, in_string), "{")
            - F.when(_ends_open(plain, in_string), 1).otherwise(0))


def _bracket_change(plain, in_string):
    s = _structure(plain, in_string)
    return _count(s, "[") - _count(s, "]")


def _split_states(records: DataFrame) -> DataFrame:
    """State of every split at its entry: inside a string, brace and bracket
    depth.  One row a split; the window runs over a file's splits only."""
    slim = records.select(
        *_SPLIT, "at", _count(F.col("plain"), '"').alias("quotes"),
        *[f(F.col("plain"), F.lit(b)).alias(f"{name}{b}") for b in (0, 1)
          for name, f in (("brace", _brace_change), ("bracket", _bracket_change))])
    w = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(w), F.lit(0)) % 2
    split = slim.withColumn("odd", odd).groupBy(*_SPLIT).agg(
        F.sum("quotes").alias("quotes"),
        *[F.sum(F.when(F.col("odd") == b, F.col(f"{n}0")).otherwise(F.col(f"{n}1"))).alias(f"{n}{b}")
          for b in (0, 1) for n in ("brace", "bracket")])
    before = (Window.partitionBy("file").orderBy("split_at")
              .rowsBetween(Window.unboundedPreceding, -1))
    split = split.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    pick = {n: F.when(F.col("in_string") == 0, F.col(f"{n}0")).otherwise(F.col(f"{n}1"))
            for n in ("brace", "bracket")}
    return split.select(*_SPLIT, "in_string", *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{n}_in") for n, c in pick.items()])


def _element_records(spark: SparkSession, path: str, level: int) -> DataFrame:
    """Records with their part inside an element (``part``), their part outside
    (``rest``), whether an element starts or ends in them, and its number in
    the split (0: begun in an earlier split).  An element is an object opened
    at brace depth ``level``, inside a bracket where ``level`` is above 0."""
    records = _records(spark, path)
    r = records.join(_split_states(records), _SPLIT)
    w = Window.partitionBy(*_SPLIT).orderBy("at")
    past = w.rowsBetween(Window.unboundedPreceding, -1)

    def running(col):
        return F.coalesce(F.sum(col).over(past), F.lit(0))
    plain, b = F.col("plain"), F.col("b")
    r = (r.withColumn("b", (F.col("in_string") + running(_count(plain, '"'))) % 2)
         .withColumn("s", _structure(plain, b))
         .withColumn("closes", F.when(_ends_open(plain, b), 1).otherwise(0))
         .withColumn("opens", _count(F.col("s"), "{"))
         .withColumn("depth", F.col("brace_in") + running(F.col("opens") - F.col("closes")))
         .withColumn("square", F.col("bracket_in")
                     + running(_count(F.col("s"), "[") - _count(F.col("s"), "]"))))
    # characters before the brace that goes from ``level`` to ``level`` + 1
    r = r.withColumn("nth", (F.lit(level + 1) - F.col("depth")).cast("int"))
    r = r.withColumn("head", F.when(F.col("nth").between(1, F.col("opens")),
                                    F.expr("substring_index(s, '{', nth)")))
    listed = (F.col("square") + _count(F.col("head"), "[") - _count(F.col("head"), "]") > 0
              if level else F.lit(True))
    r = r.withColumn("cut", F.when(listed, F.length("head")))
    r = r.withColumn("starts", F.col("cut").isNotNull().cast("int"))
    reached = F.col("depth") + F.col("opens")
    inside = F.col("depth") > level
    if level:
        inside &= F.col("square") > 0
    return (r.withColumn("inside", inside)
            .withColumn("ends", ((F.col("inside") | F.col("cut").isNotNull()) & (F.col("closes") == 1)
                                 & (reached == level + 1)).cast("int"))
            # what follows the last brace of a file was not cut off by a brace
            .withColumn("full", F.concat("text", F.when(reached > 0, "}").otherwise("")))
            .withColumn("elem", F.sum("starts").over(w))
            .select(*_SPLIT, "at", "elem", "starts", "ends",
                    F.when(F.col("inside"), F.col("full"))
                    .when(F.col("cut").isNotNull(),
                          F.expr("substring(full, cut + 1)")).alias("part"),
                    F.when(F.col("inside"), F.lit(None).cast("string"))
                    .when(F.col("cut").isNotNull(), F.expr("substring(full, 1, cut)"))
                    .otherwise(F.col("full")).alias("rest")))


def _glued(place: str, text: str):
    """Texts of a group in the order of their places."""
    rows = F.array_sort(F.collect_list(F.struct(place, text)))
    return F.array_join(F.transform(rows, lambda x: x[text]), "")


def _elements(parts: DataFrame) -> DataFrame:
    """One row an element: (file, json).  The first grouping needs no shuffle of
    its own (rows are dealt by split); only elements cut by a split's edge, two
    a split at most, are grouped again."""
    got = (parts.filter(F.col("part").isNotNull()).groupBy(*_SPLIT, "elem")
           .agg(_glued("at", "part").alias("json"), F.max("starts").alias("starts"),
                F.max("ends").alias("ends")))
    whole = got.filter("starts = 1 and ends = 1").select("file", "json")
    w = Window.partitionBy("file").orderBy("split_at", "elem")
    cut = (got.filter("not (starts = 1 and ends = 1)")
           .withColumn("no", F.sum("starts").over(w))
           .withColumn("place", F.struct("split_at", "elem"))
           .groupBy("file", "no").agg(_glued("place", "json").alias("json")))
    return whole.unionByName(cut.select("file", "json"))


def read_elements(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of a top-level JSON array as rows of ``schema``; objects one
    after the other (JSON lines) are read alike."""
    rows = _elements(_element_records(spark, path, 0))
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def read_object_with_list(spark: SparkSession, path: str, schema: T.StructType,
                          list_name: str) -> tuple[DataFrame, DataFrame]:
    """Files that hold one object with one list of objects (``list_name``, the
    only one): (one row a file without the list, one row a list element), both
    with the file they come from.  The list may be of any length."""
    r = _element_records(spark, path, 1)
    # separators between elements are left out, so the rest is the object's head
    rest = (r.filter(~F.col("rest").rlike(r"^[\s,]*$")).withColumn("place", F.struct("split_at", "at"))
            .groupBy("file").agg(_glued("place", "rest").alias("json")))
    head_schema = T.StructType([f for f in schema.fields if f.name != list_name])
    heads = rest.select("file", F.from_json("json", head_schema).alias("r")).select("file", "r.*")
    item = schema[list_name].dataType.elementType
    items = (_elements(r).select("file", F.from_json("json", item).alias("r"))
             .select("file", "r.*"))
    return heads, items
