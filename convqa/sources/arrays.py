"""Large JSON arrays, cut over many tasks.

A file of one array has no line breaks to cut at. Spark's text scan cuts it at every closing brace instead, wherever its
splits fall, and the state of a JSON reader (inside a string or not, how deep) is put together by scans over the pieces: each
piece tells whether it turns strings on or off and, for either state, how much deeper it ends. So every brace that closes
an element is found without reading the file in one task; pieces of an element are joined and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from convqa.operators import ordered as o
from convqa.sources.readers import BROKEN, unquoted_path


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def pieces(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``path, size, start, n, value``: text between closing braces, in the order of ``start`` (of the split) and ``n``."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "}").text(root)
    return read.select(
        unquoted_path().alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value")


def read_json_array(spark: SparkSession, root: str, schema: str | StructType, glob: str = "*.json") -> DataFrame:
    """Elements of the arrays in the files below ``root``, with their ``path``; an element is an object.

    A file may also hold one object or objects one after the other. What cannot be parsed raises an error. A file is cut into
    splits as Spark cuts text. Strings may hold brackets, braces and quotes of any number.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = pieces(spark, root, glob)
    bare = F.regexp_replace("value", r"\\.", "")  # escapes stand for no mark of their own
    measured = raw.withColumn("__bare", bare).withColumn("quotes", _count(F.col("__bare"), '"'))

    def depth(inside: bool) -> Column:
        """How much deeper a piece ends that begins inside a string or not: marks outside of strings."""
        text = F.concat(F.lit('"'), F.col("__bare")) if inside else F.col("__bare")
        outside = F.regexp_replace(text, '"[^"]*("|$)', "")
        return _count(outside, "{") + _count(outside, "[") - _count(outside, "]")

    told = measured.withColumn("deep", F.struct(depth(False).alias("out"), depth(True).alias("in"))).drop("__bare")
    place, block = ["start", "n"], F.col("start")
    odd = F.pmod(F.col("quotes"), F.lit(2)).cast("bigint")
    # a file whose last piece has no brace behind it is longer by none for that piece
    bounds = told.groupBy("path").agg(F.max(F.struct(*place)).alias("__end"), (F.sum(F.octet_length("value") + 1) == F.max("size")).alias("__shut"))
    told = told.join(bounds, "path").withColumn("shut", F.col("__shut") | (F.struct(*place) != F.col("__end"))).drop("__end", "__shut")
    scanned = o.running_sum(told, ["path"], place, odd, "__upto", block)
    # the running number counts this piece as well
    began, ends = F.pmod(F.col("__upto") - odd, F.lit(2)) == 1, F.pmod(F.col("__upto"), F.lit(2)) == 1
    closes = (~ends & F.col("shut")).cast("bigint")
    step = F.when(began, F.col("deep.in")).otherwise(F.col("deep.out")) - closes
    deep = o.running_sum(scanned.withColumn("step", step.cast("bigint")).withColumn("closes", closes), ["path"], place, F.col("step"), "__depth", block)
    lowest = deep.groupBy("path").agg(F.min(F.when(F.col("closes") == 1, F.col("__depth"))).alias("__level"))
    marked = deep.join(lowest, "path").withColumn("last", ((F.col("closes") == 1) & (F.col("__depth") == F.col("__level"))).cast("bigint"))
    counted = o.running_sum(marked, ["path"], place, F.col("last"), "__done", block).withColumn("element", F.col("__done") - F.col("last"))
    whole = counted.groupBy("path", "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "n", "value"))), lambda x: x["value"]), "}").alias("text"), F.max("last").alias("__last"))
    # behind the last element there is only the end of the array; before an element the array's beginning or a comma
    text = F.concat(F.regexp_replace("text", r"^[\s,\[]*", ""), F.lit("}"))
    held = StructType([*fields.fields, StructField(BROKEN, StringType())])
    parsed = whole.where("__last = 1").select("path", F.from_json(text, held, {"columnNameOfCorruptRecord": BROKEN}).alias("r"))
    problem = F.raise_error(F.concat(F.lit("not an element of this kind in "), F.col("path"), F.lit(": "), F.substring(F.col(f"r.{BROKEN}"), 1, 80)))
    return parsed.select(*[F.col(f"r.{f.name}").alias(f.name) for f in fields], F.when(F.col(f"r.{BROKEN}").isNull(), F.col("path")).otherwise(problem).alias("path"))
