"""Concatenation of texts in name order, and batch counts."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmill.sources import files, joined


def with_separator(text: Column, newline: str = "\r\n") -> Column:
    """The text with a newline unless it ends in one; an empty text is one empty line."""
    return F.concat(text, F.when(F.endswith(text, F.lit("\n")), F.lit("")).otherwise(F.lit(newline)))


def name_order(name: Column) -> list[Column]:
    """Upper-cased names, then names as they are: a total order."""
    return [F.upper(name), name]


#: Keys looked at, for each range, to find the bounds of the ranges. It does not change the result.
LOOKED_AT = 64


def _bounds(keys: DataFrame, ranges: int) -> list[tuple]:
    """Keys that cut the table into about equal ranges, in order; one that is many rows' is there more than once."""
    # in Spark's order: nulls first, texts by their bytes
    order = lambda x: tuple((v is not None, v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v) for v in x)
    seen = sorted((tuple(r["k"]) for r in keys.orderBy(F.rand(7)).limit(LOOKED_AT * ranges).collect()), key=order)
    return [seen[len(seen) * i // ranges] for i in range(1, ranges)] if len(seen) >= ranges else []


def _range_of(key: Column, kind: StructType, bounds: list[tuple]) -> tuple[Column, Column]:
    """The number of a key's range, and whether the key is so frequent that the range is its own. Ranges follow the order of the keys."""
    if not bounds:
        return F.lit(0), F.lit(False)
    # one constant, which the optimizer folds
    literal = lambda xs: F.from_json(F.lit(json.dumps([dict(zip(kind.names, x)) for x in xs], default=str)), f"array<{kind.simpleString()}>")
    often = [x for x, n in Counter(bounds).items() if n > 1]
    below = F.size(F.filter(literal(dict.fromkeys(bounds)), lambda x: x <= key)) * 2
    if not often:
        return below + 1, F.lit(False)
    alone = F.array_contains(literal(often), key)
    return F.when(alone, below).otherwise(below + 1), alone


def join_pieces(df: DataFrame, group: str, name: str, text: str = "text", newline: str = "\r\n") -> DataFrame:
    """group, seq (from 1), name and piece: the texts of each group in name order, each with its separator. Writing the pieces in
    order gives the joined file.

    A null group is a group, null names come first, and rows that repeat a name are ordered by the SHA-256 of their texts; each row has its
    piece. A null text is an empty one. An empty table gives an empty one; other columns are not read. A small job finds the bounds of as many ranges of
    names as the session has shuffle partitions; a row's place is its place in its range, behind the rows of the ranges before. Each text is
    shuffled once. A row that is so frequent that it is a range by itself is counted, and dealt out again by its number.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(group).alias("g"), F.col(name).alias("n"), F.sha2(body, 256).alias("h"), body.alias("t"))
    named = F.struct("g", F.upper("n").alias("u"), "n")
    key = named
    bounds = _bounds(rows.select(key.alias("k")), ranges)
    if len(set(bounds)) < len(bounds):
        # names are so frequent that the texts behind them have to tell the ranges apart
        key = F.struct("g", F.upper("n").alias("u"), "n", "h")
        bounds = _bounds(rows.select(key.alias("k")), ranges)
    number, alone = _range_of(F.col("k"), rows.select(key.alias("k")).schema["k"].dataType, bounds)
    placed = rows.withColumn("k", key).withColumn("r", number).withColumn("alone", alone)
    before = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group and range
    totals = placed.groupBy("g", "r").agg(F.count(F.lit(1)).alias("all"))
    starts = totals.select(F.col("g").alias("g2"), F.col("r").alias("r2"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("g", "r").orderBy(named, "h")
    met = lambda d: d.join(starts, d["g"].eqNullSafe(starts["g2"]) & (d["r"] == starts["r2"]))
    result = lambda d, seq: d.select(F.col("g").alias(group), seq.cast("int").alias("seq"), F.col("n").alias(name), with_separator(F.col("t"), newline).alias("piece"))
    found = result(met(placed.where("NOT alone").withColumn("i", F.row_number().over(inside))), F.col("start") + F.col("i"))
    if len(set(bounds)) == len(bounds):
        return found
    copies = met(placed.where("alone").groupBy("g", "n", "h", "r").agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("copies")))
    return found.union(result(copies.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), F.col("start") + F.col("i")))


def file_counts(df: DataFrame, group: str) -> DataFrame:
    """group and file_count: how many files each joined file is made of."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("file_count"))


def join_texts(df: DataFrame, name: str, text: str = "text", newline: str = "\r\n") -> DataFrame:
    """text and file_count: all texts in name order in one row, which therefore must fit one (2 GB). No rows: empty text, 0."""
    order = F.concat_ws("\u0000", F.upper(name), F.col(name))
    pieces = F.array_sort(F.collect_list(F.struct(order.alias("o"), with_separator(F.coalesce(F.col(text), F.lit("")), newline).alias("p"))))
    return df.agg(F.array_join(F.transform(pieces, lambda x: x["p"]), "").alias("text"), F.count(F.lit(1)).alias("file_count"))


def join_files(spark: SparkSession, folder: str, pattern: str, output: str, newline: str = "\r\n") -> DataFrame:
    """output_path, file_count and text of the files of ``folder`` that match ``pattern``, each decoded from its own encoding. The output itself is
    never an input."""
    if not folder.strip() or not pattern.strip() or not output.strip():
        raise ValueError("folder, pattern and output must not be blank")
    found = files.scan_files(spark, folder, pattern.strip())
    name = F.element_at(F.split("path", "/"), -1)
    joined = join_texts(found.where(name != output.strip()).select("path", "text"), "path", newline=newline)
    return joined.select(F.lit(f"{folder.rstrip('/')}/{output.strip()}").alias("output_path"), "file_count", "text")


def batch_summary(results: DataFrame, error: str = "error") -> DataFrame:
    """total, succeeded and status (Complete or Partial) of a batch whose rows have an error or null."""
    ok = F.count(F.when(F.col(error).isNull(), 1))
    return results.agg(F.count(F.lit(1)).alias("total"), ok.alias("succeeded")).withColumn("status", F.when(F.col("succeeded") == F.col("total"), "Complete").otherwise("Partial"))


def join_to(spark: SparkSession, folder: str, pattern: str, output: str, newline: str = "\r\n") -> DataFrame:
    """Join the files of ``folder`` that match ``pattern`` into ``output``, a new folder of parts (``sources.joined``), however large they are together. A row for each file
    that could not be read, with path and error; the others are joined. The files are read once for the names and faults, and once for their texts."""
    if not folder.strip() or not pattern.strip() or not output.strip():
        raise ValueError("folder, pattern and output must not be blank")
    found = files.scan_files(spark, folder, pattern.strip())
    name = F.element_at(F.split("path", "/"), -1)
    good = found.where("error IS NULL").select(F.lit(0).alias("output"), name.alias("name"), "text")
    joined.write_joined(join_pieces(good, "output", "name", newline=newline), output, "output")
    return found.where("error IS NOT NULL").select("path", "error")
