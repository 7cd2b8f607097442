"""The clean-up pipeline: threshold merge, CJK fix, punctuation fix, comma trim, rules. Steps that are off are not in the plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import lines, rules
from quillmill.sources import files, sinks


@dataclass(frozen=True)
class MergeOptions:
    threshold: int = 20
    mode: lines.Width = lines.Width.BYTES


@dataclass(frozen=True)
class PostProcess:
    fix_cjk: bool = True
    fix_punctuation: bool = False
    punctuation: str = "，"
    no_merge: bool = False
    no_merge_chars: str = "。！？"
    apply_rules: bool = False
    rules: tuple[rules.Rule, ...] = ()
    trim_leading_comma: bool = True


#: Names of the profiles that the older batch scripts had.
PROFILES = {"char_12": MergeOptions(12, lines.Width.CHARS), "byte_20": MergeOptions(20, lines.Width.BYTES), "char_20": MergeOptions(20, lines.Width.CHARS)}


def process(df: DataFrame, merge: MergeOptions = MergeOptions(), post: PostProcess = PostProcess(), column: str = "lines", charset: Column | None = None) -> DataFrame:
    """Run the pipeline on the lines of every row. ``column`` gets the result; cjk_fixed and punct_fixed say whether a step changed the
    number of lines, trimmed whether it changed any, replaced whether the rules ran."""
    keep = post.no_merge_chars if post.no_merge and post.no_merge_chars else None
    flags = {"cjk_fixed": F.lit(False), "punct_fixed": F.lit(False), "trimmed": F.lit(False), "replaced": F.lit(False)}
    now = F.col(column)
    df = df.withColumn(column, lines.merge_lines(now, merge.threshold, merge.mode, keep, charset))
    if post.fix_cjk:
        df = df.withColumn("__before", F.size(now)).withColumn(column, lines.fix_cjk(now, keep))
        df = df.withColumn("cjk_fixed", F.size(now) != F.col("__before")).drop("__before")
        del flags["cjk_fixed"]
    if post.fix_punctuation and post.punctuation:
        df = df.withColumn("__before", F.size(now)).withColumn(column, lines.fix_punctuation(now, post.punctuation, keep))
        df = df.withColumn("punct_fixed", F.size(now) != F.col("__before")).drop("__before")
        del flags["punct_fixed"]
    if post.trim_leading_comma:
        df = df.withColumn("trimmed", lines.has_leading_comma(now)).withColumn(column, lines.trim_leading_comma(now))
        del flags["trimmed"]
    if post.apply_rules and post.rules:
        df = df.withColumn(column, rules.apply_rules_to_lines(now, post.rules)).withColumn("replaced", F.lit(True))
        del flags["replaced"]
    return df.withColumns(flags)


def process_files(spark: SparkSession, paths: str | list[str], merge: MergeOptions = MergeOptions(), post: PostProcess = PostProcess(), newline: str = "\r\n") -> DataFrame:
    """path, output_path, text (a newline after every line), lines, flags and error for every file; nothing is written. ``sinks.write_texts`` writes.
    A file that cannot be read has an error and no text, and does not stop the others; ``joiner.batch_summary`` counts both."""
    scanned = files.scan_files(spark, paths).withColumn("lines", lines.to_lines(F.col("text"))).drop("content", "text")
    done = process(scanned, merge, post, charset=F.col("charset"))
    return done.withColumn("output_path", sinks.output_path(F.col("path"))).withColumn("text", sinks.lines_to_text(F.col("lines"), newline))


def replace_files(spark: SparkSession, paths: str | list[str], found: tuple[rules.Rule, ...]) -> DataFrame:
    """path, output_path, text and error of every file after the rules on its whole text, line breaks kept. Errors: as in ``process_files``."""
    if not found:
        raise ValueError("at least one rule is needed")
    scanned = files.scan_files(spark, paths)
    return scanned.select("path", sinks.output_path(F.col("path")).alias("output_path"), rules.apply_rules(F.col("text"), found).alias("text"), "error")
