"""Exact de-duplication by a tree merge of sorted digest runs, in DataFrame functions only.

Every row becomes a digest entry (digest, length, second hash, identifier). Entries are dealt into ``fan_in ** k`` leaf runs by
a hash of the identifier, so a group of copies of any size is spread over all of them. In each of the k binomial rounds,
``fan_in`` neighbouring runs exchange their entries and merge by digest: sort-based aggregation keeps, for each digest of the
new run, the best identifier and the number of rows, and checks that all entries of a digest agree in length and second hash.
A run is itself spread over tasks by digest, so no round, the last included, meets in one task, and no digest ever brings
more than ``fan_in`` entries to a merge. The winners of groups of two or more then go down the same tree, again at most
``fan_in`` entries a key, until they meet the leaf entries.

Only identifiers and digests are shuffled, never texts. The leaf entries are a table in the shared folder, so a lost executor
costs the reading of its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm import workspace

#: Runs that merge into one in a round.
FAN_IN = 8


def _entries(df: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length(whole).alias("size"), F.xxhash64(whole).alias("probe"))


def _best(keep: str) -> Column:
    """The entry that stays. A null identifier loses to any other; of repeated rows, the first or last as read."""
    order = F.struct(F.col("id").isNotNull().alias("there") if keep == "max" else F.col("id").isNull().alias("there"), F.col("id"), F.col("row"))
    return F.max(order) if keep == "max" else F.min(order)


def _merge(runs: DataFrame) -> DataFrame:
    """One round: entries (run, digest, size, probe, best, rows) of the runs with the same number merge by digest."""
    merged = runs.groupBy("run", "digest").agg(F.max("best").alias("top"), F.min("best").alias("low"), F.sum("rows").alias("rows"), F.min("size").alias("size"), F.max("size").alias("size2"), F.min("probe").alias("probe"), F.max("probe").alias("probe2"))
    sound = (F.col("size") == F.col("size2")) & (F.col("probe") == F.col("probe2"))
    return merged.withColumn("rows", F.when(sound, F.col("rows")).otherwise(F.raise_error(F.lit("texts of one digest differ")).cast("long")))


def copy_groups(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max", leaves: int | None = None) -> DataFrame:
    """For every row of ``df``: ``id`` (the value of ``key``), ``keep_id`` (that of the row of its group that stays), ``group_size``
    (long), ``kept`` (boolean) and ``digest`` (binary SHA-256 of the text).

    Rows with identical texts form a group; null counts as the empty text. ``keep``: "max" or "min", the identifier that stays.
    A null identifier stays only where all of the group's are null. Of rows that repeat the same identifier and text exactly
    one is kept. An empty table gives an empty result; other columns are not read.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be max or min")
    spark = df.sparkSession
    leaves = leaves or workspace.task_count(spark)
    depth = 1
    while FAN_IN**depth < leaves:
        depth += 1
    entries = workspace.stage(_entries(df, key, text), "digests").withColumn("run", F.pmod(F.xxhash64("id", "row"), F.lit(FAN_IN**depth)))
    there = F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()
    level = entries.select("run", "digest", "size", "probe", F.struct(there.alias("there"), "id", "row").alias("best"), F.lit(1).cast("long").alias("rows"))
    levels = []
    for k in range(depth + 1):
        merged = _merge(level).withColumn("best", F.col("top" if keep == "max" else "low")).select("run", "digest", "size", "probe", "best", "rows")
        levels.append(merged)
        level = merged.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("long"))
    # down the tree: what the digests of two or more rows have come to
    won = levels[-1].where("rows > 1").select("run", "digest", "best", "rows")
    for lower in reversed(levels[:-1]):
        own = lower.select("run", "digest", F.floor(F.col("run") / FAN_IN).cast("long").alias("above"))
        won = own.join(won.select(F.col("run").alias("above"), "digest", "best", "rows"), ["above", "digest"]).select("run", "digest", "best", "rows")
    alone = F.col("rows").isNull()
    return entries.join(won, ["run", "digest"], "left").select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("rows")).alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        "digest",
    )


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``df`` that stay, one of each group of identical texts, with all their columns.

    Cases are those of ``copy_groups``. The texts meet the identifiers that stay by identifier and digest, so a group's size
    does not matter to the join; repeated rows of one identifier and text are then reduced to one of them.
    """
    mark = "__digest"
    while mark in df.columns:
        mark = "_" + mark
    names = df.columns
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    groups = workspace.stage(copy_groups(df, key, text, keep), "groups")
    many = groups.groupBy("id", "digest").agg((F.count(F.lit(1)) > 1).alias("many"), F.max("kept").alias("kept")).where("kept")
    rows = many.select(F.col("id").alias(f"{mark}_id"), F.col("digest").alias(f"{mark}_won"), F.col("many").alias(f"{mark}_many"))
    kept = df.withColumn(mark, F.unhex(F.sha2(whole, 256))).join(rows, F.col(key).eqNullSafe(F.col(f"{mark}_id")) & (F.col(mark) == F.col(f"{mark}_won")))
    # only rows that repeat an identifier and text have to meet once more
    repeated = kept.where(f"{mark}_many").dropDuplicates([key, mark])
    return kept.where(~F.col(f"{mark}_many")).select(*names).union(repeated.select(*names))
