"""The engine's queries over the driver's tables, each with equivalent DuckDB SQL.

The documents have no CJK text and long lines, so line queries map their text first: full-width punctuation, some CJK
characters, and a line break at every space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill import session
from quillmill.functions import charsets
from quillmill.operators import edit_log, joiner, lines, long_documents, rule_index, rules
from quillmill.plans import pipeline
from quillmill.session import spread
from quillmill.sources import files, joined, sinks, splits, stores
from quillmill.streaming import status

Query = Callable[[SparkSession, str], DataFrame]
_FROM, _TO = "aeinrst ", "的一是不了人我\n"
SCHEMES = rules.builtin_schemes()
#: Schemes that the selection queries choose, in another order than the catalog's.
CHOSEN = [SCHEMES[3].name, SCHEMES[0].name, SCHEMES[7].name]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def mapped(text: Column) -> Column:
    """The text that the line queries work on."""
    return F.translate(F.replace(F.replace(text, F.lit("."), F.lit("。")), F.lit(","), F.lit("，")), _FROM, _TO)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", lines.to_lines(mapped(F.col("text"))).alias("lines"))


def _line_query(change: Callable[[Column], Column]) -> Query:
    return lambda spark, d: lines.explode_lines(_lines(spark, d).withColumn("lines", change(F.col("lines"))))


def _text_query(change: Callable[[Column], Column], cjk: bool = False) -> Query:
    source = mapped if cjk else lambda c: c
    return lambda spark, d: documents(spark, d).select("doc_id", change(source(F.col("text"))).alias("result"))


# --- SQL pieces -------------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    """A SQL string literal; control characters by chr()."""
    if "\n" in s:
        return "(" + " || chr(10) || ".join(_q(p) for p in s.split("\n")) + ")"
    return "'" + s.replace("'", "''") + "'"


def _replaced(expr: str, found: list[rules.Rule]) -> str:
    for r in found:
        if r.find:
            expr = f"replace({expr}, {_q(r.find)}, {_q(r.replace or '')})"
    return expr


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


_WS = _class(charsets.WHITESPACE)
_CJK_RE = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}"
_MAPPED = f"translate(replace(replace(text, '.', '。'), ',', '，'), {_q(_FROM)}, {_q(_TO)})"
_SPLIT = f"""
    parts AS (SELECT doc_id, regexp_split_to_array({_MAPPED}, '\\r\\n|\\r|\\n') AS a FROM documents WHERE text IS NOT NULL),
    src AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN list_slice(a, 1, len(a) - 1) ELSE a END AS lines FROM parts)
"""


def _explode(source: str) -> str:
    return f"SELECT doc_id, CAST(u.line_no AS INTEGER) AS line_no, u.line FROM {source}, unnest(lines) WITH ORDINALITY AS u(line, line_no)"


def _fold(source: str, threshold: int, width: str, no_merge: str = "") -> str:
    stop = f" OR regexp_matches(x, '[{_class(no_merge)}][{_WS}]*$')" if no_merge else ""
    return f"""
        SELECT doc_id, CASE WHEN s.b <> '' THEN list_append(s.o, s.b) ELSE s.o END AS lines FROM (
          SELECT doc_id, list_reduce(list_prepend({{'o': []::VARCHAR[], 'b': '', 'w': 0::BIGINT, 'x': ''}},
              list_transform(lines, lambda l: {{'o': []::VARCHAR[], 'b': '', 'w': 0::BIGINT, 'x': l}})),
            lambda s, e: {{
              'o': CASE WHEN s.w + {width.format(x='e.x')} >= {threshold}{stop.replace('(x,', '(e.x,')} THEN list_append(s.o, s.b || e.x) ELSE s.o END,
              'b': CASE WHEN s.w + {width.format(x='e.x')} >= {threshold}{stop.replace('(x,', '(e.x,')} THEN '' ELSE s.b || e.x END,
              'w': CASE WHEN s.w + {width.format(x='e.x')} >= {threshold}{stop.replace('(x,', '(e.x,')} THEN 0 ELSE s.w + {width.format(x='e.x')} END,
              'x': ''}}) AS s
          FROM {source})
    """


def _islands(source: str, asks: str, refuses: str = "") -> str:
    """Gaps and islands: a line goes on the one before it if the last known ending there asks for more."""
    sure = f"regexp_matches(c, '^[{asks}]$')" + (f" AND NOT regexp_matches(c, '^[{refuses}]$')" if refuses else "")
    return f"""
        SELECT doc_id, list(line ORDER BY grp) AS lines FROM (
          SELECT doc_id, grp, string_agg(line, '' ORDER BY n) AS line FROM (
            SELECT doc_id, n, line, sum(CASE WHEN coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM (
              SELECT doc_id, n, line, lag(cont) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM (
                SELECT doc_id, n, line, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING), false) AS cont FROM (
                  SELECT doc_id, n, line, CASE WHEN c <> '' THEN {sure} END AS own FROM (
                    SELECT doc_id, u.n, u.line, regexp_extract(u.line, '([^{_WS}])[{_WS}]*$', 1) AS c
                    FROM {source}, unnest(lines) WITH ORDINALITY AS u(line, n))))))
          GROUP BY doc_id, grp)
        GROUP BY doc_id
    """


def _stages(*steps: str) -> str:
    """A query over the split documents; every step is SQL with {0} for the step before."""
    out, name = f"WITH {_SPLIT}", "src"
    for k, step in enumerate(steps):
        out += f", s{k} AS ({step.replace('{0}', name)})"
        name = f"s{k}"
    return f"{out} {_explode(name)}"


_CHARS, _BYTES = "length({x})", "strlen({x})"
_TRIM = "SELECT doc_id, list_transform(lines, lambda x: CASE WHEN starts_with(x, '，') THEN substr(x, 2) ELSE x END) AS lines FROM {0}"
_STOPS = "。！？人"
_PUNCT = "，我"


def _with_rules(found: list[rules.Rule]) -> str:
    return f"SELECT doc_id, list_transform(lines, lambda x: {_replaced('x', found)}) AS lines FROM {{0}}"


_FULL_RULES = (rules.Rule("的", "得"), rules.Rule("得一", ""), rules.Rule("。", "."))
_BREAK_RULES = (rules.Rule("\n", "¶"), rules.Rule("h", "H"))
FULL = (pipeline.MergeOptions(12, lines.Width.CHARS), pipeline.PostProcess(True, True, "，", True, "。", True, _FULL_RULES, True))


def _pipeline_rows(spark: SparkSession, d: str, *options) -> DataFrame:
    return pipeline.process(_lines(spark, d), *options)


def pipeline_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge at 20 bytes, CJK fix, comma trim."""
    return lines.explode_lines(_pipeline_rows(spark, sf_dir).select("doc_id", "lines"))


def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.explode_lines(_pipeline_rows(spark, sf_dir, *FULL).select("doc_id", "lines"))


def pipeline_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _pipeline_rows(spark, sf_dir, *FULL)
    return done.select("doc_id", F.size("lines").alias("n_lines"), "cjk_fixed", "punct_fixed", "trimmed", "replaced")


def _synthetic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as bytes, in an encoding that its number chooses; what GBK lacks is left out of the text there."""
    files.legacy_charsets(spark)
    kind = F.pmod("doc_id", F.lit(5))
    text = F.when(kind == 4, F.concat(F.lit("中文"), F.regexp_replace("text", "[^\\x00-\\x7F]", ""))).otherwise(F.col("text"))
    content = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("body", "UTF-8")))
        .when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("body", "UTF-16LE")))
        .when(kind == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("body", "UTF-16BE")))
        .when(kind == 3, F.encode("body", "UTF-8"))
        .otherwise(F.encode("body", "x-mswin-936"))
    )
    return documents(spark, sf_dir).withColumn("body", text).withColumn("content", content).select("doc_id", "content")


def detect_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synthetic_files(spark, sf_dir).select("doc_id", files.detect_encoding(F.col("content")).alias("encoding"))


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _synthetic_files(spark, sf_dir).withColumn("encoding", files.detect_encoding(F.col("content")))
    return found.select("doc_id", files.decode(F.col("content"), F.col("encoding")).alias("text"))


def join_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.select("source", F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("name"), "text")
    return joiner.join_pieces(named, "source", "name", newline="\n").withColumn("seq", F.col("seq").cast("long"))


def join_files_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined files written in parts, read back by their manifest, and cut into lines."""
    path = session.shared_path(spark, "joined")
    joined.write_joined(join_files(spark, sf_dir), path, "source", part_bytes=1 << 20)
    chunks = joined.read_joined(spark, path, read_bytes=2 << 20)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\\A\\x{FEFF}", "")
    lined = splits.lines_of_pieces(chunks.select("source", "start", text.alias("text")), "source", "start", "text")
    return lined.select(F.col("path").alias("source"), "line_no", "line")


def _file_texts(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each document, in the encoding that its number chooses."""
    folder = session.shared_path(spark, "files")
    stores.make_folder(folder)
    named = _synthetic_files(spark, sf_dir).select(_path_in(folder).alias("path"), "content")
    failed = sinks.write_files(named).where("error IS NOT NULL").head()
    if failed:
        raise OSError(f"{failed['path']}: {failed['error']}")
    return folder


def _path_in(folder: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt"))


def _number() -> Column:
    return F.regexp_extract("path", r"/(\d+)(_Processed)?\.txt$", 1).cast("long").alias("doc_id")


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.list_files(spark, _file_texts(spark, sf_dir), "*.TXT").select(_number(), "length")


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_files(spark, _file_texts(spark, sf_dir), "*.txt").select(_number(), "encoding", "text")


#: Bytes of the longest file that the batch reads, and of a split.
LONGEST, SPLIT = 20_000, 4096


def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with files that are too long and one that is not there."""
    folder = _file_texts(spark, sf_dir)
    found = files.scan_files(spark, [folder, f"{folder}/999999999.txt"], longest=LONGEST)
    return found.select(_number(), F.substring_index("error", ":", 1).alias("error"), F.sha2("text", 256).alias("text_sha256"))


def batch_files_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joiner.batch_summary(batch_files(spark, sf_dir))


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of files in all encodings, read in splits."""
    return splits.file_lines(spark, _file_texts(spark, sf_dir), SPLIT).select(_number(), "line_no", "line")


def processed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean-up pipeline from files to files, read back."""
    folder = _file_texts(spark, sf_dir)
    done = pipeline.process_files(spark, folder, pipeline.MergeOptions(40, lines.Width.CHARS))
    return _read_back(spark, folder, sinks.write_texts(done))


def replaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on whole files, written and read back."""
    folder = _file_texts(spark, sf_dir)
    return _read_back(spark, folder, sinks.write_texts(pipeline.replace_files(spark, folder, _BREAK_RULES)))


def _read_back(spark: SparkSession, folder: str, report: DataFrame) -> DataFrame:
    if report.where("error IS NOT NULL").head():
        raise OSError("a file was not written")
    return files.scan_files(spark, folder, "*_Processed.txt").select(_number(), "encoding", "text")


def _dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.explode_lines(_lines(spark, sf_dir))


def merge_long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_documents.merge_lines(_dealt_lines(spark, sf_dir), 60, _W.BYTES, _STOPS)


def fix_cjk_long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_documents.fix_cjk(_dealt_lines(spark, sf_dir), _STOPS)


def fix_punct_long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_documents.fix_punctuation(_dealt_lines(spark, sf_dir), _PUNCT)


def join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return joiner.file_counts(docs, "source")


def output_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", sinks.output_path(F.col("url")).alias("output_path"))


def _ords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the numbers, in all schemes, of the rules whose find is in the text."""
    return documents(spark, sf_dir).select("doc_id", rule_index.rules_in(mapped(F.col("text")), _ALL).alias("ords"))


def _rules_with_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of all schemes with the number of documents that they can change first."""
    use = _ords(spark, sf_dir).select(F.explode("ords").alias("ord")).groupBy("ord").agg(F.count(F.lit(1)).alias("n_docs"))
    table = rules.RuleSet(tuple(_ALL)).to_df(spark)
    return table.join(use, "ord", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0).cast("long")))


def scheme_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen schemes, their rules, and the documents that any of them can change."""
    chosen = [k for k, (name, _) in enumerate((s.name, r) for s in SCHEMES for r in s.rules) if name in CHOSEN]
    met = _ords(spark, sf_dir).agg(F.count(F.when(F.arrays_overlap("ords", F.array(*map(F.lit, chosen))), 1)).alias("n_docs"))
    counts = rules.scheme_summary(rules.SchemeCatalog.default().to_df(spark), CHOSEN)
    return counts.unionByName(met, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("n_schemes", "n_rules", "n_docs")))


def selected_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the chosen schemes, with the documents that each can change."""
    found = rules.selected_rules(rules.SchemeCatalog.default().to_df(spark), CHOSEN)
    sizes = [len(s.rules) for s in SCHEMES]
    first = F.array(*(F.lit(sum(sizes[:k])) for k in range(len(sizes))))
    use = _rules_with_use(spark, sf_dir).select("ord", "n_docs")
    return found.withColumn("ord", F.get(first, F.col("scheme_ord")) + F.col("pos")).join(use, "ord").drop("ord")


def rule_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule as it is shown, with the documents that it can change."""
    return _rules_with_use(spark, sf_dir).select("ord", F.concat("find", F.lit(rules.ARROW), F.coalesce("replace", F.lit(""))).alias("shown"), "n_docs")


def replayed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of edits made of the documents, a catalog for each source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind, index = (F.col("doc_id") * 7919 + F.col("n_chars")) % 8, (F.col("doc_id") * 31 + F.col("n_chars")) % 20
    names = F.array(*map(F.lit, [edit_log.ADD] * 4 + [edit_log.REPLACE, edit_log.DELETE, edit_log.UP, edit_log.DOWN]))
    log = docs.select("source", "doc_id", F.get(names, kind.cast("int")).alias("op"), index.alias("index"), F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("find"), F.col("n_chars").cast("string").alias("replace"))
    return edit_log.replay(log, "source", "doc_id")


def arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of files that are asked for in a stream, some of them again after a restart; those over the limit fail."""
    folder, root = _file_texts(spark, sf_dir), session.shared_path(spark, "status")
    asked = documents(spark, sf_dir).select("doc_id", _path_in(folder).alias("path"))
    for rows in (asked, asked.where("doc_id % 7 = 0")):
        rows.select("path").write.mode("append").parquet(f"{root}/requests")
        stream = spark.readStream.schema("path string").parquet(f"{root}/requests")
        status.start(stream, root, LONGEST, availableNow=True).awaitTermination()
    return status.current(spark, root).select(_number(), "attempts", "failures", F.substring_index("error", ":", 1).alias("error"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a pipe count as failed."""
    docs = documents(spark, sf_dir).withColumn("error", F.when(F.contains("text", F.lit("|")), F.lit("holds a pipe")))
    return joiner.batch_summary(docs)


def replace_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of all schemes as one table value."""
    table = rules.RuleSet(tuple(r for s in SCHEMES for r in s.rules)).to_df(spark)
    return documents(spark, sf_dir).select("doc_id", rule_index.apply_many(mapped(F.col("text")), rules.RuleSet.from_df(table).rules).alias("result"))


def replace_lines_vs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule with a line break matches in the whole text only."""
    rows = documents(spark, sf_dir).withColumn("lines", lines.to_lines(F.col("text")))
    by_line = F.array_join(rules.apply_rules_to_lines(F.col("lines"), _BREAK_RULES), "\n")
    return rows.select("doc_id", by_line.alias("by_line"), rules.apply_rules(F.col("text"), _BREAK_RULES).alias("by_text"))


def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", sinks.preview(F.col("lines")).alias("shown"), sinks.lines_to_text(F.col("lines")).alias("written"))


def conversations_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme 1 on every turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", "role", rules.apply_rules(F.col("text"), SCHEMES[0].rules).alias("result"))


_ALL = [r for s in SCHEMES for r in s.rules]
_SOURCE = f"(SELECT doc_id, {_MAPPED} AS t FROM documents)"
_CONTENT_TEXT = "CASE WHEN doc_id % 5 = 4 THEN '中文' || regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') ELSE text END"


def _flags_sql() -> str:
    merged, cjk, punct = _fold("src", 12, _CHARS, "。"), _islands("m", _CJK_RE, _class("。")), _islands("c", _class("，"), _class("。"))
    return f"""WITH {_SPLIT}, m AS ({merged}), c AS ({cjk}), p AS ({punct})
        SELECT doc_id, CAST(coalesce(len(p.lines), 0) AS INTEGER) AS n_lines, coalesce(len(c.lines), 0) <> len(m.lines) AS cjk_fixed,
               coalesce(len(p.lines), 0) <> coalesce(len(c.lines), 0) AS punct_fixed,
               coalesce(len(list_filter(p.lines, lambda x: starts_with(x, '，'))), 0) > 0 AS trimmed, true AS replaced
        FROM m LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_FILES = f"(SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS kind, {_CONTENT_TEXT} AS t FROM documents)"
_LENGTH = "CAST(CASE kind WHEN 0 THEN 3 + strlen(t) WHEN 1 THEN 2 + 2 * length(t) WHEN 2 THEN 2 + 2 * length(t) WHEN 3 THEN strlen(t) ELSE strlen(t) - 2 END AS BIGINT)"
_ENCODING = "CASE kind WHEN 0 THEN 'UTF-8 (BOM)' WHEN 1 THEN 'UTF-16 LE' WHEN 2 THEN 'UTF-16 BE' WHEN 3 THEN 'UTF-8' ELSE 'GBK (ANSI)' END"
_BATCH = f"""SELECT doc_id, CASE WHEN {_LENGTH} > {LONGEST} THEN 'ValueError' END AS error, CASE WHEN {_LENGTH} <= {LONGEST} THEN sha256(t) END AS text_sha256 FROM {_FILES}
             UNION ALL SELECT 999999999, 'FileNotFoundError', NULL"""
_FILE_SPLIT = f"""
    parts AS (SELECT doc_id, regexp_split_to_array(t, '\\r\\n|\\r|\\n') AS a FROM {_FILES}),
    src AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN list_slice(a, 1, len(a) - 1) ELSE a END AS lines FROM parts)
"""
_PROCESSED = f"""WITH {_FILE_SPLIT}, s0 AS ({_fold("src", 40, _CHARS)}), s1 AS ({_islands("s0", _CJK_RE)}), s2 AS ({_TRIM.replace("{0}", "s1")})
    SELECT src.doc_id, 'UTF-8 (BOM)' AS encoding, coalesce(array_to_string(list_transform(s2.lines, lambda x: x || chr(13) || chr(10)), ''), '') AS text FROM src LEFT JOIN s2 USING (doc_id)"""
_W = lines.Width
_ENTRIES: dict[str, tuple[Query, str]] = {
    "pipeline_default": (pipeline_default, _stages(_fold("{0}", 20, _BYTES), _islands("{0}", _CJK_RE), _TRIM)),
    "pipeline_full": (pipeline_full, _stages(_fold("{0}", 12, _CHARS, "。"), _islands("{0}", _CJK_RE, _class("。")), _islands("{0}", _class("，"), _class("。")), _TRIM, _with_rules(list(_FULL_RULES)))),
    "pipeline_flags": (pipeline_flags, _flags_sql()),
    "scan_lines": (_line_query(lambda c: c), _stages()),
    "merge_char_12": (_line_query(lambda c: lines.merge_lines(c, 12, _W.CHARS)), _stages(_fold("{0}", 12, _CHARS))),
    "merge_char_20": (_line_query(lambda c: lines.merge_lines(c, 20, _W.CHARS)), _stages(_fold("{0}", 20, _CHARS))),
    "merge_byte_20": (_line_query(lambda c: lines.merge_lines(c, 20, _W.BYTES)), _stages(_fold("{0}", 20, _BYTES))),
    "merge_no_merge": (_line_query(lambda c: lines.merge_lines(c, 60, _W.BYTES, _STOPS)), _stages(_fold("{0}", 60, _BYTES, _STOPS))),
    "fix_cjk": (_line_query(lines.fix_cjk), _stages(_islands("{0}", _CJK_RE))),
    "fix_cjk_no_merge": (_line_query(lambda c: lines.fix_cjk(c, _STOPS)), _stages(_islands("{0}", _CJK_RE, _class(_STOPS)))),
    "fix_punct": (_line_query(lambda c: lines.fix_punctuation(c, _PUNCT)), _stages(_islands("{0}", _class(_PUNCT)))),
    "fix_punct_no_merge": (_line_query(lambda c: lines.fix_punctuation(c, _PUNCT + "人", "人")), _stages(_islands("{0}", _class(_PUNCT + "人"), _class("人")))),
    "trim_leading_comma": (_line_query(lambda c: lines.trim_leading_comma(F.transform(c, lambda x: F.concat(F.lit("，"), x)))), _stages("SELECT doc_id, list_transform(lines, lambda x: '，' || x) AS lines FROM {0}", _TRIM)),
    "ends_with_any": (
        lambda spark, d: lines.explode_lines(_lines(spark, d)).select("doc_id", "line_no", charsets.ends_with_any(F.col("line"), _STOPS).alias("ends"), charsets.is_cjk(F.right("line", F.lit(1))).alias("cjk")),
        f"SELECT doc_id, line_no, regexp_matches(line, '[{_class(_STOPS)}][{_WS}]*$') AS ends, regexp_matches(right(line, 1), '^[{_CJK_RE}]$') AS cjk FROM ({_stages()})",
    ),
    "widths": (
        lambda spark, d: lines.explode_lines(_lines(spark, d)).select("doc_id", "line_no", charsets.width_chars(F.col("line")).alias("chars"), charsets.width_bytes(F.col("line")).alias("bytes"), charsets.width_bytes(F.col("line"), "UTF-16LE").alias("bytes16")),
        f"SELECT doc_id, line_no, CAST(length(line) AS INTEGER) AS chars, CAST(strlen(line) AS INTEGER) AS bytes, CAST(2 * length(line) AS INTEGER) AS bytes16 FROM ({_stages()})",
    ),
    **{f"replace_scheme_{k + 1}": (_text_query(lambda c, s=s: rules.apply_rules(c, s.rules), cjk=True), f"SELECT doc_id, {_replaced('t', list(s.rules))} AS result FROM {_SOURCE}") for k, s in enumerate(SCHEMES)},
    "replace_all": (_text_query(lambda c: rules.apply_rules(c, _ALL), cjk=True), f"SELECT doc_id, {_replaced('t', _ALL)} AS result FROM {_SOURCE}"),
    "replace_rule_table": (replace_rule_table, f"SELECT doc_id, {_replaced('t', _ALL)} AS result FROM {_SOURCE}"),
    "replace_lines_vs_text": (
        replace_lines_vs_text,
        f"""SELECT doc_id, array_to_string(list_transform(CASE WHEN a[-1] = '' THEN list_slice(a, 1, len(a) - 1) ELSE a END, lambda x: {_replaced('x', list(_BREAK_RULES))}), chr(10)) AS by_line,
            {_replaced('text', list(_BREAK_RULES))} AS by_text FROM (SELECT doc_id, text, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS a FROM documents)""",
    ),
    "preview_text": (preview_text, f"WITH {_SPLIT} SELECT doc_id, array_to_string(lines, chr(10)) AS shown, array_to_string(list_transform(lines, lambda x: x || chr(13) || chr(10)), '') AS written FROM src"),
    "detect_encoding": (detect_encoding, "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'UTF-8 (BOM)' WHEN 1 THEN 'UTF-16 LE' WHEN 2 THEN 'UTF-16 BE' WHEN 3 THEN 'UTF-8' ELSE 'GBK (ANSI)' END AS encoding FROM documents"),
    "decode_roundtrip": (decode_roundtrip, f"SELECT doc_id, {_CONTENT_TEXT} AS text FROM documents"),
    "join_files": (
        join_files,
        """SELECT source, row_number() OVER (PARTITION BY source ORDER BY upper(name), name) AS seq, name, text || CASE WHEN ends_with(text, chr(10)) THEN '' ELSE chr(10) END AS piece
           FROM (SELECT source, lang || '_' || doc_id AS name, text FROM documents)""",
    ),
    "join_files_written": (
        join_files_written,
        """WITH pieces AS (SELECT source, upper(lang || '_' || doc_id) AS u, lang || '_' || doc_id AS name, text || CASE WHEN ends_with(text, chr(10)) THEN '' ELSE chr(10) END AS piece FROM documents),
           whole AS (SELECT source, string_agg(piece, '' ORDER BY u, name) AS t FROM pieces GROUP BY source),
           parts AS (SELECT source, regexp_split_to_array(t, '\\r\\n|\\r|\\n') AS a FROM whole)
           SELECT source, u.line_no, u.line FROM parts, unnest(a[1:len(a) - 1]) WITH ORDINALITY AS u(line, line_no)""",
    ),
    "listed_files": (listed_files, f"SELECT doc_id, {_LENGTH} AS length FROM {_FILES}"),
    "scanned_files": (scanned_files, f"SELECT doc_id, {_ENCODING} AS encoding, t AS text FROM {_FILES}"),
    "batch_files": (batch_files, _BATCH),
    "batch_files_status": (batch_files_status, f"SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS succeeded, 'Partial' AS status FROM ({_BATCH})"),
    "file_lines": (file_lines, f"WITH {_FILE_SPLIT} SELECT doc_id, u.line_no, u.line FROM src, unnest(lines) WITH ORDINALITY AS u(line, line_no)"),
    "processed_files": (processed_files, _PROCESSED),
    "replaced_files": (replaced_files, f"SELECT doc_id, 'UTF-8 (BOM)' AS encoding, {_replaced('t', list(_BREAK_RULES))} AS text FROM {_FILES}"),
    "merge_long_documents": (merge_long_documents, f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM ({_stages(_fold('{0}', 60, _BYTES, _STOPS))})"),
    "fix_cjk_long_documents": (fix_cjk_long_documents, f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM ({_stages(_islands('{0}', _CJK_RE, _class(_STOPS)))})"),
    "fix_punct_long_documents": (fix_punct_long_documents, f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM ({_stages(_islands('{0}', _class(_PUNCT)))})"),
    "join_counts": (join_counts, "SELECT source, count(*) AS file_count FROM documents GROUP BY source"),
    "output_path": (output_path, r"SELECT page_id, regexp_replace(url, '^(.*?)(\.[^./\\]*)?$', '\1_Processed\2') AS output_path FROM pages"),
    "scheme_summary": (
        scheme_summary,
        f"""SELECT count(*) AS n_schemes, CAST(sum(n) AS BIGINT) AS n_rules, any_value(n_docs) AS n_docs FROM (VALUES {_values([(s.name, len(s.rules)) for s in SCHEMES])}) v(name, n),
            (SELECT count(*) FILTER (WHERE len(list_filter([{', '.join(_q(r.find) for s in SCHEMES if s.name in CHOSEN for r in s.rules)}], lambda f: contains(t, f))) > 0) AS n_docs FROM {_SOURCE}) WHERE name IN ({', '.join(map(_q, CHOSEN))})""",
    ),
    "selected_rules": (
        selected_rules,
        f"""SELECT scheme_ord, pos, find, "replace", count(*) FILTER (WHERE contains(t, find)) AS n_docs
            FROM (VALUES {_values([(s.name, k, j, r.find, r.replace) for k, s in enumerate(SCHEMES) for j, r in enumerate(s.rules)])}) v(name, scheme_ord, pos, find, "replace"), {_SOURCE} WHERE name IN ({', '.join(map(_q, CHOSEN))}) GROUP BY ALL""",
    ),
    "rule_display": (
        rule_display,
        f"""SELECT ord, find || '{rules.ARROW}' || repl AS shown, count(*) FILTER (WHERE contains(t, find)) AS n_docs
            FROM (VALUES {_values([(k, r.find, r.replace) for k, r in enumerate(_ALL)])}) v(ord, find, repl), {_SOURCE} GROUP BY ord, find, repl""",
    ),
    "replayed_edits": (
        replayed_edits,
        """WITH e AS (SELECT source, doc_id, (doc_id * 7919 + n_chars) % 8 AS k, (doc_id * 31 + n_chars) % 20 AS i, {'f': lang || '_' || doc_id, 'r': n_chars::VARCHAR} AS v FROM documents),
           l AS (SELECT source, list({'s': []::STRUCT(f VARCHAR, r VARCHAR)[], 'k': k, 'i': i, 'v': v} ORDER BY doc_id) AS a FROM e GROUP BY source),
           z AS (SELECT source, list_reduce(list_prepend({'s': []::STRUCT(f VARCHAR, r VARCHAR)[], 'k': 0::BIGINT, 'i': 0::BIGINT, 'v': {'f': '', 'r': ''}}, a), lambda s, e: {'s':
               CASE WHEN e.k < 4 OR (e.k = 4 AND e.i >= len(s.s)) THEN list_append(s.s, e.v)
                    WHEN e.i >= len(s.s) THEN s.s
                    WHEN e.k = 4 THEN list_slice(s.s, 1, e.i) || [e.v] || list_slice(s.s, e.i + 2, len(s.s))
                    WHEN e.k = 5 THEN list_slice(s.s, 1, e.i) || list_slice(s.s, e.i + 2, len(s.s))
                    WHEN e.k = 6 AND e.i > 0 THEN list_slice(s.s, 1, e.i - 1) || [s.s[e.i + 1], s.s[e.i]] || list_slice(s.s, e.i + 2, len(s.s))
                    WHEN e.k = 7 AND e.i + 1 < len(s.s) THEN list_slice(s.s, 1, e.i) || [s.s[e.i + 2], s.s[e.i + 1]] || list_slice(s.s, e.i + 3, len(s.s))
                    ELSE s.s END, 'k': e.k, 'i': e.i, 'v': e.v}) AS z FROM l)
           SELECT source, u.pos - 1 AS pos, u.x.f AS find, u.x.r AS "replace" FROM z, unnest(z.s) WITH ORDINALITY AS u(x, pos)""",
    ),
    "arriving_files": (
        arriving_files,
        f"SELECT doc_id, n AS attempts, CASE WHEN bad THEN n ELSE 0 END AS failures, CASE WHEN bad THEN 'ValueError' END AS error FROM (SELECT doc_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n, {_LENGTH} > {LONGEST} AS bad FROM {_FILES})",
    ),
    "batch_summary": (batch_summary, "SELECT count(*) AS total, count(*) FILTER (WHERE NOT contains(text, '|')) AS succeeded, CASE WHEN count(*) = count(*) FILTER (WHERE NOT contains(text, '|')) THEN 'Complete' ELSE 'Partial' END AS status FROM documents"),
    "conversations_clean": (conversations_clean, f"SELECT conv_id, turn, role, {_replaced('text', list(SCHEMES[0].rules))} AS result FROM conversations"),
}

QUERIES: dict[str, Query] = {k: q for k, (q, _) in _ENTRIES.items()}
ORACLE_SQL: dict[str, str] = {k: sql for k, (_, sql) in _ENTRIES.items()}
