"""The queries of this subpackage: each applies one operator to its whole table and derives the digests of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, conversation, dedup, fim, html, langid, licenses, ngramjoin, packing, quality, rangecoder, simhash, tokencount, workspace
from quillmill.session import spread

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workspace.bound_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = simhash.edited_likeness(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.with_decoded(bpe.with_ids(docs, MULTI_RANKS).select("doc_id", "ids"), MULTI_RANKS)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.with_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def held_out() -> Column:
    """Rows that no model learns from: crc32 of the identifier as text, a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    found = langid.with_spans(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality.with_score(docs, model, out="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = workspace.new_path(spark, "ids")
    manifest = rangecoder.write_files(table(spark, sf_dir, "documents"), BYTE_BPE, uri)
    docs = rangecoder.read_files(manifest, uri)
    return docs.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the length first, so that no text goes through a shuffle
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = tokencount.with_token_count(docs, PIECES)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedup.copy_groups(table(spark, sf_dir, "documents"), keep="max")
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngramjoin.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of ``conv_id:turn``, a null counting as a space; ``there`` is false for rows that are dropped."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), (kind != 0).alias("there"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("there"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fim.with_fim(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made, form = F.col("fim.output"), F.col("fim.form")
    digests = F.sha2(made, 256).alias("output_sha256"), F.sha2(fim.restored(made, form), 256).alias("restored_sha256")
    return docs.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", *digests)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("licenses.matches")
    base = F.filter(found, lambda m: m["exact"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(m["label"])), ",")
    starts = base["start"]
    return licenses.with_licenses(docs, licenses.fit(docs)).select(
        "doc_id",
        "licenses.n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(found).alias("labels"),
        F.coalesce(F.array_max(found["coverage"]), F.lit(0.0)).alias("score"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html": op3_html,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_id_files": op6_id_files,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_fim": op12_fim,
    "op13_licenses": op13_licenses,
}

#: crc32 of the ASCII column k of raw, by bits, as the column crc of crcs.
_CRC32_SQL = """crcs AS (SELECT * EXCLUDE (k), xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS crc FROM raw),"""

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)
    """,
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op11_conversation_repair": r"""
        WITH RECURSIVE
        raw AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        """
    + _CRC32_SQL
    + r"""
        damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                           CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
                    FROM (SELECT conv_id, turn, role, text, crc % 20 AS d FROM crcs), unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM damaged),
        faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
                                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'w' END AS fault,
                          lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
                   FROM placed),
        ins AS (SELECT * FROM (VALUES (0, 0, '', '', 0), (1, 1, '', '', 0), (2, 2, '', '', 0), (3, 3, '', '', 0),
                                      (0, 2, 'I', chr(10) || 'user:', 3), (1, 2, 'I', chr(10) || 'user:', 3), (2, 3, 'I', chr(10) || 'assistant:', 3), (3, 2, 'I', chr(10) || 'user:', 3),
                                      (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6),
                                      (2, 2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 6), (3, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 6)) v(q, q2, letters, added, price)),
        ways AS (SELECT conv_id, 0 AS n, 0 AS q, {'cost': 0, 'audit': '', 'made': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, n, q, min(best) AS best FROM (
                SELECT w.conv_id, f.n, e.q AS q,
                       {'cost': w.best.cost + i.price + e.price, 'audit': w.best.audit || i.letters || e.letter,
                        'made': w.best.made || i.added || CASE WHEN e.letter = 'D' THEN '' ELSE chr(10) || e.role || ':' || f.text END} AS best
                FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN ins i ON i.q = w.q,
                     LATERAL (SELECT 'D' AS letter, i.q2 AS q, 4 AS price, '' AS role
                        UNION ALL SELECT 'R', CASE i.q2 WHEN 2 THEN 3 ELSE 2 END, CASE f.fault WHEN 't' THEN 6 ELSE 3 END, CASE i.q2 WHEN 2 THEN 'assistant' ELSE 'user' END WHERE f.fault IN ('t', 'w')
                        UNION ALL SELECT 'K', t.q2, CASE f.fault WHEN 't' THEN 3 ELSE 0 END, f.role
                            FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(q, x, q2) WHERE f.fault IN ('t', 'w') AND t.q = i.q2 AND t.x = left(f.role, 1)) e)
            GROUP BY conv_id, n, q),
        ends AS (SELECT conv_id, max(n) AS n FROM faulty GROUP BY conv_id),
        final AS (SELECT w.conv_id, min({'cost': w.best.cost + i.price, 'audit': w.best.audit || i.letters, 'made': w.best.made || i.added}) AS best
                  FROM ways w LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id JOIN ins i ON i.q = w.q WHERE w.n = coalesce(e.n, 0) AND i.q2 IN (0, 3) GROUP BY w.conv_id),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                          count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
        SELECT f.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               f.best.cost::BIGINT AS cost, f.best.audit AS audit, sha256(substr(f.best.made, 2)) AS repaired_sha256
        FROM final f LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id
    """,
    "op12_fim": r"""
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
                     ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM h),
        c AS (SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, len(w)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
}
