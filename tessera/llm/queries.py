"""One thin query for each operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, classifier, decontaminate, html, knn, linededup, minhash, recompression, spm, warc
from tessera.llm.common import table


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_html_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat(m["start"], F.lit("-"), m["end"])), " ")
    return out.withColumn("mask", mask)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> classifier.Model:
    labels = table(spark, sf_dir, "labels")
    return classifier.train(docs, labels.select("doc_id", classifier.grade(F.col("quality"), F.col("toxic")).alias("grade")))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classifier.score(docs, quality_model(spark, docs, sf_dir))
    return scored.withColumn("accepted", F.col("tail") >= classifier.ACCEPT)


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), spm.model_bytes(spark, f"file://{TOKENIZER}"))


def op7_block_join_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, captures = warc.write_archive(table(spark, sf_dir, "pages"))
    return archive.read(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_recompression_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompression.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


QUERIES = {
    "op1_pigeonhole_decontamination": op1_pigeonhole_decontamination,
    "op2_patience_line_dedup": op2_patience_line_dedup,
    "op3_html_consensus_paths": op3_html_consensus_paths,
    "op4_perspective_rotation": op4_perspective_rotation,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_sentencepiece_suffix_array": op6_sentencepiece_suffix_array,
    "op7_block_join_knn": op7_block_join_knn,
    "op8_warc_capture_index": op8_warc_capture_index,
    "op9_recompression_substring_dedup": op9_recompression_substring_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}
ORACLE: dict[str, str] = {
    "op4_perspective_rotation": """
        WITH t AS (
            SELECT conv_id, turn, replace(regexp_replace(role, '[\\r\\n]+', ' ', 'g'), '<|', '< |') AS speaker,
                   replace(coalesce(text, ''), '<|', '< |') AS text, coalesce(floor(turn / 256)::bigint, -1) AS block
            FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL),
        p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
        r AS (
            SELECT t.*, p.perspective, speaker = perspective AS own,
                   '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
                                          ELSE 'user name=' || speaker END || chr(10) AS head,
                   t.text || '<|im_end|>' || chr(10) AS body
            FROM t JOIN p USING (conv_id)),
        o AS (
            SELECT *, sum(length(head) + length(body)) OVER (
                          PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, speaker, text
                          ROWS UNBOUNDED PRECEDING) AS stop,
                   row_number() OVER (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, speaker, text) AS k
            FROM r)
        SELECT conv_id, perspective, dense_rank() OVER (PARTITION BY conv_id, perspective ORDER BY block) - 1 AS part,
               count(*) AS n_turns, count(*) FILTER (own) AS n_assistant, string_agg(head || body, '' ORDER BY k) AS text,
               coalesce(string_agg(CASE WHEN own THEN (stop - length(body))::varchar || '-' || stop::varchar END, ' ' ORDER BY k), '') AS mask
        FROM o GROUP BY conv_id, perspective, block""",
    "op7_block_join_knn": """
        WITH v AS (
            SELECT vec_id, embedding::double[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_recompression_substring_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        p AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
        s AS (SELECT r, k, array_to_string(list_slice(w, k, k + 34), ' ') AS win
              FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
        twice AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
        hit AS (SELECT r, k FROM s WHERE win IN (SELECT win FROM twice)),
        g AS (SELECT p.r, p.k, word, max(hit.k) OVER (PARTITION BY p.r ORDER BY p.k ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
              FROM p LEFT JOIN hit ON hit.r = p.r AND hit.k = p.k),
        o AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM g GROUP BY r)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN o USING (r)""",
    "op10_minhash_near_dedup": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 3), ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS k FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op8_warc_capture_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT page_id, strlen(html)::bigint AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS last FROM p),
        g AS (SELECT *, list_transform(range(0, 40, 5), lambda i: ('0x' || substr(x, i + 1, 5))::bigint) AS parts FROM k)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31)::int + 1, 1)), '')), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
        FROM g""",
}
