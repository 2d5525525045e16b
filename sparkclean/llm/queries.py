"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.llm import bpe, chat_format, html_text, packing, quality, secret_scan, shingle_join, token_counts, topk, vector_dedup, warc, whitening, word_runs
from sparkclean.sources.scratch import scratch_path

#: Vectors that can be compared, for DuckDB.
_SOUND_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _reached_sql(links: str) -> str:
    """reached(id, component): everything that links lead to, itself included."""
    return f"""reached AS (SELECT id, id AS component FROM nodes UNION SELECT l.b, r.component FROM reached r JOIN {links} l ON l.a = r.id)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from transcripts; the roles of two thirds of the conversations train the model."""
    turns = _table(spark, sf_dir, "conversations")
    model = chat_format.fit_chat(turns, F.crc32(F.col("conv_id").cast("string")) % 3 != 1)
    return chat_format.parse_transcripts(chat_format.transcripts(turns), model).withColumnRenamed("id", "conv_id")


def op6_topk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP6_SQL = f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_SOUND_SQL}),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def op7_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract_text(pages, html_text.learn_weights(pages))


def op8_join_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join_shingles(_table(spark, sf_dir, "documents"), width=4, least=85)


OP8_SQL = f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w),
    nodes AS MATERIALIZED (SELECT doc_id AS id, len(shingles) AS n FROM sets),
    postings AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS s FROM sets),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM postings a JOIN postings b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM shared JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    {_reached_sql('links')}
    SELECT id AS doc_id, n AS n_shingles, component_id FROM nodes JOIN (SELECT id, min(component) AS component_id FROM reached GROUP BY id) USING (id)"""


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode_texts(_table(spark, sf_dir, "documents"), path)
    return bpe.decode_ids(ids, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op10_dedup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


OP10_SQL = f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
                         WHERE label IS NOT NULL AND {_SOUND_SQL} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
                           ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.93),
    nodes AS (SELECT vec_id AS id FROM embeddings), {_reached_sql('links')},
    c AS (SELECT id, min(component) AS component_id FROM reached GROUP BY id)
    SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM c"""


def op11_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = _table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.write_warc(warc.page_records(pages), path)
    return warc.archived_pages(spark, path, pages.schema["page_id"].dataType.simpleString())


OP11_SQL = """
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN again THEN least_id END AS refers_to
    FROM (SELECT *, payload_bytes >= 100 AND page_id > least_id AS again
          FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                       min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least_id
                FROM pages))"""


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of a tenth of the documents repeat from one of them on, as the query's contract plants them."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hot = docs.select("doc_id", "text", F.when(crc % 10 == 0, words).alias("words"), F.floor(crc / 10).alias("g"))
    sized = hot.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, int(g % n), null)"))
    sized = sized.withColumn("p", F.expr("if(n > 0, 1 + int((n - a) div (3 + g % 8)), null)"))
    again = "slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)"
    return sized.select("doc_id", F.expr(f"if(n > 0, array_join(concat(slice(words, 1, a), {again}), ' '), text)").alias("text"))


def op12_find_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.find_runs(_planted(_table(spark, sf_dir, "documents")), least=12)
    best = found.withColumn("best", F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"))
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_whiten_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)


SQL = {"op6_topk_vectors": OP6_SQL, "op8_join_shingles": OP8_SQL, "op10_dedup_vectors": OP10_SQL, "op11_warc_pages": OP11_SQL}
QUERIES = {f.__name__: (f, SQL.get(f.__name__)) for f in (
    op1_pack_documents, op2_scan_secrets, op3_quality_scores, op4_count_tokens, op5_format_chats, op6_topk_vectors, op7_extract_pages,
    op8_join_shingles, op9_bpe_roundtrip, op10_dedup_vectors, op11_warc_pages, op12_find_runs, op13_whiten_vectors)}
