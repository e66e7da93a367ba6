"""The thin queries over the operators, and DuckDB SQL where SQL can express their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, html_extract, language_id, mixing, near_dedup, packing, substrings, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _share(modulus: int):
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    out = warc.read(archives, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(_share(5) != 0))
    out = toxicity.score(docs, machine)
    return out.select("doc_id", F.coalesce(_share(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out, _ = mixing.mix(docs, labels, weights={"0": 0.1, "1": 0.9})
    return out


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(_share(4) != 2))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(_share(4) == 2, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_successors(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.link_classes(_table(spark, sf_dir, "documents"), k=2)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op7's result SQL can express: the texts' lengths and their edited forms."""
    return op7_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10's result SQL can express: every document's words are in its sequences, once."""
    pieces = op10_packing(spark, sf_dir).select(F.explode(F.arrays_zip("doc_ids", "lengths")).alias("p"))
    return pieces.groupBy(F.col("p.doc_ids").alias("doc_id")).agg(F.sum("p.lengths").alias("n_words"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_substrings, op3_warc, op4_toxicity, op5_mixing, op6_language_id, op7_fingerprints, op8_exact_dedup, op9_near_dedup, op10_packing, edited_texts, packed_words)}

ORACLES = {
    "edited_texts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
        s AS (
            SELECT doc_id, t, n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS follows FROM d
        )
        SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 3) || left(follows, n // 3)) AS edited_sha256 FROM s
    """,
    "packed_words": r"""
        SELECT doc_id, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents
    """,
    "op3_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(h)) AS payload_bytes, unhex(sha1(h)) AS x FROM p
        ), b AS (
            SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(x::BIT::VARCHAR, 1 + 5 * i, 5))::INTEGER, 1)), '') AS payload_digest
            FROM d
        ), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM b)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM g
    """,
    "op2_substrings": r"""
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v FROM documents
        ), p AS (
            SELECT doc_id, unnest(range(1, len(v) - 11)) AS i FROM w WHERE len(v) >= 13
        ), g AS (
            SELECT p.doc_id, p.i, array_to_string(w.v[p.i : p.i + 12], ' ') AS g FROM p JOIN w USING (doc_id)
        ), f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
        c AS (
            SELECT DISTINCT doc_id, unnest(range(g.i, g.i + 13)) AS j FROM g JOIN f USING (g) WHERE f.first < g.doc_id
        ), r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
        k AS (
            SELECT w.doc_id, len(w.v) AS n_words, coalesce(len(r.gone), 0) AS n_removed,
                   CASE WHEN r.gone IS NULL THEN w.v
                        ELSE list_transform(list_filter(range(1, len(w.v) + 1), lambda j: NOT list_contains(r.gone, j)), lambda j: w.v[j]) END AS kept
            FROM w LEFT JOIN r USING (doc_id)
        )
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op9_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(v) = 1 THEN [v[1]]
                ELSE list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1]) END) AS g
            FROM w WHERE len(v) > 0
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
        p AS (  -- the rarest shingles of a set: two sets that are similar enough share one of them
            SELECT doc_id, g FROM (
                SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.df, s.g) AS r
                FROM s JOIN f USING (g) JOIN n USING (doc_id)
            ) WHERE r <= n - ceil(0.8 * n) + 1
        ), c AS (
            SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
            FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id
            JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
            WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
        ), l AS (
            SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND x.g = y.g
            JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b
            GROUP BY c.a, c.b, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
        ), e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
        r(u, v) AS (SELECT u, u FROM (SELECT DISTINCT u FROM e) UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
        k AS (SELECT u, min(v) AS c FROM r GROUP BY u)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.c, d.doc_id) AS component_id, coalesce(k.c, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.u = d.doc_id
    """,
}
