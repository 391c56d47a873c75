"""The queries of this subpackage, as __spark_entry__.py registers them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.urls import judge

    return judge(read(spark, sf_dir, "pages"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.jaccard import cluster

    return cluster(read(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.secrets import scan

    return scan(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.decontaminate import digest, find

    return digest(find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docloom.llm.bpe import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.language import predict_documents

    return predict_documents(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.warc import archive_pages

    return archive_pages(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_topk, op3_urls, op4_jaccard, op5_secrets, op6_decontaminate, op7_bpe, op8_quality, op9_language, op10_warc)}
ORACLE_SQL: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op3_urls": r"""
        WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        cut AS (
            SELECT row_number() OVER () AS r, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT r, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
        ), fit AS (
            SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS said FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
        ), hrefs AS (
            SELECT DISTINCT r, host AS src, translate(regexp_extract(substr(l, strpos(l, '//') + 2), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
            FROM (SELECT r, host, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1, 'i')) AS l FROM p WHERE host <> '')
        ), edges AS (SELECT src, dst, count(*) AS weight FROM hrefs WHERE src <> dst AND dst <> '' GROUP BY src, dst),
        hosts AS (
            SELECT host, bool_or(trusted) AND NOT blocked AS trusted, blocked FROM (
                SELECT host, coalesce(said = 'allow', false) AS trusted FROM p LEFT JOIN fit USING (r) WHERE host <> '' UNION ALL SELECT dst, false FROM edges
            ), LATERAL (SELECT list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS blocked) GROUP BY host, blocked
        ), home AS (
            SELECT 't' AS kind, host, 1.0::DOUBLE / count(*) OVER () AS rank FROM hosts WHERE trusted UNION ALL SELECT 'd', host, 1.0::DOUBLE / count(*) OVER () FROM hosts WHERE blocked
        ), steps AS (
            SELECT 't' AS kind, src, dst, weight::DOUBLE / sum(weight) OVER (PARTITION BY src) AS share FROM edges UNION ALL SELECT 'd', dst, src, weight::DOUBLE / sum(weight) OVER (PARTITION BY dst) FROM edges
        ), walk AS (
            SELECT 0 AS k, kind, host, rank FROM home
            UNION ALL SELECT walk.k + 1, steps.kind, steps.dst, sum(0.85 * share * rank) FROM walk JOIN steps ON walk.kind = steps.kind AND walk.host = steps.src WHERE walk.k < 100 GROUP BY walk.k, steps.kind, steps.dst
        ), bad AS (
            SELECT host FROM walk GROUP BY host HAVING coalesce(sum(rank) FILTER (kind = 'd'), 0) > 0.5 * sum(rank)
        )
        SELECT page_id, host, path, rule, CASE WHEN said IS NOT NULL THEN said WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM p LEFT JOIN fit USING (r)
    """,
    "op4_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), sets AS (
            SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
        ), e AS MATERIALIZED (SELECT r, doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets WHERE doc_id IS NOT NULL),
        linked AS MATERIALIZED (
            SELECT a.r AS a, b.r AS b, min(a.doc_id) AS da, min(b.doc_id) AS db FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
            GROUP BY a.r, b.r HAVING 185 * count(*) >= 85 * (min(a.n) + min(b.n))
        ), reach AS (
            SELECT a AS r, a AS x FROM linked UNION SELECT reach.r, linked.b FROM reach JOIN linked ON reach.x = linked.a
        ), least AS (SELECT reach.r, min(sets.doc_id) AS c FROM reach JOIN sets ON sets.r = reach.x GROUP BY reach.r),
        many AS (SELECT a AS r, count(*) AS n FROM linked GROUP BY a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(c, doc_id), doc_id) AS component_id, CAST(coalesce(many.n, 0) AS BIGINT) AS n_links
        FROM sets LEFT JOIN least USING (r) LEFT JOIN many USING (r)
    """,
    "op6_decontaminate": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
        ), i AS (
            SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL
        ), windows AS (
            SELECT DISTINCT item, CASE WHEN len(w) < 10 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 9], ' ') END AS g, CAST(least(len(w), 10) AS BIGINT) AS size
            FROM i, unnest(range(1, greatest(2, len(w) - 8))) AS t(k) WHERE len(w) > 0
        ), sizes AS (SELECT DISTINCT size FROM windows),
        spots AS (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS g FROM d, sizes, unnest(range(1, greatest(1, len(w) - size + 2))) AS t(k)),
        found AS MATERIALIZED (SELECT r, k, size, item FROM spots JOIN windows USING (g, size)),
        hit AS (SELECT r, count(DISTINCT p) AS n FROM found, unnest(range(k, k + size)) AS t(p) GROUP BY r),
        items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
    """,
    "op10_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
        ), g AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 1 + 10 * (k // 8), 10) AS UBIGINT) >> (35 - 5 * (k % 8))) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
            CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p JOIN g USING (h)
    """,
}
