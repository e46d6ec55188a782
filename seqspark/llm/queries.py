"""The queries of the operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqspark.llm import bloom_search, decontaminate, embed_caps, license_scan, maxent, mixing, resample, shards, simhash, suffix_dedup, token_parquet, toxicity, warc
from seqspark.llm.common import new_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_report(warc.read_pages(spark, path)).drop("n_segments")


def op2_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_parquet.round_trip(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.report(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bloom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shards(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_parquet": op2_token_parquet,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_caps": op5_embedding_caps,
    "op6_maxent": op6_maxent,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_license_scan": op9_license_scan,
    "op10_decontaminate": op10_decontaminate,
    "op11_bloom_search": op11_bloom_search,
    "op12_resample": op12_resample,
    "op13_shards": op13_shards,
}

#: Words of lower-case letters, digits and characters beyond ASCII, in DuckDB; only A-Z are lowered.
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST(('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS digest,
                min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d
    """,
    "op8_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, length(bin(CAST(strlen(coalesce(text, '')) AS BIGINT))) AS digits,
                md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || 'mix' || md5(coalesce(text, ''))) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
        w AS (SELECT *, CAST((k - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) / ((k - 1) % 3 + 1) AS ratio FROM s),
        l AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
              FROM w WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight, 0)) AS target FROM l),
        c AS (SELECT t.*, digits, words FROM (SELECT source, digits, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL) x JOIN t ON t.source IS NOT DISTINCT FROM x.source),
        cl AS (SELECT *, 3.0::DOUBLE / digits AS ratio, (target - 3 * coalesce(CAST(sum(words) OVER o AS BIGINT), 0)) / nullif(CAST(sum(words * digits) OVER (PARTITION BY source) - coalesce(sum(words * digits) OVER o, 0) AS DOUBLE), 0) AS level
               FROM c WINDOW o AS (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        cr AS (SELECT *, CASE WHEN target > 0 THEN least(3.0::DOUBLE, coalesce(arg_max(level, digits) FILTER (level <= ratio) OVER (PARTITION BY source) * digits, 3.0)) ELSE 0 END AS r FROM cl),
        g AS (SELECT *, CAST(floor(r) AS INT) AS copies, r - floor(r) AS p, target - CAST(sum(CAST(floor(r) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM cr),
        u AS (SELECT *, (CAST(('0x' || substr(key, 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u, row_number() OVER () AS n FROM d),
        r AS (SELECT u.*, source_size, target, copies, p, rest, u / (1 - u) / (p / (1 - p)) AS odds FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source AND u.digits = g.digits),
        o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), key, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS till FROM r WHERE p > 0),
        e AS (SELECT source, arg_min(till, abs(till - rest) * 4 + CASE WHEN till > rest THEN 1 ELSE 0 END) AS last FROM (SELECT source, rest, till FROM o UNION ALL SELECT DISTINCT source, rest, 0 FROM g) GROUP BY source)
        SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * (r.copies + CASE WHEN r.p > 0 AND o.till <= e.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM r LEFT JOIN o ON o.n = r.n LEFT JOIN e ON e.source IS NOT DISTINCT FROM r.source
    """,
    "op11_bloom_search": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format('text')} AS terms FROM documents),
        e AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
        z AS (SELECT doc_id, r, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM z),
        i AS (SELECT DISTINCT item_id, text, unnest({_WORDS.format('text')}) AS term FROM benchmark),
        w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM e, c WHERE term IN (SELECT term FROM i) GROUP BY term, docs),
        s AS (SELECT i.item_id, i.text, z.r, z.doc_id, CAST(sum(w.w * ((1000000000 * e.tf) // (1000 * e.tf + 8 * (100 - 90 + (90 * z.n * c.docs) // c.words)))) AS BIGINT) AS score
              FROM i JOIN w USING (term) JOIN e USING (term) JOIN z USING (r), c GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
    """,
    "op12_resample": f"""
        WITH t AS (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS x FROM range(0, 256) r(i)),
        crc AS (SELECT list(x ORDER BY i) AS t FROM t),
        d AS (SELECT doc_id, row_number() OVER () AS r, true AS own, {_WORDS.format("coalesce(text, '')")} AS words FROM documents
              UNION ALL SELECT NULL, -row_number() OVER (), false, {_WORDS.format("coalesce(text, '')")} FROM benchmark),
        f AS (SELECT r, own, unnest(list_concat(words, list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]))) AS f FROM d),
        h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
        y AS (SELECT f, list_transform(range(0, length(x) // 2), lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS INT), 2) AS BIGINT)) AS bytes FROM h),
        b AS (SELECT f, xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[CAST(xor(c, v) & 255 AS INT) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM y, crc),
        n AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN b USING (f) GROUP BY bucket),
        g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
        w AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE own GROUP BY r),
        e AS (SELECT doc_id, r, len(words) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
              CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r) WHERE own),
        p AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
        q AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM p)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM q
    """,
}
