"""The registered queries of this package, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewarden.llm import (codes, exact, html, language, neardup, packing, pivots, quality, rules, sentencepieces, spelling, tokencounts,
                            urls)
from tidewarden.llm.common import bucket, table

#: The rules of the URL filter.
URL_RULES = "('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), " \
    "('com', '/fr/', 'allow'), ('com', '/de/', 'block')"


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.section_tokens(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), bucket("doc_id", 5) == 0
    trees = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.predict(docs.select("doc_id", "text"), trees).select(
        "doc_id", held_out.alias("held_out"), "quality.score", "quality.predicted")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), bucket("doc_id", 3) == 1
    model = language.learn(docs, ~held_out)
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents")).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {URL_RULES} AS t(host, path, verdict)")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_near_vectors": op1_near_vectors,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_near_dedup": op4_near_dedup,
    "op5_language": op5_language,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_main_text": op9_main_text,
    "op10_url_filter": op10_url_filter,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_quality_rules": op12_quality_rules,
    "op13_vector_codes": op13_vector_codes,
}


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """The rounds one after the other; each compares all entries."""
    assign = """a{r} AS MATERIALIZED (
          SELECT vec_id, p, any_value(y.x) AS x, min(CAST(list_sum(list_transform(range(1, len(y.x) + 1),
                 lambda k: (y.x[k] - b.x[k]) * (y.x[k] - b.x[k]))) AS BIGINT) * 16 + e) AS best
          FROM y JOIN b{r} b USING (p) GROUP BY vec_id, p)"""
    move = """b{n} AS MATERIALIZED (
          SELECT p, e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
            SELECT p, e, list(f ORDER BY k) AS x FROM (
              SELECT p, e, k, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (
                SELECT p, best % 16 AS e, k, sum(x[k]) AS s, count(*) AS n
                FROM a{r}, unnest(range(1, len(x) + 1)) AS t(k) GROUP BY ALL)) GROUP BY p, e) m USING (p, e))"""
    steps = [part.format(r=r, n=r + 1) for r in range(rounds) for part in (assign, move)] + [assign.format(r=rounds)]
    return f"""
        WITH v AS MATERIALIZED (
          SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
          WHERE len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
        y AS MATERIALIZED (
          SELECT vec_id, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] AS x FROM v, unnest(range(8)) AS t(p)),
        b0 AS MATERIALIZED (
          SELECT p, e, x FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM y) WHERE e < 16),
        {", ".join(steps)},
        books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS sha FROM b{rounds}),
        coded AS (
          SELECT vec_id, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error
          FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
        FROM coded JOIN v USING (vec_id), books"""


_SPELLING_SQL = r"""
        WITH RECURSIVE
        -- crc32 by its table, which follows from the polynomial
        crc AS MATERIALIZED (
          SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
          FROM range(256) AS r(i)),
        runs AS (
          SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
        counted AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY doc_id, w),
        hashed AS (
          SELECT w, n, xor(4294967295, list_reduce(
                   flatten(list_transform(string_split(doc_id || ':' || w, ''),
                                          lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM counted, crc),
        words AS MATERIALIZED (
          SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT n, CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word FROM hashed)
          WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        less AS MATERIALIZED (
          SELECT word, n, k, word[:k - 1] || word[k + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(k)),
        near AS (
          SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
        best AS MATERIALIZED (
          SELECT word, count(*) AS n_near, max(other_n) AS top_n, arg_min(other, (-other_n, other)) AS top FROM near GROUP BY word),
        formed AS MATERIALIZED (
          SELECT w.word, CASE WHEN top_n >= 10 * n THEN top END AS form, n, coalesce(n_near, 0) AS n_near,
                 CASE WHEN top_n >= 10 * n THEN top_n END AS form_n FROM words w LEFT JOIN best USING (word)),
        chain AS (
          SELECT word, word AS here, 0 AS depth FROM formed
          UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN formed f ON c.here = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, form, root, n, n_near, form_n
        FROM formed f JOIN (SELECT word, arg_max(here, depth) AS root FROM chain GROUP BY word) USING (word)"""

ORACLE = {
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
    "op10_url_filter": rf"""
        WITH p AS (
          SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        r AS (SELECT * FROM (VALUES {URL_RULES}) AS t(h, q, v)),
        best AS (
          SELECT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
          FROM (SELECT DISTINCT host, path FROM p) JOIN r
            ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path)
        SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path""",
    "op11_spelling_variants": _SPELLING_SQL,
    "op13_vector_codes": _codes_sql(),
}
