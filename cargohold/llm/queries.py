"""The training-data operators on the tables of a data directory, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.llm import bpe
from cargohold.llm.decontamination import contamination
from cargohold.llm.exact_dedup import exact_dedup
from cargohold.llm.license_scan import TEMPLATES, license_scan
from cargohold.llm.line_dedup import line_dedup
from cargohold.llm.lm_scoring import lm_scores
from cargohold.llm.simhash import simhash_components
from cargohold.llm.token_files import store_tokens, stored_documents
from cargohold.llm.toxicity import Chain, fit_chain, toxicity
from cargohold.llm.warc import header_lines, resolved_revisits

_WORD_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capture_records(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: of each a response, and later a not-modified revisit.

    Pages whose number 13 divides are not found, and of those that 17 divides the
    answer is cut off. Pages of odd length send a weak tag again, those whose
    length five divides only a date, those whose length eleven divides the tag of
    an older version.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    size = F.length(F.coalesce("html", F.lit("")))
    base = pages.select("page_id", "url", tag.alias("tag"), size.alias("size")).withColumn("day", F.concat(F.lit("day "), F.col("page_id") % 28))
    full = base.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), F.when(F.col("page_id") % 13 == 0, 404).otherwise(200).alias("status"), F.when(F.col("page_id") % 17 == 0, "length").alias("truncated"), F.col("tag").alias("etag"), F.col("day").alias("last_modified"), F.expr("map('Content-Type', 'text/html', 'ETag', tag, 'Date', 'first', 'Content-Length', CAST(size AS STRING))").alias("headers"))
    again = F.expr("CASE WHEN size % 5 = 0 THEN NULL WHEN size % 11 = 0 THEN '\"old\"' WHEN size % 2 = 1 THEN concat('W/', tag) ELSE tag END")
    revisit = base.withColumn("again", again).select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + 25).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("truncated"), F.col("again").alias("etag"), F.col("day").alias("last_modified"), F.expr("map('Date', 'second', 'Cache-Control', 'max-age=60', 'Content-Length', '0')").alias("headers"))
    return full.unionByName(revisit)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every not-modified revisit of a page stands for."""
    found = resolved_revisits(capture_records(_table(spark, sf_dir, "pages")))
    return found.select("record_id", "url", "response_id", "outcome", header_lines(F.col("headers")).alias("headers"))


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree by source, language and thousands of characters; short notes are licence files of the language."""
    path = F.expr("concat(source, '/', lang, IF(n_chars < 250, '/LICENSE-', concat('/', n_chars div 1000, '/doc-')), doc_id, '.txt')")
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited."""
    return license_scan(document_files(_table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), matches=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document against all others."""
    return lm_scores(_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 4))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of what they decode to.

    One row per row of docs, repeated or without an id or not; a null text is the
    empty text, without ids; an empty table gives an empty result; very long
    texts are encoded whole.
    """
    found = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    return token_digests(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, written as wavelet matrices and read back."""
    path = store_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return stored_documents(spark, path, only_digests=True).withColumnRenamed("crc32", "ids_crc32")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The chain's categories, from the labels that there are: texts of no use, then toxic ones.
CATEGORIES = {"useless": "1 - quality", "toxic": "toxic"}


def fitted_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    return fit_chain(docs, labels, CATEGORIES, ["quality", "toxic"])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the toxicity categories of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, fitted_chain(docs, _table(spark, sf_dir, "labels")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of every document, against the index of all documents."""
    found = exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


_OP4_SQL = f"""
WITH doc AS (SELECT doc_id, {_WORD_SQL} AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM doc),
gram AS (SELECT doc_id, i, c, lag(c) OVER d AS b, lag(c, 2) OVER d AS a FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
uni AS (SELECT doc_id, c, count(*) AS n FROM word GROUP BY ALL),
uni_all AS (SELECT c, sum(n) AS n FROM uni GROUP BY ALL),
bi AS (SELECT doc_id, b, c, count(*) AS n FROM gram WHERE b IS NOT NULL GROUP BY ALL),
bi_all AS (SELECT b, c, sum(n) AS n FROM bi GROUP BY ALL),
tri AS (SELECT doc_id, a, b, c, count(*) AS n FROM gram WHERE a IS NOT NULL GROUP BY ALL),
tri_all AS (SELECT a, b, c, sum(n) AS n FROM tri GROUP BY ALL),
size AS (SELECT doc_id, len(w) AS n FROM doc),
total AS (SELECT sum(n) AS n FROM size),
others_1 AS (SELECT doc_id, c, uni_all.n - uni.n AS n FROM uni JOIN uni_all USING (c)),
others_2 AS (SELECT doc_id, b, c, bi_all.n - bi.n AS n FROM bi JOIN bi_all USING (b, c)),
others_3 AS (SELECT doc_id, a, b, c, tri_all.n - tri.n AS n FROM tri JOIN tri_all USING (a, b, c)),
found AS (SELECT g.doc_id, g.a, g.b, t.n AS n_abc, ab.n AS n_ab, bc.n AS n_bc, ub.n AS n_b, uc.n AS n_c, greatest(total.n - size.n, 1) AS n_all
          FROM gram g JOIN size USING (doc_id) CROSS JOIN total JOIN others_1 uc ON uc.doc_id = g.doc_id AND uc.c = g.c
          LEFT JOIN others_1 ub ON ub.doc_id = g.doc_id AND ub.c = g.b
          LEFT JOIN others_2 bc ON bc.doc_id = g.doc_id AND bc.b = g.b AND bc.c = g.c
          LEFT JOIN others_2 ab ON ab.doc_id = g.doc_id AND ab.b = g.a AND ab.c = g.b
          LEFT JOIN others_3 t ON t.doc_id = g.doc_id AND t.a = g.a AND t.b = g.b AND t.c = g.c),
scored AS (SELECT doc_id, sum(CASE WHEN n_abc > 0 THEN log10(n_abc) - log10(n_ab)
                                   WHEN n_bc > 0 THEN log10(n_bc) - log10(n_b) + CASE WHEN a IS NULL THEN 0 ELSE log10(0.4) END
                                   ELSE log10(greatest(n_c, 1)) - log10(n_all) + CASE WHEN b IS NULL THEN 0 WHEN a IS NULL THEN log10(0.4) ELSE 2 * log10(0.4) END END) AS s
           FROM found GROUP BY doc_id)
SELECT doc_id, CAST(size.n AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS score FROM size LEFT JOIN scored USING (doc_id)
"""
_OP5_SQL = f"""
WITH line AS (SELECT doc_id, i, l, translate(trim(l, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), {_A_Z}) AS k
              FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
                           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
gone AS (SELECT k FROM line WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE gone.k IS NULL), '')) AS kept_sha256
FROM line LEFT JOIN gone USING (k) GROUP BY doc_id
"""
_OP10_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {_A_Z}) AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


_OP1_SQL = r"""
WITH bare AS (SELECT page_id, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, length(coalesce(html, '')) AS size,
                     regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(http://[^/?]*):80([/?]|$)', '\1\2', 'i'), '^(https://[^/?]*):443([/?]|$)', '\1\2', 'i'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
part AS (SELECT *, lower(regexp_extract(u, '^([^/?]*)', 1)) AS host,
                regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'),
                    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid)(=|$)'))) AS params FROM bare),
page AS (SELECT page_id, tag, size, nullif(host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END, '') AS url,
                'day ' || (page_id % 28) AS day FROM part),
again AS (SELECT page_id, url, day, page_id * 10 + 25 AS ts,
                 CASE WHEN size % 5 = 0 THEN NULL WHEN size % 11 = 0 THEN '"old"' ELSE tag END AS tag FROM page),
near AS (SELECT again.*, (SELECT max(p.page_id) FROM page p WHERE p.url = again.url AND p.page_id * 10 < again.ts AND p.page_id % 13 <> 0 AND p.page_id % 17 <> 0) AS hit FROM again),
both_ AS (SELECT near.*, p.size AS size_1, p.tag AS tag_1,
                 CASE WHEN p.page_id IS NULL THEN 'no_response' WHEN coalesce(near.tag = p.tag, near.day = p.day) THEN 'resolved' ELSE 'mismatch' END AS outcome
          FROM near LEFT JOIN page p ON p.page_id = near.hit)
SELECT page_id * 2 + 1 AS record_id, url, hit * 2 AS response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size_1 || chr(10) || 'content-type: text/html'
                 || chr(10) || 'date: second' || chr(10) || 'etag: ' || tag_1
            ELSE 'Cache-Control: max-age=60' || chr(10) || 'Content-Length: 0' || chr(10) || 'Date: second' END AS headers
FROM both_
"""
_QUOTED = [(name, text.replace("'", "''")) for name, text in TEMPLATES]
_TEMPLATE_SQL = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(_QUOTED))
_OP2_SQL = rf"""
WITH file AS (SELECT doc_id, coalesce(text, '') AS text, n_chars < 250 AS lic,
                     source || '/' || lang || CASE WHEN n_chars < 250 THEN '' ELSE '/' || (n_chars // 1000) END AS dir,
                     source || '/' || lang || CASE WHEN n_chars < 250 THEN '/LICENSE-' ELSE '/' || (n_chars // 1000) || '/doc-' END || doc_id || '.txt' AS path
              FROM documents),
size AS (SELECT count(*) AS n FROM file),
df AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM file) GROUP BY w),
tmpl AS (SELECT t, license, w, count(*) AS tf FROM (SELECT t, license, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS w
         FROM (VALUES {_TEMPLATE_SQL}) v(t, license, x)) GROUP BY ALL),
y AS (SELECT t, license, w, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1) AS y FROM tmpl LEFT JOIN df USING (w), size),
ynorm AS (SELECT t, sqrt(sum(y * y)) AS norm FROM y GROUP BY t),
line AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM file),
unit AS (SELECT doc_id, i * 10 + k AS u, array_to_string(ls[i:i + k - 1], chr(10)) AS l
         FROM (SELECT doc_id, ls, i, unnest([1, 2, 3, 4]) AS k FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM line)) WHERE i + k - 1 <= len(ls)
         UNION ALL SELECT doc_id, -1, text FROM file WHERE lic),
x AS (SELECT doc_id, u, w, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS x
      FROM (SELECT doc_id, u, w, count(*) AS tf FROM (SELECT doc_id, u, unnest(regexp_extract_all(lower(l), '[a-z0-9]+')) AS w FROM unit) GROUP BY ALL) JOIN df USING (w), size),
xnorm AS (SELECT doc_id, u, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
cosine AS (SELECT doc_id, license, round(sum(x * y) / any_value(xnorm.norm) / any_value(ynorm.norm), 6) AS score
           FROM x JOIN y USING (w) JOIN xnorm USING (doc_id, u) JOIN ynorm USING (t) GROUP BY doc_id, u, t, license),
own AS (SELECT doc_id, license, score FROM cosine WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
named AS (SELECT file.*, license, score FROM file LEFT JOIN own USING (doc_id)),
lic AS (SELECT dir, license, score FROM named WHERE lic AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license, path) = 1),
near AS (SELECT d.dir, lic.dir AS from_dir, lic.license, lic.score FROM (SELECT DISTINCT dir FROM named) d JOIN lic ON d.dir = lic.dir OR starts_with(d.dir, lic.dir || '/')
         QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(lic.dir) DESC) = 1)
SELECT doc_id, path, coalesce(named.license, near.license) AS license, coalesce(named.score, near.score) AS score,
       CASE WHEN named.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN named.license IS NULL THEN near.from_dir END AS from_dir
FROM named LEFT JOIN near USING (dir)
"""
_OP3_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORD_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORD_SQL} AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
gram AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
         FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, size WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, gram.n, item_id FROM gram JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_warc_revisits": op1_warc_revisits, "op2_license_scan": op2_license_scan, "op3_decontamination": op3_decontamination, "op4_lm_scoring": op4_lm_scoring, "op5_line_dedup": op5_line_dedup, "op6_bpe": op6_bpe, "op7_token_files": op7_token_files, "op8_simhash_near_dedup": op8_simhash_near_dedup, "op9_toxicity": op9_toxicity, "op10_exact_dedup": op10_exact_dedup}


def oracle_sql() -> dict[str, str]:
    """No SQL for the fingerprints of op8: DuckDB has no seeded XXH64."""
    return {"op1_warc_revisits": _OP1_SQL, "op2_license_scan": _OP2_SQL, "op3_decontamination": _OP3_SQL, "op4_lm_scoring": _OP4_SQL, "op5_line_dedup": _OP5_SQL, "op10_exact_dedup": _OP10_SQL}
