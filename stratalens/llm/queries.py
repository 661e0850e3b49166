"""The registered queries of the training-data operators; thin digests of their output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, html_tree, jpeg, langid, license_scan, minhash, ranked, simhash, token_align, toxicity, url_filter, warc_zip
from .common import held_out, table

ORACLE_SQL: dict[str, str] = {}


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judged(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def bpe_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = jpeg.read(jpeg.store(table(spark, sf_dir, "documents")))
    tail = F.crc32(F.expr("substring(thumbnail, -64)"))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash")
    return seen.select("doc_id", "n_bytes", F.octet_length("thumbnail").cast("long").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zip.write_archives(table(spark, sf_dir, "pages"), warc_zip.new_store(spark))
    found = warc_zip.read_archives(archives, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    found = langid.predict(docs.select("doc_id", "text", "held_out"), langid.fit(docs.where("not held_out")))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    found = toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out())))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_tree.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_license_scan"] = license_scan.oracle()


def _drawn(text: str, first: int) -> F.Column:
    """A number from 0 to 255 from two hex digits of a text's MD5."""
    return F.conv(F.expr(f"substring(md5({text}), {first}, 2)"), 16, 10).cast("int")


def capture_times(pages: DataFrame) -> DataFrame:
    """The tables have no time of fetching: the id gives one within a year."""
    minute = F.expr("pmod(page_id * 7919, 525600)").cast("long")
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + 60 * minute).cast("timestamp_ntz").alias("fetched_at"))


def dated_list(pages: DataFrame) -> DataFrame:
    """Nor do they have filter lists: the MD5 of each registered domain, host and host with
    its first directory says whether and when lists add it, drop it and add it again."""
    host = url_filter.host_of(F.col("url"))
    first = F.get(F.filter(F.split(url_filter.path_of(F.col("url")), "/"), lambda x: x != ""), F.lit(0))
    names = pages.select(F.explode(F.array(host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.when(host != "", F.lower(F.concat(host, F.lit("/"), first))))).alias("pattern")).where("pattern <> ''").distinct()
    day = lambda n: (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(n))
    a, b, c = _drawn("pattern", 1), _drawn("pattern", 3), _drawn("pattern", 5)
    entries = F.array(
        F.when(a < 160, F.struct(F.lit("abuse").alias("list_name"), F.lit("add").alias("action"), day(a).alias("at"))),
        F.when((a < 160) & (b < 192), F.struct(F.lit("abuse").alias("list_name"), F.lit("remove").alias("action"), day(a + 1 + b).alias("at"))),
        F.when((a < 160) & (b < 96), F.struct(F.lit("abuse").alias("list_name"), F.lit("add").alias("action"), day(a + 31 + b).alias("at"))),
        F.when(c < 64, F.struct(F.lit("spam").alias("list_name"), F.lit("add").alias("action"), day(c * 4).alias("at"))),
    )
    return names.select("pattern", F.explode(F.array_compact(entries)).alias("e")).select("pattern", "e.*")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filter.filter_urls(capture_times(pages), dated_list(pages), "page_id")
    return found.select("page_id", "url", "fetched_at", "n_active", "lists", "blocked")


ORACLE_SQL["op2_url_filter"] = r"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(CAST((page_id * 7919) % 525600 AS BIGINT)) AS fetched_at,
  regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)', 1)), '\.+$', '') AS host,
  list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
names AS (SELECT DISTINCT pattern FROM (SELECT host AS pattern FROM c UNION ALL SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM c UNION ALL SELECT lower(host || '/' || parts[1]) FROM c WHERE host <> '' AND len(parts) > 0) WHERE pattern <> ''),
drawn AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 2) AS INT) AS a, CAST('0x' || substr(md5(pattern), 3, 2) AS INT) AS b, CAST('0x' || substr(md5(pattern), 5, 2) AS INT) AS x FROM names),
entries AS (
  SELECT pattern, 'abuse' AS list_name, 'add' AS action, TIMESTAMP '2024-01-01' + to_days(a) AS since FROM drawn WHERE a < 160
  UNION ALL SELECT pattern, 'abuse', 'remove', TIMESTAMP '2024-01-01' + to_days(a + 1 + b) FROM drawn WHERE a < 160 AND b < 192
  UNION ALL SELECT pattern, 'abuse', 'add', TIMESTAMP '2024-01-01' + to_days(a + 31 + b) FROM drawn WHERE a < 160 AND b < 96
  UNION ALL SELECT pattern, 'spam', 'add', TIMESTAMP '2024-01-01' + to_days(x * 4) FROM drawn WHERE x < 64),
spans AS (SELECT * FROM (SELECT pattern, list_name, action, since AS a, lead(since) OVER (PARTITION BY pattern, list_name ORDER BY since) AS z FROM entries) WHERE action = 'add'),
asked AS (SELECT page_id, url, fetched_at, host AS pattern FROM c
  UNION SELECT page_id, url, fetched_at, array_to_string(string_split(host, '.')[i:], '.') FROM (SELECT *, unnest(range(2, CASE WHEN regexp_matches(host, '^[0-9.]+$|^\[') THEN 2 ELSE greatest(len(string_split(host, '.')), 2) END)) AS i FROM c)
  UNION SELECT page_id, url, fetched_at, lower(host || '/' || array_to_string(parts[:i], '/')) FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c)),
m AS (SELECT page_id, url, fetched_at, count(DISTINCT (list_name, s.pattern)) AS n, array_to_string(list_sort(list(DISTINCT list_name)), ',') AS l
  FROM asked JOIN spans s ON asked.pattern = s.pattern AND fetched_at >= a AND (z IS NULL OR fetched_at < z) GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched_at, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(l, '') AS lists, n IS NOT NULL AS blocked
FROM c LEFT JOIN m ON c.page_id = m.page_id AND c.url = m.url AND c.fetched_at = m.fetched_at"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op11_ranked_search"] = ranked.ORACLE


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return found.withColumn("groups_sha256", digest).drop("groups")


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_url_filter, op3_warc_zip, op4_simhash_near_dedup, op5_html_extraction, op6_bpe_encode_decode, op7_license_scan, op8_language_id, op9_toxicity, op10_media_columns, op11_ranked_search, op12_minhash_near_dedup, op13_tokenizer_alignment)}
