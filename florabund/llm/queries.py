"""The registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpack, decontam, neardup, packing, phrases, ppm, quality, secrets, substring, toxicity, urls, variants, wordpiece
from .common import fold, stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), TOKENIZER).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.assign(stored(pieces))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 10) != 0).alias("train"))
    return ppm.score(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.spam_list(pages)).select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 3) != 1
    labels = table(spark, sf_dir, "labels").filter(learn)
    models = toxicity.train(docs.filter(learn), labels.filter("toxic = 1"), toxicity.prior_of(labels))
    out = toxicity.toxicity(docs, models)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_few(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_quality_rules, op3_substring_dedup, op4_secret_scan, op5_lm_scoring, op6_url_filter, op7_near_dedup, op8_token_counts, op9_toxicity, op10_decontamination, op11_bin_completion, op12_spelling_variants, op13_collocations, pipeline)
}

_AFTER = "substr(url, strpos(url, '://') + 3)"
ORACLES: dict[str, str] = {
    "op6_url_filter": rf"""
        WITH parts AS (
          SELECT page_id, url,
                 CASE WHEN strpos(url, '://') > 0 THEN {_AFTER} END AS rest
          FROM pages),
        cut AS (
          SELECT page_id,
                 coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
                 coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '') AS query
          FROM parts),
        named AS (
          SELECT page_id, host, path,
                 list_sort([p for p in string_split(query, '&') if p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')]) AS kept
          FROM cut),
        canon AS (
          SELECT page_id, host, path,
                 CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html?)$', '')
                      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical_url
          FROM named),
        spam AS (
          SELECT DISTINCT canonical_url FROM canon
          WHERE list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'casino-win', 'free-bets', 'ads-track', 'adult-x']) AND canonical_url <> ''),
        ruled AS (
          SELECT c.*, s.canonical_url IS NOT NULL AS listed,
                 CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
          FROM canon c LEFT JOIN spam s ON c.canonical_url = s.canonical_url)
        SELECT page_id, host, path, rule,
               CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
                         ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict,
               canonical_url, listed
        FROM ruled""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc AS (
          SELECT [list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) for k in range(256)] AS byte),
        runs AS (
          SELECT doc_id, run, count(*) AS n
          FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents WHERE text IS NOT NULL)
          WHERE len(run) >= 7 GROUP BY doc_id, run),
        points AS (
          SELECT run, n, [unicode(c) for c in string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')] AS points FROM runs),
        hashed AS (
          SELECT run, n, xor(list_reduce(flatten([CASE WHEN c < 128 THEN [c::BIGINT] ELSE [195, c::BIGINT - 64] END for c in points]),
                                         lambda h, b: xor(h >> 8, byte[(xor(h, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
          FROM points, crc),
        words AS (
          SELECT word, sum(n)::BIGINT AS n
          FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, n FROM hashed)
          WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        dropped AS (
          SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest
          FROM (SELECT word, n, unnest(range(1, len(word) + 1))::INT AS k FROM words)),
        links AS (
          SELECT a.word, b.word AS other FROM dropped a JOIN dropped b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
          UNION SELECT d.word, w.word FROM dropped d JOIN words w ON d.rest = w.word
          UNION SELECT w.word, d.word FROM dropped d JOIN words w ON d.rest = w.word),
        near AS (
          SELECT l.word, count(*) AS n_near, max(o.n) AS best_n, arg_min(l.other, (-o.n, l.other)) AS best
          FROM links l JOIN words o ON o.word = l.other GROUP BY l.word),
        forms AS (
          SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
          FROM words w LEFT JOIN near ON near.word = w.word),
        chain AS (
          SELECT word, word AS root FROM forms
          UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
        ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
        SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word""",
    "op13_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents WHERE text IS NOT NULL),
        cut AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS w FROM pieces),
        grams AS (
          SELECT lang, size, array_to_string(w[b:b + size - 1], ' ') AS phrase
          FROM cut, range(1, 6) s(size), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS b)),
        total AS (SELECT lang, count(*)::HUGEINT AS n FROM grams WHERE size = 1 GROUP BY lang),
        f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100),
        shorter AS (
          SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:size - 1], ' '), array_to_string(string_split(phrase, ' ')[2:size], ' ')]) AS phrase
          FROM f WHERE size > 2),
        alone AS (
          SELECT f.* FROM f WHERE size > 1 AND NOT EXISTS (FROM shorter s WHERE s.lang = f.lang AND s.phrase = f.phrase AND s.f >= f.f)),
        cuts AS (
          SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS rest
          FROM alone, range(1, 5) c(k) WHERE k < size),
        scored AS (
          SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.a * n) // (l.f * r.f) AS score
          FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest JOIN total t ON t.lang = c.lang),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM ranked WHERE rank <= 2000""",
}
