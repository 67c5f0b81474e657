"""The numbered corpus queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, imatch, langid, lexical, licenses, line_dedup, mixing, periodic, simhash, suffix_dedup, token_files, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(of: int) -> F.Column:
    """Remainder that decides whether a document is held out of learning."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints_of_edits(_documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_rows(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(4) != 2)
    docs = _documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity.learn(docs, labels))
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    learned = langid.learn_dictionaries(docs.where(_fold(5) != 0))
    found = langid.predict_languages(docs, learned)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which documents with h % 10 = 0, h the crc32 of the id, repeat p words of theirs from word a on."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.expr("CASE WHEN n > 0 THEN floor(h / 10) % n END")).withColumn("p", F.expr("1 + floor((n - a) / (3 + floor(h / 10) % 8))"))
    at = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    repeated = F.array_join(F.transform("words", lambda _, i: at(i)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_repeats(_documents(spark, sf_dir))).withColumn("best", periodic.strongest())
    printed = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(printed, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_simhash, op4_bpe, op5_fingerprints, op6_token_files, op7_line_dedup, op8_source_mixing, op9_toxicity, op10_language_id, op11_periodic_runs, op12_lexical_search, op13_license_scan)}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x FROM documents
), n AS (
  SELECT doc_id, length(x) AS n_points, sha256(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
""",
    "op11_periodic_runs": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         xor(list_reduce(
           list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
           lambda c, x: list_reduce(range(8), lambda b, k: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END, xor(c, x)),
           4294967295::BIGINT), 4294967295) AS h
  FROM documents
), e AS (
  SELECT *, len(w) AS n, h // 10 AS g FROM d
), f AS (
  SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e
), planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM f
), words AS (
  SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM planted
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), frequent AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, q) AS matches FROM same
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM frequent WHERE matches >= greatest(24, 3 * q) - q
), spans AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM spans x WHERE NOT EXISTS (SELECT 1 FROM spans y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, start, q) = 1
), printed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(start + q, start + length)) AS i FROM runs)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM documents LEFT JOIN printed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op12_lexical_search": r"""
WITH t AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), size AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), total AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs
), asked AS (
  SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
""",
    "op13_license_scan": rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), word AS (
  SELECT doc_id, unnest(range(len(w)))::BIGINT AS place, unnest(w) AS w1, unnest(list_concat(w[2:], [NULL])) AS w2, unnest(list_concat(w[3:], [NULL, NULL])[:len(w)]) AS w3 FROM d WHERE len(w) > 0
), base AS (
  SELECT doc_id, place, 'mit' AS label FROM word WHERE w1 = 'mit' AND w2 = 'license'
  UNION ALL SELECT doc_id, place, 'apache' FROM word WHERE w1 = 'apache' AND w2 = 'license'
  UNION ALL SELECT doc_id, place, 'gpl' FROM word WHERE w1 = 'general' AND w2 = 'public' AND w3 = 'license'
), texts(text_no, label, text) AS (
  VALUES {", ".join("({}, '{}', '{}')".format(n, label, text.lower().replace("'", "''")) for n, (label, text) in enumerate(licenses.TEXTS))}
), lists AS (
  SELECT text_no, label, list_filter(string_split_regex(text, '[^0-9a-z]+'), lambda x: x <> '') AS w FROM texts
), gram AS (
  SELECT text_no, label, len(w) AS size, unnest(range(len(w)))::BIGINT AS spot, unnest(w) AS w1, unnest(list_concat(w[2:], [NULL])) AS w2, unnest(list_concat(w[3:], [NULL, NULL])) AS w3 FROM lists
), vote AS (
  SELECT doc_id, text_no, label, size, place, spot, place - spot AS diagonal FROM word JOIN gram USING (w1, w2, w3)
), diagonals AS (
  SELECT DISTINCT doc_id, text_no, diagonal FROM vote
), begun AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, text_no ORDER BY diagonal) <= 4 THEN 0 ELSE 1 END AS new FROM diagonals
), session AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, text_no ORDER BY diagonal) AS session FROM begun
), starts AS (
  SELECT *, min(diagonal) OVER (PARTITION BY doc_id, text_no, session) AS lowest FROM session
), placed AS (
  SELECT doc_id, text_no, label, size, session, (diagonal - lowest) // size AS part, place, spot FROM vote JOIN starts USING (doc_id, text_no, diagonal)
), counted AS (
  SELECT doc_id, text_no, label, size, session, part, count(DISTINCT spot) AS grams, min(place) AS low, max(place) + 2 AS high, len(list_distinct(flatten(list([spot, spot + 1, spot + 2])))) AS covered FROM placed GROUP BY ALL
), span AS (
  SELECT doc_id, label, least(1.0, 2 * covered / (size + greatest(high - low + 1, covered)))::DOUBLE AS likeness FROM counted WHERE grams >= ceil(0.3 * (size - 2))
), best AS (
  SELECT doc_id, max(likeness) AS best, count(*) AS n_spans FROM span WHERE likeness >= 0.7 GROUP BY doc_id
), named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM span WHERE likeness >= 0.7) GROUP BY doc_id
), places AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
""",
}
