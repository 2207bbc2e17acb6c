"""Queries of the operators in this subpackage, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import bpe_prefix, chat, collocations, decontaminate, language_id, mixing, periodic_runs, perplexity, phrase_dedup
from noticelake.llm import simhash, suffix_dedup, token_orc, url_filter
from noticelake.llm.common import WORD, read_table, with_digest
from noticelake.storage import shared_dir

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.fit_languages(docs.where("not held_out").select("text", "lang"))
    return language_id.predict_languages(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge_quality(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return chat.read_back(chat.format_windows(given.unionByName(planted)))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/noticelake-{spark.sparkContext.applicationId}/tokens-{uuid4().hex[:12]}"
    token_orc.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_orc.token_digests(token_orc.read_tokens(spark, path))


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(phrase_dedup.remove_passages(read_table(spark, sf_dir, "documents")))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mixing_rates(read_table(spark, sf_dir, "documents"))
    return rated.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_bpe_prefix_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_prefix.encode_texts(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), decode=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents, picked by the checksum of the id, go on periodically from some word."""
    h = F.crc32(F.col("doc_id").cast("string"))
    picked = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    placed = picked.withColumn("a", F.when(n > 0, g % n).cast("int"))
    placed = placed.withColumn("p", F.floor(1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    word = "transform(sequence(0, size(w) - 1), i -> element_at(w, 1 + if(i < a, i, a + (i - a) % p)))"
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.expr(word), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_periods(read_table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256",
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT
      / 281474976710656.0::DOUBLE AS coin
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    2.0::DOUBLE * source_size AS most
  FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY most / w, source NULLS LAST) AS place
  FROM weighed
), fixed AS (SELECT arg_min(level, place) AS level, min(place) AS place FROM levels WHERE most > level * w
), targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.place >= f.place THEN f.level * l.w ELSE l.most END AS target
  FROM levels l, fixed f
), rated AS (
  SELECT doc_id, size, source_size, target, coin, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT) * size AS taken
FROM rated
"""

OP11_SQL = r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM pieces
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM pieces
), counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), cuts AS (
  SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), scored AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.c, y.f AS l, z.f AS r,
    (1000000::HUGEINT * x.a * x.a) // (y.f::HUGEINT * z.f) AS score
  FROM cuts x
  JOIN counts y ON y.lang = x.lang AND y.phrase = array_to_string(x.w[1:x.c], ' ')
  JOIN counts z ON z.lang = x.lang AND z.phrase = array_to_string(x.w[x.c + 1:], ' ')
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), outer_ AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cuts WHERE k = 3
), kept AS (
  SELECT * FROM weakest s
  WHERE NOT EXISTS (SELECT 1 FROM outer_ o WHERE s.k = 2 AND o.lang = s.lang AND o.phrase = s.phrase AND 100 * o.a >= 50 * s.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_perplexity_rules": op3_perplexity_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat_windows": op5_chat_windows,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_orc": op7_token_orc,
    "op8_phrase_dedup": op8_phrase_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_collocations": op11_collocations,
    "op12_bpe_prefix_codec": op12_bpe_prefix_codec,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {"op10_mix_sources": OP10_SQL, "op11_collocations": OP11_SQL}
