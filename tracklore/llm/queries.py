"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    importance,
    language_id,
    licenses,
    mixing,
    near_dedup,
    periodic_runs,
    private_data,
    substring_dedup,
    token_shards,
    toxicity,
)
from tracklore.llm.text_arrays import documents
from tracklore.session import new_stage_path

QUERIES = {}


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabulary files lie; nothing of them is copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(documents(spark, sf_dir), benchmark, carry=["doc_id"])
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    names = F.array_sort(F.array_distinct(F.col("matches.licence")))
    place = lambda name: lambda x: F.concat_ws(":", x[name], x["start"], x["stop"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join(F.transform("sentences", place("sentence")), ",").alias("sentences"),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licences"),
        F.array_join(licenses.families(names), ",").alias("families"),
        F.array_join(F.transform("matches", place("licence")), ",").alias("spans"),
    )


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("text_key")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(documents(spark, sf_dir)).drop("kept_text")


@query
def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find_private(documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc.doc_id", *[f"n_{k}" for k in private_data.KINDS], "base_sha256", "spans")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score(documents(spark, sf_dir), labels, carry=["doc_id"])
    return found.select("doc.doc_id", "held_out", "score", "predicted")


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


@query
def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("byte_bpe_50k.json")
    found = bpe.encode(documents(spark, sf_dir), path, carry=["doc_id"], with_ids=False)
    return found.select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc.doc_id", "held_out", "lang_pred", "score")


@query
def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = new_stage_path(spark, "token_shards")
    token_shards.write_shards(docs, vocabulary_path("word_bpe_49k.json"), path)
    return token_shards.read_documents(spark, path, docs.schema["doc_id"].dataType.simpleString())


@query
def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance.resample(documents(spark, sf_dir), target).drop("n_words")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.plant(documents(spark, sf_dir)))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


ORACLES = {
    "op1_decontamination": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), item_starts AS (
            SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 11, 2))) AS p
            FROM items WHERE len(w) > 0
        ), windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM item_starts
        ), lengths AS (
            SELECT DISTINCT n FROM windows
        ), doc_starts AS (
            SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, lengths WHERE len(w) >= n
        ), doc_windows AS (
            SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM doc_starts
        ), hits AS (
            SELECT doc_id, p, n, item_id FROM doc_windows JOIN windows USING (n, t)
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT q) AS n_hit
            FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
    "op7_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM texts WINDOW w AS (PARTITION BY t)
    """,
    "op4_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), starts AS (
            SELECT doc_id, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50
        ), windows AS (
            SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h
            FROM starts JOIN words USING (doc_id)
        ), firsts AS (
            SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p
            FROM windows JOIN firsts USING (h) WHERE first_id < doc_id
        ), gone_lists AS (
            SELECT doc_id, list(p) AS g FROM gone GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
               CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE
                   [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(g, i)] END, ' '))
                   AS kept_sha256
        FROM words LEFT JOIN gone_lists USING (doc_id)
    """,
    "op11_mix_sources": r"""
        WITH docs AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS h
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS HUGEINT) AS total,
                   [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM docs GROUP BY source
        ), filled AS (
            SELECT *, sum(total) OVER () - coalesce(sum(3 * total) OVER before, 0) AS level,
                   sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS share,
                   row_number() OVER (ORDER BY total / weight, source NULLS LAST) AS place
            FROM sources
            WINDOW before AS (ORDER BY total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), water AS (
            SELECT level AS l, share AS c FROM filled WHERE 3 * total * share >= level * weight ORDER BY place LIMIT 1
        ), goals AS (
            SELECT source, CAST(total AS BIGINT) AS source_size,
                   CASE WHEN 3 * total * c < l * weight THEN CAST(3 * total AS DOUBLE)
                        ELSE CAST(l * weight AS DOUBLE) / CAST(c AS DOUBLE) END AS target
            FROM filled, water
        ), plans AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM goals
        ), hashes AS (
            SELECT source, h, sum(size) AS held, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS up_to
            FROM docs WHERE size > 0 GROUP BY source, h
        ), taken AS (
            SELECT hashes.source, h, held,
                   greatest(0, least(held, CAST(floor(target) AS BIGINT) - passes * source_size - (up_to - held))) AS part
            FROM hashes JOIN plans ON hashes.source IS NOT DISTINCT FROM plans.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * passes + coalesce(part * size // held, 0) AS BIGINT) AS taken
        FROM docs JOIN plans ON docs.source IS NOT DISTINCT FROM plans.source
        LEFT JOIN taken ON docs.source IS NOT DISTINCT FROM taken.source AND docs.h = taken.h AND docs.size > 0
    """,
}


def oracle_sql() -> dict[str, str]:
    return {name: ORACLES[name] for name in QUERIES if name in ORACLES}
