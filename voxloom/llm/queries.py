"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, near_dedup, quality, toxicity
from .common import fold, table
from .exact_dedup import exact_dedup
from .sentencepiece_wfst import encode_and_decode, read_model
from .sharding import shard
from .url_filter import PathRule, judge

#: Fixed values of the URL contract.
URL_RULES = [
    PathRule("block", "com", "/en/"),
    PathRule("allow", "example.com", "/en/7"),
    PathRule("allow", "net", "/de/"),
    PathRule("block", "example.net", "/de/8"),
    PathRule("block", "org", "/es/"),
]


#: Where the vocabulary file lies on the driver.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, words_per_edit=line_dedup.WORDS_PER_EDIT, chars_per_edit=line_dedup.CHARS_PER_EDIT).select("doc_id", "dropped_lines", "text")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_join(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    profiles = language_id.fit(docs.filter(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "quality")
    return quality.score(docs, quality.fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode_and_decode(docs, read_model(model_path))
    return both.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "round_trip")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return held.select("doc_id", F.explode("matches").alias("match")).select("doc_id", "match.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_line_dedup, op4_ngram_jaccard_join, op5_language_id, op6_quality, op7_sentencepiece, op8_decontamination, op9_exact_dedup, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {
        # all pairs that share a shingle, so without candidates; only for tables of this size
        "op4_ngram_jaccard_join": r"""
            WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, string_split_regex(trim(lower(coalesce(text, '')), E' \t\n\r\f\v'), '\s+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE w[1] <> '')),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            link AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
            reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
            class AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM reach GROUP BY a),
            found AS (SELECT a AS doc_id, count(*) AS links, count(DISTINCT CASE WHEN x.text <> y.text THEN md5(y.text) END) AS linked_texts FROM link JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b GROUP BY a)
            SELECT doc_id, class_id, class_size, coalesce(links, 0) AS links, coalesce(linked_texts, 0) AS linked_texts, doc_id = class_id AS kept
            FROM class LEFT JOIN found USING (doc_id)""",
        "op9_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    }
