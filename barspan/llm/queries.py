"""Registered queries of the subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.llm import (
    op1_token_codes,
    op2_tool_calls,
    op3_toxicity,
    op4_mixing,
    op5_quality,
    op6_token_counts,
    op7_secret_ledger,
    op8_neural_partitions,
    op9_jaccard,
    op10_decontamination,
    op11_html_main_text,
    op12_whitening,
    op13_token_alignment,
)
from barspan.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_token_codes")
def op1(spark, sf_dir):
    return op1_token_codes.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op2_tool_call_links",
    """
WITH calls AS (
    SELECT DISTINCT conv_id, turn, conv_id || '-' || turn AS call_id, text,
        CAST(CASE WHEN turn >= 2 THEN json_object('after', conv_id || '-' || (turn - 2), 'text', text, 'turn', turn)
             ELSE json_object('text', text, 'turn', turn) END AS VARCHAR) AS arguments
    FROM conversations WHERE role = 'user'),
answers AS (
    SELECT conv_id, turn AS result_turn, conv_id || '-' || (turn - 1) AS call_id, text AS result, true AS answered
    FROM conversations WHERE role = 'assistant'
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
linked AS (
    SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, c.turn, c.arguments, a.result, a.result_turn,
        list_filter([
            CASE WHEN length(c.text) < 1 THEN 'range:text' END,
            CASE WHEN c.turn >= 2 AND p.call_id IS NULL THEN 'unknown_reference' END,
            CASE WHEN c.call_id IS NOT NULL AND a.answered IS NULL THEN 'no_result' END,
            CASE WHEN c.call_id IS NULL THEN 'orphan_result' END], lambda x: x IS NOT NULL) AS problems
    FROM calls c FULL JOIN answers a ON c.conv_id = a.conv_id AND c.call_id = a.call_id
    LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2)
SELECT conv_id, call_id, turn, CASE WHEN turn IS NOT NULL THEN CAST(0 AS BIGINT) END AS level, result_turn,
    array_to_string(problems, ',') AS problems,
    CASE WHEN len(problems) = 0 THEN '{"arguments":' || arguments || ',"call_id":' || CAST(to_json(call_id) AS VARCHAR)
        || ',"name":"answer","result":' || CAST(to_json(result) AS VARCHAR) || '}' END AS record
FROM linked
""",
)
def op2(spark, sf_dir):
    calls, results = op2_tool_calls.calls_of(table(spark, sf_dir, "conversations"))
    got = op2_tool_calls.link(calls, results, op2_tool_calls.SCHEMAS, references=["after"])
    return got.select("conv_id", "call_id", "turn", F.col("level").cast("long").alias("level"), "result_turn", F.array_join("problems", ",").alias("problems"), "record")


@query("op3_sentence_toxicity")
def op3(spark, sf_dir):
    got = op3_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.get("worst", F.lit(0))["sentence"].alias("worst_sentence"))


@query(
    "op4_weighted_fair_mix",
    """
WITH docs AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
    FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
turned AS (SELECT *, 2 * source_size AS cap,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sources),
levels AS (SELECT *,
    (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER before, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM turned WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
line AS (SELECT arg_min(level, cap / weight) AS line FROM levels WHERE cap > level * weight),
share AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(line * weight, cap)) AS target FROM levels, line),
queue AS (SELECT docs.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY digest, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM docs JOIN share ON docs.source IS NOT DISTINCT FROM share.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
    CAST(greatest(0, least(size, floor(target) - ahead)) + greatest(0, least(size, floor(target) - ahead - source_size)) AS BIGINT) AS taken
FROM queue
""",
)
def op4(spark, sf_dir):
    got = op4_mixing.taken(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op4_mixed_stream")
def op4_stream(spark, sf_dir):
    got = op4_mixing.schedule(table(spark, sf_dir, "documents")).where("words > 0")
    return got.select("doc_id", "source", "epoch", "stream_start", "words")


@query("op5_positive_unlabelled_quality")
def op5(spark, sf_dir):
    return op5_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_word_piece_counts")
def op6(spark, sf_dir):
    return op6_token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op7_secret_ledger")
def op7(spark, sf_dir):
    return op7_secret_ledger.secrets(table(spark, sf_dir, "documents"))


@query("op8_neural_partitions")
def op8(spark, sf_dir):
    return op8_neural_partitions.nearest(table(spark, sf_dir, "embeddings"), top=20, every=20)


@query(
    "op9_jaccard_components",
    """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
    SELECT DISTINCT doc_id, hash(s) AS s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    WHERE 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (
    SELECT doc_id, doc_id AS to_id FROM words
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.to_id)
SELECT r.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.to_id) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
""",
)
def op9(spark, sf_dir):
    got = op9_jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return got.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


@query("op10_template_leaks")
def op10(spark, sf_dir):
    return op10_decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query("op11_html_main_text")
def op11(spark, sf_dir):
    return op11_html_main_text.extract(table(spark, sf_dir, "pages"))


@query("op12_whitening")
def op12(spark, sf_dir):
    return op12_whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


@query("op13_token_alignment")
def op13(spark, sf_dir):
    return op13_token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
