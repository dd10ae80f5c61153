"""Queries of the training-data problems over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import mixing, operators as ops, repetition, textforms
from glyphloom.plans.session import prepare, table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = f"{mixing.TOKENIZER_DIR}/{mixing.TOKENIZER}"
#: Parameter of the mix over these tables: the domain of each source.
DOMAINS = {
    "subtitles": "speech", "assembly": "speech", "lectures": "speech", "webcrawl": "web", "forum": "web",
    "manuals": "technical", "patents": "technical", "newswire": "press", "letters": "literary", "folklore": "literary",
    "glosses": "literary",
}
#: How far the stretched mix goes beyond the total at which every source still reaches its share.
STRETCH = 2.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ops.markup_kinds(table(prepare(spark), d, "prepared"))


def p1_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return ops.clean_markup(table(prepare(spark), d, "prepared")).select(
        "prep_id", "clean_text", F.col("elements.kind").alias("element_kinds"), F.col("elements.info").alias("element_infos")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ops.repetition(table(prepare(spark), d, "prepared")).where("is_repetitive").select("prep_id")


def p2_repetition(spark: SparkSession, d: str) -> DataFrame:
    return ops.repetition(table(prepare(spark), d, "prepared"))


def p2_token_share(spark: SparkSession, d: str) -> DataFrame:
    return ops.token_repetition(table(prepare(spark), d, "toks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    levels = ops.reading_levels(table(spark, d, "prepared"), table(spark, d, "reading_labels"), clean_only=True)
    return levels.where("band is not null").select("prep_id", "band")


def p3_levels(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return ops.reading_levels(table(spark, d, "prepared"), table(spark, d, "reading_labels"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ops.sentence_spans(table(prepare(spark), d, "norm_views"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return ops.look_alike_pairs(table(spark, d, "prepared"), table(spark, d, "norm_views"))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return ops.canonical_texts(table(prepare(spark), d, "prepared"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return ops.look_classes(table(spark, d, "prepared"), table(spark, d, "norm_views"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return ops.look_links(table(spark, d, "prepared"), table(spark, d, "norm_views"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return ops.leaked_items(table(spark, d, "documents"), table(spark, d, "bench_items")).select("doc_id", "item_id").distinct()


def p6_decontaminated(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return ops.decontaminated(table(spark, d, "documents"), table(spark, d, "bench_items"))


def _mix(spark: SparkSession, d: str, stretch: float = 1.0) -> tuple[DataFrame, DataFrame]:
    prepare(spark)
    return ops.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), TOKENIZER, domains=DOMAINS, stretch=stretch)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p7_stretched(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, STRETCH)[0]


def p7_stretched_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, STRETCH)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return ops.personal_details(table(spark, d, "documents"), table(spark, d, "name_list"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return ops.redacted(table(spark, d, "documents"), table(spark, d, "name_list"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        p1_found, p1_clean_text, p2_found, p2_repetition, p2_token_share, p3_found, p3_levels, p4_found, p5_found, p5_canonical,
        p5_classes, p5_links, p6_found, p6_decontaminated, p7_mix, p7_shares, p7_stretched, p7_stretched_shares, p8_found, p8_redacted,
    )}


def oracle_sql() -> dict[str, str]:
    """SQL where it expresses the operator over whole tables; the rest is tested against brute force in tests/llm."""
    canon, skeleton = textforms.form_sql("text")
    norm = textforms.form_sql("norm_text")[1]
    keyed = f"""
        WITH m AS (
            SELECT DISTINCT 'prepared_text' AS field_name, prep_id, md5(text) AS raw_key, {skeleton} AS look FROM prepared WHERE text IS NOT NULL
            UNION ALL
            SELECT DISTINCT 'norm_text', prep_id, md5(norm_text), {norm} FROM norm_views WHERE norm_text IS NOT NULL
        )"""
    # words: runs of letters, digits and the marks that stay with them; invisible characters out
    kept, spaceless = "[\\p{L}\\p{N}" + repetition.MARKS + "]+", repetition.SPACELESS.pattern
    words = f"regexp_extract_all(lower(regexp_replace(text, '[' || {textforms._quote(textforms.INVISIBLE)} || ']', '', 'g')), {textforms._quote(kept)})"

    def covered(rows: str, n: int = repetition.RUN) -> str:
        """(prep_id, n_words, repeated_words) of (prep_id, words) rows: words in runs of ``n`` that occurred before, each counted once."""
        return f"""r AS ({rows}), g AS (SELECT prep_id, i, array_to_string(words[i : i + {n - 1}], ' ') AS gram FROM (SELECT prep_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM r)),
 f AS (SELECT *, min(i) OVER (PARTITION BY prep_id, gram) AS first FROM g), c AS (SELECT DISTINCT prep_id, i + k AS at FROM f, (SELECT unnest(range(0, {n})) AS k) WHERE i > first),
 k AS (SELECT prep_id, count(*) AS repeated_words FROM c GROUP BY prep_id), shares AS (SELECT r.prep_id AS prep_id, len(words)::BIGINT AS n_words, coalesce(repeated_words, 0)::BIGINT AS repeated_words FROM r LEFT JOIN k ON r.prep_id = k.prep_id)"""

    one = f"SELECT prep_id, any_value({words}) AS words, any_value(text) AS text FROM prepared WHERE text IS NOT NULL GROUP BY prep_id"
    letters = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"
    return {
        # the share of letter runs, which decides wherever both readings of a word agree on the limit
        "p2_found": f"""WITH {covered(one)} SELECT prep_id FROM shares JOIN r USING (prep_id)
        WHERE n_words > 0 AND repeated_words >= {ops.RULES['repeated_share']} * n_words AND length(regexp_replace(text, {textforms._quote('[^' + spaceless[1:])}, '', 'g')) * 4 < {letters}""",
        "p2_token_share": f"""WITH t AS (SELECT prep_id, tok_no, max(word) AS word FROM toks WHERE prep_id IS NOT NULL AND tok_no IS NOT NULL GROUP BY ALL),
        {covered("SELECT prep_id, list(coalesce(word, chr(1) || tok_no::VARCHAR) ORDER BY tok_no) AS words FROM t GROUP BY prep_id")} SELECT prep_id, n_words, repeated_words FROM shares""",
        "p5_found": keyed + """
        SELECT DISTINCT a.field_name AS field_name, a.prep_id AS prep_id_a, b.prep_id AS prep_id_b
        FROM m a JOIN m b ON a.field_name = b.field_name AND a.look = b.look AND a.prep_id < b.prep_id AND a.raw_key <> b.raw_key""",
        "p5_canonical": f"""
        SELECT prep_id, epoch_us(received_at) AS received_us, canonical_text, skeleton, md5(skeleton) || ':' || length(skeleton) AS look_key
        FROM (SELECT prep_id, received_at, {canon} AS canonical_text, {skeleton} AS skeleton FROM prepared WHERE text IS NOT NULL)""",
        "p5_classes": keyed + """
        SELECT DISTINCT m.field_name AS field_name, m.prep_id AS prep_id, class_id, n_documents, n_spellings
        FROM m JOIN (SELECT field_name, look, min(prep_id) AS class_id, count(DISTINCT prep_id) AS n_documents, count(DISTINCT raw_key) AS n_spellings FROM m GROUP BY ALL) k
        ON m.look = k.look AND m.field_name = k.field_name""",
        "p5_links": keyed + """, s AS (SELECT field_name, look, raw_key, min(prep_id) AS spelling_id, count(DISTINCT prep_id) AS n_documents FROM m GROUP BY ALL)
        SELECT field_name, class_id, spelling_id, n_documents FROM (SELECT *, min(spelling_id) OVER w AS class_id, count(*) OVER w AS k FROM s WINDOW w AS (PARTITION BY field_name, look)) WHERE k > 1""",
    }
