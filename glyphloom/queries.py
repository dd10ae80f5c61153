"""Queries over the test tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphloom import policy, view_queries
from glyphloom.operators import analysis, native, waivers
from glyphloom.plans.seeds import SENTENCES
from glyphloom.plans.session import prepare, spread, table

Query = Callable[[SparkSession, str], DataFrame]
SEEDS = len(SENTENCES)
#: Synthetic waived spans: (order, region kind, start, end).
WAIVED = [(0, "html", 0, 400), (1, "prose", 100, 900), (2, "structure", 0, 2_000), (3, "prose", 0, 500)]


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries.  Copies of a document fold in the narrow results, so that no text is ever shuffled."""
    return spread(table(prepare(spark), d, "prepared"), ["prep_id", "text", "profile", "input_format"]).withColumn("delivery", F.monotonically_increasing_id())


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    """Every document with one seed sentence after its text."""
    seeds = spark.createDataFrame(list(enumerate(SENTENCES)), "k bigint, sentence string")
    p = _prepared(spark, d)
    return p.join(F.broadcast(seeds), F.pmod("prep_id", F.lit(SEEDS)) == F.col("k")).select("prep_id", "profile", "delivery", F.concat("text", F.lit("\n\n"), "sentence").alias("text"))


_SEED_SQL = ", ".join(f"({i}, '{s.replace(chr(39), chr(39) * 2)}')" for i, s in enumerate(SENTENCES))
_ONE = "one AS (SELECT prep_id, any_value(text) AS text, any_value(profile) AS profile FROM prepared GROUP BY prep_id)"
_SEEDED = f"{_ONE}, seeded AS (SELECT prep_id, profile, text || chr(10) || chr(10) || s AS text FROM one JOIN (VALUES {_SEED_SQL}) v(k, s) ON prep_id % {SEEDS} = k)"
_TERMS = ", ".join(f"('{r}', '{f}', '{t.replace(chr(39), chr(39) * 2)}')" for r, f, t, _ in native.term_rows())
_GRAMS = f"""w AS (SELECT prep_id, regexp_extract_all(lower(text), '[a-z0-9''-]+') AS w FROM seeded),
 g AS ({" UNION ALL ".join(f"SELECT prep_id, unnest([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) AS gram FROM w" for k in range(1, native.NGRAM + 1))}),
 hits AS (SELECT prep_id, rule_id, family, count(*) AS hits FROM g JOIN (VALUES {_TERMS}) t(rule_id, family, gram) USING (gram) GROUP BY ALL)"""
_KIND = """CASE WHEN k0 = 'code_block' THEN 'code_fence' ELSE k0 END"""
_KINDS = "rk AS (SELECT *, lower(regexp_replace(regexp_replace(kind, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[ -]', '_', 'g')) AS k0 FROM regions)"
_TOKS = "t AS (SELECT prep_id, tok_no, max(word) AS word, max(seg) AS seg FROM toks GROUP BY ALL)"
_SHINGLE = f"""{_TOKS}, s AS (SELECT prep_id, CASE WHEN lead(seg, 7) OVER w = seg AND {' AND '.join(f'lead(word, {i}) OVER w IS NOT NULL' for i in range(8))} THEN concat_ws(' ', {', '.join(f'lead(word, {i}) OVER w' for i in range(8))}) END AS shingle
 FROM t WINDOW w AS (PARTITION BY prep_id ORDER BY tok_no)), c AS (SELECT prep_id, shingle, count(*) AS n FROM s WHERE shingle IS NOT NULL GROUP BY ALL)"""


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- reading stage (no SQL twin)


def _analysis(spark: SparkSession, d: str, **kw) -> analysis.Analysis:
    return analysis.analyze(_prepared(spark, d), F.col("profile"), F.col("input_format"), id_column="prep_id", **kw)


def ref_findings(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d, suggest=True).findings


def ref_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).documents.drop("paragraph_words", "notes")


def ref_segments(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).segments


def ref_sections(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).sections


def ref_families(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d).families


def ref_rollup(spark: SparkSession, d: str) -> DataFrame:
    return analysis.corpus_rollup(_analysis(spark, d).findings)


def ref_seeded_findings(spark: SparkSession, d: str) -> DataFrame:
    return analysis.analyze(_seeded(spark, d), "doc", id_column="prep_id", suggest=True).findings


def ref_waived(spark: SparkSession, d: str) -> DataFrame:
    rules = [r.id for r in policy.rules().values() if not r.human_only]
    w = spark.createDataFrame(
        [(r, 0, 600, "human" if i % 2 else "orchestrator-agent", "2030-01-01T00:00:00Z" if i % 3 else "2020-01-01T00:00:00+02:00", i) for i, r in enumerate(rules)],
        "rule_id string, span_start bigint, span_end bigint, signer_kind string, expires string, w_ord bigint",
    )
    return _analysis(spark, d, waivers=w, now=1_760_000_000).findings.select("doc_id", "rule_id", "start", "end", "state", "waived")


def ref_verified(spark: SparkSession, d: str) -> DataFrame:
    p = _prepared(spark, d)
    a = p.select(
        F.col("prep_id").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("document_sha256"), F.lit(policy.digest()).alias("policy_digest"),
        F.coalesce("profile", F.lit("general-writing")).alias("profile"), F.array().cast("array<string>").alias("demote"),
        F.array().cast("array<struct<rule_id:string,span_start:bigint,span_end:bigint,signer_kind:string,expires:string>>").alias("waivers"),
    ).dropDuplicates(["doc_id"])
    return waivers.verify(p, a, 1_760_000_000, id_column="prep_id")


# ---------------------------------------------------------------- native stage (each with a SQL twin)


def sql_input_probe(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _prepared(spark, d).select(
        "prep_id", F.sha2(t.cast("binary"), 256).alias("sha"), F.octet_length(t).cast("bigint").alias("n_bytes"), F.length(t).cast("bigint").alias("n_chars"),
        (t.contains("\r\n") & F.replace(t, F.lit("\r\n"), F.lit("")).contains("\n")).cast("bigint").alias("mixed"),
    ).distinct()


def sql_deliveries(spark: SparkSession, d: str) -> DataFrame:
    p = native.latest(table(prepare(spark), d, "prepared").select("prep_id", "received_at", "sha256"), "prep_id", "received_at")
    return p.select("prep_id", F.unix_micros("received_at").alias("first_received"), "sha256", "deliveries")


def sql_term_hits(spark: SparkSession, d: str) -> DataFrame:
    return native.term_hits(_seeded(spark, d), "prep_id", F.col("text"), "delivery")


def sql_term_families(spark: SparkSession, d: str) -> DataFrame:
    s = _seeded(spark, d)
    words = s.select("prep_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit(f"({native.WORDS})"), 1)).cast("bigint").alias("words")).distinct()
    return native.family_rate_rows(native.term_hits(s, "prep_id", F.col("text"), "delivery"), words, "prep_id")


def sql_term_verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = _seeded(spark, d)
    return native.verdicts(native.term_hits(s, "prep_id", F.col("text"), "delivery"), s, "prep_id")


def sql_pattern_documents(spark: SparkSession, d: str) -> DataFrame:
    return native.pattern_documents(_seeded(spark, d), "prep_id", F.col("text"))


def sql_widest_regions(spark: SparkSession, d: str) -> DataFrame:
    r = table(prepare(spark), d, "regions").where("byte_start is not null")
    # a made-up overlap: each region reaches a third of its length to both sides
    r = r.select("prep_id", (F.col("byte_start") - F.expr("(byte_end - byte_start) div 3")).alias("s"), (F.col("byte_end") + F.expr("(byte_end - byte_start) div 3")).alias("e")).distinct()
    return native.widest_spans(r, ["prep_id"], "s", "e")


def sql_coverage(spark: SparkSession, d: str) -> DataFrame:
    return native.coverage(table(prepare(spark), d, "regions"))


def sql_region_kinds(spark: SparkSession, d: str) -> DataFrame:
    r = table(prepare(spark), d, "regions").select("prep_id", "region_no", native.region_kind(F.col("kind")).alias("kind")).distinct()
    return r.groupBy("kind").agg(F.count("*").alias("regions"), F.count_distinct("prep_id").alias("documents"))


def sql_headings(spark: SparkSession, d: str) -> DataFrame:
    return native.headings(_prepared(spark, d), "prep_id", F.col("text")).distinct()


def sql_sections(spark: SparkSession, d: str) -> DataFrame:
    return native.sections(native.headings(_prepared(spark, d), "prep_id", F.col("text")).distinct(), "prep_id")


def sql_uniform_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return native.uniform_paragraphs(_prepared(spark, d), "prep_id", F.col("text")).distinct()


def sql_long_sentences(spark: SparkSession, d: str) -> DataFrame:
    return native.long_sentences(_prepared(spark, d), "prep_id", F.col("text")).distinct()


def sql_shingle_repeats(spark: SparkSession, d: str) -> DataFrame:
    return native.shingle_repeats(table(prepare(spark), d, "toks"))


def sql_top_repeats(spark: SparkSession, d: str) -> DataFrame:
    return native.top_repeats(table(prepare(spark), d, "toks"))


def sql_source_lines(spark: SparkSession, d: str) -> DataFrame:
    return native.source_lines(_prepared(spark, d), "prep_id", F.col("text"), table(spark, d, "code_regions"))


def sql_stance_counts(spark: SparkSession, d: str) -> DataFrame:
    return native.stance_counts(spark, _prepared(spark, d).select("prep_id", "profile").distinct())


def sql_waived_regions(spark: SparkSession, d: str) -> DataFrame:
    w = prepare(spark).createDataFrame(WAIVED, "w_ord bigint, w_kind string, span_start bigint, span_end bigint")
    return native.waived_regions(table(spark, d, "regions"), w)


def sql_code_languages(spark: SparkSession, d: str) -> DataFrame:
    c = table(prepare(spark), d, "code_regions").select("prep_id", "code_no", F.lower(F.regexp_extract(F.coalesce("info", F.lit("")), r"^[ {.]*([A-Za-z0-9+#-]*)", 1)).alias("language"), "fenced").distinct()
    return c.groupBy("language").agg(F.count("*").alias("blocks"), F.count_if("fenced").alias("fenced_blocks"), F.count_if(F.col("language").isin("text", "txt", "plain", "plaintext", "md", "markdown", "prose")).alias("text_blocks"))


def sql_view_blocks(spark: SparkSession, d: str) -> DataFrame:
    v = table(prepare(spark), d, "norm_views").select("prep_id", "norm_text", "block_starts").distinct()
    b = v.select("prep_id", F.octet_length("norm_text").cast("bigint").alias("size"), F.posexplode("block_starts").alias("n", "start"))
    end = F.coalesce(F.lead("start").over(Window.partitionBy("prep_id").orderBy("n")), "size")
    return b.select("prep_id", F.col("n").cast("bigint").alias("n"), "start", end.alias("end"))


def sql_removed_characters(spark: SparkSession, d: str) -> DataFrame:
    v = table(prepare(spark), d, "norm_views").select("prep_id", F.size("zero_width_removed").cast("bigint").alias("n")).where("n > 0").distinct()
    return v.groupBy("n").agg(F.count("*").alias("views"))


def sql_swaps(spark: SparkSession, d: str) -> DataFrame:
    return native.swap_hits(_seeded(spark, d), "prep_id", F.col("text"), "delivery")


def _words(s: DataFrame) -> DataFrame:
    return s.select("prep_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit(f"({native.WORDS})"), 1)).cast("bigint").alias("words")).distinct()


def sql_densities(spark: SparkSession, d: str) -> DataFrame:
    s = _seeded(spark, d)
    return native.density_flags(native.term_hits(s, "prep_id", F.col("text"), "delivery"), _words(s), "prep_id")


def sql_first_headings(spark: SparkSession, d: str) -> DataFrame:
    return native.first_headings(native.headings(_prepared(spark, d), "prep_id", F.col("text")).distinct(), "prep_id")


def sql_oversized(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit(f"({native.WORDS})"), 1)).cast("bigint")
    return native.oversized(_prepared(spark, d), "prep_id", n, F.col("profile")).distinct()


_SWAPS_SQL = ", ".join(f"({_sql(w)}, {_sql(p)})" for r in policy.rules().values() for w, p in r.swaps.items())
_COUNTED = {i: ", ".join(_sql(x) for x in policy.rules()[i].params["count_rules"]) for i in ("D001", "D004")}
_CAPS_SQL = ", ".join(f"({_sql(k)}, {v})" for k, v in policy.rules()["X003"].params["max_words"].items())
_STOCK_SQL = ", ".join(_sql(x) for x in policy.rules()["X001"].params["heading_set"])
_RULES_SQL = ", ".join(f"('{r.id}', '{r.tier}', '{r.lifecycle}')" for r in policy.rules().values())
_STANCE_SQL = ", ".join(f"('{r}', '{p}', '{s}')" for r, p, s in policy.stance_rows())
_RATE = "(CASE WHEN words > 0 THEN findings * 10000 // words ELSE 0 END)"


def _pattern_sql() -> str:
    by: dict[str, list[str]] = {}
    for r, p, ascii_ in native.sql_patterns():
        by.setdefault(r, []).append(f"regexp_matches({'a' if ascii_ else 't'}, {_sql(p)})")
    cols = ", ".join(f"count(*) FILTER (WHERE {' OR '.join(ps)}) AS {r}" for r, ps in by.items())
    return f"WITH {_SEEDED}, v AS (SELECT text AS t, regexp_replace(text, '[^\\x00-\\x7f]', ' ', 'g') AS a FROM seeded), c AS (SELECT {cols} FROM v) SELECT rule_id, documents FROM (UNPIVOT c ON COLUMNS(*) INTO NAME rule_id VALUE documents)"


def oracle_sql() -> dict[str, str]:
    return native_sql() | view_queries.oracle_sql()


def native_sql() -> dict[str, str]:
    heads = f"""{_ONE}, l AS (SELECT prep_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) - 1 AS line_no FROM one),
 h AS (SELECT prep_id, line_no, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \\t]+[^\\s]', 1)) AS level,
  trim(regexp_replace(regexp_replace(line, '^ {{0,3}}#{{1,6}}[ \\t]+', ''), '[ \\t]+#+[ \\t]*$', '')) AS title FROM l WHERE regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \\t]+[^\\s]', 1) <> '')"""
    return {
        "sql_input_probe": f"WITH {_ONE} SELECT prep_id, sha256(text) AS sha, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS n_chars, (contains(text, chr(13) || chr(10)) AND contains(replace(text, chr(13) || chr(10), ''), chr(10)))::BIGINT AS mixed FROM one",
        "sql_deliveries": "SELECT prep_id, epoch_us(min(received_at)) AS first_received, any_value(sha256) AS sha256, count(*) AS deliveries FROM prepared GROUP BY prep_id",
        "sql_term_hits": f"WITH {_SEEDED}, {_GRAMS} SELECT * FROM hits",
        "sql_term_families": f"WITH {_SEEDED}, {_GRAMS}, f AS (SELECT prep_id, family, sum(hits)::BIGINT AS findings FROM hits GROUP BY ALL), n AS (SELECT prep_id, len(w)::BIGINT AS words FROM w) SELECT prep_id, family, findings, ({_RATE} // 10)::VARCHAR || '.' || ({_RATE} % 10)::VARCHAR AS per_1000_words FROM f JOIN n USING (prep_id)",
        "sql_term_verdicts": f"""WITH {_SEEDED}, {_GRAMS}, h AS (SELECT hits.prep_id, CASE WHEN stance = 'relax' AND tier = 'violation' THEN 'candidate' ELSE tier END AS state, lifecycle = 'blocking' AND NOT (stance = 'relax' AND tier = 'candidate') AS b
 FROM hits JOIN seeded USING (prep_id) JOIN (VALUES {_RULES_SQL}) r(rule_id, tier, lifecycle) USING (rule_id) JOIN (VALUES {_STANCE_SQL}) s(rule_id, profile, stance) ON s.rule_id = hits.rule_id AND s.profile = coalesce(seeded.profile, 'general-writing') WHERE stance <> 'off'),
 k AS (SELECT prep_id, bool_or(b AND state = 'violation') AS v, bool_or(b AND state = 'candidate') AS c FROM h GROUP BY prep_id)
 SELECT seeded.prep_id, CASE WHEN v THEN 'violations_present' WHEN c THEN 'candidates_present' ELSE 'no_findings' END AS result_state FROM seeded LEFT JOIN k USING (prep_id)""",
        "sql_pattern_documents": _pattern_sql(),
        "sql_swaps": f"WITH {_SEEDED}, {_GRAMS} SELECT prep_id, gram AS term, plain, count(*) AS hits FROM g JOIN (VALUES {_SWAPS_SQL}) s(gram, plain) USING (gram) GROUP BY ALL",
        "sql_densities": f"""WITH {_SEEDED}, {_GRAMS}, n AS (SELECT prep_id, len(w)::BIGINT AS words FROM w),
 a AS (SELECT prep_id, sum(hits)::BIGINT AS hits FROM hits WHERE rule_id IN ({_COUNTED['D001']}) GROUP BY prep_id), b AS (SELECT prep_id, sum(hits)::BIGINT AS hits FROM hits WHERE rule_id IN ({_COUNTED['D004']}) GROUP BY prep_id)
 SELECT prep_id, 'D001' AS rule_id, hits, (hits >= 3 AND words > 0 AND hits * 500 >= 3 * words)::BIGINT AS fires FROM a JOIN n USING (prep_id) UNION ALL SELECT prep_id, 'D004', hits, (hits >= 3)::BIGINT FROM b""",
        "sql_first_headings": f"WITH {heads} SELECT prep_id, arg_min(title, line_no) AS first_title, count(*) AS headings, count(*) FILTER (WHERE lower(title) IN ({_STOCK_SQL})) AS stock_titles FROM h GROUP BY prep_id",
        "sql_oversized": f"WITH {_ONE}, n AS (SELECT prep_id, profile, len(regexp_extract_all(lower(text), '[a-z0-9''-]+'))::BIGINT AS words FROM one) SELECT prep_id, words, cap::BIGINT AS cap, (words > cap)::BIGINT AS over FROM n JOIN (VALUES {_CAPS_SQL}) c(profile, cap) USING (profile)",
        "sql_widest_regions": "WITH r AS (SELECT DISTINCT prep_id, byte_start - (byte_end - byte_start) // 3 AS s, byte_end + (byte_end - byte_start) // 3 AS e FROM regions WHERE byte_start IS NOT NULL), m AS (SELECT *, max(e) OVER (PARTITION BY prep_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r) SELECT prep_id, s, e FROM m WHERE reach IS NULL OR e > reach",
        "sql_coverage": f"WITH {_KINDS}, r AS (SELECT prep_id, region_no, max(byte_start) AS s, max(byte_end) AS e, max({_KIND}) AS kind FROM rk GROUP BY ALL), c AS (SELECT prep_id, sum(e - s)::BIGINT AS total_bytes, sum(CASE WHEN kind = 'prose' THEN e - s ELSE 0 END)::BIGINT AS prose_bytes FROM r GROUP BY prep_id) SELECT *, ((total_bytes - prose_bytes) * 100 >= 40 * total_bytes)::BIGINT AS flagged FROM c",
        "sql_region_kinds": f"WITH {_KINDS}, r AS (SELECT DISTINCT prep_id, region_no, {_KIND} AS kind FROM rk) SELECT kind, count(*) AS regions, count(DISTINCT prep_id) AS documents FROM r GROUP BY kind",
        "sql_headings": f"WITH {heads} SELECT prep_id, line_no::BIGINT AS line_no, level::BIGINT AS level, title FROM h",
        "sql_sections": f"WITH {heads} SELECT a.prep_id, a.line_no::BIGINT AS line_no, a.level::BIGINT AS level, a.title, min(b.line_no)::BIGINT AS end_line FROM h a LEFT JOIN h b ON a.prep_id = b.prep_id AND b.line_no > a.line_no AND b.level <= a.level GROUP BY ALL",
        "sql_uniform_paragraphs": f"""WITH {_ONE}, c AS (SELECT prep_id, list_filter([len(regexp_extract_all(p, '[\\p{{L}}\\p{{N}}_]+')) FOR p IN regexp_split_to_array(replace(text, chr(13), ''), '\\n[ \\t]*\\n')], lambda n: n > 0) AS c FROM one),
 s AS (SELECT prep_id, len(c)::BIGINT AS paragraphs, coalesce(list_sum(c), 0)::BIGINT AS words, coalesce(list_sum([x * x FOR x IN c]), 0)::BIGINT AS q FROM c)
 SELECT prep_id, paragraphs, words, (paragraphs >= 5 AND words > 0 AND 10000 * (paragraphs * q - words * words) <= 400 * words * words)::BIGINT AS uniform FROM s""",
        "sql_long_sentences": f"WITH {_ONE}, p AS (SELECT prep_id, list_filter([len(regexp_extract_all(s, '[^ \\t\\r\\n]+')) FOR s IN regexp_split_to_array(text, '[.!?\\n]')], lambda n: n > 0) AS p FROM one) SELECT prep_id, len(p)::BIGINT AS sentences, len(list_filter(p, lambda n: n > 45))::BIGINT AS long_sentences FROM p",
        "sql_shingle_repeats": f"WITH {_SHINGLE} SELECT prep_id, sum(n)::BIGINT AS shingles, sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END)::BIGINT AS repeats FROM c GROUP BY prep_id",
        "sql_top_repeats": f"WITH {_SHINGLE} SELECT * FROM (SELECT prep_id, shingle, n, row_number() OVER (PARTITION BY prep_id ORDER BY n DESC, shingle) AS rank FROM c WHERE n > 1) WHERE rank <= 20",
        "sql_source_lines": f"""WITH {_ONE}, l AS (SELECT prep_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM one),
 o AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY prep_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
 k AS (SELECT prep_id, trim(regexp_replace(line, '[\\t\\r]', ' ', 'g')) AS t FROM o WHERE NOT EXISTS (SELECT 1 FROM code_regions c WHERE c.prep_id = o.prep_id AND c.byte_start < o.s + strlen(o.line) + 1 AND o.s < c.byte_end))
 SELECT prep_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(t, '^(#\\[|#!\\[|//)') OR regexp_matches(t, '^[{{}}()\\[\\];,]+$') OR (regexp_matches(t, '[{{}};(),\\]]$') AND (regexp_matches(t, '^(pub |pub\\(crate\\) |async |unsafe )?(fn|struct|enum|impl|trait|mod|use|const|static|type|let|match|extern)\\b') OR contains(t, '::') OR contains(t, '->') OR contains(t, '=>')))) AS source_lines
 FROM k WHERE t <> '' GROUP BY prep_id""",
        "sql_stance_counts": f"WITH {_ONE}, b AS (SELECT coalesce(profile, 'general-writing') AS profile, count(*) AS documents FROM one GROUP BY 1), s AS (SELECT profile, stance, count(*) AS rules FROM (VALUES {_STANCE_SQL}) v(rule_id, profile, stance) GROUP BY ALL) SELECT profile, stance, rules, documents FROM b JOIN s USING (profile)",
        "sql_waived_regions": f"WITH {_KINDS}, r AS (SELECT DISTINCT prep_id, region_no, byte_start, byte_end, coalesce({_KIND}, 'unknown') AS kind FROM rk) SELECT prep_id, region_no, r.kind, min(o)::BIGINT AS waiver FROM r LEFT JOIN (VALUES {', '.join(map(str, WAIVED))}) w(o, kind, a, b) ON r.kind = w.kind AND a <= byte_start AND b >= byte_end GROUP BY ALL",
        "sql_code_languages": "WITH c AS (SELECT DISTINCT prep_id, code_no, lower(regexp_extract(coalesce(info, ''), '^[ {.]*([A-Za-z0-9+#-]*)', 1)) AS language, fenced FROM code_regions) SELECT language, count(*) AS blocks, count(*) FILTER (WHERE fenced) AS fenced_blocks, count(*) FILTER (WHERE language IN ('text', 'txt', 'plain', 'plaintext', 'md', 'markdown', 'prose')) AS text_blocks FROM c GROUP BY language",
        "sql_view_blocks": "WITH v AS (SELECT DISTINCT prep_id, norm_text, block_starts FROM norm_views), b AS (SELECT prep_id, strlen(norm_text)::BIGINT AS size, unnest(block_starts) AS start, generate_subscripts(block_starts, 1) - 1 AS n FROM v) SELECT prep_id, n::BIGINT AS n, start, coalesce(lead(start) OVER (PARTITION BY prep_id ORDER BY n), size) AS \"end\" FROM b",
        "sql_removed_characters": "WITH v AS (SELECT DISTINCT prep_id, len(zero_width_removed)::BIGINT AS n FROM norm_views WHERE len(zero_width_removed) > 0) SELECT n, count(*) AS views FROM v GROUP BY n",
    }


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith(("ref_", "sql_")) and callable(f)} | view_queries.queries()
