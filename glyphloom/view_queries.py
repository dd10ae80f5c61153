"""Queries that hold the text engine itself against SQL: over the given norm views, and over documents read as plain text.

Each runs the functions the reading stage runs (blocks, sentences, tokens, word sets, resolution, waivers, gate, segmentation,
statistics) over whole tables.  The SQL states the same from the tables alone; character classes that RE2 lacks are written out.
"""

from __future__ import annotations

from collections.abc import Callable

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom import policy
from glyphloom.functions.chars import BULLETS, DECORATION
from glyphloom.functions.guards import KEYWORDS, MIN_LINES, MIN_PERCENT
from glyphloom.operators import analysis, views, waivers
from glyphloom.plans.seeds import SENTENCES
from glyphloom.plans.session import prepare, spread, table

Query = Callable[[SparkSession, str], DataFrame]
NOW = 1_760_000_000


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ranges(pattern: str) -> str:
    """The characters that match a pattern, as ranges that RE2 reads inside a class."""
    rx = regex.compile(pattern)
    out: list[list[int]] = []
    for o in (*range(0xD800), *range(0xE000, 0x30000)):
        if rx.match(chr(o)):
            if out and out[-1][1] == o - 1:
                out[-1][1] = o
            else:
                out.append([o, o])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a < b else f"\\x{{{a:X}}}" for a, b in out)


#: Rules whose hits are word sets over the norm view and nothing else: SQL can state them exactly.
WORD_RULES = [r for r in policy.rules().values() if r.kind == "word-set" and r.view == "norm" and r.scope == "none" and not r.patterns and not r.case_sensitive]


def seeds() -> list[str]:
    """Sentences laid behind the views, so that every word rule has hits and near misses: seed pairs, terms, exempt phrases."""
    out = list(SENTENCES)
    for r in WORD_RULES:
        some = dict.fromkeys((*r.terms[:2], *r.terms[len(r.terms) // 2 :][:1], *r.terms[-1:]))
        out += [f"{t[:1].upper()}{t[1:]} appears in prose; so x{t}x and {t}, {t.upper()}." for t in some]
        out += [f"Here {p} stays." for p in r.exempt]
    return list(dict.fromkeys(out))


SEEDS = seeds()


def seeded_views(spark: SparkSession, d: str) -> DataFrame:
    """Every norm view with one seed sentence as its last block."""
    v = spread(table(prepare(spark), d, "norm_views"), ["prep_id", "norm_text", "block_starts"])
    s = spark.createDataFrame(list(enumerate(SEEDS)), "k bigint, sentence string")
    v = v.join(F.broadcast(s), F.pmod("prep_id", F.lit(len(SEEDS))) == F.col("k"))
    return v.select(
        "prep_id", F.concat("norm_text", F.lit("\n"), "sentence").alias("norm_text"),
        F.concat("block_starts", F.array((F.octet_length("norm_text") + 1).cast("bigint"))).alias("block_starts"),
    )


def ref_text_views(spark: SparkSession, d: str) -> DataFrame:
    """Our views of the documents that the given table has a view of."""
    ids = table(prepare(spark), d, "norm_views").where("norm_text is not null").select("prep_id").distinct()
    return views.text_views(_plain(spark, d)).join(ids, "prep_id", "left_semi")


def ref_view_blocks(spark: SparkSession, d: str) -> DataFrame:
    return views.view_blocks(table(prepare(spark), d, "norm_views"))


def ref_view_sentences(spark: SparkSession, d: str) -> DataFrame:
    return views.view_sentences(table(prepare(spark), d, "norm_views"))


def ref_view_tokens(spark: SparkSession, d: str) -> DataFrame:
    return views.view_tokens(table(prepare(spark), d, "norm_views"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    ids = [r.id for r in WORD_RULES]
    profiles = table(spark, d, "prepared").select("prep_id", "profile")
    return views.view_findings(seeded_views(spark, d), profiles).where(F.col("rule_id").isin(*ids))


def ref_view_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = views.view_hits(seeded_views(spark, d))
    return hits.where(F.col("rule_id").isin(*[r.id for r in WORD_RULES])).select("prep_id", "rule_id", "start", "end")


def ref_view_findings(spark: SparkSession, d: str) -> DataFrame:
    return _found(prepare(spark), d).select("doc_id", "profile", "rule_id", "family", "start", "end", "state", "lifecycle")


def ref_view_suggestions(spark: SparkSession, d: str) -> DataFrame:
    f = _found(prepare(spark), d)
    return f.select(
        "doc_id", "rule_id", "start", "end", "matched", analysis.suggestion().alias("replace_with"), analysis.message(F.col("name"), F.lit(None).cast("string")).alias("message")
    ).where("replace_with is not null")


def ref_view_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return analysis.gate(_found(prepare(spark), d).withColumn("waived", F.lit(False)), ["doc_id"])


def ref_view_families(spark: SparkSession, d: str) -> DataFrame:
    return analysis.family_rates(_found(prepare(spark), d))


def ref_view_rollup(spark: SparkSession, d: str) -> DataFrame:
    return analysis.corpus_rollup(_found(prepare(spark), d))


def waiver_rows() -> list[tuple]:
    """Waivers of every kind: (rule, start, end, signer, expiry, order)."""
    rows = []
    for i, r in enumerate(policy.rules().values()):
        rows.append((r.id, 0, 900 + 7 * i, ("human", "orchestrator-agent", None)[i % 3], ("2030-01-01T00:00:00Z", "2020-01-01T00:00:00+02:00")[i % 2], 2 * i))
        rows.append((r.id, 300, 5000, "human", ("2031-02-03T04:05:06.5-03:30", "some day")[i % 5 == 0], 2 * i + 1))
    return rows


def ref_view_waived(spark: SparkSession, d: str) -> DataFrame:
    w = prepare(spark).createDataFrame(waiver_rows(), "rule_id string, span_start bigint, span_end bigint, signer_kind string, expires string, w_ord bigint")
    return waivers.decide(_found(spark, d), w, "human", NOW).select("doc_id", "rule_id", "start", "end", F.col("waived").cast("bigint").alias("waived"), F.size("waiver_notes").cast("bigint").alias("notes"))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(prepare(spark), d, "prepared"), ["prep_id", "text", "profile"])


def ref_text_segments(spark: SparkSession, d: str) -> DataFrame:
    return analysis.analyze(_plain(spark, d), "doc", "text", id_column="prep_id").segments


def ref_text_stats(spark: SparkSession, d: str) -> DataFrame:
    a = analysis.analyze(_plain(spark, d), "doc", "text", id_column="prep_id").documents
    return a.select(
        "doc_id", "sha256", "bytes", "byte_len", "status", "word_count", "prose_bytes", "bullets", "linked_bullets",
        F.array_join(F.col("paragraph_words").cast("array<string>"), ",").alias("paragraph_words"),
    )


#: Rules over the statistics of a document.
STAT_RULES = ("D002", "D003", "X003", "H002")


def ref_text_flags(spark: SparkSession, d: str) -> DataFrame:
    a = analysis.analyze(_plain(spark, d), F.col("profile"), "text", id_column="prep_id").findings
    return a.where(F.col("rule_id").isin(*STAT_RULES)).select("doc_id", "rule_id", "family", "state", "lifecycle", "start", "end")


def oracle_sql() -> dict[str, str]:
    space = ranges(r"\s")
    alnum = ranges(r"[\p{Alphabetic}\p{N}]")
    cont = ranges(r"\p{XID_Continue}")
    lower = ranges(r"\p{Lowercase}")
    digit = ranges(r"\d")
    decor = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in DECORATION) + BULLETS
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def bytes_of(pieces: str) -> str:
        """Pieces of a text with the byte place of each: unnested (piece, n), summed by view and block."""
        return f"SELECT *, coalesce(sum(strlen(piece)) OVER (PARTITION BY prep_id, base ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + base AS s FROM ({pieces})"

    blocks = f"""v AS (SELECT DISTINCT prep_id, norm_text, block_starts FROM norm_views WHERE norm_text <> ''),
 u AS (SELECT prep_id, norm_text, strlen(norm_text)::BIGINT AS size, unnest(list_sort(list_distinct(block_starts))) AS s FROM v),
 w AS (SELECT prep_id, norm_text, s, coalesce(lead(s) OVER (PARTITION BY prep_id ORDER BY s), size) AS e FROM u),
 b AS (SELECT prep_id, s, regexp_replace(decode(encode(norm_text)[s + 1 : e]), '[{space}]+$', '') AS t FROM w),
 blocks AS (SELECT prep_id, s, t FROM b WHERE t <> '')"""
    terms = ", ".join(f"({quoted(r.id)}, {quoted(t)}, {r.word_boundary}, {r.block_start or t in r.params.get('block_start_only', ()) or (r.id, t) == ('T001', 'overall')})" for r in WORD_RULES for t in dict.fromkeys(r.terms))
    exempt = ", ".join(f"({quoted(r.id)}, {quoted(p)})" for r in WORD_RULES for p in r.exempt)
    hits = f"""seeded AS (SELECT DISTINCT prep_id, norm_text || chr(10) || s AS t FROM norm_views JOIN (VALUES {', '.join(f'({i}, {quoted(s)})' for i, s in enumerate(SEEDS))}) x(k, s) ON prep_id % {len(SEEDS)} = k),
 low AS (SELECT prep_id, t, translate(t, '{upper}', '{small}') AS l FROM seeded),
 p AS (SELECT prep_id, t, l, rule_id, term, bounded, opening, string_split(l, term) AS parts FROM low JOIN (VALUES {terms}) y(rule_id, term, bounded, opening) ON contains(l, term)),
 q AS (SELECT prep_id, t, l, rule_id, term, bounded, opening, unnest([list_sum([length(x) FOR x IN parts[1:k]])::BIGINT + (k - 1) * length(term) FOR k IN range(1, len(parts))]) AS a FROM p),
 r AS (SELECT *, a + length(term) AS z, substring(t, 1, a::INT) AS prefix FROM q),
 h0 AS (SELECT * FROM r WHERE NOT (bounded AND (regexp_matches(prefix, '[{cont}]$') OR regexp_matches(substring(t, z::INT + 1, 1), '^[{cont}]')))
   AND NOT (opening AND NOT (regexp_replace(prefix, '[{space}{decor}]*$', '') = '' OR regexp_matches(prefix, '\\n[{space}{decor}]*$') OR regexp_matches(prefix, '[.!?:][{space}{decor}]+$')))
   AND NOT EXISTS (SELECT 1 FROM (VALUES {exempt}) e(x_rule, phrase) WHERE x_rule = rule_id AND contains(substring(l, greatest(1, z - length(phrase) + 1)::INT, (a + length(phrase) - greatest(0, z - length(phrase)))::INT), phrase))),
 h1 AS (SELECT prep_id, rule_id, strlen(prefix)::BIGINT AS s, (strlen(prefix) + strlen(term))::BIGINT AS e, min(substring(t, (a + 1)::INT, length(term))) AS matched FROM h0 GROUP BY ALL),
 h2 AS (SELECT *, max(e) OVER (PARTITION BY prep_id, rule_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h1),
 hits AS (SELECT prep_id, rule_id, matched, s, e FROM h2 WHERE reach IS NULL OR e > reach)"""
    rules = ", ".join(f"('{r.id}', '{r.family}', '{r.tier}', '{r.lifecycle}', {r.human_only}, {quoted(r.name)})" for r in policy.rules().values())
    swaps = ", ".join(f"({quoted(w)}, {quoted(p)})" for w, p in policy.rules()["A009"].swaps.items())
    stances = ", ".join(f"('{r}', '{p}', '{s}')" for r, p, s in policy.stance_rows())
    relaxed = "CASE WHEN stance = 'relax' AND tier = 'violation' THEN 'candidate' ELSE tier END AS state, CASE WHEN stance = 'relax' AND tier = 'candidate' THEN 'advisory' ELSE lifecycle END AS lifecycle"
    found = f"""{hits}, prof AS (SELECT prep_id, coalesce(min(profile), 'general-writing') AS profile FROM prepared GROUP BY prep_id),
 found AS (SELECT prep_id AS doc_id, profile, rule_id, family, name, matched, s AS start, e AS "end", human_only, {relaxed}
  FROM hits JOIN prof USING (prep_id) JOIN (VALUES {rules}) ru(rule_id, family, tier, lifecycle, human_only, name) USING (rule_id) JOIN (VALUES {stances}) st(rule_id, profile, stance) USING (rule_id, profile) WHERE stance <> 'off')"""
    by_unix = {r[4]: waivers.unix_time(r[4]) for r in waiver_rows()}
    given = ", ".join(f"({quoted(r)}, {a}, {b}, {quoted(s) if s else 'NULL::VARCHAR'}, {by_unix[x] if by_unix[x] is not None else 'NULL::BIGINT'}, {o})" for r, a, b, s, x, o in waiver_rows())
    line = f"""one AS (SELECT DISTINCT prep_id, text FROM prepared WHERE text IS NOT NULL),
 ln AS (SELECT prep_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM one),
 lo AS (SELECT *, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY prep_id, text ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, rtrim(raw, chr(13)) AS line,
  regexp_replace(regexp_replace(raw, '^[{space}]+', ''), '[{space}]+$', '') AS t FROM ln),
 words AS (SELECT *, string_split_regex(t, '[{space}]+') AS w FROM lo),
 shaped AS (SELECT *, CASE WHEN w[1] IN ('pub', 'pub(crate)', 'async', 'unsafe') AND len(w) > 1 THEN w[2] ELSE w[1] END AS head,
  regexp_extract(t, '^(?:pub(?:\\(crate\\))? )?[{space}]*[\\p{{L}}_][\\p{{L}}\\p{{N}}\\p{{M}}_]*[{space}]*:([{space}][{space}]*[^{space}].*|[^:{space}].*),$', 1) AS kind FROM words),
 judged AS (SELECT *, t <> '' AS filled, t <> '' AND (regexp_matches(t, '^(#\\[|#!\\[|//)') OR regexp_matches(t, '^[{{}}()\\[\\];,]+$') OR (regexp_matches(t, '[{{}};(),\\]]$') AND (
   regexp_extract(head, '^[\\p{{L}}\\p{{N}}\\p{{M}}_]*') IN ({', '.join(quoted(k) for k in sorted(KEYWORDS))}) OR contains(t, '::') OR contains(t, '->') OR contains(t, '=>')
   OR (trim(kind) <> '' AND (NOT regexp_matches(trim(kind), '[{space}]') OR regexp_matches(kind, '[<&:]')) AND regexp_matches(regexp_replace(kind, '[{space}]', '', 'g'), '^[\\p{{L}}\\p{{N}}\\p{{M}}_&(\\[][\\p{{L}}\\p{{N}}\\p{{M}}_:<>&'',\\[\\]()]*$'))))) AS code FROM shaped),
 docs AS (SELECT prep_id, text, NOT (count(*) FILTER (WHERE code) >= {MIN_LINES} AND count(*) FILTER (WHERE code) * 100 >= {MIN_PERCENT} * count(*) FILTER (WHERE filled)) AS ok FROM judged GROUP BY ALL),
 prose AS (SELECT prep_id, text, s + strlen(regexp_extract(line, '^[{space}]*(?:[-*+>{BULLETS}]|#+|[{digit}]+[.)])[{space}]+'))::BIGINT AS a, s + strlen(line)::BIGINT AS z FROM judged WHERE filled),
 kept AS (SELECT prep_id, text, a, z FROM prose WHERE a < z)"""
    stats = f"""{line}, par AS (SELECT *, sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER (PARTITION BY prep_id, text ORDER BY n) AS g, len(regexp_extract_all(line, '[{cont}]+'))::BIGINT AS k FROM judged),
 paras AS (SELECT prep_id, text, g, sum(CASE WHEN filled THEN k ELSE 0 END)::BIGINT AS k FROM par GROUP BY ALL),
 pw AS (SELECT prep_id, text, coalesce(list(k ORDER BY g) FILTER (WHERE k > 0), [])::BIGINT[] AS paragraph_words FROM paras GROUP BY ALL),
 lead AS (SELECT prep_id, text, count(*) FILTER (WHERE filled AND regexp_matches(raw, '^[{space}]*[-*+] ')) AS bullets, count(*) FILTER (WHERE filled AND regexp_matches(raw, '^[{space}]*[-*+] ') AND (contains(raw, '](') OR contains(raw, 'http'))) AS linked_bullets FROM judged GROUP BY ALL),
 pb AS (SELECT prep_id, text, sum(z - a)::BIGINT AS prose_bytes FROM kept GROUP BY ALL),
 st AS (SELECT prep_id, text, ok, CASE WHEN ok THEN paragraph_words ELSE []::BIGINT[] END AS paragraph_words, CASE WHEN ok THEN bullets ELSE 0 END AS bullets, CASE WHEN ok THEN linked_bullets ELSE 0 END AS linked_bullets,
  CASE WHEN ok THEN coalesce(prose_bytes, 0) ELSE 0 END AS prose_bytes, CASE WHEN ok THEN coalesce(list_sum(paragraph_words), 0) ELSE 0 END::BIGINT AS word_count, CASE WHEN ok THEN strlen(text) ELSE 0 END::BIGINT AS byte_len
  FROM docs JOIN pw USING (prep_id, text) JOIN lead USING (prep_id, text) LEFT JOIN pb USING (prep_id, text))"""
    r = policy.rules()
    caps = ", ".join(f"('{k}', {v})" for k, v in r["X003"].params["max_words"].items())
    flags = {
        "D002": f"bullets >= {r['D002'].params['min_bullets']} AND linked_bullets * 100 >= {r['D002'].params['min_link_bullet_pct']} * bullets",
        "D003": f"len(paragraph_words) >= {r['D003'].params['min_paragraphs']} AND 10000 * (len(paragraph_words) * list_sum([x * x FOR x IN paragraph_words]) - word_count * word_count) <= {r['D003'].params['max_length_cv_pct'] ** 2} * word_count * word_count",
        "X003": f"EXISTS (SELECT 1 FROM (VALUES {caps}) c(p, cap) WHERE p = profile AND word_count > cap)",
        "H002": f"byte_len > 0 AND (byte_len - prose_bytes) * 100 >= {r['H002'].params['flag_excluded_pct']} * byte_len",
    }
    return {
        "ref_view_blocks": f"WITH {blocks} SELECT prep_id, s AS start, (s + strlen(t))::BIGINT AS \"end\" FROM blocks",
        "ref_view_sentences": f"""WITH {blocks}, m AS (SELECT prep_id, s AS base, regexp_replace(regexp_replace(t, '\\.([{alnum}])', chr(26) || '\\1', 'g'), '\\.([ \\t]{{1,8}}[{lower}])', chr(26) || '\\1', 'g') AS t FROM blocks),
 x AS ({bytes_of("SELECT prep_id, base, unnest(regexp_extract_all(t, '[^.!?]*[.!?]|[^.!?]+$')) AS piece, generate_subscripts(regexp_extract_all(t, '[^.!?]*[.!?]|[^.!?]+$'), 1) AS n FROM m")})
 SELECT prep_id, s AS start, (s + strlen(piece))::BIGINT AS "end" FROM x WHERE regexp_matches(piece, '[^{space}]')""",
        "ref_view_tokens": f"""WITH v AS (SELECT DISTINCT prep_id, norm_text AS t, 0::BIGINT AS base FROM norm_views WHERE norm_text <> ''),
 x AS ({bytes_of(f"SELECT prep_id, base, unnest(regexp_extract_all(t, '[{space}]+|[^{space}]+')) AS piece, generate_subscripts(regexp_extract_all(t, '[{space}]+|[^{space}]+'), 1) AS n FROM v")})
 SELECT prep_id, s AS start, (s + strlen(piece))::BIGINT AS "end", translate(regexp_replace(regexp_replace(piece, '^[^{alnum}'']+', ''), '[^{alnum}'']+$', ''), '{upper}', '{small}') AS bare FROM x WHERE NOT regexp_matches(piece, '^[{space}]')""",
        "ref_view_hits": f"WITH {hits} SELECT prep_id, rule_id, s AS start, e AS \"end\" FROM hits",
        "ref_view_findings": f"WITH {found} SELECT doc_id, profile, rule_id, family, start, \"end\", state, lifecycle FROM found",
        "ref_text_views": "SELECT DISTINCT prep_id, md5(nfc_normalize(norm_text)) AS view_md5, len(block_starts)::BIGINT AS n_blocks, array_to_string(zero_width_removed, ',') AS removed FROM norm_views WHERE norm_text IS NOT NULL",
        "ref_view_suggestions": f"""WITH {found}, w AS (SELECT *, CASE WHEN rule_id = 'A009' THEN CASE WHEN regexp_matches(matched, '^\\p{{Lu}}') THEN upper(plain[1]) || plain[2:] ELSE plain END WHEN rule_id IN ('M003', 'M006', 'T001', 'I001') THEN '' END AS replace_with
  FROM found LEFT JOIN (VALUES {swaps}) sw(term, plain) ON rule_id = 'A009' AND translate(matched, '{upper}', '{small}') = term)
 SELECT doc_id, rule_id, start, "end", matched, replace_with, replace(name, '-', ' ') AS message FROM w WHERE replace_with IS NOT NULL""",
        "ref_view_verdicts": f"""WITH {found}, g AS (SELECT doc_id, bool_or(lifecycle = 'blocking' AND state = 'violation') AS v, bool_or(lifecycle = 'blocking' AND state = 'candidate') AS c, count(*) AS findings FROM found GROUP BY doc_id)
 SELECT doc_id, CASE WHEN v THEN 'violations_present' WHEN c THEN 'candidates_present' ELSE 'no_findings' END AS result_state, CASE WHEN v THEN 10 WHEN c THEN 20 ELSE 0 END::BIGINT AS exit_code, findings FROM g""",
        "ref_view_families": f"""WITH {found}, n AS (SELECT prep_id AS doc_id, len(regexp_extract_all(t, '[{cont}]+'))::BIGINT AS words FROM seeded), f AS (SELECT doc_id, family, count(*) AS findings FROM found GROUP BY ALL)
 SELECT doc_id, family, findings, (findings * 10000 // words // 10)::VARCHAR || '.' || (findings * 10000 // words % 10)::VARCHAR AS per_1000_words FROM f JOIN n USING (doc_id)""",
        "ref_view_rollup": f"WITH {found} SELECT family, rule_id, count(*) AS findings, count(DISTINCT doc_id) AS documents_about FROM found GROUP BY ROLLUP (family, rule_id)",
        "ref_view_waived": f"""WITH {found}, j AS (SELECT doc_id, rule_id, start, "end", o, t IS NOT NULL AND t >= {NOW} AND coalesce(signer, '') = 'human' AS passes FROM found JOIN (VALUES {given}) w(rule_id, a, b, signer, t, o) USING (rule_id) WHERE a <= start AND b >= "end"),
 k AS (SELECT doc_id, rule_id, start, "end", min(o) FILTER (WHERE passes) AS first_ok FROM j GROUP BY ALL),
 c AS (SELECT j.doc_id, j.rule_id, j.start, j."end", first_ok, count(*) FILTER (WHERE NOT passes AND (first_ok IS NULL OR o < first_ok)) AS notes FROM j JOIN k USING (doc_id, rule_id, start, "end") GROUP BY ALL)
 SELECT f.doc_id, f.rule_id, f.start, f."end", (first_ok IS NOT NULL)::BIGINT AS waived, coalesce(notes, 0) AS notes FROM found f LEFT JOIN c USING (doc_id, rule_id, start, "end")""",
        "ref_text_segments": f"""WITH {line}, g AS (SELECT prep_id, text, a, z, coalesce(lag(z) OVER w, 0) AS before, row_number() OVER w = count(*) OVER (PARTITION BY prep_id, text) AS last FROM kept JOIN docs USING (prep_id, text) WHERE ok WINDOW w AS (PARTITION BY prep_id, text ORDER BY a))
 SELECT DISTINCT doc_id, start, "end", reason FROM (SELECT prep_id AS doc_id, a AS start, z AS "end", 'prose' AS reason FROM g UNION ALL SELECT prep_id, before, a, 'structure' FROM g WHERE a > before UNION ALL SELECT prep_id, z, strlen(text)::BIGINT, 'structure' FROM g WHERE last AND z < strlen(text)
  UNION ALL SELECT prep_id, 0, strlen(text)::BIGINT, 'structure' FROM docs WHERE ok AND text <> '' AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.prep_id = docs.prep_id AND k.text = docs.text))""",
        "ref_text_stats": f"""WITH {stats} SELECT prep_id AS doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes, byte_len,  CASE WHEN ok THEN 'ok' ELSE 'unsupported_input' END AS status, word_count, prose_bytes::BIGINT AS prose_bytes, bullets::BIGINT AS bullets, linked_bullets::BIGINT AS linked_bullets, array_to_string(paragraph_words, ',') AS paragraph_words FROM st
 UNION ALL SELECT DISTINCT prep_id, sha256(''), 0, 0, 'unsupported_input', 0, 0, 0, 0, '' FROM prepared WHERE text IS NULL""",
        "ref_text_flags": f"""WITH {stats}, pr AS (SELECT DISTINCT prep_id, text, coalesce(profile, 'general-writing') AS profile FROM prepared WHERE text IS NOT NULL),
 fl AS (SELECT prep_id, text, profile, unnest([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in flags.items())}]) AS rule_id FROM st JOIN pr USING (prep_id, text) WHERE ok)
 SELECT DISTINCT prep_id AS doc_id, rule_id, family, {relaxed}, 0::BIGINT AS start, strlen(substring(text, 1, 1))::BIGINT AS "end" FROM fl JOIN (VALUES {rules}) ru(rule_id, family, tier, lifecycle, human_only, name) USING (rule_id) JOIN (VALUES {stances}) t(rule_id, profile, stance) USING (rule_id, profile) WHERE stance <> 'off'""",
    }


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("ref_") and callable(f)}
