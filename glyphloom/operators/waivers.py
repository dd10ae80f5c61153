"""Waivers: range join, expiry, authority floor; and the verification of approvals."""

from __future__ import annotations

import re
from calendar import timegm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom import policy

HUMAN = "human"
FAIL_CLOSED = ("instrumentation_error", "unsupported_input")
#: A waiver table of at most this many rows is broadcast; a larger one is shuffled by rule and document, or rule and cell.
BROADCAST_ROWS = 50_000
#: Bytes of a document in one cell of the range join.
CELL = 4_096
_TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d).(\d\d).(\d\d)(?:\.\d+)?(Z|z|[+-]\d\d:\d\d)?")


def unix_time(s: str | None) -> int | None:
    """RFC 3339 to unix seconds; no offset counts as UTC, and a day past the end of its month runs over."""
    m = _TIME.fullmatch(s or "")
    if not m:
        return None
    y, mo, d, h, mi, sec = map(int, m.groups()[:6])
    if not 1 <= mo <= 12 or not 1 <= d <= 31:
        return None
    t = timegm((y, mo, 1, 0, 0, 0)) + (d - 1) * 86_400 + h * 3600 + mi * 60 + sec
    z = m[7] or "Z"
    if z in "Zz":
        return t
    return t - (1 if z[0] == "+" else -1) * (int(z[1:3]) * 3600 + int(z[4:6]) * 60)


def expiry(column: str) -> Column:
    """The same in columns: null where the time cannot be read."""
    c = F.col(column)
    ok = c.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]\d\d.\d\d.\d\d(\.\d+)?(Z|z|[+-]\d\d:\d\d)?$")
    n = lambda a, k: F.substring(c, a, k).cast("bigint")
    month = F.unix_date(F.make_date(n(1, 4).cast("int"), n(6, 2).cast("int"), F.lit(1))).cast("bigint")
    base = (month + n(9, 2) - 1) * 86_400 + n(12, 2) * 3600 + n(15, 2) * 60 + n(18, 2)
    zone = F.regexp_extract(c, r"([+-])(\d\d):(\d\d)$", 1)
    shift = F.regexp_extract(c, r"[+-](\d\d):(\d\d)$", 1).try_cast("bigint") * 3600 + F.regexp_extract(c, r"[+-](\d\d):(\d\d)$", 2).try_cast("bigint") * 60
    return F.when(ok, base - F.when(zone == "+", shift).when(zone == "-", -shift).otherwise(0))


def check_waivers(rows: list[dict]) -> list[dict]:
    """Every waiver must name a span and an expiry; raises ``ValueError`` otherwise."""
    for w in rows:
        if w.get("span_start") is None or w.get("span_end") is None:
            raise ValueError(f"waiver for {w.get('rule_id')} has no span")
        if not w.get("expires"):
            raise ValueError(f"waiver for {w.get('rule_id')} has no expiry")
    return rows


def floor_reason(rule: Column, signer: Column, human_only: Column, authority: str) -> Column:
    """Why the signer may not waive the rule; null where it may."""
    shown = F.coalesce(signer, F.lit("<absent>"))
    return (
        F.when(rule.isin(*FAIL_CLOSED), F.concat(F.lit("waiver on fail-closed state "), rule, F.lit(" is never valid")))
        .when(signer == HUMAN, F.lit(None).cast("string"))
        .when(human_only | (rule == "J001"), F.concat(F.lit("waiver on "), rule, F.lit(" requires a human signer; signer_kind "), shown, F.lit(" cannot clear the authority floor")))
        .when(F.lit(authority != "orchestrator-agent"), F.concat(F.lit("agent-signed waiver for "), rule, F.lit(" rejected: deployment authority is human")))
    )


def decide(found: DataFrame, waivers: DataFrame | None, authority: str = HUMAN, now: int | None = None) -> DataFrame:
    """Adds ``waived`` and ``waiver_notes``: the first waiver in order that covers the span and passes clears a finding."""
    none = F.array().cast("array<string>")
    if waivers is None:
        return found.withColumn("waived", F.lit(False)).withColumn("waiver_notes", none)
    w = waivers.withColumn("w_ord", F.col("w_ord") if "w_ord" in waivers.columns else F.monotonically_increasing_id())
    per_doc = "doc_id" in w.columns
    w = w.select(F.col("rule_id").alias("w_rule"), *([F.col("doc_id").alias("w_doc")] if per_doc else []), "span_start", "span_end", "signer_kind", "expires", "w_ord")
    w = w.withColumn("t", expiry("expires"))
    key = ["doc_id", "sha256", "rule_id", "start", "end", "state", "seq"]
    on = (F.col("rule_id") == F.col("w_rule")) & (F.col("span_start") <= F.col("start")) & (F.col("span_end") >= F.col("end"))
    if per_doc:
        on = on & (F.col("doc_id") == F.col("w_doc"))
    one = found.where("rule_id is not null").select(*key, "human_only").distinct()
    if w.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        j = one.join(F.broadcast(w), on)
    elif per_doc:
        j = one.join(w, on)
    else:
        # a waiver stands in the cell of every place it covers, so a finding meets only waivers around its own start
        cells = F.sequence(F.floor(F.col("span_start") / CELL), F.floor(F.greatest("span_start", "span_end") / CELL))
        j = one.withColumn("cell", F.floor(F.col("start") / CELL)).join(w.withColumn("w_cell", F.explode(cells)), on & (F.col("cell") == F.col("w_cell"))).drop("cell", "w_cell")
    reason = F.coalesce(
        F.when(F.lit(now is not None) & F.col("t").isNull(), F.concat(F.lit("waiver for "), "rule_id", F.lit(" has an unreadable expiry and is ignored"))),
        F.when(F.lit(now is not None) & (F.col("t") < F.lit(now or 0)), F.concat(F.lit("expired waiver for "), "rule_id", F.lit(" ignored"))),
        floor_reason(F.col("rule_id"), F.col("signer_kind"), F.col("human_only"), authority),
    )
    j = j.withColumn("reason", reason)
    passed = F.min(F.when(F.col("reason").isNull(), F.col("w_ord")))
    outcome = j.groupBy(*key).agg(passed.alias("first_ok"), F.array_sort(F.collect_list(F.struct("w_ord", "reason"))).alias("tried"))
    outcome = outcome.select(
        *key, F.col("first_ok").isNotNull().alias("waived"),
        F.transform(F.filter("tried", lambda x: x["reason"].isNotNull() & (F.col("first_ok").isNull() | (x["w_ord"] < F.col("first_ok")))), lambda x: x["reason"]).alias("waiver_notes"),
    )
    out = found.join(outcome, key, "left")
    return out.withColumn("waived", F.coalesce("waived", F.lit(False))).withColumn("waiver_notes", F.coalesce("waiver_notes", none))


def verify(documents: DataFrame, approvals: DataFrame, now: int, id_column: str = "doc_id", content: str = "text", input_format: str = "markdown") -> DataFrame:
    """Re-earns approvals: (doc_id, outcome, problems).

    ``approvals``: doc_id, document_sha256, policy_digest, profile, demote array, waivers array of
    struct(rule_id, span_start, span_end, signer_kind, expires).
    """
    from glyphloom.operators.analysis import Deployment, read_documents, resolve

    spark = documents.sparkSession
    a = approvals.select(
        F.col("doc_id").alias("a_doc"), F.regexp_replace("document_sha256", "^sha256:", "").alias("want_hash"), "policy_digest", F.col("profile").alias("a_profile"), "demote",
        F.col("waivers").alias("a_waivers"),
    )
    known = F.col("a_profile").isin(*policy.PROFILES)
    terms = a.drop("a_waivers")
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        terms = F.broadcast(terms)  # no text is shuffled
    joined = documents.select(F.col(id_column).alias("doc_id"), F.col(content).alias("text")).join(terms, F.col("doc_id") == F.col("a_doc"))
    about = ("want_hash", "policy_digest", "a_profile", "demote")
    read = read_documents(joined, F.when(known, F.col("a_profile")), input_format, want=("hits",), passing=about)
    # one reading serves both: a document without hits keeps one row without a rule
    hits = resolve(read.select("doc_id", "sha256", "profile", "word_count", "status", "error", *about, F.inline_outer(F.when(F.col("status") == "ok", F.col("hits")))), Deployment())
    w = a.select(F.col("a_doc").alias("doc_id"), F.posexplode_outer("a_waivers").alias("w_ord", "x")).where("x is not null").select("doc_id", "w_ord", "x.*")
    hits = decide(hits, w, "orchestrator-agent", now)
    demoted = F.array_contains(F.coalesce("demote", F.array().cast("array<string>")), F.col("rule_id"))
    blocking = ~F.col("waived") & (F.col("lifecycle") == "blocking") & F.col("state").isin("violation", "candidate") & ~demoted
    out = hits.groupBy("doc_id", "sha256", "status", "error", "want_hash", "policy_digest", "a_profile").agg(F.array_sort(F.collect_set(F.when(blocking, F.col("rule_id")))).alias("left_over"))
    rules = spark.createDataFrame([(r.id, r.human_only) for r in policy.rules().values()], "rule_id string, human_only boolean")
    bad = w.withColumn("t", expiry("expires")).join(F.broadcast(rules), "rule_id", "left").withColumn("human_only", F.coalesce("human_only", F.lit(False)))
    bad = bad.select("doc_id", "w_ord", F.array_compact(F.array(
        F.when(F.col("expires").isNotNull() & F.col("t").isNull(), F.concat(F.lit("waiver for "), "rule_id", F.lit(" has unreadable expiry "), "expires")),
        F.when(F.col("t") < now, F.concat(F.lit("waiver for "), "rule_id", F.lit(" expired at "), "expires")),
        floor_reason(F.col("rule_id"), F.col("signer_kind"), F.col("human_only"), "orchestrator-agent"),
    )).alias("p")).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("w_ord", "p"))), lambda x: x["p"])).alias("waiver_problems"))
    digest = policy.digest()
    out = out.join(bad, "doc_id", "left")
    problems = F.concat(
        F.array_compact(F.array(
            F.when(F.col("sha256") != F.col("want_hash"), F.concat(F.lit("document hash mismatch: payload is "), "sha256", F.lit(", approval says "), "want_hash")),
            F.when(F.col("policy_digest") != digest, F.concat(F.lit(f"policy digest mismatch: embedded policy is {digest}, approval says "), "policy_digest")),
            F.when(~known, F.concat(F.lit("unknown profile "), "a_profile")),
        )),
        F.coalesce("waiver_problems", F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(known & (F.size("left_over") > 0), F.concat(F.lit("unwaived blocking findings remain under profile "), "a_profile", F.lit(": "), F.array_join("left_over", ", "))),
            F.when(known & (F.col("status") != "ok"), F.concat(F.lit("re-analysis under the approval failed closed: "), "error")),
        )),
    )
    return out.select("doc_id", problems.alias("problems")).select("doc_id", F.when(F.size("problems") == 0, "verified").otherwise("mismatch").alias("outcome"), "problems")

