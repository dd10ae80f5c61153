"""Corpus analysis as DataFrame plans.

One Arrow stage beside the scan reads a document into nested relations (hits, segments,
sections, statistics).  Everything after it is declarative: the rule table and the stances
come in by broadcast joins (93 and 651 rows), tiers are resolved by column expressions,
waivers by a range join on the rule, duplicates by a grouped minimum, the gate by an
aggregation.  Every aggregation combines map-side, so no key is hot, and only hits are shuffled.

Defined results: null content gives status ``unsupported_input``; an empty document has no
finding; more findings than the limit give ``instrumentation_error``, with coverage; a null profile counts as the default profile; extra columns of the input pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom import policy
from glyphloom.functions.analyze import MAX_FINDINGS, RELATIONS, Settings
from glyphloom.functions.guards import MAX_BYTES
from glyphloom.operators.waivers import decide
from glyphloom.plans.session import cut, spread

_HIT = pa.struct([
    ("seq", pa.int32()), ("rule_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("quoted", pa.bool_()), ("force_candidate", pa.bool_()),
    ("force_hint", pa.bool_()), ("detail", pa.string()), ("matched", pa.string()), ("snippet", pa.string()), ("container", pa.string()), ("section", pa.string()),
])
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("profile", pa.string()), ("input_format", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64()), ("bom_stripped", pa.bool_()),
    ("mixed_line_endings", pa.bool_()), ("status", pa.string()), ("error", pa.string()), ("word_count", pa.int64()), ("byte_len", pa.int64()),
    ("prose_bytes", pa.int64()), ("bullets", pa.int64()), ("linked_bullets", pa.int64()), ("task_bullets", pa.int64()), ("paragraph_words", pa.list_(pa.int64())),
    ("hits", pa.list_(_HIT)), ("segments", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]))),
    ("sections", pa.list_(pa.struct([("title", pa.string()), ("level", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
])


def _ddl(schema: pa.Schema) -> str:
    def kind(t: pa.DataType) -> str:
        if pa.types.is_list(t):
            return f"array<{kind(t.value_type)}>"
        if pa.types.is_struct(t):
            return "struct<" + ",".join(f"{f.name}:{kind(f.type)}" for f in t) + ">"
        return {"int64": "bigint", "int32": "int", "string": "string", "bool": "boolean"}[str(t)]

    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)


@dataclass(frozen=True)
class Deployment:
    """Settings of a deployment: who may waive, demoted rules, license wording, allowed comment markers,
    the names its product goes by (subjects of a capability denial), and the limit of findings a document."""

    waiver_authority: str = "human"
    demote: tuple[str, ...] = ()
    expected_license_wording: str | None = None
    exempt_comment_markers: tuple[str, ...] = ()
    product_names: tuple[str, ...] = ()
    max_findings: int = MAX_FINDINGS

    def check(self) -> "Deployment":
        rules = policy.rules()
        if self.waiver_authority not in ("human", "orchestrator-agent"):
            raise ValueError(f"unknown waiver authority {self.waiver_authority}")
        if self.max_findings < 0:
            raise ValueError("max_findings must not be negative")
        for r in self.demote:
            if r not in rules:
                raise ValueError(f"cannot demote unknown rule {r}")
            if rules[r].tier != "candidate" or r == "J001":
                raise ValueError(f"cannot demote {r}: only candidate-tier rules outside family J")
        return self


@dataclass
class Analysis:
    """The result relations; each is a lazy DataFrame over the same reading stage."""

    documents: DataFrame
    findings: DataFrame
    segments: DataFrame
    sections: DataFrame
    families: DataFrame
    read: DataFrame = field(repr=False, default=None)
    suggest: bool = False


def _lists(rows: list[list[dict]], kind: pa.ListType) -> pa.Array:
    """Nested rows as one list array, built field by field."""
    inner = kind.value_type
    flat = [x for r in rows for x in r]
    offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    if not pa.types.is_struct(inner):
        return pa.ListArray.from_arrays(offsets, pa.array(flat, inner))
    parts = [pa.array([x[f.name] for x in flat], f.type) for f in inner]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(inner)))


def _record(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for f in schema:
        values = [r[f.name] for r in rows]
        columns.append(_lists(values, f.type) if pa.types.is_list(f.type) else pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def read_documents(df: DataFrame, profile: str | Column = "general-writing", input_format: str | Column = "markdown", deployment: Deployment = Deployment(), max_bytes: int = MAX_BYTES, id_column: str = "doc_id", content: str = "text", want: tuple[str, ...] = RELATIONS, unsupported: str | None = None, passing: tuple[str, ...] = ()) -> DataFrame:
    """The reading stage: one row of nested relations a document.

    ``want`` names the nested relations to compute; one left out has no column, and without ``hits`` nothing is
    normalised or scanned.  ``unsupported`` names a column that says why a row cannot be read (null where it can).
    ``passing`` names columns of the input (timestamps, keys) that go through unread.
    """
    deployment.check()
    if isinstance(profile, str) and profile not in policy.PROFILES:
        raise ValueError(f"unknown profile {profile}")
    if isinstance(input_format, str) and input_format not in policy.FORMATS:
        raise ValueError(f"unknown input format {input_format}")
    if not set(want) <= set(RELATIONS):
        raise ValueError(f"unknown relations {want}")
    prof = F.lit(profile) if isinstance(profile, str) else profile
    form = F.lit(input_format) if isinstance(input_format, str) else input_format
    rows = df.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(prof, F.lit("general-writing")).alias("profile"),
        F.coalesce(form, F.lit("markdown")).alias("input_format"), F.col(content).cast("binary").alias("content"),
        (F.col(unsupported) if unsupported else F.lit(None)).cast("string").alias("refused"), *(F.col(c).alias(f"pass_{c}") for c in passing),
    )
    settings = Settings(max_bytes, deployment.max_findings, deployment.expected_license_wording, deployment.exempt_comment_markers, deployment.product_names)
    schema = pa.schema([f for f in _SCHEMA if f.name in want or f.name not in RELATIONS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from glyphloom.functions.analyze import analyze_bytes

        for b in batches:
            out = []
            for doc_id, p, f, raw, refused in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
                p = p if p in policy.PROFILES else "general-writing"
                if raw is None or refused is not None:
                    row = analyze_bytes(b"", p, f, settings, ()) | {"status": "unsupported_input", "error": refused or "no content"}
                else:
                    row = analyze_bytes(raw, p, f if f in policy.FORMATS else "markdown", settings, want)
                out.append({"doc_id": doc_id, "profile": p, "input_format": f, **row})
            if out:
                record = _record(out, schema)
                for name, column in zip(b.schema.names[5:], b.columns[5:], strict=True):
                    record = record.append_column(name.removeprefix("pass_"), column)
                yield record

    ddl = ", ".join([_ddl(schema), *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in passing)])
    return spread(rows).mapInArrow(run, ddl)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        policy.rules_rows(), "rule_id string, name string, family string, tier string, lifecycle string, view string, kind string, human_only boolean"
    )


def stance_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(policy.stance_rows(), "rule_id string, profile string, stance string")


def resolve(hits: DataFrame, deployment: Deployment = Deployment()) -> DataFrame:
    """Stance, tier and lifecycle of exploded hits, in the fixed order: forced, relaxed, quoted, demoted.

    A row without a rule (a document without hits) passes through.
    """
    spark = hits.sparkSession
    df = hits.join(F.broadcast(rule_table(spark)), "rule_id", "left").join(F.broadcast(stance_table(spark)), ["rule_id", "profile"], "left")
    df = df.where("rule_id is null or (stance <> 'off' and lifecycle <> 'deprecated')")
    tier = F.when(F.col("force_hint"), "coverage_hint").when(F.col("force_candidate") & (F.col("tier") == "violation"), "candidate").otherwise(F.col("tier"))
    df = df.withColumn("t1", tier).withColumn("l1", F.when(F.col("force_hint"), "advisory").otherwise(F.col("lifecycle")))
    relax = F.col("stance") == "relax"
    df = df.withColumn("l2", F.when(relax & (F.col("t1") == "candidate"), "advisory").otherwise(F.col("l1")))
    df = df.withColumn("t2", F.when(relax & (F.col("t1") == "violation"), "candidate").otherwise(F.col("t1")))
    quoted = F.col("quoted") & (F.col("t2") == "violation") & F.col("rule_id").isin(*policy.QUOTE_DOWNGRADE)
    df = df.withColumn("state", F.when(quoted, "candidate").otherwise(F.col("t2"))).withColumn("provenance", F.when(quoted, "claimed-quotation").otherwise("author"))
    demoted = F.col("rule_id").isin(*deployment.demote) if deployment.demote else F.lit(False)
    df = df.withColumn("lifecycle", F.when(demoted, "advisory").otherwise(F.col("l2")))
    return df.drop("t1", "t2", "l1", "l2", "tier", "stance", "kind")


def suggestion() -> Column:
    """Replacement text of a finding: the plain word of a swap with the case of its first letter, or the fixed edits of the mechanical rules."""
    swaps = {w: p for r in policy.rules().values() for w, p in r.swaps.items()}
    table = F.create_map(*[F.lit(x) for kv in swaps.items() for x in kv])
    m = F.col("matched")
    first, last = F.substring(m, 1, 1), F.substring(m, -1, 1)
    plain = F.when(F.col("rule_id") == "A009", table[F.lower(m)])
    cased = F.when(first.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(plain, 1, 1)), plain.substr(F.lit(2), F.length(plain)))).otherwise(plain)
    letter = lambda c: F.when(c.rlike(r"^\p{L}"), c).otherwise("")
    return (
        F.when(plain.isNotNull(), cased)
        .when(F.col("rule_id") == "M001", F.concat(letter(first), F.lit(", "), letter(last)))
        .when(F.col("rule_id") == "M002", ".")
        .when(F.col("rule_id").isin("M003", "M006", "T001", "I001"), "")
    )


def message(name: Column, detail: Column) -> Column:
    """The rule's name in words, and what it says about the place."""
    return F.concat_ws(": ", F.replace(name, F.lit("-"), F.lit(" ")), detail)


def analyze(df: DataFrame, profile: str | Column = "general-writing", input_format: str | Column = "markdown", suggest: bool = False, waivers: DataFrame | None = None, deployment: Deployment = Deployment(), now: int | None = None, max_bytes: int = MAX_BYTES, id_column: str = "doc_id", content: str = "text", keep: bool = False, unsupported: str | None = None) -> Analysis:
    """Findings, verdicts, segments, sections and family rates of every document.

    ``waivers``: rule_id, span_start, span_end, signer_kind, expires (RFC 3339), optionally
    doc_id; ``now`` in unix seconds makes expired waivers fail.  Deliveries of one content under
    one id count once; two contents under one id are two documents.  Each relation reads only what
    it needs of a document; ``keep`` writes one full reading to the checkpoint folder instead, for
    callers that use several of the relations.
    """

    def reading(*want: str) -> DataFrame:
        return read_documents(df, profile, input_format, deployment, max_bytes, id_column, content, want, unsupported)

    if keep:
        whole = cut(reading(*RELATIONS))
        read, parts, heads = whole.drop("segments", "sections"), whole, whole
    else:
        read, parts, heads = reading("hits"), reading("segments"), reading("sections")
    doc_columns = [c for c in read.columns if c not in ("hits", "segments", "sections")]
    # one pass for both: a document without hits keeps one row without a rule
    found = resolve(read.select(*doc_columns, F.inline_outer(F.when(F.col("status") == "ok", F.col("hits")))), deployment)
    found = decide(found, waivers, deployment.waiver_authority, now)
    # distinct on rule, span and state (deliveries of one content fold here too): the first in reading order stays.
    # A grouped minimum folds copies before the exchange, so a document delivered very often is no hot key.
    key = ["doc_id", "sha256", "rule_id", "start", "end", "state"]
    rest = [c for c in found.columns if c not in key and c != "seq"]
    found = found.groupBy(*key).agg(F.min_by(F.struct(*rest), F.coalesce("seq", F.lit(0))).alias("m")).select(*key, "m.*")
    fix = F.when(~F.col("force_hint"), suggestion()) if suggest else F.lit(None).cast("string")
    findings = found.where("rule_id is not null").select(
        "doc_id", "profile", "rule_id", "family", "state", "lifecycle", "waived", "start", "end", "view", "container", "snippet", "section", "provenance",
        fix.alias("replace_with"), message(F.col("name"), F.col("detail")).alias("message"), "word_count",
    )
    gated = found.groupBy("doc_id", "sha256").agg(
        *(F.first(c).alias(c) for c in doc_columns if c not in ("doc_id", "sha256")), *gate_columns(), F.bool_or(F.col("rule_id") == "J001").alias("adversarial"),
        F.array_distinct(F.flatten(F.collect_list("waiver_notes"))).alias("waiver_notes"),
    )
    notes = F.array_compact(F.array(
        F.when(F.col("bom_stripped"), "leading byte order mark stripped; offsets index the rest"), F.when(F.col("mixed_line_endings"), "mixed line endings"),
        F.when(F.col("adversarial"), "injection pattern present: every candidate needs a human reader"),
    ))
    documents = gated.withColumn("result_state", F.when(F.col("status") != "ok", F.col("status")).otherwise(gate_state())).select(
        "doc_id", "profile", "input_format", "sha256", "bytes", "byte_len", "word_count", "prose_bytes", "bullets", "linked_bullets", "task_bullets", "paragraph_words",
        "status", "error", "result_state", exit_code(F.col("result_state")).alias("exit_code"), "findings", F.concat(notes, "waiver_notes").alias("notes"),
    )
    segments = parts.select("doc_id", F.inline("segments")).distinct()
    return Analysis(documents, findings, segments, heads.select("doc_id", F.inline("sections")).distinct(), family_rates(findings), read, suggest)


def gate_columns() -> list[Column]:
    """Aggregates of the gate: unwaived blocking violations and candidates, and all findings."""
    open_ = ~F.col("waived") & (F.col("lifecycle") == "blocking")
    return [
        F.bool_or(open_ & (F.col("state") == "violation")).alias("has_violation"), F.bool_or(open_ & (F.col("state") == "candidate")).alias("has_candidate"),
        F.count("rule_id").alias("findings"),
    ]


def gate_state() -> Column:
    return F.when(F.col("has_violation"), "violations_present").when(F.col("has_candidate"), "candidates_present").otherwise("no_findings")


def gate(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, result_state, exit_code, findings) of resolved findings with their ``waived``."""
    out = found.groupBy(*keys).agg(*gate_columns()).withColumn("result_state", gate_state())
    return out.select(*keys, "result_state", exit_code(F.col("result_state")).cast("bigint").alias("exit_code"), "findings")


def exit_code(state: Column) -> Column:
    """30 instrumentation, 40 unsupported, 10 violations, 20 candidates, 0 clean."""
    return (
        F.when(state == "instrumentation_error", 30).when(state == "unsupported_input", 40).when(state == "violations_present", 10)
        .when(state == "candidates_present", 20).otherwise(0)
    )


def rate(count: Column, words: Column, per: int = 1000) -> Column:
    """``t.d`` findings per ``per`` words in integer tenths; 0.0 where there is no word."""
    tenths = F.when(words > 0, F.floor(count * per * 10 / words)).otherwise(0).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def family_rates(findings: DataFrame) -> DataFrame:
    """Findings and rate per 1000 words of each family in each document."""
    n = findings.groupBy("doc_id", "family").agg(F.count("*").alias("findings"), F.max("word_count").alias("word_count"))
    return n.select("doc_id", "family", "findings", rate(F.col("findings"), F.col("word_count")).alias("per_1000_words"))


def corpus_rollup(findings: DataFrame) -> DataFrame:
    """Corpus totals by family and rule (an extension): counts of findings and, exactly, of documents.

    ``documents_about`` keeps its name.  The findings fold to one row a family, rule and document
    first; a document then counts once at each level of the rollup.
    """
    one = findings.groupBy("family", "rule_id", "doc_id").agg(F.count("*").alias("n"))
    return one.rollup("family", "rule_id").agg(F.sum("n").alias("findings"), F.count_distinct("doc_id").alias("documents_about"))
