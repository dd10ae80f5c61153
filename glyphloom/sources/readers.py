"""Readers that give (doc_id, path, content) or (doc_id, text) rows, and writers of the result relations."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom import __version__, policy
from glyphloom.operators.analysis import Analysis, Deployment
from glyphloom.operators.waivers import check_waivers


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files as bytes: doc_id (a hash of the path), path, bytes, content, unsupported.

    Program source by its name is not read: its content is null and ``unsupported`` says why; give that
    column's name to ``analyze(unsupported=...)`` and the file is reported as unsupported input.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    source = F.col("path").rlike(r"(?i)\.rs$")
    about = [F.xxhash64("path").alias("doc_id"), "path", F.col("length").alias("bytes")]
    prose = files.where(~source).select(*about, "content", F.lit(None).cast("string").alias("unsupported"))
    # the content column is not asked for here, so these files are listed but never opened
    return prose.unionByName(files.where(source).select(*about, F.lit(None).cast("binary").alias("content"), F.lit("program source by its name").alias("unsupported")))


def read_table(spark: SparkSession, path: str, id_column: str, text_column: str, fmt: str = "parquet") -> DataFrame:
    """Any columnar or JSON source with an id and a text column; only the two columns are read."""
    return spark.read.format(fmt).load(path).select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files, a whole file a row."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def probe(content: Column) -> dict[str, Column]:
    """Input probes in columns: size, hash, byte order mark, valid UTF-8, mixed line ends."""
    text = content.cast("string")
    return {
        "n_bytes": F.octet_length(content).cast("bigint"), "sha256": F.sha2(content.cast("binary"), 256),
        "has_bom": text.startswith("﻿"), "valid": F.is_valid_utf8(text),
        "mixed": text.contains("\r\n") & text.rlike(r"(?<!\r)\n"),
    }


def load_config(text: str) -> Deployment:
    """A deployment from TOML; a key of the wrong type raises ``ValueError``."""
    raw = tomllib.loads(text)
    kinds = {"waiver_authority": str, "demote": list, "expected_license_wording": str, "exempt_comment_markers": list, "product_names": list, "max_findings": int}
    for k, v in raw.items():
        if k not in kinds:
            raise ValueError(f"unknown setting {k}")
        if not isinstance(v, kinds[k]) or isinstance(v, bool) or isinstance(v, list) and not all(isinstance(x, str) for x in v):
            raise ValueError(f"setting {k} has the wrong type")
    return Deployment(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}).check()


def load_waivers(spark: SparkSession, text: str) -> DataFrame:
    """A waiver table from JSON: a list, or an object with ``waivers``."""
    raw = json.loads(text)
    items = raw["waivers"] if isinstance(raw, dict) else raw
    rows = [
        {"rule_id": w["rule_id"], "span_start": (w.get("span") or {}).get("start"), "span_end": (w.get("span") or {}).get("end"), "signer_kind": w.get("signer_kind"), "expires": w.get("expires"), "w_ord": i}
        for i, w in enumerate(items)
    ]
    check_waivers(rows)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "rule_id string, span_start bigint, span_end bigint, signer_kind string, expires string, w_ord bigint")


SCHEMA_VERSION = "1"
SUGGEST_NOTE = "applying any suggestion changes the document hash and invalidates any approval"


def visible(c: Column) -> Column:
    """JSON text with every C0, DEL and C1 control written as an upper-case ``\\uXXXX`` escape."""
    for short, code in (("b", 8), ("t", 9), ("n", 10), ("f", 12), ("r", 13)):
        # an escape after an even number of backslashes; an odd number is an escaped backslash and a letter
        c = F.regexp_replace(c, rf"(?<!\\)((?:\\\\)*)\\{short}", rf"$1\\u{code:04X}")
    for code in range(0x7F, 0xA0):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
    return c


def report_json(a: Analysis) -> DataFrame:
    """(doc_id, report): one JSON report a document.

    Fields in order: schema_version, tool_version, policy, document, result_state, note, findings in span order, and
    coverage (sections, segmentation, density with family rates, notes).  Absent options are left out.  Each relation is
    folded to one row a document before the join; take ``analyze(keep=True)`` to read the texts once.
    """
    spot = F.struct(F.col("start"), F.col("end"))
    finding = F.struct(
        "start", "end", "rule_id", F.struct(
            "rule_id", "family", "state", "lifecycle", "waived", F.array(spot).alias("spans"), "view", "container", "snippet", "section", "provenance",
            F.when(F.col("replace_with").isNotNull(), F.struct("start", "end", "replace_with")).alias("suggestion"), "message",
        ).alias("f"),
    )
    folded = lambda df, x, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(x)).alias(name))
    found = folded(a.findings, finding, "found")
    families = folded(a.families, F.struct("family", "findings", "per_1000_words"), "families")
    excluded = folded(a.segments.where("reason <> 'prose'"), F.struct("start", "end", "reason"), "excluded")
    sections = folded(a.sections, F.struct("start", "title", "level", "end"), "heads")
    d = a.documents.drop("findings")
    for part in (found, families, excluded, sections):
        d = d.join(part, "doc_id", "left")
    rows = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind))
    coverage = F.struct(
        F.transform(rows("heads", sections.schema["heads"].dataType), lambda s: F.struct(s["title"].alias("title"), s["level"].alias("level"), s["start"].alias("start"), s["end"].alias("end"))).alias("sections"),
        F.struct("prose_bytes", rows("excluded", excluded.schema["excluded"].dataType).alias("excluded")).alias("segmentation"),
        F.struct("word_count", "byte_len", rows("families", families.schema["families"].dataType).alias("families")).alias("density"), "notes",
    )
    report = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(__version__).alias("tool_version"),
        F.struct(F.lit(policy.VERSION).alias("version"), F.lit(policy.digest()).alias("digest")).alias("policy"),
        F.struct("sha256", "bytes", F.lit("utf-8").alias("encoding"), "input_format", "profile").alias("document"), "result_state", "error",
        F.lit(SUGGEST_NOTE if a.suggest else None).cast("string").alias("note"),
        F.transform(rows("found", found.schema["found"].dataType), lambda x: x["f"]).alias("findings"), coverage.alias("coverage"),
    )
    return d.select("doc_id", visible(F.to_json(report, {"ignoreNullFields": "true"})).alias("report"))


def write(a: Analysis, folder: str, fmt: str = "parquet") -> None:
    """The result relations as tables under ``folder``; findings are partitioned by family.

    Five tables are five jobs: take ``analyze(keep=True)``, so that they share one reading of the texts.
    """
    for name in ("documents", "segments", "sections", "families"):
        getattr(a, name).write.mode("overwrite").format(fmt).save(f"{folder}/{name}")
    a.findings.write.mode("overwrite").format(fmt).partitionBy("family").save(f"{folder}/findings")
