"""python -m glyphloom check|verify|policy: one document or a package listing; exit codes 0, 10, 20, 30, 40, 2."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    from glyphloom.plans.session import prepare

    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def check(o: argparse.Namespace) -> int:
    from glyphloom.operators.analysis import Deployment, analyze
    from glyphloom.sources import readers, report

    if o.path.lower().endswith(".rs"):
        print("program source is not prose", file=sys.stderr)
        return 40
    raw = sys.stdin.buffer.read() if o.path == "-" else Path(o.path).read_bytes()
    try:
        deployment = readers.load_config(Path(o.config).read_text()) if o.config else Deployment()
        spark = _session()
        waivers = readers.load_waivers(spark, Path(o.waivers).read_text()) if o.waivers else None
    except (ValueError, KeyError) as e:
        print(e, file=sys.stderr)
        return 2
    df = spark.createDataFrame([(0, bytearray(raw))], "doc_id bigint, content binary")
    a = analyze(df, o.profile, o.format, o.suggest, waivers, deployment, int(time.time()), o.max_bytes, content="content")
    print(report.render(a, 0) if o.output == "text" else readers.report_json(a).first()["report"])
    return a.documents.first()["exit_code"]


def verify(o: argparse.Namespace) -> int:
    from glyphloom.operators import waivers

    spark = _session()
    x = json.loads(Path(o.approval).read_text())
    rows = [(w["rule_id"], (w.get("span") or {}).get("start"), (w.get("span") or {}).get("end"), w.get("signer_kind"), w.get("expires")) for w in x.get("waivers", [])]
    approvals = spark.createDataFrame(
        [(0, x["document_sha256"], x["policy_digest"], x["profile"], x.get("demote", []), rows)],
        "doc_id bigint, document_sha256 string, policy_digest string, profile string, demote array<string>, waivers array<struct<rule_id:string,span_start:bigint,span_end:bigint,signer_kind:string,expires:string>>",
    )
    docs = spark.createDataFrame([(0, bytearray(Path(o.path).read_bytes()))], "doc_id bigint, content binary")
    r = waivers.verify(docs, approvals, int(time.time()), content="content").first()
    print(r["outcome"], *r["problems"], sep="\n")
    return 0 if r["outcome"] == "verified" else 10


def main(argv: list[str] | None = None) -> int:
    from glyphloom import policy

    p = argparse.ArgumentParser(prog="glyphloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check")
    c.add_argument("path")
    c.add_argument("--profile", required=True, choices=policy.PROFILES)
    c.add_argument("--format", default="markdown", choices=policy.FORMATS)
    c.add_argument("--output", default="json", choices=("json", "text"))
    c.add_argument("--suggest", action="store_true")
    c.add_argument("--waivers")
    c.add_argument("--config")
    c.add_argument("--max-bytes", type=int, default=2 * 1024 * 1024)
    v = sub.add_parser("verify")
    v.add_argument("path")
    v.add_argument("approval")
    sub.add_parser("policy").add_argument("what", choices=("digest", "show", "snapshot"))
    o = p.parse_args(argv)
    if o.command == "policy":
        print(getattr(policy, o.what)())
        return 0
    return check(o) if o.command == "check" else verify(o)


if __name__ == "__main__":
    sys.exit(main())
