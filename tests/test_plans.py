"""DataFrame plans: resolution order, waivers, gate, native operators against brute force, edge cases of the inputs."""

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphloom import policy, queries
from glyphloom.operators import analysis, native, waivers
from glyphloom.operators.analysis import Deployment
from glyphloom.sources import readers


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def states(a, **kw):
    return {(r["doc_id"], r["rule_id"]): (r["state"], r["lifecycle"], r["provenance"]) for r in a.findings.collect()}


def test_resolution(spark):
    df = frame(spark, ["The plan is simple; yes.", "> We delve into this.", "It is very good.", None, "", "clean words here"])
    a = analysis.analyze(df, "doc")
    s = states(a)
    assert s[0, "M002"] == ("violation", "blocking", "author")
    assert s[1, "A001"] == ("candidate", "blocking", "claimed-quotation")
    docs = {r["doc_id"]: r for r in a.documents.collect()}
    assert [docs[i]["exit_code"] for i in range(6)] == [10, 20, 10, 40, 0, 0]
    assert docs[3]["status"] == "unsupported_input" and docs[4]["findings"] == 0
    assert states(analysis.analyze(df, "report"))[0, "M002"][0] == "candidate"
    assert (0, "M002") not in states(analysis.analyze(df, "email"))
    assert {r["result_state"] for r in analysis.analyze(df.limit(0), "doc").documents.collect()} == set()


def test_profiles_by_row_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a; b", "doc", 5, "x"), (2, "a; b", "email", 6, "y"), (3, "a; b", None, 7, "z")], "doc_id bigint, text string, p string, seq int, state string")
    got = {(r["doc_id"], r["rule_id"]) for r in analysis.analyze(df, F.col("p")).findings.collect()}
    assert (1, "M002") in got and (2, "M002") not in got and (3, "M002") not in got


def test_demote_and_settings(spark):
    with pytest.raises(ValueError):
        Deployment(demote=("A001",)).check()
    with pytest.raises(ValueError):
        analysis.analyze(frame(spark, ["a"]), "novel")
    with pytest.raises(ValueError):
        readers.load_config("demote = 3")
    d = readers.load_config('demote = ["O005"]\nwaiver_authority = "human"')
    df = frame(spark, ["The council met twice, ensuring every objection was heard."])
    assert states(analysis.analyze(df, deployment=d))[0, "O005"][1] == "advisory"


def test_suggestions(spark):
    df = frame(spark, ["We reviewed Numerous drafts.", "The plan - such as it was - held."])
    got = {(r["rule_id"], r["snippet"]): r["replace_with"] for r in analysis.analyze(df, suggest=True).findings.collect()}
    assert got["A009", "Numerous"] == "Many" and got["M001", "n - s"] == "n, s" and got["M001", "s - h"] == "s, h"


def test_waivers(spark):
    df = frame(spark, ["The council met twice, ensuring every objection was heard.", "We delve into this."])
    rows = lambda *w: spark.createDataFrame(list(w), "rule_id string, span_start bigint, span_end bigint, signer_kind string, expires string, w_ord bigint")
    run = lambda w, auth="human": {(r["doc_id"], r["rule_id"]): r["waived"] for r in analysis.analyze(df, waivers=w, deployment=Deployment(auth), now=1_700_000_000).findings.collect()}
    late = "2030-01-01T00:00:00Z"
    assert run(rows(("O005", 0, 900, "human", late, 0)))[0, "O005"]
    assert not run(rows(("O005", 40, 900, "human", late, 0)))[0, "O005"]
    assert not run(rows(("O005", 0, 900, "human", "2020-01-01T00:00:00Z", 0)))[0, "O005"]
    assert not run(rows(("O005", 0, 900, "agent", late, 0)))[0, "O005"]
    assert run(rows(("O005", 0, 900, "orchestrator-agent", late, 0)), "orchestrator-agent")[0, "O005"]
    assert not run(rows(("A001", 0, 900, "orchestrator-agent", late, 0)), "orchestrator-agent")[1, "A001"]
    assert run(rows(("O005", 0, 900, "agent", late, 0), ("O005", 0, 900, "human", late, 1)))[0, "O005"]
    with pytest.raises(ValueError):
        readers.load_waivers(spark, '[{"rule_id": "O005", "span": {"start": 0, "end": 5}}]')
    w = readers.load_waivers(spark, '{"waivers": [{"rule_id": "O005", "span": {"start": 0, "end": 900}, "signer_kind": "human", "expires": "2030-01-01T00:00:00Z"}]}')
    assert run(w)[0, "O005"]


@pytest.mark.parametrize("s", ["2030-01-02T03:04:05Z", "2030-01-02t03:04:05.75+02:30", "2030-02-31 03:04:05", "1999-12-31T23:59:59-11:00", "2030-13-01T00:00:00Z", "soon", ""])
def test_expiry_columns_agree(spark, s):
    got = spark.createDataFrame([(s,)], "e string").select(waivers.expiry("e")).first()[0]
    assert got == waivers.unix_time(s)
    if s.endswith("05Z"):
        assert got == int(datetime.datetime(2030, 1, 2, 3, 4, 5, tzinfo=datetime.UTC).timestamp())


def test_verify(spark):
    df = frame(spark, ["Plain words are here.", "We delve into this.", "Plain words are here."])
    kind = "doc_id bigint, document_sha256 string, policy_digest string, profile string, demote array<string>, waivers array<struct<rule_id:string,span_start:bigint,span_end:bigint,signer_kind:string,expires:string>>"
    import hashlib

    h = [hashlib.sha256(t.encode()).hexdigest() for t in ("Plain words are here.", "We delve into this.", "x")]
    a = spark.createDataFrame([(i, x, policy.digest(), "doc", [], [("A001", 0, 99, "agent", "2030-01-01T00:00:00Z")] if i == 1 else []) for i, x in enumerate(h)], kind)
    got = {r["doc_id"]: (r["outcome"], " ".join(r["problems"])) for r in waivers.verify(df, a, 1_700_000_000).collect()}
    assert got[0][0] == "verified" and got[2][0] == "mismatch" and "hash mismatch" in got[2][1]
    assert "requires a human signer" in got[1][1] and "A001" in got[1][1]


def test_widest_spans_against_brute_force(spark):
    rnd = random.Random(5)
    spans = {(rnd.randrange(2), a := rnd.randrange(60), a + rnd.randrange(1, 25)) for _ in range(200)}
    got = {tuple(r) for r in native.widest_spans(spark.createDataFrame(list(spans), "k int, s int, e int"), ["k"], "s", "e").collect()}
    want = set()
    for k in (0, 1):
        last = None
        for s, e in sorted(((s, e) for kk, s, e in spans if kk == k), key=lambda x: (x[0], -x[1])):
            if last is None or e > last:
                want.add((k, s, e))
                last = e if last is None else max(last, e)
    assert got == want


def test_term_hits_against_brute_force(spark):
    texts = ["We delve, and DELVE again: game changer! game-changer", "", "nothing here", None]
    got = {(r["doc_id"], r["rule_id"]): r["hits"] for r in native.term_hits(frame(spark, texts), "doc_id", F.col("text")).collect()}
    assert got[0, "A001"] == 4
    terms = {(r, t) for r, _, t, _ in native.term_rows()}
    words = re.findall(native.WORDS, texts[0].lower())
    for rule in {r for r, _ in terms}:
        n = sum(" ".join(words[i : i + k]) == t for r, t in terms if r == rule for k in [len(t.split())] for i in range(len(words) - k + 1))
        assert got.get((0, rule), 0) == n


def test_shingles_and_rates(spark):
    toks = spark.createDataFrame([(1, i, f"w{i % 10}", 0, 0, 0, "o") for i in range(30)] + [(1, 3, "w3", 0, 0, 0, "o"), (2, 0, None, 0, 0, 0, None)], "prep_id bigint, tok_no int, word string, seg int, byte_start bigint, byte_end bigint, origin string")
    r = native.shingle_repeats(toks).collect()
    assert [(x["prep_id"], x["shingles"], x["repeats"]) for x in r] == [(1, 23, 13)]
    assert native.top_repeats(toks).count() == 10
    row = spark.range(1).select(analysis.rate(F.lit(3), F.lit(700)).alias("a"), analysis.rate(F.lit(3), F.lit(0)).alias("b")).first()
    assert (row["a"], row["b"]) == ("4.2", "0.0")


def test_rollup_counts_documents_exactly(spark):
    ids = F.col("id")
    found = spark.range(6000).select(F.when(ids > 0, F.concat(F.lit("d"), ids % 3000)).alias("doc_id"), F.lit("f").alias("family"), F.concat(F.lit("r"), ids % 2).alias("rule_id"))
    got = {(r["family"], r["rule_id"]): (r["findings"], r["documents_about"]) for r in analysis.corpus_rollup(found).collect()}
    assert got == {("f", "r0"): (3000, 1500), ("f", "r1"): (3000, 1500), ("f", None): (6000, 3000), (None, None): (6000, 3000)}


def test_stream_equals_batch(spark, tmp_path):
    from glyphloom.streaming import stream_findings

    frame(spark, ["We delve into this.", "a very good day"]).repartition(2).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    q = stream_findings(src, "doc").writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["doc_id"], r["rule_id"]) for r in spark.table("found").collect()}
    want = {(r["doc_id"], r["rule_id"]) for r in analysis.analyze(spark.read.parquet(str(tmp_path / "in")), "doc").findings.collect()}
    assert got == want and (0, "A001") in got


def test_stream_with_event_time(spark, tmp_path):
    from glyphloom.streaming import family_counts, stream_findings

    at = datetime.datetime(2025, 1, 1, 10)
    rows = [(0, "We delve into this.", at), (1, "We delve.", at + datetime.timedelta(hours=5)), (2, "words", at + datetime.timedelta(hours=30))]
    spark.createDataFrame(rows, "doc_id bigint, text string, t timestamp").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("doc_id bigint, text string, t timestamp").parquet(str(tmp_path / "in"))
    q = family_counts(stream_findings(src, "doc", time_column="t"), "t").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["window"]["start"].hour, r["family"]): r["findings"] for r in spark.table("counted").collect()}
    family = policy.rules()["A001"].family
    assert got[10, family] == 1 and got[15, family] == 1


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "a.md").write_text("We delve into this.")
    (tmp_path / "b.rs").write_text("fn main() {}")
    files = readers.read_files(spark, str(tmp_path))
    a = analysis.analyze(files, "doc", content="content", keep=True, unsupported="unsupported")
    docs = {r["exit_code"]: r for r in a.documents.collect()}
    assert set(docs) == {10, 40} and docs[40]["error"] == "program source by its name"
    reports = [json.loads(r["report"]) for r in readers.report_json(a).collect()]
    assert {r["result_state"] for r in reports} == {"violations_present", "unsupported_input"}
    readers.write(a, str(tmp_path / "out"))
    written = {r["rule_id"] for r in spark.read.parquet(str(tmp_path / "out/findings")).collect()}
    assert written == {"A001", "F001"}  # "We" is first person


def test_json_report(spark):
    text = "# One\n\nWe delve\x1b\x85 in, numerous times\\\\n.\n\n```\nx\n```\n"
    a = analysis.analyze(frame(spark, [text, ""]), "doc", suggest=True, keep=True)
    raw = {r["doc_id"]: r["report"] for r in readers.report_json(a).collect()}
    r = json.loads(raw[0])
    assert list(r) == ["schema_version", "tool_version", "policy", "document", "result_state", "note", "findings", "coverage"]
    assert list(r["coverage"]) == ["sections", "segmentation", "density", "notes"] and r["coverage"]["sections"] == [{"title": "One", "level": 1, "start": 0, "end": len(text.encode())}]
    assert {x["reason"] for x in r["coverage"]["segmentation"]["excluded"]} == {"structure", "code_fence"}
    found = {f["rule_id"]: f for f in r["findings"]}
    assert list(found["A009"])[:5] == ["rule_id", "family", "state", "lifecycle", "waived"] and found["A009"]["suggestion"]["replace_with"] == "many"
    assert "suggestion" not in found["A001"] and found["A001"]["section"] == "One"
    starts = [(f["spans"][0]["start"], f["spans"][0]["end"], f["rule_id"]) for f in r["findings"]]
    assert starts == sorted(starts) and "\\u001B" in raw[0] and not re.search("[\x00-\x1f\x7f-\x9f]", raw[0])
    assert json.loads(raw[1])["findings"] == [] and json.loads(raw[1])["result_state"] == "no_findings"
    # escapes stay apart from written-out backslashes
    rows = spark.createDataFrame([("a\n\\n\t\x9f",)], "s string")
    s = rows.select(readers.visible(F.to_json(F.struct("s"))).alias("j")).first()["j"]
    assert s == '{"s":"a\\u000A\\\\n\\u0009\\u009F"}' and json.loads(s)["s"] == "a\n\\n\t\x9f"


def test_fails_closed_with_coverage(spark):
    df = frame(spark, ["# A\n\n" + "very " * 30, "fine words"])
    a = analysis.analyze(df, "doc", deployment=Deployment(max_findings=20), keep=True)
    docs = {r["doc_id"]: r for r in a.documents.collect()}
    assert docs[0]["exit_code"] == 30 and docs[0]["word_count"] == 31 and docs[0]["findings"] == 0 and docs[1]["exit_code"] == 0
    assert a.segments.where("doc_id = 0").count() > 0 and a.sections.where("doc_id = 0").count() == 1
    assert readers.load_config("max_findings = 7").max_findings == 7
    for bad in ("max_findings = true", "max_findings = -1", "max_findings = 'x'"):
        with pytest.raises(ValueError):
            readers.load_config(bad)


def test_a_slice_without_its_trigger_fails_closed(monkeypatch):
    from glyphloom.functions import analyze as one
    from glyphloom.functions.scan import Hit

    monkeypatch.setattr(one, "find_hits", lambda *_: [Hit("A001", 0, 2, trigger="delve")])
    row = one.analyze_bytes(b"We sort this.", "doc")
    assert row["status"] == "instrumentation_error" and row["hits"] == [] and row["word_count"] == 3


def test_product_names_are_subjects():
    from glyphloom.functions.analyze import Settings, analyze_bytes

    found = lambda **k: [h["rule_id"] for h in analyze_bytes(b"Loomkit reads text. Loomkit does not detect authorship.", "doc", settings=Settings(**k))["hits"]]
    assert "C011" not in found() and "C011" in found(product_names=("loomkit",))
    assert readers.load_config('product_names = ["loomkit"]').product_names == ("loomkit",)


def test_each_relation_alone_equals_one_reading(spark):
    texts = ["# A\n\nWe delve.\n\n## B\n\nvery good `x`", None, "", "a;b\n\n# C"]
    kept, lazy = analysis.analyze(frame(spark, texts), "doc", keep=True), analysis.analyze(frame(spark, texts), "doc")
    for name in ("documents", "findings", "segments", "sections", "families"):
        assert sorted(map(str, getattr(kept, name).collect())) == sorted(map(str, getattr(lazy, name).collect()))
    plan = lazy.segments._jdf.queryExecution().optimizedPlan().toString()
    assert "hits" not in plan and "segments" in plan


def test_many_waivers_without_a_document(spark, monkeypatch):
    df = frame(spark, ["We delve into this. " * 400] * 2)
    rows = [("A001", a, a + 12_000, "human", "2030-01-01T00:00:00Z", a) for a in range(-5, 9_000, 1_500)]
    w = spark.createDataFrame(rows, "rule_id string, span_start bigint, span_end bigint, signer_kind string, expires string, w_ord bigint")
    want = sorted(map(str, analysis.analyze(df, "doc", waivers=w, now=1_700_000_000).findings.collect()))
    monkeypatch.setattr(waivers, "BROADCAST_ROWS", 2)
    assert sorted(map(str, analysis.analyze(df, "doc", waivers=w, now=1_700_000_000).findings.collect())) == want


def test_checkpoint_folder_is_the_clusters(spark):
    from types import SimpleNamespace

    from glyphloom.plans import session

    none = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        session.cut(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc)))
    assert not session._wide(spark.createDataFrame([(1,)], "SortJoinWindow int").selectExpr("SortJoinWindow + 1 AS Aggregate")) and session._wide(spark.range(3).distinct())


def test_queries_have_unique_lower_names():
    q, o = queries.queries(), queries.oracle_sql()
    assert set(o) <= set(q) and {k for k in q if k.startswith(("sql_", "ref_view_", "ref_text_"))} == set(o)


def test_sql_table_function(spark):
    from glyphloom.operators.udtf import register
    from glyphloom.plans.session import prepare

    register(prepare(spark))
    frame(spark, ["We delve into this.", None]).createOrReplaceTempView("some_docs")
    got = {tuple(r) for r in spark.sql("SELECT d.doc_id, r.rule_id, r.start FROM some_docs d, LATERAL lint(d.text, 'doc') r").collect()}
    assert got == {(0, "A001", 3), (0, "F001", 0)}


def test_text_report(spark):
    from glyphloom.sources.report import escape, render

    a = analysis.analyze(frame(spark, ["We delve into this.", ""]), "doc")
    assert "A001 violation/blocking" in render(a, 0) and "no_findings" in render(a, 1) and "not found" in render(a, 9)
    assert escape("a\x1b\x85b") == "a\\u001B\\u0085b"


def test_command_line(capsys):
    from glyphloom.__main__ import main

    assert main(["policy", "digest"]) == 0 and capsys.readouterr().out.strip() == policy.digest()
    assert main(["check", "x.rs", "--profile", "doc"]) == 40
    with pytest.raises(SystemExit):
        main(["check", "x"])


def test_repeated_deliveries_and_two_contents(spark):
    df = spark.createDataFrame([(1, "We delve."), (1, "We delve."), (2, "ok words"), (2, "a; b")], "doc_id bigint, text string")
    a = analysis.analyze(df, "doc")
    assert a.documents.groupBy("doc_id").count().where("doc_id = 1").first()["count"] == 1
    assert a.documents.where("doc_id = 2").count() == 2
    assert [r["findings"] for r in a.documents.where("doc_id = 1").collect()] == [2]
    assert a.findings.where("doc_id = 1").count() == 2
