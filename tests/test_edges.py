"""Every native query over empty tables, and over tables with null rows, repeated rows and clashing extra columns."""

import datetime

import pytest

from glyphloom import queries

T = datetime.datetime(2025, 1, 2)
TABLES = {
    "prepared": (
        "prep_id bigint, sha256 string, text string, input_format string, profile string, lang string, origin string, received_at timestamp, n int, words string",
        [(1, "a", "# One\n\nvery good; delve.\r\nx\ny", "markdown", "doc", "en", "o", T, 1, "x"), (2, "b", "", "text", None, None, None, T, 1, "x"), (3, "c", "words " * 500, "text", "comment", "en", "o", T, 1, "x")],
    ),
    "norm_views": ("prep_id bigint, norm_text string, block_starts array<bigint>, zero_width_removed array<bigint>, built_at timestamp, start int", [(1, "a b", [0], [2], T, 1), (2, "", [], [], T, 1)]),
    "regions": ("prep_id bigint, region_no int, byte_start bigint, byte_end bigint, kind string, origin string, m int", [(1, 0, 0, 9, "PROSE", "o", 1), (1, 1, 9, 12, "CodeBlock", None, 1), (1, 2, 12, 20, None, None, 1)]),
    "code_regions": ("prep_id bigint, code_no int, byte_start bigint, byte_end bigint, fenced boolean, info string, rank int", [(1, 0, 3, 9, True, "{.SQL x}", 1), (3, 0, 0, 2, False, None, 1)]),
    "toks": ("prep_id bigint, tok_no int, word string, seg int, byte_start bigint, byte_end bigint, origin string, state int", [(1, i, f"w{i % 9}", 0, 0, 1, "o", 1) for i in range(30)]),
}


@pytest.fixture(scope="module", params=["empty", "dirty"])
def folder(request, spark, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    for name, (ddl, rows) in TABLES.items():
        full = [] if request.param == "empty" else [*rows, *rows[:1], (None,) * len(rows[0]), (None,) * len(rows[0])]
        spark.createDataFrame(full, ddl).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return request.param, str(d)


@pytest.mark.parametrize("name", [q for q in queries.queries() if q.startswith("sql_") or q == "ref_verdicts"])
def test_query(spark, folder, name):
    kind, d = folder
    rows = queries.queries()[name](spark, d).collect()
    if kind == "empty" and name not in ("sql_pattern_documents",):
        assert rows == []
    assert len(set(map(str, rows))) == len(rows)


def test_views_with_odd_rows(spark):
    from pyspark.sql import functions as F

    from glyphloom.operators import views

    ddl = "prep_id bigint, norm_text string, block_starts array<bigint>, start string, rule_id int"
    rows = [(1, "Äh. We delve!\nHowever, so.", [0, 15, None, 1, 99], "x", 1), (1, "Äh. We delve!\nHowever, so.", [0, 15, None, 1, 99], "y", 2), (2, None, [0], "x", 1), (3, "", [], "x", 1), (4, "a b", None, "x", 1), (None, "very", [0], "x", 1)]
    v = spark.createDataFrame(rows, ddl)
    got = lambda df: {tuple(r) for r in df.collect()}
    # the start inside a character and those outside the text are left out
    assert got(views.view_blocks(v)) == {(1, 0, 14), (1, 15, 27), (4, 0, 3), (None, 0, 4)}
    assert got(views.view_sentences(v)) == {(1, 0, 4), (1, 4, 14), (1, 15, 27), (4, 0, 3), (None, 0, 4)}
    assert (1, 8, 14, "delve") in got(views.view_tokens(v)) and (1, 0, 4, "Äh") in got(views.view_tokens(v))
    hits = got(views.view_hits(v).select("prep_id", "rule_id", "start", "end"))
    assert {(1, "A001", 8, 13), (1, "M003", 15, 22), (None, "I001", 0, 4)} <= hits
    profiles = spark.createDataFrame([(1, "doc"), (1, None), (4, "email")], "prep_id bigint, profile string")
    assert {r["profile"] for r in views.view_findings(v, profiles).collect()} == {"doc"}
    texts = spark.createDataFrame([(1, "- a\n\n> b​c", 1), (2, None, 1), (3, "", 1)], "prep_id bigint, text string, removed int")
    out = {r["prep_id"]: (r["n_blocks"], r["removed"]) for r in views.text_views(texts).collect()}
    assert out == {1: (2, "8"), 3: (0, "")}
    for f in (views.view_blocks, views.view_sentences, views.view_tokens, views.view_hits):
        assert f(v.limit(0)).count() == 0
    assert views.text_views(texts.where(F.lit(False))).count() == 0
