"""DataFrame operators: nulls, empty tables, repeated rows, clashing extra columns, and brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import operators as ops
from glyphloom.llm import queries

PREPARED = "prep_id bigint, text string, origin string, lang string, kind string, item_id int"


def prepared(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, f"o{i % 2}" if i % 3 else None, lang, "x", 1) for i, t in enumerate(texts)], PREPARED)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_markup(spark):
    df = prepared(spark, ["# a\n\nb", None, "", "plain", "x **y**"])
    assert rows(ops.markup_kinds(df.union(df))) == {(0, "heading"), (4, "other")}
    clean = {r["prep_id"]: r["clean_text"] for r in ops.clean_markup(df).collect()}
    assert clean == {0: "# a\n\nb", 1: None, 2: "", 3: "plain", 4: "x y"}
    assert ops.markup_kinds(df.limit(0)).count() == 0


def test_repetition_and_hosts(spark):
    df = prepared(spark, ["one two three four five six seven. " * 5, None, "", "all words differ here now", "eight nine ten eleven twelve two. " * 4, "短い文です"])
    got = {r["prep_id"]: r for r in ops.repetition(df.union(df)).collect()}
    assert {k for k, r in got.items() if r["is_repetitive"]} == {0, 4}
    assert len(got) == 6 and got[0]["host_verdict"] == "unknown" and 0 < got[0]["host_rate"] < 1
    host = [r for r in got.values() if r["origin"] == "o0"]
    assert len({r["host_rate"] for r in host}) == 1 and host[0]["host_docs"] == 2
    assert ops.repetition(df.limit(0)).count() == 0
    toks = spark.createDataFrame([(1, i, f"w{i % 7}") for i in range(21)] + [(1, 0, "w0"), (2, 0, None)], "prep_id bigint, tok_no int, word string")
    assert rows(ops.token_repetition(toks)) == {(1, 21, 14), (2, 1, 0)}


def test_host_verdict_decides_where_the_words_do_not(spark, monkeypatch):
    # one reading of "a-b" has two words, the other one: the shares lie on both sides of the limit
    from glyphloom.llm.repetition import measures

    run = "one two three four five six seven"
    text = f"{run}. {run}. " + " ".join(f"w{chr(97 + i)}-v{chr(97 + i)}" for i in range(5)) + " so"
    _, letters, written, *_ = measures(text)
    assert letters < 0.35 <= written
    bad, good = f"{run}. " * 6, "no word of this text comes twice in it at all"
    rows_ = [(0, text, "spam"), (1, text, "fine"), (2, text, None)]
    rows_ += [(10 + i, bad, "spam") for i in range(30)] + [(100 + i, f"{good} {i}", "fine") for i in range(60)]
    df = spark.createDataFrame(rows_, "prep_id bigint, text string, origin string")
    want = {0, *range(10, 40)}
    found = lambda: {r["prep_id"] for r in ops.repetition(df).where("is_repetitive").collect()}
    assert found() == want
    monkeypatch.setattr(ops, "MAX_BROADCAST_HOSTS", 1)  # the salted join gives the same
    assert found() == want
    # without host verdicts the rows change
    real = ops.host_verdicts
    monkeypatch.setattr(ops, "host_verdicts", lambda d: (real(d)[0].withColumn("host_verdict", F.lit("ordinary")), 0.0))
    assert found() == want - {0}


def test_found_joins_the_hosts(spark, tmp_path):
    prepared(spark, ["one two three four five six seven. " * 5]).write.parquet(str(tmp_path / "prepared.parquet"))
    plan = queries.p2_found(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "host_verdict" in plan


def test_levels(spark):
    rnd = random.Random(1)
    easy = lambda: " ".join(f"The {rnd.choice(['cat', 'dog', 'sun'])} is in the {rnd.choice(['hat', 'box', 'bed'])}." for _ in range(15))
    hard = lambda: " ".join(f"The institutional {rnd.choice(['parameterisation', 'sedimentation'])} of methodological {rnd.choice(['historiography', 'legitimisation'])} destabilises, notwithstanding considerable uncertainty, the jurisdictional reconciliation." for _ in range(8))
    texts = [easy() if i % 2 else hard() for i in range(40)]
    df = prepared(spark, [*texts, None, "", "too short", "# markup\n\n" + easy(), "Die Katze ist auf der Matte. " * 20])
    labels = spark.createDataFrame([(i, i, "r", " Basic" if i % 2 else "ADVANCED", datetime.datetime(2025, 1, 1)) for i in range(30)] + [(99, 1, "r", None, None), (98, None, "r", "basic", None)], "label_id bigint, prep_id bigint, rater string, band string, rated_at timestamp")
    got = {r["prep_id"]: r for r in ops.reading_levels(df.union(df), labels).collect()}
    assert all(got[i]["band"] == ("basic" if i % 2 else "advanced") for i in range(40))
    assert set(got) == {*range(40), 43, 44} and got[43]["has_markup"] and got[44]["is_repetitive"]
    none = ops.reading_levels(df, labels.limit(0)).where("band is not null")
    assert none.count() == 0


def test_sentences(spark):
    schema = "prep_id bigint, norm_text string, block_starts array<bigint>, spans int"
    v = spark.createDataFrame([(1, "Äh. Two", [0], 1), (1, "Äh. Two", [0], 2), (2, None, [0], 1), (3, "", [], 1), (4, "a", None, 1)], schema)
    assert rows(ops.sentence_spans(v)) == {(1, 0, 4), (1, 5, 8), (4, 0, 1)}
    assert ops.sentence_spans(v.limit(0)).count() == 0


def test_look_alikes_against_brute_force(spark):
    from glyphloom.llm.textforms import fold

    rnd = random.Random(2)
    base = ["alpha cafe", "beta fish", "", "gamma"]
    texts = ["".join(rnd.choice({"a": "aа", "e": "eе", "i": "iі", " ": " \u00a0"}.get(c, c)) for c in rnd.choice(base)) for _ in range(60)] + [None]
    p = prepared(spark, texts)
    v = p.select("prep_id", F.col("text").alias("norm_text"))
    got = rows(ops.look_alike_pairs(p.union(p), v))
    want = {(f, i, j) for f in ("prepared_text", "norm_text") for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and fold(a) == fold(b)}
    assert got == want and want
    classes = {r["prep_id"]: r for r in ops.look_classes(p.union(p), v).where("field_name = 'norm_text'").collect()}
    look = {i: min(j for j, b in enumerate(texts) if b is not None and fold(b) == fold(a)) for i, a in enumerate(texts) if a is not None}
    assert {i: r["class_id"] for i, r in classes.items()} == look
    # representatives and membership carry the same links as the pairs
    links = ops.look_links(p.union(p), v).where("field_name = 'norm_text'").collect()
    first = {t: min(j for j, b in enumerate(texts) if b == t) for t in set(texts) - {None}}
    several = {c for c in look.values() if len({texts[i] for i in look if look[i] == c}) > 1}
    assert {(r["class_id"], r["spelling_id"], r["n_documents"]) for r in links} == {(look[i], i, texts.count(t)) for t, i in first.items() if look[i] in several}
    assert ops.look_links(p.limit(0), v.limit(0)).count() == ops.look_classes(p.limit(0), v.limit(0)).count() == 0


def test_canonical_texts_stay_where_they_are(spark):
    df = prepared(spark, ["caf\u00e9", "cafe\u0301", None, "\u2163 \ufb01"]).withColumn("received_at", F.lit(datetime.datetime(2025, 1, 1)))
    out = ops.canonical_texts(df.union(df))
    got = sorted((r["prep_id"], r["canonical_text"]) for r in out.collect())
    assert got == sorted([(0, "caf\u00e9"), (1, "caf\u00e9"), (3, "IV fi")] * 2)
    assert "received_us" in out.columns


def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"x y. {item.upper()} z", 1), (2, None, 1), (3, "", 1), (4, "nothing to see", 1), (5, " ".join(f"word{i}" for i in range(10, 35)), 1)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (None, item)], "item_id bigint, text string")
    assert rows(ops.leaked_items(docs, items).select("doc_id", "item_id")) == {(1, 7), (1, 8), (5, 7), (5, 8)}
    clean = {r["doc_id"]: r for r in ops.decontaminated(docs, items).collect()}
    assert clean[1]["action"] == "removed" and clean[4]["action"] == "kept" and clean[2]["text"] is None and len(clean) == 5
    old = ops.MAX_INDEX_WORDS
    try:
        whole, cut_ = rows(ops.leaked_items(docs.union(docs), items)), {str(r) for r in ops.decontaminated(docs, items).collect()}
        ops.MAX_INDEX_WORDS = 50  # the items meet the documents in a join
        assert ops.item_index(items) is None and rows(ops.leaked_items(docs.union(docs), items)) == whole
        assert {str(r) for r in ops.decontaminated(docs, items).collect()} == cut_
        assert ops.joined_leaks(docs.limit(0), items).count() == ops.joined_leaks(docs, items.limit(0)).count() == 0
    finally:
        ops.MAX_INDEX_WORDS = old
    assert ops.leaked_items(docs, items.limit(0)).count() == 0


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(6)
    sizes = {"a": 900, "B ": 120, "c": 60, "d": 30}
    docs = [(i, "word " * rnd.randrange(5, 60), rnd.choice(["en", "EN", "deu", None]), s, "x") for s, n in sizes.items() for i in range(10_000 * ord(s[0]), 10_000 * ord(s[0]) + n)]
    docs += [(1, None, "en", "a", "x"), (2, "text", "en", None, "x"), (3, "text", "en", "z", "x")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, uses string")


def test_mix(spark, mixed):
    targets = spark.createDataFrame([("a", 0.4, 1.0), ("b", 0.3, 2.5), ("c", 0.2, 4.0), ("e", 0.1, None)], "source string, target_share double, max_repeats double")
    mix, shares = ops.mix(mixed, targets, queries.TOKENIZER)
    used = mix.collect()
    s = {r["source"]: r for r in shares.collect()}
    assert {r["source"] for r in used} == {"a", "b", "c"} and s["e"]["used_tokens"] == 0
    for name, share in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(s[name]["reached_share"] - share) < 0.01
    assert all(r["uses"] <= {"a": 1, "b": 2, "c": 4}[r["source"]] for r in used)
    assert len({r["doc_id"] for r in used}) == len(used)
    again = {(r["doc_id"], r["uses"]) for r in ops.mix(mixed.repartition(7), targets, queries.TOKENIZER)[0].collect()}
    assert again == {(r["doc_id"], r["uses"]) for r in used}
    other = {r["doc_id"] for r in ops.mix(mixed, targets, queries.TOKENIZER, seed=5)[0].collect()}
    assert other != {r["doc_id"] for r in used}


def test_stretched_mix_moves_shortages_to_siblings_first(spark, mixed):
    targets = spark.createDataFrame([("a", 0.5, 3.0), ("c", 0.3, 3.0), ("d", 0.2, 1.0)], "source string, target_share double, max_repeats double")
    run = lambda stretch, domains: {r["source"]: r for r in ops.mix(mixed, targets, queries.TOKENIZER, stretch=stretch, domains=domains)[1].collect()}
    plain = run(1.0, {"c": "x", "d": "x"})
    assert all(abs(r["reached_share"] - r["target_share"]) < 0.03 for r in plain.values())
    both, apart = run(1.5, {"c": "x", "d": "x"}), run(1.5, {"a": "x", "d": "x"})
    total = sum(r["used_tokens"] for r in both.values())
    assert total == pytest.approx(1.5 * sum(r["used_tokens"] for r in plain.values()), rel=0.03)
    for got, sibling in ((both, "c"), (apart, "a")):
        # the short source gives what it has; its sibling takes the rest, the other domain keeps its share
        assert got["d"]["used_tokens"] == got["d"]["source_tokens"] and got["d"]["reached_share"] < 0.15
        share = {"a": 0.5, "c": 0.3}
        assert got[sibling]["reached_share"] > share[sibling] + 0.05
        other = "a" if sibling == "c" else "c"
        assert got[other]["reached_share"] == pytest.approx(share[other], abs=0.02)


def test_mix_with_many_buckets(spark, mixed, monkeypatch):
    targets = spark.createDataFrame([("a", 0.4, 1.0), ("b", 0.3, 2.0), ("c", 0.3, 4.0)], "source string, target_share double, max_repeats double")
    one = ops.mix(mixed, targets, queries.TOKENIZER)[1].collect()
    monkeypatch.setattr(ops, "BUCKET_ROWS", 5)
    many = ops.mix(mixed, targets, queries.TOKENIZER)
    assert all(abs(x["used_tokens"] - y["used_tokens"]) <= 120 for x, y in zip(sorted(one), sorted(many[1].collect())))
    assert many[0].count() == many[0].select("doc_id").distinct().count()


def test_mix_shortage_and_empty(spark, mixed):
    targets = spark.createDataFrame([("a", 0.5, 1.0), ("d", 0.5, 2.0)], "source string, target_share double, max_repeats double")
    mix, shares = ops.mix(mixed, targets, queries.TOKENIZER, total_tokens=15_000, domains={"a": "x", "d": "x"})
    s = {r["source"]: r for r in shares.collect()}
    assert s["d"]["used_tokens"] == 2 * s["d"]["source_tokens"] and s["d"]["most_uses"] == 2
    assert abs(s["a"]["used_tokens"] + s["d"]["used_tokens"] - 15_000) < 200
    empty, none = ops.mix(mixed.limit(0), targets, queries.TOKENIZER)
    assert empty.count() == 0 and all(r["used_tokens"] == 0 for r in none.collect())


def test_personal_details(spark):
    docs = spark.createDataFrame([(1, "Write to a@b.example now", "k"), (2, None, "k"), (3, "", "k"), (4, "nothing", "k")], "doc_id bigint, text string, kind string")
    names = spark.createDataFrame([("Ann", "given"), (None, "given"), ("Lee", None)], "name_part string, part_kind string")
    assert rows(ops.personal_details(docs, names)) == {(1, "email", 9, 20)}
    red = {r["doc_id"]: r["redacted_text"] for r in ops.redacted(docs, names).collect()}
    assert red == {1: "Write to [EMAIL] now", 2: None, 3: "", 4: "nothing"}
    assert ops.personal_details(docs.limit(0), names.limit(0)).count() == 0


def test_queries_are_registered():
    q = queries.queries()
    assert {f"p{i}_found" for i in (1, 2, 3, 4, 5, 6, 8)} | {"p7_mix"} <= set(q) and set(queries.oracle_sql()) <= set(q)
