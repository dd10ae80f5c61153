"""Rule behaviour on single documents: seed pairs, generated predicates, thresholds, mutations, invariants."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphloom import policy
from glyphloom.functions.analyze import Settings, analyze_bytes, lint
from glyphloom.functions.markdown import read_markdown, read_text
from glyphloom.functions.normview import build
from glyphloom.plans.seeds import CASES


@pytest.mark.parametrize("rule,profile,text,fires", CASES)
def test_pairs(rule, profile, text, fires):
    assert (rule in lint(text, profile)) == fires


def test_package():
    rules = policy.rules()
    assert len(rules) == 93 and len({r.family for r in rules.values()}) == 22
    tiers = [r.tier for r in rules.values()]
    assert (tiers.count("violation"), tiers.count("candidate"), tiers.count("coverage_hint")) == (22, 64, 7)
    kinds = [r.kind for r in rules.values()]
    assert (kinds.count("word-set"), kinds.count("regex-set"), kinds.count("structural"), kinds.count("ratio")) == (42, 19, 24, 8)
    assert len(policy.stance_rows()) == 651 and len(policy.digest()) == 64
    assert "A001" in policy.snapshot() and '"M005"' in policy.show()
    with pytest.raises(ValueError):
        policy.check_bounded("X", r"a+b")


@pytest.mark.parametrize("rule", [r.id for r in policy.rules().values() if r.kind == "word-set"])
def test_first_term_fires_in_prose_and_not_in_a_fence(rule):
    r = policy.rules()[rule]
    term = next(t for t in r.terms if not any(t in x for x in r.exempt))
    text = f"[x](http://a.b/?{term})" if r.scope == "link-url" else f"{term} appears in prose here.\n"
    for profile in policy.PROFILES:
        assert (rule in lint(text, profile)) == (r.stance(profile) != "off")
        if rule != "J001":
            assert rule not in lint(f"```\n{text}\n```\n", profile)


def test_density_thresholds():
    filler = "word " * 490
    assert "D001" in lint(filler + "delve delve delve", "general-writing")
    assert "D001" not in lint(filler + "delve delve", "general-writing")
    assert "X003" in lint("word " * 401, "comment") and "X003" not in lint("word " * 400, "comment")
    assert "X003" in lint("word " * 601, "email") and "X003" not in lint("word " * 600, "email")
    links = "- [a](http://b.c)\n"
    assert "D002" in lint(links * 8, "doc") and "D002" not in lint(links * 7, "doc")
    assert "D003" in lint("\n\n".join(["one two three four"] * 5), "doc")


def test_duplication():
    para = "the quick brown fox jumps over the lazy dog near a quiet river bank today"
    twice = f"{para}.\n\nSomething else here.\n\n{para}."
    hits = [h for h in analyze_bytes(twice.encode(), "general-writing")["hits"] if h["rule_id"] == "U001"]
    assert len(hits) == 1 and hits[0]["start"] > len(para)
    assert lint(f"{para}.\n\na b c.\n\n{para}.\n\nd e f.\n\n{para}.").count("U001") == 2
    nine = " ".join(para.split()[:9])
    assert "U001" not in lint(f"{nine}.\n\nother words.\n\n{nine}.")
    assert "U001" not in lint(f"{para}.\n\n> {para}.")
    stamped = "\n\n".join(f"{para} number{i}" for i in range(27))
    assert lint(stamped).count("U001") == 20


@pytest.mark.parametrize("text", ["We del&#118;e in.", "We del​ve in.", "We del­ve in.", "We **del**ve in.", "We dеlve in.", "We ｄｅｌｖｅ in.", "A game\nchanger came."])
def test_spellings(text):
    assert "A001" in lint(text, "doc")


def test_foreign_words_stay():
    assert lint("Мы живём в городе давно.", "doc") == [] and "A001" not in lint("café naïve", "doc")


def test_anomalies():
    assert "M005" in lint("```\ncode", "doc") and "M005" not in lint("```\ncode\n```\n", "doc")
    assert "M005" in lint("text &#8203; more", "doc") and "M005" in lint("<div><!-- open", "doc")
    assert "Y001" in lint("<script>\nx()\n</script>\n", "doc")
    assert "Y001" in lint('[a]: http://b.c "words"\n', "doc") and "Y002" in lint("[a]: http://b.c\n", "doc")
    assert "Y002" not in lint("See [a].\n\n[a]: http://b.c\n", "doc")
    assert "P004" in lint("[x](http://a.b/?utm_source=chatgpt.com)", "doc") and "P002" in lint("It says turn1news4 here.", "doc")
    assert "P003" in lint("As shown【3】here.", "doc") and "P003" not in lint("本文【三】です", "doc")


def test_quoting_and_guard():
    row = analyze_bytes(b"> We delve into this.\n", "doc")
    assert [h["quoted"] for h in row["hits"] if h["rule_id"] == "A001"] == [True]
    source = "use std::fmt;\n" + "fn main() {\n    let x = 1;\n}\n" * 4
    assert analyze_bytes(source.encode(), "doc")["status"] == "unsupported_input"
    assert analyze_bytes(("use std::fmt;\n" * 7).encode(), "doc")["status"] == "ok"
    assert analyze_bytes(b"\xff", "doc")["error"].endswith("byte 0")
    assert analyze_bytes(b"a" * 50, "doc", settings=Settings(max_bytes=10))["status"] == "unsupported_input"
    assert analyze_bytes(b"\xef\xbb\xbfa", "doc")["bom_stripped"] and analyze_bytes(b"a\r\nb\nc", "doc")["mixed_line_endings"]
    assert analyze_bytes(b"", "doc")["hits"] == []


def test_long_repeats_in_other_scripts_carry_their_trigger():
    text = "Олувел: портовая служба копирует рецепт без задержки, № 435 (7,4 km). " * 6
    row = analyze_bytes(text.encode(), "doc", "text")
    assert row["status"] == "ok" and "U001" in [h["rule_id"] for h in row["hits"]]


def test_license_section():
    text = b"# Tool\n\nWords.\n\n## License\n\nPublic domain.\n"
    ids = lambda **k: [h["rule_id"] for h in analyze_bytes(text, "doc", settings=Settings(**k))["hits"]]
    assert "K005" in ids() and "K005" in ids(license_wording="MIT") and "K005" not in ids(license_wording="Public  domain.")


def test_reading():
    d = read_markdown("# A *b*\n\npara `x` <https://a.b>\n\n> q\n\n1. one\n2. two\n\n| a | b |\n|---|---|\n| c | d |\n")
    assert d.headings[0].text == "A b" and d.bullets == 2 and len(d.links) == 1
    assert build(d).text.split("\n")[0] == "A b"
    t = read_text("- [a](b) c\n\nplain line\n")
    assert (t.bullets, t.linked_bullets, t.paragraph_words) == (1, 1, [3, 2])
    kinds = {k for _, _, k in d.regions}
    assert kinds >= {"prose", "structure", "inline_code", "autolink"}


def _invariants(text: str, fmt: str) -> None:
    raw = text.encode()
    row = analyze_bytes(raw, "doc", fmt)
    assert row == analyze_bytes(raw, "doc", fmt)
    if row["status"] != "ok":
        return
    body = raw[3:] if row["bom_stripped"] else raw
    at = 0
    for s in row["segments"]:
        assert s["start"] == at and s["end"] > s["start"]
        body[s["start"] : s["end"]].decode()
        at = s["end"]
    assert at == len(body)
    for h in row["hits"]:
        assert 0 <= h["start"] <= h["end"] <= len(body)
        assert body[h["start"] : h["end"]].decode().startswith(h["snippet"][:50])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_any_text(text):
    _invariants(text, "text")
    _invariants(text, "markdown")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["# ", "- ", "1. ", "> ", "```\n", "~~~", "*", "**", "_", "`", "[a](b)", "[a]", "]: x\n", "![", "<div>", "</div>", "<!--", "-->", "<b>", "&amp;", "&#8203;", "\\", "|", "---\n", "===\n", "\n", "\n\n", "    ", "\t", "delve ", "word ", "é", "е", "​", "[^n]", "<http://a.b>", "\r\n", "; ", ", not x. "]), max_size=40))
def test_any_markup(parts):
    _invariants("".join(parts), "markdown")


@pytest.mark.parametrize("text", [t for _, _, t, _ in CASES] + ["We d&#101;lve — in <b>del</b>ve.", "> a very\n> good game\n> changer", "ﬁne dеlve ½ &mdash; x"])
def test_every_slice_carries_its_trigger(text):
    from glyphloom.functions.analyze import find_hits
    from glyphloom.functions.fidelity import carries

    doc = read_markdown(text)
    norm = build(doc)
    for profile in policy.PROFILES:
        assert all(carries(doc, norm, h) for h in find_hits(doc, norm, profile))


SIZE = 2 * 1024 * 1024 - 64
FULL = lambda unit: unit.encode() * (SIZE // len(unit.encode()))
LONG = [
    # (content, profile, seconds, status): whole inputs near the size limit within 30 s, runs that tempt a pattern within 2 s
    (FULL("a\u200b"), "general-writing", 30, "instrumentation_error"),
    (FULL("d\u0435lve "), "general-writing", 30, "instrumentation_error"),
    (b"delve " * 9000 + FULL("&amp;")[: SIZE - 54_000], "general-writing", 30, "ok"),
    (FULL("\u0435"), "general-writing", 30, "ok"),
    (("\u0435" * 16_384 + "a" + "\u0435" * 16_383).encode(), "general-writing", 30, "ok"),
    (b"the same nine word phrase again and again here. " * 37_000, "general-writing", 60, "ok"),
    (b"turn1news" + b"5" * 262_144, "doc", 2, "ok"),
    (b"The catch?" + b" " * 262_144, "general-writing", 2, "ok"),
]


@pytest.mark.parametrize("case", range(len(LONG)))
def test_long_inputs_end_in_time(case):
    raw, profile, seconds, status = LONG[case]
    analyze_bytes(b"warm", profile)
    began = time.time()
    assert analyze_bytes(raw, profile)["status"] == status and time.time() - began < seconds


@pytest.mark.parametrize("unit", ["[", "*a ", "> ", "<div ", "&#8203;", "- ", "`", "| a ", "<!-- ", "[a](", "\\", "# ", "1. ", "a, not b ", "x: y ", "from a to b ", "# a\n", "[a]: b\n", "```\n", "the vantage of ", "was made by the ", "**a** "])
def test_long_markup_ends_in_time(unit):
    began = time.time()
    assert analyze_bytes(FULL(unit)[:262_144], "doc")["status"] in ("ok", "instrumentation_error") and time.time() - began < 30


@pytest.mark.parametrize("text", ["the same nine word phrase again and again here. " * 37_000, " ".join(f"w{i}" for i in range(250_000))])
def test_repeats_take_little_memory(text):
    import tracemalloc

    from glyphloom.functions.normview import NormView
    from glyphloom.functions.repeats import Repeats

    view = NormView(text)
    tracemalloc.start()
    Repeats(view, 8, 10).longest(20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 1024 * 1024


def test_repeats_against_brute_force():
    import random

    from glyphloom.functions.normview import NormView
    from glyphloom.functions.repeats import Repeats

    rnd = random.Random(2)
    for _ in range(300):
        words = [rnd.choice("abc") for _ in range(rnd.randrange(0, 60))]
        runs = Repeats(NormView(" ".join(words)), 4, 5).runs()
        end = 0
        for x, y, n in runs:
            # equal, apart, long enough, maximal to the right, and the later copies follow one another
            assert words[x : x + n] == words[y : y + n] and x + n <= y and n >= 5 and y >= end - n
            assert y + n == len(words) or x + n == y or words[x + n] != words[y + n]
            end = y + n
        # a long repeat is never missed
        text = " ".join(words)
        if not runs:
            assert not any(words[i : i + 5] == words[j : j + 5] for i in range(len(words) - 4) for j in range(i + 5, len(words) - 4)), text
