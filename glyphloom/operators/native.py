"""Operators in plain Catalyst expressions: the parts of the analysis that need no Python at all.

Each takes DataFrames and returns one; each has the same statement in SQL in ``queries``.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphloom import policy

NGRAM = 6
#: Words in the token form of a term: lower-case ASCII letters, digits, apostrophe, hyphen.
WORDS = r"[a-z0-9'-]+"


def term_rows() -> list[tuple[str, str, str, int]]:
    """(rule, family, term, words) of every word-set term that the token form can express."""
    import re

    out = []
    for r in policy.rules().values():
        if r.kind != "word-set" or r.case_sensitive:
            continue
        for t in dict.fromkeys(r.terms):
            w = t.split(" ")
            if len(w) <= NGRAM and all(re.fullmatch(WORDS, x) for x in w):
                out.append((r.id, r.family, t, len(w)))
    return out


def phrase_places(df: DataFrame, key: list[str], text: Column, phrases: DataFrame, n: int = NGRAM) -> DataFrame:
    """(key columns, columns of ``phrases``) of every place at which a phrase (column ``gram``, at most ``n`` words) stands.

    Words meet the first words of the phrases in a broadcast join; only from those places runs of words are built,
    in the row, and joined with the phrases.  Nothing is shuffled.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), 1)
    heads = phrases.select(F.split("gram", " ")[0].alias("head")).distinct()
    at = df.select(*key, words.alias("w")).select(*key, "w", F.posexplode("w").alias("i", "head")).join(F.broadcast(heads), "head", "left_semi")
    grams = [F.when(F.size("w") - F.col("i") >= k, F.array_join(F.slice("w", F.col("i") + 1, F.lit(k)), " ")) for k in range(1, n + 1)]
    return at.select(*key, F.explode(F.array_compact(F.array(*grams))).alias("gram")).join(F.broadcast(phrases), "gram")


def term_hits(df: DataFrame, key: str, text: Column, delivery: str | None = None) -> DataFrame:
    """(key, rule_id, family, hits): word-set hits in token form, by a broadcast hash join on the n-gram.

    Where one key comes in several ``delivery`` rows of the same content it counts once.
    """
    keys = [key, delivery] if delivery else [key]
    spark = df.sparkSession
    terms = spark.createDataFrame([(r, f, t) for r, f, t, _ in term_rows()], "rule_id string, family string, gram string")
    out = phrase_places(df, keys, text, terms).groupBy(*keys, "rule_id", "family").agg(F.count("*").alias("hits"))
    return out.drop(delivery).distinct() if delivery else out


#: Emoji shown as such by default: the ranges of a property that neither engine knows, in a class that both read.
@lru_cache(maxsize=1)
def emoji_class() -> str:
    import regex

    at = [o for o in range(0x2000, 0x20000) if regex.match(r"\p{Emoji_Presentation}", chr(o))]
    starts = [o for o in at if o - 1 not in set(at)]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{next(o for o in range(a, 0x20001) if o not in set(at)) - 1:X}}}" for a in starts) + "]"


def sql_patterns() -> list[tuple[str, str, bool]]:
    """(rule, pattern, whether it is read off the ASCII view) of every pattern, in a form that Java and RE2 read alike.

    Word characters and boundaries differ between the engines beyond ASCII, so patterns of ASCII text alone see a view
    in which other characters are spaces; patterns that name other characters see the text itself.  For the presence of a match
    a look-around beside a word character is that character.
    """
    out = []
    for r in policy.rules().values():
        for p in r.patterns:
            flags = "i" if p.startswith(("(?i)", "(?im)")) else ""
            body = p.removeprefix("(?im)").removeprefix("(?i)").removeprefix("(?m)").replace(r"(?<=\w)", r"\w").replace(r"(?=\w)", r"\w").replace(r"\p{Emoji_Presentation}", emoji_class())
            ascii_ = body.isascii() and r"\x{" not in body
            out.append((r.id, f"(?m{flags}){body}", ascii_))
    return out


def pattern_documents(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(rule_id, documents): documents in which any pattern of a rule matches, in one pass over the text."""
    df = df.select(key, text.alias("raw"), ascii_view(text).alias("plain"))
    by: dict[str, list[Column]] = {}
    for r, p, ascii_ in sql_patterns():
        by.setdefault(r, []).append(F.col("plain" if ascii_ else "raw").rlike(p))
    once = df.select(key, *[reduce(lambda a, b: a | b, ps).alias(r) for r, ps in by.items()]).groupBy(key).agg(*[F.bool_or(r).alias(r) for r in by])
    wide = once.agg(*[F.count_if(F.col(r)).alias(r) for r in by])
    return wide.select(F.explode(F.create_map(*[x for r in by for x in (F.lit(r), F.col(r))])).alias("rule_id", "documents"))


def ascii_view(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7f]", " ")


def widest_spans(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans not inside the span kept before them: a running maximum of the ends, in start and longest-first order."""
    w = Window.partitionBy(*keys).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reach", F.max(end).over(w)).where(F.col("reach").isNull() | (F.col(end) > F.col("reach"))).drop("reach")


def region_kind(c: Column) -> Column:
    """One spelling of a region kind: lower snake case, CodeBlock is a fence."""
    k = F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"), "[ -]", "_"))
    return F.when(k == "code_block", "code_fence").otherwise(k)


def coverage(regions: DataFrame, flag_percent: int = 40) -> DataFrame:
    """Bytes of a document by prose and the rest, and whether the rest is ``flag_percent`` of it or more."""
    r = regions.groupBy("prep_id", "region_no").agg(F.max("byte_start").alias("s"), F.max("byte_end").alias("e"), F.max(region_kind(F.col("kind"))).alias("kind"))
    size = F.col("e") - F.col("s")
    out = r.groupBy("prep_id").agg(F.sum(size).alias("total_bytes"), F.sum(F.when(F.col("kind") == "prose", size).otherwise(0)).alias("prose_bytes"))
    return out.withColumn("flagged", ((F.col("total_bytes") - F.col("prose_bytes")) * 100 >= F.lit(flag_percent) * F.col("total_bytes")).cast("bigint"))


def headings(df: DataFrame, key: str, text: Column) -> DataFrame:
    """ATX headings by line: (key, line_no, level, title)."""
    lines = df.select(key, F.posexplode(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")).alias("line_no", "line"))
    mark = F.regexp_extract("line", r"^ {0,3}(#{1,6})[ \t]+[^\s]", 1)
    return lines.where(mark != "").select(
        key, F.col("line_no").cast("bigint").alias("line_no"), F.length(mark).cast("bigint").alias("level"),
        F.trim(F.regexp_replace(F.regexp_replace("line", r"^ {0,3}#{1,6}[ \t]+", ""), r"[ \t]+#+[ \t]*$", "")).alias("title"),
    )


def sections(h: DataFrame, key: str) -> DataFrame:
    """Section of each heading: up to the next heading of the same or a higher level, in one pass from the last heading back."""
    back = Window.partitionBy(key).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.last(F.when(F.col("level") <= v, F.col("line_no")), ignorenulls=True).over(back) for v in range(1, 7)]
    return h.select(key, "line_no", "level", "title", F.element_at(F.array(*ends), F.col("level").cast("int")).alias("end_line"))


def uniform_paragraphs(df: DataFrame, key: str, text: Column, least: int = 5, cv_percent: int = 20) -> DataFrame:
    """(key, paragraphs, words, uniform): integer test of the coefficient of variation of paragraph lengths."""
    paras = F.split(F.replace(text, F.lit("\r"), F.lit("")), r"\n[ \t]*\n")
    counts = F.filter(F.transform(paras, lambda p: F.size(F.regexp_extract_all(p, F.lit(r"([\p{L}\p{N}_]+)"), 1)).cast("bigint")), lambda n: n > 0)
    df = df.select(key, counts.alias("c"))
    zero = F.lit(0).cast("bigint")
    s, q = F.aggregate("c", zero, lambda a, x: a + x), F.aggregate("c", zero, lambda a, x: a + x * x)
    df = df.select(key, F.size("c").cast("bigint").alias("paragraphs"), s.alias("words"), q.alias("squares"))
    n, w = F.col("paragraphs"), F.col("words")
    uniform = (n >= least) & (w > 0) & (10_000 * (n * F.col("squares") - w * w) <= cv_percent * cv_percent * w * w)
    return df.select(key, "paragraphs", "words", uniform.cast("bigint").alias("uniform"))


def long_sentences(df: DataFrame, key: str, text: Column, limit: int = 45) -> DataFrame:
    """(key, sentences, long_sentences) of pieces between end marks."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.size(F.regexp_extract_all(s, F.lit(r"([^ \t\r\n]+)"), 1))), lambda n: n > 0)
    return df.select(key, parts.alias("p")).select(key, F.size("p").cast("bigint").alias("sentences"), F.size(F.filter("p", lambda n: n > limit)).cast("bigint").alias("long_sentences"))


def _shingles(toks: DataFrame, k: int) -> DataFrame:
    """(prep_id, shingle, n) of ``k`` words in a row within a segment; a null word breaks the row, duplicate token rows count once."""
    t = toks.groupBy("prep_id", "tok_no").agg(F.max("word").alias("word"), F.max("seg").alias("seg"))
    w = Window.partitionBy("prep_id").orderBy("tok_no")
    whole = (F.lead("seg", k - 1).over(w) == F.col("seg")) & (F.count("word").over(w.rowsBetween(0, k - 1)) == k)
    s = t.select("prep_id", F.when(whole, F.concat_ws(" ", *[F.lead("word", i).over(w) for i in range(k)])).alias("shingle"))
    return s.where("shingle is not null").groupBy("prep_id", "shingle").agg(F.count("*").alias("n"))


def shingle_repeats(toks: DataFrame, k: int = 8) -> DataFrame:
    """Repeated word shingles inside a document, as a set: a shuffle on (document, shingle) with partial counts, no self-join."""
    c = _shingles(toks, k)
    return c.groupBy("prep_id").agg(F.sum("n").alias("shingles"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("repeats"))


def top_repeats(toks: DataFrame, k: int = 8, top: int = 20) -> DataFrame:
    """The ``top`` most frequent repeated shingles of each document, ties by the shingle itself."""
    rank = F.row_number().over(Window.partitionBy("prep_id").orderBy(F.desc("n"), "shingle"))
    return _shingles(toks, k).where("n > 1").withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)


def source_lines(df: DataFrame, key: str, text: Column, code: DataFrame) -> DataFrame:
    """(key, lines, source_lines) outside code blocks: an interval anti-join of the lines with the blocks.

    Lines are judged where they are read; only their number, length and verdict are shuffled.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    t = F.trim(F.regexp_replace("line", r"[\t\r]", " "))
    shaped = t.rlike(r"^(#\[|#!\[|//)") | t.rlike(r"^[{}()\[\];,]+$") | (
        t.rlike(r"[{};(),\]]$") & (t.rlike(r"^(pub |pub\(crate\) |async |unsafe )?(fn|struct|enum|impl|trait|mod|use|const|static|type|let|match|extern)\b") | t.contains("::") | t.contains("->") | t.contains("=>"))
    )
    lines = lines.select(key, "n", (F.octet_length("line") + 1).alias("size"), (t != "").alias("full"), shaped.alias("shaped")).distinct()
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("s", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("bigint")).withColumn("e", F.col("s") + F.col("size"))
    blocks = code.select(F.col(key).alias("c_key"), "byte_start", "byte_end").distinct()
    out = lines.join(blocks, (F.col(key) == F.col("c_key")) & (F.col("byte_start") < F.col("e")) & (F.col("s") < F.col("byte_end")), "left_anti")
    return out.where("full").groupBy(key).agg(F.count("*").alias("lines"), F.count_if("shaped").alias("source_lines"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One delivery a key: the first received, ties by nothing else that differs (a struct minimum, no window)."""
    rest = [c for c in df.columns if c not in (key, order)]
    m = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("m"), F.count("*").alias("deliveries"))
    return m.select(key, "m.*", "deliveries")


def stance_counts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(profile, stance, rules, documents): how many rules of each stance meet how many documents."""
    from glyphloom.operators.analysis import stance_table

    by = docs.groupBy(F.coalesce("profile", F.lit("general-writing")).alias("profile")).agg(F.count("*").alias("documents"))
    s = stance_table(spark).groupBy("profile", "stance").agg(F.count("*").alias("rules"))
    return by.join(F.broadcast(s), "profile").select("profile", "stance", "rules", "documents")


def waived_regions(regions: DataFrame, waivers: DataFrame) -> DataFrame:
    """Range containment join: every region with the first waiver in order whose span of its kind holds it wholly, or null.

    A region without a kind is ``unknown``.  The waivers are broadcast up to ``BROADCAST_ROWS``, counted first, else joined by kind.
    """
    from glyphloom.operators.waivers import BROADCAST_ROWS

    if waivers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        waivers = F.broadcast(waivers)
    r = regions.select("prep_id", "region_no", "byte_start", "byte_end", F.coalesce(region_kind(F.col("kind")), F.lit("unknown")).alias("kind")).distinct()
    j = r.join(waivers, (F.col("kind") == F.col("w_kind")) & (F.col("span_start") <= F.col("byte_start")) & (F.col("span_end") >= F.col("byte_end")), "left")
    return j.groupBy("prep_id", "region_no", "kind").agg(F.min("w_ord").alias("waiver"))


def family_rate_rows(hits: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, family, findings, per_1000_words) with integer tenths."""
    from glyphloom.operators.analysis import rate

    f = hits.groupBy(key, "family").agg(F.sum("hits").alias("findings")).join(words, key)
    return f.select(key, "family", "findings", rate(F.col("findings"), F.col("words")).alias("per_1000_words"))


def verdicts(hits: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Gate of each document from its word-set hits under its own profile: stance join, relaxed tiers, bool_or."""
    from glyphloom.operators.analysis import rule_table, stance_table

    spark = hits.sparkSession
    docs = docs.select(key, "profile").distinct()
    h = hits.join(docs.select(key, F.coalesce("profile", F.lit("general-writing")).alias("profile")), key)
    h = h.join(F.broadcast(rule_table(spark).drop("family")), "rule_id").join(F.broadcast(stance_table(spark)), ["rule_id", "profile"]).where("stance <> 'off'")
    state = F.when((F.col("stance") == "relax") & (F.col("tier") == "violation"), "candidate").otherwise(F.col("tier"))
    blocking = (F.col("lifecycle") == "blocking") & ~((F.col("stance") == "relax") & (F.col("tier") == "candidate"))
    g = h.groupBy(key).agg(F.bool_or(blocking & (state == "violation")).alias("v"), F.bool_or(blocking & (state == "candidate")).alias("c"))
    out = docs.select(key).join(g, key, "left")
    return out.select(key, F.when(F.col("v"), "violations_present").when(F.col("c"), "candidates_present").otherwise("no_findings").alias("result_state"))


def swap_hits(df: DataFrame, key: str, text: Column, delivery: str) -> DataFrame:
    """(key, term, plain, hits) of words with a plainer replacement: equi-join of the n-grams with the swap table."""
    rows = [(w, p) for r in policy.rules().values() for w, p in r.swaps.items()]
    swaps = df.sparkSession.createDataFrame(rows, "gram string, plain string")
    out = phrase_places(df, [key, delivery], text, swaps).groupBy(key, delivery, "gram", "plain").agg(F.count("*").alias("hits"))
    return out.select(key, F.col("gram").alias("term"), "plain", "hits").distinct()


def density_flags(hits: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Density rules over word-set hits: a semi-join on the counted rules, a count, and integer cross-multiplication."""
    rules = policy.rules()
    out = None
    for rid in ("D001", "D004"):
        p = rules[rid].params
        n = hits.where(F.col("rule_id").isin(*p["count_rules"])).groupBy(key).agg(F.sum("hits").alias("hits")).join(words, key)
        fires = F.col("hits") >= p["threshold"]
        if not p.get("per_document"):
            fires = fires & (F.col("words") > 0) & (F.col("hits") * p["per_words"] >= F.lit(p["threshold"]) * F.col("words"))
        part = n.select(key, F.lit(rid).alias("rule_id"), "hits", fires.cast("bigint").alias("fires"))
        out = part if out is None else out.unionByName(part)
    return out


def first_headings(h: DataFrame, key: str) -> DataFrame:
    """First heading of each document and how many of its titles are stock titles."""
    stock = policy.rules()["X001"].params["heading_set"]
    return h.groupBy(key).agg(
        F.min_by("title", "line_no").alias("first_title"), F.count("*").alias("headings"), F.count_if(F.lower("title").isin(*stock)).alias("stock_titles")
    )


def oversized(df: DataFrame, key: str, words: Column, profile: Column) -> DataFrame:
    """Documents over the word cap of their profile; profiles without a cap have none."""
    caps = df.sparkSession.createDataFrame(list(policy.rules()["X003"].params["max_words"].items()), "cap_profile string, cap bigint")
    return df.select(key, words.alias("words"), profile.alias("p")).join(F.broadcast(caps), F.col("p") == F.col("cap_profile")).select(key, "words", "cap", (F.col("words") > F.col("cap")).cast("bigint").alias("over"))
