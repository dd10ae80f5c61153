"""DataFrame operators of the eight training-data problems.

Texts stay on the scan side: parsing runs in Arrow batches next to the scan and only
narrow results (spans, keys, measures) are shuffled.  The one exception is named where it stands: beyond
the bound of its broadcast index, problem 6 fetches the texts of candidate documents (``joined_leaks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphloom.llm import leakage, mixing, pii, readability, textforms
from glyphloom.llm.markup import convert
from glyphloom.llm.repetition import RUN, measures, repeated_share, spaced
from glyphloom.llm.sentences import view_sentences
from glyphloom.plans.session import cut, spread

Batches = Iterator[pa.RecordBatch]


def _rows(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _map(df: DataFrame, names: list[str], ddl: str, schema: pa.Schema, each) -> DataFrame:
    """Runs ``each(values) -> list of output rows`` for every row, a batch at a time."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            out = [r for v in _rows(b, *names) for r in each(*v)]
            if out:
                yield _batch(schema, [list(c) for c in zip(*out, strict=True)])

    return spread(df, names).mapInArrow(run, ddl)


# ---------------------------------------------------------------- 1 markup

CLEAN_DDL = "prep_id bigint, clean_text string, kinds array<string>, elements array<struct<kind:string,info:string>>, content_share double"
_ELEMENT = pa.struct([("kind", pa.string()), ("info", pa.string())])
_KINDS = pa.schema([("prep_id", pa.int64()), ("kinds", pa.list_(pa.string()))])
_CLEAN = pa.schema([("prep_id", pa.int64()), ("clean_text", pa.string()), ("kinds", pa.list_(pa.string())), ("elements", pa.list_(_ELEMENT)), ("content_share", pa.float64())])


def clean_markup(prepared: DataFrame) -> DataFrame:
    """Clean text with structure marks of every prepared row: prep_id, clean_text, kinds, elements, content_share."""

    def each(prep_id, text):
        c = convert(text)
        yield prep_id, c.text, sorted(c.kinds), [{"kind": k, "info": i} for k, i in c.elements], c.content_share

    return _map(prepared, ["prep_id", "text"], CLEAN_DDL, _CLEAN, each)


def markup_kinds(prepared: DataFrame) -> DataFrame:
    """(prep_id, element_kind), distinct.  Redelivered rows fold together in the map-side part of the aggregation."""

    def each(prep_id, text):
        kinds = convert(text).kinds
        if kinds:
            yield prep_id, sorted(kinds)

    found = _map(prepared, ["prep_id", "text"], "prep_id bigint, kinds array<string>", _KINDS, each)
    return found.select("prep_id", F.explode("kinds").alias("element_kind")).distinct()


# ---------------------------------------------------------------- 2 repetition

REP_DDL = "prep_id bigint, origin string, spaced boolean, n_words bigint, repeated_share double, written_share double, sentence_share double, bigram_share double, line_share double"
_REP = pa.schema([
    ("prep_id", pa.int64()), ("origin", pa.string()), ("spaced", pa.bool_()), ("n_words", pa.int64()), ("repeated_share", pa.float64()), ("written_share", pa.float64()),
    ("sentence_share", pa.float64()), ("bigram_share", pa.float64()), ("line_share", pa.float64()),
])
#: Failing limits of the rules, each a share of the document's content.
RULES = {"repeated_share": 0.35, "sentence_share": 0.30, "bigram_share": 0.20, "line_share": 0.30}
#: Hosts up to this many are broadcast; beyond it they are joined over ``HOST_SALTS`` salted copies, so that no host is a hot key.
MAX_BROADCAST_HOSTS = 1_000_000
HOST_SALTS = 16


def repetition(prepared: DataFrame) -> DataFrame:
    """Measures of every document, the verdict of its host joined back, and the verdict on the document.

    Rule failures are summed by ``origin`` (map-side first, so a hot origin is a few rows a
    task); rates are shrunk by a beta prior whose mean and strength come from the rates of
    all hosts (method of moments).  A null origin is no host: it takes the prior mean and the verdict ``unknown``.

    What a word is has two readings (letter runs, or what stands between spaces).  Where the repeated share reaches
    the limit under both, the document is repetitive; where it does so under one only, the verdict of its host
    decides, and for an unknown host the share of letter runs.  Null and empty texts have no words and are never repetitive.
    """

    def each(prep_id, origin, text):
        n, share, other, sent, top, lines = measures(text)
        yield prep_id, origin, bool(text) and spaced(text), n, share, other, sent, top, lines

    docs = _map(prepared, ["prep_id", "origin", "text"], REP_DDL, _REP, each)
    rest = [c for c in docs.columns if c != "prep_id"]
    docs = docs.groupBy("prep_id").agg(*(F.max(c).alias(c) for c in rest))
    failed = sum((F.col(c) >= v).cast("int") for c, v in RULES.items())
    docs = cut(docs.withColumn("failures", failed))
    hosts, prior = host_verdicts(docs)
    out = join_hosts(docs, hosts).withColumn("host_verdict", F.coalesce("host_verdict", F.lit("unknown")))
    limit = RULES["repeated_share"]
    one, other = F.col("repeated_share") >= limit, F.col("written_share") >= limit
    judged = F.when(F.col("host_verdict") == "suspect", one | other).when(F.col("host_verdict") == "ordinary", one & other).otherwise(one)
    return out.select(
        "prep_id", "origin", "spaced", "n_words", "repeated_share", "written_share", *list(RULES)[1:], "failures", (F.col("spaced") & judged).alias("is_repetitive"),
        F.coalesce("host_docs", F.lit(0)).alias("host_docs"), F.coalesce("host_rate", F.lit(prior)).alias("host_rate"), "host_verdict",
    )


def join_hosts(docs: DataFrame, hosts: DataFrame) -> DataFrame:
    """Documents with the row of their host, if any: broadcast up to a counted bound, else an equi-join on host and salt."""
    if hosts.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS:
        return docs.join(F.broadcast(hosts), "origin", "left")
    copies = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("prep_id"), F.lit(HOST_SALTS)).cast("int")).join(copies, ["origin", "salt"], "left").drop("salt")


def host_verdicts(docs: DataFrame, suspect: float = 0.25) -> tuple[DataFrame, float]:
    """Shrunk failure rate and verdict of every origin, and the prior mean: (fails + m k) / (docs + k).

    The prior's mean m and strength k (method of moments) are one aggregated row on the driver.
    """
    by = docs.where("origin is not null").groupBy("origin").agg(
        F.count("*").alias("host_docs"), F.sum((F.col("failures") > 0).cast("bigint")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    row = by.agg((F.sum("host_failed") / F.sum("host_docs")).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("u")).first()
    m = float(row["m"] or 0.0)
    # between-host variance: the observed one less the binomial noise of small hosts
    v = max(float(row["v"] or 0.0) - m * (1 - m) * float(row["u"] or 0.0), 1e-4)
    k = min(max(m * (1 - m) / v - 1, 1.0), 1000.0)
    shrunk = (F.col("host_failed") + F.lit(m * k)) / (F.col("host_docs") + F.lit(k))
    verdict = F.when(shrunk >= max(suspect, 2 * m), "suspect").otherwise("ordinary")
    return by.select("origin", "host_docs", "host_failed", shrunk.alias("host_rate"), verdict.alias("host_verdict")), m


def token_repetition(toks: DataFrame, run: int = RUN) -> DataFrame:
    """Share of a view's tokens in runs of ``run`` or more words that occurred before, from the token table alone.

    The tokens of each view are gathered, in order, into one array and read in Python, so a view
    must fit the memory of one task; no window or join over n-grams is built.
    Null words break a run; duplicate rows count once.
    """
    t = toks.where("prep_id is not null and tok_no is not null").groupBy("prep_id", "tok_no").agg(F.max("word").alias("word"))
    packed = t.groupBy("prep_id").agg(F.array_sort(F.collect_list(F.struct("tok_no", "word"))).alias("toks"))
    schema = pa.schema([("prep_id", pa.int64()), ("n_words", pa.int64()), ("repeated_words", pa.int64())])

    def run_(batches: Batches) -> Batches:
        from glyphloom.llm.repetition import covered_mask

        for b in batches:
            out = []
            for prep_id, items in _rows(b, "prep_id", "toks"):
                words = [x["word"] if x["word"] is not None else f"\x00{i}" for i, x in enumerate(items)]
                out.append((prep_id, len(words), int(covered_mask(words, run).sum())))
            if out:
                yield _batch(schema, [list(c) for c in zip(*out, strict=True)])

    return packed.mapInArrow(run_, "prep_id bigint, n_words bigint, repeated_words bigint")


# ---------------------------------------------------------------- 3 reading level


def _level_rows(prepared: DataFrame) -> DataFrame:
    lang = F.lower(F.trim(F.col("lang")))
    return prepared.where(lang.isNull() | lang.isin("en", "eng", "english") | lang.startswith("en-") | (lang == "")).select(
        "prep_id", (lang.isNotNull() & (lang != "")).alias("declared"), "text"
    )


def word_counts(prepared: DataFrame) -> tuple[np.ndarray, float]:
    """Hashed word counts of all English rows: at most ``RARITY_BUCKETS`` counters reach the driver, whatever the corpus."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Batches) -> Batches:
        counts = np.zeros(readability.RARITY_BUCKETS, dtype=np.int64)
        cache: dict[str, int] = {}
        for b in batches:
            for declared, text in _rows(b, "declared", "text"):
                if not text:
                    continue
                folded = textforms.fold(text)
                if not declared and not readability.english(folded):
                    continue
                for w in readability.tokens(folded):
                    k = cache.get(w)
                    if k is None:
                        if len(cache) > 200_000:
                            cache.clear()
                        k = cache[w] = readability.bucket(w)
                    counts[k] += 1
        at = np.flatnonzero(counts)
        yield _batch(schema, [at.tolist(), counts[at].tolist()])

    rows = spread(_level_rows(prepared)).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(readability.RARITY_BUCKETS)
    for r in rows.collect():
        counts[r["bucket"]] = r["n"]
    return counts, float(counts.sum())


def fit_levels(prepared: DataFrame, labels: DataFrame, counts: np.ndarray, total: float, max_labels: int = readability.MAX_LABELS):
    """Fits the ordinal model on at most ``max_labels`` labelled rows (the bound of the training sample, by label hash)."""
    band = F.lower(F.trim("band"))
    rows = (
        labels.where(band.isin(*readability.BANDS) & F.col("prep_id").isNotNull())
        .select("prep_id", band.alias("band"), F.xxhash64("label_id").alias("h")).orderBy("h").limit(max_labels).collect()
    )
    if not rows:
        return None
    marks: dict[int, list[int]] = {}
    for r in rows:
        marks.setdefault(r["prep_id"], []).append(readability.BANDS.index(r["band"]))
    wanted = prepared.sparkSession.createDataFrame([(k,) for k in marks], "prep_id bigint")
    schema = pa.schema([("prep_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    shared = prepared.sparkSession.sparkContext.broadcast((counts, total))

    def each(prep_id, text):
        if text:
            yield prep_id, readability.features(textforms.fold(text), *shared.value).tolist()

    labelled = _level_rows(prepared).join(F.broadcast(wanted), "prep_id", "left_semi")
    got = {r["prep_id"]: r["x"] for r in _map(labelled, ["prep_id", "text"], "prep_id bigint, x array<double>", schema, each).collect()}
    x, y = [], []
    for k, bands in marks.items():
        if k in got:
            for b in bands:
                x.append(got[k])
                y.append(b)
    if len(set(y)) < 2:
        return None
    order = np.lexsort((y, *np.array(x).T))
    return readability.OrdinalModel().fit(np.array(x)[order], np.array(y)[order])


def reading_levels(prepared: DataFrame, labels: DataFrame, min_words: int = readability.MIN_WORDS, clean_only: bool = False) -> DataFrame:
    """(prep_id, band, score, n_words, has_markup, is_repetitive) of every English document of at least ``min_words`` words.

    Without a usable label the band is null (no model can be fitted).  ``clean_only`` leaves out
    documents with markup or repetition before their features are computed.
    """
    counts, total = word_counts(prepared)
    model = fit_levels(prepared, labels, counts, total)
    shared = prepared.sparkSession.sparkContext.broadcast((counts, total, model))
    schema = pa.schema([("prep_id", pa.int64()), ("band", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("has_markup", pa.bool_()), ("is_repetitive", pa.bool_())])

    def each(prep_id, declared, text):
        if not text:
            return
        folded = textforms.fold(text)
        n = len(folded.split())
        if n < min_words or not declared and not readability.english(folded):
            return
        markup = bool(convert(text).kinds)
        repetitive = not (clean_only and markup) and repeated_share(text) >= RULES["repeated_share"]
        if clean_only and (markup or repetitive):
            return
        counts, total, model = shared.value
        band = score = None
        if model is not None:
            x = readability.features(folded, counts, total)
            score = float(model.score(x)[0])
            band = readability.BANDS[int((score > model.cut).sum())]
        yield prep_id, band, score, n, markup, repetitive

    out = _map(_level_rows(prepared), ["prep_id", "declared", "text"], "prep_id bigint, band string, score double, n_words bigint, has_markup boolean, is_repetitive boolean", schema, each)
    rest = [c for c in out.columns if c != "prep_id"]
    return out.groupBy("prep_id").agg(*(F.first(c).alias(c) for c in rest))


# ---------------------------------------------------------------- 4 sentences

_SPAN = pa.struct([("byte_start", pa.int64()), ("byte_end", pa.int64())])
_SPANS = pa.schema([("prep_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def sentence_spans(views: DataFrame) -> DataFrame:
    """(prep_id, byte_start, byte_end) of every sentence of every distinct view; copies of a view fold in the map-side part."""

    def each(prep_id, text, starts):
        spans = view_sentences(text, starts)
        if spans:
            yield prep_id, [{"byte_start": a, "byte_end": b} for a, b in spans]

    rows = _map(views, ["prep_id", "norm_text", "block_starts"], "prep_id bigint, spans array<struct<byte_start:bigint,byte_end:bigint>>", _SPANS, each)
    merged = rows.groupBy("prep_id").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))
    return merged.select("prep_id", F.inline("spans"))


# ---------------------------------------------------------------- 5 look-alikes


def look_keys(df: DataFrame, column: str, keep_text: bool = False, passing: tuple[str, ...] = ()) -> DataFrame:
    """(prep_id[, passing columns, canonical_text, skeleton], raw_key, look_key), a row a row, by SQL that DuckDB runs inside the Arrow batches.

    A null text has no form and gives no row; an empty one keeps an empty form.
    """
    texts = "canonical_text string, skeleton string, " if keep_text else ""
    along = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in passing)
    rows = spread(df.where(F.col(column).isNotNull()).select("prep_id", *passing, F.col(column).alias("text")))
    return rows.mapInArrow(lambda b: textforms.key_batches(b, keep_text, passing), f"prep_id bigint, {along}{texts}raw_key string, look_key string")


def canonical_texts(prepared: DataFrame) -> DataFrame:
    """(prep_id, received_us, canonical_text, skeleton, look_key) of every delivered row; no text is exchanged."""
    rows = prepared.withColumn("received_us", F.unix_micros("received_at"))
    return look_keys(rows, "text", keep_text=True, passing=("received_us",)).drop("raw_key")


def look_members(prepared: DataFrame, views: DataFrame) -> DataFrame:
    """(field_name, prep_id, raw_key, look_key), distinct, over both fields."""
    a = look_keys(prepared, "text").withColumn("field_name", F.lit("prepared_text"))
    b = look_keys(views, "norm_text").withColumn("field_name", F.lit("norm_text"))
    return a.unionByName(b).distinct()


def look_alike_pairs(prepared: DataFrame, views: DataFrame) -> DataFrame:
    """Pairs of documents whose texts look the same but differ as strings.

    Only keys with at least two different strings go on; the self-join is an equi-join on the
    look key with the inequality of the strings as its residual, so copies of one string never
    meet each other.
    """
    m = cut(look_members(prepared, views))
    keys = m.groupBy("field_name", "look_key").agg(F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi")).where("lo <> hi").select("field_name", "look_key")
    rows = m.join(keys, ["field_name", "look_key"], "left_semi")
    a = rows.select("field_name", "look_key", F.col("prep_id").alias("prep_id_a"), F.col("raw_key").alias("raw_a"))
    b = rows.select("field_name", "look_key", F.col("prep_id").alias("prep_id_b"), F.col("raw_key").alias("raw_b"))
    pairs = a.join(b, ["field_name", "look_key"]).where("prep_id_a < prep_id_b and raw_a <> raw_b")
    return pairs.select("field_name", "prep_id_a", "prep_id_b").distinct()


def look_classes(prepared: DataFrame, views: DataFrame) -> DataFrame:
    """One row a field and document: its class (smallest prep_id of the same look), the class size and the number of spellings.

    Classes are aggregated map-side first; members meet the one row of their class in an equi-join, whose hot
    looks AQE splits on the members' side.
    """
    m = cut(look_members(prepared, views))
    by = m.groupBy("field_name", "look_key").agg(F.min("prep_id").alias("class_id"), F.count_distinct("prep_id").alias("n_documents"), F.count_distinct("raw_key").alias("n_spellings"))
    return m.join(by, ["field_name", "look_key"]).select("field_name", "prep_id", "class_id", "n_documents", "n_spellings").distinct()


def look_links(prepared: DataFrame, views: DataFrame) -> DataFrame:
    """(field_name, class_id, spelling_id, n_documents): one row a spelling of every class with several.

    ``spelling_id`` is the smallest prep_id that is spelled so, ``class_id`` the smallest of the class; together with the
    members' own classes these pairs of representatives carry every link, whatever the number of copies.
    """
    one = look_members(prepared, views).groupBy("field_name", "look_key", "raw_key").agg(F.min("prep_id").alias("spelling_id"), F.count("*").alias("n_documents"))
    spellings = F.array_sort(F.collect_list(F.struct("spelling_id", "n_documents")))
    classes = one.groupBy("field_name", "look_key").agg(F.min("spelling_id").alias("class_id"), F.count("*").alias("k"), spellings.alias("s")).where("k > 1")
    return classes.select("field_name", "class_id", F.inline("s"))


# ---------------------------------------------------------------- 6 leakage

#: Item words up to which one index is broadcast (some 100 MB in a worker); beyond it n-grams of items and documents meet in a join.
MAX_INDEX_WORDS = 200_000
#: Salts of the candidates of one document beyond the bound.
CANDIDATE_SALTS = 16
_LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_words", pa.int64()), ("item_words", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
LEAK_DDL = "doc_id bigint, item_id bigint, matched_words bigint, item_words bigint, first_word bigint, last_word bigint"
_GRAM = pa.schema([("id", pa.int64()), ("gram", pa.int64())])


def usable_items(items: DataFrame) -> DataFrame:
    return items.where("item_id is not null and text is not null").select("item_id", "text")


def item_index(items: DataFrame):
    """The broadcast index of the items, or None where their words, counted first, are more than ``MAX_INDEX_WORDS``."""
    rows = usable_items(items)
    total = rows.agg(F.sum(F.greatest(F.size(F.split("text", r"\s+")), F.length("text") / 8))).first()[0] or 0
    if total > MAX_INDEX_WORDS:
        return None
    return items.sparkSession.sparkContext.broadcast(leakage.build_index([(r["item_id"], r["text"]) for r in rows.collect()]))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched_words, item_words, first_word, last_word) of every leaked passage.

    Null or empty documents and items leak nothing.  Items within the bound are a broadcast hash set that one scan of the
    documents looks up; more items are found by ``joined_leaks``, with the same rows.
    """
    shared = item_index(items)
    if shared is None:
        return joined_leaks(documents, items)

    def each(doc_id, text):
        for item_id, matched, n, a, b in leakage.leaks(text, shared.value):
            yield doc_id, item_id, matched, n, a, b

    return _map(documents, ["doc_id", "text"], LEAK_DDL, _LEAK, each)


def joined_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same for any number of items, without a broadcast: hashed n-grams of documents and items meet in a join.

    Documents and items that share an n-gram are candidates, folded to distinct pairs before any text is fetched.  A
    document goes out with its candidate items in ``CANDIDATE_SALTS`` salted groups and is verified as in the scan.
    """
    rows = usable_items(items)
    sizes = _map(rows, ["text"], "n int", pa.schema([("n", pa.int32())]), lambda t: [(leakage.run_length(len(w)),)] if (w := leakage.leak_words(t)) else [])
    lengths = sorted(r["n"] for r in sizes.distinct().collect())  # a few small numbers, whatever the items

    def own(item_id, text):
        w = leakage.leak_words(text)
        if w:
            n = leakage.run_length(len(w))
            yield from {(item_id, leakage.gram_key(w[i : i + n])) for i in range(len(w) - n + 1)}

    def all_(doc_id, text):
        w = leakage.leak_words(text)
        yield from {(doc_id, leakage.gram_key(w[i : i + n])) for n in lengths for i in range(len(w) - n + 1)}

    ddl = "id bigint, gram bigint"
    of_items = _map(rows, ["item_id", "text"], ddl, _GRAM, own).select(F.col("id").alias("item_id"), "gram")
    of_docs = _map(documents.where("doc_id is not null"), ["doc_id", "text"], ddl, _GRAM, all_).select(F.col("id").alias("doc_id"), "gram")
    pairs = of_docs.join(of_items, "gram").select("doc_id", "item_id").distinct()
    salt = F.pmod(F.xxhash64("item_id"), F.lit(CANDIDATE_SALTS))
    groups = pairs.join(rows.withColumnRenamed("text", "item_text"), "item_id").groupBy("doc_id", salt.alias("salt")).agg(F.collect_list(F.struct("item_id", "item_text")).alias("found"))
    # two contents under one id are two rows here, each verified against the candidates of both
    ready = documents.select("doc_id", "text").join(groups, "doc_id")

    def each(doc_id, text, found):
        index = leakage.build_index([(x["item_id"], x["item_text"]) for x in found])
        for item_id, matched, n, a, b in leakage.leaks(text, index):
            yield doc_id, item_id, matched, n, a, b

    return _map(ready, ["doc_id", "text", "found"], LEAK_DDL, _LEAK, each)


def decontaminated(documents: DataFrame, items: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """One row a document: leaked spans removed, or the text null where they are more than ``drop_share`` of its words.

    Within the bound of the index the document is scanned and cut in one pass, so no text is shuffled; beyond it the
    spans of ``joined_leaks`` are joined back.  A null text stays null and is kept.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("item_ids", pa.list_(pa.int64())), ("action", pa.string())])
    ddl = "doc_id bigint, text string, item_ids array<bigint>, action string"

    def cut_out(doc_id, text, found):
        if not found or text is None:
            return doc_id, text, None, "kept"
        ids = sorted({x[0] for x in found})
        gone = {i for x in found for i in range(x[3], x[4])}
        pieces = leakage.pieces(text)
        if len(gone) > drop_share * sum(n for n, _ in pieces):
            return doc_id, None, ids, "removed"
        at, kept = 0, []
        for n, piece in pieces:
            if not (n and gone.issuperset(range(at, at + n))):
                kept.append(piece)
            at += n
        return doc_id, "".join(kept).strip(), ids, "cut"

    shared = item_index(items)
    if shared is not None:
        return _map(documents, ["doc_id", "text"], ddl, schema, lambda i, t: [cut_out(i, t, leakage.leaks(t, shared.value))])
    spans = joined_leaks(documents, items).groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "matched_words", "item_words", "first_word", "last_word")).alias("found"))
    ready = documents.select("doc_id", "text").join(spans, "doc_id", "left")
    return _map(ready, ["doc_id", "text", "found"], ddl, schema, lambda i, t, f: [cut_out(i, t, [tuple(x.values()) for x in f or ()])])


# ---------------------------------------------------------------- 7 mixing


def token_sizes(documents: DataFrame, tokenizer: str, pattern: str = mixing.SPLIT_PATTERN) -> DataFrame:
    """(doc_id, source, lang, n_tokens) with even source and language codes; a null or empty text has no tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_tokens", pa.int64())])

    def run(batches: Batches) -> Batches:
        enc = mixing.encoder(tokenizer, pattern)
        for b in batches:
            ids, source, lang, texts = (b.column(i).to_pylist() for i in range(4))
            yield _batch(schema, [ids, source, lang, [len(enc.encode_ordinary(t)) if t else 0 for t in texts]])

    even = documents.select(
        "doc_id", F.lower(F.trim("source")).alias("source"),
        F.coalesce(F.substring(F.regexp_replace(F.lower("lang"), "[^a-z]", ""), 1, 2), F.lit("")).alias("lang"), "text",
    )
    return spread(even).mapInArrow(run, "doc_id bigint, source string, lang string, n_tokens bigint")


#: Records that one hash bucket of an epoch's order holds on average; only the bucket at a leaf's edge is sorted row by row.
BUCKET_ROWS = 20_000


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str, total_tokens: float | None = None, seed: int = 17, domains: dict[str, str] | None = None, stretch: float = 1.0, pattern: str = mixing.SPLIT_PATTERN) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).  mix: doc_id, source, lang, n_tokens, uses.  shares: one row a target source.

    ``total_tokens`` null means ``stretch`` times the largest total at which every source that has records
    reaches its target within its cap; beyond 1 the short sources give what they have and their shortage goes to
    siblings in the tree, then to other domains.  ``domains`` names the domain of a source; one not named is its own.
    A null ``max_repeats`` counts as 1; a fractional one is rounded down, as a record is used a whole number of
    times.  Sources without a target are left out.  Leaf totals on the driver are at most targets x two-letter language codes.
    """
    spark = documents.sparkSession
    goal = [
        (r["source"], float(r["share"]), max(0, int(r["cap"])))
        for r in targets.where("source is not null and target_share > 0").groupBy(F.lower(F.trim("source")).alias("source"))
        .agg(F.sum("target_share").alias("share"), F.coalesce(F.max("max_repeats"), F.lit(1.0)).alias("cap")).orderBy("source").collect()
    ]
    whole = sum(s for _, s, _ in goal) or 1.0
    goal = [(n, s / whole, c) for n, s, c in goal]
    known = spark.createDataFrame([(n,) for n, _, _ in goal], "source string")
    sized = cut(token_sizes(documents, tokenizer, pattern).join(F.broadcast(known), "source", "left_semi").where("n_tokens > 0"))
    totals = sized.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()
    leaves = {(r["source"], r["lang"]): r["n"] for r in totals}
    root = mixing.build_tree(goal, leaves, domains or {})
    asked = mixing.feasible_total(goal, leaves) * stretch if total_tokens is None else float(total_tokens)
    mixing.share_out(root, asked)
    buckets = {(r["source"], r["lang"]): -(-r["k"] // BUCKET_ROWS) for r in totals}
    plans = spark.createDataFrame([(*p, buckets[p[:2]]) for p in mixing.leaf_plans(root)], "source string, lang string, whole int, rest bigint, buckets bigint")
    # the order of the last, partial epoch of a leaf: hash buckets, then hashes
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = sized.join(F.broadcast(plans), ["source", "lang"]).withColumn("h", h).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    sums = rows.where("rest > 0").groupBy("source", "lang", "rest", "bucket").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("source", "lang").orderBy("bucket"))
    over = sums.withColumn("upto", upto).where("upto > rest")
    # one row a leaf: its edge bucket and the tokens before it; without one the whole leaf goes in
    edges = over.groupBy("source", "lang").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("t")).alias("below")), "bucket").alias("edge"))
    marked = rows.join(F.broadcast(edges), ["source", "lang"], "left")
    at_edge = (F.col("rest") > 0) & (F.col("bucket") == F.col("edge.bucket"))
    inside = (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge.bucket")))
    order = Window.partitionBy("source", "lang").orderBy("h", "doc_id")
    after = F.col("edge.below") + F.sum("n_tokens").over(order)
    # the record at the edge goes in when that brings the leaf nearer to its budget
    taken = marked.where(at_edge).withColumn("after", after).withColumn("extra", (F.col("after") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).drop("after")
    plain = marked.where(~F.coalesce(at_edge, F.lit(False))).withColumn("extra", inside.cast("int"))
    out = plain.unionByName(taken).withColumn("uses", F.col("whole") + F.col("extra")).where("uses > 0")
    chosen = out.select("doc_id", "source", "lang", "n_tokens", "uses")
    have: dict[str, int] = {}
    for (s, _), n in leaves.items():
        have[s] = have.get(s, 0) + n
    base = spark.createDataFrame([(n, s, c, have.get(n, 0)) for n, s, c in goal], "source string, target_share double, max_uses int, source_tokens bigint")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    all_tokens = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # over the target rows only
    shares = base.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0))).select(
        "source", "target_share", "max_uses", "source_tokens", "used_tokens", F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        (F.col("used_tokens") / F.nullif(all_tokens, F.lit(0))).alias("reached_share"),
    )
    return chosen, shares


# ---------------------------------------------------------------- 8 personal details

_FOUND = pa.struct([("kind", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())])
#: Bound of the name list on the driver; it is a dictionary, not data that grows with the corpus.
MAX_NAME_PARTS = 500_000


def name_model(names: DataFrame) -> pii.NameModel:
    rows = names.select("name_part", "part_kind").distinct().limit(MAX_NAME_PARTS + 1).collect()
    if len(rows) > MAX_NAME_PARTS:
        raise ValueError(f"the name list has more than {MAX_NAME_PARTS} parts")
    return pii.learn_names([(r["name_part"], r["part_kind"]) for r in rows])


def personal_details(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, kind, char_start, char_end) of every personal detail."""
    shared = documents.sparkSession.sparkContext.broadcast(name_model(names))
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())])

    def run(batches: Batches) -> Batches:
        finder = pii.Finder(shared.value)
        for b in batches:
            out = [(i, k, s, e) for i, t in _rows(b, "doc_id", "text") for k, s, e in finder.find(t)]
            if out:
                yield _batch(schema, [list(c) for c in zip(*out, strict=True)])

    return spread(documents, ["doc_id", "text"]).mapInArrow(run, "doc_id bigint, kind string, char_start bigint, char_end bigint")


def redacted(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, redacted_text, n_details): every detail replaced by the placeholder of its kind, all else untouched."""
    shared = documents.sparkSession.sparkContext.broadcast(name_model(names))
    schema = pa.schema([("doc_id", pa.int64()), ("redacted_text", pa.string()), ("n_details", pa.int64())])

    def run(batches: Batches) -> Batches:
        finder = pii.Finder(shared.value)
        for b in batches:
            out = []
            for i, t in _rows(b, "doc_id", "text"):
                spans = finder.find(t)
                out.append((i, pii.redact(t, spans), len(spans)))
            if out:
                yield _batch(schema, [list(c) for c in zip(*out, strict=True)])

    return spread(documents, ["doc_id", "text"]).mapInArrow(run, "doc_id bigint, redacted_text string, n_details bigint")
