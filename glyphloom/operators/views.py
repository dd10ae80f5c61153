"""Operators over given norm views: blocks, sentences, tokens and rule hits, as relations with byte spans of the view.

A view is (prep_id, norm_text, block_starts); its rows are read where they are scanned and only spans are exchanged.
Equal copies of a view fold in the results.  Defined results: a null or empty text gives no row; null starts mean one block;
starts inside a character or past the end are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.plans.session import spread

SPAN = "start bigint, end bigint"


def _places(text: str, starts: list[int] | None) -> tuple[np.ndarray, list[int]]:
    """Byte offset of every character and of the end, and the block starts as characters."""
    from glyphloom.functions.chars import byte_table

    table = byte_table(text)
    table = np.arange(len(text) + 1) if table is None else table
    if starts is None:
        return table, [0]
    wanted = np.array(sorted({s for s in starts if s is not None}), dtype=np.int64)
    at = np.searchsorted(table, wanted)
    ok = (at < len(text)) & (table[np.minimum(at, len(text))] == wanted)
    return table, at[ok].tolist()


def _rows(views: DataFrame, ddl: str, each: Callable[[str, list[int]], Iterator[tuple]]) -> DataFrame:
    """Runs ``each(text, starts) -> rows with character spans first`` over every view; spans come out as bytes."""
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([("prep_id", pa.int64()), *((c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for prep_id, text, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not text:
                    continue
                table, at = _places(text, starts)
                for s, e, *rest in each(text, at):
                    for column, x in zip(out, (prep_id, int(table[s]), int(table[e]), *rest), strict=True):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    rows = views.select(F.col("prep_id").cast("bigint").alias("prep_id"), "norm_text", F.col("block_starts").cast("array<bigint>").alias("block_starts"))
    return spread(rows).mapInArrow(run, f"prep_id bigint, {ddl}").select("prep_id", *names).distinct()


def text_views(df: DataFrame, id_column: str = "prep_id", content: str = "text") -> DataFrame:
    """(prep_id, view_md5, n_blocks, removed) of documents read as plain text, before any look-alike folding.

    ``view_md5`` is over the view in canonical composition, ``removed`` the byte places of the invisible characters taken out.
    """
    schema = pa.schema([("prep_id", pa.int64()), ("view_md5", pa.string()), ("n_blocks", pa.int64()), ("removed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import unicodedata

        from glyphloom.functions.chars import byte_table
        from glyphloom.functions.markdown import read_text
        from glyphloom.functions.normview import build

        for b in batches:
            out: list[list] = [[] for _ in schema]
            for prep_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text is None:
                    continue
                v = build(read_text(text), fold=False)
                table = byte_table(text)
                at = v.removed if table is None else [int(table[k]) for k in v.removed]
                row = (prep_id, hashlib.md5(unicodedata.normalize("NFC", v.text).encode()).hexdigest(), len(v.blocks), ",".join(map(str, at)))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    rows = df.select(F.col(id_column).cast("bigint").alias("prep_id"), F.col(content).alias("text"))
    return spread(rows).mapInArrow(run, "prep_id bigint, view_md5 string, n_blocks bigint, removed string").distinct()


def view_blocks(views: DataFrame) -> DataFrame:
    """(prep_id, start, end) of every block: from its start to the next one, white space at its end left out."""

    def each(text: str, starts: list[int]) -> Iterator[tuple]:
        from glyphloom.functions.shapes import block_spans

        yield from block_spans(text, starts)

    return _rows(views, SPAN, each)


def view_sentences(views: DataFrame) -> DataFrame:
    """(prep_id, start, end) of the sentences the shape rules look at; a sentence keeps the space before it."""

    def each(text: str, starts: list[int]) -> Iterator[tuple]:
        from glyphloom.functions.shapes import block_spans, sentence_spans

        for block in block_spans(text, starts):
            yield from sentence_spans(text, block)

    return _rows(views, SPAN, each)


def view_tokens(views: DataFrame) -> DataFrame:
    """(prep_id, start, end, bare) of what stands between white space, and its form without outer marks, in ASCII lower case."""

    def each(text: str, starts: list[int]) -> Iterator[tuple]:
        from glyphloom.functions.shapes import bare, tokens

        for s, t in tokens(text):
            yield s, s + len(t), bare(t)

    return _rows(views, f"{SPAN}, bare string", each)


@lru_cache(maxsize=1)
def _engine():
    from glyphloom.functions.scan import Engine

    return Engine(None)


def view_hits(views: DataFrame) -> DataFrame:
    """(prep_id, rule_id, matched, start, end, word_count): word-set and pattern hits of all rules that read the norm view, overlaps
    resolved, and the words of the view (maximal runs of word characters).

    No rule is off here: stances come in when the hits meet their documents' profiles.
    """

    def each(text: str, starts: list[int]) -> Iterator[tuple]:
        from glyphloom.functions.chars import count_words
        from glyphloom.functions.normview import NormView
        from glyphloom.functions.scan import widest

        view = NormView.plain(text, starts)
        hits: list = []
        _engine().scan_view(view, hits)
        words = count_words(text) if hits else 0
        for h in widest(hits):
            yield h.start, h.end, h.rule, text[h.start : h.end], words

    return _rows(views, f"{SPAN}, rule_id string, matched string, word_count bigint", each)


def view_findings(views: DataFrame, profiles: DataFrame) -> DataFrame:
    """Hits with the profile of their document (prep_id, profile; null is the default), resolved: stance, tier, lifecycle.

    Only hits and profiles are joined, so no text moves.  Columns as ``operators.analysis.resolve`` gives them.
    """
    from glyphloom.operators.analysis import resolve

    # the verdict of one profile a document: the smallest, where deliveries differ
    one = profiles.groupBy("prep_id").agg(F.coalesce(F.min("profile"), F.lit("general-writing")).alias("profile"))
    hits = view_hits(views).join(one, "prep_id")
    no = F.lit(False)
    return resolve(hits.select(
        F.col("prep_id").alias("doc_id"), F.lit("").alias("sha256"), "profile", "word_count", F.lit(0).alias("seq"), "rule_id", "matched", "start", "end",
        no.alias("quoted"), no.alias("force_candidate"), no.alias("force_hint"),
    ))
