"""Sections and chunks of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

HEADER = re.compile(r"^Item\s+\d+[A-Z]?\.", re.IGNORECASE | re.MULTILINE | re.ASCII)
#: As ``slug`` has them.
_OTHER, _EDGES = re.compile("[^A-Za-z0-9]+"), re.compile("^_+|_+$")
#: Bytes of text that a worker cuts at a time.
CUT_BYTES = 8 << 20


def token_windows(rows: DataFrame, text: str, *steps: tuple[int, int, str], keep_text: bool = True) -> DataFrame:
    """A row for each window of tokens: ``rows`` with ``text`` replaced by the window's and its ``token_count`` added.

    A step (size, stride, name) cuts arrays of ``size`` tokens every ``stride`` and puts the window's number into
    ``name``; the last may lie within the one before. A further step cuts the windows of the step before it. Tokens are
    runs without ASCII white space, as in ``tokens``. They are found once for each text. ``keep_text=False`` leaves the
    windows' text null.
    """
    names = [name for _, _, name in steps]
    others = [f for f in rows.schema if f.name != text]
    kinds = StructType([*others, *(StructField(name, IntegerType()) for name in names), StructField(text, StringType()), StructField("token_count", IntegerType())])
    schema = to_arrow_schema(kinds)

    def spans(n: int) -> list[tuple[int, ...]]:
        out = [(0, n)]
        for size, stride, _ in steps:
            out = [(*held, k, lo + s, min(lo + s + size, hi)) for *held, lo, hi in out for k, s in enumerate(range(0, hi - lo, stride))]
        return out

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, found, texts = [], [], []
        for i, t in enumerate(batch.column(text).cast(pa.binary()).to_pylist()):
            toks = (t or b"").split()
            held = spans(len(toks))
            at += [i] * len(held)
            found += held
            if keep_text:
                texts += [b" ".join(toks[lo:hi]) for *_, lo, hi in held]
        number = np.array(found, np.int32).reshape(-1, len(steps) + 2)
        own = batch.select([f.name for f in others]).take(pa.array(at, pa.int32()))
        cols = [*own.columns, *(pa.array(number[:, k]) for k in range(len(steps)))]
        cols += [pa.array(texts, pa.binary()).cast(pa.string()) if keep_text else pa.nulls(len(at), pa.string()), pa.array(number[:, -1] - number[:, -2])]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.num_rows * CUT_BYTES // max(CUT_BYTES, batch.nbytes))
            for i in range(0, batch.num_rows, size):
                yield cut(batch.slice(i, size))

    return rows.select(*[f.name for f in others], text).mapInArrow(run, kinds)


def item_sections(docs: DataFrame, id_col: str, text_col: str, least: int = 50) -> DataFrame:
    """(doc_id, section_index, section_id, title, body). Bodies under ``least`` tokens are dropped before numbering."""
    kinds = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("section_index", IntegerType()), StructField("slug", StringType()), StructField("title", StringType()), StructField("body", StringType())])
    schema = to_arrow_schema(kinds)

    def cut(text: str) -> list[tuple[str, str]]:
        at = [m.start() for m in HEADER.finditer(text)]
        if not at:
            return [("Full Document", text.strip())]
        found = []
        for lo, hi in zip(at, [*at[1:], len(text)]):
            title, _, body = text[lo:hi].partition("\n")
            body = body.strip()
            if body and len(body.encode().split()) >= least:
                found.append((title.strip(), body))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.num_rows * CUT_BYTES // max(CUT_BYTES, batch.nbytes))
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                rows = [(j, k, t, b) for j, x in enumerate(part.column(1).to_pylist()) if x is not None for k, (t, b) in enumerate(cut(x))]
                j, k, titles, bodies = zip(*rows) if rows else ((), (), (), ())
                slugs = [_EDGES.sub("", _OTHER.sub("_", t)[:50]) for t in titles]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(j, pa.int32())), pa.array(k, pa.int32()), pa.array(slugs, pa.string()), pa.array(titles, pa.string()), pa.array(bodies, pa.string())], schema=schema)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)
    return rows.select("doc_id", "section_index", F.concat("doc_id", F.lit("__"), "section_index", F.lit("__"), "slug").alias("section_id"), "title", "body")


def section_columns(rows: DataFrame) -> DataFrame:
    """Names and titles of the sections of ``token_windows`` by their ``section_index``."""
    number = (F.col("section_index") + 1).cast("string")
    return rows.withColumn("section_id", F.concat("doc_id", F.lit("_sec_"), number)).withColumn("section_title", F.concat(F.lit("Section "), number))


def shadow_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("shadow_id", F.concat("section_id", F.lit("_shd_"), (F.col("chunk_index") + 1).cast("string")))


def upload_sections(docs: DataFrame, id_col: str, text_col: str, size: int = 2000) -> DataFrame:
    """Disjoint windows; (doc_id, section_index, section_id, title, text)."""
    rows = token_windows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", (size, size, "section_index"))
    return section_columns(rows).select("doc_id", "section_index", "section_id", F.col("section_title").alias("title"), "text")


def sliding_chunks(sections: DataFrame, size: int = 1000, stride: int = 800) -> DataFrame:
    """Overlapping windows; (doc_id, section_id, shadow_id, chunk_index, text, token_count)."""
    rows = token_windows(sections.select("doc_id", "section_id", "text"), "text", (size, stride, "chunk_index"))
    return shadow_id(rows).select("doc_id", "section_id", "shadow_id", "chunk_index", "text", "token_count")


def pack_paragraphs(sizes: list[int], limit: int = 1000, overlap: int = 200) -> list[list[tuple[int, int]]]:
    """T11 over paragraph sizes: each chunk as stretches (from, to) of the section's token line.

    After a flush a chunk starts with the last ``overlap`` tokens, so it may hold ``limit + overlap`` (D13); what is
    carried into an oversized paragraph is dropped (D14).
    """
    out, held, at = [], [], 0
    length = lambda parts: sum(b - a for a, b in parts)
    for n in sizes:
        if n > limit:
            if held:
                out.append(held)
            out += [[(at + s, at + min(s + limit, n))] for s in range(0, n, limit - overlap)]
            held = []
        elif length(held) + n > limit:
            tail, need = [], overlap
            if held:
                out.append(held)
            for a, b in reversed(held):
                if need > 0:
                    tail.insert(0, (max(a, b - need), b))
                    need -= b - a
            held = [*tail, (at, at + n)]
        else:
            held = [*held, (at, at + n)]
        at += n
    return [*out, held] if held else out


def paragraph_chunks(sections: DataFrame, limit: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, section_id, shadow_id, chunk_index, text, token_count). A stateful fold, by Arrow batches."""

    @F.pandas_udf("array<struct<text: string, n: int>>")
    def fold(texts: pd.Series) -> pd.Series:
        def one(text):
            words = [p.split() for p in (text or "").replace("\r\n", "\n").split("\n\n")]
            words = [w for w in words if w]
            line = [x for w in words for x in w]
            chunks = [[x for a, b in parts for x in line[a:b]] for parts in pack_paragraphs([len(w) for w in words], limit, overlap)]
            return [{"text": " ".join(c), "n": len(c)} for c in chunks]

        return texts.map(one)

    rows = sections.select("doc_id", "section_id", F.posexplode(fold("text")).alias("chunk_index", "c"))
    return rows.select("doc_id", "section_id", F.concat("section_id", F.lit("__chunk_"), F.col("chunk_index").cast("string")).alias("shadow_id"), "chunk_index", "c.text", F.col("c.n").alias("token_count"))
