"""Line dedup: repeated runs of lines, found by winnowing, are deleted but for the first.

Documents are ordered by doc_id; their lines are split at \\n, and lines without a word are passed
over. Each line has a 128-bit BLAKE2 digest, so equal digests mean equal lines. Winnowing selects
the smallest digest of each window of ``w`` neighbouring lines (the first of equals): two runs that
share ``w`` lines share a selected line, whatever stands around them.

1. Selected lines alone are counted, by 64 bits of their digest and summed up before the
   shuffle. Only positions whose selected line stands at two places or more go on: a run with a
   selected line that stands once can't repeat, so most windows are never compared.
2. Each position left is extended line by line to both sides, as far as the windows it was selected
   for reach. An extension is named by the digests of its lines together; the earliest place of each
   name is a minimum, summed up before the shuffle, and joined back with one row on one side.
3. An extension that stands earlier is deleted. Each further line of a repeated run lies in a window
   that has its own selected line in the run, so extensions of neighbouring positions overlap, and
   together they reach both ways to where the lines differ: the maximal repeated runs.

No texts are compared and no pairs are made of the places of a line, however common it is.

With ``long``, as in the query and the pipeline, lines of ``LONG_WORDS`` words or ``LONG_CHARS``
characters are selected by themselves too. With w = 2:

* every line in a run of two lines that also stands earlier is deleted, and
* every long line that also stands earlier, and no other.

Defined cases: null and empty texts have no lines and stay as they are; documents of fewer than
``w`` lines lose long lines only; blank lines inside a deleted run go with it; rows that agree in
doc_id and text are one document and are treated alike; a null doc_id comes before all others;
ids that aren't whole numbers have no order and raise a TypeError. Other columns, whatever their
names and types, come through in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, cut, digests, keyed, map_batches, mix, packed, table, words
from .quality import line_table

W = 2
LONG_WORDS, LONG_CHARS = 50, 200


def winnow(values: np.ndarray, owner: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """First lines of the windows of w neighbours of one owner, and the line that each selects: its smallest value."""
    if len(values) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: len(owner) - w + 1] == owner[w - 1 :])
    view = np.lib.stride_tricks.sliding_window_view(values, w)[at]
    return at, at + view.argmin(axis=1)


class Positions(NamedTuple):
    """Lines that are selected, and how far each is extended."""

    owner: np.ndarray  # the text of each position
    line: np.ndarray  # 64 bits of its line's digest
    bounds: np.ndarray  # of its extensions
    keys: tuple[np.ndarray, np.ndarray]  # of each extension: 128 bits of its lines' digests together
    first: np.ndarray
    last: np.ndarray


def positions(data: np.ndarray, offsets: np.ndarray, w: int, long: bool = False) -> Positions:
    """The selected lines of all texts, each with the windows it was selected for, and with ``long`` each long line."""
    starts, _, _ = words(data, offsets)
    begin, end, owner, filled = line_table(data, offsets, starts)
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)  # of the line in its text
    begin, end, owner, number = begin[filled], end[filled], owner[filled], number[filled]
    raw = data.tobytes()
    names = digests((raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)), 16)

    def extension(selected: np.ndarray, back: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Selected lines extended by ``back`` lines to the left, and to ``size`` lines on the right of that."""
        keys = []
        for k in range(2):
            h = np.full(len(selected), size, np.uint64)
            for i in range(size):
                h = mix(h * np.uint64(3) + names[selected - back + i, k])
            keys.append(h)
        return selected, *keys, number[selected - back], number[selected - back + size - 1]

    window, selected = winnow(names[:, 0], owner, w)
    found = [extension(selected, selected - window, w)]
    if long:
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        large = np.flatnonzero((np.searchsorted(starts, end) - np.searchsorted(starts, begin) >= LONG_WORDS) | (chars[end] - chars[begin] >= LONG_CHARS))
        found.append(extension(large, np.zeros(len(large), np.int64), 1))
    at, k1, k2, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    at, k1, k2, lo, hi = (x[order] for x in (at, k1, k2, lo, hi))
    anchor, first = np.unique(at, return_index=True)
    return Positions(owner[anchor], names[anchor, 0], np.append(first, len(at)), (k1, k2), lo, hi)


def dedup_lines(docs: DataFrame, w: int = W, long: bool = False) -> DataFrame:
    """Per row of docs: row (all its columns), text without the repeated runs, n_lines, n_removed and n_runs."""
    rows = keyed(docs).select("_d", "_h", "_text")

    def select(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            d, h = (part.column(x).to_numpy() for x in ("_d", "_h"))
            for i, _, data, offsets in batches(part.column("_text")):
                x = positions(data, offsets, w, long)
                keys = [pa.array(k.view(np.int64)) for k in x.keys]
                ext = pa.StructArray.from_arrays([*keys, pa.array(x.first.astype(np.int32)), pa.array(x.last.astype(np.int32))], ["k1", "k2", "lo", "hi"])
                yield pa.RecordBatch.from_arrays([pa.array(x.line.view(np.int64)), pa.array(d[i + x.owner]), pa.array(h[i + x.owner]), pa.ListArray.from_arrays(pa.array(x.bounds.astype(np.int32)), ext)], ["line", "_d", "_h", "ext"])

    # Tables, where they are read twice or joined: both sides of a join are then plain shuffles, and a hot line can be split.
    found = cut(map_batches(rows, select, "line long, _d long, _h long, ext array<struct<k1:long,k2:long,lo:int,hi:int>>"), "positions")
    repeated = cut(found.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("line"), "repeated")
    near = cut(found.join(repeated, "line").select("_d", "_h", F.explode("ext").alias("x")).select("_d", "_h", "x.*"), "extensions")
    first = near.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_d", "_h", "lo")).alias("first")).filter("n > 1").select("k1", "k2", "first")
    later = near.join(cut(first, "first"), ["k1", "k2"]).filter(F.struct("_d", "_h", "lo") != F.col("first"))
    spans = later.groupBy("_d", "_h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, counts = [], []
            for text, runs in zip(pc.struct_field(part.column("row"), "text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                gone = np.zeros(len(lines) + 1, np.int64)
                for r in runs or ():
                    gone[r["lo"]] += 1
                    gone[r["hi"] + 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                n = int(gone.sum())
                texts.append("\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if n else text)
                counts.append((len(lines), n, int(n > 0 and gone[0]) + int((gone[1:] & ~gone[:-1]).sum())))
            counted = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), *counted], schema.names)

    joined = packed(docs).join(spans, ["_d", "_h"], "left").select("row", "spans")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("n_lines", "n_removed", "n_runs"))])
    return map_batches(joined, apply, schema)


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, without the runs of lines and the long lines that an earlier place has."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), long=True)
    return out.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")
