"""Fill-in-the-middle: each text is cut into prefix, middle and suffix, and its parts are set in another order.

Units are runs of ASCII letters and single other characters. Two draws from the SHA-256 of the id place
the cuts between units, two more choose the form:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle,
* ``plain``: the text as it is.

A batch of texts lies end to end in one byte array. One scan marks where units begin and so where the
cuts fall. Every byte of a part moves by the same distance, so a difference array, changed only at the
cuts, sums up to each byte's displacement, and one scatter writes all outputs of the batch. The inverse
reads the markers off the outputs, sums up the displacements of the original order and gathers.

Defined cases: a null text is empty; empty texts, and texts that hold a marker, stay plain, so a marker
in an output that isn't plain stands only where it was put, and the inverse is exact; a null id draws
as the empty string; rows that agree in id and text get equal outputs; an empty table gives an empty
one. Cuts fall between code points, never inside one. Other columns, whatever their names, come
through in ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, map_batches, packed, table

MARKS = (b"<P>", b"<S>", b"<M>")
WIDE = 3
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
#: Of a hundred texts: how many are rearranged, and how many of those have the suffix first.
SHARE, SUFFIX_FIRST, SEED = 90, 20, 1


def draws(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers for each id: the first four groups of its seeded SHA-256."""
    heads = b"".join([hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids])
    return np.frombuffer(heads, ">u4").reshape(-1, 4).astype(np.int64)


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = True
    return out


LETTER = _letters()


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of markers that lie inside one text, which marker (0 P, 1 S, 2 M), and the text."""
    if len(data) < WIDE:
        return (np.zeros(0, np.int64),) * 3
    at = np.flatnonzero((data[:-2] == MARKS[0][0]) & (data[2:] == MARKS[0][2]))
    kind = np.full(len(at), -1)
    for k, m in enumerate(MARKS):
        kind[data[at + 1] == m[1]] = k
    owner = np.searchsorted(offsets, at, side="right") - 1
    good = (kind >= 0) & (at + WIDE <= offsets[owner + 1])
    return at[good], kind[good], owner[good]


def moved(n: int, places: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The displacement of each of n bytes: from places[i] up to the next place it is shifts[i]; places ascend and may repeat."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, places, np.diff(shifts, prepend=0))
    return np.cumsum(step[:-1])


def rearrange(data: np.ndarray, offsets: np.ndarray, draw: np.ndarray, share: int = SHARE, suffix_first: int = SUFFIX_FIRST) -> dict[str, np.ndarray]:
    """n, form, prefix and middle characters of each text, and the outputs' bytes and offsets."""
    begin, end = offsets[:-1], offsets[1:]
    letter = LETTER[data]
    whole = (data & 0xC0) != 0x80
    unit = whole & ~letter
    unit |= letter
    if len(data):
        inner = letter[1:] & letter[:-1]
        unit[1:][inner] = False
        firsts = begin[begin < end]
        unit[firsts] = True
    starts = np.flatnonzero(unit)
    bounds = np.searchsorted(starts, offsets)
    n = np.diff(bounds)
    cut = np.sort(draw[:, :2] % (n + 1)[:, None], axis=1)
    starts = np.append(starts, len(data))
    a, b = (np.where(cut[:, k] < n, starts[np.minimum(bounds[:-1] + cut[:, k], len(starts) - 1)], end) for k in range(2))
    form = np.where(draw[:, 3] % 100 < suffix_first, SPM, PSM)
    form[(begin == end) | (draw[:, 2] % 100 >= share)] = PLAIN
    form[marks(data, offsets)[2]] = PLAIN
    size = end - begin + 3 * WIDE * (form != PLAIN)
    to = np.concatenate([[0], np.cumsum(size)])
    out0 = to[:-1]
    # Where prefix, middle and suffix begin in the output.
    n_suffix, n_prefix = end - b, a - begin
    p = np.choose(form, [out0, out0 + WIDE, out0 + 2 * WIDE + n_suffix])
    s = np.choose(form, [out0 + (b - begin), out0 + 2 * WIDE + n_prefix, out0 + WIDE])
    m = np.choose(form, [out0 + n_prefix, *(out0 + 3 * WIDE + n_prefix + n_suffix,) * 2])
    places = np.stack([begin, a, b], axis=1).ravel()
    shift = moved(len(data), places, np.stack([p - begin, m - a, s - b], axis=1).ravel())
    out = np.empty(int(to[-1]), np.uint8)
    out[np.arange(len(data)) + shift] = data
    for part, mark in zip((p, s, m), MARKS, strict=True):
        at = part[form != PLAIN] - WIDE
        for i in range(WIDE):
            out[at + i] = mark[i]
    chars = np.concatenate([[0], np.cumsum(whole)])
    return {"n": n, "form": form, "prefix": chars[a] - chars[begin], "middle": chars[b] - chars[a], "out": out, "to": to}


def put_back(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that outputs were made of, from the outputs and their forms alone."""
    begin, end = offsets[:-1], offsets[1:]
    at, kind, owner = marks(data, offsets)
    mine = form[owner] != PLAIN
    where = np.repeat(end[:, None], 3, axis=1)
    where[owner[mine], kind[mine]] = at[mine]
    p, s, m = where.T
    first = np.where(form == SPM, m, s) - p - WIDE  # length of the prefix
    last = np.where(form == SPM, p, m) - s - WIDE  # of the suffix
    middle = end - m - WIDE
    plain = form == PLAIN
    first[plain], middle[plain], last[plain] = (end - begin)[plain], 0, 0
    to = np.concatenate([[0], np.cumsum(first + middle + last)])
    a, b = to[:-1] + first, to[:-1] + first + middle
    src = [np.where(plain, begin, p + WIDE), np.where(plain, end, m + WIDE), np.where(plain, end, s + WIDE)]
    places = np.stack([to[:-1], a, b], axis=1).ravel()
    shift = moved(int(to[-1]), places, (np.stack(src, axis=1) - np.stack([to[:-1], a, b], axis=1)).ravel())
    return data[np.arange(int(to[-1])) + shift], to


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def fill_in_middle(docs: DataFrame, seed: int = SEED, share: int = SHARE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per row of docs: row (all its columns), n, form, prefix_chars, middle_chars and output."""
    rows = packed(docs).select("row")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row = part.column("row")
            ids = pc.struct_field(row, "doc_id").to_pylist()
            for i, j, data, offsets in batches(pc.struct_field(row, "text")):
                x = rearrange(data, offsets, draws(ids[i:j], seed), share, suffix_first)
                plain = x["form"] == PLAIN
                counts = [pa.array(x[k], pa.int64(), mask=plain) for k in ("prefix", "middle")]
                yield pa.RecordBatch.from_arrays([row.slice(i, j - i), pa.array(x["n"], pa.int64()), pa.array(FORMS[x["form"]]), *counts, _strings(x["out"], x["to"]).cast(pa.string())], schema.names)

    schema = T.StructType([rows.schema["row"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return map_batches(rows, run, schema)


def restore(made: DataFrame) -> DataFrame:
    """``made`` (columns output and form, and any others but ``restored``) with the text each output was made of."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            form = np.searchsorted(FORMS, part.column("form").to_numpy(zero_copy_only=False).astype(str)).astype(np.int64)
            for i, j, data, offsets in batches(part.column("output")):
                text = _strings(*put_back(data, offsets, form[i:j])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.slice(i, j - i).columns, text], schema.names)

    schema = T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())])
    return map_batches(made, run, schema)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged and put back."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restore(made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
