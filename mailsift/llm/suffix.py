"""Suffix-array dedup: every byte under a string of ``length`` bytes that also starts elsewhere goes.

Sorting all suffixes of a corpus needs all of it in one order; only suffixes that can share ``length``
bytes need comparing, so they are first brought together. Each window of ``length`` bytes is anchored
at the smallest hash of its ``GRAM``-byte strings (the first of equals), which depends on the window's
bytes alone: equal windows have equal anchors at equal places. Neighbouring windows with one anchor
form a segment; anchors meet by hash.

* Segments that are equal in all bytes (by a 128-bit BLAKE2 digest) are repeats, all windows of them.
* Where an anchor has several different segments, one of each goes through the suffix sort: prefix
  polynomial hashes and binary search give the common extension of two suffixes in logarithmic time,
  a mergesort orders the suffixes at the anchors of each group with such comparisons, and each
  suffix walks along its sorted neighbours, whose common extensions to the right only shrink, and
  takes its extension to the left with each. Extensions that reach ``length`` together cover windows;
  their bytes are compared, so a hash collision covers nothing. The hashes are taken modulo a prime.
* What a walk of ``WALK`` neighbours leaves open, and groups of more than ``GROUP`` segments, is decided
  exactly by counting 128-bit hashes of single windows in a shuffle of their own.

Defined cases: null and short texts lose nothing; texts are UTF-8 bytes; matches never cross
documents; overlapping repeats inside one document count; repeated rows are documents of their own
(their bytes start elsewhere, so long ones lose all), though rows that agree in id and text share
one result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, batches, cut, digests, inverse_powers, keyed, map_batches, mix, prefix_hash, table

LENGTH, GRAM = 400, 128
GROUP, WALK = 2000, 32
PLACE_BITS = 24
CHUNK = 4 << 20


def _sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima of blocks of w."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Of each run of windows with one anchor: text, first window (byte in the text), windows, anchor's place in the first, hashes."""
    names = ("text", "lo", "n", "off", "key", "s1", "s2")
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in names}
    prefix, inverse = prefix_hash(data), inverse_powers(len(data) + 1)
    at = np.arange(len(data) - gram + 1)
    grams = mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(at)])
    # Places are packed below the hash, so a longer text is taken in slices, each with the grams of its last window.
    place, w = np.uint64((1 << PLACE_BITS) - 1), length - gram + 1
    anchors, step = np.empty(len(at) - w + 1, np.int64), (1 << PLACE_BITS) - w
    for i in range(0, len(anchors), step):
        own = grams[i : i + step + w - 1]
        anchors[i : i + step] = i + (_sliding_min((own & ~place) | at[: len(own)].astype(np.uint64), w) & place).astype(np.int64)
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in names}
    anchor = anchors[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    i = np.flatnonzero(first)
    lo, n, p = starts[i], np.diff(np.append(i, len(starts))), anchor[i]
    text = np.searchsorted(offsets, lo, side="right") - 1
    raw = data.tobytes()
    seg = digests((raw[a:b] for a, b in zip(lo.tolist(), (lo + n + length - 1).tolist(), strict=True)), 16) ^ mix((p - lo).astype(np.uint64))[:, None]
    return {"text": text, "lo": lo - offsets[text], "n": n, "off": p - lo, "key": grams[p].view(np.int64), "s1": seg[:, 0].view(np.int64), "s2": seg[:, 1].view(np.int64)}


class Sorter:
    """Suffixes at the anchors of segments laid end to end, grouped by key."""

    def __init__(self, key: np.ndarray, pieces: list[bytes], off: np.ndarray, length: int):
        sizes = np.array([len(x) for x in pieces], np.int64)
        self.bytes, self.length = b"".join(pieces), length
        self.text = np.frombuffer(self.bytes, np.uint8)
        self.start = np.cumsum(sizes) - sizes
        self.point, self.left, self.right = self.start + off, off, sizes - off
        self._same = Rolling(self.text).same
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.first = np.repeat(edge, np.diff(np.append(edge, len(key))))  # of each suffix's group
        self.size = np.repeat(np.diff(np.append(edge, len(key))), np.diff(np.append(edge, len(key))))
        self.windows = sizes - length + 1

    def extension(self, i: np.ndarray, j: np.ndarray, left: bool = False) -> np.ndarray:
        """Common bytes of two suffixes from their anchors on, or before them, by binary search."""
        side = self.left if left else self.right
        lo, hi = np.zeros(len(i), np.int64), np.minimum(side[i], side[j])
        a, b = self.point[i], self.point[j]
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self._same(a - mid, b - mid, mid) if left else self._same(a, b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.extension(i, j)
        end_i, end_j = n >= self.right[i], n >= self.right[j]
        last = len(self.text) - 1
        smaller = self.text[np.minimum(self.point[i] + n, last)] < self.text[np.minimum(self.point[j] + n, last)]
        return np.where(end_i | end_j, end_i & ~end_j, smaller)

    def order(self) -> np.ndarray:
        """Suffixes in order inside each group: a mergesort of all groups at a time, runs merged by rank."""
        order, width = np.arange(len(self.point)), 1
        most = int(self.size.max(initial=0))
        while width < most:
            at = np.flatnonzero(self.size > width)
            base, size = self.first[at], self.size[at]
            x, me = at - base, order[at]
            block = x // (2 * width) * (2 * width)
            second = x - block >= width
            begin = np.minimum(np.where(second, block, block + width), size)
            lo, hi = begin.copy(), np.minimum(begin + width, size)
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                mid = (lo[live] + hi[live]) >> 1
                other, own = order[base[live] + mid], me[live]
                ahead = np.where(second[live], ~self.less(own, other), self.less(other, own))
                lo[live], hi[live] = np.where(ahead, mid + 1, lo[live]), np.where(ahead, hi[live], mid)
            merged = order.copy()
            merged[base + block + (x - block - width * second) + (lo - begin)] = me
            order, width = merged, 2 * width
        return order

    def cover(self, walk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that stand in another segment too (flat, segment by segment), bounds, and segments left open."""
        order = self.order()
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        near = np.zeros(len(order), np.int64)  # common extension of order[r] and order[r + 1]
        inner = np.flatnonzero(self.first[order[:-1]] == self.first[order[1:]])
        near[inner] = self.extension(order[inner], order[inner + 1])
        bounds = np.concatenate([[0], np.cumsum(self.windows)])
        marks = np.zeros(bounds[-1] + 1, np.int64)
        open_ = np.zeros(len(order), bool)
        for way in (1, -1):
            i = np.arange(len(order))
            right, most = self.right.copy(), np.full(len(order), -1)
            for step in range(1, walk + 1):
                r = rank[i] + way * step
                ok = (r >= self.first[i]) & (r < self.first[i] + self.size[i])
                i, r, right, most = i[ok], r[ok], right[ok], most[ok]
                right = np.minimum(right, near[r - 1 if way > 0 else r])
                ok = right >= self.length - self.left[i]  # else no window with room to its left is long enough
                i, r, right, most = i[ok], r[ok], right[ok], most[ok]
                if not len(i):
                    break
                j = order[r]
                left = self.extension(i, j, left=True)
                fits = (left > most) & (left + right >= self.length)
                for x, y, a, b in zip(i[fits].tolist(), j[fits].tolist(), left[fits].tolist(), right[fits].tolist(), strict=True):
                    p, q = int(self.point[x]), int(self.point[y])
                    if self.bytes[p - a : p + b] == self.bytes[q - a : q + b]:
                        lo = int(bounds[x]) + int(self.left[x]) - a
                        hi = int(bounds[x]) + min(int(self.left[x]) - (self.length - b), int(self.windows[x]) - 1)
                        if lo <= hi:
                            marks[lo] += 1
                            marks[hi + 1] -= 1
                most = np.maximum(most, left)
                ok = most < self.left[i]  # else nothing further along adds a window
                i, right, most = i[ok], right[ok], most[ok]
            else:
                open_[i] = True
        return np.cumsum(marks)[:-1] > 0, bounds, open_


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


SPANS = "array<struct<a:int,b:int>>"
#: What names a segment: its anchor's hash and a digest of its bytes.
SEG = ("key", "s1", "s2")


def _sorted_groups(parts: Iterator[pa.RecordBatch], length: int, walk: int) -> Iterator[pa.RecordBatch]:
    """Groups arrive in order of their key; whole groups are sorted together, some megabytes at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        key = np.array([r[0] for r in rows])
        s = Sorter(key, [r[3] for r in rows], np.array([r[2] for r in rows], np.int64), length)
        covered, bounds, open_ = s.cover(walk)
        unsure = np.isin(s.first, s.first[open_])  # one open suffix leaves its group to the count
        spans = [_runs(covered[bounds[x] : bounds[x + 1]]) for x in range(len(rows))]
        segs = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 4)]
        return pa.RecordBatch.from_arrays([pa.array(key), *segs, pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(unsure)], ["key", "s1", "s2", "spans", "unsure"])

    held: list[tuple] = []
    size = 0  # bytes held
    for part in parts:
        for row in zip(*(part.column(x).to_pylist() for x in ("key", "s1", "off", "piece", "s2")), strict=True):
            if size >= CHUNK and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield solve(held)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, walk: int = WALK) -> DataFrame:
    """(_d, _h, spans): byte ranges [a, b) of each document under repeated strings; overlapping ones are not merged."""
    rows = keyed(docs).select("_d", "_h", "_text")

    def anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            d, h = (part.column(x).to_numpy() for x in ("_d", "_h"))
            for i, _, data, offsets in batches(part.column("_text")):
                s = segments(data, offsets, length, gram)
                t = i + s["text"]
                place = s["lo"].astype(np.int64) << 32 | s["n"].astype(np.int64) << 16 | s["off"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(s[k]) for k in SEG), pa.array(d[t]), pa.array(h[t]), pa.array(place)], [*SEG, "_d", "_h", "place"])

    found = map_batches(rows, anchors, "key long, s1 long, s2 long, _d long, _h long, place long")
    seg = F.struct("s1", "s2")
    met = found.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min(seg).alias("a"), F.max(seg).alias("b")).filter("times > 1").select("key", (F.col("a") != F.col("b")).alias("mixed"))
    met = cut(met, "met")  # as a table, so that the join reads both sides by plain shuffles and can split a hot key
    shared = cut(found.join(met, "key"), "shared")
    kinds = shared.groupBy(*SEG).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("_d", "_h", "place")).alias("one"), F.max("mixed").alias("mixed"))
    kinds = cut(kinds, "kinds")
    whole = kinds.filter("times > 1").select(*SEG)
    variants = kinds.filter("mixed")
    crowd = cut(variants.groupBy("key").agg(F.count(F.lit(1)).alias("variants")), "crowd")
    wanted = variants.join(crowd, "key").groupBy("one._d", "one._h").agg(F.collect_list(F.struct(*SEG, "one.place", (F.col("variants") > group).alias("crowded"))).alias("wanted"))

    def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for text, own in zip(part.column("_text"), part.column("wanted").to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for w in own:
                    lo, n, off = w["place"] >> 32, w["place"] >> 16 & 0xFFFF, w["place"] & 0xFFFF
                    out.append((w["key"], w["s1"], w["s2"], off, raw[lo : lo + n + length - 1], w["crowded"]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*SEG, "off", "piece", "crowded"])

    pieces = map_batches(rows.join(wanted, ["_d", "_h"]).dropDuplicates(["_d", "_h"]).select("_text", "wanted"), slices, "key long, s1 long, s2 long, off int, piece binary, crowded boolean")
    pieces = cut(pieces, "pieces")
    calm = pieces.filter("not crowded").drop("crowded").repartition("key").sortWithinPartitions("key")
    ordered = cut(map_batches(calm, lambda parts: _sorted_groups(parts, length, walk), f"key long, s1 long, s2 long, spans {SPANS}, unsure boolean"), "ordered")

    def single(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for key, s1, s2, off, piece in zip(*(part.column(x).to_pylist() for x in (*SEG, "off", "piece")), strict=True):
                data = np.frombuffer(piece, np.uint8)
                n = len(data) - length + 1
                p = prefix_hash(data)
                x = Rolling(data).windows(length), mix((p[length:] - p[:-length]) * inverse_powers(n))
                ids = [pa.array(np.full(n, v)) for v in (key, s1, s2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.arange(n, dtype=np.int32)), pa.array(off - np.arange(n, dtype=np.int32)), *(pa.array(y.view(np.int64)) for y in x)], [*SEG, "w", "at", "x1", "x2"])

    unsure = ordered.filter("unsure").select("key").distinct()
    left_over = pieces.filter("crowded").drop("crowded").unionByName(pieces.drop("crowded").join(unsure, "key", "left_semi"))
    windows = map_batches(left_over, single, "key long, s1 long, s2 long, w int, at int, x1 long, x2 long")
    twice = cut(windows.groupBy("key", "at", "x1", "x2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"), "twice")
    # Neighbouring windows of a segment become one span: they have one difference to their rank.
    counted = windows.join(twice, ["key", "at", "x1", "x2"]).select(*SEG, "w")
    rank = F.col("w") - F.row_number().over(Window.partitionBy(*SEG).orderBy("w"))
    counted = counted.withColumn("g", rank).groupBy(*SEG, "g").agg(F.min("w").alias("a"), F.max("w").alias("b")).select(*SEG, F.struct("a", "b").alias("s"))
    partial = ordered.filter("not unsure and size(spans) > 0").select(*SEG, F.explode("spans").alias("s")).unionByName(counted)
    # Repeats of whole segments need no more than that; the rest take the windows found. One row a segment, in a
    # table: the join to all its places reads both sides by plain shuffles then, and a hot segment can be split.
    partial = partial.join(whole, list(SEG), "left_anti").groupBy(*SEG).agg(F.collect_set("s").alias("spans"))
    partial = cut(partial, "partial")
    lo = F.shiftright("place", 32).cast("int")
    n = F.shiftright("place", 16).bitwiseAND(0xFFFF).cast("int")
    first = shared.join(whole, list(SEG)).select("_d", "_h", lo.alias("a"), (lo + n - 1 + length).alias("b"))
    second = shared.join(partial, list(SEG)).select("_d", "_h", lo.alias("lo"), F.explode("spans").alias("s"))
    second = second.select("_d", "_h", (F.col("lo") + F.col("s.a")).alias("a"), (F.col("lo") + F.col("s.b") + length).alias("b"))
    return first.unionByName(second).groupBy("_d", "_h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans and kept, the bytes that remain."""
    spans = repeated_spans(docs, **options)

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, removed, runs, kept = [], [], [], []
            for text, own in zip(part.column("_text"), part.column("spans").to_pylist(), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                at, out, n = 0, [], 0
                for a, b in _merged(own or []):
                    out.append(raw[at:a])
                    at, n = b, n + 1
                out.append(raw[at:])
                kept.append(b"".join(out))
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                runs.append(n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = keyed(docs).join(spans, ["_d", "_h"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "_text", "spans")
    return map_batches(joined, apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _merged(spans: list[dict[str, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda s: s["a"]):
        if out and s["a"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s["b"])
        else:
            out.append((s["a"], s["b"]))
    return out


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that stand elsewhere too."""
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
