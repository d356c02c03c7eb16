"""Language-model scoring: a gated recurrent network over words, with Spark-counted vocabulary.

Base: Spark counts every token of the training documents; a text's base score is the sum of its
tokens' smoothed unigram log10 probabilities.

Model: P(word) = P(class | state) P(unit | class, state) P(word | unit). The ``SINGLES`` most frequent
words are units of their own; all others share a unit with the words of the same last two bytes,
inside which they are distributed as the base distributes words (so unseen words have their mass and
the whole is a distribution over the base's token space). Units are binned into classes by the
square root of their frequency, and the output softmax is factored over classes. The state is a gated
recurrent unit's; numpy trains it by truncated backpropagation on all training documents, whole. They are dealt
by a hash into shards of about ``SHARD`` tokens and into ``ROUNDS`` slices. In each round every shard
starts from the weights of the round before (and Adam's moments), goes through its documents of the
round's slices and gives its weights; their mean, weighed by tokens, is an aggregate that ends in a table.
All slices together are one pass, at any size. Which shard a document is in depends on the corpus alone, not on how its table is cut. Scoring
runs whole documents in windows of ``WINDOW`` steps and carries the state from one to the next.

Memory: the ``KNOWN`` most frequent words go to all tasks (a bounded table); what a task meets beyond
them leaves it as (row, word, count) and meets the full counts in a join.

Defined cases: a null text is empty: its one token is its end; a null doc_id counts as training; rows
are scored one by one, so repeated rows are scored each; without training documents all words are
unknown and the network stays as it was initialised.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, table

KNOWN, SINGLES, SUFFIXES = 200_000, 256, 255
HIDDEN, CLASSES, WINDOW, LANES = 24, 24, 64, 256
SHARD, ROUNDS, STRIDE = 6_000_000, 4, 2_000_000
PIECE = 64
FLUSH = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out() -> F.col:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of the words of all training documents; each task sums its own first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for part in parts:
            for text in part.column("text"):
                seen.update(tokens(text.as_py()))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return map_batches(docs.filter(~held_out()).select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Units:
    """Words to units, and the constants of P(word | unit)."""

    def __init__(self, words: list[bytes], counts: list[int], ends: int, total: int, distinct: int, suffixes: list[tuple[bytes, int, int]], rest: tuple[int, int]):
        self.id = {w: i for i, w in enumerate(words)}
        n = min(SINGLES, len(words))
        self.end, self.suffix = n, {s: n + 1 + i for i, (s, _, _) in enumerate(suffixes)}
        self.other = n + 1 + len(suffixes)
        self.unit = np.array([i if i < n else self.suffix.get(w[-2:], self.other) for i, w in enumerate(words)], np.int32)
        self.logc = np.log10(np.array(counts, float) + 0.5)
        self.log_end = np.log10(ends + 0.5)
        self.ends, self.total, self.distinct = ends, total, distinct
        self.base = np.log10(total + 0.5 * (distinct + 1))
        mass = [*counts[:n], ends, *(t for _, t, _ in suffixes), rest[0]]
        # log10 of the numerator's sum inside each unit; a unit of one word has nothing to share.
        sums = [(t, v) for _, t, v in suffixes] + [rest]
        self.within = np.array([0.0] * (n + 1) + [np.log10(t + 0.5 * (v + 1)) for t, v in sums])
        self.shared = np.array([False] * (n + 1) + [True] * len(sums))
        weight = np.sqrt(np.array(mass, float) + 1)
        order = np.argsort(-weight, kind="stable")
        cls = np.minimum((np.cumsum(weight[order]) - weight[order]) / weight.sum() * CLASSES, CLASSES - 1).astype(int)
        _, cls = np.unique(cls, return_inverse=True)
        self.cls = np.empty(len(mass), np.int32)
        self.cls[order] = cls
        self.members = [np.sort(order[cls == c]) for c in range(cls.max() + 1)]
        self.place = np.empty(len(mass), np.int32)
        for m in self.members:
            self.place[m] = np.arange(len(m))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids (-1: not among the known) and units, without the end."""
        ids = np.array(list(map(self.id.get, words, repeat(-1))), np.int64)
        units = self.unit[ids] if len(self.unit) else np.zeros(len(ids), np.int32)
        units = units.astype(np.int32)
        for i in np.flatnonzero(ids < 0):
            units[i] = self.suffix.get(words[i][-2:], self.other)
        return ids, units


def learn_units(docs: DataFrame, counts: DataFrame) -> Units:
    """Bounded summaries of the counts: the KNOWN words, SUFFIXES endings and totals."""
    ends = docs.filter(~held_out()).count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # The least count that leaves at most KNOWN words, from a histogram of counts (exact up to 4095, then in steps of 4 %).
    step = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor((F.log2("c") - 12) * 16))
    met, least = 0, 1 << 62
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        met += r.n
        if met > KNOWN:
            break
        least = r.s
    top = counts.filter(step >= least).toPandas()
    pairs = sorted(((bytes(w), int(c)) for w, c in zip(top["word"], top["c"], strict=True)), key=lambda x: (-x[1], x[0]))
    words, known = [w for w, _ in pairs], [c for _, c in pairs]
    del top, pairs
    singles = words[:SINGLES]
    by = counts.groupBy(F.substring("word", -2, 2).alias("s")).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("v"))
    out = {}
    for w, c in zip(singles, known, strict=False):
        t, v = out.get(w[-2:], (0, 0))
        out[w[-2:]] = t + c, v + 1
    ends_top = [(bytes(r.s), r.t - out.get(bytes(r.s), (0, 0))[0], r.v - out.get(bytes(r.s), (0, 0))[1]) for r in by.orderBy(F.desc("t"), "s").limit(SUFFIXES).collect()]
    single_t, single_v = sum(known[: len(singles)]), len(singles)
    rest = total.n - single_t - sum(t for _, t, _ in ends_top), total.v - single_v - sum(v for _, _, v in ends_top)
    return Units(words, known, ends, total.n + ends, total.v + (ends > 0), ends_top, rest)


class Network:
    """A GRU over units with a class-factored softmax, in float32."""

    def __init__(self, units: Units, hidden: int = HIDDEN, seed: int = 7):
        r, u = np.random.default_rng(seed), len(units.cls)
        make = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.hidden, self.cls, self.place = hidden, units.cls, units.place
        self.p = {"wx": make(u, 3 * hidden), "wh": make(hidden, 3 * hidden), "bh": np.zeros(3 * hidden, np.float32), "wc": make(hidden, len(units.members)), "bc": np.zeros(len(units.members), np.float32)}
        for c, m in enumerate(units.members):
            self.p[f"wu{c}"], self.p[f"bu{c}"] = make(hidden, len(m)), np.zeros(len(m), np.float32)
        self.n_classes = len(units.members)
        self.flat = np.concatenate([x.ravel() for x in self.p.values()])
        self.moments, self.steps = np.zeros((2, len(self.flat)), np.float32), 0
        self.p = self.named(self.flat)

    def named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of an array like ``flat``, by the names and shapes of the weights."""
        out, at = {}, 0
        for k, x in self.p.items():
            out[k] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return out

    def state(self) -> np.ndarray:
        """Weights, moments and number of steps, end to end."""
        return np.concatenate([self.flat, *self.moments, np.array([self.steps])]).astype(np.float64)

    def restore(self, state: np.ndarray) -> None:
        n = len(self.flat)
        self.flat[:], self.moments[:] = state[:n], state[n : 3 * n].reshape(2, n)
        self.steps = round(float(state[3 * n]))

    def inputs(self, before: np.ndarray) -> np.ndarray:
        """What the units before put into the gates, with the biases of update and reset: window by window, not step by step."""
        table = self.p["wx"].copy()
        table[:, : 2 * self.hidden] += self.p["bh"][: 2 * self.hidden]
        return table[before]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after h; and update, reset and candidate, and the state's part of the candidate before the reset."""
        H, g = self.hidden, h @ self.p["wh"]
        zr = g[:, : 2 * H] + x[:, : 2 * H]
        zr *= np.float32(0.5)
        np.tanh(zr, out=zr)  # a sigmoid is a hyperbolic tangent of half its argument, moved and halved
        zr *= np.float32(0.5)
        zr += np.float32(0.5)
        z, r, gn = zr[:, :H], zr[:, H:], g[:, 2 * H :] + self.p["bh"][2 * H :]
        n = r * gn
        n += x[:, 2 * H :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, gn

    def outputs(self, states: np.ndarray, units: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log (natural) probability of each unit in its state; with grad, gradients are added and d states returned."""
        cls = self.cls[units]
        at = np.arange(len(units))
        # One column a token, so that maxima and sums go along rows of memory.
        a = self.p["wc"].T @ states.T
        a += self.p["bc"][:, None]
        a -= a.max(axis=0)
        e = np.exp(a)
        s = e.sum(axis=0)
        logp = a[cls, at] - np.log(s)
        back = None
        if grad is not None:
            e /= s
            e[cls, at] -= 1
            grad["wc"][:], grad["bc"][:] = (e @ states).T, e.sum(axis=1)
            back = e.T @ self.p["wc"].T
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.n_classes + 1))
        for c in range(self.n_classes):
            mine = order[bounds[c] : bounds[c + 1]]
            w = self.p[f"wu{c}"]
            if w.shape[1] == 1 or not len(mine):
                continue
            hs, to = states[mine], self.place[units[mine]]
            b = w.T @ hs.T
            b += self.p[f"bu{c}"][:, None]
            b -= b.max(axis=0)
            e = np.exp(b)
            s = e.sum(axis=0)
            own = np.arange(len(mine))
            logp[mine] += b[to, own] - np.log(s)
            if grad is not None:
                e /= s
                e[to, own] -= 1
                grad[f"wu{c}"][:], grad[f"bu{c}"][:] = (e @ hs).T, e.sum(axis=1)
                back[mine] += e.T @ w.T
        return logp, back

    def train(self, texts: list[np.ndarray], end: int, lanes: int = 128, window: int = 48, rate: float = 0.01) -> int:
        """One pass of truncated backpropagation through time with Adam over whole unit sequences; the tokens seen."""
        H, seen = self.hidden, 0
        plan = Lanes(texts, end, lanes)
        h = np.zeros((plan.width, H), np.float32)
        total = np.empty_like(self.flat)
        grad = self.named(total)
        for unit, before, fresh, _ in plan.windows(window):
            steps, live = unit.shape
            h, x = h[:live], self.inputs(before)
            old, states, z, r, n, gn = (np.empty((steps, live, H), np.float32) for _ in range(6))
            stay = (~fresh)[:, :, None].astype(np.float32)
            begins = fresh.any(axis=1)
            for i in range(steps):
                old[i] = h * stay[i] if begins[i] else h
                h, z[i], r[i], n[i], gn[i] = self.step(x[i], old[i])
                states[i] = h
            real = unit >= 0
            total[:] = 0
            _, d_states = self.outputs(states[real], unit[real], grad)
            d_all = np.zeros_like(states)
            d_all[real] = d_states
            # What a change of the state does to candidate, update and reset, for all steps at a time.
            to_n, to_z, to_r = (1 - z) * (1 - n * n), (old - n) * z * (1 - z), gn * r * (1 - r)
            carry, back = np.zeros((live, H), np.float32), np.ascontiguousarray(self.p["wh"].T)
            dxs, dgs = np.empty((2, steps, live, 3 * H), np.float32)
            for i in reversed(range(steps)):
                dh, dx, dg = d_all[i] + carry, dxs[i], dgs[i]
                np.multiply(dh, to_z[i], out=dx[:, :H])
                dn = np.multiply(dh, to_n[i], out=dx[:, 2 * H :])
                np.multiply(dn, to_r[i], out=dx[:, H : 2 * H])
                dg[:, : 2 * H] = dx[:, : 2 * H]
                np.multiply(dn, r[i], out=dg[:, 2 * H :])
                carry = dg @ back
                dh *= z[i]
                carry += dh
                if begins[i]:
                    carry *= stay[i]
            dxs, dgs = dxs.reshape(-1, 3 * H), dgs.reshape(-1, 3 * H)
            grad["wh"][:], grad["bh"][:] = old.reshape(-1, H).T @ dgs, dgs.sum(axis=0)
            order = np.argsort(before, axis=None, kind="stable")
            at = before.ravel()[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            grad["wx"][at[first]] = np.add.reduceat(dxs[order], first, axis=0)
            count = int(real.sum())
            seen += count
            self.steps += 1
            g = np.clip(total / max(1, count), -0.1, 0.1)
            m1, m2 = self.moments
            m1 += np.float32(0.1) * (g - m1)
            m2 += np.float32(0.01) * (g * g - m2)
            self.flat -= np.float32(rate / (1 - 0.9**self.steps)) * m1 / (np.sqrt(m2 / np.float32(1 - 0.99**self.steps)) + np.float32(1e-6))
        return seen

    def score(self, texts: list[np.ndarray], end: int, lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
        """log10 probability of the units and end of each whole text."""
        out, plan = np.zeros(len(texts)), Lanes(texts, end, lanes)
        h = np.zeros((plan.width, self.hidden), np.float32)
        for unit, before, fresh, doc in plan.windows(window):
            h, x = h[: unit.shape[1]], self.inputs(before)
            states = np.empty((*unit.shape, self.hidden), np.float32)
            begins = fresh.any(axis=1)
            for i in range(len(unit)):
                if begins[i]:
                    h = h * ~fresh[i][:, None]
                h = states[i] = self.step(x[i], h)[0]
            real = unit >= 0
            logp, _ = self.outputs(states[real], unit[real])
            out += np.bincount(doc[real], logp.astype(np.float64), minlength=len(texts))
        return out / np.log(10)


class Lanes:
    """Texts, each with its end, laid end to end on lanes of about equal length, longest lane first."""

    def __init__(self, texts: list[np.ndarray], end: int, lanes: int):
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        heap = [(0, k) for k in range(max(1, min(lanes, len(texts))))]
        lane, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i in np.argsort(-sizes, kind="stable").tolist():
            n, k = heapq.heappop(heap)
            lane[i], start[i] = k, n
            heapq.heappush(heap, (n + int(sizes[i]), k))
        length = np.zeros(len(heap), np.int64)
        for n, k in heap:
            length[k] = n
        # Lane after lane end to end, longest first: what is held is the tokens themselves, however uneven the lanes are.
        order = np.argsort(-length, kind="stable")
        self.end, self.width, self.length = end, len(heap), length[order]
        self.base = np.cumsum(self.length) - self.length
        base = np.empty(len(heap), np.int64)
        base[order] = self.base
        place = base[lane] + start
        total = int(self.length.sum())
        self.unit, self.doc, self.fresh = np.empty(total, np.int16), np.empty(total, np.int32), np.zeros(total, bool)
        for i, x in enumerate(texts):
            a, b = place[i], place[i] + sizes[i]
            self.unit[a : b - 1], self.unit[b - 1], self.doc[a:b] = x, end, i
        self.fresh[place] = True

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(units, units before, whether a text begins, texts), each steps by live lanes; -1 where a lane has ended."""
        for at in range(0, int(self.length[0]), size):
            live = int((self.length > at).sum())
            steps = min(size, int(self.length[0]) - at)
            step = np.arange(at, at + steps)[:, None]
            over = step >= self.length[:live]
            place = self.base[:live] + np.minimum(step, self.length[:live] - 1)
            unit = np.where(over, -1, self.unit[place]).astype(np.int32)
            fresh = self.fresh[place] & ~over
            before = np.empty_like(unit)
            before[1:] = unit[:-1]
            before[0] = self.unit[place[0] - 1] if at else self.end
            before[fresh | (before < 0)] = self.end
            yield unit, before, fresh, self.doc[place]


def encoded(docs: DataFrame, units: Units) -> DataFrame:
    """Per row of docs, in one pass over the texts: doc_id, n_tokens, known, logc, constant, units (16-bit numbers), rare words and their counts, and a hash r."""
    shared = docs.sparkSession.sparkContext.broadcast(units)
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        for part in parts:
            rows = []
            for text in part.column("text"):
                words = tokens(text.as_py())
                ids, u = units.encode(words)
                met = ids >= 0
                local, inner = units.logc[ids[met]], units.shared[u]
                # inside shared units: log10 (c + 0.5) of the known words, less the unit's log10 sum for all its words
                constant = float(local[units.shared[u[met]]].sum()) - float(units.within[u[inner]].sum())
                rare = [{"word": w, "n": k} for w, k in Counter(words[i] for i in np.flatnonzero(~met)).items()]
                rows.append((len(words) + 1, int(met.sum()) + (units.ends > 0), float(local.sum()) + units.log_end, constant, u.astype(np.int16).tobytes(), rare))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rare_type)
            columns = [pa.array([r[k] for r in rows], x) for k, x in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, part.column("r")], ["doc_id", "n_tokens", "known", "logc", "constant", "units", "rare", "r"])

    rows = map_batches(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r")), run, "doc_id long, n_tokens long, known long, logc double, constant double, units binary, rare array<struct<word:binary,n:long>>, r long")
    return rows.withColumn("row", F.monotonically_increasing_id())


def train_round(rows: DataFrame, units: Units, state: np.ndarray, shards: int, rate: float) -> DataFrame:
    """(piece, tokens, v): sums over shards of their tokens, and of their states times tokens in pieces of ``PIECE`` numbers."""
    shared = rows.sparkSession.sparkContext.broadcast((units, state))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, state = shared.value
        net, now, seen, held, n = Network(units), None, 0, [], 0

        def flush() -> None:
            nonlocal seen, held, n
            if held:
                seen += net.train(held, units.end, rate=rate)
            held, n = [], 0

        def out() -> pa.RecordBatch:
            v = np.append(net.state(), np.zeros(-len(state) % PIECE)) * seen
            k = len(v) // PIECE
            lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * PIECE), pa.array(v))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, seen, np.int64)), lists], ["piece", "tokens", "v"])

        for part in parts:
            for shard, x in zip(part.column("shard").to_pylist(), part.column("units"), strict=True):
                if shard != now:
                    flush()
                    if now is not None:
                        yield out()
                    now, seen = shard, 0
                    net.restore(state)
                held.append(np.frombuffer(x.as_py(), np.int16))
                n += len(held[-1]) + 1
                if n >= STRIDE:
                    flush()
        flush()
        if now is not None:
            yield out()

    dealt = rows.withColumn("shard", F.pmod("r", F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", "r")
    pieces = map_batches(dealt, run, "piece int, tokens long, v array<double>")
    return pieces.groupBy("piece").agg(F.sum("tokens").alias("tokens"), F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(PIECE))).alias("v"))


def fit(rows: DataFrame, units: Units) -> Network:
    """A network trained on all rows (r, units), whole, in one pass: each round averages what the shards have learned."""
    net = Network(units)
    shards = max(1, -(-units.total // SHARD))
    for k in range(ROUNDS):
        mine = rows.filter(F.pmod(F.shiftrightunsigned("r", 40), F.lit(ROUNDS)) == k)
        found = sorted(cut(train_round(mine, units, net.state(), shards, 0.01 * 0.5**k), "weights").collect())
        if found:
            net.restore(np.concatenate([np.array(r.v) / r.tokens for r in found])[: len(net.state())])
    return net


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = cut(count_words(docs), "counts")
    units = learn_units(docs, counts)
    rows = cut(encoded(docs, units), "encoded")
    net = fit(rows.filter(~held_out()).select("r", "units"), units)
    shared = docs.sparkSession.sparkContext.broadcast((units.end, net))
    kept = ("row", "doc_id", "n_tokens", "known", "logc")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, net = shared.value
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            scores = net.score([np.frombuffer(x.as_py(), np.int16) for x in part.column("units")], end) + part.column("constant").to_numpy()
            return pa.RecordBatch.from_arrays([*(part.column(x).combine_chunks() for x in kept), pa.array(scores)], [*kept, "model"])

        for part in parts:
            if len(part):
                held.append(part)
                size += int(part.column("n_tokens").to_numpy().sum())
            # Many texts at a time: the longest one's steps are those of all.
            if size >= STRIDE:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    scored = map_batches(rows.select(*kept, "constant", "units"), run, "row long, doc_id long, n_tokens long, known long, logc double, model double")
    met = rows.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n").join(counts, "word", "left")
    sums = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("seen"))
    out = scored.join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(units.total).cast("long").alias("train_tokens"),
        (F.col("logc") + more - F.col("n_tokens") * F.lit(float(units.base))).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores."""
    return score_documents(table(spark, sf_dir, "documents"))
