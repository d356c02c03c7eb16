"""Model members, fusion and calibration with pyspark.ml.

Quality is held to measured gates, not to equal scores with another library. Every fit reads whole
tables; what comes back to the driver is a model's parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, IDFModel, NGram, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import threshold_for_fpr

LEAST_NEGATIVES, FLOOR, LEAST_BLOCK, GAP = 30, 1e-4, 0.5, 0.10


def balanced(rows: DataFrame, label: str = "y") -> DataFrame:
    """Adds weight: both classes weigh the same in sum."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return rows.join(F.broadcast(n), label).join(F.broadcast(total), F.lit(True)).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def _positive(model_rows: DataFrame, name: str) -> DataFrame:
    return model_rows.withColumn(name, vector_to_array("probability")[1])


def _linear(strength: float, n_rows: int) -> list:
    """Unit vectors into a logistic regression; features aren't scaled by their spread, which would make the rarest the loudest."""
    return [Normalizer(inputCol="_w0", outputCol="_x", p=2.0), LogisticRegression(featuresCol="_x", labelCol="y", weightCol="weight", regParam=1.0 / (strength * max(1, n_rows)), standardization=False, maxIter=50)]


_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
_TERM_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789'" else 32 for c in range(256))


def _sparse(ends: np.ndarray, at: np.ndarray, sizes: pa.Array, values: np.ndarray) -> pa.Array:
    """Sparse vectors: where each ends among all places and values."""
    ends = ends.astype(np.int32)
    parts = [pa.array(np.zeros(len(sizes), np.int8)), sizes.cast(pa.int32()), pa.ListArray.from_arrays(ends, at.astype(np.int32)), pa.ListArray.from_arrays(ends, values)]
    return pa.StructArray.from_arrays(parts, fields=list(_VECTOR))


def _units(ends: np.ndarray, at: np.ndarray, idf: np.ndarray) -> pa.Array:
    """Unit vectors of the texts whose distinct places are given; places without weight are left out."""
    owner, n = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), len(ends) - 1
    some = idf[at] > 0
    owner, at = owner[some], at[some]
    length = np.sqrt(np.bincount(owner, idf[at] ** 2, minlength=n))
    return _sparse(np.searchsorted(owner, np.arange(n + 1)), at, pa.array(np.full(n, len(idf), np.int32)), idf[at] / length[owner])


def _words(texts: pa.Array) -> list[list[bytes]]:
    """The words of each text, as ``RegexTokenizer`` finds them."""
    return [(t or "").lower().encode("utf-8", "replace").translate(_TERM_BYTES).split() for t in texts.to_pylist()]


def _owners(each: list[list[bytes]]) -> np.ndarray:
    return np.repeat(np.arange(len(each), dtype=np.int64), np.array([len(x) for x in each], np.int64))


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and then their pairs of words, and of each its text."""
    each = _words(texts)
    owner, words = _owners(each), pa.array(list(chain.from_iterable(each)), pa.string())
    if len(words) < 2:
        return words, owner
    inside = owner[1:] == owner[:-1]
    pairs = pc.binary_join_element_wise(words[:-1], words[1:], " ").filter(pa.array(inside))
    return pa.concat_arrays([words, pairs]), np.concatenate([owner, owner[1:][inside]])


def _once(x: np.ndarray) -> np.ndarray:
    """Distinct numbers in order, by a sort: NumPy's own way hashes them, which takes several times as long."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


class Lexicon(NamedTuple):
    """A vocabulary by numbers: of each word its number and its place (-1: none), and of each pair, in order of its words' numbers, its place."""

    size: int
    words: dict[bytes, int]
    own: np.ndarray
    pairs: np.ndarray
    at: np.ndarray


def lexicon(names: list[str]) -> Lexicon:
    words: dict[bytes, int] = {}
    parts = [[words.setdefault(w, len(words)) for w in name.encode().split(b" ")] for name in names]
    own, width = np.full(len(words) + 1, -1, np.int64), len(words) + 1
    own[[x[0] for x in parts if len(x) == 1]] = [i for i, x in enumerate(parts) if len(x) == 1]
    pairs = np.array([x[0] * width + x[1] for x in parts if len(x) == 2], np.int64)
    order = np.argsort(pairs)
    return Lexicon(len(names), words, own, pairs[order], np.array([i for i, x in enumerate(parts) if len(x) == 2], np.int64)[order])


def _term_places(texts: pa.Array, known: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The places in the vocabulary of each text's distinct terms, in order: where each text's end, and all of them."""
    each, width = _words(texts), len(known.own)
    owner = _owners(each)
    word = np.fromiter(map(known.words.get, chain.from_iterable(each), repeat(width - 1)), np.int64, len(owner))
    own = known.own[word]
    found = [(owner * known.size + own)[own >= 0]]
    if len(known.pairs) and len(word) > 1:
        inside = (owner[1:] == owner[:-1]) & (word[1:] < width - 1) & (word[:-1] < width - 1)
        pair, of = (word[:-1] * width + word[1:])[inside], owner[1:][inside]
        at = np.minimum(np.searchsorted(known.pairs, pair), len(known.pairs) - 1)
        hit = known.pairs[at] == pair
        found.append(of[hit] * known.size + known.at[at[hit]])
    found = _once(np.concatenate(found))
    return np.searchsorted(found, np.arange(len(texts) + 1, dtype=np.int64) * known.size), found % max(1, known.size)


def vocabulary(rows: DataFrame, text: str, most: int, least: int = 2) -> pa.Table:
    """(term): of the words and word pairs that ``least`` texts have, the ``most`` frequent, by falling frequency and by name."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            terms, owner = _terms(part.column(0))
            coded = terms.dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            once = _once(owner * len(names) + code) % max(1, len(names))
            yield pa.RecordBatch.from_arrays([names, *(pa.array(np.bincount(x, minlength=len(names))) for x in (code, once))], ["term", "n", "held"])

    counted = rows.select(text).mapInArrow(count, "term string, n long, held long")
    found = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("held").alias("held")).filter(F.col("held") >= least)
    return found.orderBy(F.desc("n"), "term").limit(most).select("term").toArrow()


class WordMember(NamedTuple):
    """Words and word pairs that at least two texts have, the most frequent ``features`` of them, with inverse document frequencies, into a logistic regression.

    Its model has the stages of a pipeline of pyspark.ml; to fit it, texts are cut into terms batch by batch.
    """

    text: str
    features: int
    strength: float
    n_rows: int

    def fit(self, rows: DataFrame) -> PipelineModel:
        with_functions(rows.sparkSession)
        names = vocabulary(rows, self.text, self.features)
        if not len(names):
            raise ValueError("no word stands in two of the texts to fit")
        # The model is made of the vocabulary as a table: given as a list, each term would be a call to the JVM.
        known = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=self.features, minDF=1.0, binary=True).fit(rows.sparkSession.createDataFrame(names).select(F.array("term").alias("_terms")))
        held = known.vocabulary

        @F.arrow_udf(VectorUDT())
        def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = lexicon(held)
            for part in texts:
                ends, at = _term_places(part, own)
                yield _sparse(ends, at, pa.array(np.full(len(part), own.size, np.int32)), np.ones(len(at)))

        idf = IDF(inputCol="_tf", outputCol="_w0").fit(rows.select(counted(self.text).alias("_tf")))
        weights = idf.idf.toArray()

        @F.arrow_udf(VectorUDT())
        def unit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = lexicon(held)
            for part in texts:
                yield _units(*_term_places(part, own), weights)

        scaled, linear = _linear(self.strength, self.n_rows)
        return PipelineModel(
            [
                RegexTokenizer(inputCol=self.text, outputCol="_w", pattern=r"[a-z0-9']+", gaps=False, toLowercase=True),
                NGram(n=2, inputCol="_w", outputCol="_w2"),
                SQLTransformer(statement="SELECT *, concat(_w, _w2) AS _terms FROM __THIS__"),
                known,
                idf,
                scaled,
                linear.fit(rows.select("y", "weight", unit(self.text).alias("_x"))),
            ]
        )


def word_member(text: str = "text", features: int = 1 << 16, strength: float = 4.0, n_rows: int = 1000) -> WordMember:
    return WordMember(text, features, strength, n_rows)


#: Lengths of the fragments that ``char_member`` reads, and the name of its function in SQL.
FRAGMENTS, HASHED = (3, 4, 5), "mail_char_fragments"
_SHARES = pa.list_(pa.struct([("term", pa.string()), ("contribution", pa.float64()), ("place", pa.int32())]))
_FRAGMENT = pa.list_(pa.struct([("at", pa.int32()), ("term", pa.string())]))


def _mixed(h: np.ndarray, points: np.ndarray, v: np.ndarray) -> None:
    """Takes one more character into each hash; v is scratch."""
    h ^= points
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= np.right_shift(h, np.uint64(29), out=v)


def _begun() -> dict[int, np.ndarray]:
    """For each length, the hashes of a fragment's first two characters, where both are in ASCII."""
    one, out = np.arange(128, dtype=np.uint64), {}
    for n in FRAGMENTS:
        h = np.full(128 * 128, n, np.uint64)
        for points in (np.repeat(one, 128), np.tile(one, 128)):
            _mixed(h, points, np.empty_like(h))
        out[n] = h
    return out


_BEGUN = _begun()


def _places(low: str, features: int) -> list[np.ndarray]:
    """Of the fragments of each length of a text in lower case, as they stand in it: their places among ``features``."""
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, part = [], np.empty(len(points), np.uint64)
    two = (points[:-1] * np.uint64(128) + points[1:]).astype(np.intp) if low.isascii() else None
    for n in FRAGMENTS:
        size = max(0, len(points) - n + 1)
        h = np.full(size, n, np.uint64) if two is None else _BEGUN[n].take(two[:size])
        for i in range(0 if two is None else 2, n):
            _mixed(h, points[i : size + i], part[:size])
        out.append((h & np.uint64(features - 1) if features & (features - 1) == 0 else h % np.uint64(features)).astype(np.int32))
    return out


def _distinct(texts: pa.Array, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of each text's fragments, in order: where each text's end, and all of them."""
    each = []
    mark = np.zeros(max(sizes, default=0), bool)
    for t, n in zip(texts.to_pylist(), sizes, strict=True):
        places = np.concatenate(_places((t or "").lower(), n))
        if len(places) < n >> 3:
            places.sort()
            each.append(places[np.diff(places, prepend=np.int32(-1)) > 0])
            continue
        mark[places] = True  # in order and once each, without a sort: it reads all n marks, so it is for long texts
        each.append(np.flatnonzero(mark[:n]).astype(np.int32))
        mark[each[-1]] = False
    return np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)]), np.concatenate([np.zeros(0, np.int32), *each])


def _vectors(texts: pa.Array, features: pa.Array) -> pa.Array:
    """Of each text, its distinct places as a sparse vector of ones."""
    ends, at = _distinct(texts, features.to_pylist())
    return _sparse(ends, at, features, np.ones(len(at)))


def _heaviest(text: str | None, idf: np.ndarray, weights: np.ndarray, k: int) -> list[dict]:
    """The k fragments of a text that weigh most: each place once, by its first fragment; equal weights by name."""
    low = (text or "").lower()
    places = [x.astype(np.int64) for x in _places(low, len(idf))]
    at = np.unique(np.concatenate(places))
    at = at[idf[at] > 0]
    share = weights[at] * idf[at] / np.sqrt((idf[at] * idf[at]).sum())
    if len(at) > k:
        keep = np.abs(share) >= np.partition(np.abs(share), len(at) - k)[len(at) - k]
        at, share = at[keep], share[keep]
    first: dict[int, str] = {}
    for n, found in zip(FRAGMENTS, places, strict=True):
        for i in np.flatnonzero(np.isin(found, at)):
            term, here = low[i : i + n], int(found[i])
            first[here] = min(term, first.get(here, term))
    order = sorted((-abs(s), first[int(p)], s) for p, s in zip(at, share, strict=True))[:k]
    return [{"term": t, "contribution": float(s), "place": i} for i, (_, t, s) in enumerate(order, 1)]


def char_contributions(text: Column, idf: np.ndarray, weights: np.ndarray, k: int) -> Column:
    """(term, contribution, place) of the k fragments that weigh most in ``char_member``'s log-odds; a task holds the member's weights."""

    @F.arrow_udf("array<struct<term: string, contribution: double, place: int>>")
    def heaviest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array([_heaviest(t, idf, weights, k) for t in part.to_pylist()], _SHARES)

    return heaviest(text)


def _heaviest_terms(texts: pa.Array, known: Lexicon, names: list[str], idf: np.ndarray, weights: np.ndarray, k: int) -> list[list[dict]]:
    """The k terms of each text that weigh most; equal weights by name."""
    ends, at = _term_places(texts, known)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    length = np.sqrt(np.bincount(owner, idf[at] ** 2, minlength=len(texts)))
    share = weights[at] * idf[at] / np.where(length > 0, length, 1.0)[owner]
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own, mine = share[a:b], at[a:b]
        if b - a > k:
            heavy = np.abs(own)
            keep = heavy >= np.partition(heavy, b - a - k)[b - a - k]
            own, mine = own[keep], mine[keep]
        order = sorted((-abs(s), names[p], s) for s, p in zip(own.tolist(), mine.tolist(), strict=True))[:k]
        out.append([{"term": t, "contribution": s, "place": i} for i, (_, t, s) in enumerate(order, 1)])
    return out


def term_contributions(text: Column, names: list[str], idf: np.ndarray, weights: np.ndarray, k: int) -> Column:
    """(term, contribution, place) of the k terms that weigh most in ``word_member``'s log-odds; a task holds the member's vocabulary."""

    @F.arrow_udf("array<struct<term: string, contribution: double, place: int>>")
    def heaviest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = lexicon(names)
        for part in texts:
            yield pa.array(_heaviest_terms(part, known, names, idf, weights, k), _SHARES)

    return heaviest(text)


def _listed(texts: Iterator[pa.Array], features: int) -> Iterator[pa.Array]:
    for part in texts:
        out = []
        for t in part.to_pylist():
            low = (t or "").lower()
            pairs = {(int(x), low[i : i + n]) for n, found in zip(FRAGMENTS, _places(low, features), strict=True) for i, x in enumerate(found)}
            out.append([{"at": x, "term": f} for x, f in pairs])
        yield pa.array(out, _FRAGMENT)


def char_fragments(text: Column, features: int) -> Column:
    """(at, term) of the distinct fragments of a text: what the places of ``char_member``'s vectors stand for."""

    @F.arrow_udf("array<struct<at: int, term: string>>")
    def listed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _listed(texts, features)

    return listed(text)


#: Bytes of text that a Python worker takes at a time: its vectors are several times larger.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def with_functions(spark: SparkSession) -> None:
    """Registers what ``char_member``'s statement names; a session that loads such a model needs it too."""
    if int("".join(filter(str.isdigit, spark.conf.get(BATCH_SETTING)))) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")

    @F.arrow_udf(VectorUDT())
    def hashed(texts: pa.Array, features: pa.Array) -> pa.Array:
        return _vectors(texts, features)

    spark.udf.register(HASHED, hashed)


class CharMember(NamedTuple):
    """Character 3- to 5-grams, hashed, into a logistic regression. Texts are hashed batch by batch, so no fragment becomes a string of its own."""

    text: str
    features: int
    strength: float
    n_rows: int

    def fit(self, rows: DataFrame) -> PipelineModel:
        with_functions(rows.sparkSession)
        hashed = SQLTransformer(statement=f"SELECT *, {HASHED}({self.text}, {self.features}) AS _tf FROM __THIS__")
        idf = IDF(inputCol="_tf", outputCol="_w0", minDocFreq=3).fit(hashed.transform(rows.select(self.text)))
        weights = idf.idf.toArray()

        @F.arrow_udf(VectorUDT())
        def unit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in texts:
                yield _units(*_distinct(part, [len(weights)] * len(part)), weights)

        scaled, linear = _linear(self.strength, self.n_rows)
        return PipelineModel([hashed, idf, scaled, linear.fit(rows.select("y", "weight", unit(self.text).alias("_x")))])


def char_member(text: str = "text", features: int = 1 << 18, strength: float = 4.0, n_rows: int = 1000) -> CharMember:
    return CharMember(text, features, strength, n_rows)


class Linear(NamedTuple):
    """What a text member's score is made of; its vocabulary, or None where fragments are hashed."""

    vocabulary: list[str] | None
    idf: np.ndarray
    weights: np.ndarray
    intercept: float

    def log_odds(self, texts: pa.Array, known: Lexicon | None) -> np.ndarray:
        """The member's log-odds of each text, as its stages work them out; known: its vocabulary's ``lexicon``."""
        share, square = self.weights * self.idf, self.idf * self.idf
        if known is None:
            found, last = np.zeros((2, len(texts))), np.empty(len(self.idf), np.intp)
            for i, t in enumerate(texts.to_pylist()):
                places = np.concatenate(_places((t or "").lower(), len(self.idf))).astype(np.intp)
                order = np.arange(len(places))
                last[places] = order
                at = places.take(np.flatnonzero(last.take(places) == order))  # each place once, without a sort
                found[:, i] = share.take(at).sum(), square.take(at).sum()
            up, length = found
        else:
            ends, at = _term_places(texts, known)
            owner = np.repeat(np.arange(len(texts)), np.diff(ends))
            up, length = (np.bincount(owner, x[at], minlength=len(texts)) for x in (share, square))
        return up / np.sqrt(np.where(length > 0, length, 1.0)) + self.intercept


def linear(model: PipelineModel) -> Linear | None:
    """A fitted ``word_member`` or ``char_member``; None of other models."""
    idf = next((s for s in model.stages if isinstance(s, IDFModel)), None)
    if idf is None or not any(isinstance(s, SQLTransformer) for s in model.stages):
        return None
    names = next((s.vocabulary for s in model.stages if isinstance(s, CountVectorizerModel)), None)
    return Linear(names, idf.idf.toArray(), model.stages[-1].coefficients.toArray(), float(model.stages[-1].intercept))


def text_scores(members: dict[str, Linear], text: Column) -> Column:
    """A struct of the scores that text members give: a text is cut and looked up where it is read, and no vector is made of it."""

    @F.arrow_udf(", ".join(f"{name} double" for name in members))
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = {name: None if m.vocabulary is None else lexicon(m.vocabulary) for name, m in members.items()}
        for part in texts:
            with np.errstate(over="ignore"):
                found = [pa.array(1.0 / (1.0 + np.exp(-m.log_odds(part, known[name])))) for name, m in members.items()]
            yield pa.StructArray.from_arrays(found, names=list(members))

    return scored(text)


def tree_member(columns: list[str], trees: int = 40, depth: int = 5, rate: float = 0.1) -> Pipeline:
    """Gradient-boosted trees on feature columns."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep"), GBTClassifier(featuresCol="_x", labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=20, seed=7)])


def vocabulary_member(text: str = "text", size: int = 60_000) -> Pipeline:
    """Words by an exact vocabulary, for token contributions that can be read."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[a-z0-9']+", gaps=False, toLowercase=True),
            CountVectorizer(inputCol="_w", outputCol="_tf", vocabSize=size, minDF=2.0),
            IDF(inputCol="_tf", outputCol="_x"),
            LogisticRegression(featuresCol="_x", labelCol="y", weightCol="weight", regParam=1e-3, maxIter=50),
        ]
    )


def member_scores(members: dict[str, object], rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and one score column for each fitted member; the text members score in one pass."""
    of_text = {name: found for name, model in members.items() if isinstance(model, PipelineModel) and (found := linear(model))}
    out = rows
    if of_text:
        with_functions(rows.sparkSession)
        scored = text_scores(of_text, F.col(text))
        out = rows.withColumns({name: scored[name] for name in of_text})
    for name, model in members.items():
        if name not in of_text:
            before = out.columns
            out = _positive(model.transform(out), name).select(*before, name)
    return out.select(*keep, *members)


def pools(rows: DataFrame, group: str, shares: tuple[float, float] = (0.2, 0.2)) -> DataFrame:
    """Adds pool (cal, stack or fit): whole groups by a hash of their key, never split."""
    at = F.pmod(F.xxhash64(F.col(group)), F.lit(10_000)) / 10_000.0
    return rows.withColumn("pool", F.when(at < shares[0], "cal").when(at < shares[0] + shares[1], "stack").otherwise("fit"))


def fuse(scores: DataFrame, members: list[str]):
    """A logistic regression over member scores."""
    return Pipeline(stages=[VectorAssembler(inputCols=members, outputCol="_m"), LogisticRegression(featuresCol="_m", labelCol="y", weightCol="weight", regParam=1e-3)]).fit(balanced(scores))


def calibrate(fused: DataFrame, score: str = "raw"):
    """Isotonic calibration on fused scores; ties are averaged first."""
    tied = fused.groupBy(score).agg(F.avg("y").alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
    return IsotonicRegression(featuresCol=score, labelCol="label", weightCol="w").fit(tied.withColumn(score, F.col(score).cast("double")))


def fit_detector(rows: DataFrame, columns: list[str], group: str, trees: int = 40, features: int = 1 << 16) -> tuple[dict, object, object]:
    """(members, fusion, calibration) on three disjoint pools of (id, y, text, columns, group)."""
    parted = pools(rows, group)
    fit, stack, cal = (parted.filter(F.col("pool") == p) for p in ("fit", "stack", "cal"))
    weighted = balanced(fit).cache()
    n = weighted.count()
    members = {"m_trees": tree_member(columns, trees).fit(weighted), "m_words": word_member(features=features, n_rows=n).fit(weighted), "m_chars": char_member(features=features, n_rows=n).fit(weighted)}
    weighted.unpersist()
    fusion = fuse(member_scores(members, stack, ["y"]), list(members))
    raw = _positive(fusion.transform(member_scores(members, cal, ["y"])), "raw").select("y", "raw")
    return members, fusion, calibrate(raw)


def apply_detector(detector: tuple[dict, object, object], rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, member scores, raw and calibrated score."""
    members, fusion, calibration = detector
    x = _positive(fusion.transform(member_scores(members, rows, keep)), "raw").select(*keep, *members, "raw")
    return calibration.transform(x).withColumn("score", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("prediction")


def thresholds(scored: DataFrame, review_fpr: float = 0.06, block_fpr: float = 0.004, configured: tuple[float, float] = (0.40, 0.80)) -> tuple[float, float, str]:
    """(review, block, reason) from budgets of false alarms; the configured pair where they can't be trusted."""
    if scored.filter("y = 0").count() < LEAST_NEGATIVES:
        return *configured, "too few negatives"
    found = {r.target: r.threshold for r in threshold_for_fpr(scored, (review_fpr, block_fpr)).collect()}
    review, block = max(found[review_fpr], FLOOR), max(found[block_fpr], LEAST_BLOCK)
    return (review, block, "budgets") if block - review >= GAP else (*configured, "thresholds too close")


def token_contributions(model, rows: DataFrame, id: str, k: int = 10) -> DataFrame:
    """The k terms of each row with the largest share of the log-odds, of a ``vocabulary_member`` fit."""
    vocabulary, weights = model.stages[1].vocabulary, model.stages[-1].coefficients.toArray()
    table = rows.sparkSession.createDataFrame([(i, t, float(w)) for i, (t, w) in enumerate(zip(vocabulary, weights, strict=True))], "i int, term string, w double")  # the vocabulary's size
    x = model.transform(rows).select(id, F.posexplode(vector_to_array("_x")).alias("i", "v")).filter("v <> 0")
    x = x.join(F.broadcast(table), "i").select(id, "term", (F.col("v") * F.col("w")).alias("contribution"))
    order = Window.partitionBy(id).orderBy(F.desc(F.abs("contribution")), "term")
    return x.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
