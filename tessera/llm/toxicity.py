"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The terms are all words of the labelled rows, and the beginnings of words that mark label 1 in them beyond chance (a
Chernoff bound over all that were tried; copies of a text count once). Each text becomes a vector of these terms, its
weights from term counts in the text and from document counts over the whole corpus. Words that no labelled row has are
no part of the space. Every text with a term is searched. The K nearest examples vote, weighted by their cosine; a text without any term gets the rate of label 1 among
examples without terms. The share of votes is smoothed towards the rate among all, so that few or distant examples say
little, and a logistic curve makes a calibrated score of it: it is fitted to the shares that at most CALIBRATED examples
(those with the smallest hash) get from the others. One kind of label alone leaves the shares as they are.

At most MAX_LABELLED labelled rows are used, those with the smallest hash of their doc_id. Of several labels of one
document the highest counts, and of several texts of a labelled doc_id the one with the smallest hash is the example. Of
the examples whose vector equals a text's, one has no vote: it may be the text itself.

Null texts count as empty. Without usable labels every score is 0. Long texts are read whole. Equal texts get equal scores;
equally near examples are taken in the order of their vectors, then of doc_id. Extra columns of the documents pass through
``score_texts``, but for those named like an output column; those of the labels are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import HELD, cut_lineage, let_go_for, let_go_of_memory, map_rows, share, slices, values_of, written

MAX_LABELLED = 20_000
CALIBRATED = 4_000
K = 32
#: Examples in a block, and how many times k examples lie in the blocks that are read first.
BLOCK, OPENING = 16, 8
SMOOTHING = 1.0
#: At most so many terms, the commonest of those that one in SPARSE examples has or more, are columns of a dense table.
COMMON, SPARSE = 256, 64
#: Texts that are searched together, and more than the error of single precision in a cosine.
TOGETHER, MARGIN = 32, 1e-4
#: Counts of a term whose logarithm is looked up.
LOGS = 4096
#: Natural logarithm of the inverse of the expected number of terms chosen by chance.
CERTAINTY = 3.0
THRESHOLD = 0.3
EVIDENCE = 3

#: Lengths of the beginnings of longer words that may become terms.
BEGINNINGS = (3, 4, 5, 6)
#: Signs that a task counts before it hands them on.
COUNTED = 500_000
#: Texts whose scores a task keeps.
KEPT = 20_000

WORD = re.compile(r"\w+")
VECTOR = T.StructType([T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def signs(text: str | None) -> set[str]:
    """What of a text may become a term: its words, and their beginnings."""
    found = set(words(text))
    return found.union(*[{w[:k] + "-" for w in found if len(w) > k} for k in BEGINNINGS])


def examples_of(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id and toxic (0 or 1) of the labelled rows to learn from, at most ``limit``."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    each = usable.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def sign_counts(texts: DataFrame) -> DataFrame:
    """Each sign of ``texts`` (text, toxic) and the numbers n and n_toxic of those that have it; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        n_toxic: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            rows = [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([n_toxic[s] for s in n], pa.int64())]
            n.clear()
            n_toxic.clear()
            return pa.RecordBatch.from_arrays(rows, names=["word", "n", "n_toxic"])

        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = signs(text)
                n.update(own)
                if toxic:
                    n_toxic.update(own)
                if len(n) >= COUNTED:
                    yield handed_on()
        yield handed_on()

    counted = texts.select("text", "toxic").mapInArrow(run, "word string, n long, n_toxic long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def terms_of(texts: DataFrame) -> list[str]:
    """All words of ``texts`` (text, toxic), and the beginnings of words that mark toxic = 1 there."""
    texts = texts.groupBy(F.xxhash64("text").alias("hash")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    counted = cut_lineage(sign_counts(texts))
    chosen = ~F.col("word").endswith("-")
    rate = texts.agg(F.avg("toxic")).first()[0]
    if rate and rate < 1:
        least = float(np.log(max(1, counted.filter("n > 1").count()))) + CERTAINTY
        p = F.lit(float(rate))
        share = F.col("n_toxic") / F.col("n")
        gain = F.col("n_toxic") * F.log(share / p) + F.when(share < 1, (F.col("n") - F.col("n_toxic")) * F.log((1 - share) / (1 - p))).otherwise(0.0)
        chosen = chosen | ((F.col("n") > 1) & (share > p) & (gain >= least))
    return sorted(counted.filter(chosen).select("word").toArrow().column("word").to_pylist())  # bounded by the words of the labelled sample


class Vectorizer:
    """Terms of a text and their counts."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        #: The beginnings among the terms, by their first letters.
        self.starts: dict[str, list[tuple[str, int]]] = {}
        for sign, t in terms.items():
            if sign.endswith("-"):
                self.starts.setdefault(sign[: BEGINNINGS[0]], []).append((sign[:-1], t))

    def __call__(self, text: str | None) -> tuple[list[int], list[int]]:
        terms, starts = self.terms, self.starts
        own = Counter(words(text))
        counts = dict(zip(map(terms.get, own), own.values(), strict=True))
        counts.pop(None, None)
        if starts:
            for word, n in own.items():
                for start, t in starts.get(word[: BEGINNINGS[0]], ()):
                    if len(word) > len(start) and word.startswith(start):
                        counts[t] = counts.get(t, 0) + n
        found = sorted(counts)
        return found, [counts[t] for t in found]


def weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vector on ``terms``."""
    raw = (1 + np.log(counts)) * idf[terms]
    return raw / np.sqrt((raw * raw).sum()) if len(raw) else raw


def vector_key(terms: np.ndarray, counts: np.ndarray) -> bytes:
    return hashlib.blake2b(np.asarray(terms, np.int32).tobytes() + np.asarray(counts, np.int32).tobytes(), digest_size=16).digest()


def by_likeness(points: np.ndarray) -> np.ndarray:
    """Order of ``points`` in which each run of BLOCK is alike: halves along the widest direction, again and again.

    The order decides what a search must read, never what it finds.
    """
    order, runs = np.arange(len(points)), [(0, len(points))]
    while runs:
        a, b = runs.pop()
        if b - a <= BLOCK:
            continue
        own = points[order[a:b]] - points[order[a:b]].mean(axis=0)
        line = own[np.argmax((own * own).sum(axis=1))] if own.shape[1] else own[0]
        for _ in range(8):
            line = own.T @ (own @ line)
            line = line / (np.sqrt(line @ line) or 1.0)
        order[a:b] = order[a:b][np.argsort(own @ line, kind="stable")]
        middle = a + (b - a + BLOCK) // (2 * BLOCK) * BLOCK
        runs += [(a, middle), (middle, b)]
    return order


class BlockMaxIndex:
    """Inverted index of the examples, in blocks of BLOCK that are alike: rare terms as postings, common ones in a table with block maxima.

    A search is a block-max form of MaxScore. The postings of rare terms are short (their maxima in blocks would be about as
    many as they) and are summed first; what common terms can add is bounded by their greatest weights in each block, and the
    table is read for those examples alone whose bound reaches the k-th cosine. Texts that are alike are searched together,
    since they need much the same examples; these are read once for all of them.
    """

    def __init__(self, examples: list[tuple[int, int, list[int], list[int]]], idf: np.ndarray):
        known = sorted((x for x in examples if len(x[2])), key=lambda x: (np.asarray(x[2], ">i4").tobytes(), x[0]))
        blank = [x[1] for x in examples if not len(x[2])]
        n = len(known)
        held = np.zeros(len(idf), np.int64)
        for x in known:
            held[x[2]] += 1
        common = np.argsort(-held, kind="stable")[:COMMON]
        common = common[held[common] * SPARSE > n]
        self.column = np.full(len(idf), -1, np.int32)
        self.column[common] = np.arange(len(common))
        vector = lambda x: (terms := np.asarray(x[2], np.int32), weights(terms, np.asarray(x[3], float), idf))
        table = np.zeros((n, len(common)), np.float32)
        for i, x in enumerate(known):
            terms, weight = vector(x)
            column = self.column[terms]
            table[i, column[column >= 0]] = weight[column >= 0]
        #: Place of an example in the order of vectors and doc_id, by its place in the index.
        self.rank = by_likeness(table)
        known = [known[i] for i in self.rank]
        self.quick = table[self.rank]
        del table
        self.idf, self.ids = idf, [x[0] for x in known]
        self.toxic = np.array([x[1] for x in known], float)
        self.rate = sum(x[1] for x in examples) / len(examples) if len(examples) else 0.0
        self.blank = (sum(blank) + self.rate) / (len(blank) + 1)
        #: What the table has in full precision: columns and weights of each example, one after another.
        self.ends = np.concatenate([[0], np.cumsum([int((self.column[np.asarray(x[2], np.int32)] >= 0).sum()) for x in known])]).astype(np.int64)
        self.columns, self.weight = np.empty(self.ends[-1], np.int16), np.empty(self.ends[-1])
        held[common] = 0
        self.edges = np.concatenate([[0], np.cumsum(held)])
        #: Postings: places of examples and their counts, which with the examples' norms make the weights.
        most = max((int(np.max(x[3])) for x in known), default=0)
        self.logs = 1 + np.log(np.maximum(1, np.arange(min(most, LOGS) + 1)))
        self.at, self.count = np.empty(self.edges[-1], np.int32), np.empty(self.edges[-1], np.min_scalar_type(most))
        self.norm, free = np.empty(n), self.edges[:-1].copy()
        for i, x in enumerate(known):
            terms, weight = vector(x)
            counts, column = np.asarray(x[3]), self.column[terms]
            rare, often = terms[column < 0], column >= 0
            raw = (1 + np.log(counts)) * idf[terms]
            self.norm[i] = np.sqrt((raw * raw).sum())
            self.columns[self.ends[i] : self.ends[i + 1]], self.weight[self.ends[i] : self.ends[i + 1]] = column[often], weight[often]
            self.at[free[rare]], self.count[free[rare]] = i, counts[~often]
            free[rare] += 1
        self.starts = np.arange(0, n, BLOCK)
        self.most = np.maximum.reduceat(self.quick, self.starts, axis=0) if n else self.quick
        #: Examples whose row of the table searches have read, and all that they could have read.
        self.read = self.of = 0
        self.seen: dict[bytes, tuple] = {}
        #: The first example with a vector.
        self.first: dict[bytes, int] = {}
        for i in np.argsort(self.rank).tolist():
            self.first.setdefault(vector_key(known[i][2], known[i][3]), i)

    def rare(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the terms outside the table add to the cosine with each example."""
        starts, sizes = self.edges[terms], self.edges[terms + 1] - self.edges[terms]
        held = np.flatnonzero(sizes)
        if not len(held):
            return np.zeros(len(self.ids))
        starts, sizes = starts[held], sizes[held]
        ends = np.cumsum(sizes)
        places = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])
        counts = self.count[places]
        logs = self.logs[counts] if counts.max() < len(self.logs) else 1 + np.log(counts)
        return np.bincount(self.at[places], logs * np.repeat((weight * self.idf[terms])[held], sizes), len(self.ids)) / self.norm

    def rows(self, examples: np.ndarray) -> np.ndarray:
        """Rows of the table in full precision."""
        sizes = self.ends[examples + 1] - self.ends[examples]
        ends = np.cumsum(sizes)
        places = np.repeat(self.ends[examples] - ends + sizes, sizes) + np.arange(sizes.sum())
        out = np.zeros((len(examples), self.quick.shape[1]))
        out[np.repeat(np.arange(len(examples)), sizes), self.columns[places]] = self.weight[places]
        return out

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The columns of the table, for each text."""
        own = np.zeros((len(vectors), self.quick.shape[1]))
        for i, (terms, weight) in enumerate(vectors):
            column = self.column[terms]
            own[i, column[column >= 0]] = weight[column >= 0]
        return own

    def nearest_of_each(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> list[list[tuple[float, int]]]:
        """Cosine and number of the ``k`` nearest examples of each text; equal cosines in the order of vectors and doc_id. Exact.

        The blocks with the greatest bounds give the cosine that others must reach; each text decides on its own,
        and the examples that any of the texts needs are read. Cosines are in single precision there; examples within its error of
        the k-th are then weighed in full precision.
        """
        n = len(self.ids)
        if not n or not vectors:
            return [[] for _ in vectors]
        own = self.common(vectors)
        quick = own.astype(np.float32)
        most = quick @ self.most.T
        rare = [self.rare(*v) for v in vectors]
        needed = np.full(n, n <= k)
        for i in range(len(vectors) if n > k else 0):
            able = np.maximum.reduceat(rare[i], self.starts) + most[i]
            opening = min(len(able), -(-OPENING * k // BLOCK) + 1)
            first = self.starts[np.argpartition(able, len(able) - opening)[len(able) - opening :]]
            first = (first[:, None] + np.arange(BLOCK)).ravel()
            first = first[first < n]
            least = np.partition(rare[i][first] + self.quick[first] @ quick[i], len(first) - k)[len(first) - k]
            needed |= rare[i] + np.repeat(most[i], BLOCK)[:n] >= least - MARGIN
        rows = np.flatnonzero(needed)
        self.read += len(rows) * len(vectors)
        self.of += n * len(vectors)
        read = quick @ self.quick[rows].T
        found = []
        for i, row in enumerate(read):
            able = rows
            if n > k:
                about = rare[i][rows] + row
                able = rows[about >= np.partition(about, len(rows) - k)[len(rows) - k] - MARGIN]
            cosine = np.round(rare[i][able] + self.rows(able) @ own[i], 12)
            best = np.lexsort((self.rank[able], -cosine))[:k]
            found.append([(float(cosine[j]), int(able[j])) for j in best if cosine[j] > 0])
        return found

    def nearest(self, terms: np.ndarray, weight: np.ndarray, k: int = K) -> list[tuple[float, int]]:
        return self.nearest_of_each([(terms, weight)], k)[0]

    def voted(self, near: list[tuple[float, int]]) -> tuple[float, list[int]]:
        """Score and the doc_ids of the nearest examples."""
        cosine, toxic = np.array([c for c, _ in near]), self.toxic[[i for _, i in near]]
        share = (cosine @ toxic + SMOOTHING * self.rate) / (cosine.sum() + SMOOTHING) if near else self.rate
        return float(min(1.0, max(0.0, share))), [self.ids[i] for _, i in near[:EVIDENCE]]

    def scores(self, vectors: list[tuple[list[int], list[int]]]) -> list[tuple[float, list[int]]]:
        """Score and evidence of each text; equal texts are searched once as long as they are kept."""
        if len(self.seen) > KEPT:
            self.seen.clear()
        keys = [vector_key(*v) if len(v[0]) and self.ids else None for v in vectors]
        new = {key: v for key, v in zip(keys, vectors, strict=True) if key is not None and key not in self.seen}
        each = list(new.items())
        searched = [(np.asarray(t, np.int32), weights(np.asarray(t, np.int32), np.asarray(c, float), self.idf)) for _, (t, c) in each]
        alike = by_likeness(self.common(searched).astype(np.float32))
        for at in range(0, len(each), TOGETHER):
            batch = alike[at : at + TOGETHER]
            for i, near in zip(batch, self.nearest_of_each([searched[i] for i in batch], K + 1), strict=True):
                key = each[i][0]
                own = self.first.get(key)
                self.seen[key] = self.voted([x for x in near if x[1] != own][:K])
        return [(self.blank, []) if key is None else self.seen[key] for key in keys]

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[int]]:
        return self.scores([(terms, counts)])[0]


#: Slope and shift of the logistic curve on the logit of a share; none leaves shares as they are.
Curve = tuple[float, float] | None


def logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def curve_of(share: np.ndarray, toxic: np.ndarray) -> Curve:
    """Platt's curve: logistic regression of ``toxic`` on the logit of ``share``, with his smoothed targets."""
    n, n_toxic = len(toxic), int(toxic.sum())
    if n_toxic in (0, n):
        return None
    x = np.stack([logit(share), np.ones(n)], axis=1)
    target = np.where(toxic > 0, (n_toxic + 1) / (n_toxic + 2), 1 / (n - n_toxic + 2))
    curve = np.array([1.0, 0.0])
    loss = lambda c: float(np.logaddexp(0, x @ c).sum() - target @ (x @ c))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -500, 500)))
        slope = x.T @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(curve - size * step) > loss(curve):
            size /= 2
        curve = curve - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(curve[0]), float(curve[1])) if curve[0] > 0 else None


def calibrated(found: list[tuple[float, list[int]]], curve: Curve) -> list[tuple[float, list[int]]]:
    """Shares and evidence, with the curve's scores in place of the shares."""
    if curve is None or not found:
        return found
    z = curve[0] * logit(np.array([s for s, _ in found])) + curve[1]
    return [(s, e) for s, (_, e) in zip((1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist(), found, strict=True)]


class Scorer:
    """Scores of texts for ``map_rows``."""

    def __init__(self, index: BlockMaxIndex, vector: Vectorizer, curve: Curve):
        self.index, self.vector, self.curve = index, vector, curve

    def many(self, texts: list[str | None]) -> list[tuple]:
        return calibrated(self.index.scores([self.vector(t) for t in texts]), self.curve)


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])


class Model(NamedTuple):
    """What scoring needs: the terms, the examples (doc_id, toxic, terms, counts), the terms' weights, terms and examples as tasks have them, the curve."""

    terms: dict[str, int]
    examples: list[tuple[int, int, np.ndarray, np.ndarray]]
    idf: np.ndarray
    known: Broadcast
    shared: Broadcast
    curve: Curve


def document_counts(docs: DataFrame, known: Broadcast, n_terms: int) -> DataFrame:
    """Term t and the number n of documents (their texts, or the terms of each) that have it, as counted in each task; the number of documents under -1."""
    column = docs.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(n_terms, np.int64), 0
        vector = Vectorizer(known.value) if column == "text" else None
        for batch in slices(batches, column):
            if vector is None:
                n += np.bincount(batch.column(column).flatten().to_numpy(), minlength=n_terms)
            else:
                for text in batch.column(column).to_pylist():
                    n[vector(text)[0]] += 1
            total += batch.num_rows
        t = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(t, -1), pa.int32()), pa.array(np.append(n[t], total), pa.int64())], names=["t", "n"])

    return docs.mapInArrow(run, "t int, n long")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, calibrate: bool = True, store: bool = False) -> tuple[Model, DataFrame]:
    """The model, whose scores are smoothed shares of votes unless ``calibrate``, and ``docs`` with the vectors (terms, counts) in place of their texts.

    With ``store`` the vectors are a table, so that texts are read once for both counts and scores.
    """
    sample = cut_lineage(examples_of(labels, limit))
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("least")
    texts = cut_lineage(known.groupBy("doc_id").agg(least).select("doc_id", "least.text", "least.toxic"))  # at most ``limit`` documents
    terms = {w: i for i, w in enumerate(terms_of(texts))}
    known = share(docs.sparkSession, terms)
    vector = lambda df: map_rows(df.drop(*[c for c in ("terms", "counts") if c in df.columns]), "text", VECTOR, lambda: Vectorizer(known.value)).drop("text")
    vectors = written(vector(docs)) if store else vector(docs)
    counted = document_counts(vectors.select("terms") if store else docs.select("text"), known, len(terms)).groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    t, n = counted.column("t").to_numpy(), counted.column("n").to_numpy()
    total, holding = int(n[t < 0].sum()), np.zeros(max(1, len(terms)))
    holding[t[t >= 0]] = n[t >= 0]
    idf = np.log((1 + total) / (1 + holding)) + 1
    examples = []
    for batch in vector(texts).toArrow().to_batches():  # ``limit`` rows at most
        found = [values_of(batch.column(c)) for c in ("doc_id", "toxic", "terms", "counts")]
        examples += [(d, y, a.astype(np.int32, copy=False), c.astype(np.int32, copy=False)) for d, y, a, c in zip(*found, strict=True)]
    examples.sort(key=lambda x: x[0])
    model = Model(terms, examples, idf, known, share(docs.sparkSession, packed(examples, idf)), None)
    if not calibrate:
        return model, vectors
    # An example's own vote doesn't count in its share. Few rows, but dear ones: they are spread over all cores.
    judged = texts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATED).select("text", "toxic").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    shares = score_texts(judged, model).select("score", "toxic").orderBy("score", "toxic").toArrow()
    return model._replace(curve=curve_of(shares.column("score").to_numpy(), shares.column("toxic").to_numpy())), vectors


#: Index by name, in a Python worker.
INDEXES: dict[str, BlockMaxIndex] = {}
HELD[(__name__,)] = INDEXES.clear


class Packed(NamedTuple):
    """The examples of a model in a few arrays, compressed: workers keep what is broadcast beside the index that they make of it."""

    name: str
    ids: list[int]
    toxic: list[int]
    ends: np.ndarray
    idf: bytes
    terms: bytes
    counts: bytes


def packed(examples: list[tuple[int, int, np.ndarray, np.ndarray]], idf: np.ndarray) -> Packed:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    join = lambda k: squeeze(np.concatenate([np.asarray(x[k], np.int32) for x in examples] or [np.zeros(0, np.int32)]))
    return Packed(uuid4().hex, [x[0] for x in examples], [x[1] for x in examples], np.cumsum([len(x[2]) for x in examples]), squeeze(np.asarray(idf, float)), join(2), join(3))


def loaded(shared: Broadcast) -> BlockMaxIndex:
    """The index of the shared examples; a worker keeps the last one between its tasks."""
    own: Packed = shared.value
    if own.name not in INDEXES:
        INDEXES.clear()
        whole = zstandard.ZstdDecompressor().decompress
        terms, counts = (np.split(np.frombuffer(whole(x), np.int32), own.ends[:-1]) for x in (own.terms, own.counts))
        INDEXES[own.name] = BlockMaxIndex(list(zip(own.ids, own.toxic, terms, counts, strict=True)) if own.ids else [], np.frombuffer(whole(own.idf)))
        del terms, counts
        let_go_of_memory()
    return INDEXES[own.name]


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and evidence (doc_ids of the nearest examples)."""
    shared, known, curve = model.shared, model.known, model.curve
    return map_rows(docs, "text", SCORED, lambda: Scorer(loaded(shared), Vectorizer(known.value), curve))


def score_vectors(vectors: DataFrame, model: Model) -> DataFrame:
    """Like score_texts, for the vectors that ``fit`` returned."""
    shared, curve = model.shared, model.curve
    kept = [f for f in vectors.schema.fields if f.name not in ("terms", "counts", "score", "evidence")]
    schema = T.StructType([*kept, *SCORED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go_for(__name__)
        for batch in slices(batches, "terms"):
            scores = calibrated(loaded(shared).scores(list(zip(values_of(batch.column("terms")), values_of(batch.column("counts")), strict=True))), curve)
            own = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array([s for s, _ in scores], pa.float64()), pa.array([e for _, e in scores], pa.list_(pa.int64()))], names=schema.fieldNames())

    return vectors.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op8."""
    model, vectors = fit(docs.select("doc_id", "text"), labels, store=True)
    return score_vectors(vectors, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
