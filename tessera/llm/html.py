"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags. Each block becomes a vector of its tag path
(hashed tags and words of class and id), of its hashed words and of a few shares; a bidirectional LSTM in numpy reads the
page's blocks in both directions, and each block is kept or not by its own vector and the state of the whole page around
it. The labeller is fitted once, on FIT_PAGES synthetic pages of htmlpages with known blocks, from a fixed seed.

A null or empty page gives an empty text. Pages without tags are one block. Markup that breaks off is dropped; all text
is read, and none of a kept block is cut. Pages of like lengths go through the network side by side, STEPS blocks at most
with the padding; a longer page goes alone, in parts that hand on the state, so memory grows with the page's text and a few
numbers for each block. Equal pages give equal texts. Extra columns pass through; one with the name of
an output column is replaced.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_rows
from tessera.llm.htmlpages import pages as synthetic_pages

FIT_PAGES, EPOCHS, SEED = 2400, 16, 11
PATHS, WORDS, SHARES, HIDDEN = 96, 32, 10, 20
INPUT = PATHS + WORDS + SHARES
#: Pages, and blocks with padding, that go through the network side by side.
BATCH, STEPS = 48, 16_384
#: Elements of paths that a task keeps.
KEPT_PATHS = 50_000
CACHE = 200_000

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PARTS = re.compile(r"[A-Za-z]+")
#: Elements whose content is no text.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "video", "audio", "select", "textarea", "button"}
#: Of these, elements that a slash may close, and those whose content is no markup: without an end they take in the rest.
FOREIGN, RAW = {"svg", "math"}, {"script", "style", "textarea", "iframe"}
#: A closing slash at the end of a tag; one behind an unquoted value belongs to the value.
CLOSED = re.compile(r"""(?<!\S)/\Z|["']/\Z|(?:^|\s)[^\s"'=]+/\Z""")
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "output", "ruby", "rt", "rp", "nobr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An element's opening ends an open one of these within the nearest of those.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}


class Path:
    """An open element and those around it; equal paths under one root are one object."""

    __slots__ = ("parent", "label", "inner", "own", "whole", "vector")
    made = 0

    def __init__(self, parent: Path | None = None, label: str = ""):
        self.parent, self.label, self.inner, self.vector = parent, label, {}, None
        self.own = self.whole = None if parent else np.zeros(PATHS, np.float32)
        Path.made += 1

    def child(self, label: str) -> Path:
        if label not in self.inner:
            self.inner[label] = Path(self, label)
        return self.inner[label]

    def signs(self) -> np.ndarray:
        """Hashed tags and words of the path, the nearest four elements in full and those around them by 0.7."""
        if self.vector is None:
            above, at = [], self
            while at.whole is None:
                above.append(at)
                at = at.parent
            for element in reversed(above):
                name, *words = element.label.split(".")
                element.own = hashed([f"<{name}", *(f".{w}" for w in words)])
                element.whole = element.parent.whole + element.own
            vector, at = 0.7 * self.whole, self
            for _ in range(4):
                vector += 0.3 * at.own
                at = at.parent or at
                if at.parent is None:
                    break
            self.vector = np.clip(vector + hashed([f"0{self.label.split('.')[0]}"] if self.parent else []), -2, 2)
        return self.vector


def hashed(signs: list[str]) -> np.ndarray:
    vector = np.zeros(PATHS, np.float32)
    for sign in signs:
        i, s = bucket(sign, PATHS)
        vector[i] += s
    return vector


ROOTS = [Path()]


def root() -> Path:
    """The root of this worker's paths; a new one when they have become many."""
    if Path.made > KEPT_PATHS:
        ROOTS[0], Path.made = Path(), 0
    return ROOTS[0]


def blocks(page: str | None) -> list[tuple[Path, str, int, int]]:
    """Path, text, characters in links and number of tags of each leaf block, in page order.

    The path has an element for each open block-level tag: its name and, after dots, the words of its class, id and role.
    """
    found: list[tuple[Path, str, int, int]] = []
    stack: list[tuple[str, Path]] = [("", root())]
    parts: list[str] = []
    linked = tags = in_link = 0

    def close() -> None:
        nonlocal linked, tags
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                found.append((stack[-1][1], text, linked, tags))
            parts.clear()
        linked = tags = 0

    page = page or ""
    at, size = 0, len(page)
    unclosed: set[str] = set()
    while at < size:
        m = MARKUP.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending = m[1] or m[4]
        if not ending and name in SILENT:
            if name in FOREIGN and CLOSED.search(m[3] or m[6] or ""):
                continue
            end = None if name in unclosed else re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in RAW:
                at = size
            else:
                unclosed.add(name)
            continue
        tags += 1
        if name in INLINE:
            if name == "a":
                in_link = 0 if ending else 1
            elif name == "label":
                in_link = 0 if ending else 1
            continue
        if name in VOID:
            if name in ("br", "hr"):
                parts.append(" ")
            if name == "hr":
                close()
            continue
        close()
        in_link = 0
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if stack[-1][0] == "p" or stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        if name in CLOSES:
            over, within = CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in within:
                    break
                if stack[i][0] in over:
                    del stack[i:]
                    break
        label = name
        attributes = m[3] or m[6]
        if attributes and ("class" in attributes or "id" in attributes or "role" in attributes):
            words = " ".join(x or y or z for x, y, z in NAMES.findall(attributes))
            label = ".".join([name, *dict.fromkeys(w.lower() for w in NAME_PARTS.findall(words))])
        stack.append((name, stack[-1][1].child(label)))
    close()
    return found


def bucket(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % size, 1.0 if h >> 31 else -1.0


class Featurizer:
    """Vectors of blocks; what a word gives is kept."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def number(self, word: str) -> int:
        if len(self.words) > CACHE:
            self.words.clear()
        i, s = bucket(word.lower(), WORDS)
        self.words[word] = n = 2 * i + (s > 0)
        return n

    def page(self, every: list[tuple[Path, str, int, int]], begin: int = 0, end: int | None = None) -> np.ndarray:
        """Vectors of a page's blocks, or of those from ``begin`` to ``end``."""
        total, found = len(every), every[begin:end]
        n = len(found)
        x = np.zeros((n, INPUT), np.float32)
        known, numbers, counts = self.words, [], []
        for i, (path, text, linked, tags) in enumerate(found):
            x[i, :PATHS] = path.signs()
            words = text.split(" ")
            counts.append(len(words))
            numbers += [known[w] if w in known else self.number(w) for w in words]
            size, at = len(text), begin + i
            x[i, PATHS + WORDS :] = (
                min(1.1, math.log1p(size) / 6), min(1.1, math.log1p(len(words)) / 5), min(1.0, linked / size), min(1.0, tags / len(words)),
                (text.count(".") + text.count(",")) / len(words), text[-1] in ".!?", text[0].isupper(), at / total, 1 / (1 + at), 1 / (total - at),
            )
        flat = np.array(numbers, np.int64)
        row = np.repeat(np.arange(n), counts)
        both = np.bincount(row * 2 * WORDS + flat, minlength=n * 2 * WORDS).reshape(n, WORDS, 2)
        x[:, PATHS : PATHS + WORDS] = np.clip((both[:, :, 1] - both[:, :, 0]) / np.sqrt(np.array(counts))[:, None], -2, 2)
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction over a batch (time, page, input); steps beyond a page's end leave its state as it is."""

    def __init__(self, rng: np.random.Generator):
        self.w = (rng.standard_normal((INPUT, 4 * HIDDEN)) / math.sqrt(INPUT)).astype(np.float32)
        self.u = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / math.sqrt(HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1
        self.parameters = [self.w, self.u, self.b]

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False, state: tuple | None = None) -> np.ndarray:
        """States of each step; ``state`` is what an earlier part of the pages left in ``last``."""
        steps, pages, _ = x.shape
        inputs = (x.reshape(-1, INPUT) @ self.w + self.b).reshape(steps, pages, -1)
        h, c = state or (np.zeros((pages, HIDDEN), np.float32),) * 2
        out = np.empty((steps, pages, HIDDEN), np.float32)
        kept = []
        for t in range(steps):
            z = inputs[t] + h @ self.u
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            squashed = np.tanh(new_c)
            if keep:
                kept.append((i, f, o, g, c, squashed, h, m))
            c = np.where(m, new_c, c)
            h = np.where(m, o * squashed, h)
            out[t] = h
        self.kept, self.last = kept, (h, c)
        return out

    def backward(self, x: np.ndarray, d_out: np.ndarray) -> list[np.ndarray]:
        steps, pages, _ = x.shape
        d_z = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
        d_u = np.zeros_like(self.u)
        d_h = d_c = np.zeros((pages, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, c, squashed, h, m = self.kept[t]
            d_h = d_h + d_out[t]
            d_new = d_c + d_h * o * (1 - squashed * squashed)
            z = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_h * squashed * o * (1 - o), d_new * i * (1 - g * g)], 1) * m
            d_z[t] = z
            d_u += h.T @ z
            d_h = np.where(m, z @ self.u.T, d_h)
            d_c = np.where(m, d_new * f, d_c)
        flat = d_z.reshape(-1, 4 * HIDDEN)
        return [x.reshape(-1, INPUT).T @ flat, d_u, flat.sum(0)]


class Labeller:
    """Probability of each block that it belongs to the article."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng), Lstm(rng)
        self.v = (rng.standard_normal(2 * HIDDEN + INPUT) * 0.05).astype(np.float32)
        self.a = np.zeros(1, np.float32)

    @staticmethod
    def padded(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Batch, mask, and for each page the order that turns it round."""
        steps = max(map(len, vectors))
        x = np.zeros((steps, len(vectors), INPUT), np.float32)
        mask = np.zeros((steps, len(vectors)), bool)
        turn = np.tile(np.arange(steps)[:, None], (1, len(vectors)))
        for k, v in enumerate(vectors):
            x[: len(v), k], mask[: len(v), k] = v, True
            turn[: len(v), k] = np.arange(len(v))[::-1]
        return x, mask, turn

    def forward(self, vectors: list[np.ndarray], keep: bool = False) -> tuple:
        x, mask, turn = self.padded(vectors)
        page = np.arange(len(vectors))
        turned = x[turn, page]
        states = np.concatenate([self.ahead.forward(x, mask, keep), self.back.forward(turned, mask, keep)[turn, page], x], 2)
        return x, turned, mask, turn, states, sigmoid(states @ self.v + self.a)

    def fit(self, vectors: list[np.ndarray], labels: list[np.ndarray], epochs: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        weights = [*self.ahead.parameters, *self.back.parameters, self.v, self.a]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(epochs):
            order = np.argsort([len(v) + rng.random() * 12 for v in vectors])  # pages of like lengths together
            starts = rng.permutation(range(0, len(order), BATCH))
            for at in starts:
                chosen = order[at : at + BATCH]
                x, turned, mask, turn, states, p = self.forward([vectors[i] for i in chosen], True)
                y = np.zeros_like(p)
                for k, i in enumerate(chosen):
                    y[: len(labels[i]), k] = labels[i]
                d = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
                d_states = d[:, :, None] * self.v
                page = np.arange(len(chosen))
                grads = [
                    *self.ahead.backward(x, d_states[:, :, :HIDDEN]), *self.back.backward(turned, d_states[:, :, HIDDEN : 2 * HIDDEN][turn, page]),
                    np.einsum("tp,tpk->k", d, states), d.sum()[None],
                ]
                norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                rate = 0.015 * (1 - 0.9 * epoch / epochs)
                for w, g, m, s in zip(weights, grads, first, second, strict=True):
                    g = g * min(1.0, 2 / (norm + 1e-9))
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.ahead.kept = self.back.kept = []

    def label(self, vectors: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is kept, for pages side by side."""
        if not vectors:
            return []
        p = self.forward(vectors)[-1]
        return [p[: len(v), k] > 0.5 for k, v in enumerate(vectors)]

    def label_in_parts(self, vectors: Callable[[int, int], np.ndarray], n: int) -> np.ndarray:
        """The same for one page of ``n`` blocks, whose vectors are made part by part."""
        whole, kept, state = np.ones((STEPS, 1), bool), np.zeros(n, bool), None
        ahead = np.empty((n, HIDDEN), np.float32)
        for begin in range(0, n, STEPS):
            x = vectors(begin, begin + STEPS)
            ahead[begin : begin + STEPS] = self.ahead.forward(x[:, None], whole[: len(x)], state=state)[:, 0]
            state = self.ahead.last
        state = None
        for begin in range((n - 1) // STEPS * STEPS, -1, -STEPS):
            x = vectors(begin, begin + STEPS)
            back = self.back.forward(x[::-1, None], whole[: len(x)], state=state)[::-1, 0]
            state = self.back.last
            kept[begin : begin + STEPS] = sigmoid(np.concatenate([ahead[begin : begin + STEPS], back, x], 1) @ self.v + self.a) > 0.5
        return kept


def training_set(count: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    featurizer, vectors, labels = Featurizer(), [], []
    for page, kept in synthetic_pages(count, seed):
        found = blocks(page)
        if len(found) == len(kept):
            vectors.append(featurizer.page(found))
            labels.append(np.array(kept))
    return vectors, labels


@lru_cache(2)
def fitted(count: int = FIT_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    labeller = Labeller(seed)
    labeller.fit(*training_set(count, seed), epochs, seed)
    return labeller


TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])


class Extractor:
    """Tuples of TEXT for pages."""

    def __init__(self, labeller: Labeller):
        self.labeller, self.featurizer = labeller, Featurizer()

    def many(self, pages: list[str | None]) -> list[tuple]:
        found = [blocks(p) for p in pages]
        kept: list[np.ndarray] = [np.zeros(0, bool)] * len(found)
        beside: list[int] = []
        for i in sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i])):
            if len(found[i]) > STEPS:
                kept[i] = self.labeller.label_in_parts(partial(self.featurizer.page, found[i]), len(found[i]))
                continue
            if len(beside) == BATCH or (len(beside) + 1) * len(found[i]) > STEPS:
                self.label(found, kept, beside)
                beside = []
            beside.append(i)
        self.label(found, kept, beside)
        texts = [[b[1] for b, k in zip(f, ks, strict=True) if k] for f, ks in zip(found, kept, strict=True)]
        return [("\n\n".join(t), len(f), len(t)) for t, f in zip(texts, found, strict=True)]


    def label(self, found: list[list], kept: list[np.ndarray], chosen: list[int]) -> None:
        for i, k in zip(chosen, self.labeller.label([self.featurizer.page(found[i]) for i in chosen]), strict=True):
            kept[i] = k


def extract(pages: DataFrame, column: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """``pages`` without its markup, with text, n_blocks and n_kept."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller or fitted())
    made = map_rows(pages, column, TEXT, lambda: Extractor(shared.value))
    return made if column in TEXT.fieldNames() else made.drop(column)


def main_texts(pages: DataFrame) -> DataFrame:
    """The columns of op2."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
