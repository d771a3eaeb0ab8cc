"""Block cutting by hand-made pages, and main texts of pages whose article is known."""

from __future__ import annotations

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import htmlpages
from tessera.llm.html import Labeller, blocks, extract, fitted, main_texts, training_set
from tests.against import TABLES


def texts(page):
    return [b[1] for b in blocks(page)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, []), ("", []), ("   ", []), ("no markup &amp; all", ["no markup & all"]),
        ("<p>one<p>two</p>three", ["one", "two", "three"]),
        ("<p>a <b>bold</b> word<br>next</p>", ["a bold word next"]),
        ("<div>x<!-- no <p>text</p> -->y</div>", ["xy"]),
        ("<script>var a='</p>';</script><p>x</p><style>p{}</style>", ["x"]),
        ("<ul><li>a<li>b</ul>", ["a", "b"]),
        ("<p title='a>b'>x</p>", ["x"]),
        ("<p>&eacute;&#233;&#xe9; &lt;b&gt;&nbsp;z</p>", ["ééé <b> z"]),
        ("a < b and c > d", ["a < b and c > d"]),
        ("<p>cut off <b", ["cut off"]),
        ("<script>never ends", []),
        ("<p>a</p><!-- never ends <p>b</p>", ["a"]),
        ("<td>a<td>b", ["a", "b"]),
    ],
)
def test_blocks(page, expected):
    assert texts(page) == expected


@pytest.mark.parametrize(
    "page",
    [
        '<p>a</p><svg viewBox="0 0 1 1"/><p>b</p>', "<p>a</p><svg/><p>b</p>", "<p>a</p><math /><p>b</p>", "<p>a</p><svg hidden/><p>b</p><svg>x</svg>",
        "<p>a</p><svg width=1/>x</svg><p>b</p>", "<p>a</p><select><p>b</p>", "<p>a</p><noscript><p>b</p>", "<p>a</p><video src=x><canvas><p>b</p>", "<p>a</p><p>b</p><script>c",
    ],
)
def test_silent_elements_without_end(page):
    assert texts(page) == ["a", "b"]


def test_long_and_broken_markup_ends():
    for page in ("<" * 20_000, "<p " + "a='" * 20_000, "<div>" * 3000 + "x", "&" * 20_000, "<p>" + "word " * 100_000):
        blocks(page)


def test_training_pages_have_as_many_blocks_as_labels():
    for page, kept in htmlpages.pages(60, 3):
        assert len(blocks(page)) == len(kept)


def test_gradients():
    """The hand-written derivatives against differences."""
    vectors, labels = training_set(3, 5)
    labeller = Labeller(1)
    def loss():
        p = labeller.forward(vectors)[-1]
        return -sum(float((y * lo + (1 - y) * hi).sum()) for y, lo, hi in ((labels[k], fitting(p, k), others(p, k)) for k in range(len(vectors))))
    import numpy as np
    fitting = lambda p, k: np.log(p[: len(labels[k]), k].astype(float) + 1e-12)
    others = lambda p, k: np.log(1 - p[: len(labels[k]), k].astype(float) + 1e-12)
    x, turned, mask, turn, _, p = labeller.forward(vectors, True)
    y = np.zeros_like(p)
    for k, own in enumerate(labels):
        y[: len(own), k] = own
    d = np.where(mask, p - y, 0).astype(np.float32)
    from tessera.llm.html import HIDDEN
    page = np.arange(len(vectors))
    d_states = d[:, :, None] * labeller.v
    ahead = labeller.ahead.backward(x, d_states[:, :, :HIDDEN])
    back = labeller.back.backward(turned, d_states[:, :, HIDDEN : 2 * HIDDEN][turn, page])
    for lstm, grads in ((labeller.ahead, ahead), (labeller.back, back)):
        for w, g in zip(lstm.parameters, grads, strict=True):
            at = np.unravel_index(np.abs(g).argmax(), g.shape)
            old, step = w[at], 1e-2
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 0.03 * abs(g[at]) + 0.02


def test_unseen_pages_of_the_same_kind():
    vectors, labels = training_set(150, 99)
    answers = fitted().label(vectors)
    wrong = sum(int((a != y).sum()) for a, y in zip(answers, labels, strict=True))
    assert wrong < 0.02 * sum(map(len, labels))


def test_a_page_in_parts_has_the_same_labels(monkeypatch):
    from tessera.llm import html as module

    pages = [page for page, _ in htmlpages.pages(12, 8)]
    extractor = module.Extractor(fitted())
    whole = extractor.many([*pages, "".join(pages)])
    monkeypatch.setattr(module, "STEPS", 7)
    assert extractor.many([*pages, "".join(pages)]) == whole


def test_memory_on_long_pages():
    """A page of very many blocks beside short ones, and deep nesting, go through in bounded memory."""
    import tracemalloc

    from tessera.llm.html import Extractor

    extractor = Extractor(fitted())
    extractor.many(["<p>warm</p>"])
    for page in ("<p>some words here.</p>" * 60_000, "<div class='a b'>" * 8000 + "x"):
        tracemalloc.start()
        made = extractor.many(["<p>short</p>"] * 47 + [page])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made[-1][1] in (60_000, 1) and peak < 250e6


def test_form_text_inside_a_block_is_dropped():
    assert texts("<p>Read on <button class=x>Share <b>now</b></button>here</p><button>a<p>b</p>") == ["Read on here", "a", "b"]


def test_pages_of_the_tables(spark):
    """Their article is what the element of that name holds."""
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = main_texts(pages).collect()
    assert len(rows) == len(source)
    right = 0
    for r in rows:
        assert r["n_chars"] == len(r["text"])
        found = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)
        if found:
            expected = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", found[1]))).strip()
            right += re.sub(r"\s+", " ", r["text"]) == expected
    assert right >= 0.98 * sum("<article>" in x for x in source.values())


def test_edges(spark):
    rng = random.Random(18)
    article = "<article><h1>Title here</h1>" + "".join(f"<p>{' '.join(rng.choice(['some', 'plain', 'words']) for _ in range(30))}.</p>" for _ in range(4)) + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", article), (3, "u", article), (None, None, "<nav><a href=x>Home</a></nav>" + article)]
    found = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 5 and [r["text"] for r in found if r["page_id"] in (1, 2)] == ["", ""]
    kept = {r["text"] for r in found} - {""}
    assert len(kept) == 1 and kept.pop().startswith("Title here\n\n")
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clashing = spark.createDataFrame([(1, article)], "n_kept long, text string").withColumn("other", F.lit(1))
    assert extract(clashing, column="text").first()["text"].startswith("Title here")
