"""Pages whose markup is broken, and formulas."""
from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from plumbline.llm import htmlcut

BEFORE, AFTER = "The first sentence of the article, which is long enough.", "The last sentence of the article, which is long enough, too."


@pytest.mark.parametrize("tag", ["button", "select", "noscript", "object", "canvas", "svg", "iframe", "template"])
def test_elements_that_are_never_closed(tag):
    for page in (f"<article><p>{BEFORE}</p><{tag}><p>{AFTER}</p></article>", f"<article><p>{BEFORE}</p><{tag}><p>{AFTER}</p><{tag} class=x>Gone</{tag}></article>"):
        assert htmlcut.main_text(page, htmlcut.PRIOR) == f"{BEFORE} {AFTER}"
    closed = f"<article><p>{BEFORE}</p><{tag}>a<{tag}>b</{tag}>c</{tag}><p>{AFTER}</p></article>"
    assert htmlcut.main_text(closed, htmlcut.PRIOR) == f"{BEFORE} {AFTER}"


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title"])
def test_elements_that_go_on_to_the_end(tag):
    assert htmlcut.main_text(f"<article><p>{BEFORE}</p><{tag}><p>{AFTER}</p>", htmlcut.PRIOR) == BEFORE


def test_formulas():
    formula = "<math><semantics><mrow><mi>e</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation encoding='application/x-tex'>e=mc^2</annotation></semantics></math>"
    page = f"<article><p>Einstein wrote {formula} in a paper that everybody knows, as we said.</p><p>{AFTER}</p></article>"
    assert htmlcut.main_text(page, htmlcut.PRIOR) == f"Einstein wrote e=mc2 in a paper that everybody knows, as we said. {AFTER}"
    assert htmlcut.main_text(page.replace("</math>", ""), htmlcut.PRIOR) == f"Einstein wrote e=mc2 in a paper that everybody knows, as we said. {AFTER}"


@pytest.mark.parametrize("page", ["<div class='post tag-news category-notice'><p>{}</p></div>", "<article><div class='related-work'><p>{}</p></div></article>",
                                  '<p class="x>{}', "<p data-x=it's>{}</p>", "<div id=main class=\"search-algorithms\"><p title='a>b'>{}</p></div>"])
def test_names_and_quotes_that_keep_text(page):
    assert htmlcut.main_text(page.format(BEFORE), htmlcut.PRIOR) == BEFORE


@pytest.mark.parametrize("name", ["tags", "related-posts", "site-header", "social share", "content sidebar", "share-buttons", "post-comments", "legal", "search_form"])
def test_names_of_boilerplate(name):
    page = f"<body class='post tag-news'><div class='entry-content'><p>{BEFORE}</p><p>{AFTER}</p></div><div class='{name}'><p>Some words of no use.</p></div></body>"
    assert htmlcut.main_text(page, htmlcut.PRIOR) == f"{BEFORE} {AFTER}"


def test_cuts_equal_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 11))
        keep, drop = rng.random(n), rng.random(n)
        edges = {(i - 1, i): htmlcut.NEXT * rng.random() for i in range(1, n)} | {(i - 2, i): htmlcut.SIBLING * rng.random() for i in range(2, n, 3)}

        def cost(label):
            return sum(d if x else k for x, k, d in zip(label, keep, drop)) + sum(c for (i, j), c in edges.items() if label[i] != label[j])

        best = min(cost(label) for label in itertools.product((False, True), repeat=n))
        assert cost(htmlcut.minimum_cut(keep, drop, edges)) == pytest.approx(best)


def test_pages_of_many_short_blocks_take_time_in_proportion():
    rng = random.Random(1)
    page = "<div>" + "".join(f"<p>{rng.choice(['a short one', 'Home'])} {k}</p>" if rng.random() < 0.8 else f"<div><p>x, {k}.</p><p>y</p></div>" for k in range(16_000)) + "</div>"
    start = time.time()
    htmlcut.main_text(page, htmlcut.PRIOR)
    assert time.time() - start < 20
