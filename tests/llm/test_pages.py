"""Page extraction: layouts beside the given one, hostile pages, and marginals against all states of a small tree."""

import itertools
import math
import time

import pytest

from signalcheck.llm import extract

LONG = " ".join(["some words of a real paragraph that goes on for a while"] * 3)
NAV = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul></nav>"


def page(body):
    return f"<html><head><title>T</title></head><body>{NAV}{body}<footer>&copy; me</footer></body></html>"


@pytest.fixture(scope="module")
def model(spark, folder):
    return extract.fit_extractor(spark.read.parquet(f"{folder}/pages.parquet"))


LAYOUTS = [
    (f"<article><p>{LONG}</p><ul><li>one</li><li>two</li></ul></article>", f"{LONG}\none\ntwo"),
    (f"<article><header><h1>Real title</h1></header><p>{LONG}</p></article>", f"Real title\n{LONG}"),
    *((f'<article class="{c}"><p>{LONG}</p></article>', LONG) for c in ("post no-sidebar", "category-social", "share-price", "comments-open")),
    (
        f'<header>TOP</header><article><p>{LONG}</p><aside>A {LONG}</aside><div class="ad-banner">B {LONG}</div>'
        f'<section class="comments"><h2>Said</h2>{f"<p>C {LONG}</p>" * 20}</section></article>',
        LONG,
    ),
    (
        f'<div class="cookie-notice">K {LONG}</div><div class="entry"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div id="sidebar"><p>S {LONG}</p></div>',
        "\n".join([LONG] * 3),
    ),
    (
        f"<main><p>{LONG}</p><p><a href=z>only link</a></p><table><tr><td>cell</td></tr></table><form>F<button>B</button></form></main><div>O {LONG}</div>",
        f"{LONG}\nonly link\ncell",
    ),
]


@pytest.mark.parametrize("body, want", LAYOUTS)
def test_layouts(model, body, want):
    assert extract.main_text(page(body), model) == want


def test_without_labelled_pages(spark):
    none = extract.fit_extractor(spark.createDataFrame([(1, None), (2, "")], "page_id int, html string"))
    assert extract.main_text(page(LAYOUTS[0][0]), none) == LAYOUTS[0][1]
    rows = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, page(LAYOUTS[1][0]), "y")], "page_id int, html string, text string")
    found = extract.extract_text(rows, none, ["page_id"]).collect()
    assert sorted(r.text for r in found) == ["", "", LAYOUTS[1][1]]
    assert extract.extract_text(rows.limit(0), none).count() == 0


@pytest.mark.parametrize("piece", ['<a "', "<div>", "</x>", '<a ="', "<!--", "<p><b>", '<div class="'])
def test_hostile_pages_take_linear_time(model, piece):
    begin = time.monotonic()
    extract.main_text(page(piece * 40_000), model)
    assert time.monotonic() - begin < 5


def test_marginals_are_brute_force(model):
    tree = extract.Page('<body><nav>n</nav><div class="ad">buy it</div><article><p>one<b>two</b></p><ul><li>x</li></ul></article></body>')
    found = extract.marginals(tree, model)
    n = len(tree.name)
    local = [0.0] + [sum(model["nodes"].get(f, 0.0) for f in features) for features in tree.features]
    weight = [0.0] * n
    whole = 0.0
    for states in itertools.product((0, 1), repeat=n):
        p = 1.0
        for i in range(1, n):
            p *= math.exp(local[i] * states[i]) * model["pairs"][tree.kind[i]][2 * states[tree.parent[i]] + states[i]]
        whole += p
        for i, s in enumerate(states):
            weight[i] += p * s
    assert [1 / (1 + math.exp(-b)) for b in found] == pytest.approx([w / whole for w in weight], abs=1e-9)
