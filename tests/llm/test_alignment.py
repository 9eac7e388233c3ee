"""Alignment of large trees: time, memory, and that it finds what small ones find."""

import random
import time
import tracemalloc

import pytest

from eddyscale.llm import html_extraction


def thread(rng, posts: int, depth: int = 1):
    """A page of posts with varying parts, a fixed head and foot: (parents, labels)."""
    parents, labels = [-1, 0, 0], ["", "header", "div.thread"]
    for _ in range(posts):
        post = len(labels)
        parents.append(2)
        labels.append("div.post")
        for tag in ["h3", *rng.choices(["p", "ul", "blockquote", "img", "pre"], k=rng.randrange(1, 5))]:
            parents.append(post)
            labels.append(tag)
    parents.append(0)
    labels.append("footer")
    return parents, labels


def test_twenty_thousand_nodes():
    rng = random.Random(1)
    one, other = thread(rng, 4500), thread(rng, 4400)
    assert len(one[1]) > 20_000
    began = time.process_time()
    found = html_extraction.align(one, other)
    assert time.process_time() - began < 12  # 3.6 s on an idle core
    assert len(found) > 0.35 * len(one[1])  # posts of random parts; most are unlike any near them
    assert all(one[1][a] == other[1][b] for a, b in found.items())
    assert all(found[one[0][a]] == other[0][b] for a, b in found.items() if a)


def test_memory_grows_with_the_nodes():
    rng = random.Random(3)
    trees = thread(rng, 1100), thread(rng, 1100)
    tracemalloc.start()
    html_extraction.align(*trees)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 120 << 20  # of 5,000 nodes


def test_time_grows_with_the_nodes():
    rng = random.Random(2)
    spent = []
    for posts in (1000, 4000):
        trees = thread(rng, posts), thread(rng, posts)
        began = time.process_time()
        html_extraction.align(*trees)
        spent.append(time.process_time() - began)
    assert spent[1] < 7 * max(spent[0], 0.1)


@pytest.mark.parametrize("seed", range(20))
def test_near_matching_is_close_to_the_best(seed, monkeypatch):
    """Long lists against the whole programme: order kept, and nearly as many nodes."""
    rng = random.Random(seed)
    one = thread(rng, 60)
    cut = rng.randrange(20, 40)
    keep = [i for i in range(len(one[1])) if not (one[0][i] == 2 and rng.random() < 0.05) and i != cut]
    place = {}
    for i in keep:
        if i == 0 or one[0][i] in place:
            place[i] = len(place)
    other = [(-1 if i == 0 else place[one[0][i]]) for i in place], [one[1][i] for i in place]
    near = html_extraction.align(one, other)
    monkeypatch.setattr(html_extraction, "_ALL", 10**9)
    whole = html_extraction.align(one, other)
    assert len(near) >= 0.97 * len(whole)
    for found in (near, whole):
        assert all(found[one[0][a]] == other[0][b] for a, b in found.items() if a)
        below = [(a, b) for a, b in sorted(found.items()) if one[0][a] == 2]
        assert [b for _, b in below] == sorted(b for _, b in below)


def test_heaviest_chain():
    rng = random.Random(0)
    for _ in range(200):
        pairs = [(rng.randrange(6), rng.randrange(6), rng.randrange(1, 9)) for _ in range(8)]
        pairs = list({(i, j): (i, j, w) for i, j, w in pairs}.values())
        best = max((sum(p[2] for p in c) for n in range(1 << len(pairs)) for c in [[p for k, p in enumerate(sorted(pairs)) if n >> k & 1]] if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False))), default=0)
        total, chain = html_extraction._heaviest(pairs, 6)
        assert total == best == sum(w for i, j, w in pairs if (i, j) in set(chain))


WHERE = {
    "wrapper": "<body><div><p>{0} and more of {0}<p>{1}</div><div>Site</div></body>",
    "both": "<body><div><h1>Site</h1><article><p>{0}<p>{1}</article><div>Site</div></div></body>",
    "tags": "<body><div><article><p>{0}</article><div><b>{1}</b></div><article><p>{1}</article></div></body>",
}


@pytest.mark.parametrize("told", WHERE)
def test_what_decides_a_page(spark, told):
    """The search alone, the search where it comes to an article, tags where no child has enough; a page without a wrapper."""
    rows = [(i, "http://a.org/", WHERE[told].format(" ".join(f"x{i}{k}" for k in range(20)), " ".join(f"y{i}{k}" for k in range(20)))) for i in range(9)]
    rows.append((9, "http://b.org/", "<article><p>alone</article>"))
    got = {r["page_id"]: r for r in html_extraction.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["decided"] for i in range(10)] == [told] * 9 + ["page"]
    assert all(f"x{i}19" in got[i]["text"] and f"y{i}19" in got[i]["text"] and "Site" not in got[i]["text"] for i in range(9)) and got[9]["text"] == "alone"


def test_descent_is_by_mass():
    """body > div > (article 6, article 4): no child has enough, so both articles; with one article, the search comes to it."""
    two = ([-1, 0, 1, 2, 2], ["", "body", "div", "article", "article"])
    assert html_extraction.descend(*two, {3: 6, 4: 4}) == ({3, 4}, "tags")
    assert html_extraction.descend(*two, {3: 9, 4: 1}) == ({3, 4}, "tags")
    one = ([-1, 0, 1, 2, 2], ["", "body", "div", "article", "div"])
    assert html_extraction.descend(*one, {3: 9, 4: 1}) == ({3}, "both")
    assert html_extraction.descend(*one, {3: 6, 4: 4}) == ({3}, "tags")
    assert html_extraction.descend(*one, {3: 1, 4: 9}) == ({3, 4}, "wrapper")  # a tenth is enough to be taken along
    assert html_extraction.descend(*one, {}) == ({0}, "wrapper")


def best_pairs(one, other):
    """The most nodes that simple tree matching pairs, by the plain programme over all pairs of children."""
    below = []
    for parents, _ in (one, other):
        below.append([[] for _ in parents])
        for i in range(1, len(parents)):
            below[-1][parents[i]].append(i)
    worth = {}
    for a in range(len(one[1]) - 1, -1, -1):
        for b in range(len(other[1]) - 1, -1, -1):
            if one[1][a] == other[1][b]:
                row = [0] * (len(below[1][b]) + 1)
                for p in below[0][a]:
                    up, row = row, [0]
                    for j, q in enumerate(below[1][b]):
                        row.append(max(up[j + 1], row[j], up[j] + worth.get((p, q), 0)))
                worth[a, b] = 1 + row[-1]
    return worth[0, 0]


def is_matching(found, one, other):
    kept = all(one[1][a] == other[1][b] and (a == 0 or found[one[0][a]] == other[0][b]) for a, b in found.items())
    return kept and [b for _, b in sorted(found.items())] == sorted(found.values())


def forest(rng, nodes, labels, reach):
    """A tree of any form, in preorder; ``reach``: how far up the next node may hang."""
    parents, up = [-1], [0]
    for i in range(1, nodes):
        del up[max(1, len(up) - rng.randrange(reach)) :]
        parents.append(up[-1])
        up.append(i)
    return parents, ["", *rng.choices(labels, k=nodes - 1)]


LONG = {  # labels, how far up: few long lists of many sorts, lists of few labels, lists whose labels are nearly all different
    "posts": None,
    "wide": (["a", "b", "c"], 40),
    "deep": (["a", "b"], 3),
    "sparse": ([f"x{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)], 40),
}


@pytest.mark.parametrize("kind", LONG)
@pytest.mark.parametrize("limits", [{}, {"_HELD": 0, "_CELLS": 0}, {"_ALL": 0}, {"_ALL": 0, "_HELD": 0, "_CELLS": 0}, {"_ALL": 10**9}], ids=str)
def test_no_pair_is_left_out(kind, limits, monkeypatch):
    """Long lists, where partners may be far from the diagonal: as many pairs as the plain programme over all."""
    for name, value in limits.items():
        monkeypatch.setattr(html_extraction, name, value)
    for seed in range(6):
        rng = random.Random(seed)
        one, other = (thread(rng, posts) if kind == "posts" else forest(rng, 6 * posts, *LONG[kind]) for posts in (70, 45))
        found = html_extraction.align(one, other)
        assert len(found) == best_pairs(one, other) and is_matching(found, one, other)


def test_partner_far_from_the_diagonal():
    """Children without a partner before the only one that has one: forty more in one list than in the other."""

    def listing(prefix, before, after, last):
        parents, labels = [-1, 0], ["", "div"]
        for k in range(before + after):
            parents.append(1)
            labels.append(f"div.{prefix}{chr(97 + k // 26)}{chr(97 + k % 26)}")
            if k == before:
                parents += [1, len(labels), len(labels)]
                labels += ["section", "p", last]
        return parents, labels

    one, other = listing("x", 50, 10, "ul"), listing("y", 5, 55, "ol")
    found = html_extraction.align(one, other)
    assert len(found) == 4 and {one[1][a] for a in found} == {"", "div", "section", "p"}


def test_equal_subtree_that_crosses_larger_ones():
    """A single equal subtree is no fixed point: pairing it would part fifty larger ones that are nearly equal."""

    def listing(first, last):
        parents, labels = [-1, 0], ["", "div"]
        for label in [first] + ["post"] * 50 + [last]:
            at = len(labels)
            parents.append(1)
            labels.append(label)
            if label == "post":
                parents += [at] * 4
                labels += ["h3", "p", "ul", "dl" if first == "hr" else "pre"]
        return parents, labels

    one, other = listing("hr", "b"), listing("i", "hr")
    assert len(html_extraction.align(one, other)) == 2 + 50 * 4 == best_pairs(one, other)


def test_page_with_its_template_far_down(spark):
    """What all pages of a host share is found wherever the page's long list has it."""
    letters = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(90)]
    rows = []
    for i in range(12):
        parts = [f'<section><div class="x{chr(97 + i)}{k}"><p>of {i} alone {k}</p></div></section>' for k in letters[:76]]
        kind = ("ul", "ol", "dl", "pre", "table", "blockquote")[i % 6]
        parts.insert(3 + 6 * i, f"<section><p>Told by all pages</p>{''.join(f'<div class=t{k}></div>' for k in letters)}<{kind}>end {i}</{kind}></section>")
        rows.append((i, f"http://a.org/{i}", f"<body><div>{''.join(parts)}</div></body>"))
    got = {r["page_id"]: r["text"] for r in html_extraction.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(12):
        want = [f"of {i} alone {k}" for k in letters[:76]]
        want.insert(3 + 6 * i, f"end {i}")
        assert got[i].split("\n") == want
