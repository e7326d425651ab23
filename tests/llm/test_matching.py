"""Alignment of page trees against a plain recursive version."""

import random
from functools import lru_cache

from panelworks.llm.matching import Aligner, Tree, place, tree_from
from tests.llm.test_models import extracted


@lru_cache(maxsize=None)
def plain_match(a, b):
    if a[0] != b[0]:
        return 0

    def best(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        return max(best(i + 1, j), best(i, j + 1), plain_match(a[1][i], b[1][j]) + best(i + 1, j + 1))

    return 1 + best(0, 0)


def some_tree(rng, depth=0):
    return ("r" if depth == 0 else rng.choice("abc"), tuple(some_tree(rng, depth + 1) for _ in range(rng.randrange(5) if depth < 3 else 0)))


def nodes(tree):
    return [tree, *(n for c in tree.children for n in nodes(c))]


def as_pairs(aligner, a, b):
    mates: dict[int, Tree] = {}
    aligner._pair(a, b, mates)
    return mates


def test_matching_equals_a_plain_recursion():
    rng = random.Random(6)
    for _ in range(150):
        a, b = some_tree(rng), some_tree(rng)
        x, y = tree_from(a), tree_from(b)
        aligner = Aligner([y])
        assert aligner.matched(x, y) == plain_match(a, b)
        mates = as_pairs(aligner, x, y)
        assert len(mates) == plain_match(a, b) == len({id(m) for m in mates.values()})
        for node in nodes(x):
            if id(node) in mates:
                order = {id(c): i for i, c in enumerate(mates[id(node)].children)}
                assert mates[id(node)].label == node.label
                at = [order[id(mates[id(c)])] for c in node.children if id(c) in mates]
                assert at == sorted(at)


def test_paths_follow_the_mates_and_are_distinct():
    reference = tree_from(["", [["div", []], ["div", [["ul", []]]], ["p", []]]])
    place(reference)
    page = tree_from(["", [["h", []], ["div", [["ul", []]]], ["p", []], ["p", []]]])
    aligner = Aligner([reference])
    place(page, 0, as_pairs(aligner, page, reference))
    paths = [n.path for n in nodes(page)]
    assert len(set(paths)) == len(paths)
    assert page.path == reference.path
    # The only div that holds a list is matched with the second one, whatever its number on the page.
    assert page.children[1].path == reference.children[1].path != reference.children[0].path
    assert sum(p in {n.path for n in nodes(reference)} for p in paths) == 4


def test_equal_labels_are_told_apart_by_alignment(spark):
    def page(i):
        return f"<body><div>Follow us</div><div><p>Para {i} of this page<p>More {i} of it</div><div>All rights</div></body>"

    assert extracted(spark, [("a.example", page(i)) for i in range(6)]) == [f"Para {i} of this page\nMore {i} of it" for i in range(6)]


def test_headline_and_formulas_of_an_article_stay(spark):
    pages = [
        f"<body><header><h1>Site</h1></header><article><header><h1>Headline {i}</h1></header><p>Let <math><mi>x</mi><mo>=</mo>"
        f"<mn>{i}</mn></math> be so.</p></article><footer>End</footer></body>"
        for i in range(5)
    ]
    assert extracted(spark, [("a.example", p) for p in pages]) == [f"Headline {i}\nLet x={i} be so." for i in range(5)]
    assert extracted(spark, [(f"{i}.example", p) for i, p in enumerate(pages)]) == [f"Headline {i}\nLet x={i} be so." for i in range(5)]
