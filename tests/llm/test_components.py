"""Labels of components against a search by hand, and how often edges are worked on."""

import random

import pytest

from tidemark.llm import components, jaccard_join


def searched(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {}
    for start in sorted(near):
        todo = [start] if start not in label else []
        while todo:
            at = todo.pop()
            if at not in label:
                label[at] = start
                todo += near[at]
    return label


def told(labels):
    rows = labels.collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.label for r in rows}


r = random.Random(8)
GRAPHS = {
    "empty": [],
    "loop": [(4, 4), (1, 2)],
    "path": [(i + 1, i) for i in range(40)],
    "star around the greatest": [(99, i) for i in range(30)],
    "two levels of stars": [(100 + i // 5, i) for i in range(50)] + [(100 + i, 200) for i in range(10)],
    "random": [(r.randrange(120), r.randrange(120)) for _ in range(80)],
}


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


@pytest.mark.parametrize("name", GRAPHS)
def test_labels(spark, name):
    edges = [e for e in GRAPHS[name] if e[0] != e[1]]
    assert told(components.least_labels(frame(spark, GRAPHS[name]))) == searched(edges)


@pytest.mark.parametrize("first", [0, 30, 80])
def test_labels_with_further_edges(spark, first):
    edges = [e for e in GRAPHS["random"] if e[0] != e[1]]
    labels = components.least_labels(frame(spark, edges[:first]))
    assert told(components.with_edges(labels, frame(spark, edges[first:]))) == searched(edges)


def test_links_are_worked_on_once(spark, monkeypatch):
    """Rounds with other heads add links: those found before are not gone through again,
    and no round of labels goes through all of them."""
    r, n = random.Random(6), 60
    rows = []
    for group in range(2):
        base = [f"w{r.randrange(10**9)}" for _ in range(400)]
        for i in range(n):
            copy = list(base)
            for at in r.sample(range(0, 400, 10), 9 if i != n // 2 else 0):
                copy[at] = f"x{r.randrange(10**9)}"
            rows.append((group * n + i, " ".join(copy)))
    made = []
    for module in (components, jaccard_join):
        kept = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, label, kept=kept: made.append((label, kept(df, label))) or made[-1][1])
    monkeypatch.setattr(components, "discard", lambda *tables: None)
    monkeypatch.setattr(jaccard_join, "discard", lambda *tables: None)
    got = {x.doc_id: x.component_id for x in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {i: i // n * n for i in range(2 * n)}
    count = lambda *labels: sum(df.count() for label, df in made if label in labels)
    links = count("jaccard-closer", "jaccard-more-links") + next(df.count() for label, df in made if label == "jaccard-links")
    rounds = sum(label == "jaccard-closer" for label, _ in made)
    assert rounds > 1 and links >= 2 * n - 2
    # Those between labels, of the smaller graphs, included.
    assert count("components-edges") < 1.5 * links
