"""Near-duplicates by shingle similarity, against all pairs."""

import random

import pytest

from sheetweave.llm import simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def sets_of(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def alike(a, b):
    return not (a | b) or 5 * len(a & b) >= 4 * len(a | b)


def expected(rows):
    """The smallest id of each component of all pairs."""
    sets, label = {i: sets_of(t) for i, t in rows}, {i: i for i, _ in rows}
    near = {i: [j for j in sets if alike(sets[i], sets[j])] for i in sets}
    while (new := {i: min(label[j] for j in near[i]) for i in near}) != label:
        label = new
    return set(label.values())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(0, None), (1, ""), (2, " \n "), (3, "Two words"), (4, "two  WORDS"), (5, "a b c d e"), (6, "a b c d f")]
    for k in range(40):  # copies with some words changed, from well above to well below 0.8
        text = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 200))]
        out.append((100 + 10 * k, " ".join(text)))
        for n in range(4):
            own = list(text)
            for at in rng.sample(range(len(own)), 1 + n):
                own[at] = f"x{rng.randint(0, 3000)}"
            out.append((101 + 10 * k + n, " ".join(own)))
    return out


def test_stage_keeps_one_of_texts_alike_by_four_fifths(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == expected(rows)
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").collect() == []


def test_large_groups_are_cut_into_blocks(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k:]])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grouped = simhash.coarse_groups(simhash._marks(docs, 5))
    roots = lambda group: {(r.node, r.root) for r in simhash.components(simhash.similar_links(docs, grouped, group=group)).collect()}
    assert roots(3) == roots(1000) and len(roots(3)) == 39  # all but the root itself
