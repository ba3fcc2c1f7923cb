"""Overlaps against all alignments, without seeds."""

import random
from itertools import combinations

import numpy as np

from sheetweave.llm import decontamination


def test_masks_lose_no_pattern_of_substitutions():
    for n, k in ((15, 3), (14, 2), (13, 2), (12, 2)):
        placed = [{at + o for o, bit in enumerate(m) if bit == "1"} for m in decontamination.MASKS for at in range(n - len(m) + 1)]
        assert all(any(not own & {*lost} for own in placed) for lost in combinations(range(n), k))


def by_alignments(doc, item):
    """First and last word and the fewest mismatches over all alignments of stretches of the item with the document."""
    w = min(15, len(item))
    if not item or len(doc) < w:
        return None
    most = w // 5 if len(item) >= 12 else 0  # short items must be whole
    alike = np.array(item)[:, None] == np.array(doc)[None, :]
    m, n = len(item) - w + 1, len(doc) - w + 1
    bad = w - sum(alike[j : j + m, j : j + n].astype(int) for j in range(w))
    at = np.nonzero(bad <= most)[1]
    return (int(at.min()), int(at.max()) + w - 1, int(bad.min())) if len(at) else None


def test_overlaps_match_all_alignments(spark):
    rng = random.Random(11)
    items = {k: [f"t{rng.randint(0, 400)}" for _ in range(rng.choice([12, 13, 14, 15, 16, 20, 30]))] for k in range(30)}
    docs = {}
    for k in range(240):
        own = list(items[k % 30])
        for at in rng.sample(range(len(own)), min(rng.randint(1, 5), len(own) // 5 + 1)):
            own[at] = f"x{rng.randint(0, 400)}"
        docs[k] = [*(f"a{j}" for j in range(rng.randint(0, 9))), *own, "end"]
    text = lambda rows: [(k, " ".join(w)) for k, w in rows.items()]
    got = decontamination.overlaps(spark.createDataFrame(text(docs), "doc_id long, text string"), spark.createDataFrame(text(items), "item_id long, text string")).collect()
    want = {(d, i): hit for d, doc in docs.items() for i, item in items.items() if (hit := by_alignments(doc, item))}
    assert {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.mismatches) for r in got} == want
