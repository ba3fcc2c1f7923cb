"""Operators against plain loops of what they are to compute."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetweave.llm import ann, bpe, decontamination, licenses, lm, quality, rans, sharding, simhash, toxicity
from sheetweave.llm.common import text_buffer, word_hashes

DOC = "doc_id long, text string, found string, row int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOC)


def test_fingerprints_by_the_engines_own_hash(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["Ab", "c", "DÉ", "é", "x1", "-"]) for _ in range(k % 23))) for k in range(120)] + [(900, None), (901, "\t\n"), (902, "a\x0bb\x1cc a")]
    shingles, of = [], {}
    for i, t in rows:
        words = [w for w in "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
        of[i] = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        shingles += [(i, s) for s in of[i]]
    hashed = spark.createDataFrame(shingles, "i long, s string").select("i", F.xxhash64("s").alias("h")).collect()
    for i, _ in rows:
        own = [r.h % (1 << 64) for r in hashed if r.i == i]
        of[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
    got = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == of


def test_components_by_one_task_and_by_star_steps(spark):
    rng = random.Random(4)
    pairs = [(a, a + 1) for a in range(0, 300) if a % 50] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(90)] + [(5000, 4000 + k) for k in range(40)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    label = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    want = {k: v for k, v in label.items() if k != v}
    assert {r.node: r.root for r in simhash.components(df).collect()} == want
    assert {r.node: r.root for r in simhash.components(df, whole=3).collect() if r.node != r.root} == want
    held = [x for batch in simhash._stars(iter(df.toArrow().to_batches(max_chunksize=11)), most=40) for x in batch.to_pylist()]
    assert {r.node: r.root for r in simhash.components(spark.createDataFrame([(x["a"], x["b"]) for x in held], "a long, b long")).collect()} == want


def test_links_within_a_shard_equal_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, (60, 6), dtype=np.uint64), axis=1) for b in base]))
    for right in (np.zeros(len(fp), bool), rng.random(len(fp)) < 0.5):
        a, b = simhash._spanning(np.zeros(len(fp), np.int64), fp, right, 5)
        got = simhash.joined(np.arange(len(fp)), np.searchsorted(fp, a), np.searchsorted(fp, b))
        near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 5) & ((right[:, None] != right[None, :]) if right.any() else True)
        x, y = np.nonzero(near)
        want = simhash.joined(np.arange(len(fp)), x, y)
        if right.any():  # more may be linked: what lies near the first of the other side
            assert all(len({*got[want == r].tolist()}) == 1 for r in {*want.tolist()})
        else:
            assert np.array_equal(got, want)


def test_rows_alike_in_id_and_text_keep_one(spark):
    rows = [(1, "one two three four five six", f"c{k}", k) for k in range(5)] + [(2, "other", "c", 1)]
    out = simhash.keep_one(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(r.doc_id for r in out) == [1, 2] and out == simhash.keep_one(spark.createDataFrame(rows[::-1], DOC).repartition(3)).collect() or len(out) == 2


def test_index_recall_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 24))
    v = centres[rng.integers(0, 60, 20_000)] + rng.normal(size=(20_000, 24))
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())] + [(30_000, [1.0, 2.0]), (30_020, [2.0, 1.0]), (30_040, [5.0])], "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("key", F.lit("x"))
    got = {}
    for r in ann.nearest(df, every=500).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [k for k in got if k < 20_000]
    hit = 0
    for q in asked:
        score = v @ v[q]
        score[q] = -np.inf
        hit += len({*np.argsort(-score, kind="stable")[:20].tolist()} & {x[1] for x in got[q]})
        assert [x[0] for x in sorted(got[q])] == [*range(1, 21)]
    assert len(asked) == 40 and hit / (20 * len(asked)) >= 0.9 and ann.SHARE <= 0.15 and 20_000 > 4 * ann.BLOCK
    # rare lengths have their own candidates
    assert [x[1:] for x in got[30_000]] == [(30_020, 4.0)] and 30_040 not in got


def test_best_places_are_those_of_the_footrule():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    files = ann.InvertedFiles(v, ann.choose_pivots(v, 16))
    order = ann.permutations(rng.normal(size=(1, 8)), files.pivots)[0]
    place = {p: j for j, p in enumerate(order.tolist())}
    own = ann.permutations(v, files.pivots)
    n = len(order)
    distance = [sum(abs(place.get(p, n) - (row.tolist().index(p) if p in row else n)) for p in range(len(files.pivots))) for row in own]
    found, _ = files.nearest(v[0], order, 45)
    cut = sorted(distance)[44]
    assert all(distance[k] <= cut for k in found) and {k for k, d in enumerate(distance) if d < cut} <= {*found.tolist()}


def test_short_items_must_be_whole_and_names_may_clash(spark):
    bench = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(k))) for k in range(1, 12)], "item_id long, text string")
    rows = [(k, "so " + " ".join(f"i{k}w{j}" for j in range(k)) + " end") for k in range(1, 12)] + [(50 + k, " ".join(f"i{k}w{j}" for j in range(k - 1))) for k in range(2, 12)]
    found = {(r.doc_id, r.item_id, r.first_word, r.last_word, r.mismatches) for r in decontamination.overlaps(docs_of(spark, rows), bench).collect()}
    assert found == {(k, k, 1, k, 0) for k in range(1, 12)}
    for most in (decontamination.BROADCAST_ROWS, 0):  # the second by a shuffle
        assert sorted(r.doc_id for r in decontamination.clean(docs_of(spark, rows), bench, most).collect()) == [50 + k for k in range(2, 12)]
    assert decontamination.clean(docs_of(spark, rows).limit(0), bench).collect() == []


def test_licences_with_titles_and_sentences_about_copyright(spark):
    bsd = licenses.TEXTS["BSD-3-Clause"].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n2. ").replace(" 3. ", "\n3. ")
    rows = [(1, f"MIT License\n\nCopyright (c) 2020 Some Body\nAll rights reserved.\n\n{licenses.TEXTS['MIT']}\n"), (2, f"BSD 3-Clause License\n\nCopyright 2019-2021, The Authors\n\n{bsd}"), (3, "Copyright law is a broad subject\n(c) is a letter"), (4, "© 2021 X"), (5, ""), (6, licenses.TEXTS["Zlib"]), (7, "The Unlicense\n" + licenses.TEXTS["Unlicense"])]
    out = {r.doc_id: r for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert [out[k].license_id for k in range(1, 8)] == ["MIT", "BSD-3-Clause", None, None, None, "Zlib", "Unlicense"]
    assert out[3].digest != out[5].digest and out[4].digest == out[5].digest


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(400)], k=300))) for k in range(60)]
    return rows + [(100 + k, rows[k][1]) for k in range(10)] + [(200, None), (201, "one"), (None, "w1 w2 w3"), (201, "one")]


def test_scores_are_sums_of_conditionals_over_the_vocabulary(spark, corpus):
    docs = docs_of(spark, corpus)
    bits = 15
    counts = lm.corpus_counts(docs, bits)
    hashes = {i: word_hashes(*text_buffer([t or ""]))[0] for i, t in corpus}
    want = np.zeros(1 << bits, np.int64)
    for i, t in corpus:
        np.add.at(want, (word_hashes(*text_buffer([t or ""]))[0] >> np.uint64(64 - bits)).astype(np.int64), 1)
    assert np.array_equal(counts, want)
    tables = lm.Tables(counts)
    net = lm.trained(docs, spark.sparkContext.broadcast(tables), lm.Network.start(tables.share), 100_000)
    assert np.abs(net.nodes).max() > 0
    # the probabilities of all ids in one place sum to one (ids with a class of their own have a small share below the others)
    ids = lm._ids(hashes[0], bits)
    context = net.context(tables.class_of[ids].astype(np.int64), np.array([0, len(ids)]))[7:8]
    _, hidden, p = net.forward(context)
    every = np.arange(1 << bits)
    node, second = tables.path(every)
    z = net.halves(np.repeat(hidden, len(every), axis=0), node, tables)[1]
    share = np.exp(tables.below - np.logaddexp(0, np.where(second, -z, z)).sum(axis=1))
    assert abs(p[0, : lm.OWN].sum() + (p[0, lm.OWN + (every >> (bits - lm.FIRST_BITS))] * share).sum() - 1) < 1e-4
    # a text's score by a plain loop
    held = counts.astype(float)
    held[tables.class_of < lm.OWN] = 0
    got = net.log_likelihood(ids, np.array([0, len(ids)]), tables)
    for at in (0, 5, len(ids) // 2, len(ids) - 1):
        near = [int(tables.class_of[ids[at + s]]) if 0 <= at + s < len(ids) else lm.CLASSES for s in (-2, -1, 1, 2)]
        h = np.tanh(np.concatenate([net.embed[c] for c in near]) @ net.w1 + net.b1)
        out = h @ net.w2 + net.b2
        k, c = int(ids[at]), int(tables.class_of[ids[at]])
        score = out[c] - math.log(np.exp(out).sum())
        for depth in range(lm.FIRST_BITS, bits) if c >= lm.OWN else ():
            n, half = k >> (bits - depth), 1 << (bits - depth - 1)
            odds = math.log(held[(2 * n + 1) * half : (2 * n + 2) * half].sum() + 0.25) - math.log(held[2 * n * half : (2 * n + 1) * half].sum() + 0.25)
            if depth < lm.NODE_BITS:
                odds += net.nodes[(1 << depth) + n] @ h[: lm.UNITS]
            score -= math.log1p(math.exp(-odds if k >> (bits - depth - 1) & 1 else odds))
        assert abs(score - got[at]) < 1e-3


def plain_training(net, ids, bounds, tables, seen):
    """A pass over the words by the formulas, with a sum for each word and weight."""
    classes = tables.class_of[ids].astype(np.int64)
    context = net.context(classes, bounds)
    for a in range(0, len(ids), lm.BATCH):
        c, y = context[a : a + lm.BATCH], classes[a : a + lm.BATCH]
        x = net.embed[c].reshape(len(c), -1)
        hidden = np.tanh(x @ net.w1 + net.b1)
        p = np.exp(hidden @ net.w2 + net.b2)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        d_hidden = p @ net.w2.T
        rest = np.flatnonzero(y >= lm.OWN)
        node, second = tables.path(ids[a : a + lm.BATCH][rest])
        weight, own = np.ascontiguousarray(net.nodes)[node], hidden[rest, : lm.UNITS]
        z = tables.bias[node] + np.matmul(weight, own[:, :, None])[:, :, 0]
        error = (1 / (1 + np.exp(-z)) - second) / len(y)
        d_hidden[rest, : lm.UNITS] += np.matmul(error[:, None, :], weight)[:, 0]
        at = (node[:, :, None] * lm.UNITS + np.arange(lm.UNITS)).ravel()
        d_nodes = np.bincount(at, weights=(error[:, :, None] * own[:, None]).ravel(), minlength=net.nodes.size).reshape(net.nodes.shape)
        d_hidden *= 1 - hidden * hidden
        place = (c.ravel()[:, None] * lm.DIM + np.arange(lm.DIM)).ravel()
        d_embed = np.bincount(place, weights=(d_hidden @ net.w1.T).ravel(), minlength=net.embed.size).reshape(net.embed.shape)
        for name, g in {"embed": d_embed, "w1": x.T @ d_hidden, "b1": d_hidden.sum(axis=0), "w2": hidden.T @ p, "b2": p.sum(axis=0), "nodes": d_nodes}.items():
            seen[name] = seen.get(name, 1e-4) + g * g
            getattr(net, name)[...] -= lm.RATE * g / np.sqrt(seen[name])


def test_network_trains_by_the_formulas_in_less_time():
    rng = np.random.default_rng(4)
    bounds = np.cumsum([0, *rng.integers(0, 4, 300), *rng.integers(0, 900, 60), 0])
    ids = (1 << 15) * rng.random(bounds[-1]) ** 6
    ids = ids.astype(np.int64) * 7919 % (1 << 15)
    tables, took = lm.Tables(np.bincount(ids, minlength=1 << 15)), {"plain": [], "own": []}
    for _ in range(5):
        plain, own = lm.Network.start(tables.share), lm.Network.start(tables.share)
        began = time.thread_time()
        plain_training(plain, ids, bounds, tables, {})
        took["plain"].append(time.thread_time() - began)
        seen, began = np.full(len(own.flat), 1e-4, np.float32), time.thread_time()
        own.train(ids, bounds, tables, seen)
        took["own"].append(time.thread_time() - began)
    assert all(np.abs(getattr(plain, k) - getattr(own, k)).max() < 1e-4 for k in ("embed", "w1", "b1", "w2", "b2", "nodes"))
    assert np.abs(own.nodes).max() > 0.01 and min(took["own"]) < 0.75 * min(took["plain"])
    own.train(ids[:0], np.zeros(3, np.int64), tables, seen)  # texts without words
    assert len(own.log_likelihood(ids[:0], np.zeros(3, np.int64), tables)) == 0


def test_scores_depend_on_the_corpus_and_not_on_partitions(spark, corpus):
    docs = docs_of(spark, corpus)
    key = lambda r: (str(r.doc_id), r.n_words, r.log_likelihood, r.memory)
    one, other = (sorted(key(r) for r in lm.pseudo_likelihood(df).collect()) for df in (docs.coalesce(1), docs.repartition(7)))
    assert len(one) == len(corpus) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 and abs(a[3] - b[3]) < 1e-9 for a, b in zip(one, other, strict=True))
    by = {r.doc_id: r for r in lm.pseudo_likelihood(docs).collect()}
    twice = [by[100 + k].memory for k in range(10)]
    once = [by[k].memory for k in range(10, 60)]
    assert np.mean([a > b for a in twice for b in once]) > 0.9 and by[200].n_words == 0 and by[200].perplexity is None
    assert lm.pseudo_likelihood(docs.limit(0)).collect() == []


def test_landmarks_by_a_plain_count(spark, corpus):
    rows = [(i, t) for i, t in corpus if i is not None]
    seen, marks = {}, {}
    for k, (_, t) in enumerate(rows):
        h = [int(x) for x in word_hashes(*text_buffer([t or ""]))[0]]
        context = lm.contexts(np.array(h, np.uint64), np.array([0, len(h)])) if h else []
        marks[k] = [(int(c), w) for c, w in zip(context, h, strict=True) if c % np.uint64(lm.LANDMARK) == 0]
        for c, w in marks[k]:
            seen.setdefault(c, {}).setdefault(w, 0)
            seen[c][w] += 1
    share = lambda c, w: seen[c][w] > 1
    want = {i: sum(share(*m) for m in marks[k]) / len(marks[k]) if marks[k] else 0 for k, (i, _) in enumerate(rows)}
    got = {r.doc_id: r.memory for r in lm.pseudo_likelihood(docs_of(spark, rows)).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_every_context_is_counted(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 5000, raising=False)
    monkeypatch.setattr(lm, "PART_BYTES", 9000, raising=False)
    docs = docs_of(spark, corpus)
    n_bytes = sum(len(t or "") for _, t in corpus)
    tables = lm.Tables(lm.corpus_counts(docs, lm.vocabulary_bits(n_bytes)))
    net = lm.trained(docs, spark.sparkContext.broadcast(tables), lm.Network.start(tables.share), n_bytes)
    places, seen = [], {}
    for _, t in corpus:
        words = ["<", *(t or "").split(), ">"]
        places.append([((words[k - 1], words[k + 1]), words[k]) for k in range(1, len(words) - 1)])
        for around, word in places[-1]:
            seen.setdefault(around, {}).setdefault(word, 0)
            seen[around][word] += 1
    want = []
    for (i, t), own in zip(corpus, places, strict=True):
        hashes = word_hashes(*text_buffer([t or ""]))[0]
        p = np.exp(net.log_likelihood(lm._ids(hashes, tables.bits), np.array([0, len(hashes)]), tables))
        share = [(seen[a][w] - lm.DISCOUNT + lm.DISCOUNT * len(seen[a]) * x) / sum(seen[a].values()) for (a, w), x in zip(own, p, strict=True)]
        want.append((str(i), len(own), sum(map(math.log, share)), np.mean([seen[a][w] > 1 for a, w in own]) if own else 0))
    got = [(str(r.doc_id), r.n_words, r.log_likelihood, r.memory) for r in lm.pseudo_likelihood(docs).collect()]
    assert len(got) == len(want)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 and abs(a[3] - b[3]) < 1e-9 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_order_tells_words_with_the_same_first_bits_apart():
    rng = np.random.default_rng(2)
    for n, contexts, low in ((0, 1, 1), (1, 1, 1), (500, 1, 3), (2000, 40, 1 << 62), (2000, 1500, 5), (3000, 700, 9)):
        context = rng.integers(0, contexts, n).astype(np.uint64) << np.uint64(50)
        words = rng.integers(0, low, n).astype(np.uint64) + (rng.integers(0, 2, n).astype(np.uint64) << np.uint64(63))
        got, want = lm._order(context, words), np.lexsort((words, context))
        assert np.array_equal(np.sort(got), np.arange(n))
        assert np.array_equal(context[got], context[want]) and np.array_equal(words[got], words[want])


def test_words_are_hashed_alike_by_slices(monkeypatch):
    rng = random.Random(3)
    texts = ["", *(" ".join(rng.choices(["Été", "two", "three3", "x"], k=rng.randrange(40))) for _ in range(50)), "", "one", ""]
    raw, offsets = text_buffer(texts)
    want = word_hashes(raw, offsets)
    for most in (1, 100, 1000, 1 << 20):
        monkeypatch.setattr(lm, "HASH_BYTES", most)
        assert all(np.array_equal(a, b) for a, b in zip(lm._hashed(raw, offsets), want, strict=True))


def test_pages_of_rows_that_no_bit_parts(spark):
    rng = random.Random(1)
    rows = [(None, "x" * rng.randint(0, 40)) for _ in range(300)] + [(7, "y" * 10)] * 250 + [(8, "z" * 500)]
    out = sharding.shards(docs_of(spark, rows), limit=200).collect()
    size = {}
    for r in out:
        size.setdefault(r.shard, []).append(r.n_bytes)
    assert len(out) == len(rows) and all(sum(v) <= 200 or len(v) == 1 for v in size.values())
    assert sum(len(v) == 1 for v in size.values()) < 30  # unlike sizes share pages
    one, cut = (sharding._pages(spark.createDataFrame([("1", 1, 3)] * 50, "bits string, doc_id long, n_bytes long"), 12, s).groupBy("shard").count().collect() for s in (100, 7))
    assert sorted(map(tuple, one)) == sorted(map(tuple, cut)) and {r["count"] for r in one} <= {2, 3}


def test_other_tokenizers_go_through_the_library(spark, tmp_path):
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    rows = [(1, "Hello  World\nÉté 日本"), (2, None), (3, "a" * 5000)]
    rans.write(docs_of(spark, rows), str(tmp_path), path)
    encoder = rans.token_encoder(path)
    assert isinstance(encoder, rans.PlainEncoder)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rans.read(spark, str(tmp_path)).collect()}
    assert got == {i: [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, rans.END] for i, t in rows}
    large = json.loads(encoder.tokenizer.to_str())
    large["model"]["vocab"] |= {f"<more {k}>": k for k in range(60_000, 70_000)}
    (tmp_path / "large.json").write_text(json.dumps(large))
    with pytest.raises(ValueError):
        rans.token_encoder(str(tmp_path / "large.json"))


def test_stretches_between_checkpoints_are_decoded_side_by_side():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 5000, 128 * 2048, 128 * 2048 + 1, 700_001):
        ids = np.minimum(rng.zipf(1.4, n), 40_000).astype(np.uint16)
        coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=rans.IDS)))
        payload = coder.encode(ids)
        assert np.array_equal(coder.decode(payload), ids)
        marks = rans._HEAD.unpack_from(payload)[3]
        parts = [coder.decode(payload, k, k + 1) for k in range(marks)]
        assert np.array_equal(np.concatenate([*parts, ids[:0]]), ids)


def test_filters_slide_and_keep_the_largest_value():
    rng = np.random.default_rng(4)
    model = toxicity.fit([])
    model.table = rng.normal(size=model.table.shape).astype(np.float32)
    model.table[0] = 0
    model.bias = [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    texts = ["a b c d e f", "", "one", "x y"]
    hashes, bounds = word_hashes(*text_buffer(texts))
    got, *_ = model.pooled(hashes, bounds)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        own = [model.table[k] for k in toxicity._ids(hashes[a:b])]
        for k, width in enumerate(toxicity.WIDTHS):
            padded = [*own, *[np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS))]
            windows = [model.bias[k] + sum(padded[s + j] @ model.filters[k][j] for j in range(width)) for s in range(len(own))]
            want = np.maximum(np.max(windows, axis=0), 0) if own else 0
            assert np.allclose(got[i, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS], want, atol=1e-4)


def test_filters_add_to_word_ratios(spark):
    """A word is toxic only right behind another: word ratios alone can't tell."""
    rng = random.Random(7)
    other = [f"v{k}" for k in range(40)]
    sample = []
    for k in range(500):
        w = rng.choices(other, k=25)
        at = rng.randint(0, 20)
        w[at : at + 3] = ["you", "fool", "so"] if k % 2 else ["fool", "so", "you"]
        sample.append((" ".join(w), k % 2))
    model = toxicity.fit(sample[:400])
    held = sample[400:]
    score = model.score(*text_buffer([t for t, _ in held]))
    assert np.mean((score >= 0.5) == np.array([y == 1 for _, y in held])) >= 0.85
    texts = [word_hashes(*text_buffer([t]))[0] for t, _ in sample[:400]]
    ratio = toxicity.log_ratio_bound(texts, np.array([y for _, y in sample[:400]]))
    alone = np.array([ratio[toxicity._ids(word_hashes(*text_buffer([t]))[0])].max() for t, _ in held])
    assert max(np.mean((alone > c) == np.array([y == 1 for _, y in held])) for c in np.linspace(-1, 1, 21)) < 0.75


def test_dual_coordinate_descent_closes_the_gap():
    rng = np.random.default_rng(3)
    y = (rng.random(200) < 0.4).astype(int)
    features = [np.unique(rng.integers(0, 60, 12) + 40 * v).astype(np.int32) for v in y]
    scale = quality.log_count_ratio(features, y)
    w, bias = quality.dual_coordinate_descent(features, scale, y)
    sign, n = np.where(y == 1, 1.0, -1.0), len(y)
    cost = np.where(y == 1, quality.COST * n / (2 * (y == 1).sum()), quality.COST * n / (2 * (y == 0).sum()))
    size = np.array([max(1.0, np.sqrt((scale[f] ** 2).sum())) for f in features])
    x = np.zeros((n, quality.DIM))
    for i, f in enumerate(features):
        x[i, f] = scale[f] / size[i]
    u = np.divide(w, scale, out=np.zeros_like(w), where=scale != 0)
    primal = lambda u, b: 0.5 * (u @ u + b * b) + (cost * np.maximum(0, 1 - sign * (x @ u + b))).sum()
    best = primal(u, bias)
    for _ in range(200):  # no step in any direction tried makes it much smaller
        d = rng.normal(size=quality.DIM) * (scale != 0)
        for t in (1e-3, 1e-2, 0.1):
            assert primal(u + t * d / np.linalg.norm(d), bias + t * rng.normal()) >= best * 0.995


@pytest.mark.parametrize("run, column", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_scores_of_an_empty_table(spark, run, column):
    docs = docs_of(spark, [(1, "a")])
    labels = spark.createDataFrame([(1, 1)], f"doc_id long, {column} int")
    assert run(docs.limit(0), labels).collect() == []
