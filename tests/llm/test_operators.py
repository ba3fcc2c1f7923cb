"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, extra columns; against plain versions."""

import random
import zlib

import numpy as np
import pytest

from sheetweave.llm import ann, bpe, decontamination, licenses, lm, quality, rans, sharding, simhash, toxicity

DOC = "doc_id long, text string, hash string, key int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    plain = [(k, " ".join(word() for _ in range(rng.randint(5, 60)))) for k in range(10, 40)]
    return [(0, None), (1, ""), (2, " \n "), (3, "été Ça, É!"), (4, "word " * 30_000), *plain, (40, plain[0][1]), (41, plain[0][1] + " more"), (12, plain[2][1]), (None, "no id")]


@pytest.mark.parametrize("run", [simhash.near_duplicates, licenses.scan, lm.pseudo_likelihood, sharding.shards, rans.round_trip, bpe.round_trip_digests])
def test_every_row_comes_back_and_none_of_an_empty_table(spark, odd, run):
    docs = docs_of(spark, odd)
    assert sorted(str(r.doc_id) for r in run(docs).collect()) == sorted(str(i) for i, _ in odd)
    assert run(docs.limit(0)).collect() == []


def test_simhash_matches_brute_force(spark, odd):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    near = [(100 + k, " ".join(base[: 200 + rng.randint(0, 6)])) for k in range(30)]
    rows = [(i, t) for i, t in odd if i is not None] + near
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    mine = {i: simhash.fingerprint(t) for i, t in rows}
    assert all(int(r.fingerprint, 16) == mine[r.doc_id] for r in got) and mine[0] == 0
    label = {i: i for i in mine}
    for _ in mine:
        label = {i: min(label[j] for j in mine if (mine[i] ^ mine[j]).bit_count() <= 3) for i in mine}
    assert {r.doc_id: r.component_id for r in got} == label


def test_one_row_of_each_component_is_kept(spark):
    text = [" ".join(f"{stem}{k}" for k in range(40)) for stem in "pqrst"]
    rows = [(5, text[0]), (5, text[1]), (3, text[0]), (None, text[2]), (None, text[2]), (None, text[3]), (9, text[3]), (9, text[3]), (2, text[4])]
    out = simhash.keep_one(docs_of(spark, rows))
    assert out.columns == ["doc_id", "text", "hash", "key"]
    key = lambda x: (str(x[0]), x[1])
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted([(3, text[0]), (5, text[1]), (None, text[2]), (9, text[3]), (2, text[4])], key=key)
    assert simhash.keep_one(docs_of(spark, rows).limit(0)).collect() == []


def test_rows_are_cleaned_one_by_one(spark):
    item = " ".join(f"t{k}" for k in range(30))
    bench = spark.createDataFrame([(None, item), (None, "other words of an item that nobody has")], "item_id long, text string")
    rows = [(None, item), (None, "clean"), (1, "so " + item), (1, "clean too"), (2, None)]
    out = decontamination.clean(docs_of(spark, rows), bench)
    assert out.columns == ["doc_id", "text", "hash", "key"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(None, "clean"), (1, "clean too"), (2, None)]))


def test_large_shards_are_cut_into_blocks(spark):
    rng = np.random.default_rng(1)
    fp = np.unique(np.concatenate([rng.integers(0, 2**63, 40), 7 ^ (1 << rng.integers(0, 60, 60)), 7 ^ (1 << rng.integers(0, 60, 60)) ^ (1 << rng.integers(0, 60, 60))]).astype(np.int64))
    distinct = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    root = lambda df: {r.node: r.root for r in simhash.components(df).collect()}
    assert root(simhash.links(distinct)) == root(simhash.links(distinct, shard=7))


def test_round_trip_of_token_files(spark, odd, tmp_path):
    docs = docs_of(spark, [(i, t) for i, t in odd if i is not None])
    rans.write(docs, str(tmp_path))
    got = rans.read(spark, str(tmp_path)).collect()
    library = rans.token_encoder(bpe.vocabulary_path(rans.TOKENIZER)).tokenizer
    plain = sorted((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in odd if i is not None)
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == plain
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])


def test_coder_checkpoints_and_damage():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 300_000), 49_000).astype(np.uint16)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=1 << 16)))
    payload = coder.encode(ids)
    assert np.array_equal(coder.decode(payload), ids)
    assert np.array_equal(coder.decode(payload, 1, 2), ids[128 * 2048 : 256 * 2048])
    with pytest.raises(ValueError):
        coder.decode(payload[:-1] + bytes([payload[-1] ^ 1]))


def test_byte_bpe_equals_tiktoken(spark, odd):
    import public_tokenizers
    import tiktoken

    path = bpe.vocabulary_path(bpe.RANKS)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(4)
    parts = ["a", "B", " ", "  ", "\n", ".", "é", "日", "😀", "́", "​", "\xa0", "'s", "<|endoftext|>", "-" * 40]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))) for k in range(300)]
    docs = docs_of(spark, rows)
    encoded = {r.doc_id: r for r in bpe.encode(docs, offsets=True).collect()}
    for i, t in rows:
        assert encoded[i].ids == plain.encode_ordinary(t)
        assert all(a < b for a, b in zip(encoded[i].starts, encoded[i].ends)) and (not t or encoded[i].ends[-1] == len(t))
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(docs)).collect()} == dict(rows)


def test_overlaps_tolerate_substitutions(spark):
    item = [f"t{k}" for k in range(30)]
    changed = [*item[:9], "other", *item[10:]]
    rows = [(1, "a b " + " ".join(item) + " c"), (2, " ".join(changed)), (3, " ".join(item[:10])), (4, None), (5, ""), (6, "x y z one two three four five six x")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "One two three, four five six!"), (9, None), (10, "x y")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.mismatches) for r in decontamination.overlaps(docs_of(spark, rows), bench).collect()}
    assert got[1, 7] == (2, 31, 0) and (2, 7) in got and got[6, 8] == (3, 8, 0) and {k[0] for k in got} == {1, 2, 6}
    parts = {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs_of(spark, rows), bench, broadcast_seeds=10).collect()}
    assert parts == set(got)
    assert decontamination.overlaps(docs_of(spark, rows), bench.limit(0)).collect() == []
    assert sorted(r.doc_id for r in decontamination.clean(docs_of(spark, rows), bench).collect()) == [3, 4, 5]


def test_shards_hold_the_limit(spark, odd):
    rows = [(i, t) for i, t in odd] + [(77, "same")] * 40
    out = sharding.shards(docs_of(spark, rows), limit=60).collect()
    size: dict = {}
    for r in out:
        size.setdefault(r.shard, []).append(r.n_bytes)
    assert len(out) == len(rows) and all(sum(v) <= 60 or len(v) == 1 for v in size.values())


def test_license_texts_and_notices(spark):
    mit = "Copyright (c) 2020 Somebody\n" + licenses.TEXTS["MIT"].upper().replace("SUBLICENSE", "sub-licence")
    out = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(docs_of(spark, [(1, mit), (2, "prose\nReleased under the MIT Licence.\nmore"), (3, None), (4, "x")])).collect()}
    assert out == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, "")}


def test_neighbours_on_odd_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 16))
    rows = [(k, [float(x) for x in v[k]]) for k in range(400)] + [(500 + k, [float(x) for x in v[20]]) for k in range(60)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df).collect()
    good = [(i, np.array(x)) for i, x in rows if i is not None and i < 900]
    hit = 0
    for q in {r.query_id for r in got}:
        own = dict(good)[q]
        exact = [i for _, i in sorted((-round(float(x @ own), 9), i) for i, x in good if i != q)[:20]]
        mine = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert len(mine) == 20
        hit += len({*exact} & {*mine})
    assert hit / (20 * len({r.query_id for r in got})) >= 0.9 and {r.query_id for r in got} == {i for i, _ in good if i % 20 == 0}
    assert ann.nearest(df.limit(0)).collect() == []


@pytest.mark.parametrize("module, run, marker, threshold", [(toxicity, toxicity.score_toxicity, "scum", 0.5), (quality, quality.score_quality, "!!!", 0.3)])
def test_classifiers_learn_a_marker(spark, odd, module, run, marker, threshold):
    rng = random.Random(9)
    words = [f"v{k}" for k in range(60)]
    bad = module is toxicity
    rows = [(k, " ".join([rng.choice(words) for _ in range(30)] + [marker] * (k % 2) + ["end"])) for k in range(100, 400)]
    labels = spark.createDataFrame([(k, int((k % 2 == 1) == bad)) for k, _ in rows], f"doc_id long, {'toxic' if bad else 'quality'} int")
    out = [r for r in run(docs_of(spark, rows + odd), labels).collect()]
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in out)
    held = [r for r in out if r.held_out and r.doc_id and r.doc_id >= 100]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([(r.predicted == 1) == ((r.doc_id % 2 == 1) == bad) for r in held]) >= 0.95
    keep, scored = toxicity.keep_clean if bad else quality.keep_good, docs_of(spark, rows + odd)
    kept = keep(scored, labels)
    assert kept.columns == scored.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.predicted == 1 - bad)
    assert keep(scored.limit(0), labels).collect() == [] and keep(docs_of(spark, odd), labels.limit(0)).count() == len(odd)
    assert len(run(docs_of(spark, odd), labels.limit(0)).collect()) == len(odd)


def test_network_beats_counts_alone(spark):
    rng = random.Random(6)
    pairs = [("north", "wind"), ("red", "stone"), ("old", "river"), ("blue", "glass")]
    rows = [(k, " ".join(w for _ in range(400) for w in rng.choice(pairs))) for k in range(40)]
    out = lm.pseudo_likelihood(docs_of(spark, rows)).collect()
    assert np.mean([r.perplexity for r in out]) < 6 and all(r.n_words == 800 for r in out)  # eight words alike: 8 by counts


def test_chunk_encoder_equals_the_library():
    encoder = rans.token_encoder(bpe.vocabulary_path(rans.TOKENIZER))
    rng = np.random.default_rng(5)
    signs = [*"aZéÉßÿÞ1 9.,'!s t\n\t\u0301İΣ“<|>\x85\xa0µªvdlremLL½\x1c"]
    texts = ["", "It's THE end!'s we'll they'RE 3.14 --- <|endoftext|>", "İstanbul ΣΑΣ. 日本 ẞ", *("".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(3000))]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for most in (encoder.most, 50):  # the second time memory starts anew with every text
        own = rans.WordEncoder(encoder.tokenizer, most)
        assert [np.frombuffer(own.encode([rans.spaced(t)])[0], np.int32).tolist() for t in texts] == want
