"""The pipeline's stages against plain versions of what they keep."""

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def kept_by_similarity(rows):
    """The smallest id of each component of texts alike by four fifths in their sets of five-word shingles, by all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label, changed = {i: i for i in sets}, True
    near = [(a, b) for a in sets for b in sets if a < b and (not (sets[a] | sets[b]) or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            changed |= max(label[a], label[b]) != low
            label[a] = label[b] = low
    return {*label.values()}


def test_stages_keep_what_plain_versions_keep(spark, tmp_path):
    import public_tokenizers
    import tiktoken
    from test_decontamination import by_alignments

    from sheetweave.llm import bpe, common, quality, toxicity

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    split = lambda t: [w for w in "".join(ch if ch.isalnum() else " " for ch in t.lower()).split()]
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary_path(bpe.RANKS)), special_tokens={})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        got = out.collect()
        if k < 4:
            assert out.columns == docs.columns and {(r.doc_id, r.text) for r in got} <= {*rows} and len(got) == len({r.doc_id for r in got}) > 0
        if name in ("quality", "toxicity"):
            module, column = (quality, "quality") if name == "quality" else (toxicity, "toxic")
            model = module.fit(common.labelled_sample(docs, labels, column, module.PER_CLASS))
            score = {i: float(model.score(*common.text_buffer([t or ""]))[0]) for i, t in rows}  # each text by itself
            assert {r.doc_id for r in got} == {i for i, s in score.items() if (s >= 0.3 if name == "quality" else s < 0.5)}
        if name == "near_dedup":
            assert {r.doc_id for r in got} == kept_by_similarity(rows)
        if name == "decontamination":
            assert {r.doc_id for r in got} == {i for i, t in rows if not any(by_alignments(split(t or ""), split(x)) for _, x in bench)}
        if name == "byte_bpe":
            for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows), strict=True):
                ids = plain.encode_ordinary(t or "")
                assert (r.doc_id, r.n_tokens, r.decoded_sha256) == (i, len(ids), hashlib.sha256((t or "").encode()).hexdigest())
                assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        docs = out
