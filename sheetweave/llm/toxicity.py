"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (lower-cased runs of letters and digits) are hashed to rows of an embedding table; filters of several widths slide
over them and each filter's maximum over the whole text goes to a logistic output. The logit is shifted by a threshold
calibrated for the text's language, which is told from the text's own function words, so 0.5 is the cut everywhere.
The table's first column starts at a lower bound of each word's class log-count ratio, which the first filter of each
width reads; everything is then trained together.

Null and empty texts have no window: all maxima are zero and they get the score of the bias. Repeated rows are scored
each. Without labels of both classes the score is a half less a margin (nothing is rejected). Columns other than doc_id
and text are not read. An empty table gives an empty result. The fit uses at most PER_CLASS labelled texts of each class and
16 MB of them; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import U64, append_scores, kept_by_score, labelled_sample, mix, sigmoid, text_buffer, word_hashes

#: Bound of the labelled sample, for each class.
PER_CLASS = 3000
BUCKETS, DIM, WIDTHS, FILTERS, STEPS, BATCH = 1 << 18, 8, (1, 2, 3), 8, 500, 48
#: Frequent function words by which a language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as be at by this from not or have an they which",
    "fr": "le la les des et un une du est dans que qui pour pas sur au par plus avec ce il sont ne se",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "es": "el los de y en las del se por con una para su al lo como más pero sus le ya o este sí",
}


def _ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes % U64(BUCKETS - 1)).astype(np.int64) + 1


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    entries = []
    for k, words in enumerate(FUNCTION_WORDS.values()):
        raw, offsets = text_buffer([words])
        entries += [(h, k) for h in word_hashes(raw, offsets)[0]]
    entries.sort()
    return np.array([h for h, _ in entries], U64), np.array([k for _, k in entries])


_LANG_HASHES, _LANG_OF = _language_table()


def languages(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The language with most function words in each text; the last index + 1 where there is none."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    counts = np.zeros((len(bounds) - 1, len(FUNCTION_WORDS)), np.int64)
    for h, k in zip(_LANG_HASHES, _LANG_OF, strict=True):
        counts[:, k] += np.bincount(rows[hashes == h], minlength=len(bounds) - 1)
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(FUNCTION_WORDS))


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray

    def pooled(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Maxima of each filter over each text; the padded ids, each text's start among them, and the windows' values."""
        n, pad = len(bounds) - 1, max(WIDTHS) - 1
        sizes = np.diff(bounds) + pad + 1
        starts = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()) + pad, np.int64)
        ids[np.arange(len(hashes)) + np.repeat(starts - bounds[:-1], np.diff(bounds))] = _ids(hashes)
        x = self.table[ids]
        # a window begins at a word; behind a text's end there is none, so no text reads the next one's words
        behind = ((starts + sizes - pad - 1)[:, None] + np.arange(pad + 1)).ravel()
        values = []
        for width, w, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            out = x[: len(x) - pad] @ w[0]
            for j in range(1, width):
                out += x[j : len(x) - pad + j] @ w[j]
            out = np.maximum(out + b, 0)
            out[behind] = 0
            values.append(out)
        maxima = np.concatenate([np.maximum.reduceat(v, starts, axis=0) for v in values], axis=1) if n else np.zeros((0, len(self.out)), np.float32)
        return maxima, ids, starts, values

    def logits(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.pooled(hashes, bounds)[0] @ self.out + self.out_bias

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, bounds = word_hashes(raw, offsets)
        return sigmoid(self.logits(hashes, bounds) - self.cuts[languages(hashes, bounds)])


def log_ratio_bound(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each bucket the log-count ratio of the texts that hold it, less 1.5 standard errors towards zero."""
    counts = np.full((2, BUCKETS), 0.5)
    for t, label in zip(texts, y, strict=True):
        counts[int(label)][np.unique(_ids(t))] += 1
    ratio = np.log(counts[1] / (1 + (y == 1).sum())) - np.log(counts[0] / (1 + (y == 0).sum()))
    return (np.sign(ratio) * np.maximum(0, np.abs(ratio) - 1.5 * np.sqrt((1 / counts).sum(axis=0)))).astype(np.float32)


def fit(sample: list[tuple[str, int]], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    width = FILTERS * len(WIDTHS)
    model = Model(
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, width).astype(np.float32), -1.0, np.zeros(len(FUNCTION_WORDS) + 1),
    )
    model.table[0] = 0
    y = np.array([v for _, v in sample], dtype=np.float32)
    if len({*y.tolist()}) < 2:
        return model
    texts = [word_hashes(*text_buffer([t]))[0] for t, _ in sample]
    model.table[1:, 0] = log_ratio_bound(texts, y)[1:]
    for w in model.filters:
        w[:, :, 0], w[:, 0, 0] = 0, 1
    model.out[::FILTERS] = 1
    dense = [*model.filters, *model.bias, model.out]
    seen, table_seen = [np.full(p.shape, 1e-2, np.float32) for p in dense], np.full(BUCKETS, 1e-2, np.float32)
    bias_seen, by_class = 1e-2, [np.flatnonzero(y == k) for k in (0, 1)]
    calibration = np.zeros(len(y), bool)
    for own in by_class:
        calibration[own[::5]] = len(own) >= 50
    train = [own[~calibration[own]] for own in by_class]
    for _ in range(STEPS):
        rows = np.concatenate([rng.choice(train[0], BATCH * 2 // 3), rng.choice(train[1], BATCH // 3)])
        bounds = np.cumsum([0, *(len(texts[i]) for i in rows)])
        maxima, ids, starts, values = model.pooled(np.concatenate([texts[i] for i in rows]), bounds)
        error = ((sigmoid(maxima @ model.out + model.out_bias) - y[rows]) / len(rows)).astype(np.float32)
        back = error[:, None] * model.out[None, :]
        d_filters, d_bias, touched, d_rows = [np.zeros_like(f) for f in model.filters], [np.zeros_like(b) for b in model.bias], [], []
        ends = np.append(starts[1:], len(values[0]))
        for k, v in enumerate(values):
            for i in range(len(rows)):
                g = back[i, k * FILTERS : (k + 1) * FILTERS]
                at = starts[i] + v[starts[i] : ends[i]].argmax(axis=0)
                g = g * (v[at, np.arange(FILTERS)] > 0)
                d_bias[k] += g
                for j in range(WIDTHS[k]):
                    touched.append(ids[at + j])
                    d_filters[k][j] += model.table[ids[at + j]].T * g
                    d_rows.append((model.filters[k][j] * g).T)
        grads = [*d_filters, *d_bias, maxima.T @ error]
        for p, g, s in zip(dense, grads, seen, strict=True):
            s += g * g
            p -= 0.05 * g / np.sqrt(s)
        bias_seen += float(error.sum()) ** 2
        model.out_bias -= 0.05 * float(error.sum()) / bias_seen**0.5
        where, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(where), DIM), np.float32)
        np.add.at(total, inverse, np.concatenate(d_rows))
        total[where == 0] = 0
        table_seen[where] += (total**2).mean(axis=1)
        model.table[where] -= 0.1 * total / np.sqrt(table_seen[where])[:, None]
    model.cuts = calibrated(model, texts, y, np.flatnonzero(calibration) if calibration.any() else np.arange(len(y)))
    return model


def calibrated(model: Model, texts: list[np.ndarray], y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each language the logit between the classes with fewest errors, drawn to the common one where texts are few."""
    bounds = np.cumsum([0, *(len(texts[i]) for i in rows)])
    hashes = np.concatenate([texts[i] for i in rows])
    z, lang, y = model.logits(hashes, bounds), languages(hashes, bounds), y[rows]

    def best(own: np.ndarray) -> float:
        cuts = np.linspace(-4, 4, 161)
        wrong = [max(1e-9, ((z[own] >= c) != (y[own] == 1)).sum()) for c in cuts]
        return float(np.mean(cuts[np.flatnonzero(np.array(wrong) == min(wrong))]))

    common = best(np.arange(len(z)))
    out = np.full(len(FUNCTION_WORDS) + 1, common)
    for k in range(len(FUNCTION_WORDS)):
        own = np.flatnonzero(lang == k)
        if (y[own] == 1).sum() >= 10 and (y[own] == 0).sum() >= 10:
            out[k] = (len(own) * best(own) + 50 * common) / (len(own) + 50)
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) of every row of docs."""
    model = fit(labelled_sample(docs, labels, "toxic", per_class))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_scores(docs, lambda raw, offsets: shared.value.score(raw, offsets), 0.5)


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs that aren't found toxic: no join, each row by its own text, null and repeated ids too."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, "toxic", per_class)))
    return kept_by_score(docs, lambda raw, offsets: shared.value.score(raw, offsets), lambda s: s < 0.5)
