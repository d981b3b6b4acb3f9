"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, then a linear classifier.

Voters. Lexicon voters are words and word beginnings (4 to 6 bytes) that labelled training documents mark as toxic far
more often than others; each votes "toxic" where it occurs and is silent elsewhere. Pattern voters look at the form of a
text (shouting, signs, repeats, length, whether any lexicon voter speaks) and vote for the side their pattern leans to.

Label model. A latent class model (y, then votes) is fitted by EM: every voter gets its rates of voting under either
class. Correlations of votes given the class are estimated from the posteriors; a voter's evidence is divided by the
summed squared correlations with all others, so that ten voters saying one thing count once.

Classifier. A logistic regression over token and form features learns the posteriors; it scores every text whole.

Fitting takes token sets of at most ``FIT_ROWS`` labelled documents of the training folds to the driver.

Cases: null, empty and wordless texts get a score; repeated rows are scored each; with no labelled rows every score is
0.5; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.labelled import held_out, sample
from quarry.llm.store import small_batches

#: Labelled documents that voters and models are fitted on at most.
FIT_ROWS = 5000
#: Lexicon voters and token features at most.
VOTERS = 400
FEATURES = 2048
PREFIXES = (4, 5, 6)
#: Training documents that a voter or feature occurs in at least.
LEAST_DOCS = 4
#: How much likelier a lexicon voter is in toxic documents, as natural log of the odds ratio.
LEAST_ODDS = 1.5
REJECT = 0.5
FORMS = 6
_TAG = tuple(np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(len(PREFIXES)))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token hash) of all words and word beginnings, and the form of each text."""
    words = W.split(data, at, W.ALNUM, lower=True)
    owner = words.text_of()
    owners, hashes = [owner], [words.hashes()]
    length = words.ends - words.starts
    for k, tag in zip(PREFIXES, _TAG, strict=True):
        long = length > k
        begin = W.Words(words.data, words.starts[long], words.starts[long] + k, words.first)
        owners.append(owner[long])
        hashes.append(W.mix(begin.hashes() ^ tag))
    n = len(at) - 1
    size = np.maximum(1, np.diff(at)).astype(float)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at]) / size
    count = np.maximum(1, words.counts).astype(float)
    own = hashes[0]
    again = np.zeros(len(own), dtype=bool)
    again[1:] = (own[1:] == own[:-1]) & (owner[1:] == owner[:-1])
    forms = np.stack(
        [
            share((data >= 0x41) & (data <= 0x5A)),
            share(data == 0x21),
            share((data >= 0x23) & (data <= 0x2A)),
            share((data >= 0x30) & (data <= 0x39)),
            np.bincount(owner, weights=again, minlength=n) / count,
            np.log1p(words.counts) / 10,
        ],
        axis=1,
    )
    return np.concatenate(owners), np.concatenate(hashes), forms


@dataclass
class Linear:
    """Logistic regression on token presence and form; ``tokens`` is sorted."""

    tokens: np.ndarray
    weights: np.ndarray
    forms: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        owner, hashes, forms = tokens(data, at)
        ok = known[(hashes & np.uint64(len(known) - 1)).astype(np.int64)]
        owner, hashes = owner[ok], hashes[ok]
        total = forms @ self.forms + self.bias
        if len(self.tokens) and len(hashes):
            spot = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
            hit = self.tokens[spot] == hashes
            pair = np.unique(owner[hit] * len(self.tokens) + spot[hit])
            np.add.at(total, pair // len(self.tokens), self.weights[pair % len(self.tokens)])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    def filter(self) -> np.ndarray:
        """Which low bits of a hash some token has."""
        known = np.zeros(1 << 20, dtype=bool)
        known[(self.tokens & np.uint64(len(known) - 1)).astype(np.int64)] = True
        return known


@dataclass
class LabelModel:
    """Rates of voting "toxic" under (clean, toxic), the weights that correlation leaves, and the prior."""

    rates: np.ndarray
    weights: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1] / self.rates[0])
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        evidence = votes @ (self.weights * on) + (1 - votes) @ (self.weights * off)
        return 1 / (1 + np.exp(-np.clip(evidence + np.log(self.prior / (1 - self.prior)), -40, 40)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> LabelModel:
    """EM from ``start`` (first guesses of the posteriors); correlations are re-estimated in each round."""
    q = start
    model = None
    for _ in range(rounds):
        both = np.stack([1 - q, q])
        rates = (both @ votes + 0.5 * np.array([[0.02], [0.2]])) / (both.sum(axis=1, keepdims=True) + 0.5)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        gap = votes - (both.T @ rates)
        scale = np.sqrt((gap * gap).mean(axis=0)) + 1e-9
        correlation = (gap / scale).T @ (gap / scale) / len(votes)
        weights = 1 / np.maximum(1, (correlation**2).sum(axis=0))
        model = LabelModel(rates, weights, float(np.clip(q.mean(), 0.005, 0.5)))
        new = model.posterior(votes)
        if np.abs(new - q).max() < 1e-4:
            break
        q = new
    return model


def fit_tokens(sets: list[np.ndarray], forms: np.ndarray, y: np.ndarray) -> Linear:
    """Voters from labels, the label model over their votes, and the classifier on its posteriors."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    names, index = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    seen = np.bincount(index, minlength=len(names))
    toxic = np.bincount(index, weights=y[doc], minlength=len(names))
    yes, no = y.sum(), n - y.sum()
    odds = np.log((toxic + 0.3) / (yes + 1)) - np.log((seen - toxic + 0.3) / (no + 1))
    often = seen >= LEAST_DOCS
    lexicon = np.flatnonzero(often & (odds >= LEAST_ODDS) & (toxic >= LEAST_DOCS))
    lexicon = lexicon[np.lexsort((names[lexicon], -odds[lexicon] * np.sqrt(toxic[lexicon])))][:VOTERS]
    place = np.full(len(names), -1)
    place[lexicon] = np.arange(len(lexicon))
    votes = np.zeros((n, len(lexicon)))
    mine = place[index] >= 0
    votes[doc[mine], place[index[mine]]] = 1
    # pattern voters: high form values and "a lexicon voter speaks"; they lean where their rates lead them
    patterns = [votes.any(axis=1)] + [forms[:, k] > np.quantile(forms[:, k], 0.9) for k in range(FORMS)]
    votes = np.concatenate([votes, np.stack(patterns, axis=1).astype(float)], axis=1)
    start = np.clip(0.05 + 0.6 * y + 0.3 * patterns[0], 0.02, 0.98)
    label_model = fit_label_model(votes, start)
    posterior = label_model.posterior(votes)
    # features: tokens that lean most to either side of the posterior
    weight = np.bincount(index, weights=posterior[doc], minlength=len(names))
    lean = np.abs(np.log((weight + 0.5) / (posterior.sum() + 1)) - np.log((seen - weight + 0.5) / (n - posterior.sum() + 1))) * np.sqrt(seen)
    chosen = np.flatnonzero(often)
    chosen = chosen[np.lexsort((names[chosen], -lean[chosen]))][:FEATURES]
    chosen.sort()
    place[:] = -1
    place[chosen] = np.arange(len(chosen))
    mine = place[index] >= 0
    x = np.zeros((n, len(chosen) + FORMS + 1), dtype=np.float32)
    x[doc[mine], place[index[mine]]] = 1
    x[:, len(chosen) : -1] = forms
    x[:, -1] = 1
    w = fit_logistic(x, posterior)
    return Linear(names[chosen], w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def fit_logistic(x: np.ndarray, target: np.ndarray, rounds: int = 1200) -> np.ndarray:
    """Full-batch Adam on the log-loss against soft targets, with a little weight decay."""
    w, target = np.zeros(x.shape[1], dtype=np.float32), target.astype(np.float32)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = (p - target) @ x / len(x) + 2e-5 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w = w - np.float32(0.05) * (m1 / (1 - 0.9**k)).astype(np.float32) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-9).astype(np.float32)
    return w


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, y) to (y, token set, form)."""
    for batch in batches:
        sets, all_forms = [], []
        for row, end, data, at in W.steps(batch.column(1)):
            owner, hashes, forms = tokens(data, at)
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(end - row + 1))
            sets += [np.unique(hashes[order[a:b]]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            all_forms += [f.tobytes() for f in forms]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(sets, pa.binary()), pa.array(all_forms, pa.binary())], ["y", "tokens", "forms"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Linear | None:
    """Fit on a bounded sample of labelled training rows; None without any."""
    small_batches(docs.sparkSession)
    found = sample(docs, labels, "toxic", rows, id_col, text_col).mapInArrow(_sets, "y int, tokens binary, forms binary").toPandas()
    if not len(found):
        return None
    sets = [np.frombuffer(b, dtype=np.uint64) for b in found["tokens"]]
    forms = np.stack([np.frombuffer(b, dtype=np.float64) for b in found["forms"]])
    return fit_tokens(sets, forms, found["y"].to_numpy().astype(float))


def _scorer(model: Linear | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if model is None else model.filter()
        for batch in batches:
            parts = [np.zeros(0)]
            for row, end, data, at in W.steps(batch.column(1)):
                parts.append(np.full(end - row, 0.5) if model is None else model.scores(data, at, known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.concatenate(parts), 6))], ["id", "score"])

    return score


def score(docs: DataFrame, model: Linear | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["id"]
    return texts.mapInArrow(_scorer(model), f"id {kind}, score double").withColumnRenamed("id", "doc_id")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    scored = score(docs, fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))
