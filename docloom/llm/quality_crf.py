"""Text quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.language_id import held_out, training_texts
from docloom.llm.text_stats import CHAR, DIGIT, LETTER, STRONG, SYMBOL, UPPER, line_spans, repeated, sums
from docloom.llm.textblocks import rows_of, span_hashes, text_slices, window_hashes, word_spans

TRAIN_DOCS, TRAIN_BYTES = 750, 8 << 20
THRESHOLD = 0.3
ROUNDS = 200


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for each line, with its neighbours' features; line lengths; each text's first line."""
    a, b, line = line_spans(buf, offs)
    starts, ends, first = word_spans(buf, offs)
    chars = sums(CHAR[buf], starts, ends)
    at = np.searchsorted(starts, a), np.searchsorted(starts, b)
    words = at[1] - at[0]

    def within(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[at[1]] - total[at[0]]

    hashes = span_hashes(buf, starts, ends)
    rows = rows_of(first)
    inside = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
    _, twin = repeated(rows[inside], window_hashes(hashes, 3)[inside])
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[inside[twin] + j] = True
    echoed = np.zeros(len(hashes), bool)
    echoed[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    full = words > 0
    later, _ = repeated(rows_of(line)[full], span_hashes(buf, a[full], b[full]))
    dup = np.zeros(len(a))
    dup[np.flatnonzero(full)[later]] = 1
    each, letters = np.maximum(words, 1), sums(LETTER[buf], a, b)
    size = sums(CHAR[buf], a, b)
    own = np.stack(
        [
            sums(UPPER[buf], a, b) / np.maximum(letters, 1),
            np.minimum(sums(SYMBOL[buf], a, b) / each, 3),
            np.minimum(sums(STRONG[buf], a, b) / each, 3),
            within(sums(LETTER[buf], starts, ends) == 0) / each,
            within(chars <= 3) / each,
            dup,
            within(covered) / each,
            within(echoed) / each,
        ],
        1,
    )
    alone = np.stack(
        [
            np.log1p(words) / 5,
            np.minimum(within(chars) / each / 10, 3),
            letters / np.maximum(size, 1),
            sums(DIGIT[buf], a, b) / np.maximum(size, 1),
            words == 0,
        ],
        1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[line[:-1]] = 0
    after[line[1:] - 1] = 0
    return np.concatenate([np.ones((len(a), 1)), own, alone, before, after], 1), size, line


def marginals(emission: np.ndarray, jumps: np.ndarray, line: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over all texts at once: each line's probability of being good.

    ``emission`` is the score of good over bad by line, ``jumps`` the 2 x 2 scores of label changes. ``pairs``, if
    given, gets the sums of the probabilities of each label pair of neighbours.
    """
    count = np.diff(line)
    order = np.argsort(-count, kind="stable")
    head, long = line[:-1][order], count[order]
    steps = int(long[0]) if len(long) else 0
    live = np.searchsorted(-long, -np.arange(steps), side="left")
    node = np.stack([np.zeros(len(emission)), emission], 1)
    ahead, back = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    for t in range(steps):
        here = head[: live[t]] + t
        if t:
            reach = ahead[here - 1][:, :, None] + jumps[None]
            high = reach.max(1)
            ahead[here] = node[here] + high + np.log(np.exp(reach - high[:, None, :]).sum(1))
        else:
            ahead[here] = node[here]
    for t in range(steps - 2, -1, -1):
        here = head[: live[t + 1]] + t
        reach = jumps[None] + (node[here + 1] + back[here + 1])[:, None, :]
        high = reach.max(2)
        back[here] = high + np.log(np.exp(reach - high[:, :, None]).sum(2))
    both = ahead + back
    if pairs is not None:
        inner = np.ones(len(emission), bool)
        inner[line[1:] - 1] = False
        here = np.flatnonzero(inner)
        joint = ahead[here][:, :, None] + jumps[None] + (node[here + 1] + back[here + 1])[:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))


class LineModel:
    """Weights of the field, and the calibration of a text's mean line probability to the share of good labels."""

    def __init__(self, texts: list[str], labels: list[int], rounds: int = ROUNDS):
        raw = [t.encode() for t in texts]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        offs = np.cumsum([0, *[len(t) for t in raw]])
        x, size, line = line_features(buf, offs)
        self.weights, self.jumps = np.zeros(x.shape[1]), np.zeros((2, 2))
        self.slope, self.bias = 1.0, 0.0
        if not texts:
            return
        good = np.array(labels, float)
        truth = np.repeat(good, np.diff(line))
        seen = np.zeros((2, 2))
        moves = np.diff(line) - 1
        seen[1, 1], seen[0, 0] = moves[good == 1].sum(), moves[good == 0].sum()
        # Line weights count a text once, however many lines it has.
        share = 1 / np.repeat(np.diff(line), np.diff(line))
        momentum, square = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
        for k in range(1, rounds + 1):
            pairs = np.zeros((2, 2))
            p = marginals(x @ self.weights, self.jumps, line, pairs)
            slope = np.concatenate([x.T @ ((truth - p) * share) / len(texts) - 1e-4 * self.weights, ((seen - pairs) / max(1, moves.sum()) - 1e-2 * self.jumps).ravel()])
            momentum = 0.9 * momentum + 0.1 * slope
            square = 0.99 * square + 0.01 * slope**2
            step = 0.1 * (momentum / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
            self.weights += step[:-4]
            self.jumps += step[-4:].reshape(2, 2)
        z = self._logit(self.mean(x, size, line))
        for _ in range(50):
            p = 1 / (1 + np.exp(np.clip(-(self.slope * z + self.bias), -500, 500)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((good - p) * z).sum() - 0.1 * (self.slope - 1), (good - p).sum()])
            hess = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
            ds, db = np.clip(np.linalg.solve(hess, grad), -1, 1)
            self.slope, self.bias = max(0.05, self.slope + ds), self.bias + db

    @staticmethod
    def _logit(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def mean(self, x: np.ndarray, size: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Length-weighted mean of each text's line probabilities."""
        p = marginals(x @ self.weights, self.jumps, line)
        weight = size + 1.0
        return row_float(p * weight, line) / row_float(weight, line)

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self._logit(self.mean(*line_features(buf, offs))) + self.bias)))


def row_float(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.zeros(0)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in text_slices(batch.column("text"), 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(model.value.score(buf, offs))], names=["id", "score"])


def train_line_model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, docs_each: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> LineModel:
    """The field from a bounded sample of whole training texts: about ``docs_each`` of each label, and ``train_bytes`` in all."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").where(~held_out("id"))
    rows = sorted((r["text"], r["label"]) for r in training_texts(texts, "label", docs_each, train_bytes, known).collect())
    return LineModel([t for t, _ in rows], [y for _, y in rows])


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD,
    docs_each: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES,
) -> DataFrame:
    """Returns (id, held_out, score, predicted) for every row; the score estimates the probability of label 1.

    Every line of a training text takes the text's label; the field learns from each line's features and its
    neighbours'. A text's score is the length-weighted mean of its lines' forward-backward marginals, calibrated on the
    training texts. Only rows outside the held-out fold teach: about ``docs_each`` whole texts of each label, together
    about ``train_bytes``; labels, language, source and id are no inputs.

    Defined cases: null and empty texts are one empty line and get that line's score; rows of ``labels`` without a
    text, null labels and repeated labels (the least counts) do no harm; without labels every score is 0.5; a text of
    any length and number of lines is scored whole, in memory proportional to it; a score at the threshold is predicted
    1; repeated rows and null ids each give a row (repeated rows teach once); an empty table gives an empty result;
    further columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_line_model(docs, labels, id_col, text_col, label_col, docs_each, train_bytes))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    out = given.mapInArrow(lambda it: _score(it, model), f"id {kind}, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
