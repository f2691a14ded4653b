"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.text_stats import text_stats
from docloom.llm.textblocks import text_slices
from docloom.llm.workspace import Workspace

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_strong", "n_bare", "n_short")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in text_slices(batch.column("text")):
            found = text_stats(buf, offs)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *[pa.array(found[c], pa.int64()) for c in STATS]], names=["id", *STATS])


def rule_votes() -> dict[str, Column]:
    """Each rule's vote over the counts: 1 good, -1 bad, 0 abstains. Every rule has one verdict or abstains."""
    words, letters, lines = F.col("n_words"), F.col("n_letters"), F.col("n_lines")
    bad = {
        "symbols": F.col("n_symbols") * 4 > words,
        "word_length": (words >= 1) & ((F.col("word_chars") < words * 2) | (F.col("word_chars") > words * 14)),
        "capitals": (letters >= 40) & (F.col("n_upper") * 5 > letters * 2),
        "exclaiming": F.col("n_strong") * 4 > words,
        "bare_words": F.col("n_bare") * 5 > words,
        "repeats": F.col("n_repeat_words") * 5 > words * 2,
        "lines": (lines >= 4) & (F.col("n_dup_lines") * 5 > lines * 2),
    }
    good = {
        "prose": (words >= 20) & (F.col("n_short") * 5 >= words) & (F.col("n_bare") * 20 <= words),
        "plain": (words >= 20) & (F.col("n_symbols") * 20 <= words) & (F.col("n_upper") * 10 <= letters),
    }
    return {k: F.when(v, -1).otherwise(0) for k, v in bad.items()} | {k: F.when(v, 1).otherwise(0) for k, v in good.items()}


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of good texts and, by rule, class (good, bad) and vote (-1, 0, 1), the vote's probability.
    Weak supervision needs rules that are better than chance: a rule may vote bad on at most one good text in a
    hundred and vote good on at most half of the bad ones. Counts are smoothed by one.
    """
    prior = 0.9
    table = np.empty((rules, 2, 3))
    table[:, 0], table[:, 1] = (0.002, 0.2, 0.798), (0.25, 0.5, 0.25)
    if not patterns:
        return prior, table
    votes = np.array([p for p, _ in patterns], int) + 1
    count = np.array([c for _, c in patterns], float)
    at = np.arange(rules)
    used = np.array([[bool(((votes[:, k] == v) * count).sum()) or v == 1 for v in range(3)] for k in range(rules)])
    table *= used[:, None, :]
    table[:, :, 1] += 1 - table.sum(2)
    for _ in range(rounds):
        logs = np.log(np.maximum(table, 1e-300))
        good = np.log(prior) + logs[at, 0, votes].sum(1)
        bad = np.log1p(-prior) + logs[at, 1, votes].sum(1)
        p = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        was, prior = prior, float(np.clip(((p * count).sum() + 9) / (count.sum() + 10), 0.01, 0.99))
        for c, share in ((0, p), (1, 1 - p)):
            seen = np.stack([((votes == v) * (share * count)[:, None]).sum(0) for v in range(3)], 1) + used
            table[:, c] = seen / seen.sum(1, keepdims=True)
        table[:, 0, 0] = np.minimum(table[:, 0, 0], 0.01)
        table[:, 1, 2] = np.minimum(table[:, 1, 2], 0.5)
        table[:, :, 1] += 1 - table.sum(2)
        if abs(prior - was) < 1e-12:
            break
    return prior, np.maximum(table, 1e-12)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Returns (id, counts of the text, quality_probability, base_failed, kept) for every row.

    Counts are taken over whole texts. Nine rules vote or abstain; the numbers of rows by vote pattern (at most
    2**9, whatever the input) are all that reaches the driver, where expectation-maximisation estimates each
    rule's reliability. A row's verdict is its posterior probability of being good; the two base conditions (under 50
    words, or over half of the words in repeated 3-word windows) reject on their own.

    Defined cases: a null or blank text has zero counts, every rule abstains and the base rejects it; repeated rows
    and null ids each give a row; an empty table gives an empty result; further columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    measured = given.mapInArrow(_measure, f"id {kind}, " + ", ".join(f"{c} long" for c in STATS))
    votes = rule_votes()
    table = Workspace(docs.sparkSession, "rules").table("votes", measured.withColumns({f"v_{k}": v for k, v in votes.items()}))
    names = [f"v_{k}" for k in votes]
    patterns = [(tuple(r[:-1]), r[-1]) for r in table.groupBy(*names).count().collect()]
    prior, fitted = fit_votes(sorted(patterns), len(names))
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for k, name in enumerate(names):
        weight = np.log(fitted[k, 0] / fitted[k, 1])
        odds = odds + F.when(F.col(name) < 0, float(weight[0])).when(F.col(name) > 0, float(weight[2])).otherwise(float(weight[1]))
    out = table.withColumn("quality_probability", 1 / (1 + F.exp(-odds)))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))
    return out.select(F.col("id").alias(id_col), *STATS[:5], "quality_probability", "base_failed", "kept")
