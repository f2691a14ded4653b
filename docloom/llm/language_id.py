"""Language identification by prediction by partial matching (PPM) with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.text_stats import LETTER
from docloom.llm.textblocks import text_slices

TRAIN_DOCS, TRAIN_BYTES, LANGUAGES = 256, 16 << 20, 4096
#: Entries of the table of code lengths that is made before the first text; rarer grams are looked up as they come.
_TABLE = 1 << 25
ORDER = 3
_START = 10
_SLICE = 2 << 20


def held_out(id_col: str, folds: int = 5):
    """Whether a row is kept from training: CRC-32 of its id as text, modulo the number of folds, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == 0, F.lit(False))


def training_texts(texts: DataFrame, by: str, docs_each: int, train_bytes: int, labels: DataFrame | None = None) -> DataFrame:
    """A bounded sample of whole texts: distinct (by, text) of about ``docs_each`` rows a class, about ``train_bytes`` in all.

    ``texts`` has id and text, and the class unless ``labels`` has it by id. Rows are drawn by a hash of id and text, at
    a rate that a class's numbers of rows and bytes give; of the drawn rows a class takes those of the smallest draws, until
    it has its share of the bytes. The row of a class's smallest draw always teaches, so every class is learned, however few or
    long its texts are. Repeated rows count once. Only drawn texts meet the labels.
    """
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(1 << 30)).alias("draw")
    given = texts.select(*texts.columns, draw, F.octet_length("text").alias("bytes"))
    known = (lambda rows: rows.join(labels, "id")) if labels is not None else (lambda rows: rows)
    sizes = known(given.drop("text")).groupBy(by).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("draw").alias("least")).collect()
    if not sizes:
        return known(given).select(by, "text").limit(0)
    share = train_bytes / len(sizes)
    rates = {r[by]: max(r["least"] + 1, int(min(1.0, docs_each / r["n"], share / max(1, r["bytes"])) * (1 << 30))) for r in sizes}
    rate = F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair])[F.col(by)]
    drawn = known(given.where(F.col("draw") < max(rates.values()))).where(F.col("draw") < rate).select(by, "text", "draw", "bytes").distinct()
    earlier = F.sum("bytes").over(Window.partitionBy(by).orderBy("draw", "text").rowsBetween(Window.unboundedPreceding, -1))
    return drawn.withColumn("earlier", F.coalesce(earlier, F.lit(0))).where(F.col("earlier") < share).select(by, "text").distinct()


def _grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one number; before a text's start stand line breaks."""
    out = data.astype(np.uint32)
    for back in (1, 2, 3):
        shifted = np.full(len(data), _START, np.uint32)
        shifted[back:] = data[:-back]
        for k in range(back):
            at = starts + k
            shifted[at[at < len(data)]] = _START
        out |= shifted << np.uint32(8 * back)
    return out


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in an ascending table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


class ContextTrees:
    """Per-language byte context trees of order 0 to 3: what each context that a language's texts hold was followed by.

    The PPM code length of a byte, in bits, is that of its share where the context has seen it, else the context's
    escape and the code length in the next shorter context; below order 0 every byte takes 8 bits. A context that a
    language has not seen adds nothing. An escape's share is the number of different bytes that followed. All contexts
    of the texts are kept, in tables as large as the sample.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.trees = [self._tree(samples[lang]) for lang in self.langs]
        # Code lengths by language of the contexts and bytes that some language has seen, as many as the table holds.
        known = np.unique(np.concatenate([np.zeros(0, np.uint32), *[t[ORDER][0] for t in self.trees]]))
        self.known = known[: _TABLE // max(1, len(self.langs))]
        self.cost = [self._lengths(lang, self.known) for lang in range(len(self.langs))]

    @staticmethod
    def _tree(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By order: contexts with a byte, their code lengths, contexts, the code lengths of their escapes."""
        raw = [t.encode() for t in texts if t]
        data = np.frombuffer(b"".join(raw), np.uint8)
        grams = _grams(data, np.cumsum([0, *[len(t) for t in raw[:-1]]]).astype(np.int64))
        out = []
        for order in range(ORDER + 1):
            keys, counts = np.unique(grams & np.uint32((1 << 8 * (order + 1)) - 1), return_counts=True)
            contexts, first = np.unique(keys >> np.uint32(8), return_index=True)
            kinds = np.diff(np.append(first, len(keys)))
            whole = (np.add.reduceat(counts, first) if len(keys) else kinds) + kinds
            out.append((keys, -np.log2(counts / np.repeat(whole, kinds)), contexts, -np.log2(kinds / whole)))
        return out

    def _lengths(self, lang: int, grams: np.ndarray) -> np.ndarray:
        """Code lengths in one language of the last byte of each gram after the three before it."""
        bits = np.full(len(grams), 8.0)
        for order, (keys, lengths, contexts, escapes) in enumerate(self.trees[lang]):
            gram = grams & np.uint32((1 << 8 * (order + 1)) - 1)
            at, seen = _found(contexts, gram >> np.uint32(8))
            bits[seen] += escapes[at[seen]]
            at, seen = _found(keys, gram)
            bits[seen] = lengths[at[seen]]
        return bits

    def code_lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each row in each language."""
        grams, place = np.unique(_grams(buf, offs[:-1][np.diff(offs) > 0]), return_inverse=True)
        at, seen = _found(self.known, grams)
        bits = np.empty(len(grams))
        out = np.empty((len(offs) - 1, len(self.langs)))
        for lang in range(len(self.langs)):
            bits[seen] = self.cost[lang][at[seen]]
            bits[~seen] = self._lengths(lang, grams[~seen])
            total = np.concatenate([[0.0], np.cumsum(bits[place])])
            out[:, lang] = total[offs[1:]] - total[offs[:-1]]
        return out


def _has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(LETTER[buf] & (buf < 128), dtype=np.int64)])
    plain = total[offs[1:]] > total[offs[:-1]]
    for r in np.flatnonzero(~plain):
        piece = buf[offs[r] : offs[r + 1]]
        plain[r] = bool((piece >= 128).any()) and any(c.isalpha() for c in piece.tobytes().decode())
    return plain


def _identify(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    trees: ContextTrees = model.value
    names = np.array([*trees.langs, "und"], dtype=object)
    for batch in batches:
        for lo, hi, buf, offs in text_slices(batch.column("text"), _SLICE):
            told = _has_letter(buf, offs)
            best, score = np.full(hi - lo, len(trees.langs)), np.zeros(hi - lo)
            if trees.langs:
                bits = trees.code_lengths(buf, offs)
                lead = bits.argmin(1)
                odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                best, score = np.where(told, lead, best), np.where(told, 1 / odds, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])


def train_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_each: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, languages: int = LANGUAGES) -> ContextTrees:
    """Context trees of every language that has a training text, from a bounded sample of whole texts.

    More than ``languages`` values of the language column are refused with an error.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("out"))
    given = given.where("NOT out AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''").drop("out")
    if (found := given.select("lang").distinct().limit(languages + 1).count()) > languages:
        raise ValueError(f"{lang_col} has at least {found} values with training texts; raise languages above {languages} if they are languages")
    samples: dict[str, list[str]] = {}
    for r in training_texts(given, "lang", docs_each, train_bytes).collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return ContextTrees({k: sorted(v) for k, v in samples.items()})


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, languages: int = LANGUAGES
) -> DataFrame:
    """Returns (id, held_out, lang_pred, score) for every row; the score is the posterior of the predicted language.

    Trained on whole texts and languages of rows outside the held-out fold: about ``docs_each`` texts of each value of the
    language column and at least one, together about ``train_bytes`` and at least those; more than ``languages`` values are
    refused with an error. Language, source and id are
    no inputs of a prediction. Whole texts are coded, byte by byte, under each language's frozen statistics; the least
    total wins.

    Defined cases: a null text or one without a letter is ``und`` with score 0, as is all if no language was learned;
    ties go to the first language; a text of any length is coded whole, in memory proportional to it; repeated rows and
    null ids each give a row and teach once (a null id is not held out); an empty table gives an empty result; further
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_languages(docs, id_col, text_col, lang_col, docs_each, train_bytes, languages))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    out = given.mapInArrow(lambda it: _identify(it, model), f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col).withColumn("held_out", held_out(id_col)).select(id_col, "held_out", "lang_pred", "score")
