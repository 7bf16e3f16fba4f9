"""Language identification as a mixture of languages.

Every text is a mixture of the learned languages over hashed byte trigrams. Expectation-maximisation
estimates the proportions; the set of languages is the one with the best likelihood less a penalty for
each further language, added in the order of their proportions while that pays.

Plan: two scans without a shuffle of texts. Learning sees at most ``train_docs`` labelled rows of each
language (chosen by a hash of the id, a documented bound for the classifier alone) and its counts, at
most 65,536 a language, meet in one small aggregation. Prediction is one Arrow pass with the model
broadcast, whose size depends on the number of languages alone; all proportions of a batch are
estimated together.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text when no
row has a label; equal texts get equal results; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, lean, utf8_values

BUCKETS = 1 << 16
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_GAPS = re.compile(rb" {3,}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all byte trigrams of the folded texts, and where each text's begin (one more for the end)."""
    folded = [_GAPS.sub(b"  ", b"  " + (t or b"").translate(_FOLD)) for t in texts]
    starts = np.cumsum([0, *map(len, folded)])
    raw = np.frombuffer(b"".join((*folded, b"  ")), np.uint8).astype(np.uint32)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    code *= np.uint32(2654435761)
    return (code >> np.uint32(16)).astype(np.int64), starts


class Mixture:
    """Languages with log probabilities of each bucket."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.1, penalty: float = 10.0, rounds: int = 15):
        self.languages, self.penalty, self.rounds = languages, penalty, rounds
        smooth = counts.astype(np.float64) + smoothing
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
        self.shares = np.ascontiguousarray(np.exp(self.logs).T)

    def _fit(self, chance, weight, starts, pick):
        """Proportions and log likelihood of each document within its picked languages."""
        sizes = np.diff(starts)
        totals = np.add.reduceat(weight, starts[:-1])
        part = pick / pick.sum(axis=1, keepdims=True)
        for _ in range(self.rounds):
            mixed = np.einsum("rl,rl->r", chance, np.repeat(part.astype(np.float32), sizes, axis=0))
            gain = np.add.reduceat(chance * (weight / mixed)[:, None], starts[:-1], axis=0)
            part = part * gain / totals[:, None]
            part /= part.sum(axis=1, keepdims=True)
        mixed = np.einsum("rl,rl->r", chance, np.repeat(part.astype(np.float32), sizes, axis=0))
        return part, np.add.reduceat(weight * np.log(mixed), starts[:-1])

    def predict(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the main language and its score, for texts with letters."""
        code, ends = trigrams(texts)
        n = len(texts)
        owner = np.repeat(np.arange(n), np.diff(ends))
        keys, counts = np.unique(owner * BUCKETS + code, return_counts=True)
        docs, bucket, weight = keys // BUCKETS, keys % BUCKETS, counts.astype(np.float32)
        starts = np.searchsorted(docs, np.arange(n + 1))
        alone = np.stack([np.add.reduceat(weight * self.logs[k][bucket], starts[:-1]) for k in range(len(self.languages))], axis=1).astype(np.float64)
        best = alone.argmax(axis=1)
        likely = np.exp(alone - alone.max(axis=1, keepdims=True))
        score = likely.max(axis=1) / likely.sum(axis=1)
        if len(self.languages) == 1:
            return best, score
        chance = self.shares[bucket]
        part, whole = self._fit(chance, weight, starts, np.ones((n, len(self.languages))))
        price = self.penalty * np.log(np.maximum(2, np.diff(ends)))
        # No set does better than all languages together: where that gain doesn't pay for one more language, none does.
        open_ = np.flatnonzero(whole - alone.max(axis=1) > price)
        kept, order = alone.max(axis=1), np.argsort(-part, axis=1)
        for size in range(2, len(self.languages) + 1):
            if not len(open_):
                break
            rows = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in open_])
            own = np.cumsum([0, *(starts[open_ + 1] - starts[open_])])
            pick = np.zeros((len(open_), len(self.languages)))
            np.put_along_axis(pick, order[open_, :size], 1.0, axis=1)
            shares, fit = self._fit(chance[rows], weight[rows], own, pick)
            pays = fit - kept[open_] > price[open_]
            won = open_[pays]
            kept[won], best[won], score[won] = fit[pays], shares[pays].argmax(axis=1), shares[pays].max(axis=1)
            # A first pair that doesn't pay may still be part of a larger set that does.
            open_ = won if size > 2 else open_
        return best, score


def learn(docs: DataFrame, train_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Mixture | None:
    """The model of the labelled rows, ``train_docs`` of each language at most in expectation; None without any."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not sizes:
        return None
    steps = 1 << 20
    limit = {lang: max(1, min(steps, int(steps * train_docs / n))) for lang, n in sizes.items()}
    bound = F.create_map(*[F.lit(x) for pair in limit.items() for x in pair])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(steps)) < bound[F.col("lang")])

    @lean
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                code, ends = trigrams(utf8_values(batch.column("text")))
                for i, lang in enumerate(batch.column("lang").to_pylist()):
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    np.add.at(sums[lang], code[ends[i] : ends[i + 1]], 1)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "bucket", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    languages = sorted(sizes)
    counts = np.zeros((len(languages), BUCKETS), np.int64)
    row = {lang: i for i, lang in enumerate(languages)}
    at = np.array([row[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[at, np.asarray(table.column("bucket"), dtype=np.int64)] = np.asarray(table.column("n"), dtype=np.int64)
    return Mixture(languages, counts, **options)


def identify(docs: DataFrame, model: Mixture | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs``, with ``pred_col`` and ``score_col`` in place of any of the same name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*({pred_col, score_col} - {text_col}))
    names = list(docs.columns)
    text_at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{pred_col}` string, `{score_col}` double"

    @lean
    def run(batches):
        mixture = shared.value
        for whole in batches:
            for batch in byte_slices(whole, text_col, 1 << 20):
                texts = batch.column(text_at)
                langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                if mixture is not None:
                    real = [i for i, t in enumerate(texts.to_pylist()) if has_letter(t)]
                    if real:
                        best, score = mixture.predict(utf8_values(texts.take(pa.array(real))))
                        scores[real] = np.clip(score, 0.0, 1.0)
                        for i, k in zip(real, best.tolist()):
                            langs[i] = mixture.languages[k]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], [*names, pred_col, score_col])

    return docs.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, folds: int = 5, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents whose crc32(doc_id) mod ``folds`` is not 0."""
    held = F.crc32(F.col("doc_id").cast("string")) % folds == 0
    model = learn(docs.where(~held), **options)
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).drop("text")


def keep_identified(docs: DataFrame, folds: int = 5, least_score: float = 0.5, **options) -> DataFrame:
    """The documents, all columns kept, with a language that makes up ``least_score`` of them at least; texts without a letter go."""
    held = F.crc32(F.col("doc_id").cast("string")) % folds == 0
    model = learn(docs.where(~held), **options)
    found = identify(docs, model, pred_col="__lang", score_col="__share")
    return found.where((F.col("__lang") != "und") & (F.col("__share") >= least_score)).select(*docs.columns)
