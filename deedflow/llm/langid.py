"""Language ID as inference of a mixture: each text's language proportions by expectation-maximisation.

A model holds the likelihood of hashed letter trigrams in each language.  For a text, EM estimates the proportions of all
languages; then sets of its likeliest languages, one to all, are compared by likelihood less a penalty for each language,
and the best set's proportions are the result.

The model is fitted on a sample of labelled documents of at most about ``PER_LANGUAGE`` a language, chosen by a hash of
doc_id (the bound is a parameter; counts of labels cover all data); prediction covers every text whole.

Defined cases: null text or text without letters is ``und`` with score 0, as is all text if nothing can be learned; rows with
a null doc_id are predicted, but neither learned from nor held out.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, small_batches, worker_cache

GRAM = 3
CELLS = 1 << 16
PER_LANGUAGE = 2000
SMOOTHING = 0.5
ROUNDS = 25
#: Each further language costs this times half the logarithm of the number of independent grams.
PENALTY = 4.0
FOLDS = 5
#: A document of the pipeline holds wanted languages to this share, with trigrams at most so much less likely (in nats) than usual.
LEAST_SHARE, LEAST_FIT = 0.5, 3.0
#: Short texts may fall short of that by so much more over the root of their number of trigrams.
SHORT_SLACK = 8.0
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, mixture string"


def letter_table() -> np.ndarray:
    kept = worker_cache()
    if "letters" not in kept:
        kept["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return kept["letters"]


def gram_cells(text: str | None) -> np.ndarray:
    """Cells of all trigrams of lower-cased letters, where each run of other characters is one space."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le"), np.uint32)
    letter = letter_table()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes = np.where(letter, codes, 32)[keep].astype(U64)
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    packed = codes[:n]
    for i in range(1, GRAM):
        packed = (packed << U64(21)) | codes[i : i + n]
    return (mix(packed) >> U64(48)).astype(np.int64)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.likelihood = (smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float64).copy()
        #: Mean log-likelihood of a trigram of the language that fits its own text least.
        own = (counts * np.log(smooth / smooth.sum(axis=1, keepdims=True))).sum(axis=1) / np.maximum(1, counts.sum(axis=1))
        self.usual = float(own.min()) if len(own) else 0.0

    @staticmethod
    def em(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions, and the log-likelihood."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        total = n.sum()
        for _ in range(ROUNDS if p.shape[1] > 1 else 0):
            new = share * ((n / (p @ share)) @ p) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> list[tuple[str, float]]:
        """The selected languages with their proportions, the largest first; empty if there is nothing to tell from."""
        return self.infer_with_fit(text)[0]

    def infer_with_fit(self, text: str | None) -> tuple[list[tuple[str, float]], float, int]:
        """infer, the mean log-likelihood of the text's trigrams in the mixture, and their number."""
        cells = gram_cells(text)
        if not len(cells) or not self.langs:
            return [], 0.0, 0
        n = np.bincount(cells, minlength=CELLS)
        seen = np.flatnonzero(n)
        n, p = n[seen].astype(np.float64), self.likelihood[seen]
        share, _ = self.em(p, n)
        order = np.argsort(-share, kind="stable")
        cost = PENALTY / 2 * np.log(max(2.0, len(cells) / GRAM))
        best, best_value, fit_of = None, -np.inf, 0.0
        for k in range(1, len(order) + 1):
            chosen = order[:k]
            own, value = self.em(p[:, chosen], n)
            total, value = value, value - cost * k
            if value <= best_value:
                break
            fit_of = total / len(cells)
            best, best_value = [(self.langs[c], float(s)) for c, s in zip(chosen, own, strict=True)], value
        return sorted(best, key=lambda x: (-x[1], x[0])), fit_of, len(cells)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the labelled documents that aren't held out."""
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n_of = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not n_of:
        return Model([], np.zeros((0, CELLS)))
    langs = sorted(n_of)
    steps = 1_000_000
    limits = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(steps, -(-steps * per_language // n_of[lang]))))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = counts.setdefault(lang, np.zeros(CELLS, np.int64))
                    own += np.bincount(gram_cells(text), minlength=CELLS)
        for lang, own in counts.items():
            cells = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells), pa.array(own[cells])], ["lang", "cell", "n"])

    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < limits[F.col("lang")]).select("lang", "text")
    found = sample.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), CELLS))
    at = {lang: i for i, lang in enumerate(langs)}
    rows = np.array([at[x] for x in found.column("lang").to_pylist()], np.int64)
    np.add.at(counts, (rows, found.column("cell").to_numpy().astype(np.int64)), found.column("n").to_numpy())
    learned = counts.sum(axis=1) > 0
    return Model([lang for lang, x in zip(langs, learned, strict=True) if x], counts[learned])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: predicted language, its proportion, and all proportions of the chosen set."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.likelihood))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.langs, own.likelihood = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [own.infer(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([f[0][0] if f else UNKNOWN for f in found], pa.string()),
                        pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                        pa.array([",".join(f"{lang}:{share:.4f}" for lang, share in f) for f in found], pa.string()),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "mixture"],
                )

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_languages(docs: DataFrame, model: Model, wanted: Collection[str] | None = None, least_share: float = LEAST_SHARE, least_fit: float = LEAST_FIT) -> DataFrame:
    """The documents in wanted languages (None: all learned ones), with all their columns.

    A document stays if the wanted languages' proportions add up to least_share, and if its trigrams are likely in its
    mixture: the mean log-likelihood may be at most least_fit (and SHORT_SLACK) below the least that the model saw in its own
    languages, so text in a language never learned goes.  Texts without letters go; if nothing was learned, all with letters
    stay.  Rows that repeat, and null ids, are judged like others."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.likelihood, model.usual))
    chosen = None if wanted is None else frozenset(wanted)

    def stays(own: Model, text: str | None) -> bool:
        if not own.langs:
            return len(gram_cells(text)) > 0
        found, fit_of, n = own.infer_with_fit(text)
        share = sum(s for lang, s in found if chosen is None or lang in chosen)
        return bool(found) and share >= least_share and fit_of >= own.usual - least_fit - SHORT_SLACK / max(1, n) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.langs, own.likelihood, own.usual = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array([stays(own, t) for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_unknown(docs: DataFrame, model: Model) -> DataFrame:
    """The documents in any learned language."""
    return keep_languages(docs, model)
