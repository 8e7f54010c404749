"""Language identification in two steps: the language family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import blocks, with_fields

#: ISO 639-1 codes by family. Languages not named here are each a family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be bs",
    "indo-aryan": "hi ur bn pa mr gu ne si",
    "turkic": "tr az kk uz ky tk tt",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "baltic": "lt lv",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Hashed n-gram features.
FEATURES = 4096
#: Labelled documents that the models are fitted on, about: the documented bound of the training sample.
SAMPLE = 2400

_TEXT = np.full(256, 32, np.uint8)
_TEXT[97:123] = np.arange(97, 123)
_TEXT[65:91] = np.arange(97, 123)
_TEXT[128:] = np.arange(128, 256)


def _ngram_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature of the 2- and the 3-byte gram that begins at each byte; what isn't a letter counts as a space."""
    t = np.concatenate((_TEXT[data], np.full(2, 32, np.uint8))).astype(np.uint32)
    two = t[:-2] + (t[1:-1] << np.uint32(8))
    three = two + (t[2:] << np.uint32(16))
    return tuple(((x * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64) for x in (two + np.uint32(1 << 24), three))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between the offsets, empty ones 0."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and (t.isalpha() or any(map(str.isalpha, t))) for t in texts], bool)


def features(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with the non-zero features' numbers (16 bits each) and shares (32-bit floats); texts without letters are left out."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(kept))
            for lo, hi, data, offsets in blocks(text):
                good = _has_letter(text[lo:hi].to_pylist())
                two, three = _ngram_features(data)
                at, share = [], []
                for i in np.flatnonzero(good):
                    x = np.concatenate((two[offsets[i] : offsets[i + 1]], three[offsets[i] : offsets[i + 1]]))
                    n = np.bincount(x, minlength=FEATURES)
                    some = np.flatnonzero(n)
                    at.append(some.astype("<u2").tobytes())
                    share.append((n[some] / len(x)).astype("<f4").tobytes())
                pick = pa.array(np.flatnonzero(good))
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[lo:hi].take(pick) for k in range(len(kept))), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=[*kept, "at", "share"])

    return docs.select(*kept, "text").mapInArrow(run, with_fields(docs.select(*kept), "at binary, share binary"))


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 100) -> np.ndarray:
    """Weights, the last of them the bias, of a linear SVM with squared hinge loss; y is +1 or -1.

    Accelerated gradient steps from zero, each class weighted alike: the same rows give the same weights.
    """
    n = len(y)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) / n * c

    def ahead(v: np.ndarray) -> np.ndarray:
        return x @ v[:-1] + v[-1]

    def back(g: np.ndarray) -> np.ndarray:
        return np.append(x.T @ g, g.sum())

    u = np.ones(x.shape[1] + 1, x.dtype)
    for _ in range(30):  # the largest curvature, by power iteration
        u = back(weight.astype(x.dtype) * ahead(u))
        top = float(np.linalg.norm(u))
        u /= max(top, 1e-30)
    step = 1 / (1 + 2.2 * top)
    w = v = np.zeros(x.shape[1] + 1, x.dtype)
    t = 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * ahead(v))
        grad = v - 2 * back((weight * y * gap).astype(x.dtype))
        new = v - step * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


class Model:
    """families: names; languages: the languages of each family; pairs: the (family, i, j) of each SVM; weights: a column for each SVM."""

    def __init__(self, langs: list[str], at: list, share: list):
        self.languages: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.languages.setdefault(_FAMILY_OF.get(lang, lang), []).append(lang)
        self.families = sorted(self.languages)
        x = np.zeros((len(langs), FEATURES), np.float32)
        for i, (a, s) in enumerate(zip(at, share, strict=True)):
            x[i, a] = s
        self.scale = np.float32(1 / max(1e-9, np.sqrt(np.einsum("ij,ij->i", x, x)).mean())) if len(langs) else np.float32(1)
        x *= self.scale
        lang = np.array(langs)
        family = np.array([_FAMILY_OF.get(v, v) for v in langs])
        self.pairs: list[tuple[str | None, str, str]] = []
        columns = []
        for of, names, labels in [(None, self.families, family), *((f, self.languages[f], lang) for f in self.families)]:
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    rows = (labels == a) | (labels == b)
                    self.pairs.append((of, a, b))
                    columns.append(linear_svm(x if rows.all() else x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
        self.weights = np.stack(columns, axis=1) if columns else np.zeros((FEATURES + 1, 0))

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The margin of each text for each SVM, summed over its n-grams without ever making a feature vector."""
        two, three = _ngram_features(data)
        w = (self.weights[:-1] * self.scale).astype(np.float32)
        n = np.maximum(1, 2 * np.diff(offsets))[:, None]
        return _sums(w[two] + w[three], offsets) / n + self.weights[-1]

    def _vote(self, of: str | None, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the name with the most pairwise wins (ties by the sum of margins, then by name) and its confidence."""
        wins, total = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        sure = np.full((len(margins), len(names), len(names)), np.inf)
        for k, (f, a, b) in enumerate(self.pairs):
            if f == of and a in names and b in names:
                i, j, m = names.index(a), names.index(b), margins[:, k]
                wins[:, i] += m >= 0
                wins[:, j] += m < 0
                total[:, i] += m
                total[:, j] -= m
                sure[:, i, j], sure[:, j, i] = m, -m
        best = np.argmax(wins + 1e-6 * np.tanh(total), axis=1)
        least = sure[np.arange(len(best)), best].min(axis=1)
        return best, 1 / (1 + np.exp(-np.clip(3 * least, -30, 30)))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margins = self.margins(data, offsets)
        family, score = self._vote(None, self.families, margins)
        lang = np.empty(len(margins), object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, sure = self._vote(f, self.languages[f], margins[rows])
                lang[rows] = np.array(self.languages[f], object)[best]
                score[rows] *= sure
        return lang, score


def _id_check(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled documents, spread evenly over the languages and chosen by a hash of doc_id.

    Only text and non-null lang are learnt from, of documents whose crc32(doc_id as text) mod 5 isn't 0.
    One task sorts the sample's features (60 MB at most) and fits the model, which alone comes to the driver.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (_id_check(F.col("doc_id")) != 0))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    each = sample / max(1, len(counts))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11) / F.lit(float(1 << 53))
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (draw < min(1.0, each / n)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = pa.Table.from_batches(held) if held else schema.empty_table()
        at, share = (([np.frombuffer(x.as_buffer(), kind) for x in rows[name]]) for name, kind in (("at", "<u2"), ("share", "<f4")))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(rows["lang"].to_pylist(), at, share))], pa.binary())], names=["model"])

    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("share", pa.binary())])
    fitted = features(usable.where(chosen).select("doc_id", "lang", "text")).repartition(1).sortWithinPartitions("doc_id", "lang").mapInArrow(fit, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else Model([], [], [])


_models: dict[str, Model] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with held_out, lang_pred and score.

    lang_pred is one of the model's languages, or ``und`` (score 0) if the text is null or has no letter,
    or if the model knows no language; score, from 0 to 1, is the product of the two steps' logistic
    confidence. held_out tells whether crc32(doc_id as text) mod 5 is 0 (false for a null doc_id). lang,
    source and doc_id take no part in a prediction. Repeated rows are each predicted; other columns are
    carried along, and columns of the new names are replaced.
    """
    new = ["held_out", "lang_pred", "score"]
    kept = [c for c in docs.columns if c not in new]
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = shared.value
        m = _models[key]
        for batch in batches:
            text, held = batch.column(len(kept)), batch.column(len(kept) + 1)
            for lo, hi, data, offsets in blocks(text):
                good = _has_letter(text[lo:hi].to_pylist())
                if m.families:
                    lang, score = m.predict(data, offsets)
                    good_lang, good_score = np.where(good, lang, "und"), np.where(good, score, 0.0)
                else:
                    good_lang, good_score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[lo:hi] for k in range(len(kept))), held[lo:hi], pa.array(good_lang.tolist(), pa.string()), pa.array(good_score, pa.float64())], names=[*kept, *new])

    wide = docs.select(*kept, F.col("text").cast("string").alias("__text"), F.coalesce(_id_check(F.col("doc_id")) == 0, F.lit(False)).alias("__held"))
    return wide.mapInArrow(run, with_fields(docs.select(*kept), "held_out boolean, lang_pred string, score double"))
