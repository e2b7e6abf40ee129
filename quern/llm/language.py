"""Language identification by string kernels.

The kernel of two texts counts the character 1-, 2- and 3-grams present in both (blended spectrum, presence only; letters of
any script in lower case, anything else is one character), divided by the root of the product of their own counts. Nystroem landmarks turn it into features, one-versus-rest kernel ridge
regression learns a weight per landmark and language, and texts are scored by products of 0/1 matrices.
Defined results: null text and text without a letter give `und` and 0, so does every text if nothing could be learned;
equal texts give equal results, repeated rows too, each kept; ties go to the language first in order of name; texts of any length
are read whole; extra columns pass, ones named like a result are replaced; an empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from quern.llm.batches import add_columns, sample_ids, small_batches

#: Bounds of the training sample: texts a language, characters of a sampled text, landmarks a language.
PER_LANGUAGE, MAX_CHARS, LANDMARKS = 200, 20_000, 32
RIDGE = 1e-2
#: Odd multipliers that number n-grams, one for each length.
STEP, LENGTHS = np.uint64(0x9E3779B97F4A7C15), [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


def _fold_table() -> np.ndarray:
    t = np.zeros(65536, np.uint32)
    for c in range(65536):
        s = chr(c)
        if s.isalpha():
            t[c] = ord(s.lower()[0])
    return t


_table: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    """Code points in lower case; 0 for anything but a letter."""
    if not _table:
        _table.append(_fold_table())
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(c) and c.max() >= 65536:
        far, where = np.unique(c[c >= 65536], return_inverse=True)
        low = _table[0][np.minimum(c, 65535)].copy()
        low[c >= 65536] = np.array([ord(chr(x).lower()[0]) if chr(x).isalpha() else 0 for x in far], np.uint32)[where]
        return low
    return _table[0][c]


def present(text: str) -> np.ndarray:
    """Ascending 64-bit numbers of the distinct character 1-, 2- and 3-grams in text, but for those without a letter."""
    c = folded(text).astype(np.uint64)
    out, key, letter = [], np.zeros(len(c), np.uint64), np.zeros(len(c), bool)
    for n, by in enumerate(LENGTHS):
        if len(c) <= n:
            break
        last = c[n:]
        key = (key[: len(last)] * STEP + last) * STEP
        letter = letter[: len(last)] | (last > 0)
        got = np.sort(key[letter] * by)
        out.append(got[np.append(True, got[1:] != got[:-1])] if len(got) else got)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class KernelModel:
    languages: list[str]
    grams: np.ndarray  # ascending n-grams, one a row of `landmarks`
    landmarks: np.ndarray  # columns x landmarks, 0/1, divided by the root of each landmark's count
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(self.grams)), np.float32)
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(self.grams, s), len(self.grams) - 1)
            x[i, at[self.grams[at] == s]] = 1
        size = np.sqrt(np.maximum(1, [len(s) for s in sets])).astype(np.float32)
        return (x @ self.landmarks) / size[:, None]

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.weights + self.bias


def train(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    pairs = [(present(t), g) for t, g in zip(texts, langs) if has_letter(t)]
    if not pairs:
        return None
    names = sorted({g for _, g in pairs})
    chosen = []
    for g in names:
        own = [s for s, h in pairs if h == g]
        chosen += own[:: max(1, len(own) // landmarks)][:landmarks]
    grams = np.unique(np.concatenate(chosen))
    lm = np.zeros((len(grams), len(chosen)), np.float32)
    for j, s in enumerate(chosen):
        lm[np.searchsorted(grams, s), j] = 1 / np.sqrt(len(s))
    model = KernelModel(names, grams, lm, np.zeros((len(chosen), len(names)), np.float32), np.zeros(len(names), np.float32))
    k_mm = model.kernel(chosen).astype(float)
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    ok = value > 1e-6 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    z = np.concatenate([model.kernel([s for s, _ in pairs[i : i + 256]]) for i in range(0, len(pairs), 256)]).astype(float) @ root
    y = np.array([[1.0 if g == h else -1.0 for h in names] for _, g in pairs])
    size = np.array([1 / sum(h == g for _, h in pairs) for _, g in pairs])  # each language weighs the same
    mean_z, mean_y = np.average(z, 0, size), np.average(y, 0, size)
    zc, yc = z - mean_z, y - mean_y
    beta = np.linalg.solve((zc * size[:, None]).T @ zc + ridge * np.eye(z.shape[1]), (zc * size[:, None]).T @ yc)
    model.weights, model.bias = (root @ beta).astype(np.float32), (mean_y - mean_z @ beta).astype(np.float32)
    return model


def predict(model: KernelModel | None, col: pa.Array) -> tuple[list[str], np.ndarray]:
    texts = col.to_pylist()
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    who = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    for lo in range(0, len(who), 128):
        part = who[lo : lo + 128]
        f = model.scores([present(texts[i]) for i in part])
        best = f.argmax(1)
        for i, b, row in zip(part, best, f):
            lang[i], score[i] = model.languages[b], min(1.0, max(0.0, (float(row[b]) + 1) / 2))
    return lang, score


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS, landmarks: int = LANDMARKS) -> KernelModel | None:
    """Train on at most per_language texts of each language, of at most max_chars characters; only they come to the driver."""
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t"), F.col(lang).alias("_g")).where((F.length("_t") <= max_chars) & F.col("_g").isNotNull())
    ids = sample_ids(rows, "_id", "_g", per_language, salt=3)
    got = small_batches(rows.join(F.broadcast(ids.select("_id").distinct()), "_id")).select("_id", "_t", "_g").toArrow().sort_by([("_id", "ascending"), ("_t", "ascending")])
    return train(got.column("_t").to_pylist(), got.column("_g").to_pylist(), landmarks)


FIELDS = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]


def identify(docs: DataFrame, model: KernelModel | None, text: str = "text") -> DataFrame:
    """docs with `lang_pred` and `score`; one map over whole texts. The model's size is bounded by its landmarks."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value

        def run(col):
            lang, score = predict(own, col)
            return [pa.array(lang, pa.string()), score]

        return run

    return add_columns(docs, text, make, FIELDS)
