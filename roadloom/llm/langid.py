"""Language identification in two steps: the family first, then one language against another within it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Families by language code (fixed values); what is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en is nl no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ur",
}
#: Hashed n-grams of one to three letters.
DIMS = 2048
#: A classifier is fitted on so many labelled rows of each language at most, those with the smallest hash.
SAMPLE = 400
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs.split()), lang)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the n-gram counts of the whole text, of length 1; None without any letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    points = np.where(_letters()[points], points, np.uint32(0)).astype(np.uint32)
    if not points.any():
        return None
    a = np.concatenate([[0], points, [0]]).astype(np.uint32)
    keep = (a[1:] != 0) | (a[:-1] != 0)  # no n-grams of gaps alone
    one, two = a[a != 0], (a[:-1] * np.uint32(0x9E3779B1) + a[1:])[keep]
    three = (a[:-2] * np.uint32(0x85EBCA6B) + a[1:-1] * np.uint32(0x9E3779B1) + a[2:])[a[1:-1] != 0]
    grams = np.concatenate([one * np.uint32(0x27D4EB2F), two * np.uint32(0xC2B2AE35) + np.uint32(1), three * np.uint32(0x165667B1) + np.uint32(2)])
    x = np.sqrt(np.bincount((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(21), minlength=DIMS))
    return x / np.linalg.norm(x)


def svm(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent; the last weight is the threshold."""
    x = np.hstack([x, np.ones((len(x), 1))])
    y, alpha, w = np.where(positive, 1.0, -1.0), np.zeros(len(x)), np.zeros(x.shape[1])
    norm, order = (x * x).sum(1), np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0.0), cost)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """``pairs`` holds, for the families and for the languages of each family, a machine for each pair of classes."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names, langs = sorted(set(langs)), np.array(langs)
        kin = np.array([family_of(n) for n in langs])
        self.groups = {"": sorted(set(kin.tolist()))} | {f: [n for n in names if family_of(n) == f] for f in set(kin.tolist())}
        self.pairs = {}
        for group, classes in self.groups.items():
            label = langs if group else kin
            for a, b in combinations(classes, 2):
                rows = (label == a) | (label == b)
                self.pairs[group, a, b] = svm(x[rows], label[rows] == a).astype(np.float32)

    def choose(self, group: str, x: np.ndarray) -> tuple[str, float]:
        """The class with the most wins, then the largest margins; how sure its closest pair is."""
        classes = self.groups[group]
        margins = {c: [] for c in classes}
        for a, b in combinations(classes, 2):
            w = self.pairs[group, a, b]
            m = float(x @ w[:-1] + w[-1])
            margins[a].append(m)
            margins[b].append(-m)
        best = max(classes, key=lambda c: (sum(m > 0 for m in margins[c]), sum(margins[c]), c))
        return best, 1 / (1 + np.exp(-3 * min(margins[best], default=10.0)))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.groups[""]:
            return UNKNOWN, 0.0
        family, sure = self.choose("", x)
        lang, surer = self.choose(family, x)
        return lang, float(min(max(sure * surer, 0.0), 1.0))


def _remainder(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 3


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample: int = SAMPLE) -> Model:
    """Fit on rows with a label and crc32(id) mod 3 other than 1: of each language the ``sample`` ids with the smallest hash.
    Rows without id or letters are not used.  Only the features of that bounded sample reach the driver."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l")).where("i is not null and l is not null").where(_remainder("i") != 1)
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    chosen = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("i", "l").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = [], []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = features(text)
                if x is not None:
                    langs.append(lang)
                    rows.append(x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["lang", "x"])

    texts = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    texts = texts.join(F.broadcast(chosen), ["i", "l"]).withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i", F.xxhash64("t"))))
    got = texts.where(F.col("n") <= sample).select("l", "t").mapInArrow(run, "lang string, x binary").collect()
    got = sorted((r["lang"], bytes(r["x"])) for r in got)
    x = np.array([np.frombuffer(b, "<f4") for _, b in got]).reshape(len(got), DIMS)
    return Model(x, [lang for lang, _ in got])


def identify(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", keep_rows: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (crc32(id) mod 3 is 1; false for a null id), lang_pred, score; with
    ``keep_rows`` instead the columns of ``docs`` and a struct ``found`` (lang_pred, score).

    The prediction sees the whole text and nothing else.  Texts that are null or have no letter are `und` with score 0, and
    so is everything where there was nothing to learn from.  Repeated rows are rows of their own; other columns, also ones named like
    the result's, do no harm; an empty table gives an empty one.
    """

    @F.pandas_udf("lang_pred string, score double")
    def found(texts):
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    out = docs.select("*" if keep_rows else F.col(id_col).cast("long").alias("doc_id"), found(F.col(text_col)).alias("found"))
    if keep_rows:
        return out
    return out.select("doc_id", F.coalesce(_remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "found.lang_pred", "found.score")
