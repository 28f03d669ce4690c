"""Language identification by error-correcting output codes.

Each language has a codeword; each bit is predicted by a binary classifier over hashed byte n-grams of the
lower-cased text (orders 1 to 4, digits and punctuation as blanks). A classifier is the log-odds of the two sides of
its bit, where every language counts alike; its counts come from all training rows, summed per language and feature.
Margins are means over a text's n-grams, scaled by what the classifier gives on its own languages. Decoding is
loss-weighted: a language's loss is the sum over bits of weight * log(1 + exp(-code * margin)), where a bit's weight
is how well it parts the languages. The smallest loss wins; score is its softmax share; a result is `ambiguous` if
the two best shares differ by less than `gap`.

Defined cases: null texts and texts without letters are `und` with score 0, as is everything if nothing was learned.
Null labels train nothing, nor do labels beyond the `most_languages` most frequent, so a dirty column of labels can't fill a
task's memory. Ties go to the first language by code point. Rows are judged one by one, so null and
repeated ids need no care. Other columns pass through unchanged. Empty tables give an empty result. Very long texts are read whole, in slices.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, mix

BITS = 15
ORDERS = (1, 2, 3, 4)
SLICE = 1 << 16
BLANK = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str):
    """Feature numbers of all n-grams, slice by slice; order o starts at o-1 in the first slice's terms."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(BLANK).split()) + b" ", np.uint8)
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + max(ORDERS) - 1].astype(np.uint64)
        own, out, code = min(SLICE, len(data) - at), [], np.zeros(len(part), np.uint64)
        for k in range(max(ORDERS)):
            n = len(part) - k
            if n <= 0:
                break
            code = (code[:n] << np.uint64(8)) | part[k:]
            if k + 1 in ORDERS:
                out.append((mix(code[:own] + (np.uint64(k + 1) << np.uint64(40))) >> np.uint64(64 - BITS)).astype(np.int64))
        yield np.concatenate(out)


def codebook(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages: all two-sided splits up to 7 languages, else the best of some
    seeded random codes of 10 log2 n bits, by smallest distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if i == 0 or not s >> (i - 1) & 1 else -1 for s in splits] for i in range(n)], float)
    rng, best, apart = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, math.ceil(10 * math.log2(n))))
        if (abs(code.sum(0)) == n).any():
            continue
        d = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9).min()
        if d > apart:
            best, apart = code, d
    return best


class Model:
    """Languages, codewords, weights of features by bit, scale and weight of each bit."""

    def __init__(self, languages: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.languages, self.code = languages, codebook(len(languages))
        if not languages:
            return
        p = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * counts.shape[1])
        weights = []
        for bit in self.code.T:
            up, down = (p[bit > 0].mean(0), p[bit < 0].mean(0)) if (bit < 0).any() else (p.mean(0), np.full(p.shape[1], 1 / p.shape[1]))
            weights.append(np.log(up) - np.log(down))
        self.weights = np.array(weights, np.float32).T.copy()
        expected = p @ self.weights * self.code  # margin of each bit on each language, positive if right
        self.scale = np.maximum(np.abs(expected).mean(0), 1e-6)
        self.share = np.maximum(expected.min(0) / self.scale, 0.05)
        self.share /= self.share.sum()

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, share of the best, gap to the second)."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, 0.0
        total, n = np.zeros(self.weights.shape[1]), 0
        for g in grams(text):
            total += self.weights[g].sum(0, dtype=np.float64)
            n += len(g)
        margin = total / n / self.scale
        loss = (np.logaddexp(0, -4 * self.code * margin) * self.share).sum(1)
        share = np.exp(-4 * (loss - loss.min()))
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        return self.languages[order[0]], float(share[order[0]]), float(share[order[0]] - (share[order[1]] if len(order) > 1 else 0))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most_languages: int = 256) -> Model:
    """Fit on every row with a text and one of the `most_languages` labels that most rows have (ties: the first by code
    point). What reaches the driver, and what a task holds, is one count per such language and feature."""

    def count(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for g in grams(text):
                    own += np.bincount(g, minlength=1 << BITS)
        step = 1 << 11
        for lang, own in total.items():
            yield pa.RecordBatch.from_pylist([{"lang": lang, "part": k, "counts": own[k * step : (k + 1) * step].astype("<i8").tobytes()} for k in range((1 << BITS) // step)])

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(b, "<i8") for b in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "part": table.column("part")[:1], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    schema = "lang string, part long, counts binary"
    rows = labelled.select(text_col, lang_col).dropna()
    common = rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_languages).collect()
    rows = rows.where(F.col(lang_col).isin([r[0] for r in common]))
    found = rows.mapInArrow(count, schema).groupBy("lang", "part").applyInArrow(add, schema).collect()
    languages = sorted({r["lang"] for r in found})
    counts = [np.concatenate([np.frombuffer(r["counts"], "<i8") for r in sorted((r for r in found if r["lang"] == x), key=lambda r: r["part"])]) for x in languages]
    return Model(languages, np.array(counts, float).reshape(len(languages), 1 << BITS))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_of_id(F.col(id_col)) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, gap: float = 0.1, text_col: str = "text", out_col: str = "judged") -> DataFrame:
    """docs with `out_col`, a struct of lang_pred, score and ambiguous. The model is broadcast: a row of 2^15 features for each bit,
    whatever the input. A column of docs by the name of out_col is an error, not overwritten."""
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents have a column {out_col}; choose another out_col")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def judged(text):
        import pandas as pd

        rows = [shared.value.judge(t) for t in text]
        return pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "ambiguous": [r[0] != "und" and r[2] < gap for r in rows]})

    return docs.withColumn(out_col, judged(text_col))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "judged.*")
