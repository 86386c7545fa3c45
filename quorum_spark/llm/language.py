"""Language identification by error-correcting output codes.

Every language has a codeword; for every bit a logistic classifier on hashed counts of one to three letters predicts it.
Decoding sums each bit's logistic loss, weighted by how reliable that bit was in training, and chooses the nearest
codeword; where the second comes close, `ambiguous` is set.

Training takes about SAMPLE rows (by hash of their ids), dealt evenly to the languages, to one task; a language with fewer
rows than its share has all of them in it.
The model has a fixed size for a number of languages and is broadcast. Texts that are null or hold no letter get `und`
and score 0; so does every text when nothing could be learned. Rows are answered one by one, so repeated rows and extra
columns don't matter; equal distances go to the language that comes first by name.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.llm.learning import counts_of, fitted, remainder, sample, sigmoid
from quorum_spark.operators.scratch import arrow_rows
from quorum_spark.llm.words import mix, pieces, raw

if TYPE_CHECKING:
    import pandas as pd

SAMPLE = 4000
FEATURES, ORDERS = 4096, (1, 2, 3)
ROUNDS, RATE = 60, 8.0
#: Bits of a codeword; more where there are many languages.
BITS = 15
#: Least lead in probability of a prediction that isn't ambiguous.
LEAD = 0.2
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
_SMALL = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(1 << 16)], np.uint32)


def letters(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with 0 in place of anything else, and where each text begins and ends."""
    buf, off = raw(arr)
    lead = (buf & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[off]
    codes = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = codes < 1 << 16
    keep = np.zeros(len(codes), bool)
    keep[low] = _LETTER[codes[low]]
    codes[low] = _SMALL[codes[low]]
    for c in np.unique(codes[~low]):
        keep[codes == c] = chr(c).isalpha()
    codes[~keep] = 0
    return codes, at


def features(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text: square roots of hashed counts of its letter groups, scaled to length 1."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    out = np.zeros(n * FEATURES)
    acc = np.zeros(len(codes), np.uint64)
    some = np.zeros(len(codes), bool)
    for k in ORDERS:
        m = len(codes) - k + 1
        if m <= 0:
            break
        acc, some = acc[:m] * np.uint64(0x110001) + codes[k - 1 :].astype(np.uint64) + np.uint64(k), some[:m] | (codes[k - 1 :] > 0)
        use = some & (doc[:m] == doc[k - 1 :])
        out += np.bincount(doc[:m][use] * FEATURES + (mix(acc[use]) % np.uint64(FEATURES)).astype(np.int64), minlength=len(out))
    x = np.sqrt(out.reshape(n, FEATURES)).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n rows of bits -1 and 1, as far apart as the best of many drawn codes."""
    bits = max(BITS, int(np.ceil(10 * np.log2(max(n, 2)) / 2)))
    rng, best, far = np.random.default_rng(5), None, -1
    for _ in range(300):
        code = np.where(rng.random((n, bits)) < 0.5, -1, 1)
        code[0, np.abs(code.sum(0)) == n] *= -1 if n > 1 else 1  # a bit that all share tells nothing
        near = min(((code[i] != code[j]).sum() for i in range(n) for j in range(i)), default=0)
        if near > far:
            best, far = code, near
    return best


class Model:
    def __init__(self, rows: pd.DataFrame):
        self.languages = sorted(rows["lang"].unique())
        y = np.array([self.languages.index(x) for x in rows["lang"]])
        self.code = codewords(len(self.languages))
        x = np.concatenate([features(*letters(pa.array(rows["text"].iloc[a : a + 128].tolist(), pa.string()))) for a in range(0, len(rows), 128)])
        share = 1 / np.bincount(y)[y]
        share = (share / share.sum()).astype(np.float32)[:, None]
        target = (self.code[y] > 0).astype(np.float32)
        self.weights, self.bias = np.zeros((FEATURES, target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
        speed = [np.zeros_like(self.weights), np.zeros_like(self.bias)]
        for _ in range(ROUNDS):
            err = ((sigmoid(x @ self.weights + self.bias) - target) * share).astype(np.float32)
            for v, p, g in ((speed[0], self.weights, x.T @ err), (speed[1], self.bias, err.sum(0))):
                v *= 0.9
                v -= RATE * (g + 1e-5 * p)
                p += v
        right = (((x @ self.weights + self.bias > 0) == (target > 0)) * share).sum(0)
        self.trust = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999))).astype(np.float32)
        self.trust /= self.trust.mean()

    def chances(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(1) for c in self.code], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 18):
                codes, at = letters(part.column("text"))
                some = np.diff(np.concatenate([[0], np.cumsum(codes > 0)])[at]) > 0
                n = len(at) - 1
                lang, score, unsure = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
                if model:
                    for a in range(0, n, 128):
                        b = min(n, a + 128)
                        p = model.chances(features(codes[at[a] : at[b]], at[a : b + 1] - at[a]))
                        first = p.argmax(1)
                        ok = some[a:b]
                        ranked = np.sort(p, 1)
                        lead = ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)
                        lang[a:b][ok] = np.array(model.languages, object)[first[ok]]
                        score[a:b][ok] = p.max(1)[ok]
                        unsure[a:b] = ok & (lead < LEAD)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous. Learns from `lang` outside the held-out quarter."""
    spark = docs.sparkSession
    arrow_rows(spark)
    known = docs.where("doc_id is not null and lang is not null").where(remainder("doc_id", 4) != 2).select("doc_id", "lang")
    counts = counts_of(known, "lang")
    rows = sample(known, docs.select("doc_id", "text"), "lang", counts, dict.fromkeys(counts, SAMPLE / max(1, len(counts))))
    model = fitted(rows, Model, "doc_id", "lang")
    out = docs.select("doc_id", "text").mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
