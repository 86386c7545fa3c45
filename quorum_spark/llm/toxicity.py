"""Toxicity by a convolutional text classifier in NumPy.

Words (ASCII marks separate them, ASCII letters are lower-cased) are embedded by the sum of two hashed rows. Filters of
one, two and three words run over the whole text, their maxima over all positions feed a logistic output. Thresholds are
calibrated for each language, which is guessed from the text itself, and scores are shifted so that every threshold lies
at 0.3.

Training reads every labelled row outside the held-out quarter. Rows are dealt by a hash of their ids into blocks of about ROWS, whatever
the partitioning. In each epoch every block goes on by itself from the same model, and a row of the model moves by the mean of what the blocks that
hold it made of it, so a rare word counts as much as in one block; sums are of whole numbers, so their order doesn't matter. First weights, the guess
of languages (of at most 256) and thresholds are counts over all rows. The model has a fixed size of about
4 MB and is broadcast. Null and empty texts get the score of a text without words. Without any labelled
rows of both kinds the score is 0. Rows are scored one by one, so ties, copies and extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.llm.learning import MOST_VALUES, counts_of, logit, remainder, segment_sum, sigmoid
from quorum_spark.llm.words import MARKS, Words, give_back, pieces
from quorum_spark.operators.scratch import Scratch, arrow_rows, small_batches

THRESHOLD = 0.3
BUCKETS, WIDTH, FILTERS, SIZES = 1 << 15, 16, 16, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.1
#: Labelled rows of a block, about.
ROWS = 4096
#: Whole numbers of changes, and bins of raw scores, to one.
UNIT, BINS = float(1 << 20), 128
#: A language needs so many rows of each label for a threshold of its own.
ENOUGH = 20


class Texts:
    """Two embedding rows for every word. Each text has one more, empty word in front, so that none is without words."""

    def __init__(self, arr: pa.Array):
        w = Words(arr, lower=True, spaces=MARKS)
        h = w.hashes()
        n = len(w)
        self.at = w.at + np.arange(n + 1)
        self.rows = np.zeros((2, len(h) + n), np.int64)
        place = np.arange(len(h)) + w.doc_of() + 1
        self.rows[0, place] = (h >> np.uint64(8)) % np.uint64(BUCKETS - 1) + np.uint64(1)
        self.rows[1, place] = (h >> np.uint64(36)) % np.uint64(BUCKETS - 1) + np.uint64(1)

    def __len__(self) -> int:
        return len(self.at) - 1

    @classmethod
    def packed(cls, rows: np.ndarray, at: np.ndarray) -> Texts:
        t = cls.__new__(cls)
        t.rows, t.at = rows, at
        return t

    def take(self, part: np.ndarray) -> Texts:
        lens = np.diff(self.at)[part]
        at = np.concatenate([[0], np.cumsum(lens)])
        return Texts.packed(self.rows[:, np.repeat(self.at[part] - at[:-1], lens) + np.arange(at[-1])].astype(np.int64), at)


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {"e0": draw(BUCKETS, WIDTH, by=0.1), "e1": draw(BUCKETS, WIDTH, by=0.1), "out": draw(FILTERS * len(SIZES), by=0.1), "bias": np.zeros(1, np.float32)}
        for s in SIZES:
            self.p |= {f"w{s}": draw(s, WIDTH, FILTERS, by=(s * WIDTH) ** -0.5), f"b{s}": np.zeros(FILTERS, np.float32)}
        self.p["e0"][0] = self.p["e1"][0] = 0
        self.sums = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        self.languages: list = []

    def forward(self, t: Texts, keep: bool = True):
        """Each text's pooled features, and the position that each comes from if these are to be kept."""
        x = self.p["e0"][t.rows[0]] + self.p["e1"][t.rows[1]]
        n, first = len(x), t.at[:-1]
        pooled, where = [], []
        for s in SIZES:
            c = np.full((n, FILTERS), -1.0, np.float32)
            if n >= s:
                c[: n - s + 1] = sum(x[j : n - s + 1 + j] @ self.p[f"w{s}"][j] for j in range(s)) + self.p[f"b{s}"]
            for j in range(1, s):  # windows that leave their text
                c[np.maximum(t.at[1:] - j, first)] = -1.0
            best = np.maximum.reduceat(c, first, axis=0)
            pooled.append(np.maximum(best, 0))
            where.append((c, best) if keep else None)
        return x, np.concatenate(pooled, 1), where

    def step(self, t: Texts, y: np.ndarray, weight: np.ndarray) -> None:
        x, feats, where = self.forward(t)
        err = ((sigmoid(feats @ self.p["out"] + self.p["bias"]) - y) * weight / len(y)).astype(np.float32)
        grads = {"out": feats.T @ err, "bias": err.sum(keepdims=True)}
        back = err[:, None] * self.p["out"] * (feats > 0)
        dx: dict[str, list] = {"i": [], "g": []}
        doc = np.repeat(np.arange(len(t)), np.diff(t.at))
        for k, s in enumerate(SIZES):
            c, best = where[k]
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            hit_row, hit_col = np.nonzero((c == best[doc]) & (best > 0)[doc])
            _, one = np.unique(doc[hit_row] * FILTERS + hit_col, return_index=True)  # the first of equal maxima
            row, col = hit_row[one], hit_col[one]
            own = g[doc[row], col]
            gw, one_of = np.zeros_like(self.p[f"w{s}"]), np.eye(FILTERS, dtype=np.float32)
            for j in range(s):
                at = np.minimum(row + j, len(x) - 1)
                gw[j] = x[at].T @ (own[:, None] * one_of[col])
                dx["i"].append(at)
                dx["g"].append(own[:, None] * self.p[f"w{s}"][j].T[col])
            grads |= {f"w{s}": gw, f"b{s}": np.bincount(col, own, FILTERS).astype(np.float32)}
        i, g = np.concatenate(dx["i"]), np.concatenate(dx["g"])
        for k, name in enumerate(("e0", "e1")):
            rows, inverse = np.unique(t.rows[k][i], return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            total = np.add.reduceat(g[order], np.searchsorted(inverse[order], np.arange(len(rows)))) if len(rows) else np.zeros((0, WIDTH), np.float32)
            self.sums[name][rows] += total**2
            self.p[name][rows] -= RATE * total / np.sqrt(self.sums[name][rows])
            self.p[name][0] = 0
        for k, g in grads.items():
            self.sums[k] += g**2
            self.p[k] -= RATE * g / np.sqrt(self.sums[k])

    def raw_scores(self, t: Texts) -> np.ndarray:
        return self.forward(t, keep=False)[1] @ self.p["out"] + self.p["bias"]

    def guess(self, t: Texts) -> np.ndarray:
        """The index of each text's likeliest language."""
        if len(self.languages) < 2:
            return np.zeros(len(t), np.int64)
        return segment_sum(self.lang_table[t.rows[0]], t.at).argmax(1)

    def flat(self) -> np.ndarray:
        """Weights and their sums of squares, WIDTH of each in a row."""
        lay = lambda x: np.concatenate([np.pad(v.ravel(), (0, -v.size % WIDTH)) for v in x.values()]).reshape(-1, WIDTH)
        return np.concatenate([lay(self.p), lay(self.sums)], 1).astype(np.float64)

    def put(self, flat: np.ndarray) -> None:
        for x, part in ((self.p, flat[:, :WIDTH].ravel()), (self.sums, flat[:, WIDTH:].ravel())):
            at = 0
            for k, v in x.items():
                x[k] = part[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size + -v.size % WIDTH

    def scores(self, t: Texts) -> np.ndarray:
        return sigmoid(self.raw_scores(t) - self.shift[self.guess(t)] + logit(THRESHOLD))


def _best(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of raw scores with the largest F1, in the middle of the gap above which it holds."""
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    tp, fp = np.cumsum(y * weight), np.cumsum((1 - y) * weight)
    f1 = np.where(np.append(z[1:] != z[:-1], True), 2 * tp / (tp + fp + (y * weight).sum()), -1)
    k = int(f1.argmax())
    return float(z[k] - 1 if k + 1 == len(z) else (z[k] + z[k + 1]) / 2)


def _words(batches):
    """Rows with their texts as pairs of numbers of embedding rows."""
    for batch in batches:
        for part in pieces(batch, "text"):
            t = Texts(part.column("text"))
            packed = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer((t.at * 4).astype(np.int32)), pa.py_buffer(t.rows.T.astype(np.uint16).tobytes())])
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), packed], names=[*names, "words"])


_BLOCK = "block long, fit0 long, fit1 long, all0 long, all1 long, langs array<string>, held array<long>, lang binary, y binary, tune binary, at binary, words binary"


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """A block's rows, one for each id and label, in one row. A quarter is kept for thresholds.

    A fifth of the texts of label 0 come once more, as up to 20 of their words in a row, so that a text isn't toxic for being short.
    """
    number = key[0].as_py()
    rng = np.random.default_rng([11, number])
    table = table.sort_by([(c, "ascending") for c in ("doc_id", "toxic", "mark", "lang")])
    table = table.filter(pa.array(~table.select(["doc_id", "toxic"]).to_pandas().duplicated().to_numpy()))
    words = [np.frombuffer(w.as_buffer(), np.uint16).reshape(-1, 2) for w in table.column("words")]
    y, lang = table.column("toxic").to_numpy().astype(np.uint8), np.array(table.column("lang").to_pylist(), object)
    short = rng.permutation(np.flatnonzero(y == 0))
    short = short[: len(short) // 5 + 1]
    for k in short:
        n = len(words[k]) - 1
        a = 1 + int(rng.integers(0, max(1, n)))
        words.append(np.concatenate([words[k][:1], words[k][a : a + int(rng.integers(0, 21))]]))
    y, lang = np.append(y, y[short]), np.append(lang, lang[short])
    tune = rng.permutation(len(y)) < len(y) // 4
    langs, code, held = np.unique(lang.astype(str), return_inverse=True, return_counts=True)
    count = lambda of: [int((of & (y == label)).sum()) for label in (0, 1)]
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    data = [code.astype(np.int32), y, tune.astype(np.uint8), at.astype(np.int64), np.concatenate(words).T]
    row = [number, *count(~tune), *count(tune | True), langs.tolist(), held.tolist(), *(x.tobytes() for x in data)]
    kinds = [*[pa.int64()] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 5]
    return pa.Table.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])


class Block:
    def __init__(self, row: dict):
        self.number, self.langs = row["block"], row["langs"]
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.lang, self.y, self.tune = get("lang", np.int32), get("y", np.uint8).astype(np.float32), get("tune", np.uint8) > 0
        self.texts = Texts.packed(get("words", np.uint16).reshape(2, -1), get("at", np.int64))

    def parts(self, rows: np.ndarray, size: int):
        for a in range(0, len(rows), size):
            yield rows[a : a + size], self.texts.take(rows[a : a + size])


def blocks(docs: DataFrame, known: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """All labelled texts, a row of the table for each block. known: doc_id, toxic (0 or 1), about so many rows."""
    n = -(-max(rows, 1) // ROWS)
    own = docs.where(remainder("doc_id", 4) != 2).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").join(known.distinct(), "doc_id")
    own = own.select("doc_id", "toxic", "lang", F.xxhash64("text").alias("mark"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("block"), "text")
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in own.columns[:-1])
    dealt = own.mapInArrow(_words, f"{kinds}, words binary").repartition(n, "block")
    return scratch.cut(dealt.groupBy("block").applyInArrow(_block, _BLOCK), "blocks", large_rows=True)


def _each(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch.slice(row, 1).to_pylist()[0])
        give_back()


def _counts(languages: list[str]):
    """How many texts of either label, of those to fit, hold a bucket (columns 0 and 1), and how many words of each language (columns from 2) are in it."""
    wide = len(languages) + 2

    def run(batches):
        total = np.zeros(BUCKETS * wide, np.int64)
        for b in _each(batches):
            code = np.array([languages.index(x) if x in languages else -1 for x in b.langs])[b.lang]
            for part, t in b.parts(np.arange(len(b.y)), 256):
                doc = np.repeat(np.arange(len(part)), np.diff(t.at))
                pairs = np.unique(doc * BUCKETS + t.rows[0])
                own = part[pairs // BUCKETS]
                pairs, own = pairs[~b.tune[own]], own[~b.tune[own]]
                total += np.bincount(pairs % BUCKETS * wide + b.y[own].astype(np.int64), minlength=len(total))
                own = code[part][doc]
                total += np.bincount((t.rows[0] * wide + 2 + own)[own >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    return run


def _epoch(shared, epoch: int, weight: np.ndarray):
    """What blocks change in rows of the model, summed, and how many changed each row."""

    def run(batches):
        model = shared.value
        start = model.flat()
        total, n = np.zeros(start.shape, np.int64), np.zeros(len(start), np.int64)
        for b in _each(batches):
            model.put(start)
            for part, t in b.parts(np.random.default_rng([epoch, b.number]).permutation(np.flatnonzero(~b.tune)), BATCH):
                model.step(t, b.y[part], weight[b.y[part].astype(int)])
            change = np.rint((model.flat() - start) * UNIT).astype(np.int64)
            total += change
            n += change.any(1)
        model.put(start)
        n = np.repeat(n, 2 * WIDTH // len(_CHANGES))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *(pa.array(c) for c in total.reshape(len(n), -1)[at].T)], names=["at", "n", *_CHANGES])
        give_back()

    return run


#: Columns of the table of changes; a row of the model takes several of its rows, as a wider table isn't compiled.
_CHANGES = [f"c{k}" for k in range(8)]


def _binned(shared):
    """How many rows of a guessed language, label and use have a raw score in a bin."""

    def run(batches):
        model = shared.value
        for b in _each(batches):
            found = []
            for part, t in b.parts(np.arange(len(b.y)), 256):
                z = np.floor(np.clip(model.raw_scores(t), -64, 64) * BINS).astype(np.int64)
                found.append(np.stack([model.guess(t), z, b.y[part].astype(np.int64), b.tune[part].astype(np.int64)]))
            keys, n = np.unique(np.concatenate(found, 1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(n)], names=["guess", "bin", "y", "tune", "n"])

    return run


def _summed(rows: DataFrame, run, keys: list[str], values: list[str], scratch: Scratch, means: bool = False) -> pa.Table:
    """What tasks make of blocks, summed by keys. Keys are few, as many as the model has rows or bins. means: the values after n as what one unit of n has, of single precision.

    Each task sends as much as the model has, so there are no more tasks than run at once, however many blocks there are.
    """
    few = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))
    out = few.mapInArrow(run, ", ".join(f"{c} long" for c in (*keys, *values)))
    with small_batches(rows.sparkSession, 1):  # rows have megabytes, those of the result don't
        found = out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])
        if means:
            found = found.select(*keys, *[(F.col(c) / F.col("n") / UNIT).cast("float").alias(c) for c in values[1:]])
        found = scratch.cut(found, "sums")
    table = found.toArrow()
    scratch.drop(found)
    return table


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of all labelled rows outside the held-out quarter, None without rows of both labels. docs: doc_id, text, lang, which is used for thresholds only; labels: doc_id, toxic."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & (remainder("doc_id", 4) != 2)).select("doc_id", "toxic")
    counts = counts_of(known, "toxic")
    if not (counts.get(0) and counts.get(1)):
        return None
    share = counts[1] / sum(counts.values())
    scratch = Scratch(spark, "toxicity")
    rows = blocks(docs, known.where("toxic in (0, 1)"), counts[0] + counts[1], scratch)
    fit0, fit1, all0, all1 = (x or 0 for x in rows.agg(*[F.sum(c) for c in ("fit0", "fit1", "all0", "all1")]).first())
    if not (all0 and all1):
        return None
    model = Model()
    named = rows.select(F.explode(F.arrays_zip("langs", "held")).alias("x")).groupBy("x.langs").agg(F.sum("x.held").alias("n"))
    model.languages = sorted(r[0] for r in named.orderBy(F.desc("n"), "langs").limit(MOST_VALUES).collect())
    table = _summed(rows, _counts(model.languages), ["at"], ["n"], scratch)
    have = np.zeros((BUCKETS, len(model.languages) + 2))
    have.ravel()[table["at"].to_numpy()] = table["n"].to_numpy()
    words = have[:, 2:] + 0.1
    model.lang_table = np.log(words / words.sum(0)).astype(np.float32)
    # first rows start from how far more often texts of label 1 hold them
    odds = np.log((have[:, 1] + 1) / (fit1 + 2)) - np.log((have[:, 0] + 1) / (fit0 + 2))
    model.p["e0"][:, 0] = model.p["e1"][:, 0] = 0
    model.p["e0"][1:, 0] = np.clip(odds[1:], -1, 4) / 2
    model.p["w1"][0, 0, : FILTERS // 2] = 1.0
    model.p["out"][: FILTERS // 2] = 0.2
    mean = all1 / (all0 + all1)
    weight = np.array([0.5 / (1 - mean), 0.5 / mean], np.float32)
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast(model)
        t = _summed(rows, _epoch(shared, epoch, weight), ["at"], ["n", *_CHANGES], scratch, means=True)
        shared.destroy()
        flat = model.flat()
        at, parts = t["at"].to_numpy(), flat.reshape(-1, len(_CHANGES))
        for k, c in enumerate(_CHANGES):
            parts[at, k] += t[c].to_numpy()
        model.put(flat)
        del t, flat, at, parts
        give_back()
    shared = spark.sparkContext.broadcast(model)
    t = _summed(rows, _binned(shared), ["guess", "bin", "y", "tune"], ["n"], scratch).sort_by([(c, "ascending") for c in ("guess", "bin", "y", "tune")])
    shared.destroy()
    scratch.drop(rows)
    guess, z, y, tune, n = (t[c].to_numpy() for c in ("guess", "bin", "y", "tune", "n"))
    z, tune = (z + 0.5) / BINS, tune > 0
    true = n * np.where(y == 1, share / mean, (1 - share) / (1 - mean))
    both = lambda of: min(n[of & (y == 1)].sum(), n[of & (y == 0)].sum())
    of = tune if both(tune) else tune | True
    model.shift = np.full(len(model.languages), _best(z[of], y[of], true[of]))
    for k in range(len(model.languages)):
        own = tune & (guess == k)
        if both(own) >= ENOUGH:
            model.shift[k] = _best(z[own], y[own], true[own])
    model.sums = None
    return model


def _score(shared, name: str):
    def run(batches):
        model = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                t = Texts(part.column("text"))
                score = model.scores(t) if model else np.zeros(len(t))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score.astype(np.float64))], names=[*part.schema.names, name])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, out_columns: list[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """docs with columns out_columns and text, plus the score under a name. Learns from labels (doc_id, toxic) outside the held-out quarter."""
    spark = docs.sparkSession
    arrow_rows(spark)
    model = train(docs.select("doc_id", "text", "lang"), labels)
    keep = docs.select(*dict.fromkeys([*out_columns, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + f", `{name}` double"
    return keep.mapInArrow(_score(spark.sparkContext.broadcast(model), name), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.3)."""
    out = toxicity_scores(docs, labels).drop("text")
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
