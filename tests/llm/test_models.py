"""The classifiers' arithmetic against plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from quorum_spark.llm import language, learning, quality, toxicity

TEXTS = ["one two three", "", None, "x", "a b", "the quick, brown fox! jumps over it", "zeta " * 40]


def plain_forward(model, rows, at):
    """Pooled features by loops over positions, filters and texts."""
    x = model.p["e0"][rows[0]] + model.p["e1"][rows[1]]
    out = []
    for a, b in zip(at[:-1], at[1:]):
        feats = []
        for s in toxicity.SIZES:
            for f in range(toxicity.FILTERS):
                values = [sum(float(x[i + j] @ model.p[f"w{s}"][j][:, f]) for j in range(s)) + float(model.p[f"b{s}"][f]) for i in range(a, b - s + 1)]
                feats.append(max([0.0, *values]))
        out.append(feats)
    return np.array(out)


def test_convolution_and_pooling():
    t, model = toxicity.Texts(pa.array(TEXTS, pa.string())), toxicity.Model()
    for s in toxicity.SIZES:
        model.p[f"b{s}"] += 0.05
    feats = model.forward(t)[1]
    assert len(t) == len(TEXTS)
    np.testing.assert_allclose(feats, plain_forward(model, t.rows, t.at), atol=1e-5)


def test_a_step_follows_the_numeric_gradient():
    """The first step of each weight goes against the sign of the loss's slope there."""
    t = toxicity.Texts(pa.array(["alpha beta gamma delta", "beta beta", "omega psi chi phi"], pa.string()))
    y, weight = np.array([1.0, 0.0, 1.0], np.float32), np.ones(3, np.float32)

    def loss(m):
        z = m.raw_scores(t).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / len(y))

    before, after = toxicity.Model(), toxicity.Model()
    after.step(t, y, weight)
    assert loss(after) < loss(before)
    rng = np.random.default_rng(1)
    for name in ("w1", "w2", "w3", "out", "bias"):
        moved = (after.p[name] - before.p[name]).ravel()
        for k in rng.permutation(np.flatnonzero(np.abs(moved) > 1e-3))[:6]:
            probe = toxicity.Model()
            probe.p[name].ravel()[k] += 1e-2
            up = loss(probe)
            probe.p[name].ravel()[k] -= 2e-2
            slope = (up - loss(probe)) / 2e-2
            if abs(slope) > 1e-4:
                assert np.sign(moved[k]) == -np.sign(slope), (name, k)


def test_codewords_are_far_apart_and_decoding_is_loss_weighted():
    rng = random.Random(4)
    words = {"aa": "kala mora tiko", "bb": "grunz stroff plick", "cc": "zyx vut qop"}
    rows = pd.DataFrame([(" ".join(rng.choices(v.split(), k=12)), k) for k, v in words.items() for _ in range(30)], columns=["text", "lang"])
    model = language.Model(rows)
    code = model.code
    assert min((code[i] != code[j]).sum() for i in range(3) for j in range(i)) >= code.shape[1] // 3
    x = language.features(*language.letters(pa.array(["kala tiko", "plick grunz", "vut"], pa.string())))
    got = model.chances(x)
    for row, chance in zip(x, got):
        margin = [float(row @ model.weights[:, b] + model.bias[b]) for b in range(code.shape[1])]
        loss = [sum(math.log1p(math.exp(-m * c)) * float(w) for m, c, w in zip(margin, word, model.trust)) for word in code]
        p = [math.exp(-v) for v in loss]
        np.testing.assert_allclose(chance, np.array(p) / sum(p), rtol=1e-3, atol=1e-6)
    assert [model.languages[k] for k in got.argmax(1)] == ["aa", "bb", "cc"]


def test_letter_groups_are_counted():
    codes, at = language.letters(pa.array(["Ab1", None, "b"], pa.string()))
    assert codes.tolist() == [97, 98, 0, 98] and at.tolist() == [0, 3, 3, 4]
    x = language.features(codes, at)
    np.testing.assert_allclose(np.sqrt((x * x).sum(1)), [1, 0, 1], atol=1e-6)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, len(quality.NAMES)))
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0).astype(float)
    model = quality.Model(x, y, np.ones(400))
    got = model.scores(x[:50])
    for row, score in zip(x[:50], got):
        b = [int(np.searchsorted(e, v, "right")) for e, v in zip(model.edges, row)]
        z = model.base + sum(t[k] for t, k in zip(model.tables, b))
        for grid, (i, j) in zip(model.grids, model.pairs):
            z += grid[(b[i] * quality.COARSE // quality.BINS) * quality.COARSE + b[j] * quality.COARSE // quality.BINS]
        assert abs(score - 1 / (1 + math.exp(-(z + math.log(0.3 / 0.7))))) < 1e-9
    assert ((model.scores(x) >= 0.3) == (y == 1)).mean() > 0.9
    assert (1, 2) in model.pairs


def test_a_tree_splits_where_the_gain_is():
    g, h = np.array([1.0, 1.0, -2.0, -2.0, 0.0]), np.ones(5)
    leaves = quality._tree(g, h)
    assert leaves[0] == leaves[1] == 2 / 3 and leaves[2] == leaves[3] == -4 / 3


def test_commonest_values_are_counted(spark):
    rows = spark.createDataFrame([(v,) for v in ["a"] * 3 + ["b"] * 5 + ["c", None, "d"]], "lang string")
    assert learning.counts_of(rows, "lang") == {"a": 3, "b": 5, "c": 1, "d": 1}
    assert learning.counts_of(rows, "lang", 3) == {"a": 3, "b": 5, "c": 1}


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """All rows are in blocks, repeated ones once, and scores don't depend on the partitioning."""
    from quorum_spark.operators.scratch import Scratch

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("kala mora tiko sela".split(), k=6)) + (" vile" if i % 2 else ""), "aa") for i in range(9000)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9000)], "doc_id long, toxic int")
    known = labels.where(learning.remainder("doc_id", 4) != 2)
    table = toxicity.blocks(docs, known.union(known), known.count(), Scratch(spark, "test"))
    b = table.selectExpr("count(*) as n", "sum(all0 + all1) as rows", "sum(all1) as ones").first()
    zeros = known.where("toxic = 0").count()
    assert b.n == 2 and b.ones == known.count() - zeros
    assert zeros // 5 <= b.rows - known.count() <= zeros // 5 + b.n
    monkeypatch.setattr(toxicity, "ROWS", 100)
    few, some = docs.where("doc_id < 400"), labels.where("doc_id < 400")
    one, many = ({r.doc_id: r.score for r in toxicity.toxicity_scores(few.repartition(k), some.repartition(k)).collect()} for k in (1, 5))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-6 for i in one)  # sums of a batch differ in the last bits
    assert all((score >= toxicity.THRESHOLD) == bool(i % 2) for i, score in one.items())


def test_sums_of_blocks_take_as_many_tasks_as_run_at_once(spark):
    """What tasks send for an epoch doesn't grow with the number of blocks, and means come as single numbers."""
    from quorum_spark.operators.scratch import Scratch

    def run(batches):
        held = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (0, 1, held * int(toxicity.UNIT))], names=["at", "n", "c"])

    rows, scratch = spark.range(0, 640, 1, 64), Scratch(spark, "test")
    tasks = spark.sparkContext.defaultParallelism
    sums = toxicity._summed(rows, run, ["at"], ["n", "c"], scratch)
    assert sums["n"].to_pylist() == [tasks] and sums["c"].to_pylist() == [640 * int(toxicity.UNIT)]
    means = toxicity._summed(rows, run, ["at"], ["n", "c"], scratch, means=True)
    assert means.column_names == ["at", "c"] and means["c"].to_pylist() == [640 / tasks]
