"""Near-duplicates and repeats against brute force, with nulls, empty and long texts, ties, copies and clashing columns."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from quorum_spark.llm import decontam, embedding, minhash, substring
from quorum_spark.operators.scratch import Scratch

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def fixture_texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t ", "one", "One two", "one TWO three four", "one two three four five"]
    line = " ".join(rng.choices(vocabulary, k=25))
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 120, 300]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append("  ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
        texts.append(line + "\n" + " ".join(rng.choices(vocabulary, k=60)))
    big = " ".join(rng.choices(vocabulary, k=20000))
    return texts + [big, big, big + " x", "é ü " * 9, "a b c d e f g h i j k l m a b c d e f g h i j k l m"]


def near_copies_of_one(n):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(200)]
    out = []
    for i in range(n):
        own = list(base)
        own[rng.randrange(200)] = f"own{i}"
        out.append(" ".join(own))
    return out


def brute_near(rows):
    sets = []
    for _, text in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                comp[y] = x
    return {(i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets)}


def brute_repeats(rows):
    """How often each result row is due."""
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = Counter()
    for i, text in rows:
        w = words(text)
        gone = {k + d for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for d in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    texts = fixture_texts() + near_copies_of_one(40)
    ids = list(range(100, 100 + len(texts)))
    random.Random(1).shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in rows], "doc_id long, text string, rep string, n int, value int, set_key string")


def test_near_duplicates(spark, rows):
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute_near(rows)


def test_near_duplicates_of_repeated_and_null_rows(spark):
    text = "a b c d e f g"
    got = minhash.near_duplicates(frame(spark, [(5, text), (5, text), (None, text), (7, text), (8, None)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True)]


def test_substring(spark, rows):
    assert Counter(tuple(r) for r in substring.substring_dedup(frame(spark, rows)).collect()) == brute_repeats(rows)


def test_substring_of_repeated_ids_with_different_words(spark):
    rng = random.Random(9)
    a = " ".join(rng.choices([f"w{i}" for i in range(300)], k=60))
    rows = [(1, a), (2, "zz " * 30 + a), (2, "x " * 14), (2, "short text here"), (2, a), (2, a), (3, "x " * 14 + "y"), (3, a + " " + a), (None, a), (None, None)]
    got = substring.substring_dedup(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(rows)


def test_substring_in_many_packs(spark, rows, monkeypatch):
    """Small packs and many buckets give the same rows as one of each."""
    monkeypatch.setattr(substring, "PACK", 3000)
    monkeypatch.setattr(substring, "BUCKET", 5000)
    hot = " ".join(f"hot{i}" for i in range(30))
    more = rows + [(5000 - i, f"own{i} {hot} end{i}") for i in range(200)] + [(9000 + i, hot) for i in range(100)]
    assert Counter(tuple(r) for r in substring.substring_dedup(frame(spark, more)).collect()) == brute_repeats(more)


@pytest.mark.parametrize("f", [minhash.near_duplicates, substring.substring_dedup])
def test_empty_table(spark, f):
    assert f(frame(spark, [])).collect() == []


def brute_vectors(rows):
    """How often each result row is due. rows: vec_id, embedding, label."""

    def ok(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links, near = Counter(), {i: set() for i, *_ in rows}
    for k, (i, a, x) in enumerate(rows):
        for m, (j, b, y) in enumerate(rows):
            if k != m and None not in (i, j, x) and x == y and ok(a) and ok(b) and len(a) == len(b):
                v, w = np.array(a), np.array(b)
                if v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                    links[i] += 1
                    near[i].add(j)
    comp = {None: None}
    for i in sorted(x for x in near if x is not None):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += near[x]
    return Counter((i, links[i], comp[i], comp[i] == i) for i, *_ in rows)


@pytest.mark.parametrize("block", [1024, 5])
def test_embeddings(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + (rng.standard_normal(16) * 0.12 if i > 90 else 0)).tolist(), i % 3 if i % 7 else None, "z") for i in range(260)]
    rows += [(900, None, 1, "z"), (901, [0.0] * 16, 1, "z"), (902, [1.0, None], 1, "z"), (903, [float("nan"), 1.0], 1, "z"), (904, [1.0, 2.0], 1, "z"), (905, [2.0, 4.0], 1, "z"), (906, [], 1, "z"), (907, [float("inf"), 1.0], 1, "z")]
    got = embedding.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string"), block).collect()
    assert Counter(tuple(r) for r in got) == brute_vectors([r[:3] for r in rows])
    assert embedding.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).collect() == []


def test_embeddings_of_repeated_ids(spark):
    rng = np.random.default_rng(4)
    v, w, x = (rng.standard_normal(16) for _ in range(3))
    near = lambda a: (a + rng.standard_normal(16) * 0.01).tolist()
    rows = [(1, v.tolist(), 0), (2, near(v), 0), (1, v.tolist(), 1), (3, near(v), 1)]
    got = {tuple(r) for r in embedding.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {(1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False)}
    rows += [(7, w.tolist(), 0), (7, w.tolist(), 0), (8, near(w), 0), (7, x.tolist(), 0), (9, near(x), 0), (7, None, 0), (4, near(x), None), (None, v.tolist(), 0), (None, None, None)]
    got = embedding.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 2).collect()
    assert Counter(tuple(r) for r in got) == brute_vectors(rows)


def test_blocks_of_long_lists_find_every_component(spark, monkeypatch):
    """Sets around the threshold, in two lists of several blocks, give the components of all pairs' exact similarities."""
    monkeypatch.setattr(minhash, "BLOCK", 4000)
    rng = np.random.default_rng(5)
    bases = [rng.choice(1 << 40, 320, replace=False) for _ in range(3)]
    sets = []
    for i in range(60):
        base = bases[i % 3]
        kept = base[rng.random(len(base)) < rng.uniform(0.78, 0.95)]
        sets.append(np.unique(np.concatenate([kept, rng.choice(1 << 40, 15)])).astype(np.int64))
    rows = [(v, i, len(s), i, 60, sum(map(len, sets)), 7) for v in (11, 22) for i, s in enumerate(sets)]
    mixed = spark.createDataFrame(rows, "value long, rep long, n long, c long, size long, values long, main long")
    full = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "rep long, shingles binary")
    found = [tuple(r) for r in minhash._in_blocks(mixed, full, Scratch(spark, "test")).collect()]

    def similar(a, b):
        common = len(np.intersect1d(sets[a], sets[b]))
        return 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common)

    def roots(pairs):
        top = list(range(60))
        for a, b in pairs:
            x, y = sorted((top[a], top[b]))
            top = [x if t == y else t for t in top]
        return top

    assert all(similar(a, b) for a, b in found)
    exact = [(a, b) for a in range(60) for b in range(a) if similar(a, b)]
    assert 60 < len(exact) < 590 and 1 < len(set(roots(exact))) < 60
    assert roots(found) == roots(exact)
    assert len(found) < len(exact)


def test_recall_at_the_threshold_and_the_exact_way(spark):
    """Planted pairs of large sets with a similarity of 0.75 to 0.77: nearly all are found, and all when sketches hold whole sets."""
    rng = random.Random(17)
    rows, pairs = [], 0
    for p in range(400):
        n = rng.randint(150, 900)
        a = [f"p{p}w{i}" for i in range(n)]
        left = n - 4 - round((n - 4) * 2 * 0.757 / 1.757)  # shingles that the copy lacks
        cut = [f"p{p}x{i}" if i >= n - left else w for i, w in enumerate(a)]
        both = len(set(zip(*(a[i:] for i in range(5)))) & set(zip(*(cut[i:] for i in range(5)))))
        if 0.75 <= both / (2 * (n - 4) - both) <= 0.77:
            pairs += 1
            rows += [(2 * p, " ".join(a)), (2 * p + 1, " ".join(cut))]
    assert pairs > 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs).where("component_id <> doc_id").count()
    assert found >= 0.99 * pairs
    assert minhash.near_duplicates(docs, retained=1000).where("component_id <> doc_id").count() == pairs


def thue_morse(n):
    """Two words of 2 ** n letters that polynomials modulo 2 ** 64 don't tell apart."""
    bits = [0]
    for _ in range(n):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomials_confuse(spark):
    x, y = thue_morse(11)
    lead = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*lead, x])), (2, " ".join([*lead, y]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring.substring_dedup(docs).collect())) == brute_repeats(rows)
    ends = [(k, " ".join(["a b c d", w])) for k, w in enumerate((x, y))]
    got = minhash.near_duplicates(spark.createDataFrame(ends, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_near(ends)
    item = spark.createDataFrame([(5, " ".join(["a b c d", x, "e f g h"]))], "item_id long, text string")
    texts = spark.createDataFrame([(1, " ".join(["a b c d", y, "e f g h"])), (2, " ".join(["a b c d", x, "e f g h"]))], "doc_id long, text string")
    assert {r.doc_id for r in decontam.find_leaks(texts, item).collect()} == {2}


def test_repeated_ids_of_different_texts(spark):
    """Each row is judged by its own set; its component is the smallest id that it reaches."""
    w = [f"v{i}" for i in range(200)]
    a, b = " ".join(w[:100]), " ".join(w[100:])
    v = " ".join(w[:95] + w[195:200])
    rows = [(1, a), (2, a), (2, b), (3, v), (7, b), (2, b), (9, None), (9, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter([(1, 96, 1, True), (2, 96, 1, False), (2, 96, 2, True), (3, 96, 1, False), (7, 96, 2, False), (2, 96, 2, True), (9, 0, 9, True), (9, 96, 1, False)])
    assert Counter(map(tuple, got.collect())) == want


def test_recall_in_long_lists(spark):
    """Pairs of a similarity of 0.75 to 0.80 whose passages very many other documents share: nearly all are found, and nothing else is linked."""
    rng = random.Random(23)
    rows = []
    for family in range(5):
        pool = [[f"f{family}p{p}w{i}" for i in range(60)] for p in range(11)]
        for k in range(45):
            own = rng.sample(pool, 6)
            a = [w for passage in own for w in passage] + [f"f{family}d{k}w{i}" for i in range(20)]
            cut = list(a)
            for i in range(len(a) - 34, len(a) - 34 + rng.randint(12, 34)):
                cut[i] = f"f{family}d{k}x{i}"
            for at in rng.sample(range(len(a) - 40), 2):
                cut[at] = f"f{family}d{k}y{at}"
            rows += [(1000 * family + 2 * k, " ".join(a)), (1000 * family + 2 * k + 1, " ".join(cut))]
    sets = {i: set(zip(*(t.split()[j:] for j in range(5)))) for i, t in rows}
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    planted = [i for i in sets if i % 2 == 0 and 0.75 <= alike(i, i + 1) <= 0.80]
    assert len(planted) > 60
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for i, _, c, _ in brute_near(rows)}
    assert sum(got[i] == got[i + 1] for i in planted) >= 0.99 * len(planted)
    assert sum(got[i] != want[i] for i in got) <= 0.01 * len(got)
