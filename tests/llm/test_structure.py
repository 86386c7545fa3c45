"""Conversation repair, URL filters and spelling variants against brute force, with nulls, ties, repeats, long rows, empty tables and clashing columns."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import product

import pytest
from pyspark.sql import functions as F

from quorum_spark.llm import conversation, spelling, urls
from quorum_spark.operators.scratch import Scratch

GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute_edits(rows):
    """Least (cost, initials, repaired lines) of all ways to edit a few rows (role, text, fault)."""
    best = None
    options = []
    for role, text, fault in rows:
        own = [(3, "D", None)]
        if fault in (0, 3):
            own += [(fault // 3, "K", (role, text)), (2 + fault // 3, "R", ("user", text)), (2 + fault // 3, "R", ("assistant", text))]
        options.append(own)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for gaps in product(inserts, repeat=len(rows) + 1):
        for ways in product(*options):
            cost, edits, out = 0, "", []
            for k, gap in enumerate(gaps):
                cost, edits, out = cost + 2 * len(gap), edits + "I" * len(gap), out + [(r, "") for r in gap]
                if k < len(ways):
                    c, e, m = ways[k]
                    cost, edits, out = cost + c, edits + e, out + ([m] if m else [])
            if all(r for r, _ in out) and GRAMMAR.fullmatch("".join(r[0] for r, _ in out)):
                best = min(best or (cost, edits, out), (cost, edits, out), key=lambda x: x[:2])
    return best


def brute_report(originals, rows):
    out = {}
    for conv in {r[0] for r in originals}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, found = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            found.append((role, text, fault))
        turns = {r[0] for r in own} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, edits, lines = brute_edits(found) if own else (0, "", [])
        n = Counter(f for *_, f in found)
        digest = sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n[1], n[2], n[3], illegal, cost, edits, digest)
    return out


def conversations():
    rng = random.Random(1)
    roles, texts = ["system", "user", "assistant", "tool", "u", "", None], ["Yes.", "No", "what? ", "Yes.", " \n", "", None, "long " * 3000 + "!"]
    rows = []
    for conv in [None, *range(60)]:
        for k in range(rng.choice([0, 1, 2, 3, 3, 4])):
            rows.append((conv, rng.choice([k, k, 0, None]), rng.choice(roles), rng.choice(texts)))
    return rows + [(60, 0, "system", "A.")] + [(61, 5, "user", "A."), (61, 9, "assistant", "B.")]


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def as_dict(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_repair_against_all_edits(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, edit string")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert as_dict(conversation.report(table, table)) == brute_report(plain, plain)


def test_damage(spark):
    rows = conversations() * 2 + [(k, k % 7, "assistant", f"a.b!{k}?") for k in range(200)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            want += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    assert Counter(map(tuple, conversation.damage(table).collect())) == Counter(want)


def test_long_conversation_in_blocks(spark, monkeypatch):
    """A conversation of many blocks, and many rows of one turn, have the result of one pass."""
    rng = random.Random(2)
    rows = [(1, k // 2 if k < 900 else None, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice([f"t{k}.", f"t{k}", "same.", ""])) for k in range(1500)]
    rows += [(2, 0, "user", "x.")] * 500 + [(c, k, ["user", "assistant"][k % 2], f"{k}.") for c in range(3, 40) for k in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = as_dict(conversation.report(table, table))
    monkeypatch.setattr(conversation, "BLOCK_BITS", 5)
    assert as_dict(conversation.report(table, table)) == whole
    own = sorted((r[1:] for r in rows if r[0] == 1), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, initials, found = set(), "", []
    for _, role, text in own:
        found.append(1 if not text else 2 if (role, text) in seen else 0 if text.endswith(".") else 3)
        seen.add((role, text))
        initials += role[0] if role[0] in "sua" else "-"
    last = conversation.viterbi(conversation._closed({0: (0, "")}), initials, found)
    assert whole[1][5:7] == min(last[s] for s in (0, 3) if s in last)
    assert whole[2] == (0, 0, 499, 0, 499, 2 + 3 * 499, "K" + "D" * 499 + "I", sha256(b"user:x.\nassistant:").hexdigest())
    out = conversation.repair(table).orderBy("conv_id", "at", "k").collect()
    for conv in (1, 2, 3):
        assert GRAMMAR.fullmatch("".join(r.role[0] for r in out if r.conv_id == conv))
    assert [r.role for r in out if r.conv_id == 3] == ["user", "assistant"] * 3


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.report(empty, empty).count() == 0
    assert conversation.repair(empty).count() == 0
    gone = spark.createDataFrame([(7, 1, "user", "a.")], empty.schema)
    assert as_dict(conversation.report(gone, empty)) == {7: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_filters(spark):
    some = [
        None, "", "x", "http://", "https://Example.NET/en/1", "https://example.net/en", "ftp://a.net", "http://b.net/", "http://bnet/", "http://m.example.com/de/?a=1", "http://example.com/de", "http://notexample.com/de/x",
        "http://z.org/fr/1#a", "http://z.org?x=/fr/", "http://z.org/FR/1", "a://b://c.net/", "http://ÉA.com/é", "http://listed.com/p/?b=2&a=1#x", "https://WWW.listed.com:443/p.html?a=1&utm_source=q&b=2", "http://listed.com/p?a=1",
        "http://listed.com/other", "http://listed.net/p", "http://h.com/" + "x" * 100000, "http://listed.com/p?b=2&a=1\n",
    ]
    pages = spark.createDataFrame([(None if k == 3 else k % 30, u, "h", "r") for k, u in enumerate(some + ["http://hot.com/p"] * 500)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("http://listed.com/p?a=1&b=2",), (None,), ("http://hot.com/p/",), ("http://listed.com/p?a=1&b=2",), ("nothing",)], "url string")
    blocked = {some[17], some[18], "http://hot.com/p"}
    want = Counter()
    for r in pages.collect():
        host, path, rule, verdict = brute_rule(r.url)
        want[r.page_id, host, path, rule, verdict or ("block" if r.url in blocked else "allow")] += 1
    assert Counter(map(tuple, urls.judge(pages, listed).collect())) == want
    assert Counter(map(tuple, urls.judge(pages, listed, most_blocks=1).collect())) == want
    none = urls.judge(pages, listed.limit(0), rules=())
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
    assert urls.judge(pages.limit(0), listed).count() == 0


def test_bloom_passes_all_listed_and_few_others(spark):
    forms = spark.range(5000).select(F.concat(F.lit("h.com/"), "id").alias("form"))
    blocks = 5000 * urls.BITS // 256
    asked = spark.range(20000).select("id", F.concat(F.lit("h.com/"), "id").alias("form"))
    rows = asked.withColumn("block", urls._block("form", blocks)).join(urls.bloom(forms, blocks), "block", "left")
    passing = F.lit(True)
    for k, bits in enumerate(urls._asked("form")):
        passing &= F.coalesce(F.col(f"w{k}"), F.lit(0)).bitwiseAND(bits) == bits
    hits = [r.id for r in rows.where(passing).select("id").collect()]
    assert sum(i < 5000 for i in hits) == 5000 and sum(i >= 5000 for i in hits) < 300


def apart(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_variants(counts):
    near = {w: [v for v in counts if apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return out


def some_words(alphabet, size, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(1, longest))) for _ in range(size)]


@pytest.mark.parametrize(("most", "nodes"), [(spelling.SUBTREE, spelling.NODES), (6, 1 << 19), (1 << 14, 20)])
def test_variants(spark, most, nodes):
    rng = random.Random(4)
    words = set(some_words("ab", 120, 9, 1)) | set(some_words("aéz", 150, 7, 2)) | {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499} | {f"same{c}{e}" for c in "abcdefgh" for e in "uvw"}
    counts = {w: rng.choice([1, 2, 3, 5, 9, 17, 40, 90]) for w in words}
    table = spark.createDataFrame([(w, n, 0, "f") for w, n in counts.items()], "word string, n int, m int, form string")
    got = spelling.variants(table, most=most, nodes=nodes).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(got) == len(counts) and set(map(tuple, got)) == brute_variants(counts)


def test_subtrees_stay_small(spark):
    """Whatever the words share, parts have few words, or two open code points at most."""
    words = spark.range(3000).select(F.concat(F.lit("common"), F.translate(F.lpad(F.col("id").cast("string"), 5, "0"), "0123456789", "abcdefghij"), F.lit("shared")).alias("word"), F.lit(1).alias("n"))
    parts = spelling.subtrees(words, Scratch(spark, "test"), most=50).groupBy(*spelling.KEY).count().collect()
    assert max(r["count"] for r in parts if r.m - len(r.pre) - len(r.suf) > 1) <= 50
    assert max(r["count"] for r in parts) <= 121


def test_vocabulary(spark):
    rng = random.Random(6)
    base = ["Straße", "ÉCOLE", "naïve", "colour", "color", "four", "fifth", "x÷y×zz", "abc1defgh"]
    texts = [" ".join(rng.choices(base, k=rng.choice([3, 40]))) for _ in range(300)] + [None, "", "a" * 50000 + " " + "a" * 50000, "\n".join(base * 50)]
    rows = [(None if k == 5 else k // 2, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {(w, n) for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert set(map(tuple, spelling.vocabulary(docs, damage=97).collect())) == want
    assert spelling.variants(spelling.vocabulary(docs.limit(0))).count() == 0
