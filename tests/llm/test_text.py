"""PII, BPE, decontamination and chat against brute force; classifiers on texts at the edges."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quorum_spark.llm import bpe, chat, decontam, language, pii, quality, toxicity
from quorum_spark.operators.scratch import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGES = [None, "", " ", "\n", "x", "😀 " * 50, "a" * 5000, "word " * 20000, "\x00\x01\x02﻿", "1.2.3.4"]


def brute_spans(text):
    text = text or ""
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    out = [(m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m[0])]
    return sorted(out)


def pii_texts():
    rng = random.Random(4)
    some = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "1.2.3.4", "001.02.3.255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+1 2", "@", "..", "é", "😀", "1234567", "+", "DE89 3704 0044 0532 0130 00", "iban", "token", "0123456789abcdef" * 2, "\x01", "\x02", "-", "%", "a.b.c@d-e.f.g.h", "1.2.3.4.5.6.7.8", "79927398713000"]
    return EDGES + ["".join(rng.choice(some) + rng.choice(["", " ", ".", "\n", ","]) for _ in range(rng.choice([3, 10, 60]))) for _ in range(300)] + ["a.a@b" + ".c" * 20000, "9" * 30000, "x" * 30000 + "@", "a@b.cd " * 500]


def test_pii(spark):
    texts = pii_texts()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.report(docs).collect():
        want = brute_spans(texts[r.doc_id])
        text = ",".join(f"{n}:{s}:{e}" for s, _, e, n in want)
        base = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE)
        assert base == text, texts[r.doc_id][:200]
        assert r.base_sha256 == sha256(text.encode()).hexdigest()
        counts = Counter(n for *_, n in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.BASE)


def test_pii_adds_checked_kinds_and_redacts(spark):
    docs = spark.createDataFrame([(1, "iban DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00, mail a@b.cd!", 9), (2, None, 0)], "doc_id long, text string, n_chars long")
    assert pii.report(docs).first().spans.startswith("iban:5:32")
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[1].text == "iban <IBAN> and DE88 3704 0044 0532 0130 00, mail <EMAIL>!"
    assert rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None


IBANS = [
    ("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "<IBAN> BIC COBADEFFXXX"),
    ("GB29 NWBK 6016 1331 9268 19 EUR 500", "<IBAN> EUR 500"),
    ("DE89370400440532013000 A note", "<IBAN> A note"),
    ("DE89 3704 0044 0532 0130 00 12 May", "<IBAN> 12 May"),
    ("é😀 DE89 3704 0044 0532 0130 00 GB29NWBK60161331926819 NO93 8601 1117 947.", "é😀 <IBAN> <IBAN> <IBAN>."),
    ("AT12 DE89 3704 0044 0532 0130 00 AB12 DE89 3704 0044 0532 0130 00 X", "AT12 <IBAN> AB12 <IBAN> X"),
    ("DE89370400440532013000X DE88370400440532013000 A", "DE89370400440532013000X DE88370400440532013000 A"),
]


def test_pii_account_numbers_before_capitals_and_digits(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(IBANS)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == dict(enumerate(want for _, want in IBANS))
    assert pii.report(docs).where("doc_id = 1").first().spans == "iban:0:27"


def test_pii_of_a_hundred_thousand_spans(spark):
    """Time follows the spans and the text, in the report and in redaction; a mark of byte order is a letter like others."""
    n = 34_000
    text = " é😀 ".join(["a1@b.cd 1.2.3.4 DE89370400440532013000\ufeff"] * n)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.report(docs).first()
    assert (r.n_email, r.n_ip, r.spans.count("iban:"), r.spans.count(",")) == (n, n, n, 3 * n - 1)
    assert r.spans.endswith(f"iban:{len(text) - 23}:{len(text) - 1}")
    assert pii.redact(docs).first().text == " é😀 ".join(["<EMAIL> <IP> <IBAN>\ufeff"] * n)


def bpe_texts():
    rng = random.Random(8)
    some = ["the", "Hello", "don't", "WE'LL", "x²½Ⅷ", "Σίσυφος ΣΑΣ", "İstanbul", "日本語", "😀", "!!!", "<|endoftext|>", "<|startoftext|>", "<|", "é", "\x1c", "\x85", " ", "﻿", "ß", "Ａ", "123", "'s", "''", "ǅ", "zxqvbn", "ÉCOLE", "naïve", "ſ"]
    return [*EDGES, *("".join(rng.choice(some) + rng.choice(["", " ", "\n"]) for _ in range(30)) for _ in range(300))]


def test_bpe_equals_the_library(spark):
    texts = bpe_texts()
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, digest=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest(), t
        assert got[i].decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), t
    assert bpe.encode(docs.limit(0), PATH).collect() == []
    whole = bpe.encode(docs, PATH)
    assert {r.doc_id: r.ids for r in whole.collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    text = {r.doc_id: r.decoded for r in bpe.decode(whole.withColumn("decoded", F.lit(1)), PATH).collect()}
    assert text == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(texts)}


def test_bpe_decodes_null_lists_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [320, None, 10**8, -1, 320]), (2, None), (3, []), (4, [None])], "doc_id long, ids array<int>")
    token = bpe.Vocabulary(open(PATH).read()).tokens[320]
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, PATH).collect()} == {1: f"{token} {token}", 2: "", 3: "", 4: ""}
    assert [r.decoded for r in bpe.decode(rows.select("ids").where("doc_id = 2"), PATH).collect()] == [""]


def test_bpe_lexicon_is_bounded(spark, monkeypatch):
    """Words that would not fit are left out, and results don't change."""
    docs = spark.createDataFrame([(i, "aa bb cc dd " * (i % 3) + "ee " * i) for i in range(20)], "doc_id long, text string")
    whole = {tuple(r) for r in bpe.encode(docs, PATH, digest=True).collect()}
    content = spark.sparkContext.broadcast(open(PATH).read())
    for most, words in ((3, [b"ee"]), (5, [b"aa", b"bb", b"cc", b"dd", b"ee"]), (0, [])):
        monkeypatch.setattr(bpe, "LEXICON", most)
        machine = bpe.Transducer(bpe.lexicon(docs, content, Scratch(spark, "test")))
        held = [x is not None for x in machine.look_up([b"aa", b"bb", b"cc", b"dd", b"ee", b"zz"])]
        assert [w for w, ok in zip([b"aa", b"bb", b"cc", b"dd", b"ee", b"zz"], held) if ok] == words
        assert {tuple(r) for r in bpe.encode(docs, PATH, digest=True).collect()} == whole


def test_bpe_merges_very_long_words():
    rng = random.Random(3)
    library, vocabulary = Tokenizer.from_file(PATH), bpe.Vocabulary(open(PATH).read())
    words = ["a" * 300_000, "".join(rng.choices("etaoinshr", k=200_000)), "the" * 50_000, "!" * 1000, *("".join(rng.choices("abcé", k=k)) for k in (255, 256, 257, 3000))]
    for w in words:
        assert [i for x in vocabulary.words(w) for i in vocabulary.merge(x)] == library.encode(w, add_special_tokens=False).ids


def test_transducer_holds_its_words_and_no_others():
    rng = random.Random(1)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 6))).encode() for _ in range(300)}
    entries = {w: [i, i + 1] for i, w in enumerate(sorted(words))}
    machine = bpe.Transducer(bpe.compile_lexicon(entries))
    others = [b"", b"zz", *(w + b"a" for w in words)]
    assert machine.look_up(sorted(words)) == [entries[w] for w in sorted(words)]
    assert machine.look_up(others) == [entries.get(w) for w in others]
    assert bpe.Transducer(bpe.compile_lexicon({})).look_up([b"a"]) == [None]


def brute_leaks(docs, items):
    def of(text):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    out = {}
    for d, text in docs:
        w = of(text)
        for i, item in items:
            t = of(item)
            if not t or not w:
                continue
            best = 0
            for k in range(max(1, len(w) - len(t) + 1)):
                own = w[k : k + len(t)]
                if len(t) < 5 and len(own) < len(t):
                    continue
                if len(own) < 5 <= len(t):
                    continue
                a, b = bag(own), bag(t)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.75:
                out[d, i] = round(best, 9)
    return out


def test_decontamination(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([1, 3, 5, 6, 12, 20, 33, 33, 60])] + [(50, None), (51, ""), (52, "Zz yy")]
    docs = list(enumerate(EDGES))
    for _ in range(60):
        w = rng.choices(vocabulary, k=rng.choice([4, 30, 200]))
        i, item = rng.choice(items)
        t = (item or "").split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            if t:
                t[rng.randrange(len(t))] = "changed"
        docs.append((len(docs), " ".join(w[:10] + t + w[10:]).upper()))
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == brute_leaks(docs, items)
    blocks = decontam.find_leaks(frame, bench, block_bytes=300).collect()
    assert Counter(tuple(r) for r in blocks) == Counter(tuple(r) for r in got)
    assert decontam.find_leaks(frame.limit(0), bench, block_bytes=300).collect() == []
    assert decontam.find_leaks(frame.limit(0), bench).collect() == []
    assert decontam.find_leaks(frame, bench.limit(0)).collect() == []


def test_decontamination_of_a_million_words(spark):
    """Windows of a long text are found in slices, also those across slices, and sums of votes equal plain ones."""
    rng = np.random.default_rng(3)
    sh = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    starts = np.array([0, 5, 4090, 4096, 8000, 19_000])
    want = [decontam.votes(sh[s : s + 1000]).sum(0) for s in starts]
    assert (decontam.window_sums(sh, starts, 1000) == want).all()
    item = [f"q{i}" for i in range(40)]
    w = [f"w{x}" for x in rng.integers(0, 5000, 1_000_000)]
    for at in (10, decontam.SLICE - 3, 700_000):
        w[at : at + 40] = item
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(item * 25_000))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.start_word, r.similarity) for r in decontam.find_leaks(docs, bench).collect()) == [(1, 7, 10, 1.0), (2, 7, 0, 1.0)]


def test_rotation(spark):
    rows = [(1, 0, "system", "s", 0), (1, 1, "ann", "hi 😀", 0), (1, 2, "bob", None, 0), (1, 3, "ann", "x", 0), (1, 3, "ann", "x", 0), (2, None, None, "q", 0), (None, 1, "ann", "z", 0), (3, 0, "system", "only", 0)]
    got = {(r.conv_id, r.speaker): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, speaker int")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob")}
    ann = got[1, "ann"]
    assert ann.rendered == "<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\nhi 😀<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n" + "<|im_start|>assistant\nx<|im_end|>\n" * 2
    assert [ann.rendered[int(a) : int(b)] for a, b in (x.split(":") for x in ann.mask.split(","))] == ["hi 😀", "x", "x"]
    assert (ann.n_messages, ann.n_trained, got[1, "bob"].n_trained) == (5, 3, 1)


def test_parts_of_a_view_are_the_whole_view(spark):
    rows = [(1, t, ("ann", "bob", "system")[t % 3], f"m{t}") for t in range(150)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.speaker: r for r in chat.rotate(docs, part=None).collect()}
    for speaker, view in whole.items():
        parts = sorted((r for r in chat.rotate(docs, part=20).collect() if r.speaker == speaker), key=lambda r: r.part)
        assert len(parts) == 8 and "".join(r.rendered for r in parts) == view.rendered
        own = [r.rendered[int(a) : int(b)] for r in parts for a, b in (x.split(":") for x in r.mask.split(","))]
        assert own == [view.rendered[int(a) : int(b)] for a, b in (x.split(":") for x in view.mask.split(","))] == [f"m{t}" for t in range(150) if ("ann", "bob", "system")[t % 3] == speaker]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        lang = "aa" if i % 3 else "bb"
        w = rng.choices(["kala", "mora", "tiko", "sela"] if lang == "aa" else ["grunz", "stroff", "plick", "drosch"], k=40)
        toxic = int(i % 5 == 0)
        if toxic:
            w[rng.randrange(40)] = "vile"
        good = int(i % 4 > 0)
        rows.append((i, " ".join(w) if good else "%%% ".join(w), lang, "s", 1))
        labels.append((i, good, toxic))
    rows += [(1000 + k, t, None, None, None) for k, t in enumerate(EDGES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, corpus, module, column):
    docs, labels = corpus
    got = module.classify(docs, labels).collect()
    truth = {r.doc_id: r[column] for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    assert module.classify(docs.limit(0), labels).collect() == []
    assert {r.score for r in module.classify(docs, labels.limit(0)).collect()} == {0.0}


def test_language(spark, corpus):
    docs, _ = corpus
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got.values() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 0
    assert [got[1000 + k].lang_pred == "und" for k in range(len(EDGES))] == [not any(c.isalpha() for c in t or "") for t in EDGES]
    assert all(r.score == 0 for r in got.values() if r.lang_pred == "und")
    assert language.identify(docs.limit(0)).collect() == []
    nothing = language.identify(docs.withColumn("lang", docs.lang.substr(9, 0)).where("doc_id < 0")).collect()
    assert nothing == []


def test_pipeline_stages(spark, corpus, tmp_path):
    docs, labels = corpus
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "word word word word word word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1007 not in got  # holds the benchmark item
    assert 1000 in got and 1000 + 9 in got
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(toxic & set(got)) <= 0.1 * len(toxic)
    library = Tokenizer.from_file(PATH)
    assert got[1009].ids == library.encode("<IP>", add_special_tokens=False).ids


def test_stages_keep_rows_without_id_and_one_of_repeated_ids(spark, tmp_path):
    rng = random.Random(2)
    a, b, c, d = (" ".join(rng.choices("kala mora tiko sela grunz stroff plick drosch".split(), k=40)) for _ in range(4))
    item = "one two three four five six seven eight"
    rows = [(None, a), (7, a), (7, a), (5, b), (None, c), (3, None), (3, None), (3, ""), (None, None), (None, ""), (9, c + " x"), (8, d), (8, b)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted((str(i), str(t)) for i, t in [(7, a), (5, b), (9, c + " x"), (3, None), (3, ""), (None, None), (None, ""), (8, d)])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{a} {item} {b}"), (None, a), (4, item), (4, b), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()))) == sorted(map(str, [(None, a), (4, b), (6, None)]))


def test_pipeline_of_odd_columns_and_of_nothing(spark, corpus, tmp_path):
    """Nulls in every column, columns that stages make themselves, very long and empty texts; and an empty table."""
    names = ["score", "kept", "component_id", "n_shingles", "item_id", "ids", "decoded", "n_tokens", "_row_key", "rep", "value"]
    make = ", ".join(f"cast(doc_id as string) as {n}" for n in names)
    docs = corpus[0].selectExpr("doc_id", "text", "if(doc_id % 2 = 0, lang, null) as lang", "source", "cast(null as long) as n_chars", make.split(", ")[0], *make.split(", ")[1:])
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        corpus[1].write.parquet(f"{tmp_path}/{d}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    stage = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, f"{tmp_path}/a")
        assert stage.columns == docs.columns
    assert all(r._row_key == str(r.doc_id) == r.score for r in stage.collect())
    assert {1000 + k for k in range(len(EDGES))} <= {r.doc_id for r in corpus_pipeline.encode_tokens(spark, stage, "").collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_whole_views_of_many_messages_and_empty_tables(spark):
    """A view of 400 messages in one row is what its parts are together."""
    rows = [(1, k, ["user", "assistant", "bob"][k % 3], f"m{k}") for k in range(400)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.speaker: r for r in chat.rotate(table, part=None).collect()}
    parts = {}
    for r in sorted(chat.rotate(table).collect(), key=lambda r: r.part):
        parts.setdefault(r.speaker, []).append(r)
    assert set(whole) == {"user", "assistant", "bob"}
    for speaker, r in whole.items():
        assert r.rendered == "".join(p.rendered for p in parts[speaker]) and r.n_messages == 400
        own = [r.rendered[int(a) : int(b)] for a, b in (m.split(":") for m in r.mask.split(","))]
        assert own == [t for _, _, role, t in rows if role == speaker]
    assert chat.rotate(table.limit(0)).count() == 0
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(none).count() == 0 and pii.redact(none).count() == 0
