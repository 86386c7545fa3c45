"""BPE encoding and decoding with a lexicon of frequent words compiled into a minimal acyclic transducer.

Words are counted over all documents. The most frequent ones, with the ids that the merges give them, are compiled into an
automaton whose equal suffixes are shared; numbers on its edges add up to a word's rank, which leads to its ids. Which words
are frequent enough follows from a histogram of the counts, so no more than LEXICON words come to the driver. The
automaton is one array file in the shared folder that Spark hands to every executor, where it is memory-mapped. New words of
a batch walk through it together; words that it doesn't hold are merged exactly. Texts are decoded from their ids.

The results equal the tokenizers library's for a vocabulary with the normalizers NFC, white space and lower case, a split
into words, byte-level letters, and word-end suffixes. Special tokens in a text are found before anything else.

Null counts as empty text; empty texts have no tokens. Rows are answered one by one, so repeated rows, ties and extra
columns don't matter. LEXICON and MEMO bound sizes and never change a result.
"""

from __future__ import annotations

import io
import json
import re
import unicodedata
from collections import Counter
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.scratch import Scratch, arrow_rows
from quorum_spark.llm.learning import fitted
from quorum_spark.llm.words import pieces

#: Words of the lexicon, words that a worker remembers, and words that it counts before it hands on their counts.
LEXICON, MEMO, COUNTED = 1 << 16, 400_000, 250_000
#: Steps of the histogram of counts for each doubling.
STEPS = 64
#: Letters from which a word's pairs wait in a heap.
LONG = 256


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself where it is printable, else the next free one from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = count(256)
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Vocabulary:
    """A tokenizer file's words: splitting texts and merging words, as the file says."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel" or spec["decoder"]:
            raise ValueError("not a lower-case word-end BPE file")
        self.end = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.numbers = {i: str(i) for i in self.tokens}
        self.letters = byte_letters()
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # the same split in the faster module, for texts of ASCII and of Latin letters alone
        self.plain = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+", re.ASCII)
        latin = "a-zßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿā-ſ"
        self.latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{latin}]+|[0-9]|[^\\sa-z0-9{latin}]+", re.ASCII)
        self.simple = re.compile(f"[\\t-\\r -~{latin}]*")
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """Words and special tokens of a text."""
        if self.parts and "<|" in text and (some := self.parts.split(text))[1:]:
            return [w for p in some for w in ([p] if p in self.special else self.words(p))]
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.plain.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a letter's lower case doesn't depend on its place
        text = text.lower()
        return (self.latin if self.simple.fullmatch(text) else self.pattern).findall(text)

    def merge(self, word: str) -> list[int]:
        """The ids of a word, by its merges in order of rank."""
        if word in self.special:
            return [self.special[word]]
        s = [self.letters[b] for b in word.encode()]
        s[-1] += self.end
        if len(s) > LONG:
            return self._merge_long(s)
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(p, none) for p in zip(s, s[1:])]  # noqa: B905
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((s[i - 1], s[i]), none)
            if i < len(ranks):
                ranks[i] = rank((s[i], s[i + 1]), none)
        return [self.ids[t] for t in s]

    def _merge_long(self, s: list[str]) -> list[int]:
        """The same for very long words: pairs wait in a heap, so the time is n log n."""
        n, rank = len(s), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := rank((s[i], s[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue  # merged meanwhile
            s[i], s[j] = a + b, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank((s[x], s[y]))) is not None:
                    heappush(heap, (r, x, s[x], s[y]))
        return [self.ids[t] for t in s if t]


def compile_lexicon(entries: dict[bytes, list[int]]) -> np.ndarray:
    """The transducer as one array: five lengths, then edge keys, edge targets, edge numbers, final states, where each rank's ids begin, ids.

    An edge's key is 256 * state + byte, in ascending order. Its number counts the words that rank before all that go
    through it at its state. State 0 is the start.
    """
    words = sorted(entries)
    nodes: list[tuple[dict[int, int], bool]] = []
    register: dict[tuple, int] = {}

    def freeze(children: dict[int, int], final: bool) -> int:
        key = (final, *children.items())
        if key not in register:
            register[key] = len(nodes)
            nodes.append((children, final))
        return register[key]

    path: list[list] = [[{}, False]]
    last = b""
    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))  # noqa: B905
        while len(path) - 1 > same:
            children, final = path.pop()
            path[-1][0][last[len(path) - 1]] = freeze(children, final)
        path += [[{}, False] for _ in word[same:]]
        path[-1][1] = True
        last = word
    while len(path) > 1:
        children, final = path.pop()
        path[-1][0][last[len(path) - 1]] = freeze(children, final)
    start = freeze(*path[0])
    below = []
    for children, final in nodes:  # children come before their parents
        below.append(final + sum(below[c] for c in children.values()))
    number = {s: i for i, s in enumerate([start, *(s for s in range(len(nodes)) if s != start)])}
    edges = []
    for s, (children, final) in enumerate(nodes):
        before = int(final)
        for b, c in sorted(children.items()):
            edges.append((number[s] * 256 + b, number[c], before))
            before += below[c]
    edges = np.array(sorted(edges), np.int64).reshape(-1, 3)
    final = np.zeros(len(nodes), np.int64)
    final[[number[s] for s, n in enumerate(nodes) if n[1]]] = 1
    ids = [entries[w] for w in words]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    flat = np.array([i for x in ids for i in x], np.int64)
    whole = np.concatenate([[len(edges), len(final), len(begin), len(flat), 0], *edges.T, final, begin, flat])
    return whole.astype(np.int32 if whole.max() < 1 << 31 else np.int64)


class Transducer:
    def __init__(self, array: np.ndarray):
        e, s, b, f = (int(x) for x in array[:4])
        at = np.cumsum([5, e, e, e, s, b, f])
        self.keys, self.targets, self.numbers, self.final, self.begin, self.ids = (array[x:y] for x, y in zip(at[:-1], at[1:], strict=True))

    def look_up(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for those that the lexicon doesn't hold. All words walk at once."""
        if not words or not len(self.keys):
            return [None] * len(words)
        lens = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.cumsum(lens) - lens
        state, rank, alive = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), lens > 0
        for i in range(int(lens.max())):
            go = np.flatnonzero(alive & (lens > i))
            if not len(go):
                break
            key = (state[go] * 256 + text[first[go] + i]).astype(self.keys.dtype)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive[go[~ok]] = False
            state[go[ok]] = self.targets[at[ok]]
            rank[go[ok]] += self.numbers[at[ok]]
        alive &= self.final[state] == 1
        return [self.ids[self.begin[r] : self.begin[r + 1]].tolist() if ok else None for r, ok in zip(rank, alive, strict=True)]


_OPEN: dict[str, "Encoder"] = {}


class Encoder:
    """A vocabulary, its transducer, and what a worker remembers of words: their ids, joined by one space."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        self.vocabulary, self.transducer = vocabulary, transducer
        self.ids: dict[str, str] = {}

    @staticmethod
    def of(content: str, name: str) -> Encoder:
        if name not in _OPEN:
            _OPEN.clear()
            _OPEN[name] = Encoder(Vocabulary(content), Transducer(np.load(SparkFiles.get(name), mmap_mode="r")))
        return _OPEN[name]

    def learn(self, new: list[str]) -> None:
        text = self.vocabulary.numbers
        for w, ids in zip(new, self.transducer.look_up([w.encode() for w in new]), strict=True):
            if ids is None or w in self.vocabulary.special:
                ids = self.vocabulary.merge(w)
            self.ids[w] = " ".join([text[i] for i in ids])

    def encode(self, texts: list[str | None]) -> list[str]:
        """For each text its ids, joined by one space."""
        split = [self.vocabulary.words(text or "") for text in texts]
        new = set().union(*split).difference(self.ids)
        if len(self.ids) + len(new) > MEMO:
            self.ids.clear()
            new = set().union(*split)
        self.learn(list(new))
        return [" ".join([self.ids[w] for w in words]) for words in split]


class Decoder:
    """Ids to text: their tokens, joined by one space. Ids that the vocabulary lacks and null ones are left out."""

    def __init__(self, vocabulary: Vocabulary):
        names = [vocabulary.tokens.get(i) for i in range(max(vocabulary.tokens) + 1)]
        self.tokens = pa.array(names, pa.large_string())

    def decode(self, ids: pa.Array, offsets: np.ndarray) -> pa.Array:
        """The text of each list. ids: those of all lists; offsets: where each list begins, and the end."""
        ids = pc.if_else(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(self.tokens))), ids, None)
        tokens = self.tokens.take(ids)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), tokens)
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())) if not tokens.null_count else self._known(tokens, offsets)

    def _known(self, tokens: pa.Array, offsets: np.ndarray) -> pa.Array:
        some = np.asarray(tokens.is_valid())
        left = np.concatenate([[0], np.cumsum(some)])[offsets]
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), tokens.drop_null()), pa.scalar(" ", pa.large_string()))


def _counts(shared):
    def run(batches):
        vocabulary, seen = Vocabulary(shared.value), Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(vocabulary.words(text.as_py() or ""))
                if len(seen) > COUNTED:
                    yield rows()
        if seen:
            yield rows()

    return run


def lexicon(docs: DataFrame, content, scratch: Scratch) -> np.ndarray:
    """The transducer of the most frequent words, LEXICON at most, compiled in one task."""
    counts = docs.select("text").mapInArrow(_counts(content), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = scratch.cut(counts.withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")), "counts")
    steps = counts.groupBy("step").count().orderBy(F.desc("step")).collect()  # some thousands at most, whatever the input
    room, least = LEXICON, None
    for r in steps:
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    array = None
    if least is not None:
        array = fitted(counts.where(F.col("step") >= least).select("word"), lambda top: _compiled(top["word"], Vocabulary(content.value)), "word")
    scratch.drop(counts)
    return compile_lexicon({}) if array is None else array


def _compiled(words, vocabulary: Vocabulary) -> np.ndarray:
    return compile_lexicon({w.encode(): vocabulary.merge(w) for w in words if w not in vocabulary.special})


def _encode(shared, name, digest):
    def run(batches):
        encoder = Encoder.of(shared.value, name)
        decoder = Decoder(encoder.vocabulary)
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            texts = encoder.encode(batch.column("text").to_pylist())
            flat, offsets = _numbers(texts)
            rest = [batch.column(k) for k in range(batch.num_columns - 1)]
            if digest:
                hexed = lambda s: sha256(s.encode()).hexdigest()
                decoded = decoder.decode(flat, offsets).to_pylist()
                cols = {"n_tokens": pa.array(np.diff(offsets), pa.int64()), "ids_sha256": pa.array([hexed(i) for i in texts], pa.string()), "decoded_sha256": pa.array([hexed(d) for d in decoded], pa.string())}
            else:
                cols = {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)}
            yield pa.RecordBatch.from_arrays([*rest, *cols.values()], names=[*batch.schema.names[:-1], *cols])

    return run


def _numbers(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The numbers of all texts, and where each text's begin."""
    counts = [t.count(" ") + 1 if t else 0 for t in texts]
    flat = np.fromstring(" ".join([t for t in texts if t]), np.int32, sep=" ") if any(counts) else np.zeros(0, np.int32)
    return pa.array(flat, pa.int32()), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _schema(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


def encode(docs: DataFrame, path: str, digest: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns in keep, with ids, or with digest: n_tokens, ids_sha256, decoded_sha256. path: of the tokenizer's file."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    content = Path(path).read_text()
    shared = spark.sparkContext.broadcast(content)
    file = io.BytesIO()
    np.save(file, lexicon(docs, shared, scratch))
    name = f"{scratch.root.rpartition('/')[2]}.npy"
    spark.sparkContext.addFile(scratch.put(file.getvalue(), name))
    rows = docs.select(*keep, F.col("text").alias("text"))
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    return rows.mapInArrow(_encode(shared, name, digest), f"{_schema(docs.select(*keep))}, {more}")


def _decode(shared, name):
    def run(batches):
        decoder = Decoder(Vocabulary(shared.value))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(name)).cast(pa.list_(pa.int32())).fill_null([])
            offsets = lists.offsets.to_numpy().astype(np.int64)
            text = decoder.decode(lists.values[offsets[0] : offsets[-1]], offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with a column decoded: the text of each list in ids, empty for a null one. path: of the tokenizer's file."""
    arrow_rows(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(Path(path).read_text())
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decode(shared, ids), f"{_schema(rows)}, decoded string")
