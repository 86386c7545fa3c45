"""Exact repeats of 13 or more words across documents, found by fixed-block anchors.

Rows are dealt to packs of about PACK bytes of text. Every document's non-overlapping seven-word blocks form the index; each
of its rolling seven-word windows is a probe. Any 13 consecutive words hold one whole block of the document they start in,
wherever the blocks lie, so a repeated 13-word window always has a probe that hits a block. From the hits the windows around
them are extended: those that also start in a document with a smaller id are repeats, and runs of them are the maximal exact
repeats.

How it keeps to size:
- A pack sends each of its distinct hashes once, with what matters of all its documents (first whether one is a block and
  whether several hold it, then the smallest id), so what a hash costs follows the packs and not the documents that share it.
- Hashes are dealt to buckets by value, a bucket for each BUCKET bytes of text and a task for each bucket. A bucket answers
  every pack with the places, among the hashes that it sent, that matter. Texts are never expanded into rows.
- A pack's text, compressed, and its answers meet in one exchange; rows of answers come first, so a task holds one pack at a
  time, and packs are dealt to tasks by their number.

Blocks and probes are told apart by 32 bits of a hash within a bucket, which can only propose too much. Windows are decided by
128 bits: two hashes, of different halves of the 128-bit digests of their words.

Null text and text without words have no words: nothing is removed, and kept_sha256 is that of the empty text. Rows are
answered one by one, each by its own words: rows that repeat one doc_id, with equal or different words, don't remove each
other's, and rows without an id neither lose words nor make others lose any. Extra columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.scratch import Scratch, small_batches
from quorum_spark.llm.words import SECOND, Words, mix, pieces, windows

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Bytes of text in a pack (a longer text is a pack of its own) and for each bucket.
PACK, BUCKET = 4 << 20, 12 << 20
#: Packs that a task reads on average.
PACKS = 4
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
PACKED = "bytes long, rows binary"
ANSWER = "pack long, step int, bucket int, places binary"


def _packs(most: int):
    """Rows in packs of up to most bytes: size, and ids and texts as a compressed Arrow stream."""

    def run(batches):
        held, size = [], 0

        def pack():
            rows = pa.RecordBatch.from_arrays([pa.concat_arrays([x[k] for x in held]) for k in (0, 1)], names=["doc_id", "text"])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(rows)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["bytes", "rows"])

        for batch in batches:
            for part in pieces(batch, "text", most):
                texts = part.column("text").cast(pa.string())
                here = texts.nbytes
                if held and size + here > most:
                    yield pack()
                    size = 0
                held.append((part.column("doc_id").cast(pa.int64()), texts))
                size += here
        if held:
            yield pack()

    return run


class Pack:
    """A pack's words: hashes, where each text begins, and ids. lost: texts without an id."""

    def __init__(self, batch: pa.RecordBatch):
        ids = batch.column("doc_id")
        self.parts = [Words(p.column("text")) for p in pieces(batch, "text")]
        self.at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.at) for w in self.parts]))])
        self.known = np.asarray(ids.is_valid())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        halves = [w.digests() for w in self.parts]
        self.h, self.other = (np.concatenate([x[k] for x in halves]) for k in (0, 1))

    def probes(self, buckets: int):
        """All rolling windows of BLOCK words of texts with an id: first word, text, and 32 bits of hash after the bucket."""
        roll, pos = windows(self.h, self.at, BLOCK)
        doc = np.searchsorted(self.at, pos, "right") - 1
        keep = self.known[doc]
        roll, pos, doc = roll[keep], pos[keep], doc[keep]
        return pos, doc, _bucket(roll, buckets) << np.uint64(32) | roll >> np.uint64(32)

    def candidates(self, hits: list, buckets: int):
        """Windows of WINDOW words around probes that matter: both hashes, first word, text."""
        pos, doc, key = self.probes(buckets)
        some, inverse = np.unique(key, return_inverse=True)
        near = np.zeros(len(self.h) + 1, np.int32)
        p, d = (x[_marks(some, hits)[inverse]] for x in (pos, doc))
        np.add.at(near, np.maximum(p - (WINDOW - BLOCK), self.at[d]), 1)
        np.add.at(near, p + 1, -1)
        a, start = windows(self.h, self.at, WINDOW)
        use = np.cumsum(near)[start] > 0
        b, _ = windows(self.other, self.at, WINDOW, SECOND)
        a, b, start = a[use], b[use], start[use]
        return a, b, start, np.searchsorted(self.at, start, "right") - 1


def _opened(rows: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows).read_next_batch()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return mix(h ^ SECOND) % np.uint64(buckets)


def _marks(keys: np.ndarray, answers: list) -> np.ndarray:
    """Which of the sorted keys, bucket first, the buckets named."""
    out = np.zeros(len(keys), bool)
    for bucket, places in answers:
        out[np.searchsorted(keys, np.uint64(bucket) << np.uint64(32)) + np.frombuffer(places, np.uint32)] = True
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, the first one first and equal ones as they stand, and where each group of equal ones begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], 0)
    return order, np.flatnonzero(new)


def _rows(pack: int, bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: the pack and the bucket's part of each column, truth values as bits. bucket: ascending."""
    raw = lambda v: (np.packbits(v) if v.dtype == bool else v).tobytes()
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    cut = {k: pa.array([raw(v[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()) for k, v in columns.items()}
    return pa.RecordBatch.from_pydict({"pack": pa.array([pack] * (len(edge) - 1), pa.int64()), "bucket": pa.array(bucket[edge[:-1]].astype(np.int32)), **cut})


def _anchors(buckets: int):
    """For each bucket a pack's distinct probes, whether one is a block, and whether several texts hold it."""

    def run(batches):
        for batch in batches:
            for pack, rows in zip(batch.column("pack").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                own = Pack(_opened(rows))
                pos, doc, key = own.probes(buckets)
                if not len(key):
                    continue
                order, first = _groups(key)
                block = (pos - own.at[doc]) % BLOCK == 0
                several = doc[order][first] != doc[order][np.append(first[1:], len(order)) - 1]
                some = key[order][first]
                yield _rows(pack, some >> np.uint64(32), hashes=some.astype(np.uint32), blocks=np.logical_or.reduceat(block[order], first), several=several)

    return run


def _whole(batches) -> pa.Table | None:
    """All rows of a task, which is one bucket."""
    held = list(batches)
    return pa.Table.from_batches(held) if sum(b.num_rows for b in held) else None


def _column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def _answer(table: pa.Table, step: int, counts: list[int], hit: np.ndarray) -> pa.RecordBatch:
    """For each pack the places of its hits among the hashes that it sent."""
    ends = np.cumsum(counts)
    places = [np.flatnonzero(hit[b - n : b]).astype(np.uint32) for b, n in zip(ends, counts, strict=True)]
    rows = [(p, b, x.tobytes()) for p, b, x in zip(table["pack"].to_pylist(), table["bucket"].to_pylist(), places, strict=True) if len(x)]
    pack, bucket, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(pack, pa.int64()), pa.array([step] * len(rows), pa.int32()), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], names=["pack", "step", "bucket", "places"])


def _hits(batches):
    """Probes matter where a text has a block of that hash and another text has a probe."""
    if (table := _whole(batches)) is None:
        return
    h, counts = _column(table, "hashes", np.uint32), [len(x) // 4 for x in table["hashes"].to_pylist()]
    block, several = (np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table[c].to_pylist(), counts, strict=True)]) for c in ("blocks", "several"))
    order, first = _groups(h)
    size = np.diff(np.append(first, len(h)))
    ok = (np.bitwise_or.reduceat(block[order], first) > 0) & ((np.bitwise_or.reduceat(several[order], first) > 0) | (size > 1))
    hit = np.empty(len(h), bool)
    hit[order] = np.repeat(ok, size)
    yield _answer(table, 1, counts, hit)


def _repeats(batches):
    """Windows of a pack matter where another pack's smallest document is smaller than its own."""
    if (table := _whole(batches)) is None:
        return
    a, b = (_column(table, c, np.uint64) for c in ("hashes", "others"))
    low = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table["steps"].to_pylist()])
    order, first = _groups(a, b)
    least = np.empty(len(a), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], first), np.diff(np.append(first, len(a))))
    yield _answer(table, 2, [len(x) // 8 for x in table["hashes"].to_pylist()], least < low)


def _met(batches):
    """(pack, answers by step, ids and texts) of rows that are sorted by pack and step; the text's row is a pack's last."""
    answers: dict[int, list] = {}
    for batch in batches:
        for pack, step, bucket, places, rows in zip(*(batch.column(c).to_pylist() for c in ("pack", "step", "bucket", "places", "rows")), strict=True):
            if bucket is not None:
                answers.setdefault(step, []).append((bucket, places))
            else:
                yield pack, answers, _opened(rows)
                answers = {}


class Windows:
    """A pack's candidate windows in groups of equal ones. Groups are in the order of their bucket, and there of their smallest document."""

    def __init__(self, own: Pack, hits: list, buckets: int):
        self.a, self.b, self.start, doc = own.candidates(hits, buckets)
        self.ids = own.ids[doc]
        self.order, self.first = _groups(self.a, self.b)
        self.size = np.diff(np.append(self.first, len(self.order)))
        one = self.order[self.first]
        self.bucket = _bucket(self.b[one], buckets)
        self.low = np.minimum.reduceat(self.ids[self.order], self.first) if len(one) else np.zeros(0, np.int64)
        self.sorted = np.lexsort((np.arange(len(one)), self.low, self.bucket))

    def message(self, pack: int) -> pa.RecordBatch:
        """For each bucket the groups' hashes and by how much each one's smallest document exceeds the one before."""
        one = self.order[self.first][self.sorted]
        bucket, low = self.bucket[self.sorted], self.low[self.sorted]
        step = np.diff(low, prepend=0)
        new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        step[new] = low[new]
        return _rows(pack, bucket, hashes=self.a[one], others=self.b[one], steps=step)

    def repeats(self, answers: list) -> np.ndarray:
        """Where windows start that a smaller document holds, too. answers: groups that a smaller document of another pack holds."""
        keys = self.bucket[self.sorted] << np.uint64(32)
        other = np.zeros(len(self.first), bool)
        for bucket, places in answers:
            other[self.sorted[np.searchsorted(keys, np.uint64(bucket) << np.uint64(32)) + np.frombuffer(places, np.uint32)]] = True
        repeated = np.repeat(other, self.size) | (self.ids[self.order] > np.repeat(self.low, self.size))
        return self.start[self.order][repeated]


def _candidates(buckets: int):
    """For each bucket a pack's distinct candidate windows, with the smallest document of each."""

    def run(batches):
        for pack, answers, rows in _met(batches):
            if 1 in answers and len((found := Windows(Pack(rows), answers[1], buckets)).first):
                yield found.message(pack)

    return run


def _removed(buckets: int):
    """The result of every row of a pack."""

    def run(batches):
        for _, answers, batch in _met(batches):
            gone = _cover(Pack(batch), answers, buckets) if 1 in answers else None
            at = 0
            for part in pieces(batch, "text"):
                w = Words(part.column("text"))
                n = len(w.starts)
                lost = gone[at : at + n] if gone is not None else np.zeros(n, bool)
                at += n
                sums = np.concatenate([[0], np.cumsum(lost)])
                shas = [sha256(x).hexdigest() for x in w.kept(~lost)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.at), pa.int64()), pa.array(np.diff(sums[w.at]), pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _cover(own: Pack, answers: dict[int, list], buckets: int) -> np.ndarray:
    """Words that lie in a window that starts in a smaller document, too."""
    start = Windows(own, answers[1], buckets).repeats(answers.get(2, []))
    cover = np.zeros(len(own.h) + 1, np.int32)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the words that no repeated window covers, joined by one space)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packs = scratch.cut(docs.mapInArrow(_packs(PACK), PACKED).withColumn("pack", F.monotonically_increasing_id()), "packs", large_rows=True)
    part, place = F.shiftright("pack", 33), F.col("pack").bitwiseAND((1 << 33) - 1)
    size = packs.select(F.sum("bytes").alias("bytes"), F.count("*").alias("packs"), F.max(part).alias("last")).first()
    buckets, tasks = (size["bytes"] or 0) // BUCKET + 1, size["packs"] // PACKS + 1
    number = part * (size["packs"] // ((size["last"] or 0) + 1) + 1) + place  # parts hold about as many packs

    def together(*answers: DataFrame) -> DataFrame:
        """Packs after their answers, dealt evenly to tasks."""
        rows = packs.select("pack", F.lit(9).alias("step"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("places"), "rows")
        for a in answers:
            rows = rows.unionByName(a, allowMissingColumns=True)
        return rows.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int")).sortWithinPartitions("pack", "step")

    def asked(messages: DataFrame, answer, name: str) -> DataFrame:
        return scratch.cut(messages.repartitionById(buckets, "bucket").mapInArrow(answer, ANSWER), name)

    with small_batches(spark, 4):  # a pack's row has megabytes
        hits = asked(packs.mapInArrow(_anchors(buckets), "pack long, bucket int, hashes binary, blocks binary, several binary"), _hits, "hits")
        found = asked(together(hits).mapInArrow(_candidates(buckets), "pack long, bucket int, hashes binary, others binary, steps binary"), _repeats, "repeats")
        out = scratch.cut(together(hits, found).mapInArrow(_removed(buckets), RESULT), "removed")
    scratch.drop(packs, hits, found)
    return out
