"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a Hamming index, and an exact check.

For a benchmark item of L words every L-word window of a document (or the whole document, if it is shorter) can be a
leak. A window can only reach the similarity if at least that share of its five-word shingles occurs in the benchmark, so
only such windows are fingerprinted. Fingerprints have 64 bits in eight blocks; any two within RADIUS differ by three bits
or less in some block, so a table of each block's near values finds every item within RADIUS. Candidates are decided by
the exact similarity of their shingles weighted by how often each occurs: the sum of the smaller weights over the sum of
the larger ones. A window of that similarity lies 11 bits away on average, with a deviation of 3; RADIUS is 24.

The benchmark is the query set. It is read in blocks of about BLOCK_BYTES of text, one of which is in the driver and
broadcast at a time. Documents are scanned once: with more than one block, a bitmap of fixed size first tells which documents
share a shingle with the benchmark at all, and only those are kept for the blocks. Long texts are worked on in slices of
windows, so memory follows a text's words and a slice. Items with fewer than five words match a window that equals them. ASCII letters are
lower-cased. Null and empty texts, of documents or items, match nothing. Repeated rows give repeated answers; equal
similarities go to the earliest window. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.scratch import Scratch, arrow_rows
from quorum_spark.llm.words import Words, mix, pieces, windows

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.75, 24, 8
BLOCK_BYTES = 4 << 20
#: Windows of a slice, pairs of windows and items of a slice, shingles whose bits are summed at once.
SLICE, PAIRS, SUMMED = 1 << 14, 1 << 22, 1 << 12
#: Bits of the bitmap of all the benchmark's shingles.
BITMAP = 1 << 27
SCHEMA = "item_id long, start_word long, n_words long, distance int, similarity double"
_SALT = np.uint64(0x5851F42D4C957F2D)
_BITS = np.arange(64, dtype=np.uint64)


def votes(shingles: np.ndarray) -> np.ndarray:
    """-1 or 1 for each of 64 bits of each shingle."""
    return ((mix(shingles ^ _SALT)[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return ((sums >= 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


class Items:
    """A block of the benchmark: for every length the items, their shingle counts and the Hamming index."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = Words(pa.array(texts, pa.string()), lower=True)
        h = w.digests()[0]
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        by_length, every = defaultdict(list), []
        for i, item in enumerate(ids):
            own = h[w.at[i] : w.at[i + 1]]
            n = len(own)
            if 0 < n < SHINGLE:
                self.short[n][int(windows(own, np.array([0, n]), n)[0][0])].append(item)
            elif n:
                s, _ = windows(own, np.array([0, n]), SHINGLE)
                every.append(s)
                by_length[n].append((item, Counter(s.tolist()), pack(votes(s).sum(0)[None])[0]))
        self.short = {n: dict(v) for n, v in self.short.items()}
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= RADIUS // BLOCKS
        self.lengths = {}
        for n, rows in by_length.items():
            prints = np.array([r[2] for r in rows], np.uint64)
            parts = prints[:, None].view(np.uint8).reshape(len(rows), BLOCKS)
            self.lengths[n] = (rows, prints, [near[:, parts[:, b]] for b in range(BLOCKS)])

    def occurs(self, shingles: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.seen[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        out = np.zeros(len(shingles), bool)
        if len(maybe) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
            out[maybe] = self.known[at] == shingles[maybe]
        return out

    def leaks(self, shingles: np.ndarray, hit: np.ndarray) -> dict[int, tuple]:
        """Best window of each item that leaks into one text: (similarity, -start, words, distance)."""
        found: dict[int, tuple] = {}
        hits = np.concatenate([[0], np.cumsum(hit)])
        for n, (rows, prints, index) in self.lengths.items():
            width = min(n - SHINGLE + 1, len(shingles))
            full = n - SHINGLE + 1
            every = np.flatnonzero(hits[width:] - hits[: len(hits) - width] >= SIMILARITY * full)
            step = max(1, min(SLICE, PAIRS // len(rows)))
            for a in range(0, len(every), step):
                starts = every[a : a + step]
                fp = pack(window_sums(shingles, starts, width))
                parts = fp[:, None].view(np.uint8).reshape(len(fp), BLOCKS)
                near = reduce(np.logical_or, (index[b][parts[:, b]] for b in range(BLOCKS)))
                counted = (-1, Counter())
                for i, j in zip(*np.nonzero(near), strict=True):
                    distance = int(np.bitwise_count(fp[i] ^ prints[j]))
                    if distance > RADIUS:
                        continue
                    start = int(starts[i])
                    if counted[0] != start:
                        counted = (start, Counter(shingles[start : start + width].tolist()))
                    item, counts, _ = rows[j]
                    low = sum(min(c, counts[s]) for s, c in counted[1].items() if s in counts)
                    similarity = low / (width + full - low)
                    if similarity >= SIMILARITY:
                        found[item] = max(found.get(item, (-1.0,)), (similarity, -start, width + SHINGLE - 1, -distance))
        return found


def window_sums(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each start the summed votes of width shingles. Running sums are made for SUMMED shingles at a time."""
    at = np.unique(np.concatenate([starts, starts + width]))
    sums = np.empty((len(at), 64), np.int32)
    total = np.zeros(64, np.int32)
    for s in range(int(at[0]), int(at[-1]) + 1, SUMMED):
        part = np.cumsum(votes(shingles[s : min(s + SUMMED, int(at[-1]))]), 0, dtype=np.int32)
        part = np.concatenate([np.zeros((1, 64), np.int32), part]) + total
        lo, hi = np.searchsorted(at, [s, s + SUMMED])
        sums[lo:hi] = part[at[lo:hi] - s]
        total = part[-1]
    return sums[np.searchsorted(at, starts + width)] - sums[np.searchsorted(at, starts)]


def _keys(w: Words) -> np.ndarray:
    """Hashes, modulo the bitmap's size, of the shingles of these items, and of items with fewer words than a shingle as a whole."""
    h, words = w.digests()[0], np.diff(w.at)
    every = [windows(h, w.at, SHINGLE)[0]]
    for n in range(1, SHINGLE):
        whole, at = windows(h, w.at, n)
        every.append(whole[words[np.searchsorted(w.at, at, "right") - 1] == n])
    return np.concatenate(every) % np.uint64(BITMAP)


def _marked(batches):
    """The bits of these items, without repeats."""
    for batch in batches:
        for part in pieces(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_keys(Words(part.column("text"), lower=True))).astype(np.int64))], names=["bit"])


def _bytes_of_bits(batches):
    """The bits of a range, packed, as (place of the first byte, bytes)."""
    for batch in batches:
        bits = np.unique(batch.column("bit").to_numpy())
        if len(bits):
            at = int(bits[0]) // 8
            flags = np.zeros((int(bits[-1]) // 8 + 1 - at) * 8, bool)
            flags[bits - at * 8] = True
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["at", "bytes"])


def _touched(shared):
    """Documents that hold a shingle of the benchmark or a whole item of fewer words."""

    def run(batches):
        bitmap = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(part.column("text"), lower=True)
                h, keep = w.digests()[0], np.zeros(len(w), bool)
                for n in range(1, SHINGLE + 1):
                    whole, at = windows(h, w.at, n)
                    key = whole % np.uint64(BITMAP)
                    bit = bitmap[(key >> np.uint64(3)).astype(np.int64)] >> (7 - (key & np.uint64(7)).astype(np.uint8)) & 1
                    keep[np.searchsorted(w.at, at[bit > 0], "right") - 1] = True
                yield part.filter(pa.array(keep))

    return run


def _scan(shared):
    def run(batches):
        items: Items = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(part.column("text"), lower=True)
                h = w.digests()[0]
                sh, pos = windows(h, w.at, SHINGLE)
                hit = items.occurs(sh)
                lo = np.searchsorted(pos, w.at)
                hits = np.concatenate([[0], np.cumsum(hit)])[lo]
                rows = []
                for i in np.flatnonzero(hits[1:] > hits[:-1]):
                    for item, (sim, start, n, distance) in items.leaks(sh[lo[i] : lo[i + 1]], hit[lo[i] : lo[i + 1]]).items():
                        rows.append((i, item, -start, n, -distance, sim))
                for n, wanted in items.short.items():
                    whole, at = windows(h, w.at, n)
                    keys = np.array(sorted(wanted), np.uint64)
                    one = np.isin(whole, keys)
                    doc = np.searchsorted(w.at, at[one], "right") - 1
                    first = {}
                    for d, p, x in zip(doc.tolist(), at[one].tolist(), whole[one].tolist(), strict=True):
                        first.setdefault((d, x), p)
                    rows += [(d, item, p - int(w.at[d]), n, 0, 1.0) for (d, x), p in first.items() for item in wanted[x]]
                if rows:
                    index, *cols = zip(*rows, strict=True)
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                    names = ["item_id", "start_word", "n_words", "distance", "similarity"]
                    ids = part.column("doc_id").take(pa.array(np.array(index, np.int64)))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", *names])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, start_word, n_words, distance, similarity."""
    spark = docs.sparkSession
    arrow_rows(spark)
    texts = docs.select("doc_id", "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(size // block_bytes) + 1
    scratch = Scratch(spark, "leaks")
    if n_blocks > 1:  # written by block, so each one is read by itself
        items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
        items = scratch.cut(items.repartitionByRange(n_blocks, "block").sortWithinPartitions("block"), "items")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"

    def block(k: int):
        own = (items.where(F.col("block") == k) if n_blocks > 1 else items).orderBy("item_id", "text").collect()
        return spark.sparkContext.broadcast(Items([r["item_id"] for r in own], [r["text"] for r in own]))

    if n_blocks == 1:
        return texts.mapInArrow(_scan(block(0)), schema)
    texts = scratch.cut(texts.mapInArrow(_touched(_bitmap(items)), texts.schema), "touched")
    out = None
    for k in range(n_blocks):
        shared = block(k)
        found = scratch.cut(texts.mapInArrow(_scan(shared), schema), f"block-{k}")
        shared.destroy()
        out = found if out is None else out.union(found)
    scratch.drop(texts, items)
    return out


def _bitmap(items: DataFrame):
    """A broadcast of BITMAP bits: those of the benchmark's shingles and short items."""
    bits = items.mapInArrow(_marked, "bit long").distinct().repartitionByRange("bit").sortWithinPartitions("bit")
    packed = np.zeros(BITMAP // 8, np.uint8)
    for r in bits.mapInArrow(_bytes_of_bits, "at long, bytes binary").toLocalIterator():  # BITMAP bits at most, whatever the benchmark
        packed[r["at"] : r["at"] + len(r["bytes"])] |= np.frombuffer(r["bytes"], np.uint8)
    return items.sparkSession.sparkContext.broadcast(packed.tobytes())
