"""Benchmark decontamination: a prefix-filtered containment join of documents with item windows.

A window is eight consecutive words of an item (a shorter item is one window). A document
contains a window only if it contains all of its words, so with the words of each window
ordered by rarity, the necessary prefix is the single rarest word. Windows are indexed by it;
a document's word that is in the index fetches its windows, the position bound keeps those
that fit into the document around it (the length bound: a document shorter than the window
has none), and word-by-word comparison verifies the rest. Nothing is approximate.

Rarity is the frequency over the items of a block; the order decides the work, never the result.
The index is broadcast in blocks of about ``block_bytes`` of item text: a benchmark over that
is worked off block by block against all documents and the hits are united. Equal items are one in it, with all
their ids, and long items come in pieces of ``PIECE_WORDS`` words that overlap by all but one word of a window, so a block
is even, whatever the items are. A window is eight bytes of the index, so a block's index is of the order of its text.

Defined results: null texts have no words and no hits; items without words never occur; rows
with an equal doc_id are judged row by row; items with an equal item_id count once; an empty
benchmark leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwave.llm.shared import read, stored, utf8

WINDOW = 8
BLOCK_BYTES = 16 << 20
PIECE_WORDS = 5_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
FOUND = "doc_id long, text_hash long, n_words long, starts array<int>, lengths array<int>, items array<string>"
KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Runs of digits, letters and anything beyond ASCII, A-Z lowered."""
    return (text if isinstance(text, bytes) else utf8(text)).translate(KEEP).split()


class Index:
    """Windows under their rarest word: eight bytes each, as a place in the items' words and a place in the window.

    Equal windows are filed once; items that share one are its owners.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW):
        rows = [(i if isinstance(i, frozenset) else frozenset([str(i)]), w) for i, text in items if i is not None and (w := words_of(text))]
        count = Counter(x for _, w in rows for x in w)
        rank = {x: k for k, x in enumerate(sorted(count, key=lambda x: (count[x], -len(x), x)))}
        word = {x: x for x in count}  # one object per word
        self.window, self.names, self.starts, self.words = window, [n for n, _ in rows], array("q"), []
        self.under: dict[bytes, array] = {}
        self.owners: dict[int, frozenset] = {}
        for _, w in rows:
            base, ranks = len(self.words), [rank[x] for x in w]
            self.starts.append(base)
            self.words += [word[x] for x in w]
            for s in range(max(1, len(w) - window + 1)):
                part = ranks[s : s + window]
                at = part.index(min(part))
                self.under.setdefault(self.words[base + s + at], array("q")).append((base + s) * window + at)
        self.starts.append(len(self.words))
        for rarest, filed in self.under.items():
            if len(filed) > 1:
                equal: dict[tuple, list[int]] = {}
                for place in filed:
                    item, start, end = self.span(place)
                    equal.setdefault(tuple(self.words[start:end]), []).append(place)
                if len(equal) < len(filed):
                    self.under[rarest] = array("q", [places[0] for places in equal.values()])
                    for places in equal.values():
                        if len(places) > 1:
                            self.owners[places[0]] = frozenset().union(*(self.names[self.span(x)[0]] for x in places))

    def span(self, place: int) -> tuple[int, int, int]:
        """The item that a filed window was seen in first, and where its words start and end."""
        start = place // self.window
        item = bisect_right(self.starts, start) - 1
        return item, start, min(start + self.window, self.starts[item + 1])

    def verified(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, place, item) of each window that the words hold."""
        n = len(words)
        if self.under.keys().isdisjoint(words):
            return
        for i, w in enumerate(words):
            for place in self.under.get(w, ()):
                s = i - place % self.window
                if s >= 0:
                    item, start, end = self.span(place)
                    if s + end - start <= n and words[s : s + end - start] == self.words[start:end]:
                        yield s, end - start, place, item


def occurrences(words: list[bytes], index: Index) -> tuple[set, set]:
    """Spans (start, length) of verified windows, and the ids of their items."""
    spans, ids = set(), set()
    for s, n, place, item in index.verified(words):
        spans.add((s, n))
        ids |= index.owners.get(place) or index.names[item]
    return spans, ids


def covered(spans) -> int:
    """Words inside any of the spans."""
    total = end = 0
    for s, n in sorted(spans):
        total += max(0, s + n - max(s, end))
        end = max(end, s + n)
    return total


def digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _judged(index, min_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, clean = index.value, digest(())
        for b in batches:
            out = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
            for text in b.column(1).to_pylist():
                words = words_of(text)
                spans, ids = occurrences(words, known)
                out["n_words"].append(len(words))
                out["n_hit"].append(covered(spans))
                out["n_items"].append(len(ids))
                out["items_sha256"].append(digest(ids) if ids else clean)
                out["contaminated"].append(len(ids) >= min_items)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *map(pa.array, out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["doc_id", *out])

    return run


def _found(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for b in batches:
            rows = []
            for doc, text, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = words_of(text)
                spans, ids = occurrences(words, known)
                if ids:
                    spans = sorted(spans)
                    rows.append((doc, h, len(words), [s for s, _ in spans], [n for _, n in spans], sorted(ids)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["doc_id", "text_hash", "n_words", "starts", "lengths", "items"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: what several blocks have found, as one row."""
    for b in batches:
        d, out = b.to_pydict(), []
        for doc, h, n, starts, lengths, items in zip(*d.values(), strict=True):
            ids = {x for part in items for x in part}
            out.append((doc, h, n, covered({(s, k) for a, c in zip(starts, lengths, strict=True) for s, k in zip(a, c, strict=True)}), len(ids), digest(ids)))
        kinds = (pa.int64(),) * 5 + (pa.string(),)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=["doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256"])


def _indexes(items: DataFrame, block_bytes: int) -> list:
    """For each block of items: a function that makes its index and sends it out."""
    sc = items.sparkSession.sparkContext
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    pieces = stored(rows.mapInArrow(_pieces, "item_id string, piece binary").groupBy("piece").agg(F.collect_set("item_id").alias("ids")), "items")
    size = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("piece"), F.lit(blocks))
    return [lambda k=k: sc.broadcast(Index([(frozenset(r.ids), bytes(r.piece)) for r in pieces.where(part == k).collect()])) for k in range(blocks)]


def _pieces(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Words of items, joined by blanks, in pieces that hold every window."""
    for b in batches:
        ids, pieces = [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words_of(text)
            for at in range(0, max(1, len(w) - window + 1) if w else 0, PIECE_WORDS):
                ids.append(i)
                pieces.append(b" ".join(w[at : at + PIECE_WORDS + window - 1]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.binary())], names=["item_id", "piece"])


def without_items(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no window of any item, with their columns.

    Each row is judged by its own text, whatever its doc_id: one pass and no shuffle. Items of more
    than a block take a pass per block, each over what the one before has left.
    """
    for k, made in enumerate(_indexes(items, block_bytes)):
        docs = (stored(docs, "decontaminated") if k else docs).where(~_holds(made())(F.col("text").cast("string")))
    return docs


def _holds(index):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([next(index.value.verified(words_of(x)), None) is not None for x in texts], dtype="bool")

    return holds


def decontaminate(docs: DataFrame, items: DataFrame, min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words, the words hit, and the items it holds windows of."""
    indexes = _indexes(items, block_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(indexes) == 1:
        return rows.mapInArrow(_judged(indexes[0](), min_items), SCHEMA)
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    found = None
    for made in indexes:
        now = hashed.mapInArrow(_found(made()), FOUND)
        found = now if found is None else found.unionByName(now)
    keys = ["doc_id", "text_hash", "n_words"]
    # rows of one document that are equal find the same: one of each block is enough
    per = found.dropDuplicates(["doc_id", "text_hash", "starts", "items"]).groupBy(*keys).agg(F.collect_list("starts").alias("starts"), F.collect_list("lengths").alias("lengths"), F.collect_list("items").alias("items"))
    hit = per.mapInArrow(_united, "doc_id long, text_hash long, n_words long, n_hit long, n_items long, items_sha256 string").drop("n_words")
    all_rows = hashed.mapInArrow(_counted, "doc_id long, text_hash long, n_words long")
    joined = all_rows.alias("a").join(hit.alias("h"), F.col("a.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("a.text_hash") == F.col("h.text_hash")), "left")
    return joined.select(
        "a.doc_id", "a.n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(digest(()))).alias("items_sha256"), (F.coalesce("n_items", F.lit(0)) >= min_items).alias("contaminated"),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = pa.array([len(words_of(x)) for x in b.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], names=["doc_id", "text_hash", "n_words"])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
