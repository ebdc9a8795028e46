"""LM scoring: prediction by partial matching over bytes, and a word-frequency base.

Every context of up to five bytes that training holds is in the model, at any size of corpus: a table of
counts by context and next byte, one for each length of context. A byte seen after a context has
``(count - 1/2) / total``; the rest, the escape ``distinct / (2 * total)``, goes to the bytes not seen, in
proportion to the next shorter context without the seen ones (symbol exclusion); a context that training
lacks takes the next shorter one. The tables also hold what occurs in the scored texts alone, with a count
of 0, so each length is one join with the shorter one and one window over the context, and the last table has the code length of
every place of every text. A score is the sum over a text's words, joined by one blank, and its
end. A byte that training lacks is coded as such and then evenly among all 256.

That last table meets the texts in one of two ways, with the same scores (a test holds them against each other). While it
has at most ``model_rows`` rows, which is counted, it is sent out as a hash table of twelve bytes a slot and
the texts are read once more, without a shuffle. Beyond that texts are scored in blocks of about 48 MB: the distinct
places of a block are joined with the table and meet the block's texts.

The base takes each word's count over all training documents. Words that make up at least 1/65536 of
the tokens (so 65536 of them at most) are broadcast and summed where the text is read; only the rarer
ones, of which none can be a hot key, are shuffled, once, as 64-bit hashes, to meet their counts. Training
words that share a hash are found beforehand and broadcast with the frequent ones, so their counts stay
exact; a word that training lacks takes another's hash with a chance of (distinct words) / 2**64.

Defined results: null and empty texts are their end alone; rows with an equal doc_id are scored row by
row; a null doc_id is never held out; without training rows counts are 0 and bytes are coded evenly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brookwave.llm.shared import dropped, read, stored, utf8
from brookwave.llm.toxicity import held_out

FOLDS, HELD_OUT = 7, 2
ORDER = 5
WORD_SHARE = 1 << 16
END = 256  # the symbol after the last byte; 257 stands for bytes that training lacks
BITS = 9
FILLER = 511  # no text's symbol: a context ends before it
FLUSH, PIECE, BLOCK = 4 << 20, 1 << 18, 48 << 20
KEYS = 3_000_000  # distinct grams that a task holds before it hands them on
MODEL_ROWS = 6_000_000  # of the model that is sent out: 12 bytes each, in one and a half as many slots, are 108 MB


def tokens_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            n.update(tokens_of(text))
        if len(n) > 1_500_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
            n = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def hashed(word: bytes) -> int:
    """Spark's xxhash64 of a binary value."""
    return signed(xxhash.xxh64_intdigest(word, 42))


def grams(stream: np.ndarray, order: int) -> np.ndarray:
    """Each symbol with the ``order`` before it, as one number; the stream begins with ``order`` ends."""
    out = np.zeros(len(stream) - order, np.int64)
    for k in range(order + 1):
        out = (out << BITS) | stream[k : len(stream) - order + k]
    return out


def _stream(raw: bytes, order: int) -> np.ndarray:
    return np.concatenate([np.full(order, END, np.int64), np.frombuffer(raw, np.uint8), [END]])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their words, with a number of their own and that of the part they are in."""
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    row, part, held = first, first, 0
    for b in batches:
        raws, parts = [], []
        for text in b.column(2).to_pylist():
            raws.append(b" ".join(tokens_of(text)))
            parts.append(part)
            held += len(raws[-1]) + 1
            if held >= BLOCK:
                part, held = part + 1, 0
        rows = pa.array(range(row, row + b.num_rows), pa.int64())
        row += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), rows, b.column(0), b.column(1), pa.array(raws, pa.binary())], names=["part", "row", "doc_id", "held_out", "raw"])


def _counted_grams(order: int):
    """Distinct grams of each block, as far as a task holds it, with their count in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        keys, counts, parts, held, block = none, none, [], 0, None

        def with_() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([g << 1 | t for g, t in parts]), return_counts=True)
            n, new = n * (new & 1), new >> 1
            first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
            found, n = new[first], np.add.reduceat(n, first)
            both, where = np.unique(np.concatenate([keys, found]), return_inverse=True)
            return both, np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 100_000):
                k = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, np.int64)), pa.array(k), pa.array(counts[at : at + 100_000])], names=["block", "gram", "n"])

        for b in batches:
            for now, unseen, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if now != block or held > FLUSH:
                    if parts:
                        keys, counts = with_()
                        parts, held = [], 0
                    if now != block or len(keys) > KEYS:
                        yield from out()
                        keys, counts, block = none, none, now
                raw = text if isinstance(text, bytes) else b" ".join(tokens_of(text))
                parts.append((grams(_stream(raw, order), order), unseen is False))
                held += len(raw) + 1
        if parts:
            keys, counts = with_()
        yield from out()

    return run


class Lengths:
    """Code lengths by gram: an open-addressed table, filled and looked up a whole array at a time."""

    def __init__(self, gram: np.ndarray, length: np.ndarray):
        self.slots = max(2, len(gram) * 3 // 2)
        self.key, self.length = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.float32)
        left, at = np.arange(len(gram)), self.place(gram)
        while len(left):
            free = self.key[at] == -1
            self.key[at[free]] = gram[left[free]]  # of several the last one stays
            mine = self.key[at] == gram[left]
            self.length[at[mine]] = length[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) % self.slots

    def place(self, gram: np.ndarray) -> np.ndarray:
        mixed = (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return ((mixed * np.uint64(self.slots)) >> np.uint64(32)).astype(np.int64)

    def of(self, gram: np.ndarray) -> np.ndarray:
        at = self.place(gram)
        out, miss = self.length.take(at), np.flatnonzero(self.key.take(at) != gram)
        at = at[miss]
        while len(miss):
            at = (at + 1) % self.slots
            found = self.key.take(at)
            if (found == -1).any():
                raise KeyError("a gram that the model lacks")
            hit = found == gram[miss]
            out[miss[hit]] = self.length.take(at[hit])
            miss, at = miss[~hit], at[~hit]
        return out


class Trie:
    """The model in memory, which the tables are tested against: code lengths (log10 of probabilities) by node and next symbol.

    A context is a node if it makes up at least 1/share of what was read; by default every one is.
    symbol: byte or END -> place in the alphabet; the alphabet's last place is for bytes unseen.
    child: node and the symbol before it -> the longer node, or -1; the root is node 0.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, order: int = ORDER, share: int = 1 << 62):
        self.order = order
        last = gram & ((1 << BITS) - 1)
        seen = np.union1d(last, [END]).astype(np.int64)
        self.width = len(seen) + 1
        self.symbol = np.full(1 << BITS, self.width - 1, np.int32)
        self.symbol[seen] = np.arange(len(seen))
        total = int(n.sum())
        raw = [(gram >> (BITS * k)) & ((1 << BITS) - 1) for k in range(order + 1)]  # the last first
        digits = [self.symbol[x] for x in raw]
        node = np.zeros(len(gram), np.int64)
        level = self.level(np.zeros((1, self.width)), np.full((1, self.width), 1 / self.width), digits[0], node, n)
        rows, self.child = [level], np.full((1, self.width), -1, np.int32)
        alive, base = np.ones(len(gram), bool), 0
        for k in range(1, order + 1):
            alive &= raw[k] != FILLER
            pair = node * self.width + digits[k]
            found, where = np.unique(pair[alive], return_inverse=True)
            size = np.bincount(where, weights=n[alive], minlength=len(found))
            big = size * share >= total
            first = base + len(rows[-1])
            number = np.where(big, first + np.cumsum(big) - 1, -1)
            parents = found[big] // self.width
            self.child[parents, found[big] % self.width] = number[big]
            to = number[where]
            index = np.flatnonzero(alive)
            alive[index[to < 0]] = False
            node[index] = np.where(to >= 0, to, node[index])
            count = np.zeros((int(big.sum()), self.width))
            lower = rows[-1][parents - base]
            rows.append(self.level(count, lower, digits[0][alive], node[alive] - first, n[alive]))
            self.child = np.vstack([self.child, np.full((len(count), self.width), -1, np.int32)])
            base = first
        self.length = np.log10(np.vstack(rows)).astype(np.float32)

    @staticmethod
    def level(count: np.ndarray, lower: np.ndarray, symbol: np.ndarray, node: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Distributions of an order's nodes from their counts and from the next shorter contexts'."""
        np.add.at(count, (node, symbol), n)
        total, distinct = count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True)
        left = np.where(count > 0, 0.0, lower)
        mass = left.sum(axis=1, keepdims=True)
        most = np.maximum(total, 1)
        escape = np.where(mass > 0, distinct / (2 * most), 0.0)
        p = np.where(count > 0, (count - np.where(mass > 0, 0.5, 0.0)) / most, escape * left / np.where(mass > 0, mass, 1))
        return np.where(total > 0, p, lower)

    def steps(self) -> np.ndarray:
        """(state, symbol before) -> state. A state at or over the number of nodes has found no longer context and stays."""
        if not hasattr(self, "_steps"):
            n = len(self.child)
            own = np.arange(n, 2 * n, dtype=np.int32)[:, None]
            self._steps = np.vstack([np.where(self.child >= 0, self.child, own), np.broadcast_to(own, self.child.shape)]).ravel()
        return self._steps

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_steps"}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """log10 of the probability of each text's words and its end."""
        out, held, size = np.zeros(len(texts)), [], 0
        for i, text in enumerate(texts):
            raw = b" ".join(tokens_of(text))
            s = np.concatenate([np.full(self.order, self.symbol[END], np.int32), self.symbol[np.frombuffer(raw, np.uint8)], self.symbol[[END]]])
            for at in range(0, len(raw) + 1, PIECE):
                held.append((i, s[at : at + PIECE + self.order]))
                size += len(held[-1][1])
                if size >= PIECE:
                    self._add(out, held)
                    held, size = [], 0
        if held:
            self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
        """Adds pieces, each with the context before it, to their texts' scores."""
        s, steps, n = np.concatenate([x for _, x in held]), self.steps(), len(self.child)
        state = np.zeros(len(s) - self.order, np.int32)
        for k in range(1, self.order + 1):
            state *= self.width
            state += s[self.order - k : len(s) - k]
            state = steps.take(state)
        state[state >= n] -= n
        now = s[self.order :]
        length = self.length.ravel().take(state * self.width + now).astype(np.float64)
        length[now == self.width - 1] -= math.log10(256)
        ends = np.cumsum([len(x) for _, x in held])
        sums = np.concatenate([[0.0], np.cumsum(length)])
        for (i, x), end in zip(held, ends.tolist(), strict=True):
            out[i] += sums[end - self.order] - sums[end - len(x)]


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, sum_log double, score double, keys array<long>"


def _rated(raw: bytes, logs: dict, length: float) -> tuple:
    """Tokens, frequent known ones, the sum of their logarithms, the score, and hashes of the other tokens."""
    n = Counter(raw.split())
    often = n.keys() & logs.keys()
    return sum(n.values()) + 1, sum(n[w] for w in often), sum(n[w] * logs[w] for w in sorted(often)), length, [h for w in n if w not in often for h in [hashed(w)] * n[w]]


def _table(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
    return [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]


NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "sum_log", "score", "keys"]


def _scored(known, order: int):
    """A block's texts with the code lengths of its places."""

    def run(texts: pa.Table, lengths: pa.Table) -> pa.Table:
        logs, parts = known.value, []
        gram, length = lengths.column("gram").to_numpy(), lengths.column("length").to_numpy()
        sort = np.argsort(gram)
        gram, length = gram[sort], length[sort]
        for b in texts.select(["row", "doc_id", "held_out", "raw"]).to_batches(max_chunksize=1000):  # few rows as Python values at once
            out = []
            for row, doc_id, held, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                stream, total = _stream(raw, order), 0.0
                for at in range(0, len(stream) - order, PIECE):
                    total += float(length[np.searchsorted(gram, grams(stream[at : at + PIECE + order], order))].sum())
                out.append((row, doc_id, held, *_rated(raw, logs, total)))
            parts.append(pa.RecordBatch.from_arrays(_table(out), names=NAMES))
        return pa.Table.from_batches(parts) if parts else pa.Table.from_arrays(_table([]), names=NAMES)

    return run


def _scored_with(model, known, order: int):
    """Texts with the whole model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for b in batches:
            out = []
            for doc_id, held, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw, length = b" ".join(tokens_of(text)), 0.0
                stream = _stream(raw, order)
                for at in range(0, len(stream) - order, PIECE):
                    length += float(model.value.of(grams(stream[at : at + PIECE + order], order)).sum(dtype=np.float64))
                out.append((row, doc_id, held, *_rated(raw, known.value, length)))
                row += 1
            yield pa.RecordBatch.from_arrays(_table(out), names=NAMES)

    return run


def lm_scores(docs: DataFrame, train, order: int = ORDER, model_rows: int = MODEL_ROWS) -> DataFrame:
    """docs: doc_id, text. train: a condition on their columns. One row per document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = rows.where(train).select("text")
    n_docs = seen.count()
    words = stored(seen.mapInArrow(_counted_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_docs, distinct + (n_docs > 0)  # with the ends
    often = {bytes(r.word): math.log10(r.c + 1) for r in words.where(F.col("c") * WORD_SHARE >= total).collect()} if total else {}
    twins = words.groupBy(F.xxhash64("word").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    often |= {bytes(r.word): math.log10(r.c + 1) for r in words.join(twins, F.xxhash64("word") == F.col("k"), "left_semi").collect()}
    rows = rows.select("doc_id", (~train).alias("held_out"), "text")
    counted = rows.select(F.lit(0).cast("long").alias("block"), "held_out", "text").mapInArrow(_counted_grams(order), "block long, gram long, n long")
    table = stored(counted.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    p = code_lengths(table, order)
    dropped(table)
    spark._jvm.System.gc()  # what was shuffled so far leaves the disks
    known = spark.sparkContext.broadcast(often)
    if p.count() <= model_rows:
        model = p.select("gram", F.col("length").cast("float").alias("length")).toArrow()
        model = spark.sparkContext.broadcast(Lengths(model.column("gram").to_numpy(), model.column("length").to_numpy()))
        parts, scored = [], stored(rows.mapInArrow(_scored_with(model, known, order), SCORED), "scored")
    else:
        texts = _texts(rows)
        found = texts.select("block", "held_out", "raw").mapInArrow(_counted_grams(order), "block long, gram long, n long")
        places = found.select("block", "gram").join(p.hint("shuffle_hash"), "gram").select("block", "gram", "length")
        parts, scored = [texts.parts], stored(texts.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(_scored(known, order), SCORED), "scored")
    for x in (p, *parts):
        dropped(x)
    counts = words.where(F.col("c") * WORD_SHARE < total).select(F.xxhash64("word").alias("k"), F.log10(F.col("c") + 1).alias("log")).hint("shuffle_hash")
    exploded = scored.select("row", F.explode("keys").alias("key"))
    rare = exploded.join(counts, F.col("key") == F.col("k")).groupBy("row").agg(F.count("*").alias("rare_known"), F.sum("log").alias("rare_log"))
    per = scored.drop("keys").join(rare, "row", "left")
    end_log = math.log10(n_docs + 1)
    return per.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + int(n_docs > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sum_log") + F.coalesce("rare_log", F.lit(0.0)) + end_log - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"), "score",
    )


def _texts(rows: DataFrame) -> DataFrame:
    """Texts as their words, with the block they are in: parts of tasks, put together to about BLOCK bytes."""
    parts = stored(rows.mapInArrow(_blocked, "part long, row long, doc_id long, held_out boolean, raw binary"), "texts")
    at, blocks = 0, []
    for r in sorted(parts.groupBy("part").agg(F.sum(F.length("raw") + 1).alias("size")).collect()):
        blocks.append((r.part, at // BLOCK))
        at += r.size
    of = F.broadcast(rows.sparkSession.createDataFrame(blocks, "part long, block long"))
    out = parts.join(of, "part").drop("part")
    out.parts = parts
    return out


def code_lengths(table: DataFrame, order: int) -> DataFrame:
    """gram, n (its count in training, 0 if only scored texts hold it) -> gram, length (log10 of the probability of its last symbol)."""
    levels = {order: table}
    for k in range(order - 1, -1, -1):
        short = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k + 1))) - 1)).alias("gram")
        levels[k] = stored(levels[k + 1].groupBy(short).agg(F.sum("n").alias("n")), f"level-{k}")
    trained = {r.gram for r in levels[0].where("n > 0").collect()} | {END}
    even = 1 / (len(trained) + 1)  # the last place is for bytes unseen
    p = levels[0].select("gram", F.when(F.col("gram").isin(sorted(trained)), even).otherwise(even / 256).alias("p"))
    for k in range(order + 1):
        if k:
            shorter = p.select(F.col("gram").alias("short"), "p")
            here = levels[k].join(shorter.hint("shuffle_hash"), levels[k]["gram"].bitwiseAND(F.lit((1 << (BITS * k)) - 1)) == F.col("short")).drop("short")
        else:
            here = levels[0].join(p, "gram")
        context = Window.partitionBy(F.shiftright("gram", BITS))
        all_, distinct = F.sum("n").over(context), F.sum((F.col("n") > 0).cast("long")).over(context)
        left = F.greatest(1 - F.sum(F.when(F.col("n") > 0, F.col("p")).otherwise(0.0)).over(context), F.lit(1e-12))  # over 0 but for rounding
        here = here.select("gram", "n", "p", all_.alias("all"), distinct.alias("distinct"), left.alias("left"))
        new = F.when(F.col("all") == 0, F.col("p")).when(F.col("n") > 0, (F.col("n") - 0.5) / F.col("all")).otherwise(F.col("distinct") / (2 * F.col("all")) * F.col("p") / F.col("left"))
        last, p = p, stored(here.select("gram", (new if k < order else F.log10(new)).alias("p" if k < order else "length")), f"p-{k}")
        dropped(last)
        if k < order:
            dropped(levels[k])
    return p


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"), ~held_out("doc_id", FOLDS, HELD_OUT))
