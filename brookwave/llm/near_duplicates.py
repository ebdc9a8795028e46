"""MinHash near-dedup: a multi-index Hamming join of signatures, confirmed on full shingle sets.

Rows of the work, none of which the driver sees:

1. each text becomes its set of five-word shingles (64-bit hashes), a hash of the whole set, and a
   signature of 128 symbols of 16 bits (one minimum per permutation)
2. documents with equal sets form a class; the smallest doc_id stands for it
3. index: 48 of the symbols form 8 chunks of 6. By pigeonhole two signatures that differ in at most 15
   of these 48 agree, in some chunk, in all but one symbol at most, so each chunk is filed once for
   every symbol left out: 48 keys. Every pair within this distance (``NEAR``) has a common key and is taken
   up: the join is complete for it. Pairs of a similarity of 0.85 lie beyond it with a chance of 1e-3, so
   those that have a common key all the same are taken up too if the whole signatures differ in at
   most 38 symbols (``FAR``); such a pair has no common key with a chance of 6e-6, and lies beyond FAR
   with one of 4e-6
4. keys that one class alone has are dropped; under the others signatures are compared. A
   pair is taken up by the first key that both have, and by no other
5. the members of such pairs meet once more, in jobs, with their full sets: exact intersections
   confirm links. A job holds at most ``JOB_BYTES`` of sets, or two sets. Only links of a spanning forest leave the task
6. components by minimum-label propagation with pointer jumping

Skew: exact copies collapse in step 2, before the shuffle, and find their component again without
one (see HEAVY). A key with more members than
``block`` is dealt out to tasks by pairs of blocks, so that none holds more than two blocks. No pairs
are emitted, but the signatures of a key of n members move n / block times, so the rows of a key grow
with n * n / block; so do its comparisons, which are work in memory.

Defined results: null texts and texts without words have no set, are linked with nothing and form
their own component; a text of under five words is one shingle; rows with an equal doc_id are
joined by their sets like any others; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwave.llm.shared import dropped, read, stored, utf8

SHINGLE = 5
SIMILARITY = 85  # in hundredths
PERMUTATIONS, CHUNKS, CHUNK = 128, 8, 6
NEAR, FAR = 2 * CHUNKS - 1, 38  # of the indexed symbols, of all
BLOCK = 512
JOB_BYTES = 64 << 20
HEAVY = 1000  # sets that hold one in so many rows or more are joined by broadcast: there are at most so many of them
MEMO = 100_000  # hashes of words that a worker remembers
BROADCAST = 4_000_000  # doc_ids, of eight bytes each; beyond so many the texts are shuffled
_rng = np.random.default_rng(20240229)
#: Odd multipliers are permutations of 32-bit numbers.
MULTIPLIERS = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | 1).astype(np.uint32)
ADDENDS = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
CHUNK_SALTS = _rng.integers(0, 1 << 63, (CHUNKS, CHUNK, CHUNK), dtype=np.uint64) | np.uint64(1)
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)], np.uint64)
_memo: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a permutation that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingles."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_memo) > MEMO:
        _memo.clear()
    for w in words:
        if w not in _memo:
            _memo[w] = xxhash.xxh3_64_intdigest(w)
    h = mixed(np.array([_memo[w] for w in words], np.uint64))
    if len(words) < size:
        return mixed(np.array([np.add.reduce(h * POWERS[: len(h)]) + np.uint64(len(h))], np.uint64))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * POWERS[k]
    return np.unique(mixed(out))


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each permutation's minimum."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        low = np.minimum(low, (x[at : at + 2048, None] * MULTIPLIERS + ADDENDS).min(axis=0))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, ids, signs = [], [], []
        for text in b.column(1).to_pylist():
            found = shingles(text)
            n.append(len(found))
            ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signs.append(signature(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "signature"])


def keys_of(signs: np.ndarray) -> np.ndarray:
    """(rows, chunks * symbols of a chunk) keys: a chunk with one symbol left out."""
    parts = signs[:, : CHUNKS * CHUNK].reshape(len(signs), CHUNKS, 1, CHUNK).astype(np.uint64) + np.uint64(1)
    terms = mixed(parts * CHUNK_SALTS[None])  # of each symbol at its place
    terms[:, :, np.arange(CHUNK), np.arange(CHUNK)] = 0
    place = np.arange(1, CHUNKS * CHUNK + 1, dtype=np.uint64).reshape(CHUNKS, CHUNK)
    return mixed(terms.sum(axis=3, dtype=np.uint64) + place * np.uint64(0xD6E8FEB86659FD93)).reshape(len(signs), CHUNKS * CHUNK).view(np.int64)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place of the key, class) rows."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            signs = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(part.num_rows, PERMUTATIONS)
            keys = keys_of(signs)
            classes = np.repeat(part.column(0).to_numpy(), keys.shape[1])
            place = np.tile(np.arange(keys.shape[1], dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(place), pa.array(classes)], names=["key", "place", "class"])


def taken_up(signs: np.ndarray, place: int, first: int) -> np.ndarray:
    """Which rows are in a pair that this key takes up; first: rows below it are one block, the others another (0: all are one)."""
    n, chunk, left_out = len(signs), place // CHUNK, place % CHUNK
    out = np.zeros(n, bool)
    step = max(1, (1 << 22) // max(1, n * PERMUTATIONS))
    for a in range(0, first or n, step):
        rows = np.arange(a, min(a + step, first or n))
        cols = slice(first or a, n)
        differ = signs[rows, None, :] != signs[None, cols, :]
        parts = differ[:, :, : CHUNKS * CHUNK].reshape(len(rows), -1, CHUNKS, CHUNK)
        errors = parts.sum(axis=3, dtype=np.uint8)
        close = (errors <= 1).argmax(axis=2) == chunk  # the first chunk that both have a key of
        close &= (errors[:, :, chunk] == 1) & parts[:, :, chunk, left_out] | (errors[:, :, chunk] == 0) & (left_out == 0)
        close &= (errors.sum(axis=2, dtype=np.uint8) <= NEAR) | (differ.sum(axis=2, dtype=np.uint8) <= FAR)
        i, j = np.nonzero(close)
        j = j + (first or a)
        pairs = rows[i] < j
        out[rows[i[pairs]]] = out[j[pairs]] = True
    return out


def jobs_of(sizes: list[int], most: int) -> list[list[int]]:
    """Members in jobs, by their sizes in bytes: any two meet in one, and a job holds at most ``most`` bytes or two members."""
    if sum(sizes) <= most or len(sizes) < 3:
        return [list(range(len(sizes)))]
    parts, held = [[]], 0
    for k in sorted(range(len(sizes)), key=lambda k: sizes[k]):
        if parts[-1] and held + sizes[k] > most // 2:
            parts.append([])
            held = 0
        parts[-1].append(k)
        held += sizes[k]
    return [parts[0], *(a + b for i, b in enumerate(parts) for a in parts[:i])] if len(parts) > 1 else parts


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows that follow each other with equal first ``width`` values."""
    held, at = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:width] != at:
                if held:
                    yield held
                held, at = [], row[:width]
            held.append(row)
    if held:
        yield held


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: key, cell, place, half, class, signature, size, in order. Out: (job, class) of the members of pairs."""
    jobs, classes = [], []
    for run in _runs(batches, 2):
        if len(run) > 1:
            first = sum(r[3] == 0 for r in run) if run[-1][3] else 0
            if first == len(run) or run[0][3]:
                continue  # a cell of two blocks with one of them empty
            signs = np.frombuffer(b"".join(r[5] for r in run), "<u2").reshape(len(run), PERMUTATIONS)
            chosen = [r for r, x in zip(run, taken_up(signs, run[0][2], first), strict=True) if x]
            for k, members in enumerate(jobs_of([8 * r[6] for r in chosen], JOB_BYTES)):
                jobs += [xxhash.xxh3_64_intdigest(f"{run[0][0]}/{run[0][1]}/{k}") - (1 << 63)] * len(members)
                classes += [chosen[i][4] for i in members]
        if len(jobs) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.int64()), pa.array(classes, pa.int64())], names=["job", "class"])
            jobs, classes = [], []
    yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.int64()), pa.array(classes, pa.int64())], names=["job", "class"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["class", "shingles"])


def links_of(sets: list[np.ndarray], similarity: int = SIMILARITY) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs whose exact similarity reaches the bound.

    Shingles that one set alone has can't be shared: what is left is an incidence matrix, worked
    off in slices of columns, whose products with itself are the intersections.
    """
    n, root = len(sets), list(range(len(sets)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if 100 * both >= similarity * (sizes[0] + sizes[1] - both):
            yield 0, 1
        return
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[where]
    owner, place = owner[keep], column[where[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(place, (at, at + 4096))
        part = np.zeros((n, min(4096, int(shared.sum()) - at)), np.float32)
        part[owner[a:b], place[a:b] - at] = 1
        both += part @ part.T
    i, j = np.nonzero(np.triu(100 * both.astype(np.int64) >= similarity * (sizes[:, None] + sizes[None, :] - both.astype(np.int64)), 1))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            yield a, b


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: job, class, shingles, in order of jobs. Out: links (a, b)."""
    a, b = [], []
    for run in _runs(batches, 1):
        if len(run) > 1:
            sets = [np.frombuffer(r[2], np.uint64) for r in run]
            for i, j in links_of(sets):
                a.append(run[i][1])
                b.append(run[j][1])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of links (a, b): the smallest node that each can reach."""
    edges = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("low"))
        new = labels.join(near, labels["node"] == near["x"], "left").select("node", "label", F.least("label", F.coalesce("low", "label")).alias("mine"))
        # pointer jumping: the label's own label is as good
        to = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = new.join(to, new["mine"] == to["via"], "left").select("node", F.least("mine", F.coalesce("far", "mine")).alias("label"), (F.least("mine", F.coalesce("far", "mine")) != F.col("label")).cast("int").alias("moved"))
        new = stored(new, "labels")
        moved = new.agg(F.max("moved")).first()[0]
        dropped(labels)
        at = new.stored_at
        labels = new.select("node", "label")
        labels.stored_at = at
        if not moved:
            dropped(edges)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def numbered(docs: DataFrame, number: str) -> DataFrame:
    """docs with a number of each row that is the same in every later job, whatever executors are lost meanwhile.

    Rows of a plain scan of files are numbered by their file and their place in it, so nothing is copied; the list of
    files, which the driver holds anyway, is broadcast. Rows of anything else are stored with numbers first.
    """
    plain = docs._jdf.queryExecution().analyzed().toString().split("\n")
    if "_metadata" not in docs.columns and all(re.match(r"[\s:+-]*(Relation|Project|Filter|SubqueryAlias)\b", x) for x in plain if x):
        try:
            files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
            known = docs.sparkSession.createDataFrame(list(enumerate(files)), "file_number long, file_path string")
            placed = docs.select(*docs.columns, F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_place"))
            rows = placed.join(F.broadcast(known), F.col("row_file") == F.col("file_path"))
            return rows.select(*docs.columns, (F.shiftleft("file_number", 40) + F.col("row_place")).alias(number))
        except AnalysisException:
            pass  # files of a kind that has no places of rows
    return stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with its columns, and all rows that have no words.

    Rows are grouped by their own texts, whatever their doc_id: rows of one doc_id with different texts
    are different documents, repeated rows are copies of which one stays, and rows without doc_id are judged
    like any others. The first of a group, in the order of the rows' numbers, stays.
    """
    number = next(f"row_{k}" for k in range(len(docs.columns) + 1) if f"row_{k}" not in docs.columns)
    rows = numbered(docs, number)
    found = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"))
    gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias(number)), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST else gone, number, "left_anti").select(*docs.columns)


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per document: the size of its set, its component, and whether it is the one that stays."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(texts.mapInArrow(_signed, "doc_id long, n_shingles long, set_id binary, signature binary"), "signed")
    some = signed.where("set_id is not null and doc_id is not null")
    # equal sets have equal signatures, so any will do; copies combine before the shuffle
    grouped = stored(some.groupBy("set_id").agg(F.min("doc_id").alias("class"), F.count("*").alias("n"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size")), "classes")
    classes, members = grouped.select("class", "signature", "size"), grouped.select("set_id", "class", "n")
    filed = classes.mapInArrow(_filed, "key long, place int, class long")
    shared = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = filed.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select(
        "key", (F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")).alias("cell"), "place",
        F.when(F.col("own") == F.col("other"), 0).otherwise((F.col("own") > F.col("other")).cast("int")).alias("half"), "class",
    )
    cells = cells.join(classes, "class").select("key", "cell", "place", "half", "class", "signature", "size")
    jobs = stored(cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "half", "class").mapInArrow(_close, "job long, class long"), "jobs")
    wanted = kept_ids = stored(jobs.select("class").distinct(), "wanted")
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    sets = texts.join(wanted, texts["doc_id"] == wanted["class"], "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(_sets, "class long, shingles binary")
    full = jobs.join(sets, "class").select("job", "class", "shingles")
    links = full.repartition("job").sortWithinPartitions("job", "class").mapInArrow(_confirmed, "a long, b long")
    found = components(links.where("a <> b").distinct())
    for x in (jobs, kept_ids):
        dropped(x)
    of = members.join(found, members["class"] == found["node"], "left").where("n > 1 or component is not null")
    of = stored(of.select(F.col("set_id").alias("sid"), F.coalesce("component", "class").alias("component_id"), F.col("n") * HEAVY >= signed.count()), "of").toDF("sid", "component_id", "heavy")
    slim = signed.select("doc_id", "n_shingles", "set_id")
    few = F.broadcast(of.where("heavy").drop("heavy"))  # at most HEAVY rows
    same = F.col("set_id") == F.col("sid")
    of_heavy = slim.join(few, same)
    of_others = slim.where("set_id is not null").join(few, same, "left_anti").join(of.where("not heavy"), same, "left")
    without = slim.where("set_id is null").withColumn("component_id", F.lit(None).cast("long"))
    columns = ("doc_id", "n_shingles", "component_id")
    out = of_heavy.select(*columns).union(of_others.select(*columns)).union(without.select(*columns))
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
