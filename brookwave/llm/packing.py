"""Packing: cost-balanced filling of fixed-length training sequences.

Every document becomes token ids and an end id. A sequence costs, over its pieces,
``linear * length + quadratic * length ** 2`` (attention stays inside a piece). Pieces of a
window of documents go, by descending cost, each to the sequence of lowest cost whose remaining
capacity holds it; a piece that none holds is cut, and its first part fills the sequence of
lowest cost that has room. A window holds as many tokens as its sequences, so each ends full:
no padding but in the last window of a partition, whose rest goes to sequences of the powers of
two that it is the sum of (a sequence of such a length is not padded).

One pass without a shuffle; memory is bounded by the window (2 M ids) and one document. A lost
task is packed anew with the same result, as its input split is the same.

Defined results: a null or empty text is its end id alone; rows with an equal doc_id are packed
each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwave.llm.shared import read, utf8

LENGTH = 4096
WINDOW_SEQUENCES = 512
END = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
MEMO = 1_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Chunks(dict):
    """Ids, as packed 16- or 32-bit numbers, by chunk between ASCII white space.

    The tokenizer drops white space and never joins across it, so equal chunks have equal ids. A
    chunk of letters is one piece; its merges run in a byte-pair merger built from the same
    merges (each byte before the end mark joins it first, as the file's word ends want). Both
    mergers agree because each token's own symbols merge back into it (see the tests); chunks
    that are not plain letters, or not yet normalised, go through the tokenizer itself, piece by piece.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.slow = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.kind = "<u2" if max(self.vocab.values()) < 1 << 16 and all(t["id"] < 1 << 16 for t in spec["added_tokens"]) else "<u4"
        self.merger = None
        if spec["model"].get("end_of_word_suffix") == MARK and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == SPLIT:
            ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
            for pair in spec["model"]["merges"]:
                ranks.setdefault(as_bytes("".join(pair) if isinstance(pair, list) else pair.replace(" ", "", 1)), len(ranks) + 1)
            self.merger = tiktoken.Encoding("merges", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            id_of = {ranks[k]: i for t, i in self.vocab.items() if (k := as_bytes(t)) in ranks}
            self.packed = {r: np.array([i], self.kind).tobytes() for r, i in id_of.items()}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        word = text.lower()
        head = word.rstrip(SIGNS)
        plain = self.merger and (not head or head.isalpha()) and (word.isascii() or is_normalized("NFC", text) and "\u03a3" not in text)
        if plain and len(head) == len(word):
            out = self._merged(word)
        elif plain and "<|" not in word:
            out = (self[head.encode()] if head else b"") + self._merged(word[len(head) :])
        else:
            out = np.array(self.slow([text], add_special_tokens=False)[0].ids, self.kind).tobytes()
        self[chunk] = out
        return out

    def _merged(self, piece: str) -> bytes:
        """Ids of one piece: a run of letters or of signs."""
        return b"".join([self.packed[r] for r in self.merger.encode_single_piece(piece.encode() + b"\xff")])

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text its ids, without the end id."""
        for text in texts:
            if len(self) > MEMO:
                self.clear()
            yield np.frombuffer(b"".join(map(self.__getitem__, utf8(text).split())), self.kind)


def as_bytes(token: str) -> bytes:
    """A token of the file as its bytes; the word-end mark as 255, which no text has."""
    end = token.endswith(MARK) and token != MARK
    return bytes(BYTE_OF[c] for c in (token[: -len(MARK)] if end else token) if c in BYTE_OF) + (b"\xff" if end else b"")


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


MARK = "</w>"
BYTE_OF = _byte_letters()
#: How the vocabulary's file says that it normalises and splits; another file goes through the tokenizer alone.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
#: ASCII signs without the apostrophe, which may begin a piece of its own.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def capacities(tokens: int, length: int) -> list[int]:
    """Sequences that hold exactly so many tokens: full ones, then falling powers of two."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assigned(lengths: list[int], room: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) of every part, by the rule above; sum(lengths) is sum(room)."""
    free, cost = np.array(room, dtype=np.int64), np.zeros(len(room))
    out = []
    todo = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    for i in todo:
        start, left = 0, lengths[i]
        while left:
            fits = np.flatnonzero(free >= left)
            at = fits if len(fits) else np.flatnonzero(free > 0)
            k = int(at[np.argmin(cost[at])])
            n = min(left, int(free[k]))
            out.append((i, start, n, k))
            free[k] -= n
            cost[k] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack_window(docs: list[tuple], length: int, first: int) -> tuple[list[tuple], int]:
    """docs: (doc_id, ids, start in the document, tokens of the document). Rows, and how many sequences."""
    rows, lengths, of, done = [], [], [], 0
    for d, (doc_id, ids, start, total) in enumerate(docs):
        whole = len(ids) // length * length
        for s in range(0, whole, length):  # a full sequence each
            rows.append((doc_id, start + s, length, zlib.crc32(ids[s : s + length].tobytes()), total, first + done, 0))
            done += 1
        if whole < len(ids):
            lengths.append(len(ids) - whole)
            of.append((d, whole))
    room = capacities(sum(lengths), length)
    offset = [0] * len(room)
    for i, s, n, k in assigned(lengths, room):
        d, base = of[i]
        doc_id, ids, start, total = docs[d]
        rows.append((doc_id, start + base + s, n, zlib.crc32(ids[base + s : base + s + n].tobytes()), total, first + done + k, offset[k]))
        offset[k] += n
    return rows, done + len(room)


@lru_cache(maxsize=1)
def _chunks(path: str) -> Chunks:
    """One per Python worker: its memo serves all of the worker's tasks."""
    return Chunks(path)


def _packed(path: str, length: int, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(path)
        held, tokens, next_id = [], 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        kinds = [pa.int64()] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), chunks.ids(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    held.append((doc_id, ids, 0, len(ids)))
                    tokens += len(ids)
                    while tokens >= window * length:
                        doc_id, ids, start, total = held.pop()
                        over = tokens - window * length
                        cut = len(ids) - over
                        rows, n = pack_window([*held, (doc_id, ids[:cut], start, total)], length, next_id)
                        next_id += n
                        yield batch(rows)
                        held, tokens = ([(doc_id, ids[cut:], start + cut, total)] if over else []), over
        if held:
            yield batch(pack_window(held, length, next_id)[0])

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, window_sequences: int = WINDOW_SEQUENCES, end: int = END) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packed(tokenizer_path, length, window_sequences, end), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())
