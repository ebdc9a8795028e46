import random
import struct

from brookwave.sources import media
from brookwave.streaming.push import advanced, push_frames


def frame(payload, fs=3, ch=2, profile=1):
    w = (0xFFF1 << 40) | profile << 38 | fs << 34 | ch << 30 | (7 + len(payload)) << 13 | 0x7FF << 2
    return w.to_bytes(7, "big") + payload


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


STREAM = b"".join(frame(bytes([k]) * (k * 7 % 40)) for k in range(50))
FILE = box(b"ftyp", b"M4A \0\0\0\0") + box(b"moov", box(b"trak", box(b"mdia", b"")) + box(b"mvex", b"")) + box(b"mdat", b"12345")


def test_sources(spark):
    d = spark.createDataFrame([("a", bytearray(STREAM)), ("b", bytearray(FILE)), ("c", bytearray(b"\x56\xe0\x00")), ("d", bytearray(b"")), ("e", None), ("f", bytearray(b"junk" + STREAM + STREAM[:5]))], "path string, content binary")
    assert {r.path: r.c for r in d.select("path", media.container(d["content"]).alias("c")).collect()} == {"a": "adts", "b": "isobmff", "c": "latm", "d": None, "e": None, "f": None}
    frames = media.adts_frames(d).collect()
    assert sum(r.path == "a" for r in frames) == 50 == sum(r.path == "f" for r in frames)
    assert all(r.sample_rate == 48000 and r.ch_cfg == 2 and len(r.payload) == r.au_idx * 7 % 40 for r in frames)
    assert {r.path: r.frames for r in media.exact_frames(d).collect()} == {"a": 50, "b": None, "c": None, "d": None, "e": None, "f": None}
    assert [(r.type, r.depth) for r in media.boxes(d.where("path = 'b'")).collect()] == [("ftyp", 0), ("moov", 0), ("trak", 1), ("mdia", 2), ("mvex", 1), ("mdat", 0)]


def test_faults():
    bad = bytearray(STREAM)
    bad[1] |= 2
    assert [r[-1] for r in media.frames_of(bytes(bad))] == ["layer"]
    assert next(iter(media.boxes_of(b"\0\0\0\2free")))[-1] == "size"


def test_files_of_over_a_million_frames(spark):
    n = (1 << 20) + 5
    d = spark.createDataFrame([("long", bytearray(frame(b"") * n))], "path string, content binary")
    assert [r.frames for r in media.exact_frames(d).collect()] == [n]


def test_frames_walked_together_are_those_walked_alone(monkeypatch):
    import pyarrow as pa

    r = random.Random(4)
    plain = [b"".join(frame(r.randbytes(r.randint(0, 50)), r.randint(0, 12), r.randint(0, 7)) for _ in range(n)) for n in range(8) for _ in range(40)]
    odd = [x[: -r.randint(1, 9)] for x in plain[60:90]] + [r.randbytes(9) + x + b"\xff" * 9 for x in plain[90:120]] + [STREAM * 9, b"", None]
    for x in plain[120:]:
        k = r.randrange(min(7, len(x)))
        odd.append(x[:k] + bytes([x[k] ^ 1 << r.randrange(8)]) + x[k + 1 :])
    r.shuffle(files := plain + odd)
    ways = ((media._frames_together, media.frames_of, media.FRAMES), (media._tiles_together, media.tiles_of, media.TILES))
    batch = pa.RecordBatch.from_arrays([pa.array([*map(str, range(len(files)))]), pa.array(files, pa.binary())], names=["path", "content"])
    for most in (media.TOGETHER, 3000):
        monkeypatch.setattr(media, "TOGETHER", most)
        for made, rows_of, ddl in ways:
            for b in (batch, batch.slice(50), batch.slice(0, 40), batch.slice(0, 2), batch.slice(0, 0)):
                got = [x for t in media._together(made, rows_of, ddl)(iter([b])) for x in t.to_pylist()]
                assert got == [x for t in media._exploded(rows_of, media._arrow(ddl))(iter([b])) for x in t.to_pylist()]
    monkeypatch.setattr(media, "frames_of", None)  # frames of plain files are found in as many steps as the longest has
    monkeypatch.setattr(media, "TOGETHER", 1 << 20)
    batch = pa.RecordBatch.from_pydict({"path": [*map(str, range(320))], "content": plain})
    assert next(media._together(*ways[0])(iter([batch]))).num_rows == 40 * sum(range(8))


def test_any_cut_gives_the_same_frames():
    whole = advanced(STREAM, 0, 0, 1 << 16)[0]
    for seed in range(20):
        r, at, buffer, taken, n, got = random.Random(seed), 0, b"", 0, 0, []
        while at < len(STREAM):
            size = r.choice((1, 7, 64))
            rows, buffer, taken, n, failed = advanced(buffer + STREAM[at : at + size], taken, n, 1 << 16)
            got += rows
            at += size
            assert not failed
        assert got == whole and len(got) == 50


def test_push_stream(spark, tmp_path):
    rows = [(s, k, bytearray(STREAM[k * 64 : k * 64 + 64])) for s in ("x", "y") for k in range(len(STREAM) // 64 + 1)]
    d = spark.createDataFrame(rows, "stream_id string, seq long, chunk binary")
    for part in range(3):
        d.where(f"seq % 1000 >= {part * 8} and seq < {(part + 1) * 8 if part < 2 else 10 ** 6}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = push_frames(chunks).writeStream.format("memory").queryName("pushed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("select stream_id, au_idx, frame_len from pushed where error is null order by 1, 2").collect()
    assert [(r[0], r[1], r[2]) for r in got] == [(s, k, 7 + k * 7 % 40) for s in ("x", "y") for k in range(50)]
