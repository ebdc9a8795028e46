"""Containers: what is written reads back the same."""

import random

import pytest

from brookwave.plans import containers
from brookwave.sources import bitio, boxes_write, configs, loas, movies
from brookwave.sources.media import boxes_of
from tests.comparing import SF


def test_bits_read_as_written():
    r = random.Random(5)
    for _ in range(50):
        fields = [(r.getrandbits(n), n) for n in (r.randint(1, 40) for _ in range(30))]
        w = bitio.BitWriter()
        for v, n in fields:
            w.write(v, n)
        reader = bitio.BitReader(w.bytes())
        assert [reader.read(n) for _, n in fields] == [v for v, _ in fields]
        with pytest.raises(bitio.Truncated):
            reader.read(9)
    assert bitio.BitReader(b"\xf0").signed(4) == -1 and bitio.BitReader(b"\x70").signed(4) == 7


def test_checksums():
    data = bytes(range(1, 60))
    as_bits = int.from_bytes(data, "big")
    assert bitio.crc16(data) == bitio.crc(as_bits, 8 * len(data), 0x8005, 16, 0xFFFF)
    assert bitio.crc16(b"123456789") == 0xAEE7  # published check value of this polynomial and start
    assert bitio.crc_of(b"123456789", 0x07, 8, 0) == 0xF4 == bitio.crc8_bits(int.from_bytes(b"123456789", "big"), 72)


def test_tables_of_checksums_are_made_once(spark, monkeypatch):
    want = bitio.crc_of(b"abc", 0x1021, 16, 0)
    monkeypatch.setattr(bitio, "_table", None)
    assert bitio.crc_of(b"abc", 0x1021, 16, 0) == want == bitio.crc(0x616263, 24, 0x1021, 16, 0)
    assert bitio.crc_of(b"123456789", 0x07, 8, 0) == 0xF4
    assert containers.checksums(spark, SF).rdd.getNumPartitions() > 1  # a small file is one task


@pytest.mark.parametrize("sbr,ps", [(False, False), (True, False), (True, True)])
@pytest.mark.parametrize("channels", [1, 2, 6, 8])
def test_configurations(sbr, ps, channels):
    got = configs.parsed(configs.built(2, 24000, channels, sbr, ps))
    assert got == {"object_type": 2, "rate": 24000, "channels": channels, "frame": 1024, "sbr": sbr, "ps": ps, "output_rate": 48000 if sbr else 24000, "elements": got["elements"], "error": None}


def test_faulty_and_trailing_configurations(spark):
    trailing = bitio.BitWriter().put(configs.built(2, 24000, 1)).write(0x2B7, 11).write(5, 5).write(1, 1).write(3, 4).write(0x548, 11).write(1, 1).bytes()
    rows = [(bytearray(x),) if x is not None else (None,) for x in (configs.built(2, 44100, 2), trailing, b"", b"\x12", b"\xf8\x00\x00", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(configs.configuration(__import__("pyspark.sql.functions").sql.functions.col("b"))).collect()]
    assert (got[0].rate, got[0].error, got[1].output_rate, got[1].sbr, got[1].ps) == (44100, None, 48000, True, True)
    assert [x.error for x in got[2:5]] == ["truncated", "truncated", "object type"] or all(x.error for x in got[2:5])
    assert got[5] is None


def test_packets(spark):
    units = [bytes([k]) * (k * 37 % 600) for k in range(40)]
    config = configs.built(2, 48000, 2)
    stream = b"noise" + b"".join(loas.packet(config, 16, units[k : k + 4]) for k in range(0, 40, 4))
    d = spark.createDataFrame([("a", bytearray(stream)), ("b", bytearray(stream[:-1])), ("c", bytearray(b"")), ("d", None)], "path string, content binary")
    rows = loas.loas_units(d).collect()
    assert [bytes(r.payload) for r in rows if r.path == "a"] == units and not any(r.error for r in rows)
    assert [bytes(r.payload) for r in rows if r.path == "b"] == units[:36]  # the partial tail goes
    assert {bytes(r.config) for r in rows} == {config} and {r.path for r in rows} == {"a", "b"}
    same = (0x2B7 << 13 | 2).to_bytes(3, "big") + b"\x80\x00"
    assert [r[-1] for r in loas.units_of(same)] == ["no configuration"]


def test_files_of_boxes(spark):
    r = random.Random(9)
    streams = {s: [r.randbytes(r.randint(0, 300)) for _ in range(n)] for s, n in (("x", 57), ("y", 1))}
    d = spark.createDataFrame([(s, k, bytearray(u)) for s, us in streams.items() for k, u in enumerate(us)], "stream_id string, au_idx long, payload binary").repartition(4)
    made = boxes_write.m4a_files(d, 48000, 2, priming=1000)
    files = made.selectExpr("stream_id as path", "content")
    assert {x.stream_id: x.error for x in made.collect()} == {"x": None, "y": None}
    found = movies.first_usable(movies.tracks(files))
    facts = {x.path: x for x in found.collect()}
    assert bytes(facts["x"].config) == configs.built(2, 48000, 2) and facts["x"].timescale == 48000 and facts["x"].edit_start == 1000
    assert {x.path: (x.coded, x.priming, x.valid) for x in movies.presented(found).collect()} == {"x": (57 * 1024, 1000, 57 * 1024 - 1000), "y": (1024, 1000, 24)}
    got = movies.with_payloads(files, movies.units(found)).orderBy("path", "au_idx").collect()
    assert [(x.path, bytes(x.payload)) for x in got] == [(s, u) for s, us in streams.items() for u in us]


def test_several_runs_of_chunks(spark):
    rows = [("a", 0, "soun", None, b"\x11\x90", [(1, 2), (3, 1)], [5, 6, 7, 8, 9], 0, 5, [100, 200, 300])]
    d = spark.createDataFrame(rows, "path string, track int, handler string, error string, config binary, stsc array<struct<first:long,per:long>>, sizes array<long>, size_of_all long, n_sizes long, chunks array<long>")
    got = [(x.au_idx, x.offset, x["size"]) for x in movies.units(d).orderBy("au_idx").collect()]
    assert got == [(0, 100, 5), (1, 105, 6), (2, 200, 7), (3, 207, 8), (4, 300, 9)]


def test_limits():
    with pytest.raises(ValueError):
        boxes_write.m4a([b"x"], configs.built(2, 48000, 2), priming=2000)
    with pytest.raises(ValueError):
        boxes_write.m4a([b"x"], b"")
    with pytest.raises(ValueError):
        loas.packet(configs.built(2, 48000, 2), 16, [])
    assert [x[3] for x in boxes_of(boxes_write.m4a([], configs.built(2, 48000, 2)))][:3] == ["ftyp", "mdat", "moov"]
    assert movies.varint_at(boxes_write.varint(300), 0) == (300, 4)
    broken = bytearray(boxes_write.m4a([b"abc"], configs.built(2, 48000, 2)))
    at = broken.find(b"stsz")
    broken[at + 12 : at + 16] = b"\x7f\xff\xff\xff"
    assert [t["error"] for t in movies.tracks_of("p", bytes(broken))] == ["table longer than its box"]


def test_small_files_share_batches():
    import pyarrow as pa
    from brookwave.sources import media

    config = configs.built(2, 48000, 2)
    data = [boxes_write.m4a([bytes(k)], config) for k in range(1, 101)]
    files = [pa.RecordBatch.from_pydict({"path": list(map(str, range(k, k + 50))), "content": data[k : k + 50]}) for k in (0, 50)]
    made = list(media._exploded(media.boxes_of, media._arrow(media.BOXES))(iter(files)))
    assert len(made) == 1 and made[0].column(0).to_pylist() == [str(k) for k, d in enumerate(data) for _ in media.boxes_of(d)]
    long = pa.RecordBatch.from_pydict({"path": ["x"], "content": [boxes_write.box(b"free") * 10_000]})
    assert [b.num_rows for b in media._exploded(media.boxes_of, media._arrow(media.BOXES))(iter([long]))] == [4096, 4096, 1808]
    assert [x[3] for x in media.boxes_of(data[0], deepest=0)] == ["ftyp", "mdat", "moov"]
    assert list(media.boxes_of(data[0], deepest=1)) == [x for x in media.boxes_of(data[0]) if x[4] < 2]


def test_remembered_indices():
    config, other = configs.built(2, 48000, 2), configs.built(2, 24000, 1, True)
    for c, u in ((config, [b"ab", b"c"]), (other, [b"ab", b"c"]), (config, [b"x", b"yyy"]), (config, [b"z"] * 1500)):  # the last is not remembered
        t = next(movies.tracks_of("", boxes_write.m4a(u, c)))
        assert (t["sizes"], t["config"], t["chunks"]) == ([*map(len, u)], c, [36])
    kept = configs.parsed(config)
    kept["rate"] = 1
    assert configs.parsed(config)["rate"] == 48000


def test_units_lie_by_their_tables_without_a_shuffle(spark):
    runs = [{"first": 1, "per": 2}, {"first": 3, "per": 1}]
    assert list(movies._placed([100, 200, 300, 400], runs, [5, 6, 7, 8, 9, 10, 11], 0, 7)) == [(0, 100, 5), (1, 105, 6), (2, 200, 7), (3, 207, 8), (4, 300, 9), (5, 400, 10)]
    assert list(movies._placed([100, 200], runs, [], 4, 3)) == [(0, 100, 4), (1, 104, 4), (2, 200, 4)]
    assert list(movies._placed([100, 200, 300], [{"first": 2, "per": 1}, {"first": 1, "per": 2}], [1] * 9, 0, 9)) == [(0, 100, 1), (1, 101, 1), (2, 200, 1), (3, 201, 1), (4, 300, 1), (5, 301, 1)]
    assert list(movies._placed(None, None, None, None, None)) == [] == list(movies._placed([1], [{"first": 2, "per": 1}], [1], 0, 1))
    for query in (containers.file_units, containers.file_timing):  # the one that builds the streams
        assert query(spark, SF)._jdf.queryExecution().sparkPlan().toString().count("Window") == 1
        assert query(spark, SF)._jdf.queryExecution().toString().count("Exchange hashpartitioning") == 1


def test_the_first_usable_track(spark):
    a, b = (boxes_write.movie([4], 36, configs.built(2, 48000, n), n, 48000, 1024, 0, 1024) for n in (1, 2))
    trak = lambda m: m[m.index(b"trak") - 4 :]
    both = boxes_write.box(b"moov", a[8 : a.index(b"trak") - 4], trak(a).replace(b"soun", b"vide"), trak(a), trak(b))
    files = spark.createDataFrame([("x", bytearray(both)), ("y", bytearray(b)), ("z", None)], "path string, content binary")
    assert [(r.path, r.track, r.usable) for r in movies.tracks(files).orderBy("path", "track").collect()] == [("x", 0, False), ("x", 1, True), ("x", 2, False), ("y", 0, True)]
    assert [(r.path, r.track) for r in movies.first_usable(movies.tracks(files)).orderBy("path").collect()] == [("x", 1), ("y", 0)]


def test_files_made_together_are_those_made_alone():
    import pyarrow as pa

    config, r = configs.built(2, 24000, 2), random.Random(3)
    lists = [[r.randbytes(r.randint(0, 60)) for _ in range(r.randint(1, 7))] for _ in range(50)] + [[], [b"x"], [b"", b""], [None, b"y"], [b"z"] * (boxes_write.FEW_UNITS + 1)]
    for priming in (0, 1024, 2000):
        column = pa.array([[b"cut"]] * 3 + lists, pa.list_(pa.binary()))[3:]
        got = list(boxes_write._m4a_each(list(range(len(lists))), column, config, priming))
        for (_, content, error), parts in zip(got, lists, strict=True):
            try:
                assert (content, error) == (boxes_write.m4a([x or b"" for x in parts], config, priming), None)
            except ValueError as e:
                assert (content, error) == (None, str(e))


def test_tracks_of_alike_indices_are_remembered(spark, monkeypatch):
    r = random.Random(6)
    config = configs.built(2, 24000, 2)
    files = [boxes_write.m4a([r.randbytes(r.randint(0, 60)) for _ in range(n)], config, 1024) for n in (1, 2, 3) for _ in range(20)]
    files += [b"", files[0] + files[1], files[0][:-3], boxes_write.m4a([], config)] + [files[0][:k] + bytes([files[0][k] ^ 1]) + files[0][k + 1 :] for k in range(30, len(files[0]), 3)]
    rows = spark.createDataFrame([(str(k), bytearray(f)) for k, f in enumerate(files + files)], "path string, content binary").coalesce(1)
    got = sorted((int(x.path), x.track, x.handler, x.config, x.sizes, x.n_sizes, x.chunks, x.stts, x.edit_start, x.edit_duration, x.error, x.usable) for x in movies.tracks(rows).collect())
    want = []
    for k, f in enumerate(files + files):
        found = False
        for t in movies.tracks_of("", f):
            usable = not found and t["handler"] == "soun" and t["config"] is not None and not t["error"]
            found = found or usable
            want.append((k, t["track"], t["handler"], t["config"], t["sizes"], t["n_sizes"], t["chunks"], t["stts"], t["edit_start"], t["edit_duration"], t["error"], usable))
    assert [tuple(list(map(tuple, v)) if n == 7 and v is not None else bytes(v) if n == 3 and v is not None else v for n, v in enumerate(x)) for x in got] == sorted(want, key=lambda x: x[:2])
    seen = movies.Remembered()
    for f in files[:60]:
        index = movies._lone_index(f)
        if seen.of(index) is None:
            seen.add(index, movies.unread(index), (1,))
    assert seen.n == 3  # one a number of units


def test_multiplex_configurations_are_parsed_once(monkeypatch):
    config, units = configs.built(2, 48000, 2), [b"a" * n for n in (0, 3, 254, 255, 600)]
    stream = b"".join(loas.packet(config, 16, units[k : k + 2]) for k in (0, 2, 4)) + loas.packet(configs.built(2, 24000, 1, True), 25, units)
    odd = [stream[:k] + bytes([stream[k] ^ x]) + stream[k + 1 :] for k in range(16) for x in (1, 2, 16, 128)] + [stream[:k] for k in range(0, 30)]
    monkeypatch.setattr(loas, "_SEEN", {})
    got = [list(loas.units_of(d)) for d in [stream, *odd, stream]]
    assert [x[6] for x in got[0]] == units + units and got[0] == got[-1]
    calls = []
    monkeypatch.setattr(loas, "mux_config", lambda r, f=loas.mux_config: calls.append(1) or f(r))
    assert list(loas.units_of(stream)) == got[0] and not calls
    monkeypatch.setattr(loas, "_remembered", loas.mux_config)
    assert got == [list(loas.units_of(d)) for d in [stream, *odd, stream]]


def test_frames_are_tiled_without_a_join(spark):
    plan = containers.tiled_frames(spark, SF)._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_sorted_units_are_not_sorted_again(spark):
    """A hash aggregation would fall back to sorting all rows twice more, held beside the window's own."""
    for query in (containers.frame_walk, containers.packet_walk, containers.file_timing):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortAggregate") == 1 and "HashAggregate" not in plan and plan.count("Sort [") == 1


def test_framed_units_are_joined_once(spark):
    """A fold would copy a stream once for each of its units."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    units = [(s, k, bytearray(r.randbytes(r.randint(0, 40)))) for s, n in (("x", 300), ("y", 1), ("z", 2)) for k in range(n)] + [("n", 0, bytearray(b"a")), ("n", 1, None), ("t", 0, bytearray(b"b")), ("t", 0, bytearray(b"a"))]
    d = spark.createDataFrame(r.sample(units, len(units)), "stream_id string, au_idx int, payload binary").repartition(4)
    made = boxes_write.framed_streams(d, F.unhex(F.lpad(F.hex("au_idx"), 4, F.lit("0"))), F.col("payload"))
    want = {s: b"".join(k.to_bytes(2, "big") + u for t, k, u in units if t == s) for s in "xyz"} | {"n": None, "t": b"\0\0a\0\0b"}
    assert {x.stream_id: (x.content and bytes(x.content), x.n) for x in made.collect()} == {s: (c, sum(u[0] == s for u in units)) for s, c in want.items()}
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
