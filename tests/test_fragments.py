"""Fragmented files, probes and their push readers: faults, tags, and any cut into chunks."""

import pickle
import random
import struct

import pytest

from brookwave.plans.fragmented import CONFIG, INIT, fragmented
from brookwave.sources import boxes_write, configs, fragments, loas, probes
from brookwave.sources.media import boxes_of
from brookwave.streaming.push import Fragments, Packets, push_fragments, push_packets

PARTS = [bytes([k]) * (k % 7 + 1) for k in range(11)]
WHOLE = fragmented(PARTS)


def facts(data):
    return dict(zip([x.split()[0] for x in probes.PROBE.split(", ")[1:]], next(probes.probed(data)), strict=True))


def pieces(data, rng, most=97):
    out, at = [], 0
    while at < len(data):
        n = rng.randint(1, most)
        out.append(data[at : at + n])
        at += n
    return out


def pushed(reader, parts):
    rows = []
    for p in parts:
        rows += reader.push(p)
        reader = pickle.loads(pickle.dumps(reader))  # as a restart from the state does
    return rows + list(reader.finish())


def test_samples_are_the_units():
    rows = list(fragments.samples_of(WHOLE))
    assert [WHOLE[r[2] : r[2] + r[3]] for r in rows] == PARTS
    assert all(r[6] is None for r in rows)


@pytest.mark.parametrize(
    "data, fault",
    [
        (b"", "no index"), (INIT, "no fragments"), (WHOLE[len(INIT) :], "no index"), (WHOLE[:-1], "truncated"),
        (INIT + fragments.fragment_bytes([b"a"], 1, len(INIT), 0, 512, True) + fragments.fragment_bytes([b"a"], 3, len(INIT), 0, 512, False), "sequence"),
        (INIT + fragments.fragment_bytes([b"a"], 1, 5, 0, 512, True), "outside the media"),
        (INIT + fragments.fragment_bytes([b"a"], 1, len(INIT), 0, 0, True), "duration"),
    ],
)
def test_faults_are_the_last_row(data, fault):
    assert list(fragments.samples_of(data))[-1][6] == fault


def test_a_fragment_without_base_goes_on_where_data_ended():
    data = fragments.fragment_bytes([b"abc"], 1, len(INIT), 0, 512, False)
    second = bytearray(fragments.fragment_bytes([b"de"], 2, 0, 0, 512, False))
    at = second.index(b"tfhd") + 4
    second[at : at + 4] = struct.pack(">I", fragments.OWN_DURATION)  # neither a base nor from its position
    at = second.index(b"trun") + 12
    second[at : at + 4] = struct.pack(">i", len(second) - 2)  # relative to the end of the data before
    whole = INIT + data + bytes(second)
    rows = list(fragments.samples_of(whole))
    assert [whole[r[2] : r[2] + r[3]] for r in rows] == [b"abc", b"de"]


def test_fragmented_is_told_from_flat_even_cut_short():
    assert fragments.is_fragmented(WHOLE) and fragments.is_fragmented(INIT)
    assert fragments.is_fragmented(INIT[:-8])
    assert not fragments.is_fragmented(boxes_write.m4a(PARTS, CONFIG)) and not fragments.is_fragmented(b"")


@pytest.mark.parametrize("seed", range(12))
def test_any_cut_gives_the_same_samples(seed):
    assert pushed(Fragments(1 << 16), pieces(WHOLE, random.Random(seed))) == list(fragments.samples_of(WHOLE))


@pytest.mark.parametrize("seed", range(12))
def test_any_cut_gives_the_same_packets(seed):
    rng = random.Random(seed)
    data = b"".join((b"xy" if k % 4 == 3 else b"") + loas.packet(CONFIG, 16, PARTS[k : k + 2]) for k in range(0, 11, 2))
    want = [(n, k, at, None if p is None else len(p), e) for n, k, at, _, _, _, p, e in loas.units_of(data)]
    assert len(want) == 11
    assert pushed(Packets(1 << 14), pieces(data, rng)) == want


def test_push_ends():
    assert pushed(Fragments(1 << 16), [WHOLE[:-1]])[-1][6] == "truncated"
    assert pushed(Fragments(100), [WHOLE[:200]])[-1][6] == "buffer"
    assert pushed(Fragments(1 << 16), [])[-1][6] == "no index"
    packet = loas.packet(CONFIG, 16, [b"abc"])
    assert pushed(Packets(1 << 14), [packet + packet[:-1]])[-1][4] == "truncated"


def test_probes():
    frame = (0xFFF1 << 40 | 1 << 38 | 3 << 34 | 2 << 30 | 16 << 13 | 0x7FF << 2).to_bytes(7, "big") + bytes(9)
    assert facts(frame)["duration"] == "unknown" and facts(frame)["channels"] == 2
    assert facts(b"")["error"] == "need more" and facts(b"ID3\x04\0\0\0\0\0\x09" + frame)["error"] is not None
    item = b" 00000000 00000064 00000064 0000000000000338"
    tagged = boxes_write.box(b"----", boxes_write.full_box(b"mean", 0, 0, probes.OWNER), boxes_write.full_box(b"name", 0, 0, probes.NAME), boxes_write.full_box(b"data", 0, 1, bytes(4), item))
    moov = boxes_write.movie([3], 36, CONFIG, 2, 24000, 1024, 0, 1024)
    at = moov.index(b"edts") - 4
    bare = bytearray(moov[8:])
    del bare[at - 8 : at - 8 + struct.unpack_from(">I", moov, at)[0]]
    k = bytes(bare).index(b"trak") - 4
    bare[k : k + 4] = struct.pack(">I", len(bare) - k)
    udta = boxes_write.box(b"udta", boxes_write.full_box(b"meta", 0, 0, boxes_write.box(b"ilst", tagged)))
    brand = boxes_write.box(b"ftyp", b"M4A \0\0\2\0M4A mp42isom")
    got = facts(brand + boxes_write.box(b"moov", bytes(bare), udta))
    assert (got["error"], got["trim"], got["priming"], got["remainder"], got["samples"]) == (None, "exact", 100, 100, 824)
    twice = facts(brand + boxes_write.box(b"moov", bytes(bare), udta, udta))  # two items say nothing
    assert (twice["trim"], twice["duration"], twice["samples"]) == ("unknown", "exact", 1024)


def test_pushed_streams(spark, tmp_path):
    spark.createDataFrame([("a", k, p) for k, p in enumerate(pieces(WHOLE, random.Random(1)))] + [("a", 10_000, None)], "stream_id string, seq long, chunk binary").write.parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema("stream_id string, seq long, chunk binary").parquet(str(tmp_path / "in"))
    q = push_fragments(chunks).writeStream.format("memory").queryName("pushed_fragments").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r)[1:] for r in spark.table("pushed_fragments").collect())
    assert got == sorted(fragments.samples_of(WHOLE))


def test_tags_are_read_once(spark):
    from brookwave.plans import fragmented, rules
    from tests.comparing import SF

    plan = lambda q: q(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(rules.tags_read).count("split(") == 1
    assert fragmented.probe_packets(spark, SF).rdd.getNumPartitions() > 1  # a small file is one task


def test_steps_by_table_equal_the_formula(spark):
    from pyspark.sql import functions as F

    from brookwave.functions import replication as R

    rows = spark.range(1, R.BANDS + 1).select(F.col("id").alias("least"), F.explode(F.sequence(F.lit(0), F.lit(R.STEPS - 1))).alias("p"))
    border = lambda p: R.nearest(F.col("least") * F.pow(R.BANDS / F.col("least"), p / R.STEPS))
    steps = {}
    for r in rows.select("least", (border(F.col("p") + 1) - border(F.col("p"))).alias("step")).collect():
        steps.setdefault(r.least, []).append(r.step)
    assert all(R.taken_of(m) == [sum(sorted(x)[:k]) for k in range(R.STEPS + 1)] for m, x in steps.items()) and len(steps) == R.BANDS
    end = spark.createDataFrame([(r, k) for r in (8000, 16000, 44100, 96000) for k in (-1, 0, 5, 13, 14, 15, 16)], "r int, k int")
    got = {(x.r, x.k): x.e for x in end.select("r", "k", R.end_band(F.col("r"), F.col("k"), F.lit(10)).alias("e")).collect()}
    assert [got[16000, k] for k in (-1, 0, 14, 15, 16)] == [None, 48, 20, 30, None] and got[8000, 5] == 64


def test_probes_of_alike_indices_are_remembered(monkeypatch):
    r = random.Random(4)
    files = [boxes_write.m4a([r.randbytes(r.randint(1, 60)) for _ in range(n)], CONFIG, 1024) for n in (1, 2, 3) for _ in range(20)] + [WHOLE, fragmented(PARTS[:4]), INIT]
    odd = [f[:k] + bytes([f[k] ^ x]) + f[k + 1 :] for f in (files[0], files[30], WHOLE) for k in range(len(f)) for x in (1, 0x80)] + [f[:-k] for f in (files[0], WHOLE) for k in range(1, len(f), 7)]
    odd += [files[0] + files[1], files[0] + WHOLE, WHOLE + files[0], files[0] + boxes_write.box(b"moof"), boxes_write.box(b"moof") + files[0]]
    got = [next(probes.probed(f)) for f in files + odd + files]
    monkeypatch.setattr(probes, "_movie", probes._whole_movie)
    assert got == [next(probes.probed(f)) for f in files + odd + files]
    monkeypatch.undo()
    calls = []
    monkeypatch.setattr(probes, "_SEEN", type(probes._SEEN)())
    monkeypatch.setattr(probes, "_whole_movie", lambda d, f=probes._whole_movie: calls.append(1) or f(d))
    assert [next(probes.probed(f)) for f in files] == got[: len(files)] and len(calls) == 4  # one a number of units, one of fragments


def test_layouts_of_fragments_are_remembered(monkeypatch):
    """Against a plain walk over all boxes, for whole and faulty files."""

    def plainly(data, top, index):
        held = None
        for at, size, head, kind, depth, _, fault in fragments.boxes_of(data):
            if fault:
                raise fragments.Fault(fault)
            if depth == 0:
                if held:
                    yield *held, None
                held = (at, at + size, []) if kind == "moof" else None
            elif held:
                held[2].append((kind, data[at + head : at + size]))
        if held:
            yield *held, None

    files = [WHOLE, fragmented(PARTS, 2), WHOLE + boxes_write.box(b"udta", b"\0\0\0\2free"), WHOLE + INIT, fragmented([])]
    files += [WHOLE[:k] + bytes([WHOLE[k] ^ x]) + WHOLE[k + 1 :] for k in range(len(INIT) - 60, len(WHOLE)) for x in (1, 0x40)] + [WHOLE[:k] for k in range(len(INIT), len(WHOLE), 5)]
    monkeypatch.setattr(fragments, "_LAYOUTS", fragments.Layouts())
    got = [list(fragments.samples_of(f)) for f in files + files]
    monkeypatch.setattr(fragments, "_fragments", plainly)
    assert got == [list(fragments.samples_of(f)) for f in files + files]
    walks, known = [], fragments.Layouts()
    monkeypatch.setattr(fragments, "boxes_of", lambda d, *a, f=fragments.boxes_of, **k: walks.append(1) or f(d, *a, **k))
    data = fragments.fragment_bytes([b"a", b"bc"], 1, 0, 0, 512, True), fragments.fragment_bytes([b"xyz", b"d"], 9, 77, 512, 512, True)
    for d in data:
        n = struct.unpack_from(">I", d)[0]
        assert [k for k, _ in known.inside(d, 0, n)] == ["mfhd", "traf", "tfhd", "tfdt", "trun"] and known.inside(d, 0, n)[0][1] == d[16:24]
    assert len(walks) == 1


def test_runs_end_as_they_say():
    head = lambda flags, n: struct.pack(">II", flags, n)
    assert list(fragments.run(head(0, 2))[1]) == [(None, None)] * 2
    assert list(fragments.run(head(fragments.SIZES | fragments.FLAGS, 2) + struct.pack(">4I", 5, 0, 6, 0))[1]) == [(None, 5), (None, 6)]
    short = fragments.run(head(fragments.DURATIONS | fragments.SIZES, 2) + struct.pack(">3I", 1, 2, 3))[1]
    assert next(short) == (1, 2)
    with pytest.raises(struct.error):
        next(short)
    with pytest.raises(fragments.Fault):
        list(fragments.run(head(fragments.COMPOSITION, 1) + struct.pack(">I", 1))[1])


@pytest.mark.parametrize("n", [0, 1, 3, 1500])
@pytest.mark.parametrize("duration", [None, 512])
def test_fragments_by_layout(n, duration):
    for own in (False, True):
        units = [bytes(k % 7) for k in range(n)]
        data = fragments.fragment_bytes(units, 4, 1000, 77, duration, own)
        parts = {k: data[a + h : a + s] for a, s, h, k, *_ in boxes_of(data)}
        assert parts["mfhd"][4:] == struct.pack(">I", 4) and fragments.decode_time(parts["tfdt"]) == 77 and parts["mdat"] == b"".join(units)
        assert fragments.fragment_header(parts["tfhd"]) == {"track": 1, "base": 1000 if own else None, "description": None, "duration": duration, "size": None, "empty": False, "from_moof": not own}
        offset, samples = fragments.run(parts["trun"])
        assert [s for _, s in samples] == [*map(len, units)] and offset == len(data) - len(parts["mdat"])


def test_fragments_of_a_known_shape_are_not_parsed_again(monkeypatch):
    monkeypatch.setattr(fragments, "_LAYOUTS", fragments.Layouts())
    want = list(fragments.samples_of(WHOLE))
    monkeypatch.setattr(fragments, "run", None)  # the plain way
    assert list(fragments.samples_of(WHOLE)) == want and want[-1][6] is None


def test_framed_streams_are_built_and_counted_at_once(spark):
    from brookwave.plans import fragmented as plans
    from tests.comparing import SF

    plan = plans.probe_framed(spark, SF)._jdf.queryExecution()
    assert plan.toString().count("Exchange hashpartitioning") == 1 and plan.sparkPlan().toString().count("Window") == 1
    assert plan.optimizedPlan().toString().count("array_join(") == 1  # a tag is put together once
