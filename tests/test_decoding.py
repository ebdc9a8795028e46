import numpy as np
import pytest
from pyspark.sql import functions as F

from brookwave.operators import decoding as D
from brookwave.operators import kernels as K
from brookwave.sources import blocks as B
from brookwave.sources.bitio import BitReader, BitWriter

RNG = np.random.default_rng(5)
C = B.ruled()


def channel(mode, q=40, noise=(), shaping=(), gain=110):
    n = len(mode.groups)
    books = [[B.NOISE if b in noise else 11 for b in range(mode.bands)] for _ in range(n)]
    scales = [[20 + b if b in noise else gain - b for b in range(mode.bands)] for _ in range(n)]
    c = B.Channel(mode, gain, books, scales, shaping=list(shaping), quant=np.zeros(B.windows(mode, C), int))
    for g, b, w, k, lo, hi in B.spans(mode, C):
        if books[g][b] == 11:
            c.quant[w : w + k, lo:hi] = RNG.integers(-q, q + 1, (k, hi - lo))
    return c


def single(*a, **k):
    return B.write_block([B.Element(B.SINGLE, 0, [channel(*a, **k)])], C)


def stream(n):
    """Blocks in lawful orders of windows, with noise."""
    kinds = [B.ONLY_LONG, B.START, B.SHORT, B.SHORT, B.STOP]
    return [single(B.Mode(kinds[k % 5], k // 3 % 2, 10, (2, 1, 5) if kinds[k % 5] == B.SHORT else (1,)), noise=(3, 7) if k % 3 else ()) for k in range(n)]


@pytest.mark.parametrize("book", B.BOOKS)
def test_tuples_come_back_at_their_cost(book):
    d, _, most = B.BOOKS[book]
    for _ in range(200):
        v = tuple(int(x) for x in RNG.integers(-most, most + 1, d) * (1 if book != 11 else RNG.choice([1, 500])))
        out = BitWriter()
        B.write_tuple(C, book, v, out)
        assert out.n == B.tuple_bits(C, book, v)
        bits = BitReader(out.bytes())
        assert tuple(B.read_tuple(C, book, bits)) == v and bits.at == out.n
    assert book == 11 or B.tuple_bits(C, book, (most + 1,) * d) is None


def test_blocks_come_back():
    for mode in (B.Mode(0, 1, 49), B.Mode(1, 0, 3), B.Mode(2, 1, 14, (3, 1, 1, 2, 1)), B.Mode(3, 0, 0)):
        shaping = [(4, [(5, 3, 1, 1, [3, -4, 1])])] + [(3, [])] * (sum(mode.groups) - 1)
        c = channel(mode, 8191 if mode.bands == 3 else 40, noise=(1, 2), shaping=shaping if mode.bands else [])
        pair = [channel(mode), channel(mode)]
        mask = [[(b + g) % 2 == 0 for b in range(mode.bands)] for g in range(len(mode.groups))]
        found = B.read_block(B.write_block([B.Element(B.SINGLE, 1, [c]), B.Element(B.PAIR, 2, pair, mask, True)], C), C)
        assert [e.tag for e in found] == [1, 2] and found[1].mask == mask
        for a, b in zip([c, *pair], [x for e in found for x in e.channels]):
            assert a.mode == b.mode and a.books == b.books and a.scales == b.scales and a.shaping == b.shaping and (a.quant == b.quant).all()


def test_fill_and_data_are_passed_over():
    body = BitReader(single(B.Mode(0, 0, 2)))
    out = BitWriter().write(B.FILL, 3).write(15, 4).write(3, 8).put(b"x" * 17).write(B.DATA, 3).write(0, 4).write(1, 1).write(2, 8)
    out.write(0, -out.n % 8).put(b"ab")
    out.write(body.read(body.left), len(body.data) * 8)
    assert len(B.read_block(out.bytes(), C)) == 1


@pytest.mark.parametrize("bits", [(B.COUPLED, 3), (B.PROGRAM, 3), (0, 3), (0b0000000_00000000_0_00_0_111111_0, 26), (0b0000000_00000000_0_00_0_000001_1, 26)])
def test_what_no_block_has_is_refused(bits):
    with pytest.raises(ValueError):
        B.read_block(BitWriter().write(*bits).bytes(), C)


def test_every_cut_block_is_an_error():
    data = single(B.Mode(0, 0, 20))
    for n in range(len(data) - 1):
        with pytest.raises(ValueError):
            B.read_block(data[:n], C)


def test_noise_has_its_energy_and_pairs_share_it():
    mode = B.Mode(0, 0, 6)
    pair = [channel(mode, noise=(2, 4)), channel(mode, noise=(2, 4, 5))]
    e = B.Element(B.PAIR, 0, pair, [[b == 2 for b in range(6)]], True)
    (left, right), state = B.spectra([e], C)
    assert np.isclose((left[0, 8:12] ** 2).sum(), 2 ** (22 / 2)) and np.allclose(left[0, 8:12], right[0, 8:12])
    assert not np.allclose(left[0, 16:20], right[0, 16:20])
    assert B.draws_of([e], C) == 4 * 4 and state == B.jumped(B.NOISE_SEED, 16)
    assert B.jumped(B.NOISE_SEED, 1000) == K.noise(B.NOISE_SEED, 1000, 1.0)[1]


def test_shaping_undoes_its_residual():
    mode = B.Mode(0, 0, 49)
    plain, filters = channel(mode), [(4, [(49, 2, 0, 0, [5, -3])])]
    x = B.rescaled(plain, C)
    plain.shaping = filters
    y = B.shaped(x, plain, C)
    a = K.step_up(np.sin(np.array([5, -3]) / np.array([7.5, 8.5]) * np.pi / 2))
    reach = C.long[42]
    assert np.allclose(K.all_zero(y[:, :reach], a[None]), x[:, :reach]) and (y[0, reach:] == x[0, reach:]).all()


@pytest.mark.parametrize("order", [[0, 0, 0], [0, 1, 2, 3, 0], [0, 1, 2, 2, 3]])
def test_windows_that_meet_give_the_signal_back(order):
    """Spectra of one signal, taken with the windows of the sequence, come back as that signal."""
    m, s, edge = 1024, 128, 448
    x = RNG.normal(size=m * (len(order) + 1))
    held, before = np.zeros(m), 0
    for k, sequence in enumerate(order):
        shape, part = k % 2, x[k * m : (k + 2) * m]
        rise, fall = B.half(before, m, False), B.half(shape, m, False)[::-1]
        short = [B.half(v, s, True) for v in (before, shape)]
        if sequence == B.SHORT:
            spectrum = np.array([K.mdct((part[edge + w * s :][: 2 * s] * np.concatenate([short[w > 0], short[1][::-1]]))[None])[0] for w in range(8)])
        else:
            if sequence == B.STOP:
                rise = np.concatenate([np.zeros(edge), short[0], np.ones(edge)])
            if sequence == B.START:
                fall = np.concatenate([np.ones(edge), short[1][::-1], np.zeros(edge)])
            spectrum = K.mdct((part * np.concatenate([rise, fall]))[None])
        first, second = B.halves(spectrum, B.Mode(sequence, shape, 0), before)
        if k:
            assert np.allclose(first + held, part[:m])
        held, before = second, shape


def test_pieces_equal_one_walk(spark):
    parts = stream(23)
    parts[9] = b"\x00"
    rows = [("a", k, p) for k, p in enumerate(parts) if k != 15] + [("b", 0, parts[1]), ("b", 1, None), (None, 0, parts[2]), ("c", None, parts[0])]
    d = spark.createDataFrame(rows, "stream_id string, au_idx int, payload binary").withColumn("piece", F.lit(1)).withColumn("drawn", F.lit("x"))
    want, held = {}, B.Held()
    for k, p in enumerate(parts):
        if k in (9, 15):
            held = B.Held(noise=held.noise)
        else:
            want[k], held = B.block_planes(p, C, held)
    for per in (1, 4, 100):
        got = {(r.stream_id, r.au_idx): r for r in D.decoded(d, C, per).collect()}
        assert len(got) == len(rows)
        for k, planes in want.items():
            assert got["a", k].error is None and np.allclose(got["a", k].planes, planes, rtol=0, atol=1e-9), (per, k)
        assert got["a", 9].planes is None and got["a", 9].error and got["b", 1].error == "no payload" and got["c", None].error
        assert got[None, 0].error is None and len(got["b", 0].planes[0]) == 1024
    assert D.decoded(d.limit(0), C).count() == 0
