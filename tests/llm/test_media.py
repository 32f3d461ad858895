import numpy as np
import pytest

from tallyweave.llm import media_webp as m


def image(seed, n, colours=None):
    rng = np.random.default_rng(seed)
    px = rng.integers(0, 2**32, n, dtype=np.uint32)
    if colours:
        px = px[:colours][rng.integers(0, colours, n)]
    px[n // 2 : n // 2 + n // 4] = px[: n // 4]
    return px


@pytest.mark.parametrize("transforms", [(), (m.PREDICTOR,), (m.CROSS_COLOUR,), (m.SUBTRACT_GREEN,), (m.PREDICTOR, m.CROSS_COLOUR, m.SUBTRACT_GREEN)])
@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"matches": True}, {"cache_bits": 7, "matches": True, "tile": 2}])
def test_round_trip(transforms, options):
    px = image(3, 23 * 19, 300)
    ((w, h, got),) = m.decode(m.encode(px, 23, transforms, **options))
    assert (w, h) == (23, 19) and np.array_equal(got, px)


@pytest.mark.parametrize("colours", [1, 2, 3, 9, 60, 200])
def test_palette_round_trip(colours):
    px = image(5, 21 * 13, colours)
    ((_, _, got),) = m.decode(m.encode(px, 21, (m.PALETTE,), matches=True))
    assert np.array_equal(got, px)


def test_neighbour_order():
    assert len(m.NEIGHBOURS) == 120
    assert m.NEIGHBOURS[:7] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2)]
    assert m.NEIGHBOURS[-5:] == [(8, 5), (7, 7), (-7, 7), (8, 6), (8, 7)]


@pytest.mark.parametrize("data", [b"", b"a", "naïve ß\u0000".encode(), bytes(range(256)) * 9, b"long " * 700_000])
def test_store_and_load(data):
    payload = m.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64
    assert m.load(m.store(payload)) == payload


def test_rejects_other_files():
    with pytest.raises(ValueError):
        m.decode(b"RIFF" + bytes(40))


def test_columns(spark):
    rows = [(1, "abc", "x"), (2, None, "x"), (3, "", "x"), (4, "abc", "x")]
    got = {r["doc_id"]: r for r in m.media_columns(spark.createDataFrame(rows, "doc_id long, text string, media string")).collect()}
    assert got[2][1:] == got[3][1:] and got[1][1:] == got[4][1:] and got[1]["n_bytes"] == 3 and got[2]["payload_bytes"] == 64
    assert m.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_file_of_another_writer():
    import base64

    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")  # one transparent pixel, as browsers are probed with
    ((width, height, px),) = m.decode(data)
    assert (width, height, px.tolist()) == (1, 1, [0])


def features_of(payload):
    """What a stored payload uses, and whether it comes back."""
    seen, undo, copied, hits = [], m._undo, m._copied, []

    class Counted(list):
        def __getitem__(self, k):
            hits.append(k)
            return list.__getitem__(self, k)

    read = m._read_tokens
    try:
        m._undo = lambda kind, *rest: seen.append(kind) or undo(kind, *rest)
        m._copied = lambda *args: seen.append("copy") or copied(*args)
        m._read_tokens = lambda r, codes, width, total, cache, bits: (seen.append("codes") or 0) or read(r, codes, width, total, Counted(cache), bits)
        assert m.load(m.store(payload)) == payload
    finally:
        m._undo, m._copied, m._read_tokens = undo, copied, read
    return set(seen) | ({"cache"} if hits else set())


def test_store_uses_every_part_of_the_format():
    rng = np.random.default_rng(4)
    prose = " ".join(rng.choice("the of and house river water under through long small".split(), 3000)).encode()
    used = features_of(m.padded(prose))
    assert {"codes", "copy"} <= used
    colours = rng.integers(0, 2**32, 600, dtype=np.uint32)
    assert "cache" in features_of(np.concatenate([colours, np.repeat(colours[:40], 3)[rng.permutation(120)]]).astype("<u4").tobytes())
    assert m.PALETTE in features_of(rng.choice(colours[:9], 640).astype("<u4").tobytes())
    rows = np.cumsum(np.concatenate([rng.integers(0, 256, (1, 64)), rng.integers(0, 3, (400, 64))]), axis=0).astype(np.uint8)
    assert m.PREDICTOR in features_of(rows.tobytes())
    green = rng.integers(0, 256, 16 * 300)
    alike = np.stack([green + rng.integers(0, 4, len(green)), green, green + 7, np.full(len(green), 9)], axis=1).astype(np.uint8)
    assert m.SUBTRACT_GREEN in features_of(alike.tobytes())
    signed = green.astype(np.uint8).view(np.int8).astype(np.int64)
    sloped = np.stack([(signed * 11 >> 5) + rng.integers(0, 3, len(green)), green, (signed * -19 >> 5) + 40, np.full(len(green), 9)], axis=1).astype(np.uint8)
    assert m.CROSS_COLOUR in features_of(sloped.tobytes())


@pytest.mark.parametrize("seed", range(12))
def test_stored_payloads_of_all_kinds(seed):
    rng = np.random.default_rng(seed)
    for n in (16, 32, 48, 160, 1600, 4096):
        kinds = (rng.integers(0, 256, 4 * n), rng.integers(0, 2, 4 * n), np.repeat(rng.integers(0, 256, n), 4), np.tile(rng.integers(0, 256, n), 4), np.zeros(4 * n), np.arange(4 * n) % 251)
        for data in kinds:
            payload = m.padded(data.astype(np.uint8).tobytes())
            assert m.load(m.store(payload)) == payload


def test_every_column_by_brute_force(spark):
    import hashlib
    import zlib

    texts = ["abc", "", None, "naïve ß " * 50, "x" * 64, "word " * 5000]
    got = {r["doc_id"]: r for r in m.media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep_media=True).collect()}
    for n, text in enumerate(texts):
        data = (text or "").encode()
        whole = data + bytes(max(64, (len(data) + 63) // 64 * 64) - len(data))
        row, media = got[n], bytes(got[n]["media"])
        columns = [[whole[k] for k in range(at, len(whole), 16)] for at in range(16)]
        bands = [sum(b >> 4 == k for b in whole) * 255 // len(whole) for k in range(16)]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest())
        assert (row["tail_crc32"], row["media_bytes"], row["media_sha256"]) == (zlib.crc32(whole[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert row["feature"] == bytes(int(sum(c) / len(c)) for c in columns).hex() + bytes(bands).hex()
        assert m.load(media) == whole


def test_stored_files_stay_the_same():
    # What the plain, one by one form of the writer made of these payloads.
    import hashlib

    rng = np.random.default_rng(10)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (3, 30, 300, 3000)] + [b"", b"abc " * 900, bytes(range(256)) * 9]
    files = b"".join(m.store(m.padded(x)) for x in texts)
    assert hashlib.sha256(files).hexdigest() == "16726e30c35b9d2e5c7f63ec5fc4e9c28c34aa6d38ed533d0b9e5b837e86c50c"


def test_only_slots_that_are_asked_for_are_kept(monkeypatch):
    # A slot of the cache is brought up to date when a token asks for it, not with each pixel.
    rng = np.random.default_rng(11)
    colours = rng.integers(0, 2**32, 900, dtype=np.uint32)
    px = np.concatenate([colours, np.repeat(colours[:100], 2)[rng.permutation(200)], colours[300:700]])
    payload, written = m.padded(px.astype("<u4").tobytes()), []

    class Counted(list):
        def __setitem__(self, k, p):
            written.append(k)
            list.__setitem__(self, k, p)

    read = m._read_tokens
    monkeypatch.setattr(m, "_read_tokens", lambda r, codes, width, total, cache, bits: read(r, codes, width, total, Counted(cache), bits))
    assert m.load(m.store(payload)) == payload
    assert 0 < len(written) <= 220


def test_a_copy_outside_the_image_is_an_error():
    with pytest.raises(ValueError):
        m._placed(np.array([5]), [(0, 3, 121)], 16, 4, [], 0)
    with pytest.raises(ValueError):
        m._placed(np.array([5, -1]), [(1, 9, 121)], 16, 4, [0, 0], 1)


def test_calls_of_a_short_text():
    # Most texts are short, so what they cost is the number of calls, whatever the machine.
    import sys

    rng = np.random.default_rng(12)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(200)]
    payloads = [m.padded(" ".join(rng.choice(words, 250)).encode()) for _ in range(6)]
    assert m.load(m.store(payloads[0])) == payloads[0]  # tables that are made once
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        back = [m.load(m.store(p)) for p in payloads[1:]]
    finally:
        sys.setprofile(None)
    assert back == payloads[1:]
    assert calls[0] < 5 * 1250, calls[0] / 5
