import hashlib
import os
import sys
import zlib

import numpy as np
import pytest

from rankloom.llm import webp

sys.path.insert(0, os.path.dirname(__file__))
from webp_writer import encode  # noqa: E402

R = np.random.default_rng(11)


def picture(h, w, colours=None, smooth=False):
    if colours:
        return R.integers(0, 256, (colours, 4), dtype=np.uint8)[R.integers(0, colours, (h, w))]
    x = R.integers(0, 256, (h, w, 4), dtype=np.uint8)
    if smooth:
        x = (np.cumsum(np.cumsum(R.integers(-2, 3, (h, w, 4)), 0), 1) + 128).clip(0, 255).astype(np.uint8)
    return x


def same(rgba, **options):
    data = encode(rgba, **options)
    assert np.array_equal(webp.decode(data), rgba)
    assert np.array_equal(webp.decode_many([data, data])[1], rgba)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (13, 21)])
def test_literals(shape):
    same(picture(*shape))
    same(picture(*shape, colours=1))
    same(picture(*shape, colours=2), simple=False)


def test_references_and_colour_cache():
    base = picture(9, 17, colours=5)
    for cache_bits in (0, 1, 6, 11):
        same(np.concatenate([base, base, picture(2, 17), base]), references=True, cache_bits=cache_bits)
    same(np.zeros((80, 90, 4), np.uint8), references=True)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    for smooth in (False, True):
        same(picture(11, 14, smooth=smooth), transforms=("predictor",), modes=np.full((3, 4), mode))


def test_mixed_predictors_and_cross_colour():
    for size in (2, 3):
        blocks = (-(-19 // (1 << size)), -(-23 // (1 << size)))
        modes, elements = R.integers(0, 14, blocks), R.integers(0, 256, (*blocks, 3))
        same(picture(19, 23, smooth=True), transforms=("predictor", "cross", "green"), modes=modes, elements=elements, size=size, references=True, cache_bits=4)
        same(picture(19, 23), transforms=("green", "cross", "predictor"), modes=modes, elements=elements, size=size)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    same(picture(10, 19, colours=colours), transforms=("palette",), references=True)
    same(picture(6, 5, colours=colours), transforms=("palette",), cache_bits=3)


def test_groups_of_prefix_codes():
    numbers = R.integers(0, 3, (4, 6))
    numbers[0, 0] = 2
    same(picture(16, 23, colours=30), groups=(2, numbers), references=True, cache_bits=5)


def test_damaged_images_fail():
    data = encode(picture(20, 20))
    for bad in (b"", b"RIFF", data[:12], data[: len(data) // 2], data[:20] + b"\0" + data[21:], data.replace(b"VP8L", b"VP8 ")):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_samples_round_trip():
    for payload in (b"\xff" * 576, bytes(range(256)) * 9, b"some text, " * 3000 + b"\xff" * 216, b"\xff" * 576 * 40, b"a" * 576 * 17):
        payload = payload[: len(payload) // 576 * 576]
        images = webp.encode_samples(payload)
        for decoded in ([webp.decode(x) for x in images], webp.decode_many(images)):
            assert b"".join(x[..., 1].tobytes() for x in decoded) == payload
            assert all((x[..., 0] == x[..., 1]).all() and (x[..., 2] == x[..., 1]).all() and (x[..., 3] == 255).all() for x in decoded)
    for bad in (b"", b"x" * 577):
        with pytest.raises(ValueError):
            webp.encode_samples(bad)


def test_the_encoder_takes_what_pays():
    grid = np.tile(R.integers(0, 256, 576, dtype=np.uint8), (16, 1)) + np.arange(16, dtype=np.uint8)[:, None]
    slope = np.cumsum(R.integers(0, 3, 576 * 4, dtype=np.uint8), dtype=np.uint8)
    cases = {
        "palette of 16": (R.integers(0, 16, 576 * 5, dtype=np.uint8) * 9, [webp.PALETTE], 0.55),
        "palette of 3": (R.integers(97, 100, 576 * 5, dtype=np.uint8), [webp.PALETTE], 0.3),
        "palette of 2": (R.integers(0, 2, 576 * 5, dtype=np.uint8), [webp.PALETTE], 0.16),
        "one byte": (np.full(576 * 5, 7, np.uint8), [webp.PALETTE], 0.03),
        "rows": (grid.ravel(), [webp.PREDICTOR, webp.SUBTRACT_GREEN], 0.2),
        "slope": (slope, [webp.PREDICTOR, webp.SUBTRACT_GREEN], 0.35),
        "noise": (R.integers(0, 256, 576 * 5, dtype=np.uint8), [webp.SUBTRACT_GREEN], 1.12),
    }
    texts = {"Japanese": "これは日本語の文章です。短い文を何度か繰り返しません。漢字とかなが交じる普通の文です。", "Russian": "Это обычный русский текст, в котором нет ничего особенного, кроме букв и запятых.", "base64": "VGhpcyBpcyBub3QgYSBzZWNyZXQsIGJ1dCBpdCBsb29rcyBsaWtlIG9uZSBmb3IgYWxsIHdlIGtub3c="}
    for name, text in texts.items():
        raw = np.frombuffer((text * 60).encode(), np.uint8)[: 576 * 4]
        cases[name] = (raw, [webp.SUBTRACT_GREEN], 0.95)
    for name, (samples, kinds, most) in cases.items():
        (image,) = webp.encode_samples(samples.tobytes())
        head = webp.read_head(webp._chunk(image))
        assert [t[0] for t in head.transforms] == kinds, name
        assert len(image) < most * len(samples), (name, len(image) / len(samples))
        for x in (webp.decode(image), *webp.decode_many([image, image])):
            assert np.array_equal(x[..., 1].ravel(), samples) and (x[..., 3] == 255).all() and (x[..., 0] == x[..., 2]).all(), name


@pytest.mark.parametrize("seed", range(30))
def test_any_samples_round_trip(seed):
    r = np.random.default_rng(seed)
    n, most = 576 * int(r.integers(1, 34)), int(r.choice([1, 2, 3, 5, 16, 17, 100, 256]))
    p = r.dirichlet(np.full(most, 0.05 if seed % 2 else 5.0))
    x = r.choice(r.permutation(256)[:most].astype(np.uint8), n, p=p)
    x[n - int(r.integers(0, 500)) :] = 255
    images = webp.encode_samples(x.tobytes())
    assert b"".join(d[..., 1].tobytes() for d in webp.decode_many(images)) == x.tobytes()
    assert b"".join(webp.decode(d)[..., 1].tobytes() for d in images) == x.tobytes()


def test_texts_to_media_and_back(spark):
    texts = [(1, "plain text. " * 80), (2, None), (3, ""), (4, "é" * 288), (5, "x" * 576), (6, "y" * 577), (None, "z"), (7, "long " * 30_000), (1, "plain text. " * 80), (8, "\x00𝄞")]
    df = spark.createDataFrame([(i, t, "m") for i, t in texts], "doc_id long, text string, media string")
    rows = {r["doc_id"]: r for r in webp.examine_media(webp.store_texts(df)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["feature"] == webp.sample_features(np.frombuffer(payload, np.uint8)) and r["media_bytes"] > 0
    assert webp.examine_media(webp.store_texts(df.limit(0))).collect() == []


def test_pixel_column(spark):
    x = picture(3, 4)
    df = spark.createDataFrame([(1, encode(x), 0), (2, None, 0), (3, b"junk", 0)], "id int, media binary, width int")
    rows = {r["key"]: r for r in webp.pixels(df, "id", "media").collect()}
    assert (rows[1]["width"], rows[1]["height"], bytes(rows[1]["rgba"])) == (4, 3, x.tobytes())
    assert rows[2]["rgba"] is None and rows[2]["error"] is None
    assert rows[3]["rgba"] is None and rows[3]["error"]
