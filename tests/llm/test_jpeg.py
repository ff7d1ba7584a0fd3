import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from kairoscope.llm import jpeg

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "é漢😀" * 100, "\0" * 130, "a" + "\0" * 62 + "b", "ÿ" * 500, "\x01\0\0" * 90]


def plain_decode(media):
    """One bit at a time, one symbol at a time, straight from the format's description."""
    p = jpeg.parse(media)
    codes = []
    for counts, symbols in p["units"][0][1:]:
        code, k, table = 0, 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        codes.append(table)
    scan, at, bits = p["scan"], 0, []

    def refill():
        nonlocal at
        byte = scan[at]
        at += 2 if byte == 0xFF and scan[at + 1] == 0 else 1
        bits.extend(byte >> i & 1 for i in range(7, -1, -1))

    def take(n):
        value = 0
        for _ in range(n):
            if not bits:
                refill()
            value = value << 1 | bits.pop(0)
        return value

    def symbol(table):
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError

    def signed(size):
        v = take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    blocks, before = [], 0
    for b in range(-(-p["width"] // 8) * -(-p["height"] // 8)):
        if p["restart"] and b and b % p["restart"] == 0:
            bits.clear()
            assert scan[at] == 0xFF and scan[at + 1] == 0xD0 + (b // p["restart"] - 1) % 8
            at += 2
            before = 0
        block = [0] * 64
        before += signed(symbol(codes[0]))
        block[0], k = before, 1
        while k < 64:
            s = symbol(codes[1])
            if not s:
                break
            k += s >> 4
            if s & 15:
                block[k] = signed(s & 15)
            k += 1
        blocks.append(block)
    return np.array(blocks)


@pytest.mark.parametrize("restart", [1, 2, 5])
def test_decoder_matches_a_plain_one_and_the_payload(restart):
    rng = random.Random(restart)
    payloads = [jpeg.payload(t) for t in TEXTS] + [bytes(rng.choice([0, 0, 0, 7, 128, 255, rng.randrange(256)]) for _ in range(64 * rng.randrange(1, 9))) for _ in range(40)]
    images = jpeg.encode(payloads, restart)
    for p, m, (found, got) in zip(payloads, images, jpeg.decode(images)):
        assert (plain_decode(m) == got).all()
        assert jpeg.stored(got, found) == p


def test_a_scan_without_restarts_and_with_negative_values():

    def image(stream, width):
        stream += "1" * (-len(stream) % 8)
        body = bytes(int(stream[i : i + 8], 2) for i in range(0, len(stream), 8)).replace(b"\xff", b"\xff\0")
        head = jpeg._header(width // 8, 1, 64, 1)
        head = head.replace(b"\xff\xdd\x00\x04\x00\x01", b"")
        return head + body + b"\xff\xd9"

    dc, ac = jpeg._canonical(*jpeg.DC), jpeg._canonical(*jpeg.AC)
    put = lambda table, s: format(table[s][0], f"0{table[s][1]}b")
    stream = put(dc, 3) + "010" + put(ac, 0x05) + "00001" + put(ac, 0) + put(dc, 2) + "11" + put(ac, 0)
    media = image(stream, 16)
    (_, got), = jpeg.decode([media])
    assert got[:, 0].tolist() == [-5, -2] and got[0, 1] == -30 and (plain_decode(media) == got).all()


def test_long_payloads_in_parts_are_the_same_image():
    rng = random.Random(8)
    payloads = [bytes(rng.choice(b"\0abcdefgh\xff") for _ in range(64 * n)) for n in (1, 40, 3, 100, 17)]
    for restart in (1, 3):
        whole = jpeg.encode(payloads, restart)
        assert jpeg.encode(payloads, restart, part_blocks=8) == whole
        for a, b in zip(jpeg.decode(whole), jpeg.decode(whole, part_blocks=8)):
            assert (a[1] == b[1]).all()


def test_thumbnail_is_the_dc_of_each_block():
    (found, got), = jpeg.decode(jpeg.encode([bytes([0] * 64 + [100] + [9] * 63 + [255] + [0] * 63)]))
    assert jpeg.thumbnail(found, got).tolist() == [[128, 228], [255, 128]]


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, code, size):
        self.text += format(code, f"0{size}b") if size else ""

    def number(self, table, run, value):
        size = abs(value).bit_length()
        self.put(*table[run << 4 | size])
        self.put(value if value >= 0 else value + (1 << size) - 1, size)

    def done(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")


def colour(rng, width, height, sampling, restart=0, interleaved=True):
    """A baseline file of several components with made-up coefficients, and the DC of the first one's blocks, row by row."""
    h, v = max(a for a, _ in sampling), max(b for _, b in sampling)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    dc, ac = jpeg._canonical(*jpeg.DC), jpeg._canonical(*jpeg.AC)
    planes = [{(x, y): [rng.randrange(-120, 120)] + [rng.choice([0, 0, 0, 3, -7]) for _ in range(63)] for y in range(down * b) for x in range(across * a)} for a, b in sampling]
    orders = []
    if interleaved:
        orders.append((list(range(len(sampling))), [[(c, mx * a + x, my * b + y) for c, (a, b) in enumerate(sampling) for y in range(b) for x in range(a)] for my in range(down) for mx in range(across)]))
    else:
        for c, (a, b) in enumerate(sampling):
            wide, tall = -(-(-(-width * a // h)) // 8), -(-(-(-height * b // v)) // 8)
            orders.append(([c], [[(c, x, y)] for y in range(tall) for x in range(wide)]))
    seg = jpeg._segment
    media = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + b"\x08" * 64) + seg(0xDB, b"\1" + b"\x10" * 64) + b"\xff"
    media += seg(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(sampling)]) + b"".join(bytes([c + 1, a << 4 | b, min(c, 1)]) for c, (a, b) in enumerate(sampling)))
    media += seg(0xC4, b"\x00" + bytes(jpeg.DC[0]) + bytes(jpeg.DC[1]) + b"\x10" + bytes(jpeg.AC[0]) + bytes(jpeg.AC[1]))
    media += seg(0xDD, bytes([0, restart])) if restart else b""
    for components, units in orders:
        media += seg(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + b"\0\x3f\0")
        bits, before, number = Bits(), [0] * len(sampling), 0
        for k, unit in enumerate(units):
            if restart and k and k % restart == 0:
                media += bits.done() + bytes([0xFF, 0xD0 + number % 8])
                bits, before, number = Bits(), [0] * len(sampling), number + 1
            for c, x, y in unit:
                block = planes[c][x, y]
                bits.number(dc, 0, block[0] - before[c])
                before[c], run = block[0], 0
                for value in block[1:]:
                    if value == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits.put(*ac[0xF0])
                        run -= 16
                    bits.number(ac, run, value)
                    run = 0
                if run:
                    bits.put(*ac[0])
        media += bits.done()
    a, b = sampling[0]
    wide, tall = -(-(-(-width * a // h)) // 8), -(-(-(-height * b // v)) // 8)
    return media + b"\xff\xd9", [[planes[0][x, y][0] for x in range(wide)] for y in range(tall)]


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1)], [(1, 1), (2, 1)]])
@pytest.mark.parametrize("restart", [0, 3])
def test_colour_images_give_their_luminance(sampling, restart):
    rng = random.Random(restart)
    made = [colour(rng, w, h, sampling, restart, interleaved) for w, h in ((8, 8), (33, 50), (100, 17)) for interleaved in (True, False)]
    for (_, want), (found, got) in zip(made, jpeg.decode([m for m, _ in made], part_blocks=8)):
        assert got[:, 0].reshape(found["luma"][::-1]).tolist() == want
        assert jpeg.thumbnail(found, got).shape == (len(want), len(want[0]))


def test_malformed_media_is_an_error():
    (good,) = jpeg.encode([jpeg.payload("hello " * 40)])
    bad = [b"no", good.replace(b"\xff\xc0", b"\xff\xc2"), good.replace(b"\xff\xd0", b"", 1)]
    for whole in (good, colour(random.Random(3), 40, 20, [(2, 2), (1, 1), (1, 1)], 2)[0]):
        bad += [whole[:n] for n in range(len(whole))]
    for media in bad:
        with pytest.raises(ValueError):
            jpeg.decode([media])


def test_thumbnails_of_stored_media(spark):
    good, _ = colour(random.Random(5), 90, 40, [(2, 1), (1, 1), (1, 1)])
    rows = {r.n: r for r in jpeg.thumbnails(spark.createDataFrame([(1, good), (2, good[:50]), (3, None), (4, b""), (5, good)], "n int, media binary")).collect()}
    assert (rows[1].width, rows[1].height, len(rows[1].thumbnail), rows[1].error) == (90, 40, 12 * 5, None)
    assert rows[1].feature == rows[5].feature and all(rows[n].error and rows[n].feature is None for n in (2, 3, 4))


def test_the_hash_sees_every_block():
    rng = np.random.default_rng(0)
    thumb = rng.integers(100, 140, (64, 63)).astype(np.uint8)
    for y, x in ((0, 0), (31, 30), (63, 62)):
        other = thumb.copy()
        cell = other[y // 8 * 8 : y // 8 * 8 + 8, x // 7 * 7 : x // 7 * 7 + 7]
        cell[:] = 0
        assert jpeg.thumbnail_hash(other) != jpeg.thumbnail_hash(np.where(other == 0, 255, other).astype(np.uint8))
    small = np.array([[1, 2], [3, 1]], np.uint8)
    assert len(jpeg.thumbnail_hash(small)) == 16


@pytest.mark.parametrize("texts", [["ordinary words of a row " * 8] * 10_000, ["one long text " * 150_000], ["漢字仮名" * 16] * 10_000])
def test_working_memory_is_bounded(texts):
    jpeg.describe(["warm"])
    tracemalloc.start()
    for low in range(0, len(texts), 5000):
        jpeg.describe(texts[low : low + 5000], False, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def test_media_columns(spark):
    rows = [(i, t, b"m") for i, t in enumerate(TEXTS)] + [(None, "a", None), (2, "a", None)]
    got = jpeg.media_columns(spark.createDataFrame(rows, "doc_id long, text string, media binary")).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        p = jpeg.payload(r.text)
        assert r.n_bytes == len((r.text or "").encode()) and r.payload_bytes == len(p) and r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.thumbnail) == r.width * r.height // 64
        assert by_text.setdefault(r.text or "", (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert jpeg.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
