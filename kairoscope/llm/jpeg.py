"""Media columns: a baseline JPEG codec in numpy and features from the stored bytes.

A payload of bytes is stored losslessly in the format's own unit: the 64 quantised coefficients of a block are 64
payload bytes, in zigzag order, Huffman-coded as a baseline scan of one component. The decoder takes any baseline file,
of one component or several, interleaved or not, with subsampling, with or without restarts: it parses markers, splits
scans at restart markers and Huffman-decodes all segments of all images of a batch side by side, one symbol of each per
step. The thumbnail is the DC-only luminance (the first component): one pixel per block, DC times its quantiser over
8, plus 128. Its hash compares means over a grid that covers every block.

Memory: a worker codes and decodes PART_BLOCKS blocks at a time; beside that it holds some ten times the bytes of
a slice of texts, or of one text if that is longer.

Defined results: a null text is stored as the empty one, an empty payload as one block of zeros. Equal texts have
equal media and features. Malformed media, cut off anywhere or with bytes missing within, raises a ValueError in
decode(); in thumbnails() its row has nulls and says why. Nothing is dropped in silence.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kairoscope.llm.common import declared, map_slices, named, offsets

BLOCK = 64
#: Restart marker after so many blocks: segments are decoded side by side.
RESTART = 1
#: Blocks that are encoded or decoded at a time, of one image or of several.
PART_BLOCKS = 1 << 11
#: Text bytes of a slice: its media, coefficients and thumbnails are held at once.
SLICE_BYTES = 1 << 20
#: Magnitude categories of a byte stored as a coefficient of 0 to 255 are at most 8.
_CATEGORY = np.array([int(v).bit_length() for v in range(256)], np.int32)

#: A marker that is no restart; in entropy-coded data 0xFF is followed by 0.
_ENDS = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a DHT table."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        if code > 1 << length:
            raise ValueError("a Huffman table has too many codes")
        code <<= 1
    return out


def _tables() -> tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]]:
    """Our DC and AC tables: categories 0 to 8; for AC, category 5 to 7 without a run first (text), the others equal."""
    dc = ([0] * 16, list(range(9)))
    dc[0][3] = 9  # nine codes of four bits
    common = [0x07, 0x06, 0x05]
    rest = [0x00, 0xF0, *[r << 4 | c for c in range(1, 9) for r in range(16) if r << 4 | c not in common]]
    ac = ([0] * 16, common + rest)
    ac[0][0], ac[0][2], ac[0][3] = 1, 1, 1  # 0; 100; 1010
    ac[0][9] = len(rest)  # ten bits; codes from 1011000000, none of ones only
    return dc, ac


DC, AC = _tables()
_DC_CODE = np.zeros((256, 2), np.int32)
_AC_CODE = np.zeros((256, 2), np.int32)
for _table, _code in ((DC, _DC_CODE), (AC, _AC_CODE)):
    for _s, _pair in _canonical(*_table).items():
        _code[_s] = _pair


def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16 bits: symbol << 5 | code length; 0 if no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _canonical(list(counts), list(symbols)).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 5 | length
    return out


def dimensions(blocks: int) -> tuple[int, int]:
    """Blocks across and down: the squarest grid that holds them."""
    across = int(np.ceil(np.sqrt(blocks)))
    return across, -(-blocks // across)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def encode(payloads: list[bytes], restart: int = RESTART, part_blocks: int = PART_BLOCKS) -> list[bytes]:
    """A baseline JPEG of each payload, a positive multiple of 64 bytes. A comment segment says how long it is."""
    grids = [dimensions(len(p) // BLOCK) for p in payloads]
    step = part_blocks // (8 * restart) * 8 * restart or 8 * restart  # parts begin where restart markers begin anew
    scans: list[list[bytes]] = [[] for _ in payloads]
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        for (i, _), scan in zip(held, _scans([part for _, part in held], restart)):
            scans[i].append(scan)
        held.clear()

    size = 0
    for i, (p, (w, h)) in enumerate(zip(payloads, grids)):
        whole = p + b"\0" * (w * h * BLOCK - len(p))
        for low in range(0, len(whole), step * BLOCK):
            part = whole[low : low + step * BLOCK]
            if held and size + len(part) > step * BLOCK:
                flush()
                size = 0
            held.append((i, part))
            size += len(part)
    if held:
        flush()
    return [_header(w, h, len(p), restart) + b"\xff\xd7".join(s) + b"\xff\xd9" for (w, h), p, s in zip(grids, payloads, scans)]


def _scans(payloads: list[bytes], restart: int) -> list[bytes]:
    """Entropy-coded blocks of each payload, markers between segments included."""
    each = np.array([len(p) // BLOCK for p in payloads], np.int64)
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    n = len(blocks)
    image = np.repeat(np.arange(len(payloads)), each)
    fresh = (np.arange(n) - (np.cumsum(each) - each)[image]) % restart == 0
    # DC: difference from the block before, of its sign and category; a fresh segment starts from 0
    first = blocks[:, 0].astype(np.int32)
    change = first - np.where(fresh, 0, np.roll(first, 1))
    dc_size = _CATEGORY[np.abs(change)]
    dc_bits = np.where(change < 0, change + (1 << dc_size) - 1, change)
    # AC: each value that is not 0 with the run of zeros before it, in runs of 16 apart
    row, col = np.nonzero(blocks[:, 1:])
    value = blocks[row, col + 1].astype(np.int32)
    head = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    run = col - np.where(head, -1, np.append(-1, col[:-1]) if len(col) else col) - 1
    skips = run >> 4
    last = np.zeros(n, np.int64)
    last[row] = col + 1
    short = last < BLOCK - 1  # blocks that end with an end-of-block symbol
    # places of the symbols: block after block, DC first, then runs and values, then the end
    taken = offsets(np.bincount(row, skips + 1, n))
    ended = np.cumsum(short) - short
    number = np.arange(n)
    at_dc = (taken[:-1] + number + ended).astype(np.int64)
    at_value = np.cumsum(skips + 1) - 1 + row + 1 + ended[row]
    at_end = (taken[1:] + number + 1 + ended).astype(np.int64)[short]
    symbols = int(taken[-1]) + n + int(short.sum())
    code, length = np.full(symbols, _AC_CODE[0xF0, 0], np.int32), np.full(symbols, _AC_CODE[0xF0, 1], np.int32)  # what stays is a run of 16
    code[at_dc], length[at_dc] = _DC_CODE[dc_size, 0] << dc_size | dc_bits, _DC_CODE[dc_size, 1] + dc_size
    size = _CATEGORY[value]
    pair = _AC_CODE[(run & 15) << 4 | size]
    code[at_value], length[at_value] = pair[:, 0] << size | value, pair[:, 1] + size
    code[at_end], length[at_end] = _AC_CODE[0, 0], _AC_CODE[0, 1]
    # segments end on whole bytes, filled with ones
    segment = np.cumsum(fresh) - 1
    segments = int(segment[-1]) + 1
    owner = np.repeat(segment, np.diff(np.append(at_dc, symbols)))
    used = np.bincount(owner, length, segments).astype(np.int64)
    octets = -(-used // 8)
    start = (np.cumsum(octets) - octets) * 8
    at = np.cumsum(length) - length + (start - (np.cumsum(used) - used))[owner]
    body = _pack_bits(at, code, length, int(octets.sum()))
    body[np.cumsum(octets) - 1] |= ((1 << (octets * 8 - used)) - 1).astype(np.uint8)
    # a zero after each 0xFF, then markers between segments of one image
    stuffed = np.cumsum(body == 0xFF)
    seg_image = image[fresh]
    seg_index = np.arange(segments) - np.searchsorted(seg_image, seg_image)
    marks = np.cumsum(seg_index > 0)  # markers up to the start of each segment
    spot = np.arange(len(body)) + np.append(0, stuffed[:-1]) + 2 * np.repeat(marks, octets)
    out = np.zeros(len(body) + int(stuffed[-1]) + 2 * int(marks[-1]), np.uint8)
    out[spot] = body
    begin = spot[np.cumsum(octets) - octets]
    inner = np.flatnonzero(seg_index > 0)
    out[begin[inner] - 2] = 0xFF
    out[begin[inner] - 1] = 0xD0 + (seg_index[inner] - 1) % 8
    ends = np.append(begin[seg_index == 0], len(out))
    scan = out.tobytes()
    return [scan[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def _pack_bits(at: np.ndarray, code: np.ndarray, length: np.ndarray, octets: int) -> np.ndarray:
    """Codes set at bit positions, which rise and do not overlap, as bytes."""
    words = np.zeros(-(-octets // 4) + 2, np.uint64)
    word, bit = at >> 5, at & 31
    wide = code.astype(np.uint64) << (64 - bit - length).astype(np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    full = np.bitwise_or.reduceat(wide, starts) if len(starts) else wide
    w = word[starts]
    words[w] |= full >> np.uint64(32)
    words[w + 1] |= full & np.uint64(0xFFFFFFFF)
    return np.frombuffer(words.astype(">u4").tobytes(), np.uint8)[:octets].copy()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(across: int, down: int, size: int, restart: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xFE, struct.pack(">Q", size)),
        _segment(0xDB, b"\0" + b"\x08" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, down * 8, across * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + bytes(DC[0]) + bytes(DC[1])),
        _segment(0xC4, b"\x10" + bytes(AC[0]) + bytes(AC[1])),
        _segment(0xDD, struct.pack(">H", restart)),
        _segment(0xDA, struct.pack(">BBBBBB", 1, 1, 0x00, 0, 63, 0)),
    ])


def parse(media: bytes) -> dict:
    """Markers of a baseline JPEG: width, height, quantisers, comment, and of the scan that holds the first component its
    bytes, restart interval, Huffman tables and units.

    units: for each block of a minimum coded unit its component, DC table and AC table; a scan of one component has
    one unit. blocks: units times minimum coded units. luma: width and height of the first component in blocks.
    """
    try:
        return _parse(media)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"cut off or without a table it names: {e!r}") from None


def _parse(media: bytes) -> dict:
    if media[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, found = 2, {"quant": {}, "comment": b"", "components": []}
    dc, ac, every, chosen = {}, {}, 0, None
    while True:
        if media[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        while media[at + 1] == 0xFF:  # fill bytes
            at += 1
        marker = media[at + 1]
        at += 2
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:  # markers without a body
            continue
        size = struct.unpack_from(">H", media, at)[0]
        body = media[at + 2 : at + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("a segment is cut off")
        at += size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                found["quant"][body[0] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, 1)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            depth, found["height"], found["width"], parts = struct.unpack_from(">BHHB", body)
            found["components"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)]
            if depth != 8 or not parts or not found["height"] or not found["width"] or not all(0 < h < 5 and 0 < v < 5 for _, h, v, _ in found["components"]):
                raise ValueError("no image of 8 bits a sample with a size")
        elif marker == 0xC4:
            while body:
                counts = tuple(struct.unpack_from(">16B", body, 1))
                n = sum(counts)
                if len(body) < 17 + n:
                    raise ValueError("a Huffman table is cut off")
                (ac if body[0] >> 4 else dc)[body[0] & 15] = (counts, tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            found["comment"] = body
        elif marker == 0xDA:
            end = _scan_end(media, at)
            named_ = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            if not found["components"]:
                raise ValueError("a scan before the frame")
            if chosen is None and any(c == found["components"][0][0] for c, _ in named_):
                chosen = (named_, media[at:end], every, {c: (dc[t >> 4], ac[t & 15]) for c, t in named_})
            at = end
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not a baseline scan")
    if chosen is None:
        raise ValueError("no scan")
    return found | _layout(found, *chosen)


def _scan_end(media: bytes, at: int) -> int:
    """Where the next marker that ends entropy-coded data stands."""
    found = _ENDS.search(media, at)
    if not found:
        raise ValueError("no marker after the scan")
    return found.start()


def _layout(found: dict, named_: list, scan: bytes, every: int, tables: dict) -> dict:
    frame = {c: (h, v) for c, h, v, _ in found["components"]}
    most_h, most_v = max(h for h, _ in frame.values()), max(v for _, v in frame.values())
    first, h, v, quant = found["components"][0]
    luma = tuple(-(-(-(-found[side] * own // most)) // 8) for side, own, most in (("width", h, most_h), ("height", v, most_v)))
    if len(named_) == 1:
        units, mcus = [(0, *tables[first])], luma[0] * luma[1]
        across = luma[0]
    else:
        units = [(k, *tables[c]) for k, (c, _) in enumerate(named_) for _ in range(frame[c][0] * frame[c][1])]
        across = -(-found["width"] // (8 * most_h))
        mcus = across * -(-found["height"] // (8 * most_v))
    place = [c for c, _ in named_].index(first)
    return {"scan": scan, "restart": every, "units": tuple(units), "blocks": mcus * len(units), "luma": luma, "luma_unit": place, "luma_grid": (h, v) if len(named_) > 1 else (1, 1), "across": across, "quant_dc": found["quant"][quant][0]}


def decode(images: list[bytes], part_blocks: int = PART_BLOCKS) -> list[tuple[dict, np.ndarray]]:
    """(what parse() found, int16 coefficients [blocks, 64] in zigzag order of the first component, row by row) of each image."""
    parsed = [parse(m) for m in images]
    done: list[list[np.ndarray]] = [[] for _ in images]
    alike: dict = {}
    for i, p in enumerate(parsed):
        alike.setdefault(p["units"], []).append(i)
    for units, at in alike.items():
        dealt = _Units(units)
        held: list[tuple[int, dict]] = []
        size = 0
        for i in at:
            for part in _parts(parsed[i], part_blocks):
                if held and size + part["blocks"] > part_blocks:
                    for (k, _), c in zip(held, _scan([p for _, p in held], dealt)):
                        done[k].append(c)
                    held, size = [], 0
                held.append((i, part))
                size += part["blocks"]
        for (k, _), c in zip(held, _scan([p for _, p in held], dealt)):
            done[k].append(c)
    return [(p, _luma(p, c[0] if len(c) == 1 else np.concatenate(c))) for p, c in zip(parsed, done)]


class _Units:
    """The blocks of a minimum coded unit: look-up tables of each, stacked, and the component whose DC it continues."""

    def __init__(self, units: tuple):
        tables = list(dict.fromkeys(t for _, dc, ac in units for t in (dc, ac)))
        self.stacked = np.concatenate([_lookup(*t) for t in tables])
        self.component = np.array([c for c, _, _ in units])
        self.dc = np.array([tables.index(dc) << 16 for _, dc, _ in units])
        self.ac = np.array([tables.index(ac) << 16 for _, _, ac in units])
        self.period = len(units)


def _luma(image: dict, coefficients: np.ndarray) -> np.ndarray:
    """The first component's blocks, row by row, from the order of the scan."""
    period = len(image["units"])
    if period == 1:
        return coefficients
    h, v = image["luma_grid"]
    low = [c for c, _, _ in image["units"]].index(image["luma_unit"])
    w, t = image["luma"]
    grid = coefficients.reshape(-1, image["across"], period, BLOCK)[:, :, low : low + h * v].reshape(-1, image["across"], v, h, BLOCK)
    return grid.transpose(0, 2, 1, 3, 4).reshape(-1, image["across"] * h, BLOCK)[:t, :w].reshape(-1, BLOCK)


def _parts(image: dict, most: int) -> list[dict]:
    """An image's scan cut at restart markers into parts of about `most` blocks; whole if it has none."""
    blocks, every = image["blocks"], image["restart"] * len(image["units"])
    if not every or blocks <= most:
        return [{"scan": image["scan"], "restart": every, "blocks": blocks}]
    raw = np.frombuffer(image["scan"], np.uint8)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    if len(marks) != -(-blocks // every) - 1:
        raise ValueError("restart markers do not fit the size")
    step = max(1, most // every)  # segments of a part
    cuts = marks[step - 1 :: step].tolist()
    edges = zip([0, *[c + 2 for c in cuts]], [*cuts, len(raw)])
    parts = [{"scan": image["scan"][a:b], "restart": every, "blocks": min(step * every, blocks - k * step * every)} for k, (a, b) in enumerate(edges)]
    return [p for p in parts if p["blocks"] > 0]


def _scan(images: list[dict], units: _Units) -> list[np.ndarray]:
    blocks = np.array([p["blocks"] for p in images], np.int64)
    raw = np.frombuffer(b"".join(p["scan"] for p in images), np.uint8)
    edges = offsets([len(p["scan"]) for p in images])
    mark = np.zeros(len(raw), bool)
    mark[:-1] = (raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)
    drop = mark.copy()
    drop[1:] |= mark[:-1] | ((raw[:-1] == 0xFF) & (raw[1:] == 0))
    kept = offsets(~drop)  # place of each byte in the clean stream
    cut = np.sort(np.concatenate([edges[:-1], np.flatnonzero(mark) + 2]))
    owner = np.searchsorted(edges, cut, "right") - 1
    start = kept[cut] * 8
    stop_bit = np.append(start[1:], kept[-1] * 8)
    clean = np.append(raw[~drop], np.zeros(8, np.uint8)).astype(np.uint32)
    # 32 bits from each byte on, so that a look-up is one gather
    wide = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    del clean, drop, mark, kept
    first = np.searchsorted(owner, np.arange(len(images)))
    number = np.arange(len(cut)) - first[owner]
    every = np.array([p["restart"] for p in images], np.int64)
    base = offsets(blocks)
    spacing = np.where(every[owner] > 0, every[owner], blocks[owner])
    if (np.bincount(owner, minlength=len(images)) != -(-blocks // np.where(every > 0, every, blocks))).any():
        raise ValueError("restart markers do not fit the size")
    block = base[owner] + number * spacing
    stop = np.minimum(block + spacing, base[owner + 1])
    out = np.zeros((int(base[-1]), BLOCK), np.int16)
    flat = out.ravel()
    position = start.copy()
    index = np.zeros(len(cut), np.int64)  # next coefficient of the block
    phase = np.zeros(len(cut), np.int64)  # which block of its minimum coded unit
    before = np.zeros((len(cut), int(units.component.max()) + 1), np.int64)
    live = np.arange(len(cut))
    end_of = len(wide) - 1
    while len(live):
        p, k, turn = position[live], index[live], phase[live]
        is_dc = k == 0
        window = (wide[np.minimum(p >> 3, end_of)] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        hit = units.stacked[np.where(is_dc, units.dc[turn], units.ac[turn]) + window]
        if not hit.all():
            raise ValueError("no Huffman code fits")
        symbol = hit >> 5
        size = symbol & 15
        p += hit & 31
        bits = ((wide[np.minimum(p >> 3, end_of)] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)).astype(np.int64) >> (16 - size)
        value = np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)
        end = ~is_dc & (symbol == 0)
        put = k + np.where(is_dc, 0, symbol >> 4)
        if (put[~end] >= BLOCK).any():
            raise ValueError("a run leaves its block")
        dc = np.flatnonzero(is_dc)
        if len(dc):
            if (symbol[dc] > 15).any():
                raise ValueError("no category of a DC difference")
            own = live[dc], units.component[turn[dc]]
            value[dc] += before[own]
            before[own] = value[dc]
            if (np.abs(value[dc]) > 32767).any():
                raise ValueError("a DC coefficient out of range")
        write = ~end & ((size > 0) | is_dc)
        flat[(block[live] * BLOCK + put)[write]] = value[write]
        p += size
        position[live] = p
        after = np.where(end, BLOCK, put + 1)
        done = after >= BLOCK
        index[live] = np.where(done, 0, after)
        if done.any():
            block[live] += done
            phase[live] = (turn + done) % units.period
            live = live[block[live] < stop[live]]
    if (position > stop_bit).any():
        raise ValueError("a segment is cut off")
    return [out[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def thumbnail(found: dict, coefficients: np.ndarray) -> np.ndarray:
    """DC-only luminance, one pixel per block, uint8."""
    grid = coefficients[:, 0].astype(np.int64).reshape(found["luma"][::-1])
    return np.clip(np.rint(grid * found["quant_dc"] / 8) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Difference hash: means over 8 x 9 cells that cover every pixel, a bit where a cell is brighter than its left
    neighbour, as 16 hex digits. With fewer pixels than cells on a side, cells share them."""
    h, w = thumb.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    (top, low), (left, right) = _cells(h, 8), _cells(w, 9)
    sums = total[low][:, right] - total[top][:, right] - total[low][:, left] + total[top][:, left]
    area = np.outer(low - top, right - left)
    # a / m > b / n in whole numbers
    return np.packbits(sums[:, 1:] * area[:, :-1] > sums[:, :-1] * area[:, 1:]).tobytes().hex()


def _cells(pixels: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(cells + 1) * pixels // cells
    return at[:-1], np.maximum(at[1:], at[:-1] + 1)


def stored(coefficients: np.ndarray, found: dict) -> bytes:
    """The payload back from an image of encode()."""
    return coefficients.astype(np.uint8).tobytes()[: struct.unpack(">Q", found["comment"])[0]]


ADDED = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "width": "int", "height": "int", "feature": "string"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _mapped(df: DataFrame, column: str, keep: list[str] | None, added: dict[str, str], rows_of) -> DataFrame:
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    df = df.select(*named(dict.fromkeys([*kept, column])))

    def make():
        def add(part: pa.Table) -> pa.Table:
            rows = rows_of(part.column(column).to_pylist())
            part = part.select(kept)
            for name, kind in added.items():
                part = part.append_column(name, pa.array([r[name] for r in rows], _ARROW[kind]))
            return part

        return add

    return map_slices(df, make, declared(df.select(*named(kept)), added), column, SLICE_BYTES)


def media_columns(docs: DataFrame, text: str = "text", keep: list[str] | None = None, media: bool = True, thumbs: bool = True) -> DataFrame:
    """docs (its columns `keep`, all if None) with the stored JPEG (media), dimensions, thumbnail (bytes, a row of
    blocks after the other), its hash (in feature) and digests of the payload as read back from the stored bytes.
    A column with the name of an added one is replaced."""
    added = ADDED | ({"media": "binary"} if media else {}) | ({"thumbnail": "binary"} if thumbs else {})
    return _mapped(docs, text, keep, added, lambda texts: describe(texts, media, thumbs))


def thumbnails(files: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """files (its columns `keep`, all if None) with width, height, thumbnail, feature and error of a column of baseline
    JPEGs. A null or malformed one has nulls and its error; other rows are not touched by it."""
    added = {"width": "int", "height": "int", "thumbnail": "binary", "feature": "string", "error": "string"}
    return _mapped(files, media, keep, added, lambda found: [_seen(m) for m in found])


def _seen(image: bytes | None) -> dict:
    out = {"width": None, "height": None, "thumbnail": None, "feature": None, "error": None}
    try:
        if image is None:
            raise ValueError("no media")
        [(found, coefficients)] = decode([image])
    except ValueError as e:
        return out | {"error": str(e)}
    thumb = thumbnail(found, coefficients)
    return out | {"width": found["width"], "height": found["height"], "thumbnail": thumb.tobytes(), "feature": _feature(found, thumb)}


def _feature(found: dict, thumb: np.ndarray) -> str:
    return f"{found['width']}x{found['height']}:{thumbnail_hash(thumb)}"


def describe(texts: list[str | None], media: bool = True, thumbs: bool = True) -> list[dict]:
    """The columns of media_columns() for each text: stored, read back from the stored bytes, described."""
    images = encode([payload(t) for t in texts])
    out = []
    for text, image, (found, coefficients) in zip(texts, images, decode(images)):
        back, thumb = stored(coefficients, found), thumbnail(found, coefficients)
        out.append({
            "n_bytes": len((text or "").encode()), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]),
            "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(), "width": found["width"], "height": found["height"],
            "feature": _feature(found, thumb),
        } | ({"media": image} if media else {}) | ({"thumbnail": thumb.tobytes()} if thumbs else {}))
    return out
