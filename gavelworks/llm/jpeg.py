"""Baseline JPEG in numpy, for many images at once.

Reading needs no picture but its DC terms: markers are parsed, the scan that holds the luminance is Huffman-decoded with
table look-ups, AC terms are passed over, and the DC terms give one pixel for each 8 x 8 block. All restart intervals of
all images with the same tables advance together, a block a step.

Writing stores bytes without loss, one as the DC term of a block each: with a DC quantiser of 8 the block's mean is the
byte. A row of 64 blocks is a restart interval.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ROW = 64  # bytes, and blocks, of a stored row
MOST_ROWS = 8191  # rows of blocks in an image of at most 65,535 lines
# The Huffman tables that are written: codes of each length, then the symbols. DC categories 0 to 8; end of block.
_DC = [0, 0, 4, 5] + [0] * 12, [4, 5, 6, 7, 0, 1, 2, 3, 8]
_AC = [1] + [0] * 15, [0]


class Scan(NamedTuple):
    """What is needed to decode a scan; equal scans are decoded together."""

    blocks: tuple[tuple[int, bytes, bytes], ...]  # component, DC table and AC table of each block of an MCU
    luma: int  # index of the luminance component in the scan


class Image(NamedTuple):
    width: int
    height: int
    scan: Scan
    across: int  # blocks of an MCU, and MCUs of a row
    down: int
    columns: int
    rows: int
    interval: int  # MCUs between restarts; 0 is none
    quantiser: int
    begin: int  # entropy-coded bytes
    end: int


def _codes(table: bytes) -> list[tuple[int, int, int]]:
    """``(code, length, symbol)`` of a Huffman table as it stands in the file."""
    out, code, at = [], 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out.append((code, length, table[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _look_up(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length (0: no code) and symbol by the next 16 bits."""
    lengths, symbols = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for code, length, symbol in _codes(table):
        low = code << (16 - length)
        lengths[low : low + (1 << (16 - length))] = length
        symbols[low : low + (1 << (16 - length))] = symbol
    return lengths, symbols


def _block_look_up(dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: bits of a whole block without AC terms (0: it has some, or is longer), and its DC step."""
    lengths, sizes = _look_up(dc)
    ends, symbols = _look_up(ac)
    window = np.arange(1 << 16)
    used = lengths + sizes
    fits = (lengths > 0) & (used < 16)
    value = (window >> np.where(fits, 16 - used, 0)) & ((1 << sizes) - 1)
    value = np.where((sizes > 0) & (value < (1 << np.maximum(sizes - 1, 0))), value - (1 << sizes) + 1, value)
    rest = (window << np.where(fits, used, 0)) & 0xFFFF
    whole = fits & (ends[rest] > 0) & (symbols[rest] == 0) & (used + ends[rest] <= 16)
    return np.where(whole, used + ends[rest], 0), value


def parse(data: bytes, begin: int = 0) -> tuple[Image, int]:
    """The image that starts at ``begin``, and where the one after it does."""
    if data[begin : begin + 2] != b"\xff\xd8":
        raise ValueError("no JPEG image here")
    at, tables, quantisers, interval, frame, found = begin + 2, {}, {}, 0, None, None
    while at + 1 < len(data):
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        if marker == 0xFF:
            at += 1
            continue
        at += 2
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at : at + 2], "big")
        part = data[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            while part:
                wide = part[0] >> 4
                quantisers[part[0] & 15] = int.from_bytes(part[1 : 2 + wide], "big")
                part = part[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while part:
                n = 17 + sum(part[1:17])
                tables[part[0]] = part[1:n]
                part = part[n:]
        elif marker == 0xDD:
            interval = int.from_bytes(part[:2], "big")
        elif marker in (0xC0, 0xC1):
            height, width = int.from_bytes(part[1:3], "big"), int.from_bytes(part[3:5], "big")
            frame = [(part[i], part[i + 1] >> 4, part[i + 1] & 15, part[i + 2]) for i in range(6, 6 + 3 * part[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDA:
            begin_scan, at = at, _end_of_scan(data, at)
            chosen = {part[i]: part[i + 1] for i in range(1, 1 + 2 * part[0], 2)}
            luma = frame[0]
            if luma[0] not in chosen or found is not None:
                continue
            inside = [c for c in frame if c[0] in chosen]
            most_h, most_v = max(c[1] for c in frame), max(c[2] for c in frame)
            alone = len(inside) == 1
            blocks = tuple(
                (i, tables[chosen[c[0]] >> 4], tables[16 + (chosen[c[0]] & 15)])
                for i, c in enumerate(inside)
                for _ in range(1 if alone else c[1] * c[2])
            )
            if alone:
                columns = -(-(-(-width * luma[1] // most_h)) // 8)
                rows = -(-(-(-height * luma[2] // most_v)) // 8)
                across = down = 1
            else:
                columns, rows = -(-width // (8 * most_h)), -(-height // (8 * most_v))
                across, down = luma[1], luma[2]
            scan = Scan(blocks, inside.index(luma))
            found = Image(
                width, height, scan, across, down, columns, rows, interval, quantisers[luma[3]], begin_scan, at
            )
    if found is None:
        raise ValueError("no luminance scan")
    return found, at


def _end_of_scan(data: bytes, at: int) -> int:
    """Where the next marker other than a restart begins."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the scan does not end")
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def _window(data: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The 16 bits at each place."""
    byte = bit >> 3
    three = (data[byte].astype(np.int64) << 16) | (data[byte + 1].astype(np.int64) << 8) | data[byte + 2]
    return (three >> (8 - (bit & 7))) & 0xFFFF


def _decode(scan: Scan, data: np.ndarray, begins: np.ndarray, mcus: np.ndarray) -> np.ndarray:
    """DC terms of the luminance blocks of every lane, as (lane, block); short lanes end in zeros."""
    tables = {}
    for _, dc, ac in scan.blocks:
        if (dc, ac) not in tables:
            tables[dc, ac] = (*_block_look_up(dc, ac), *_look_up(dc), *_look_up(ac))
    own = [c for c, _, _ in scan.blocks].count(scan.luma)
    most = int(mcus.max())
    out = np.zeros((len(begins), most * own), np.int32)
    bit = begins.astype(np.int64) * 8
    last = np.zeros((max(c for c, _, _ in scan.blocks) + 1, len(begins)), np.int64)
    order = np.argsort(-mcus, kind="stable")  # lanes that go on are the first ones
    alive, filled = len(order), 0
    ends = mcus[order]
    for m in range(most):
        alive = int(np.searchsorted(-ends, -m, side="left"))
        lanes = order[:alive]
        for component, dc, ac in scan.blocks:
            bits, steps, dc_lengths, dc_sizes, ac_lengths, ac_symbols = tables[dc, ac]
            window = _window(data, bit[lanes])
            used, step = bits[window], steps[window]
            hard = used == 0
            if hard.any():
                some, rows = np.flatnonzero(hard), lanes[hard]
                at, seen = bit[rows], window[some]
                if (dc_lengths[seen] == 0).any():
                    raise ValueError("no such code")
                at, size = at + dc_lengths[seen], dc_sizes[seen]
                value = _window(data, at) >> (16 - size)
                low = (size > 0) & (value < (1 << np.maximum(size - 1, 0)))
                step[some] = np.where(low, value - (1 << size) + 1, value)
                at = at + size
                k, going = np.ones(len(rows), np.int64), np.arange(len(rows))
                while len(going):
                    seen = _window(data, at[going])
                    if (ac_lengths[seen] == 0).any():
                        raise ValueError("no such code")
                    symbol = ac_symbols[seen]
                    at[going] += ac_lengths[seen] + (symbol & 15)
                    k[going] = np.where(symbol == 0, 64, k[going] + (symbol >> 4) + 1)
                    going = going[k[going] < 64]
                used[some] = at - bit[rows]
            bit[lanes] += used
            last[component, lanes] += step
            if component == scan.luma:
                out[lanes, filled] = last[component, lanes]
                filled += 1
    return out


def thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    """Per file, which may hold several images one after the other, the luminance of each image's blocks."""
    images, owner, at = [], [], 0
    for i, data in enumerate(files):
        begin = 0
        while begin < len(data):
            image, begin = parse(data, begin)
            images.append(image._replace(begin=at + image.begin, end=at + image.end))
            owner.append(i)
        at += len(data)
    whole = np.frombuffer(b"".join(files) + bytes(8), np.uint8)
    out: list[list[np.ndarray]] = [[] for _ in files]
    groups: dict[Scan, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault(image.scan, []).append(i)
    decoded: dict[int, np.ndarray] = {}
    for scan, members in groups.items():
        inside = np.zeros(len(whole) + 1, np.int64)
        for i in members:
            inside[images[i].begin] += 1
            inside[images[i].end] -= 1
        keep = np.cumsum(inside)[:-1] > 0
        # Stuffed zeros and restart markers are no data.
        ff = np.flatnonzero(keep[:-1] & (whole[:-1] == 255))
        following = whole[ff + 1]
        restart = ff[(following >= 0xD0) & (following <= 0xD7)]
        keep[ff + 1] = False
        keep[restart] = False
        place = np.concatenate([[0], np.cumsum(keep)])
        data = np.concatenate([whole[keep], np.full(8, 255, np.uint8)])
        begins, mcus, lanes = [], [], []
        for i in members:
            image = images[i]
            cuts = restart[np.searchsorted(restart, image.begin) : np.searchsorted(restart, image.end)]
            total = image.columns * image.rows
            each = image.interval or total
            n = -(-total // each)
            if len(cuts) + 1 != n:
                raise ValueError("restart markers do not agree with the size")
            begins.append(place[np.concatenate([[image.begin], cuts + 2])])
            mcus.append(np.minimum(each, total - each * np.arange(n)))
            lanes.append(n)
        terms = _decode(scan, data, np.concatenate(begins), np.concatenate(mcus))
        own = [c for c, _, _ in scan.blocks].count(scan.luma)
        first = 0
        for i, n in zip(members, lanes):
            image = images[i]
            rows = terms[first : first + n]
            total = image.columns * image.rows * own
            line = rows.reshape(-1)[:total] if rows.shape[1] * n == total or n == 1 else np.concatenate(
                [r[: own * m] for r, m in zip(rows, mcus[members.index(i)])]
            )
            first += n
            square = line.reshape(image.rows, image.columns, image.down, image.across).transpose(0, 2, 1, 3)
            square = square.reshape(image.rows * image.down, image.columns * image.across)
            square = square[: -(-image.height // 8), : -(-image.width // 8)]
            pixels = np.clip((square * image.quantiser + 4) // 8 + 128, 0, 255).astype(np.uint8)
            decoded[i] = pixels
    for i, pixels in sorted(decoded.items()):
        out[owner[i]].append(pixels)
    return out


def average_hash(pixels: np.ndarray) -> str:
    """64 bits: which of 8 x 8 cells are lighter than the whole."""
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    total[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)

    def cells(n: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.arange(8) * n // 8
        return low, np.maximum(low + 1, -(-(np.arange(8) + 1) * n // 8))

    (top, bottom), (left, right) = cells(pixels.shape[0]), cells(pixels.shape[1])
    sums = total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]
    areas = (bottom - top)[:, None] * (right - left)[None, :]
    return np.packbits(sums * pixels.size > total[-1, -1] * areas).tobytes().hex()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([8] * 64))
    + _segment(0xC4, bytes([0x00, *_DC[0], *_DC[1], 0x10, *_AC[0], *_AC[1]]))
    + _segment(0xDD, ROW.to_bytes(2, "big"))
)
_SCAN = _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block without AC terms, by its DC step + 255."""
    codes = {symbol: (code, length) for code, length, symbol in _codes(bytes([*_DC[0], *_DC[1]]))}
    bits, lengths = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for step in range(-255, 256):
        size = abs(step).bit_length()
        code, length = codes[size]
        value = step if step > 0 else step + (1 << size) - 1
        # One more bit, 0, ends the block.
        bits[step + 255] = ((code << size) | value) << 1
        lengths[step + 255] = length + size + 1
    return bits, lengths


_BITS, _LENGTHS = _block_codes()


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a multiple of 64 bytes, as images of at most ``MOST_ROWS`` rows."""
    counts = np.array([len(p) // ROW for p in payloads])
    values = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int64) - 128
    steps = np.diff(values, axis=1, prepend=0) + 255
    lengths = _LENGTHS[steps]
    row_bits = lengths.sum(1)
    row_bytes = -(-row_bits // 8)
    row_begins = np.cumsum(row_bytes) - row_bytes
    at = (row_begins * 8)[:, None] + np.cumsum(lengths, 1) - lengths
    # Each code of at most 17 bits lies in three bytes, whose bits no other code has.
    shifted = (_BITS[steps] << (24 - lengths - (at & 7))).ravel()
    byte = (at >> 3).ravel()
    size = int(row_bytes.sum()) + 3
    packed = np.zeros(size)
    for k in range(3):
        packed += np.bincount(byte + k, (shifted >> (16 - 8 * k)) & 255, minlength=size)
    packed = packed[:-3].astype(np.uint8)
    packed[row_begins + row_bytes - 1] |= ((1 << (row_bytes * 8 - row_bits)) - 1).astype(np.uint8)
    # Zeros after 255, and a restart marker before each row but an image's first.
    number = np.arange(len(row_bytes)) - np.repeat(np.cumsum(counts) - counts, counts)
    number %= MOST_ROWS
    marked = number > 0
    ff = packed == 255
    extra = np.zeros(len(packed) + 1, np.int64)
    extra[1:] += ff
    extra[row_begins[marked]] += 2
    place = np.arange(len(packed)) + np.cumsum(extra)[:-1]
    out = np.zeros(len(packed) + int(extra.sum()), np.uint8)
    out[place] = packed
    marks = place[row_begins[marked]]
    out[marks - 2], out[marks - 1] = 255, 0xD0 + (number[marked] - 1) % 8
    whole = out.tobytes()
    heads = np.append(place[row_begins], len(out))
    files, row = [], 0
    for n in counts.tolist():
        parts = []
        for first in range(row, row + n, MOST_ROWS):
            last = min(first + MOST_ROWS, row + n)
            size = ((last - first) * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big")
            frame = _segment(0xC0, bytes([8]) + size + bytes([1, 1, 0x11, 0]))
            parts += [_TABLES, frame, _SCAN, whole[heads[first] : heads[last]], b"\xff\xd9"]
        files.append(b"".join(parts))
        row += n
    return files
