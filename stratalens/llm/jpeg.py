"""Media columns: payloads in baseline JPEG, read back from their DC coefficients.

Storing: the UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, become 8x8
blocks of one grey each, 64 blocks to a row. The quantiser is 8 for the DC coefficient,
so a byte is the coefficient itself (less 128) and the round trip is lossless. Each row of
blocks is a restart interval. A frame has at most 8191 rows (JPEG's largest height); a
longer payload is a sequence of frames.

Reading: markers are parsed, the restart intervals of all images of a batch are
Huffman-decoded in lock step with numpy (one table lookup per symbol for all intervals at
once), and the DC coefficients of the luminance give the thumbnail, an eighth of the size.
Any baseline image is read, with any Huffman tables, subsampling and restart interval;
AC coefficients are passed over. Progressive or damaged files give a null thumbnail.

Null and empty texts are 64 zero bytes. Equal texts give equal values, repeated rows and ties
are no matter. Nothing is shuffled. Values are encoded and decoded in groups of frames of
about ``GROUP`` bytes, so a task holds a few MB besides the values themselves, and a very
long text costs a few times its own size. Extra columns of ``read`` stay; their names must
differ from those it adds.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

ROW, MAX_ROWS, GROUP = 64, 8191, 1 << 20
# The DC luminance code lengths of the JPEG standard's annex K (number of
# codes of 1..16 bits); the categories 0..11 follow in order.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = list(range(12))
# one AC code: end of block, one bit
AC_COUNTS, AC_VALUES = [1] + [0] * 15, [0]


def huffman_codes(counts: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(value, code, length): codes of one length are consecutive, shorter ones first."""
    out, code, i = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((values[i], code, length))
            code, i = code + 1, i + 1
        code <<= 1
    return out


def _writer_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for every DC difference from -255 to 255: the category's
    code, the magnitude, end of block."""
    codes = {v: (c, n) for v, c, n in huffman_codes(DC_COUNTS, DC_VALUES)}
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = codes[cat]
        magnitude = d if d >= 0 else d + (1 << cat) - 1
        bits[d + 255], size[d + 255] = ((code << cat) | magnitude) << 1, n + cat + 1
    return bits, size


BITS, SIZES = _writer_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xDB, bytes([0] + [8] * 64))
        + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * rows, 8 * ROW, 1, 1, 0x11, 0))
        + _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_VALUES]))
        + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_VALUES]))
        + _segment(0xDD, struct.pack(">H", ROW))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def grouped(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of neighbours whose sizes add up to ``most`` at most, if more than one."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if sizes:
        yield first, len(sizes)


def encode(payloads: list[bytes]) -> list[bytes]:
    """The JPEG stream of each payload (a positive multiple of 64 bytes each), frame by
    frame: what is held besides the streams is bounded by ``GROUP`` bytes of payload."""
    cut = ROW * MAX_ROWS
    spans = [(i, a, min(a + cut, len(p))) for i, p in enumerate(payloads) for a in range(0, len(p), cut)]
    media: list[list[bytes]] = [[] for _ in payloads]
    for first, end in grouped([b - a for _, a, b in spans], GROUP):
        made = _encode_frames([payloads[i][a:b] for i, a, b in spans[first:end]])
        for (i, *_), frame in zip(spans[first:end], made):
            media[i].append(frame)
    return [b"".join(frames) for frames in media]


def _encode_frames(payloads: list[bytes]) -> list[bytes]:
    """One image of each payload of at most ``MAX_ROWS`` rows."""
    rows_of = [len(p) // ROW for p in payloads]
    v = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    diff = v.copy()
    diff[:, 1:] -= v[:, :-1]
    diff = diff.astype(np.int64) + 255
    bits, size = BITS[diff], SIZES[diff]
    # two symbols make one piece of at most 30 bits
    piece, length = (bits[:, ::2] << size[:, 1::2]) | bits[:, 1::2], size[:, ::2] + size[:, 1::2]
    offset = np.cumsum(length, axis=1) - length
    total = offset[:, -1] + length[:, -1]
    nbytes = (total + 7) // 8
    start = np.cumsum(nbytes) - nbytes
    out = np.zeros(int(nbytes.sum()) + 8, np.uint8)
    for c in range(piece.shape[1]):
        at = start + (offset[:, c] >> 3)
        word = piece[:, c] << (40 - length[:, c] - (offset[:, c] & 7))
        for k in range(5):
            out[at + k] |= ((word >> (32 - 8 * k)) & 255).astype(np.uint8)
    out = out[: int(nbytes.sum())]
    pad = (8 * nbytes - total).astype(np.int64)
    out[start + nbytes - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # 0xFF is followed by 0; a restart marker ends each row but the last of its frame
    number = np.concatenate([np.arange(r) for r in rows_of])
    last = np.zeros(len(number), bool)
    last[np.cumsum(rows_of) - 1] = True
    full = out == 255
    row_at = np.repeat(np.arange(len(nbytes)), nbytes)
    shift = np.cumsum(full) - full + (2 * np.concatenate(([0], np.cumsum(~last)[:-1])))[row_at]
    scan = np.zeros(len(out) + int(full.sum()) + 2 * int((~last).sum()), np.uint8)
    place = np.arange(len(out)) + shift
    scan[place] = out
    row_end = place[start + nbytes - 1] + 1 + full[start + nbytes - 1]
    mid = np.flatnonzero(~last)
    scan[row_end[mid]], scan[row_end[mid] + 1] = 255, 0xD0 + number[mid] % 8
    data, media, at, row = scan.tobytes(), [], 0, 0
    for rows in rows_of:
        end = int(row_end[row + rows - 1])
        media.append(_head(rows) + data[at:end] + b"\xff\xd9")
        at, row = end, row + rows
    return media


@dataclass
class Frame:
    """What the markers of one image say, and where its scan stands."""

    height: int = 0
    width: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # the DC entry
    tables: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    interval: int = 0
    scan: tuple[tuple[int, int, int], ...] = ()  # component index, DC table, AC table
    data: tuple[int, int] = (0, 0)


def parse(media: bytes) -> list[Frame]:
    """The frames of a stream of baseline images; raises ValueError on anything else."""
    frames, i, f = [], 0, None
    tables, quantisers, interval = {}, {}, 0
    while i + 1 < len(media):
        if media[i] != 0xFF:
            raise ValueError("a marker is missing")
        m = media[i + 1]
        if m == 0xFF:
            i += 1
            continue
        i += 2
        if m == 0xD8:
            f, tables, quantisers, interval = Frame(), {}, {}, 0
            continue
        if m == 0xD9:
            continue
        if f is None or i + 2 > len(media):
            raise ValueError("no start of image")
        body = media[i + 2 : i + struct.unpack(">H", media[i : i + 2])[0]]
        i += len(body) + 2
        if m == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif m == 0xC4:
            while body:
                counts = tuple(body[1:17])
                n = sum(counts)
                tables[body[0]] = (counts, tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif m == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif m in (0xC0, 0xC1):
            depth, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not f.height or not f.width:
                raise ValueError("not 8 bits a sample")
            f.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= m <= 0xCF and m != 0xC8 and m != 0xCC:
            raise ValueError("not baseline")
        elif m == 0xDA:
            ids = [c[0] for c in f.components]
            f.scan = tuple((ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15) for k in range(body[0]))
            f.tables, f.quantisers, f.interval = dict(tables), dict(quantisers), interval
            end = i
            while True:  # to the next marker that is no restart
                end = media.find(b"\xff", end)
                if end < 0 or end + 1 >= len(media):
                    raise ValueError("the scan has no end")
                if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            if 0 in (s[0] for s in f.scan):
                f.data = (i, end)
                frames.append(f)
            i = end
    if not frames:
        raise ValueError("no scan with luminance")
    return frames


def _lookup(table: tuple[tuple[int, ...], tuple[int, ...]]) -> np.ndarray:
    """By the next 16 bits: value << 8 | code length; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int64)
    for value, code, n in huffman_codes(list(table[0]), list(table[1])):
        out[code << (16 - n) : (code + 1) << (16 - n)] = value << 8 | n
    return out


def _layout(f: Frame) -> tuple[int, int, list[int]]:
    """MCUs across and down, and the scan component of each block of an MCU."""
    if len(f.scan) == 1:
        h, v = max(c[1] for c in f.components), max(c[2] for c in f.components)
        _, ch, cv, _ = f.components[f.scan[0][0]]
        return -(-(-(-f.width * ch // h)) // 8), -(-(-(-f.height * cv // v)) // 8), [0]
    h, v = max(c[1] for c in f.components), max(c[2] for c in f.components)
    return -(-f.width // (8 * h)), -(-f.height // (8 * v)), [k for k, s in enumerate(f.scan) for _ in range(f.components[s[0]][1] * f.components[s[0]][2])]


def _decode_alike(frames: list[tuple[bytes, Frame]]) -> list[np.ndarray | None]:
    """Luminance thumbnails of frames with the same tables, components and interval."""
    f0 = frames[0][1]
    _, _, kinds = _layout(f0)
    per = len(kinds)
    kind = np.array(kinds)
    look = [np.stack([_lookup(f0.tables[s[w]]) for s in f0.scan]) for w in (1, 2)]
    sizes = [f.data[1] - f.data[0] for _, f in frames]
    data = np.frombuffer(b"".join(m[f.data[0] : f.data[1]] for m, f in frames) + bytes(8), np.uint8)
    base = np.concatenate(([0], np.cumsum(sizes)))
    ff = np.flatnonzero(data[:-1] == 255)
    nxt = data[ff + 1]
    keep = np.ones(len(data), bool)
    keep[ff[nxt == 0] + 1] = False
    rst = ff[(nxt >= 0xD0) & (nxt <= 0xD7)]
    keep[rst] = keep[rst + 1] = False
    cuts = np.sort(np.concatenate((base[:-1], rst)))
    owner = np.searchsorted(base, cuts, side="right") - 1
    packed = np.cumsum(keep) - keep
    begin = packed[cuts].astype(np.int64)
    clean = np.concatenate((data[keep].astype(np.int64), np.zeros(8, np.int64)))
    window = (clean[:-3] << 24) | (clean[1:-2] << 16) | (clean[2:-1] << 8) | clean[3:]
    top = len(window) - 1
    # blocks of each interval
    number = np.arange(len(cuts)) - np.searchsorted(owner, owner, side="left")
    mcus = np.array([_layout(f)[0] * _layout(f)[1] for _, f in frames])
    step = np.array([f.interval or n for (_, f), n in zip(frames, mcus)])
    todo = np.clip(mcus[owner] - number * step[owner], 0, step[owner]) * per
    dc = np.zeros((len(cuts), int(todo.max(initial=0))), np.int32)
    pred = np.zeros((len(cuts), len(f0.scan)), np.int64)
    bad = np.zeros(len(frames), bool)
    bad[np.bincount(owner, minlength=len(frames)) != -(-mcus // step)] = True
    live = np.flatnonzero((todo > 0) & ~bad[owner])
    p, k, b = 8 * begin[live], np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)

    def peek(at):
        return (window[np.minimum(at >> 3, top)] >> (16 - (at & 7))) & 0xFFFF

    def value(at, cat):
        raw = peek(at) >> (16 - cat)
        return np.where(raw < (1 << np.maximum(cat - 1, 0)), raw - (1 << cat) + 1, raw)

    while len(live):
        fresh = k == 0
        s = slice(None) if fresh.all() else np.flatnonzero(fresh)
        c = kind[b[s] % per] if per > 1 else np.zeros(len(b[s]), np.int64)
        sym = look[0][c, peek(p[s])] if per > 1 else look[0][0][peek(p[s])]
        wrong = sym == 0
        cat = np.minimum(sym >> 8, 11)
        at = p[s] + (sym & 255)
        now = pred[live[s], c] + np.where(cat > 0, value(at, cat), 0)
        pred[live[s], c] = now
        dc[live[s], b[s]] = now
        p[s], k[s] = at + cat, 1
        if wrong.any():
            bad[owner[live[s][wrong]]] = True
        c = kind[b % per] if per > 1 else 0
        sym = look[1][c, peek(p)] if per > 1 else look[1][0][peek(p)]
        if (sym == 0).any():
            bad[owner[live[sym == 0]]] = True
        rs = sym >> 8
        p += (sym & 255) + (rs & 15)
        k = np.where(rs == 0, 64, k + (rs >> 4) + 1)
        done = k >= 64
        if done.all():
            b += 1
            k[:] = 0
        else:
            b[done] += 1
            k[done] = 0
        more = (b < todo[live]) & ~bad[owner[live]]
        if not more.all():
            live, p, k, b = live[more], p[more], k[more], b[more]
    out: list[np.ndarray | None] = []
    for n, (_, f) in enumerate(frames):
        if bad[n]:
            out.append(None)
            continue
        across, down, _ = _layout(f)
        own = np.flatnonzero(owner == n) if len(frames) < 3 else np.arange(np.searchsorted(owner, n), np.searchsorted(owner, n + 1))
        blocks = dc[own].ravel() if dc.shape[1] == step[n] * per else np.concatenate([dc[i, : todo[i]] for i in own])
        blocks = blocks[: across * down * per]
        if per > 1:
            lum = [k for k, s in enumerate(f.scan) if s[0] == 0][0]
            blocks = blocks.reshape(-1, per)[:, kind == lum]
            h, v = f.components[0][1:3]
            grid = blocks.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        else:
            grid = blocks.reshape(down, across)
        q = f.quantisers.get(f.components[0][3], 1)
        thumb = np.clip((grid.astype(np.int64) * q + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        hmax, vmax = max(c[1] for c in f.components), max(c[2] for c in f.components)
        out.append(thumb[: -(-(-(-f.height * f.components[0][2] // vmax)) // 8), : -(-(-(-f.width * f.components[0][1] // hmax)) // 8)])
    return out


def thumbnails(media: list[bytes | None]) -> list[np.ndarray | None]:
    """DC-only luminance of each stream; the frames of one stream stand below each other."""
    parsed: list[list[Frame]] = []
    for m in media:
        try:
            parsed.append(parse(m or b""))
        except (ValueError, IndexError, struct.error):
            parsed.append([])
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, frames in enumerate(parsed):
        for j, f in enumerate(frames):
            key = (tuple(f.scan), tuple(f.components), f.interval > 0, tuple(sorted(f.tables.items())))
            groups.setdefault(key, []).append((i, j))
    found: dict[tuple[int, int], np.ndarray | None] = {}
    for alike in groups.values():
        for first, end in grouped([parsed[i][j].data[1] - parsed[i][j].data[0] for i, j in alike], GROUP):
            which = alike[first:end]
            try:
                made = _decode_alike([(media[i], parsed[i][j]) for i, j in which])
            except (ValueError, IndexError, KeyError):
                made = [None] * len(which)
            found |= dict(zip(which, made))
    out = []
    for i, frames in enumerate(parsed):
        own = [found[i, j] for j in range(len(frames))]
        out.append(None if not own or any(t is None for t in own) or len({t.shape[1] for t in own}) > 1 else np.concatenate(own))
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit average hash and 64-bit gradient hash over a 9 x 8 grid of cell means."""
    h, w = thumb.shape
    y0, x0 = np.arange(8) * h // 8, np.arange(9) * w // 9
    y1, x1 = np.maximum(y0 + 1, (np.arange(8) + 1) * h // 8), np.maximum(x0 + 1, (np.arange(9) + 1) * w // 9)
    cell = np.zeros((8, 9))
    for i in range(8):  # a band's column sums at a time
        sums = np.concatenate(([0], np.cumsum(thumb[y0[i] : y1[i]].sum(axis=0, dtype=np.int64))))
        cell[i] = (sums[x1] - sums[x0]) / ((y1[i] - y0[i]) * (x1 - x0))
    bits = np.packbits(np.concatenate(((cell[:, :8] >= cell[:, :8].mean()).ravel(), (cell[:, 1:] > cell[:, :-1]).ravel())))
    return bits.tobytes().hex()


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a stream of baseline JPEG frames."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        media = encode([r + bytes(-len(r) % ROW or (0 if r else ROW)) for r in raw])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), run, "doc_id long, n_bytes long, media binary", "t", 2 << 20)


def read(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with what the stored images say: ``width, height`` in samples,
    ``thumbnail`` (rows of DC luminance, bytes), ``thumbnail_hash``; null where the
    column is null or no baseline JPEG."""
    out = media.selectExpr("*", "cast(null as int) as width", "cast(null as int) as height", "cast(null as binary) as thumbnail", "cast(null as string) as thumbnail_hash")
    at, names = out.columns.index(column), out.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        thumbs = thumbnails(batch.column(at).to_pylist())
        new = [
            pa.array([None if t is None else 8 * t.shape[1] for t in thumbs], pa.int32()),
            pa.array([None if t is None else 8 * t.shape[0] for t in thumbs], pa.int32()),
            pa.array([None if t is None else t.tobytes() for t in thumbs], pa.binary()),
            pa.array([None if t is None else thumbnail_hash(t) for t in thumbs], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns[:-4], *new], names)

    return map_batches(out, run, out.schema, column, 2 << 20)

