import hashlib
import os
import struct
import zlib

import numpy as np

from stratalens.llm import jpeg as J, queries as Q


def test_round_trip_of_bytes():
    payloads = [bytes(64), bytes(range(256)) * 3, os.urandom(64 * 200), b"\xff" * 640, b"\x00\xff" * 320, os.urandom(64 * (2 * J.MAX_ROWS + 5))]
    media = J.encode(payloads)
    for p, m, t in zip(payloads, media, J.thumbnails(media)):
        assert t.tobytes() == p and t.shape == (len(p) // 64, 64)
        assert m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9"
        alone = J.thumbnails([m])[0]
        assert alone.tobytes() == p


def slow_scan(bits, blocks, dc_codes, ac_codes):
    """Bit by bit, for the test of a general image."""
    pos, out, pred = 0, [], [0] * 3

    def symbol(codes):
        nonlocal pos
        code = n = 0
        while True:
            code, n, pos = code << 1 | int(bits[pos]), n + 1, pos + 1
            if (code, n) in codes:
                return codes[code, n]

    for c in blocks:
        cat = symbol(dc_codes)
        raw = int(bits[pos : pos + cat] or "0", 2)
        pos += cat
        pred[c] += raw if cat and raw >> (cat - 1) else raw - (1 << cat) + 1 if cat else 0
        out.append((c, pred[c]))
        k = 1
        while k < 64:
            rs = symbol(ac_codes)
            if rs == 0:
                break
            k += (rs >> 4) + 1
            pos += rs & 15
    return out


def test_colour_image_with_subsampling_and_ac():
    """4:2:0, no restart markers, AC coefficients: written bit by bit here."""
    r = np.random.default_rng(4)
    ac_counts, ac_values = [0, 2, 1] + [0] * 13, [0x00, 0x01, 0xF0]
    dc = {v: (c, n) for v, c, n in J.huffman_codes(J.DC_COUNTS, J.DC_VALUES)}
    ac = {v: (c, n) for v, c, n in J.huffman_codes(ac_counts, ac_values)}
    bits, pred, lum, blocks = "", [0] * 3, [], []
    for _ in range(3 * 2):
        for c in [0, 0, 0, 0, 1, 2]:
            v = int(r.integers(-100, 100))
            d, pred[c] = v - pred[c], v
            cat = abs(d).bit_length()
            bits += format(dc[cat][0], f"0{dc[cat][1]}b") + (format(d if d >= 0 else d + (1 << cat) - 1, f"0{cat}b") if cat else "")
            for _ in range(int(r.integers(0, 3))):
                bits += format(ac[1][0], f"0{ac[1][1]}b") + "1"
            if r.random() < 0.3:
                bits += format(ac[0xF0][0], f"0{ac[0xF0][1]}b")
            bits += format(ac[0][0], f"0{ac[0][1]}b")
            blocks.append(c)
            if c == 0:
                lum.append(v)
    assert [v for c, v in slow_scan(bits, blocks, {(c, n): v for v, (c, n) in dc.items()}, {(c, n): v for v, (c, n) in ac.items()}) if c == 0] == lum
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    image = b"\xff\xd8" + J._segment(0xDB, bytes([0] + [16] * 64)) + J._segment(0xC0, struct.pack(">BHHB9B", 8, 30, 41, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0)) + J._segment(0xC4, bytes([0, *J.DC_COUNTS, *J.DC_VALUES])) + J._segment(0xC4, bytes([0x10, *ac_counts, *ac_values])) + J._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (thumb,) = J.thumbnails([image])
    grid = np.clip(np.array(lum).reshape(2, 3, 2, 2).transpose(0, 2, 1, 3).reshape(4, 6) * 2 + 128, 0, 255)
    assert (thumb == grid[:4, :6]).all()
    assert J.thumbnails([image[:40], b"", None, b"\xff\xd8\xff\xc2\0\2", image]) [:4] == [None] * 4


def test_query(spark, tmp_path):
    texts = [None, "", "héllo", "x" * 64, "é" * 5000, "x" * 64]
    spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in Q.op10_media_columns(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        media = J.encode([full])[0]
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[3].feature == rows[5].feature
    assert J.read(J.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_groups_do_not_change_bytes(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    payloads = [r.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 3, 8191, 8192, 20_000, 2)]
    whole = J.encode(payloads)
    thumbs = J.thumbnails(whole)
    assert [t.tobytes() for t in thumbs] == payloads
    monkeypatch.setattr(J, "GROUP", 64 * 100)
    assert J.encode(payloads) == whole
    assert [t.tobytes() for t in J.thumbnails(whole)] == payloads


def test_memory_of_a_long_text_is_bounded():
    import tracemalloc

    payload = b"some text of a very long document " * (64 * 8000)
    payload += bytes(-len(payload) % 64)
    tracemalloc.start()
    [media] = J.encode([payload])
    [thumb] = J.thumbnails([media])
    assert thumb.tobytes() == payload and len(J.thumbnail_hash(thumb)) == 32
    assert tracemalloc.get_traced_memory()[1] < 8 * len(payload) + (200 << 20)
    tracemalloc.stop()
