"""Stored media against the texts they hold; the decoder against a plain one, bit by bit."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lumenfold.llm import jpeg
from lumenfold.llm.common import table


def plain_decode(data):
    """Coefficients of every block in scan order, by a loop over bits."""
    im = jpeg.parse(data)
    codes = {}
    for t, (bits, values) in im.tables.items():
        code, i, own = 0, 0, {}
        for n in range(1, 17):
            for _ in range(bits[n - 1]):
                own[(n, code)] = values[i]
                code, i = code + 1, i + 1
            code <<= 1
        codes[t] = own
    raw, parts, i = im.scan, [bytearray()], 0
    while i < len(raw):
        if raw[i] == 0xFF and raw[i + 1] == 0:
            parts[-1].append(0xFF)
            i += 2
        elif raw[i] == 0xFF:
            parts.append(bytearray())
            i += 2
        else:
            parts[-1].append(raw[i])
            i += 1
    out, left = [], im.mcus[0] * im.mcus[1]
    for part in parts:
        bits, at = "".join(f"{b:08b}" for b in part), 0

        def symbol(t):
            nonlocal at
            for n in range(1, 17):
                if (s := codes[t].get((n, int(bits[at : at + n], 2)))) is not None:
                    at += n
                    return s
            raise ValueError

        def extra(n):
            nonlocal at
            v = int(bits[at : at + n], 2) if n else 0
            at += n
            return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

        pred = {}
        for _ in range(min(im.restart or left, left)):
            for comp, dc, ac in im.blocks:
                block = [0] * 64
                pred[comp] = pred.get(comp, 0) + extra(symbol(dc))
                block[0], k = pred[comp], 1
                while k < 64:
                    s = symbol(0x10 + ac)
                    if s == 0:
                        break
                    k += s >> 4
                    block[k if k < 64 else 63] = extra(s & 15) if s & 15 else block[min(k, 63)]
                    k += 1
                out.append(block)
            left -= 1
    return np.array(out)


def colour_jpeg(width, height, restart, seed):
    """A three-component 4:2:0 image of random coefficients with tables of its own, written bit by bit."""
    rng = random.Random(seed)
    mx, my = -(-width // 16), -(-height // 16)
    blocks, dcs, acs = [], np.zeros(256, int), np.zeros(256, int)
    size = lambda v: abs(v).bit_length()
    plan = []
    pred = [0, 0, 0]
    for m in range(mx * my):
        if restart and m % restart == 0:
            pred = [0, 0, 0]
            plan.append("rst") if m else None
        for comp in (0, 0, 0, 0, 1, 2):
            b = [rng.randint(-300, 300)] + [rng.choice([0] * 12 + [1, -1, 5, -90, 700]) for _ in range(63)]
            if rng.random() < 0.2:
                b[1:] = [0] * 63
            blocks.append(b)
            seq = [("dc", size(b[0] - pred[comp]), b[0] - pred[comp])]
            pred[comp], run = b[0], 0
            for v in b[1:]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    seq.append(("ac", 0xF0, 0))
                    run -= 16
                seq.append(("ac", run * 16 + size(v), v))
                run = 0
            if run:
                seq.append(("ac", 0, 0))
            for kind, s, _ in seq:
                (dcs if kind == "dc" else acs)[s] += 1
            plan += seq
    dl, al = jpeg.huffman_lengths(dcs), jpeg.huffman_lengths(acs)
    (dcode, db, dv), (acode, ab, av) = jpeg.canonical(dl), jpeg.canonical(al)
    scan, bits, n_rst = bytearray(), "", 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for i in range(0, len(bits), 8):
            scan.append(int(bits[i : i + 8], 2))
            if scan[-1] == 0xFF:
                scan.append(0)
        bits = ""

    for x in plan:
        if x == "rst":
            flush()
            scan.extend([0xFF, 0xD0 + n_rst % 8])
            n_rst += 1
            continue
        kind, s, v = x
        code, length = (dcode[s], dl[s]) if kind == "dc" else (acode[s], al[s])
        bits += f"{code:0{length}b}"
        n = s if kind == "dc" else s & 15
        if n:
            bits += f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"
    flush()
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, *range(1, 65)])) + seg(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, bytes([0, *db, *dv]) + bytes([0x10, *ab, *av])) + (seg(0xDD, struct.pack(">H", restart)) if restart else b"")
    return head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + bytes(scan) + b"\xff\xd9", np.array(blocks)


@pytest.mark.parametrize("restart", [0, 1, 5])
def test_colour_images(restart):
    made = [colour_jpeg(70, 45, restart, i) for i in range(3)]
    images = [jpeg.parse(d) for d, _ in made]
    for (data, want), im, got in zip(made, images, jpeg.decode(images)):
        assert (got == want).all() and (plain_decode(data) == want).all()
        thumb = jpeg.thumbnail(im, got)
        assert thumb.shape == (6, 9)
        # Block row 0, column 3 is the second block of the second MCU.
        assert thumb[0, 3] == np.clip(np.rint(want[6 + 1, 0] / 8 + 128), 0, 255)


@pytest.mark.parametrize("payload", [bytes(64), b"a" * 64, bytes(range(256)), b"\xff" * 640, "Text é. ".encode() * 999 + bytes(55), bytes(random.Random(1).randbytes(64 * 700)), (b" " * 63 + b"x") * 3, b"e" + b" " * 63])
def test_payload_round_trip(payload):
    payload = payload[: len(payload) // 64 * 64]
    data = jpeg.encode(payload)
    im = jpeg.parse(data)
    (got,) = jpeg.decode([im])
    assert jpeg.payload_of(im, got) == payload
    if len(payload) < 10_000:
        assert (plain_decode(data) == got).all()
    assert jpeg.encode_many([b"z" * 128, payload, bytes(64)])[1] == data


def test_damage_is_seen():
    data = jpeg.encode(b"some text to keep " * 64)
    for bad in (b"", b"\xff\xd8", data[:-40], data[:-2], data.replace(b"\xff\xd0", b"\x11\x11", 1), data.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, struct.error)):
            im = jpeg.parse(bad)
            jpeg.payload_of(im, jpeg.decode([im])[0])


def test_optimal_lengths_are_a_code():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = (rng.random(256) ** 12 * 1e7).astype(int)
        n = jpeg.huffman_lengths(counts)
        assert (n[counts > 0] > 0).all() and n.max() <= 16 and sum(2.0 ** -n[n > 0]) < 1


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_query(spark, odd_docs, sf, which):
    docs = odd_docs if which == "odd" else table(spark, sf, "documents")
    got = jpeg.media_query(spark, docs).collect()
    want, texts = [], {}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        pay = data + bytes(-len(data) % 64 or (0 if data else 64))
        want.append((str(r["doc_id"]), len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    for r in got:
        assert texts.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"], r["media_bytes"])) == (r["media_sha256"], r["feature"], r["media_bytes"])


def test_no_rows(spark, no_docs):
    assert jpeg.media_query(spark, no_docs).count() == 0
