"""A minimal MP4 file built from atoms."""

import struct


def atom(kind: bytes, content: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(content), kind) + content


def mp4(width=960, height=540, samples=6, gop=2, ticks=1001, timescale=30000, entry=b"avc1"):
    units = [struct.pack(">I", 3) + bytes([k, k, k]) for k in range(samples)]
    sps, pps = b"\x67\x01\x02", b"\x68\x03"
    config = bytes([1, 0, 0, 0, 0xFF, 0xE1]) + struct.pack(">H", len(sps)) + sps + b"\x01" + struct.pack(">H", len(pps)) + pps
    inner = atom(b"avcC", config) if entry == b"avc1" else b""
    sample = atom(entry, bytes(24) + struct.pack(">HH", width, height) + bytes(50) + inner)
    keys = list(range(1, samples + 1, gop))
    stbl = atom(b"stsd", struct.pack(">II", 0, 1) + sample) + atom(b"stss", struct.pack(f">II{len(keys)}I", 0, len(keys), *keys))
    stbl += atom(b"stsz", struct.pack(f">III{samples}I", 0, 0, samples, *map(len, units))) + atom(b"stts", struct.pack(">IIII", 0, 1, samples, ticks))
    mdia = atom(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, timescale, samples * ticks, 0, 0)) + atom(b"minf", atom(b"stbl", stbl))
    return atom(b"ftyp", b"isom") + atom(b"moov", atom(b"trak", atom(b"mdia", mdia))) + atom(b"mdat", b"".join(units)), b"".join(units)
