import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from treeloom.llm.media import UNKNOWN, as_pgm, as_wav, automaton, carve, op5, padded, regions, sniff, stored


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "hello")
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\0\0\0\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0\x3b"
JPEG = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2\x11\xff\0\x22\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"moov")
OGG = b"OggS\0\6" + b"\0" * 20 + b"\1\3abc"
PDF = b"%PDF-1.4\nstuff\nstartxref\n0\n%%EOF"
SAMPLES = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "video/mp4": MP4, "application/ogg": OGG, "application/pdf": PDF, "application/zip": archive(), "application/gzip": gzip.compress(b"x" * 99), "audio/wav": as_wav(b"abcd"), "image/x-portable-graymap": as_pgm(b"a" * 192)}


def test_every_format_whole_truncated_and_embedded():
    magic = automaton()
    for kind, data in SAMPLES.items():
        assert [(x.media_type, x.offset, x.length) for x in regions(data, magic)][:1] == [(kind, 0, len(data))], kind
        assert not [x for x in regions(data[:-1], magic) if x.media_type == kind and not x.offset], kind
        host = b"some text BM GIF89a RIFF P5 " + data + b" tail"
        assert [(x.media_type, x.offset, x.length) for x in regions(host, magic)] == [(kind, 28, len(data))], kind


def test_time_grows_with_length():
    magic, began = automaton(), time.time()
    for part in (b"%PDF-1", b"%PDF-1 startxref ", b"PK\3\4", b"PK\3\4PK\5\6" + b"\0" * 18, b"\x1f\x8b\x08", b"\x1f\x8b\x08\x08abcdefg", b"GIF89aaaaaaaa,bbbbbbbb ", b"\0\0\0\x08ftyp", b"BM", b"P5 ", b"RIFF"):
        regions(part * (2_000_000 // len(part)), magic)
    assert time.time() - began < 60
    name = io.BytesIO()
    with gzip.GzipFile("named.txt", "wb", fileobj=name) as f:
        f.write(b"x" * 3_000_000)
    assert [(x.media_type, x.offset, x.length) for x in regions(b"ab" + name.getvalue() + b"c", magic)] == [("application/gzip", 2, len(name.getvalue()))]


@given(st.binary(max_size=300))
@settings(max_examples=200, deadline=None)
def test_regions_stay_inside_and_never_crash(data):
    for start in (b"", *(x[:12] for x in SAMPLES.values())):
        for x in regions(start + data, automaton()):
            assert x.offset + x.length <= len(start + data)


def test_sniff_corrects_and_carves(spark):
    rows = [(k, data, "image/png") for k, data in enumerate(SAMPLES.values())] + [(90, b"nothing", None), (91, None, "image/png"), (92, b"", None), (93, b"xx" + png() + GIF, "text/plain")]
    df = spark.createDataFrame(rows, "doc_id long, content binary, declared string")
    out = {r["doc_id"]: r for r in sniff(df, declared_col="declared").collect()}
    assert [out[k]["media_type"] for k in range(len(SAMPLES))] == list(SAMPLES)
    assert [out[k]["corrected"] for k in range(3)] == [False, True, True]
    assert out[90]["media_type"] == out[91]["media_type"] == out[92]["media_type"] == UNKNOWN
    assert not out[91]["corrected"] and not out[90]["corrected"] and out[93]["media_type"] == UNKNOWN and not out[93]["corrected"]
    assert [(r["media_type"], bytes(r["content"])) for r in carve(df.where("doc_id = 93")).orderBy("offset").collect()] == [("image/png", png()), ("image/gif", GIF)]


def test_round_trip(spark):
    texts = [None, "", "a", "x" * 192, "é" * 97, "long " * 40000, "a", "GIF89a BM RIFF", "\x00퟿"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    out = {r["doc_id"]: r for r in op5(df).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload)) and padded(t)[0] == payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(as_wav(payload)), hashlib.sha256(as_wav(payload)).hexdigest())
        assert r["media_type"] == "audio/wav" and r["corrected"]
    assert out[2]["feature"] == out[6]["feature"]
    kept = {r["doc_id"]: r for r in stored(df, store="pgm", keep=True).collect()}
    assert all(bytes(kept[i]["media"]) == as_pgm(padded(t)[0]) and kept[i]["payload_sha256"] == out[i]["payload_sha256"] for i, t in enumerate(texts))
    assert op5(spark.createDataFrame([], T._parse_datatype_string("doc_id long, text string"))).collect() == []
