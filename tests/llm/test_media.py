import hashlib
import struct
import zlib

import pytest

from storyloom.llm import media


def box(kind, *parts):
    data = b"".join(parts)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def test_round_trip_and_tables():
    for n in (64, 128, 64 * 15, 64 * 16, 64 * 33, 64 * 1000):
        payload = bytes(i * 7 % 251 for i in range(n))
        data = media.mux(payload)
        brand, (track,) = media.parse(data)
        frames = n // 64
        assert (brand, track.codec, track.handler, track.width, track.height) == ("isom", "raw ", "vide", 8, 8)
        assert media.samples(data, track) == payload and len(track.sizes) == track.duration == frames and track.timescale == 25
        start = data.index(b"mdat") + 4
        assert track.ranges(track.keys) == [(start + 64 * k, 64) for k in range(0, frames, 16)]


def test_hand_made_file_with_64_bit_and_varied_sizes():
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + 60) + bytes(range(60))
    first = 16

    def full(kind, *parts):
        return box(kind, bytes(4), *parts)

    def audio(offset):
        stsd = full(b"stsd", struct.pack(">I", 1), box(b"mp4a", bytes(28)))
        stbl = box(b"stbl", stsd, full(b"stsz", struct.pack(">II5I", 0, 5, 4, 6, 8, 10, 12)), full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 3, 1)), full(b"co64", struct.pack(">IQQ", 2, offset, offset + 20)))
        mdhd = box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQ", 0, 0, 1000, 2500), bytes(4))
        return box(b"trak", box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(13)), box(b"minf", stbl)))

    data = mdat + box(b"moov", audio(first), box(b"free", b"xx"))
    _, (t,) = media.parse(data)
    assert (t.codec, t.handler, t.timescale, t.duration) == ("mp4a", "soun", 1000, 2500)
    assert t.offsets.tolist() == [16, 20, 36, 44, 54] and t.keys.tolist() == [0, 1, 2, 3, 4]
    assert t.ranges() == [(16, 10), (36, 30)]


def test_broken_files_give_errors(spark):
    good = media.mux(bytes(64))
    bad = [None, b"", b"abc", good[:50], b"\0\0\0\0moov", good[:40] + b"\xff" * 40 + good[80:], b"\0\0\0\x04ftyp"]
    rows = [(i, x) for i, x in enumerate([good, *bad, good])] + [(None, good)]
    got = media.probe(spark.createDataFrame(rows, "doc_id long, media binary").selectExpr("*", "1 tracks")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (0, 8, None):
            assert r.error is None and r.tracks[0].codec == "raw " and r.tracks[0].seconds == 0.04 and r.tracks[0].keyframes[0].length == 64
        elif r.doc_id != 6:
            assert r.error and r.tracks == []
    with pytest.raises(ValueError):
        media.mux(b"x")


def test_query(spark, tmp_path):
    from storyloom.llm import queries

    rows = [(0, None), (1, ""), (2, "x" * 64), (3, "é" * 40), (4, "long " * 60000), (4, "long " * 60000), (None, "q")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' media").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_media(spark, str(tmp_path)).collect()
    assert len(got) == 7
    for r in got:
        text = (dict(rows)[r.doc_id] or "").encode()
        payload = text + bytes(-len(text) % 64 if text else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.mux(payload)), hashlib.sha256(media.mux(payload)).hexdigest())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media.read_back(media.store_texts(empty)).count() == 0


def _moov(number, sizes_box, extra=b""):
    """A movie box of one track with the given box of sizes, and chunks of one sample each where there are some."""
    mdhd = media._full(b"mdhd", media.struct.pack(">IIIIHH", 0, 0, 25, 0, 0x55C4, 0))
    stts = media._full(b"stts", media.struct.pack(">III", 1, 3, 50))
    stbl = media._box(b"stbl", media._full(b"stsd", media.struct.pack(">I", 0)), stts, sizes_box, extra)
    tkhd = media._box(b"tkhd", b"\0\0\0\7", media.struct.pack(">IIIII", 0, 0, number, 0, 0))
    mdia = media._box(b"mdia", mdhd, media._full(b"hdlr", bytes(4), b"vide", bytes(13)), media._box(b"minf", stbl))
    return media._box(b"trak", tkhd, mdia)


@pytest.mark.parametrize(("bits", "table"), [(4, b"\x35\x70"), (8, b"\x03\x05\x07"), (16, b"\0\3\0\5\0\7")])
def test_compact_sizes(bits, table):
    pack = media.struct.pack
    head = media._box(b"ftyp", b"isom", pack(">I", 0))

    def whole(first):
        sizes = media._full(b"stz2", pack(">I", bits), pack(">I", 3), table)
        chunks = media._full(b"stco", pack(">II", 1, first)) + media._full(b"stsc", pack(">IIII", 1, 1, 3, 1))
        return head + media._box(b"moov", _moov(1, sizes, chunks)) + media._box(b"mdat", b"abcdefghijklmno")

    data = whole(0)
    data = whole(data.index(b"mdat") + 4)
    (track,) = media.parse(data)[1]
    assert track.sizes.tolist() == [3, 5, 7] and media.samples(data, track) == b"abcdefghijklmno" and track.duration == 150
    with pytest.raises(ValueError, match="compact"):
        media.parse(data.replace(pack(">I", bits) + pack(">I", 3), pack(">I", bits) + pack(">I", 3000)))


def test_fragments():
    """Two fragments of a track: sizes of their own, default sizes; the second and fifth samples are no keyframes."""
    pack = media.struct.pack
    head = media._box(b"ftyp", b"iso5", pack(">I", 0))
    moov = media._box(b"moov", _moov(7, media._full(b"stsz", pack(">II", 0, 0))), media._box(b"mvex", media._full(b"trex", pack(">IIIII", 7, 1, 10, 4, 0))))
    moov = moov.replace(media._full(b"stts", pack(">III", 1, 3, 50)), media._full(b"stts", pack(">III", 1, 0, 50)))

    def moof(run_flags, run, shift):
        tfhd = media._box(b"tfhd", pack(">I", 0x20000), pack(">I", 7))
        trun = media._box(b"trun", pack(">I", run_flags | 1), run[:4], pack(">i", shift), run[4:])
        return media._box(b"moof", media._full(b"mfhd", pack(">I", 1)), media._box(b"traf", tfhd, trun))

    own = pack(">I", 3) + pack(">IIIIII", 3, 0, 5, 0x10000, 7, 0)
    first = moof(0x600, own, 0)
    first = moof(0x600, own, len(first) + 8) + media._box(b"mdat", b"abcdefghijklmno")
    second = moof(0x4, pack(">I", 2) + pack(">I", 0x10000), 0)
    second = moof(0x4, pack(">I", 2) + pack(">I", 0x10000), len(second) + 8) + media._box(b"mdat", b"ABCDEFGH")
    data = head + moov + first + second
    (track,) = media.parse(data)[1]
    assert track.sizes.tolist() == [3, 5, 7, 4, 4] and track.keys.tolist() == [0, 2, 4]
    assert media.samples(data, track) == b"abcdefghijklmnoABCDEFGH" and track.duration == 50
    with pytest.raises(ValueError, match="track 9"):
        media.parse(data.replace(pack(">I", 0x20000) + pack(">I", 7), pack(">I", 0x20000) + pack(">I", 9)))
