"""Synthesised files through parsers, sources and sinks."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.functions import exif, formats
from fotolake.operators import tiff
from fotolake.sources import images, sinks
from fotolake.sources.png import read_png, write_png
from fotolake.streaming.images import format_counts, stream_files

CODES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "I", 7: "B", 8: "H", 9: "i", 10: "i"}


def build(dirs, order="<", base=0):
    """A TIFF of directories: lists of (tag, type, values); ("dir", k) as a value points to directory k; `following` links."""
    sizes = [2 + 12 * len(d["entries"]) + 4 for d in dirs]
    at = [8 + sum(sizes[:k]) for k in range(len(dirs))]
    heap, free = b"", 8 + sum(sizes)
    body = b""
    for d in dirs:
        body += struct.pack(order + "H", len(d["entries"]))
        for tag, typ, values in d["entries"]:
            values = [at[v[1]] if isinstance(v, tuple) else v for v in values] if not isinstance(values, bytes) else values
            raw = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{CODES.get(typ, 'B')}", *values)
            count = len(values) // (2 if typ in (5, 10) else 1)
            if len(raw) <= 4:
                field = raw.ljust(4, b"\0")
            else:
                field = struct.pack(order + "I", free + len(heap))
                heap += raw
            body += struct.pack(order + "HHI", tag, typ, count) + field
        body += struct.pack(order + "I", at[d["following"]] if d.get("following") is not None else 0)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body + heap


def jpeg(tiff_bytes=None, before=b""):
    app1 = b"" if tiff_bytes is None else b"\xff\xe1" + struct.pack(">H", len(tiff_bytes) + 8) + b"Exif\0\0" + tiff_bytes
    return b"\xff\xd8" + before + app1 + b"\xff\xd9"


def raw_file(data, width, height, compression=32767, make=b"SONY\0", order="<", extra=()):
    def made(offset):
        return build([{"entries": [(271, 2, make), (330, 4, [("dir", 1)])]}, {"entries": [(256, 4, [width]), (257, 4, [height]), (258, 3, [14]), (259, 3, [compression]), (273, 4, [offset]), (279, 4, [len(data)]), *extra]}], order)

    return made(len(made(0))) + data


@pytest.mark.parametrize("order", ["<", ">"])
def test_wire_types(order):
    data = build([{"entries": [(1, 1, [1, 2]), (2, 2, b"abc\0"), (3, 3, [7, 8]), (4, 4, [9]), (5, 5, [1, 2, 3, 4]), (6, 7, [1, 2, 3, 4, 5]), (8, 8, [65535]), (9, 9, [-5]), (10, 10, [-1, 2]), (11, 6, [1]), (12, 12, [1] * 8), (13, 2, b"long text\0\0")]}], order)
    got = tiff.exif_of_tiff(data, 0)
    strip = {k: {x: y for x, y in v.items() if x not in ("typ", "count")} for k, v in got.items()}
    assert strip == {1: {"bytes": b"\1\2"}, 2: {"ascii": "abc"}, 3: {"short": [7, 8]}, 4: {"long": [9]}, 5: {"rational": [(1, 2), (3, 4)]}, 6: {"bytes": b"\1\2\3\4\5"}, 8: {"short": [65535]}, 9: {"slong": [-5]}, 10: {"srational": [(-1, 2)]}, 13: {"ascii": "long text\0"}}


def test_short_big_endian_values_of_an_old_reader():
    data = build([{"entries": [(274, 3, [6]), (256, 4, [234])]}], ">")
    assert tiff.exif_of_tiff(data, 0)[274]["short"] == [6]
    old = tiff.exif_of_tiff(data, 0, compat=True)
    assert old[274]["short"] == [0] and old[256]["long"] == [0xEA000000]


def test_later_sections_win():
    data = build([{"entries": [(1, 3, [1]), (2, 3, [1]), (3, 3, [1]), (0x014A, 4, [("dir", 2)]), (0x8769, 4, [("dir", 1)])]}, {"entries": [(2, 3, [2]), (3, 3, [2])]}, {"entries": [(3, 3, [3])]}])
    got = tiff.exif(jpeg(data, b"\xff\xe0\x00\x04ab\xff\xe1\x00\x0ahttp://a\xff\xff"))
    assert [got[k]["short"][0] for k in (1, 2, 3)] == [1, 2, 3]


def test_pointers():
    missing = build([{"entries": [(1, 3, [1])]}])
    assert tiff.exif_of_tiff(missing, 0)[1]["short"] == [1]
    beyond = build([{"entries": [(0x8769, 4, [10_000])]}])
    with pytest.raises(tiff.BadFile):
        tiff.exif_of_tiff(beyond, 0)
    with pytest.raises(tiff.BadFile, match="no EXIF"):
        tiff.exif(jpeg())


def test_walk_over_directories():
    one = {"entries": [(256, 4, [4]), (257, 4, [4]), (273, 4, [8]), (279, 4, [16])]}
    same = {"entries": [(256, 4, [9]), (257, 4, [4]), (273, 4, [8]), (279, 4, [16])], "following": 0}
    none = {"entries": [(256, 4, [1]), (257, 4, [1]), (273, 4, [8]), (279, 4, [0])]}
    data = build([{"entries": [(330, 4, [("dir", 1), ("dir", 2), ("dir", 3)])], "following": 4}, one, same, none, {"entries": [(272, 2, b"M1\0")]}])
    got = tiff.raw_info(data.ljust(400, b"\0"))
    assert got.width == 9 and got.model == "M1" and len(got.visited) == 5 and got.visited[1] == max(got.visited)  # the link first, then sub-directories from the last
    with pytest.raises(tiff.BadFile, match="no RAW"):
        tiff.raw_info(build([none]))
    rgb = build([{"entries": [(256, 4, [4]), (257, 4, [4]), (273, 4, [8]), (277, 3, [3]), (279, 4, [16])]}])
    with pytest.raises(tiff.BadFile):
        tiff.exif(rgb)


def test_variants(spark):
    cases = [(comp, total, bits, dng, sony) for comp in (0, 1, 7, 32767) for total in (20, 35, 40, 50) for bits in (8, 14) for dng in (None, 1) for sony in (True, False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, comp int, total long, bits int, dng long, sony boolean")
    got = df.select("i", formats.raw_variant(F.col("comp"), F.lit(5), F.lit(4), F.col("bits"), F.col("total"), F.col("dng"), F.col("sony")).alias("v")).collect()
    for r in got:
        comp, total, bits, dng, sony = cases[r.i]
        assert r.v == tiff.variant(tiff.RawInfo(5, 4, bits, comp, [0], [total], sony, dng=dng)), cases[r.i]


def test_sniffing_is_total(spark):
    rows = [(k, bytes([k >> 8, k & 255])) for k in range(0, 65536, 7)] + [(70000 + i, v) for i, v in enumerate([b"", b"\xff", b"\xff\xd8", b"\x89P", b"RIFF1234WAVE", b"%PDF", b"II", b"MM", None])]
    got = {r.k: r.f for r in spark.createDataFrame(rows, "k int, c binary").select("k", formats.sniff(F.col("c")).alias("f")).collect()}
    for k, c in rows:
        try:
            want = tiff.sniff(c or b"")
        except tiff.BadFile as e:
            want = "io_error" if "end of file" in str(e) else "unsupported"
        assert got[k] == want
    assert [got[70000 + i] for i in range(9)] == ["io_error", "io_error", "jpeg", "png", "webp", "pdf", "raw", "raw", "io_error"]


@pytest.mark.parametrize("colour,depth", [(0, 1), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 2), (3, 8), (4, 8), (6, 8)])
def test_png(colour, depth):
    rng = np.random.default_rng(colour * 20 + depth)
    h, w, ch = 5, 7, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    top = 3 if colour == 3 else (1 << depth) - 1
    px = rng.integers(0, top + 1, (h, w, ch))
    line = -(-w * ch * depth // 8)
    if depth == 16:
        rows = px.astype(">u2").reshape(h, -1).view(np.uint8)
    elif depth == 8:
        rows = px.astype(np.uint8).reshape(h, -1)
    else:
        bits = (px.reshape(h, -1, 1) >> np.arange(depth - 1, -1, -1)) & 1
        rows = np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1)
    step, body, prev = max(1, ch * depth // 8), b"", np.zeros(line, int)
    for y in range(h):
        cur = rows[y].astype(int)
        left, corner = np.r_[np.zeros(step, int), cur][:line], np.r_[np.zeros(step, int), prev][:line]
        p = left + prev - corner
        d = np.stack([abs(p - left), abs(p - prev), abs(p - corner)])
        guess = [0 * cur, left, prev, (left + prev) // 2, np.choose(d.argmin(axis=0), [left, prev, corner])][y]
        body += bytes([y]) + ((cur - guess) & 255).astype(np.uint8).tobytes()
        prev = cur
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    palette = rng.integers(0, 256, (4, 3)).astype(np.uint8)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + chunk(b"PLTE", palette.tobytes()) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    v = np.rint(px * 255 / top).astype(int) if depth == 16 else px * 255 // top if depth < 8 else px
    want = palette[px[..., 0]] if colour == 3 else v[..., :3] if ch >= 3 else np.repeat(v[..., :1], 3, axis=2)
    assert (read_png(data) == want).all()
    rgb = rng.integers(0, 256, (3, 4, 3)).astype(np.uint8)
    assert (read_png(write_png(rgb)) == rgb).all()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    plane = (np.arange(16 * 4).reshape(4, 16) * 100 + 600).astype("<u2")
    samples = {
        "a.png": write_png(np.full((2, 3, 3), 9, np.uint8)), "b.arw": raw_file(plane.tobytes(), 16, 4, 1, extra=[(274, 3, [8]), (0x7310, 3, [500]), (0x7313, 3, [2000, 1000, 1000, 1500])]),
        "c.jpg": jpeg(build([{"entries": [(271, 2, b"Make\0")]}])), "d.jpg": jpeg(), "e.pdf": b"%PDF-1.4", "f.wav": b"RIFF1234WAVE", "g.txt": b"hello", "h.bin": b"x", "i.arw": raw_file(plane.tobytes()[:100], 16, 4, 32767),
    }
    for name, data in samples.items():
        (d / name).write_bytes(data)
    return d


def test_load(spark, folder, tmp_path):
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.load_images(spark, str(folder)).collect()}
    assert (rows["a.png"].width, rows["a.png"].height, rows["a.png"].error) == (3, 2, None) and bytes(rows["a.png"].data) == b"\t" * 18
    raw = rows["b.arw"]
    assert raw.error is None and (raw.width, raw.height) == (4, 16) and len(raw.data) == 192 and raw.exif[271].ascii == "SONY"
    assert {k: rows[k].error.message for k in ("d.jpg", "e.pdf", "f.wav", "g.txt", "h.bin")} == {"d.jpg": "no EXIF data", "e.pdf": "PDF support is not enabled", "f.wav": "no codec for webp", "g.txt": "unsupported image format", "h.bin": "unexpected end of file"}
    codec = {"jpeg": lambda data: np.zeros((1, 2, 3), np.uint8)}
    more = {r.path.rsplit("/", 1)[1]: r for r in images.load_images(spark, str(folder), codec, require_exif=False, glob="*.jpg").collect()}
    assert {k: r.error for k, r in more.items()} == {"c.jpg": None, "d.jpg": None}
    with pytest.raises(Exception, match="PDF support"):
        images.load_images(spark, str(folder), mode="FAILFAST", glob="*.pdf").collect()


def test_metadata_columns(spark, folder):
    df = images.load_exif(images.scan(spark, str(folder), "*.arw")).where("error is null and path like '%b.arw'")
    # The sub-directory with the tags is read, since the first one points to it.
    r = df.select(
        exif.black_level(F.col("exif")).alias("black"), exif.white_balance(F.col("exif")).alias("wb"), exif.exif_bytes(exif.exif_value(F.col("exif"), 271)).alias("make"), exif.exif_bytes(exif.exif_value(F.col("exif"), 258)).alias("bits"),
        exif.exif_bytes(exif.exif_value(F.col("exif"), 9999)).alias("none"), exif.display(F.lit("Make"), exif.exif_value(F.col("exif"), 271)).alias("line"), exif.to_json(F.col("exif")).alias("json"),
    ).first()
    assert r.black == 500 and r.wb == [2.0, 1.0, 1.5] and bytes(r.make.data) == b"SONY" and bytes(r.bits.data) == b"\x0e\0" and r.none is None
    assert r.line == "Make".ljust(30) + ": SONY" and json.loads(r.json)["271"] == {"Ascii": "SONY"} and json.loads(r.json)["274"] == {"Short": [8]}
    plan = images.scan(spark, str(folder)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_resize_and_write(spark, folder, tmp_path):
    img = images.load_images(spark, str(folder), glob="*.png")
    small = images.resize_images(img, 5, 4)
    done = sinks.write_images(small, str(tmp_path / "out")).collect()
    assert len(done) == 1
    with open(done[0].target, "rb") as f:
        assert (read_png(f.read()) == 9).all()
    with pytest.raises(ValueError, match="encoder"):
        sinks.encode_images(small, "webp")
    with pytest.raises(ValueError):
        images.resize_images(img, 0, 4)
    own = sinks.encode_images(small, "webp", lambda rgb: b"RIFF" + bytes(rgb.shape)).first()
    assert bytes(own.file) == b"RIFF\x04\x05\x03"


def test_jvm_source(spark, folder):
    r = images.jvm_images(spark, str(folder / "a.png")).first()
    assert (r.width, r.height, bytes(r.data)) == (3, 2, b"\t" * 18)


def test_jpeg_pixels_and_exif(spark, tmp_path):
    """Grey and colour JPEGs written by the JVM, with and without EXIF data, under a name with a space, and a broken one."""
    gate = spark.sparkContext._gateway
    jvm = gate.jvm

    def write(name, kind, rgb):
        im = jvm.java.awt.image.BufferedImage(8, 16, kind)
        for y in range(16):
            for x in range(8):
                im.setRGB(x, y, rgb)
        jvm.javax.imageio.ImageIO.write(im, "jpg", jvm.java.io.File(str(tmp_path / name)))
        return (tmp_path / name).read_bytes()

    app = b"Exif\0\0" + build([{"entries": [(271, 2, b"Make\0")]}])
    app = b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app
    for name, kind, rgb in (("a b+%41.jpg", 5, 0xF01414), ("grey.dat", 10, 0x808080)):
        data = write(name, kind, rgb - (1 << 24))
        (tmp_path / name).write_bytes(data[:2] + app + data[2:])
    write("plain.jpg", 5, 0x0000F0 - (1 << 24))
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8" + app + b"\xff\xd9")
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.load_images(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a b+%41.jpg", "broken.jpg", "grey.dat", "plain.jpg"]
    red, grey = rows["a b+%41.jpg"], rows["grey.dat"]
    for r in (red, grey):
        assert r.error is None and (r.format, r.width, r.height, r.n_channels) == ("jpeg", 8, 16, 3) and r.exif[271].ascii == "Make"
    px = np.frombuffer(red.data, np.uint8).reshape(16, 8, 3).astype(int)
    assert (abs(px - [0xF0, 0x14, 0x14]) < 8).all()
    px = np.frombuffer(grey.data, np.uint8).reshape(16, 8, 3)
    assert (px[..., 0] == px[..., 1]).all() and (px[..., 0] == px[..., 2]).all() and len(set(px.ravel())) == 1
    assert {k: (rows[k].error.stage, rows[k].error.message) for k in ("plain.jpg", "broken.jpg")} == {"plain.jpg": ("decode", "no EXIF data"), "broken.jpg": ("decode", "the JPEG can't be decoded")}
    assert all(rows[k].data is None and rows[k].width is None for k in ("plain.jpg", "broken.jpg"))
    loose = {r.path.rsplit("/", 1)[1]: r for r in images.load_images(spark, str(tmp_path), require_exif=False, glob="p*.jpg").collect()}
    px = np.frombuffer(loose["plain.jpg"].data, np.uint8).reshape(-1, 3).astype(int)
    assert loose["plain.jpg"].error is None and loose["plain.jpg"].exif == {} and (abs(px - [0, 0, 0xF0]) < 8).all()
    with pytest.raises(Exception, match="can't be decoded"):
        images.load_images(spark, str(tmp_path), glob="broken*", mode="FAILFAST").collect()
    assert images.rgb_of(bytes([3, 2, 1, 9, 6, 5, 4, 9]), 4) == bytes([1, 2, 3, 4, 5, 6])


def test_truncated_files_give_errors(spark, folder):
    for name in ("a.png", "b.arw", "c.jpg"):
        data = (folder / name).read_bytes()
        for n in range(len(data)):
            try:
                tiff.exif(data[:n])
            except tiff.BadFile:
                pass
    cut = spark.createDataFrame([(f"{n}", (folder / "b.arw").read_bytes()[:n]) for n in range(0, 300, 3)], "path string, content binary").withColumn("format", formats.sniff(F.col("content")))
    rows = images.decode_images(cut).collect()
    assert len(rows) == 100 and sum(r.error is None for r in rows) < 5


def test_stream(spark, folder, tmp_path):
    q = format_counts(stream_files(spark, str(folder))).writeStream.format("memory").queryName("formats").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.format: r["count"] for r in spark.table("formats").groupBy("format").agg(F.sum("count").alias("count")).collect()} == {"png": 1, "raw": 2, "jpeg": 2, "pdf": 1, "webp": 1, "unsupported": 1, "io_error": 1}


def test_catalogue(spark, tmp_path):
    listing = tmp_path / "tags.md"
    listing.write_text("x\n### IFD0 (2)\n\n0x0100 ImageWidth @82; 0x010f Make @98.\n\n### ExifIFD (1)\n0x829a ExposureTime @449.\n")
    tags = exif.catalogue(spark, str(listing))
    rows = exif.with_names(spark.createDataFrame([(271,), (1,)], "tag int"), tags).collect()
    assert {r.tag: (r.name, r.section) for r in rows} == {271: ("Make", "IFD0"), 1: (None, None)}


def test_command_line(spark, folder, tmp_path, capsys):
    from fotolake.__main__ import main

    assert main(["exif", str(folder)]) == 0
    lines = {x.split("\t")[0].rsplit("/", 1)[1]: x.split("\t")[1:] for x in capsys.readouterr().out.splitlines()}
    assert json.loads(lines["c.jpg"][1]) == {"271": {"Ascii": "Make"}} and lines["e.pdf"] == ["pdf", "{}"] and lines["d.jpg"] == ["jpeg", "error: no EXIF data"]
    assert main(["convert", str(folder / "a.png"), str(tmp_path / "o"), "4", "2"]) == 0
    target = capsys.readouterr().out.strip().split("\t")[1]
    with open(target, "rb") as f:
        assert read_png(f.read()).shape == (2, 4, 3)
    assert main([]) == 2
