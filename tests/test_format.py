"""The container format: codecs, records, pixels, scripts and the directory job, on files built here."""

import io
import os
import struct
import wave
import zlib

import make
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.functions import bytecode, pixels, records
from chunkloom.functions import bytes as B
from chunkloom.plans.project import Project
from chunkloom.sources import container, files, sinks

TAGS = st.binary(min_size=4, max_size=4).filter(lambda t: t not in (b"RIFX", b"LIST"))
BLOBS = st.binary(max_size=60)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_varints(n):
    data = B.varint(n)
    assert len(data) <= 5 and B.Reader(data).varint() == n


def test_varint_values():
    assert B.Reader(bytes((0x89, 0x16))).varint() == 1174 and B.Reader(b"\x8f\xff\xff\xff\x7f").varint() == 2**32 - 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(TAGS, BLOBS), max_size=8))
def test_frames_round_trip(chunks):
    if chunks and chunks[0][0] in [t[::s] for t in (*container.PACKED, *container.MAPPED) for s in (1, -1)]:
        with pytest.raises(ValueError):
            container.write_frames(chunks)
        return
    got = container.decode(container.write_frames(chunks)).chunks
    assert [(c.tag, c.data, c.declared) for c in got] == [(t, d, len(d)) for t, d in chunks]


def test_frames_nest_and_are_cut():
    inner = container.write_frames([(b"abcd", b"xyz")], b"LIST")
    got = container.frames(container.write_frames([(b"LIST", inner[8:]), (b"efgh", b"1")]))
    assert [(c.tag, c.path) for c in got] == [(b"RIFX", (0,)), (b"LIST", (0, 0)), (b"abcd", (0, 0, 0)), (b"efgh", (0, 1))]
    cut = container.decode(b"RIFX" + struct.pack(">I", 100) + b"abcd" + struct.pack(">I", 50) + b"few").chunks
    assert [(c.data, c.declared) for c in cut] == [(b"few", 50)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(TAGS, st.binary(min_size=1, max_size=60), st.booleans()), min_size=1, max_size=8), st.sampled_from(["XFIR", "RIFX"]))
def test_packed_round_trip(chunks, wrapper):
    rows = [(i + 3, t, d, inside) for i, (t, d, inside) in enumerate(chunks)]
    data = container.write_packed(rows[::-1], container.Header(wrapper))
    f = container.decode(data)
    assert [(c.res_id, c.tag, c.data) for c in f.chunks] == [r[:3] for r in rows] and f.header.container == wrapper
    assert container.repack(data) == data


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(TAGS, st.binary(min_size=1, max_size=40)), min_size=1, max_size=6), st.sampled_from([20, 24, 28]))
def test_map_round_trip(chunks, stride):
    f = container.decode(container.write_mapped(chunks, stride=stride))
    assert f.layout == "map" and [(c.tag, c.data, c.res_id) for c in f.chunks] == [(t, d, i + 1) for i, (t, d) in enumerate(chunks)]


def test_codecs_in_either_spelling():
    for codec, kind in ((b"FGDM", "packed"), (b"FGDC", "packed"), (b"MV93", "map"), (b"APPL", "map"), (b"abcd", "unknown")):
        assert container.classify(bytes(8) + codec) == container.classify(bytes(8) + codec[::-1]) == kind
    assert container.classify(b"XFIR") == "unknown"


@pytest.mark.parametrize("kind,data", [("truncated", b"XFIR"), ("truncated", b"ab"), ("unknown", b"GIF89a12"), ("compression", b"XFIR1234abcd"), ("truncated", b"XFIR1234CDGFrevF\x05"), ("compression", b"XFIR123439VMimap"[:16] + bytes(40))])
def test_broken_files_say_why(kind, data):
    with pytest.raises(container.Broken) as e:
        container.decode(data)
    assert e.value.kind == kind


def test_broken_stream_is_kept_with_its_error():
    data = bytearray(container.write_packed([(3, b"abcd", bytes(500), False), (4, b"efgh", b"good", True)]))
    body = data.rindex(zlib.compress(bytes(500)))
    data[body + 4] ^= 0xFF
    got = container.decode(bytes(data)).chunks
    assert [c.error is None for c in got] == [False, True]


def test_links_in_three_layouts():
    rows = [(5, 9, b"BITD"), (6, 9, b"CLUT")]
    assert records.links(make.links(rows, "<")) == ("le", rows) and records.links(make.links(rows, ">")) == ("be", rows)
    bare = b"\0" + b"".join(t + struct.pack("<II", c, p) for c, p, t in rows)
    assert records.links(bare) == ("headerless", rows)
    with pytest.raises(ValueError):
        records.links(b"\xff" * 20)


def test_members():
    m = records.member(make.member(1, b"spec", b"a name", 7))
    assert (m["kind"], m["layout"], m["spec"]) == ("bitmap", "d5", b"spec")
    assert records.member_name(m["info"]) == "a name" and records.script_id(m["info"]) == 7
    assert records.member_name(b"") is None and records.member_name(make.info()) is None
    old = records.member(struct.pack(">HI", 4, 0) + b"\x06\x00" + bytes(4))
    assert (old["kind"], old["layout"]) == ("sound", "d4")
    oldest = records.member(b"\xff" * 12 + b"TULC" + bytes(8))
    assert (oldest["kind"], oldest["layout"], oldest["child_tags"]) == ("palette", "d3", ["CLUT"])


def test_libraries():
    cells = [b"", make.pascal(b"Internal"), make.pascal(b""), b"", struct.pack(">HHi", 1, 20, 4)]
    cells += [b"", make.pascal(b"Shar\xe9d"), make.pascal(b"disk:x"), b"", struct.pack(">HHi", 9, 3, 5)]
    got = records.libraries(struct.pack(">IHHHH", 12, 0, 2, 5, 0) + make.item_table(cells))
    assert got[0] == {"id": 4, "name": "Internal", "path": "", "min_member": 1, "max_member": 20, "member_count": 20}
    assert (got[1]["name"], got[1]["path"], got[1]["member_count"]) == ("Shar?d", "disk:x", 0)
    assert records.libraries(b"") == records.libraries(b"\0" * 20) == []


def test_palettes():
    rgb = [(255, 0, 1), (2, 3, 4)]
    assert records.palette(make.colours(254, rgb))[253:] == [(0, 0, 0), *rgb]
    full = b"".join(struct.pack(">3H", i * 257, 0, 0) for i in range(256))
    assert records.palette(full)[200] == (200, 0, 0) and records.palette(full[:12])[1] == (1, 0, 0)
    with pytest.raises(ValueError):
        records.palette(bytes(11))
    system = records.builtin_palette(-1)
    assert len(system) == 256 and system[0] == (255, 255, 255) and system[215] == (238, 0, 0) and system[245] == (238, 238, 238) and system[255] == (0, 0, 0)
    assert records.palette_of_id(0) == system and records.palette_of_id(-2)[1] == (254, 254, 254) and records.palette_of_id(5) is None
    filled = records.tail_filled([(0, 0, 0)] * 256)
    assert filled[246:255] == list(system[246:255]) and filled[245] == filled[255] == (0, 0, 0)


def test_small_records():
    got = records.styled_text(make.text("né".encode()))
    assert got["text"] == "né" and got["runs"][0]["font_id"] == 3 and got["runs"][0]["r"] == 65535
    assert records.styled_text(bytes(20)) == {"text": "", "runs": []}
    assert records.styled_text(make.text(b"\x8e"), roman=True)["text"] == "é"
    assert records.shape(struct.pack(">5H2x5B", 8, 1, 2, 3, 4, 5, 6, 0, 1, 7))["outline_invisible"] and records.shape(b"") is None
    assert records.script_context(make.context([26, 0])) == [(26, 4), (0, 4)] and records.script_names(make.names([b"a", b"bc"])) == ["a", "bc"]
    assert records.bitmap_info(b"")["width"] == 0 and records.bitmap_info(make.bitmap(34, 29, 8, 34, -3, (5, 6))) == {"width": 34, "height": 29, "bpp": 8, "pitch": 34, "palette_id": -3, "has_palette": True, "reg_x": 5, "reg_y": 6}
    assert records.float80(bytes.fromhex("3fff8000000000000000")) == 1.0 and records.float80(bytes.fromhex("c000c000000000000000")) == -3.0
    table = struct.pack(">HHII", 12, 10, 2, 2) + struct.pack(">4sHI", b"abcd", 1, 2) + struct.pack(">4sHI", b"free", 0, 0)
    assert container.listing(table) == [(b"abcd", 1, 2)]
    names = struct.pack(">H", 3) + b"Foo"
    fmap = struct.pack(">ii8xi16x", 36, 0, 1) + struct.pack(">iHH", 0, 1, 77) + bytes(2) + names
    assert records.font_map(fmap) == [(77, 1, "Foo")]


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=400))
def test_runs_come_back(data):
    packed = pixels.runs(data)
    if len(packed) < len(data) and not container.looks_packed(packed):
        assert pixels.unpacked(packed, len(data)) == data


def test_pixels():
    assert pixels.placed(np.array([0, 1, 2, 3]), 2).tolist() == [0, 85, 170, 255]
    assert pixels.indices(b"\x1b\x00", 4, 1, 2, 2).tolist() == [[0, 1, 2, 3]]
    assert pixels.indices(b"\xa0\x00", 3, 1, 1, 2).tolist() == [[1, 0, 1]]
    assert pixels.rgba(b"\x80\x00", 2, 1, 1, 2, []).tolist() == [[[0, 0, 0, 255], [255, 255, 255, 255]]]
    assert pixels.rgba(b"\x7f\xff\x00\x1f", 2, 1, 16, 4, []).tolist() == [[[255, 255, 255, 255], [0, 0, 255, 255]]]
    assert pixels.rgba(bytes((9, 8, 1, 2, 3, 4, 5, 6)), 2, 1, 32, 8, [], 1000).tolist() == [[[1, 3, 5, 9], [2, 4, 6, 8]]]
    assert pixels.rgba(bytes((9, 1, 2, 3, 8, 4, 5, 6)), 2, 1, 32, 8, [], 0).tolist() == [[[1, 2, 3, 9], [4, 5, 6, 8]]]
    assert pixels.rgba(zlib.compress(b"\x01"), 2, 1, 8, 2, [(1, 1, 1), (2, 2, 2)]).tolist() == [[[2, 2, 2, 255], [1, 1, 1, 255]]]
    assert pixels.row_bytes(9, 1) == 2 and pixels.row_bytes(3, 8) == 4
    with pytest.raises(ValueError):
        pixels.indices(b"", 1, 1, 3, 1)


def test_sound_files():
    frame = b"\xff\xfb\x90\x00" + bytes(20)
    assert pixels.sound_file(b"SND ", b"head\xff\xff\xff" + frame + b"\xff" * 9, {}) == ("mp3", frame)
    riff = pixels.wav(b"\x80\x81", 8000, 8, 1)
    assert pixels.sound_file(b"snd ", riff, {}) == ("wav", riff)
    with wave.open(io.BytesIO(riff)) as w:
        assert (w.getframerate(), w.getnframes(), w.getsampwidth()) == (8000, 2, 1)
    assert pixels.sound_file(b"ediM", b"other", {}) == ("bin", b"other") and pixels.sound_file(b"snd ", b"", {}) is None


NAMES = ["go", "x", "put", "foo", "i", "sprite"]


def shown(code: bytes, literals=(), args=(), locals_=()):
    s = bytecode.script(make.script(code, list(args), list(locals_), list(literals)))
    return bytecode.text_of(s, NAMES, 1000).splitlines()


def test_instructions():
    got = bytecode.instructions(bytes((0x41, 0xFF, 0x8A, 0, 7, 0xEF, 0, 0, 1, 0, 0x01, 0x41)))
    assert [(x.at, x.op, x.arg) for x in got] == [(0, "pushInt8", -1), (2, "getProp", 7), (5, "pushInt32", 256), (10, "ret", 0)]
    listed = bytecode.listing(bytecode.script(make.script(b"\x8a\x00\x07\x01")), NAMES)
    assert listed == "on go\n      0: getProp 7\n      3: ret\nend\n\n"


def test_float_text():
    for value, text in ((0.5, "0.5"), (1.0, "1.0"), (1e10, "10000000000.0"), (1e-5, "1e-05"), (1e20, "1e+20")):
        assert bytecode.number_text(value) == text


def test_statements():
    assert shown(make.code((0x41, 7), (0x41, 2), (0x41, 3), (0x05, None), (0x04, None), (0x52, 0), (0x01, None)), locals_=[1]) == ["on go", "  x = 7 * (2 + 3)", "end"]
    assert shown(make.code((0x44, 0), (0x42, 1), (0x57, 2), (0x01, None)), [(1, b"hi\0")]) == ["on go", '  put "hi"', "end"]
    assert shown(make.code((0x44, 0), (0x43, 1), (0x57, 0), (0x4F, 1)), [(9, struct.pack(">d", 2.0))]) == ["on go", "  x = go(2.0)", "end"]
    assert shown(make.code((0x4B, 0), (0x45, 1), (0x41, 1), (0x42, 3), (0x67, 3), (0x01, None)), args=[4]) == ["on go i", "  i.foo(#x, 1)", "end"]
    assert shown(make.code((0x41, 1), (0x41, 2), (0x43, 2), (0x1E, None), (0x4F, 1))) == ["on go", "  x = [1, 2]", "end"]
    assert shown(make.code((0x45, 3), (0x41, 2), (0x43, 2), (0x1F, None), (0x4F, 1))) == ["on go", "  x = [#foo: 2]", "end"]
    assert shown(make.code((0x4B, 0), (0x61, 3), (0x42, 1), (0x57, 2)), args=[4]) == ["on go i", "  put i.foo", "end"]


def shown_old(code: bytes, literals=(), args=(), locals_=(), version=400, wide=True):
    s = bytecode.script(make.script(code, list(args), list(locals_), list(literals)))
    return bytecode.text_of(s, NAMES, version, wide).splitlines()[1:-1]


def test_numbered_properties():
    n = lambda *values: [(0x41, v) for v in values]
    keep = (0x4F, 1)  # set x to ..
    assert shown_old(make.code(*n(3, 0x0D), (0x5C, 6), keep)) == ["  set x to the locH of sprite 3"]
    assert shown_old(make.code(*n(8), (0x5C, 0), keep)) == ["  set x to the long time"]
    assert shown_old(make.code((0x49, 1), *n(0x0D), (0x5C, 0), keep)) == ["  set x to the last word in x"]
    assert shown_old(make.code((0x49, 1), *n(4), (0x5C, 1), keep)) == ["  set x to the number of lines in x"]
    assert shown_old(make.code(*n(2, 1, 2), (0x5C, 3), keep)) == ["  set x to the checkMark of menuItem 2 of menu 1"]
    assert shown_old(make.code(*n(1, 1), (0x5C, 4), keep)) == ["  set x to the volume of sound 1"]
    assert shown_old(make.code(*n(0x1B), (0x5C, 7), keep)) == ["  set x to the stageColor"]
    assert shown_old(make.code(*n(0x1C), (0x5C, 7), keep)) == ["  set x to the ERROR"]
    assert shown_old(make.code(*n(3), (0x5C, 8), keep)) == ["  set x to the number of menus"]
    assert shown_old(make.code(*n(9, 1), (0x5C, 9), keep)) == ["  set x to the name of cast 9"]
    assert shown_old(make.code(*n(9, 0, 1), (0x5C, 9), keep), version=500) == ["  set x to the name of member 9"]
    assert shown_old(make.code(*n(9, 2, 1), (0x5C, 9), keep), version=500) == ["  set x to the name of member(9, 2)"]
    assert shown_old(make.code(*n(5, 2), (0x5C, 0x0B), keep)) == ["  set x to the text of field 5"]
    assert shown_old(make.code(*n(2, 0, 0, 0, 0, 0, 1, 0, 5, 2), (0x5C, 0x0C), keep)) == ["  set x to the text of char 2 of line 1 of field 5"]
    assert shown_old(make.code(*n(1), (0x5C, 0x30))) == ["  -- ERROR: Unknown property type 48"]


def test_numbered_properties_are_set():
    n = lambda *values: [(0x41, v) for v in values]
    assert shown_old(make.code(*n(3, 7, 0x0D), (0x5D, 6))) == ["  set the locH of sprite 3 to 7"]
    assert shown_old(make.code((0x44, 0), *n(1), (0x5D, 0)), [(1, b" go\r  put 1\r\0")]) == ["  when mouseDown then go", "  put 1"]
    assert shown_old(make.code((0x44, 0), *n(1), (0x5D, 0)), [(1, b"go\0")]) == ['  set the mouseDownScript to "go"']
    assert shown_old(make.code(*n(1, 7, 2), (0x5D, 9)), version=1000)[0].startswith("  set the text of ")


def test_chunk_variables_and_places():
    n = lambda *values: [(0x41, v) for v in values]
    assert shown_old(make.code(*n(7), *n(0), (0x59, 0x15)), locals_=[1]) == ["  put 7 into x"]
    assert shown_old(make.code(*n(7), *n(8), (0x59, 0x25)), locals_=[1, 3], version=500, wide=False) == ["  put 7 after foo"]
    assert shown_old(make.code(*n(7), *n(6), (0x59, 0x14)), args=[1, 4], version=400, wide=False) == ["  put 7 into i"]
    assert shown_old(make.code(*n(7), *n(5), (0x59, 0x36))) == ["  put 7 before field 5"]
    assert shown_old(make.code(*n(0), (0x6D, 5), (0x4F, 4)), locals_=[1]) == ["  set i to x"]
    # a handler row of 42 bytes
    data = make.script(make.code((0x41, 7), (0x42, 1), (0x57, 2)), [], [], [])
    assert bytecode.text_of(bytecode.script(data), NAMES, 1000) == "on go\n  put 7\nend\n"
    (first,) = struct.unpack_from(">I", data, 74)
    narrow = bytecode.script(data[: first + 42] + data[first + 46 :] if first + 46 == len(data) else data, wide=False)
    assert narrow.handlers[0].name_id == bytecode.script(data).handlers[0].name_id


def test_if_and_else():
    # if x then put 1 else put 2
    code = make.code((0x49, 1), (0x55, 10), (0x41, 1), (0x42, 1), (0x57, 2), (0x53, 8), (0x41, 2), (0x42, 1), (0x57, 2), (0x01, None))
    assert shown(code) == ["on go", "  if x then", "    put 1", "  else", "    put 2", "  end if", "end"]


def test_repeat_while():
    # while x < 3: x = x + 1
    code = make.code((0x49, 1), (0x41, 3), (0x0C, None), (0x55, 11), (0x49, 1), (0x41, 1), (0x05, None), (0x4F, 1), (0x54, 14), (0x01, None))
    assert shown(code) == ["on go", "  repeat while x < 3", "    x = x + 1", "  end repeat", "end"]


def test_repeat_with():
    code = make.code((0x41, 1), (0x4F, 4), (0x49, 4), (0x41, 9), (0x0D, None), (0x55, 17), (0x49, 4), (0x42, 1), (0x57, 2), (0x41, 1), (0x49, 4), (0x05, None), (0x4F, 4), (0x54, 20), (0x01, None))
    assert shown(code) == ["on go", "  repeat with i = 1 to 9", "    put i", "  end repeat", "end"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("movies")
    os.makedirs(top / "deep")
    (top / "a.dcr").write_bytes(make.packed())
    (top / "deep" / "B.CCT").write_bytes(container.write_mapped([(b"STXT", make.text(b"map"))]))
    (top / "stub.cst").write_bytes(b"<!DOCTYPE html><html>")
    (top / "bad.dcr").write_bytes(b"XFIR1234????")
    (top / "note.txt").write_bytes(b"no")
    return str(top)


@pytest.fixture(scope="module")
def project(spark, folder, tmp_path_factory):
    return Project(spark, folder, str(tmp_path_factory.mktemp("work") / "chunks"))


def test_scan_and_sniff(spark, folder):
    got = {r.file: r for r in files.sniffed(files.scan(spark, folder)).collect()}
    assert set(got) == {"a.dcr", "deep/B.CCT", "stub.cst", "bad.dcr"}
    assert got["a.dcr"].codec == "packed" and got["a.dcr"].packed and got["deep/B.CCT"].codec == "map" and got["stub.cst"].stub


def test_chunks_and_outcome(project):
    rows = project.chunks.where("file = 'a.dcr'").orderBy("ordinal").collect()
    assert [(r.res_id, r.tag, bytes(r.data)) for r in rows] == [(i, t.decode(), d) for i, t, d, _ in sorted(make.movie())]
    errors = {r.file: r.error for r in project.chunks.where("tag is null").collect()}
    assert errors["stub.cst"].startswith("skip") and errors["bad.dcr"].startswith("compression")
    assert tuple(project.outcome().first()) == (1, 1, 2, 4)


def test_tables(project):
    assert project.links.count() == 5 and project.members.count() == 7
    assert {(r.number, r.res_id) for r in project.numbers.collect()} == {(1, 11), (2, 12), (4, 13), (5, 14), (6, 15), (7, 16), (8, 17)}
    coloured = {r.res_id: r for r in project.coloured().collect()}
    assert coloured[11].step == 1 and coloured[11].colors[6].r == 6 and coloured[17].step == 0 and coloured[17].colors[0].r == 255
    assert {r.res_id: r.kinds for r in project.report().collect()}[11] == 16
    assert project.casts().where("file = 'a.dcr'").first().member_count == 7


def test_palettes_by_fallback(spark):
    """Probes in order, and the closest table where none hits."""
    from chunkloom.operators import resolve

    grey = [{"r": i, "g": i, "b": i} for i in range(256)]
    palettes = spark.createDataFrame([("f", 1, 40, grey, None), ("f", 2, 6, [{"r": 0, "g": 0, "b": 0}] * 256, None)], "file string, ordinal int, res_id long, colors array<struct<r:int,g:int,b:int>>, error string")
    members = spark.createDataFrame([("f", 1, 30, "palette")], "file string, ordinal int, res_id long, kind string")
    parts = spark.createDataFrame([("f", 30, "palette", 40)], "file string, parent long, part string, child long")
    numbers = spark.createDataFrame([("f", 9, 30)], "file string, number long, res_id long")
    maps = spark.createDataFrame([("f", i, p) for i, p in enumerate((9, 31, 7, 6, 1, 99, 0, -2, -1))], "file string, res_id long, palette_id int")
    got = {r.palette_id: r for r in resolve.colours(maps, numbers, parts, palettes, members).collect()}
    assert {p: r.step for p, r in got.items()} == {9: 1, 31: 2, 7: 3, 6: 3, 1: 4, 99: None, 0: 0, -2: 0, -1: 0}
    assert got[9].colors[7].r == 7 and got[-1].colors is None and got[7].colors[246].r == records.builtin_palette(-1)[246][0]
    hist = spark.createDataFrame([("f", 99, 5, 10), ("f", 99, 0, 3), ("f", 98, 0, 9), ("f", 98, 5, 1)], "file string, palette_id int, idx int, n long")
    near = resolve.closest(hist, palettes).collect()
    assert [(r.palette_id, r.colors[5].r) for r in near] == [(99, 5)]


def test_outputs(project, tmp_path):
    rows = project.outputs().collect()
    out = {r.rel_path: bytes(r.content) for r in rows if r.content is not None}
    assert [r.error for r in rows if r.content is None] == []
    assert out["a.dcr/texts/0004_text_words.txt"] == b"one\ntwo\nthree" and out["a.dcr/bitmaps/0001_bitmap_pic_one.regpoint"] == b"regX=3\nregY=1\n"
    image = out["a.dcr/bitmaps/0001_bitmap_pic_one.png"]
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (4, 2) and image[25] == 3
    assert out["a.dcr/palettes/0002_palette_reds.pal"].startswith(b"JASC-PAL\n0100\n256\n0 0 0\n1 0 0\n")
    with wave.open(io.BytesIO(out["a.dcr/sounds/0005_sound_beep.wav"])) as w:
        assert w.getframerate() == 11025 and w.readframes(9) == b"\x80\x90\x70\x80"
    assert b"shapeType: oval\nregX: 2\nregY: 1\nwidth: 40\nheight: 30\ncolor: 0x5\nbackColor: 0\n" in out["a.dcr/shapes/0006_shape_dot.txt"]
    assert out["a.dcr/scripts/0007_script_main.ls"] == b"-- Cast member: main\n-- Type: Movie Script\n\non go\n  put 7\nend\n" and b"pushInt8 7" in out["a.dcr/scripts/0007_script_main.lasm"]
    movie = dict(x.split("\t") for x in out["a.dcr/movie.txt"].decode().splitlines())
    assert movie["stage_width"] == "640" and movie["stage_color_rgb"] == "0x112233" and movie["default_palette"] == "-1:-1" and movie["tempo"] == "15"
    assert out["a.dcr/casts.txt"] == b"1\tInternal\t\t1\t8\t7\n" and "a.dcr/linked_casts.txt" not in out
    assert [(r.script_res, r.kind) for r in project.script_kinds().collect()] == [(26, "Movie Script")]
    seen = project.inspect()
    assert seen["tags"].where("tag = 'CASt'").first().n == 7 and {r.node for r in seen["tree"].collect()} >= {"CASt", "KEY*"}
    sinks.write_blobs(project.texts(), str(tmp_path / "out"))
    assert (tmp_path / "out/a.dcr/texts/0004_text_words.txt").read_bytes() == b"one\ntwo\nthree"


def test_outputs_of_one_path_are_refused(spark, tmp_path):
    """Files of one stem have folders of their own; what would overwrite another is an error."""
    df = spark.createDataFrame([("a.dcr", 0, bytearray(make.config())), ("a.cct", 0, bytearray(make.config()))], "file string, ordinal int, data binary")
    sinks.write_blobs(sinks.config_text(df), str(tmp_path / "out"))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("movie.txt")) == ["out/a.cct/movie.txt", "out/a.dcr/movie.txt"]
    with pytest.raises(ValueError, match="a.dcr/movie.txt"):
        sinks.write_blobs(sinks.config_text(df.where("file = 'a.dcr'")).unionByName(sinks.config_text(df)), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_short_config_leaves_fields_out(spark):
    df = spark.createDataFrame([("d/x.dir", 0, bytearray(make.config()[:14]))], "file string, ordinal int, data binary")
    row = sinks.config_text(df).first()
    assert row.rel_path == "d/x.dir/movie.txt" and b"tempo" not in row.content and b"min_member\t1\n" in row.content


def test_containers_are_written_again(project, spark):
    made = sinks.containers(project.chunks.where("file = 'a.dcr'")).first()
    assert [(c.res_id, c.tag, c.data) for c in container.decode(bytes(made.content)).chunks] == [r[:3] for r in sorted(make.movie())]
    plain = sinks.containers(project.chunks.where("file = 'a.dcr'"), packed=False).first()
    assert [(c.tag, c.data) for c in container.decode(bytes(plain.content)).chunks] == [r[1:3] for r in sorted(make.movie())]


def test_bad_chunks_give_error_rows(spark, project):
    bad = project.chunks.where("tag = 'KEY*'").withColumn("data", F.substring("data", 1, 5))
    assert [r.error[:9] for r in files.links(bad).collect()] == ["Truncated"]


def test_native_numbers(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfe\x01\x02\x03"),)], "d binary")
    d = F.col("d")
    row = df.select(B.unsigned(d, 0, 2), B.signed(d, 0, 2), B.unsigned(d, 0, 2, big=False), B.unsigned(d, 4, 2), B.numbers(d, 2), B.tag(d, 1)).first()
    assert tuple(row)[:4] == (65534, -2, 65279, None) and row[4] == [65534, 258] and row[5] == "\xfe\x01\x02\x03"


def test_files_as_they_arrive(spark, folder, tmp_path):
    stream = files.chunks(files.stream(spark, folder))
    assert stream.isStreaming
    q = stream.select("file", "ordinal", "tag").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrived").where("file = 'a.dcr'").count() == len(make.movie())


def old_bitmap(width: int, height: int, rows: list[tuple[int, int, bytes]], pixels_: bytes) -> bytes:
    head = struct.pack(">H4h", 0, 0, 0, height, width).ljust(26, b"\0")
    return head + b"".join(struct.pack("<II", tag, child) + name for tag, child, name in rows) + pixels_


def test_old_members_hold_their_pixels():
    """Rows go on by tag and child alone, and end before the third in a row that is not plausible."""
    own = bytes(range(200, 256)) + b"\xff" * 40
    data = old_bitmap(8, 12, [(1024, 7, b"DTIB"), (1025, 8, b"????"), (9, 9, b"none"), (1026, 4999, b"abcd")], own)
    assert records.entries_end(data) == 26 + 4 * 12
    info, body = records.inline_bitmap(data)
    assert (info["width"], info["height"], info["bpp"], body) == (8, 12, 8, own)
    assert records.member(data)["kind"] == "bitmap" and records.member(data)["old"]
    assert records.entries_end(old_bitmap(8, 12, [(999, 7, b"DTIB"), (1024, 5000, b"TULC")], own)) is None
    assert records.inline_bitmap(old_bitmap(8, 12, [(1024, 7, b"DTIB")], own[:50]))[1][:2] == bytes(2)  # too few: the whole record
    assert records.inline_bitmap(old_bitmap(0, 0, [(1024, 7, b"DTIB")], own)) is None and records.inline_bitmap(b"x" * 19) is None


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=120))
def test_any_bytes_are_a_member_or_too_short(data):
    if len(data) < 6:
        with pytest.raises(ValueError):
            records.member(data)
        return
    records.member(data)
    end = records.entries_end(data)
    assert end is None or end <= len(data)
    records.inline_bitmap(data)


def test_trees_are_written_again():
    inner = container.write_frames([(b"abcd", b"xyz"), (b"LIST", container.write_frames([(b"deep", b"1")], b"LIST")[8:])], b"LIST")
    data = container.write_frames([(b"STXT", b"odd"), (b"LIST", inner[8:]), (b"efgh", b"12")])
    f = container.decode(data)
    assert container.write_tree(f.chunks) == data and container.rewritten(data) == data and container.plain(data) == data
    f.chunks[2].data = b"longer"
    assert [c.data for c in container.decode(container.write_tree(f.chunks)).chunks if c.tag in (b"abcd", b"deep")] == [b"longer", b"1"]
    packed = make.packed()
    assert [(c.tag, c.data) for c in container.decode(container.plain(packed)).chunks] == [(c.tag, c.data) for c in container.decode(packed).chunks]
    assert [c.data for c in container.decode(container.rewritten(packed)).chunks] == [c.data for c in container.decode(packed).chunks]
    with pytest.raises(container.Broken):
        container.rewritten(container.write_mapped([(b"STXT", b"x")]))


@pytest.fixture(scope="module")
def plain_project(spark, tmp_path_factory):
    """A file of plain frames: an old bitmap, a shape that is too short, and a film loop; members have no ids."""
    top = tmp_path_factory.mktemp("plain")
    own = bytes(range(96))
    chunks = [(b"CASt", old_bitmap(8, 12, [(1024, 7, b"DTIB")], own)), (b"CASt", make.member(8, b"few", b"bit")), (b"CASt", make.member(2, b"xx", b"loop"))]
    (top / "old.cst").write_bytes(container.write_frames(chunks))
    return Project(spark, str(top), str(tmp_path_factory.mktemp("work") / "chunks"))


def test_plain_members_are_written(plain_project):
    rows = plain_project.outputs(listed=False).collect()
    assert [r.error for r in rows if r.content is None] == []
    out = {r.rel_path: bytes(r.content) for r in rows}
    assert set(out) == {"old.cst/bitmaps/0001_bitmap_member_0." + e for e in ("png", "pal", "regpoint")} | {"old.cst/shapes/0002_shape_bit.bin"}
    assert out["old.cst/shapes/0002_shape_bit.bin"] == make.member(8, b"few", b"bit")
    image = out["old.cst/bitmaps/0001_bitmap_member_0.png"]
    assert struct.unpack(">II", image[16:24]) == (8, 12)
    assert plain_project.without_palette().first().n == 1
    assert [r.hex for r in plain_project.records_of("loop", "none").collect()] == ["7878"]


def test_fonts_of_other_members(spark, tmp_path):
    font = b"PFR1" + bytes(60)
    rows = [(11, b"CASt", make.member(12, b"", b"xtra"), True), (12, b"CASt", make.member(12, b"", b"again"), True), (13, b"CASt", make.member(14, b"", b"own"), True)]
    rows += [(20, b"XMED", font, False), (21, b"XMED", b"none", False), (30, b"KEY*", make.links([(20, 11, b"XMED"), (20, 12, b"XMED"), (21, 13, b"XMED")]), True)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.cst").write_bytes(container.write_packed(rows))
    project = Project(spark, str(tmp_path / "in"), str(tmp_path / "work"))
    assert [(r.rel_path, bytes(r.content)) for r in project.movie_fonts().collect()] == [("f.cst/fonts/0001_font_20.pfr", font)]
    assert [r.rel_path for r in project.fonts().collect()] == ["f.cst/fonts/0003_font_own.bin"]


def test_instructions_by_context(spark):
    """Files without a script context have handler rows of 42 bytes."""
    from chunkloom.operators import scripts

    two = make.script(make.code((0x41, 7), (0x01, None)))
    df = spark.createDataFrame([("wide", 0, 5, "Lscr", bytearray(two)), ("narrow", 0, 5, "Lscr", bytearray(two))], "file string, ordinal int, res_id long, tag string, data binary")
    contexts = spark.createDataFrame([("wide",), ("wide",)], "file string")
    got = scripts.instructions(df, contexts).groupBy("file").count().collect()
    assert {r.file: r["count"] for r in got} == {"wide": 2, "narrow": 2}
    assert scripts.instructions(df).count() == 4


def test_folder_names(spark):
    from chunkloom.functions import text

    names = [" a/b.dcr", "é" * 40, "x" * 70, "___", "a\x01b"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(text.file_name(F.col("s"))).collect()]
    assert got == ["a_b", "é" * 32, "x" * 64, "cast", "ab"] and len(got[1].encode()) == 64
    assert spark.sql("select concat('x', repeat('é', 40)) as s").select(text.file_name(F.col("s"))).first()[0] == "x" + "é" * 31


def test_command_line(spark, folder, tmp_path, capsys):
    from chunkloom.__main__ import main

    assert main([str(tmp_path / "none"), str(tmp_path / "out")]) == 1
    assert main([folder, str(tmp_path / "all")]) == 0
    assert "ok=2 skip=1 fail=1 files=4" in capsys.readouterr().out
    assert (tmp_path / "all/a.dcr/movie.txt").exists() and not list((tmp_path / "all").rglob("*.lasm"))
    one = f"{folder}/a.dcr"
    assert main([one, str(tmp_path / "tree"), "-t"]) == 0 and "KEY*" in capsys.readouterr().out and not (tmp_path / "tree").exists()
    assert main([one, str(tmp_path / "one"), "-o", str(tmp_path / "plain"), "--palettes", "--lasm", "-m"]) == 0
    assert "palettes" in capsys.readouterr().out and list((tmp_path / "one").rglob("*.lasm"))
    assert container.decode((tmp_path / "plain/a.dcr").read_bytes()).layout == "frames"
    assert main([one, str(tmp_path / "no"), "-c", str(tmp_path / "again")]) == 0 and not (tmp_path / "no").exists()
    assert len(container.decode((tmp_path / "again/a.dcr").read_bytes()).chunks) == len(make.movie())
    assert main([f"{folder}/deep/B.CCT", str(tmp_path / "no"), "-c", str(tmp_path / "again")]) == 1
