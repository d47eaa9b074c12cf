import io
import json
import struct
import tarfile
import zlib

import numpy as np
import pytest

from plyframe.sources import blocks, files, sinks


def test_plane_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 64)
    monkeypatch.setattr(sinks, "CHUNK", 64)
    n = 300
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 4, n)
    codes[64:200] = 0
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes) if c], "rank long, code short")
    for bits in (2, 8):
        uri = f"{tmp_path}/plane{bits}"
        sinks.write_plane(df, uri, n, bits, b"HEAD")
        got = files.read_plane(spark, uri, n, bits, 4).orderBy("rank").collect()
        assert [r.code for r in got] == codes.tolist()
    with pytest.raises(ValueError, match="shorter"):
        files.read_plane(spark, uri, 10 * n, 8, 4)


def test_proof_records_round_trip(spark, tmp_path):
    rows = [(5, 1, 3, 2), (-1, 2, 63, 0), (1, 1, 255, 9)]
    df = spark.createDataFrame(rows, "key long, res short, best short, depth short")
    sinks.write_proof_records(df, f"{tmp_path}/p", 5, 5, 1)
    got = [(r.key, r.res, r.best, r.depth) for r in files.read_proof_records(spark, f"{tmp_path}/p").orderBy("rank").collect()]
    assert got == [(1, 1, 255, 9), (5, 1, 3, 2), (-1, 2, 63, 0)]  # unsigned order


def test_keys_are_found_in_a_file_in_parts(spark, tmp_path, monkeypatch):
    """Several parts and blocks, keys above 2^63, missing and repeated ones, and what a file
    looks like that was put together."""
    keys = [int(x) for x in np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 500)]
    rows = [(k, i % 3, i % 256, i % 7) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "key long, res short, best short, depth short").repartition(3)
    uri = f"{tmp_path}/p"
    write = sinks.write_in_order
    monkeypatch.setattr(sinks, "write_in_order", lambda *a: write(*a, block=8, parts=4))
    sinks.write_proof_records(df, uri, 5, 5, 1)
    told = files.parts_of(uri)
    assert len(told["parts"]) > 3 and told["block"] == 8
    raw = b"".join((tmp_path / "p" / name).read_bytes() for name, _ in told["parts"])
    assert len(raw) == files.file_size(uri) == 28 + 16 * 500 and files.read_bytes(uri, 20, 2000) == raw[20:2020]
    words = np.frombuffer(raw[28:], dtype=files.PROOF)["key"]
    assert (np.diff(words.astype(object)) > 0).all()
    asked = [*keys[::3], *keys[:9], 5, -5, None, 0, -1]
    got = files.lookup_records(spark.createDataFrame([(k,) for k in asked], "key long"), uri, files.PROOF, ["key"])
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] in set(asked))
    sinks.write_proof_records(df.limit(0), f"{tmp_path}/none", 5, 5, 1)
    assert files.read_proof_records(spark, f"{tmp_path}/none").count() == 0
    assert files.lookup_records(spark.range(3).withColumnRenamed("id", "key"), f"{tmp_path}/none", files.PROOF, ["key"]).count() == 0


def test_layer_database_round_trip(spark, tmp_path):
    rows = [(0, 0, 0, 1), (1, 2, 7, -1), (1, 2, 3, 0), (2, 9, 9, 1)]
    df = spark.createDataFrame(rows, "ply int, w0 long, w1 long, value short")
    uri = f"{tmp_path}/db"
    sinks.write_layer_database(df, uri, 3, 3, [0, 0])
    got = [(r.ply, r.w0, r.w1, r.value) for r in files.read_layer_database(spark, uri).orderBy("rank").collect()]
    assert got == sorted(rows)
    last = sorted(tmp_path.glob("db/part-*"))[-1]
    with open(last, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="length"):
        files.read_layer_database(spark, uri)


def test_other_readers(spark, tmp_path):
    (tmp_path / "t.wdl").write_bytes(struct.pack("<IiiiQ", 0x53484257, 3, 3, 2, 3) + bytes([1, 2, 3]) + struct.pack("<3H", 0, 5, 6))
    assert [(r.code, r.depth) for r in files.read_solver_table(spark, f"{tmp_path}/t.wdl").orderBy("rank").collect()] == [(1, 0), (2, 5), (3, 6)]
    (tmp_path / "d").write_bytes(struct.pack("<QQB", 7, 1, 2) + struct.pack("<QQB", 8, 0, 1))
    assert [(r.lo, r.hi, r.status) for r in files.read_position_dump(spark, f"{tmp_path}/d").orderBy("rank").collect()] == [(7, 1, 2), (8, 0, 1)]
    (tmp_path / "v").write_bytes(struct.pack("<4Q", 0xCCB0F0CE, 7, 1, 2) + bytes([1, 2]))
    assert files.read_value_dump(spark, f"{tmp_path}/v", 7, 1).count() == 2
    np.save(tmp_path / "a.npy", np.arange(8, dtype="<u8").reshape(2, 4))
    assert [(r.c0, r.c3) for r in files.read_npy(spark, f"{tmp_path}/a.npy").orderBy("rank").collect()] == [(0, 3), (4, 7)]


def test_bounds_records(spark, tmp_path):
    digit = files.DIGITS
    # first four cells: mover, other, empty, mover -> 1 + 2*3 + 27 = 34
    key = digit[34] + digit[0] * 8
    (tmp_path / "b.txt").write_text(key + digit[1] + digit[36 - 2] + digit[36 + 4] + "\n")
    r = files.read_bounds(spark, f"{tmp_path}/b.txt").first()
    assert (r.mover, r.other, r.kind, r.lower, r.upper) == (0b1001, 0b0010, 1, -2, 4)


def test_blocks(spark, tmp_path):
    data = bytes(range(64))
    packed = zlib.compress(data)
    section = struct.pack("<QIIII", 0, len(packed), 64, zlib.crc32(data), 0) + packed
    head = struct.pack("<8sIIQQ32x", b"PGSLICE1", 1, 4, 2, 1)
    table = struct.pack("<Q4iQQII", 1, 8, 1, 1, 1, 64 + 96, len(section), 1, 0) + struct.pack("<Q4iQQII", 2, 8, 1, 1, 1, 0, 0, 0, 0)
    (tmp_path / "s").write_bytes(head + table + section)
    assert [bytes(r.data) for r in files.read_blocks(spark, f"{tmp_path}/s").collect()] == [data]
    (tmp_path / "s").write_bytes(head + table + section[:16] + b"\0\0\0\0" + section[20:])
    with pytest.raises(Exception, match="damaged"):
        files.read_blocks(spark, f"{tmp_path}/s").collect()


def test_logs_and_books(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("empties\tside\tbook_wl\tbook_ssM\tresult\tnodes\tseconds\tboard\n13\tb\t0.9\t14.6\tWIN\t298\t0.0\t.XO\n13\tw\n")
    assert [r.nodes for r in files.read_calibration(spark, f"{tmp_path}/c.tsv").collect()] == [298]
    step = {"origin": {"x": 1, "y": 2}, "heading": {"x": 0, "y": 1}}
    log = {"game_states": [{"board": "a", "turn": "BLACK"}, {"board": "b", "turn": "WHITE"}], "turns": [{"passive": step, "aggressive": step}], "winner": "BLACK"}
    (tmp_path / "g.json").write_text(json.dumps(log))
    got = files.read_game_logs(spark, f"{tmp_path}/g.json").collect()
    assert [(r.n, r.board, r.turn, r.passive.origin.y, r.winner) for r in got] == [(0, "a", "BLACK", 2, "BLACK")]
    page = "const board = [0,1,2,];\nconst nextPla = 1;\nconst moves = [{'v':3,'wl':0.5,'ssM':1.5,},{'v':9,'wl':0.75,'ssM':-2,},]"
    with tarfile.open(tmp_path / "book.tar.gz", "w:gz") as t:
        for name, text in (("a.html", page), ("b.html", "nothing"), ("c.txt", page)):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    assert [tuple(r) for r in files.read_book_archive(spark, f"{tmp_path}/book.tar.gz").collect()] == [(".XO", "b", 0.75, -2.0, 9, 2)]


def test_layers_text_reach_manifest(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 1), (1, 2, -1), (1, 3, 0)], "layer int, id long, value int")
    sinks.write_layers(df, f"{tmp_path}/layers")
    sinks.write_layers(spark.createDataFrame([(1, 2, 1)], df.schema), f"{tmp_path}/layers")  # layer 0 stays
    assert {(r.layer, r.id, r.value) for r in spark.read.parquet(f"{tmp_path}/layers").collect()} == {(0, 1, 1), (1, 2, 1)}
    sinks.write_verdict_text(spark.createDataFrame([(10, 1, 0, 1)], "a long, b long, x long, value int"), f"{tmp_path}/text")
    assert [r.value for r in spark.read.text(f"{tmp_path}/text").collect()] == ["a 1 0 W"]
    reached = spark.createDataFrame([(1,), (3,)], "id long")
    assert {r.id: r.value for r in sinks.mask_unreached(df, reached).collect()} == {1: 1, 2: None, 3: 0}
    sinks.write_summary(df.groupBy("layer").count(), f"{tmp_path}/s.json")
    assert len(json.loads((tmp_path / "s.json").read_text())) == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.bin").write_bytes(b"abc")
    assert sinks.manifest(spark, f"{tmp_path}/m").first().line.startswith("ba7816bf") and sinks.manifest(spark, f"{tmp_path}/m").first().line.endswith("  x.bin")


def test_sections_go_on_where_they_stopped(spark, tmp_path):
    rows = [(s, b, bytes([s, b] * 50)) for s in (1, 2, 7) for b in (0, 3)]
    df = spark.createDataFrame(rows, "section long, block long, data binary")
    uri = f"{tmp_path}/s"
    assert sinks.sections_done(spark, uri) == set()
    assert {r.section for r in sinks.write_sections(df.where("section < 5"), uri).collect()} == {1, 2}
    assert [tuple(r)[:2] for r in sinks.write_sections(df, uri).collect()] == [(7, 2)]
    assert sorted((r.section, r.block, bytes(r.data)) for r in files.read_sections(spark, uri).collect()) == rows
    (tmp_path / "s" / "section-00000002.z").write_bytes(b"\1" + (tmp_path / "s" / "section-00000002.z").read_bytes()[1:-1] + b"x")
    with pytest.raises(Exception):
        files.read_sections(spark, uri).collect()


def test_stored_tables_can_be_cleared(spark):
    from plyframe import persist

    persist.clear(spark)
    df = persist.stored(spark.range(5))
    assert df.count() == 5 and persist.clear(spark) == 1 and persist.clear(spark) == 0


def test_the_source_skips_sections_and_blocks(spark, tmp_path, monkeypatch):
    rows = [(s, b, bytes([s, b]) * 50) for s in range(4) for b in range(0, 40, 2)]
    uri = f"{tmp_path}/s"
    sinks.write_sections(spark.createDataFrame(rows, "section long, block long, data binary").repartition("section").sortWithinPartitions("section", "block"), uri).collect()
    take = lambda condition: sorted((r.section, r.block, bytes(r.data)) for r in blocks.read_blocks_where(spark, uri, condition, 6).collect())
    assert take(None) == rows
    assert take("section in (1, 3) and block between 8 and 20 and block % 4 = 0") == [r for r in rows if r[0] in (1, 3) and 8 <= r[1] <= 20 and r[1] % 4 == 0]
    assert take("section = 2 and block = 7 or section = 1 and block < 2") == [(1, 0, bytes([1, 0]) * 50)]
    assert take("section > 9") == []
    plan = blocks.read_blocks_where(spark, uri, "section = 1 and block >= 30")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # the source has taken the condition over

    # what a reader opens: the block tables, and the blocks that are asked for
    reader = blocks.SectionReader(uri, 1024)
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    other = StringContains(("data",), "x")
    assert list(reader.pushFilters([EqualTo(("section",), 1), GreaterThan(("block",), 33), other])) == [other]
    opened, plain = [], files._read_plain
    monkeypatch.setattr(blocks, "_read_plain", lambda u, at, n: opened.append((u[-4:], at)) or plain(u, at, n))
    parts = reader.partitions()
    assert [p.section for p in parts] == [1] and {u for u, _ in opened} == {"01.z"}
    opened.clear()
    assert [b for _, b, _ in reader.read(parts[0])] == [34, 36, 38] and len(opened) == 4


def test_a_damaged_block_is_an_error(spark, tmp_path):
    uri = f"{tmp_path}/s"
    sinks.write_sections(spark.createDataFrame([(0, 0, b"a" * 90), (0, 1, b"b" * 90)], "section long, block long, data binary").coalesce(1), uri).collect()
    path = tmp_path / "s" / "section-00000000.z"
    raw = bytearray(path.read_bytes())
    raw[-3] ^= 255
    path.write_bytes(raw)
    assert blocks.read_blocks_where(spark, uri, "block = 0").count() == 1
    with pytest.raises(Exception, match="block 1 of section 0 is damaged"):
        blocks.read_blocks_where(spark, uri).collect()
