import json
import os
import struct

import pytest

from thalweg.sources import sinks, tables

def write(path, text):
    path.write_text(text)
    return str(path)


def test_points(spark, tmp_path):
    ok = write(tmp_path / "p.tsv", "sample\tlat\tlong\textra\na\t1.5\t2\tx\nb\t3\t4\ty\n")
    assert [tuple(r) for r in tables.read_points(spark, ok).collect()] == [("a", 1.5, 2.0), ("b", 3.0, 4.0)]
    for header in ("sample\tlat", "lat\tlong", "sample\tlong", "a\t1\t2"):
        with pytest.raises(ValueError, match="Missing required columns"):
            tables.read_points(spark, write(tmp_path / "bad.tsv", header + "\n"))


def test_matrix(spark, tmp_path):
    m = tables.read_matrix(spark, write(tmp_path / "m.tsv", "\ta\tb\na\t0\t2.5\nb\t2.5\t0\n"))
    assert {tuple(r) for r in m.collect()} == {("a", "a", 0.0), ("a", "b", 2.5), ("b", "a", 2.5), ("b", "b", 0.0)}
    labels = spark.createDataFrame([("b", 0), ("a", 1)], "label string, pt_idx long")
    assert {tuple(r) for r in tables.reindex_matrix(m, labels).collect()} == {(0, 0, 0.0), (0, 1, 2.5), (1, 0, 2.5), (1, 1, 0.0)}
    with pytest.raises(ValueError):
        tables.reindex_matrix(m, labels.unionByName(spark.createDataFrame([("c", 2)], "label string, pt_idx long")))


def test_small_scans(spark, tmp_path):
    assert tables.read_variables("a, b,c") == ["a", "b", "c"]
    spec = write(tmp_path / "v.txt", "x\tMAX\ny\tMEDIAN\n")
    assert tables.read_variables(spec) == ["x", "y"]
    assert tables.read_methods(spark, ["x", "y", "z"], spec, "SUM") == {"x": "MAX", "y": "MEDIAN", "z": "SUM"}
    with pytest.raises(ValueError):
        tables.read_methods(spark, ["x"], None, "NONE")
    fixed = write(tmp_path / "f.tsv", "variable\tshape\ttransform\tfitness\nx\t5\t1\t-3\nx\t2\t4\t-1\nx\t2\t3\t-1\n")
    assert tables.read_fixed(spark, fixed) == {"x": {"shape": 2.0, "transform": 3}}
    assert tables.read_fixed(spark, {"x": {"shape": 1}}) == {"x": {"shape": 1}}
    log = write(tmp_path / "log", "noise\nWorker 3: Best Loss = -12.5\nWorker 4: Best = 7\n")
    assert sorted(map(tuple, tables.read_losses(spark, log).collect())) == [(3, -12.5), (4, 7.0)]
    with pytest.raises(ValueError):
        tables.read_network(spark, "x.pkl")
    sim = tables.read_simulation(spark, write(tmp_path / "s.tsv", "VAR\tWEIGHT\tTRANSFORM\tSHAPE\nx\t1.0\t0\t0\n"))
    assert tuple(sim.first()) == ("x", 1.0, 0, 0.0)
    sizes = tables.read_sizes(spark, write(tmp_path / "z.tsv", "sample\tsize\na\t100\n"))
    assert tuple(sizes.first()) == ("a", 100.0)


def test_many_files(spark, tmp_path):
    for k in (1, 2):
        write(tmp_path / f"r_{k}.tab", "label\tx\na\t1\nb\t2\n")
    assert tables.read_many(spark, str(tmp_path), ".tab").count() == 2
    assert tables.read_many(spark, str(tmp_path / "r_"), ".tab", head=1).count() == 1
    assert {r[0] for r in tables.read_many(spark, str(tmp_path), ".tab", "label").select("label").collect()} == {"a_1", "b_1", "a_2", "b_2"}


def shapefile(path, lines, values):
    """A minimal polyline file and its table."""
    body = b""
    for n, pts in enumerate(lines):
        xs, ys = zip(*pts)
        content = struct.pack("<i4d3i", 3, min(xs), min(ys), max(xs), max(ys), 1, len(pts), 0) + b"".join(struct.pack("<dd", *p) for p in pts)
        body += struct.pack(">ii", n + 1, len(content) // 2) + content
    head = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 3, *[0.0] * 8)
    (path / "n.shp").write_bytes(head + body)
    field = b"edge_id".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([8, 0]) + b"\0" * 14
    field += b"length_km".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([10, 3]) + b"\0" * 14
    rows = b"".join(b" " + f"{a:8d}{b:10.3f}".encode() for a, b in values)
    header = 32 + 64 + 1
    (path / "n.dbf").write_bytes(struct.pack("<B3sIHH20x", 3, b"\0\0\0", len(values), header, 19) + field + b"\r" + rows)
    return str(path / "n.shp")


def test_shapefile_network(spark, tmp_path):
    path = shapefile(tmp_path, [[(0, 0), (1, 1), (2, 0)], [(2, 0), (3, 3)]], [(7, 1.5), (8, 2.25)])
    nodes, edges = tables.read_network(spark, path)
    assert nodes.count() == 3
    assert sorted(tuple(r) for r in edges.select("edge_id", "length_km", "src", "dst").collect()) == [(7, 1.5, 0, 1), (8, 2.25, 1, 2)]


def test_geopackage_network(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "n.gpkg")
    line = lambda *pts: b"\x01" + struct.pack("<II", 2, len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts)
    several = lambda *lines: b"\x01" + struct.pack("<II", 5, len(lines)) + b"".join(lines)
    blob = lambda wkb, code=0: b"GP\0" + bytes([1 | code << 1]) + struct.pack("<i", 4326) + b"\0" * (32 if code else 0) + wkb
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('rivers', 'geom')")
        db.execute("CREATE TABLE rivers (edge_id INTEGER, geom BLOB, length_km REAL, name TEXT)")
        shapes = [blob(line((0, 0), (1, 1), (2, 0))), blob(several(line((2, 0), (2, 1)), line((2, 1), (3, 3))), 1), None]
        db.executemany("INSERT INTO rivers VALUES (?, ?, ?, ?)", [(7 + k, b, 1.5 + k, f"r{k}") for k, b in enumerate(shapes)])
    nodes, edges = tables.read_network(spark, path)
    assert nodes.count() == 3
    assert sorted(tuple(r) for r in edges.select("edge_id", "length_km", "name", "src", "dst").collect()) == [(7, 1.5, "r0", 0, 1), (8, 2.5, "r1", 1, 2)]


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (0, 0, 0.0), (1, 1, 0.0)], "i long, j long, value double")
    sinks.write_tsv(sinks.matrix(m, ["p", "q"]), str(tmp_path / "m"))
    text = next((tmp_path / "m").glob("part-*")).read_text()
    assert text == "label\tp\tq\np\t0.0\t2.0\nq\t2.0\t0.0\n"
    models = spark.createDataFrame([(1, None, True)], "model_id long, a_weight double, keep boolean")
    sinks.write_models(models, str(tmp_path / "h"))
    assert next((tmp_path / "h").glob("part-*")).read_text() == "model_id\ta_weight\tkeep\n1\t-\tTrue\n"
    with pytest.raises(ValueError):
        sinks.edge_resistances(models)
    assert sinks.edge_resistances(spark.createDataFrame([(1, 2.0, 3.0)], "edge_id long, upstream double, downstream double")).columns == ["EDGE_ID", "Resistance_Downstream", "Resistance_Upstream"]
    line = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0, 5)], "x1 double, y1 double, x2 double, y2 double, edge_id long")
    assert json.loads(sinks.geojson(line).first()[0])["geometry"]["coordinates"] == [[0.0, 1.0], [2.0, 3.0]]


def test_command_line(spark, tmp_path):
    from thalweg.__main__ import main

    edges = [(k, float(k), 0.0, float(k + 1), 0.0, 1.0 + k % 3, float(k * k % 7), float(k % 4)) for k in range(12)]
    spark.createDataFrame(edges, "edge_id long, x1 double, y1 double, x2 double, y2 double, length_km double, slope double, flow double").write.parquet(str(tmp_path / "net"))
    at = [0, 3, 5, 8, 12]
    coords = write(tmp_path / "p.tsv", "sample\tlat\tlong\n" + "".join(f"s{k}\t0.01\t{x}\n" for k, x in enumerate(at)))
    head = "\t" + "\t".join(f"s{k}" for k in range(5))
    body = "".join(f"s{i}\t" + "\t".join(str(abs(a - b) + (0.3 * (i * j % 3) if i != j else 0)) for j, b in enumerate(at)) + "\n" for i, a in enumerate(at))
    inmat = write(tmp_path / "m.tsv", f"{head}\n{body}")
    out = str(tmp_path / "out")
    main(["optimise", "--network", str(tmp_path / "net"), "--coords", coords, "--inmat", inmat, "--vars", "slope,flow", "--out", out, "--max-iter", "2", "--reps", "3", "--nstart", "1", "--max-shape", "5", "--only-keep"])
    made = {p.split("out")[-1] for p in map(str, tmp_path.glob("out.*"))}
    assert {".HallOfFame.tsv", ".varImportance.tsv", ".modavgWeights.tsv", ".Null-Model.tsv", ".FitnessLog.tsv", ".Model-Average.ResistanceMatrix.tsv"} <= made
    spec = write(tmp_path / "s.tsv", "VAR\tWEIGHT\tTRANSFORM\tSHAPE\nlength_km\t1.0\t0\t0\n")
    main(["simulate", "--network", str(tmp_path / "net"), "--spec", spec, "--samples", "3", "--reps", "2", "--out", str(tmp_path / "sim")])
    assert os.path.isdir(tmp_path / "sim_2.ResistanceMatrix.tsv")


def test_adjacency_matrix(spark):
    adj = spark.createDataFrame([(0, 1, 1), (1, 0, -1), (1, 2, 1), (2, 1, -1)], "edge_i long, edge_j long, dir int")
    assert [tuple(r) for r in sinks.adjacency_matrix(adj, [0, 1, 2]).collect()] == [(0, 0, 1, 0), (1, -1, 0, 1), (2, 0, -1, 0)]


def test_outputs_by_model(spark, tmp_path):
    df = spark.createDataFrame([(0, 5, 1.5), (0, 6, 2.5), (1, 5, 3.5)], "model_id long, edge_id long, resistance double")
    sinks.write_by_model(df, str(tmp_path / "models"))
    assert sorted(f for f in os.listdir(tmp_path / "models") if f.startswith("model_id")) == ["model_id=0", "model_id=1"]
    back = spark.read.parquet(str(tmp_path / "models")).select("model_id", "edge_id", "resistance")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
