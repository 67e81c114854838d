import json
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.cli import main
from folioflux.functions.schemas import LINES, record
from folioflux.operators import evaluate as E
from folioflux.operators import resolve as R
from folioflux.operators.names import Lexicons
from folioflux.operators.recognise import Recorded
from folioflux.operators.select import even_ordinals, with_ordinal
from folioflux.plans import pipeline as P
from folioflux.plans.pages import Line
from folioflux.sources import catalogs as C
from folioflux.sources import images as I
from folioflux.sources import sinks as S


def png(array):
    h, w, _ = array.shape
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + array[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.fixture
def job(tmp_path):
    t = str(tmp_path)
    blank = np.full((600, 500, 3), 255, np.uint8)
    for k, name in enumerate(("h1/a.png", "h1/sub/b.PNG", "h2/c.png", "other/d.png")):
        blank[0, 0, 0] = k
        put(f"{t}/images/{name}", png(blank))
    put(f"{t}/images/h1/notes.txt", "x")
    put(f"{t}/centers.csv", "﻿carpeta,centro,extra\nh1,Hospital Uno,\n h2 , Hospital Dos,\n")
    put(f"{t}/specialties.csv", "alias,especialidad,area\npediatria,Pediatría,\nPediatría UCI,Pediatría,UCI\n,x,\n")
    put(f"{t}/places.csv", "alias,lugar\npetare,Petare\n")
    put(f"{t}/given.csv", "termino,peso\nmaria,1.0\nluis,\n")
    put(f"{t}/surnames.csv", "termino,peso\nperez,2\ngomez,1\n")
    return t


def config(t, **more):
    return P.Config(f"{t}/images", f"{t}/centers.csv", f"{t}/specialties.csv", f"{t}/given.csv", f"{t}/surnames.csv", f"{t}/places.csv", **more)


READ = [Line("Pediatría", 0.95, 50, 100, 400, 140, 500, 600), Line("María Pérez 8a F Petare", 0.95, 50, 160, 450, 200, 500, 600)]


def test_catalogs(spark, job):
    assert [(r.slug, r.name) for r in C.read_centers(spark, f"{job}/centers.csv").orderBy("rank").collect()] == [("h1", "Hospital Uno"), ("h2", "Hospital Dos")]
    assert [a.alias for a in C.read_specialties(spark, f"{job}/specialties.csv")] == ["pediatria uci", "pediatria"]
    assert C.read_places(spark, None) == C.read_places(spark, f"{job}/none.csv") == []
    assert C.read_lexicons(spark, f"{job}/given.csv", f"{job}/surnames.csv") == Lexicons({"maria": 1.0, "luis": 1.0}, {"perez": 1.0, "gomez": 1.0})
    for bad in ("carpeta,centro\n", "carpeta,centro\na,x\na,y\n", "carpeta,centro\na,\n"):
        with pytest.raises(ValueError):
            C.read_centers(spark, put(f"{job}/bad.csv", bad))


def test_discovery_and_sampling(spark, job):
    centers = C.read_centers(spark, f"{job}/centers.csv")
    found = I.discover(spark, f"{job}/images", centers).orderBy("ordinal").collect()
    assert [(r.relative, r.center_name) for r in found] == [("h1/a.png", "Hospital Uno"), ("h1/sub/b.PNG", "Hospital Uno"), ("h2/c.png", "Hospital Dos")]
    assert [r.relative for r in I.unmapped(spark, f"{job}/images", centers).collect()] == ["other/d.png"]
    for n, limit, want in ((10, 3, [0, 4, 9]), (10, 0, []), (10, 1, [0]), (3, 9, [0, 1, 2]), (5, None, [0, 1, 2, 3, 4])):
        assert sorted(r.ordinal for r in even_ordinals(spark, n, limit).collect()) == want


def test_uploads_and_cases(spark):
    rows = spark.createDataFrame([("b é.png", b"\x89PNG\r\n\x1a\n.."), ("a.gif", b"x"), ("c.jpg", b""), ("d.jpg", b"nope")], "name string, content binary")
    got = {r.name: (r.error, r.stored) for r in I.check_uploads(rows).collect()}
    assert got == {"a.gif": ("extensión", "001_a.gif"), "b é.png": (None, "002_b_e.png"), "c.jpg": ("vacío", "003_c.jpg"), "d.jpg": ("formato", "004_d.jpg")}
    images = spark.createDataFrame([("x/a.png",), ("x/b.png",), ("y/b.png",)], "path string")
    truth = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    good, bad = I.pair_cases(images, truth)
    assert [r.stem for r in good.collect()] == ["a"] and {(r.stem, r.error) for r in bad.collect()} == {("b", "imagen duplicada"), ("c", "sin imagen")}
    good, bad = I.pair_cases(images, truth, ["A", "zz"])
    assert [r.stem for r in good.collect()] == ["a"] and {(r.stem, r.error) for r in bad.collect()} == {("zz", "no encontrado")}


def test_pipeline_with_cache_and_workbook(spark, job):
    done = []
    c = config(job, cache=f"{job}/cache", limit=None)
    lines = READ
    first = P.run(spark, c, lambda: Recorded(lines), report=lambda share, name: done.append(share))
    people = first.people.collect()
    assert [(r.patient_id, r.full_name, r.center, r.occurrences) for r in sorted(people, key=lambda r: r.first)] == [("PAC-0001", "María Pérez", "Hospital Uno", 2), ("PAC-0002", "María Pérez", "Hospital Dos", 1)]
    assert people[0].duplicate_status in ("Duplicado consolidado", "Único") and first.errors.count() == 0 and first.unmapped.count() == 1
    assert done == sorted(done) and "total_segundos" in first.seconds

    def broken():
        raise AssertionError("the cache should have all pages")

    again = P.run(spark, c, broken)
    assert sorted(r.patient_id for r in again.people.collect()) == ["PAC-0001", "PAC-0002"]
    rows = P.predicted_rows(spark, c, broken).orderBy("stem").collect()
    assert [(r.stem, r.row_no, r.nombre_completo, r.edad) for r in rows] == [(s, 1, "María Pérez", "8") for s in "abc"]
    path = P.export(first, f"{job}/out/book.xlsx", ["Pediatría"])
    with pytest.raises(FileExistsError):
        P.export(first, path, [])
    with zipfile.ZipFile(path) as z:
        import xml.dom.minidom as X

        for n in z.namelist():
            X.parseString(z.read(n))
        book, sheet, template = (z.read(f"xl/{n}.xml").decode() for n in ("workbook", "worksheets/sheet2", "worksheets/sheet1"))
    assert [s.split('"')[0] for s in book.split('sheet name="')[1:]] == ["Plantilla", "Pacientes", "Diccionario"]
    assert template.count("<row ") == 1001 and sheet.count("<dataValidation ") == 4 and sheet.count("<row ") == 3 and "María Pérez" in sheet
    with pytest.raises(ValueError):
        config(job, mode="wrong")


def test_pages_without_lines_are_read_once(spark, job):
    c = config(job, cache=f"{job}/cache")
    put(f"{job}/images/h2/broken.png", b"\x89PNG\r\n\x1a\n no picture")
    images = I.discover(spark, c.images, C.read_centers(spark, c.centers))
    assert P.recognised_lines(spark, images, c, lambda: Recorded([])).count() == 0
    hits, misses = I.cached_lines(images, I.read_cache(spark, c.cache, c.mode), c.mode)
    assert hits.count() == 0 and [r.relative for r in misses.collect()] == ["h2/broken.png"]


def test_a_webp_is_more_than_its_container(spark):
    rows = [("a.webp", b"RIFF\x10\0\0\0WEBPVP8 "), ("b.webp", b"RIFF\x10\0\0\0WAVEfmt ")]
    got = {r.name: r.error for r in I.check_uploads(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got == {"a.webp": None, "b.webp": "formato"}


def test_command_line(spark, job, capsys):
    centers = C.read_centers(spark, f"{job}/centers.csv")
    ids = [r.image_id for r in I.discover(spark, f"{job}/images", centers).collect()]
    rows = [(i, k, x.text, x.score, (x.x1, x.y1, x.x2, x.y2), x.width, x.height) for i in ids for k, x in enumerate(READ)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{job}/lines")
    args = ["process", *(x for n in ("images", "lines") for x in (f"--{n}", f"{job}/{n}")), *(x for n in ("centers", "specialties", "places", "surnames") for x in (f"--{n}", f"{job}/{n}.csv")), "--given-names", f"{job}/given.csv", "--output", f"{job}/o.xlsx"]
    assert main(args, spark) == 0 and "2 people" in capsys.readouterr().out
    with pytest.raises(FileExistsError):
        main(args, spark)
    head = ";".join(E.FIELDS)
    good = "María Pérez;María;Pérez;123456;H;8;años;F;Petare;;"
    put(f"{job}/truth/a.csv", f"﻿{head}\n{good}\nAna Gil;;;;H;9;años;F;;;\n")
    put(f"{job}/pred/a.csv", f"﻿{head}\n{good.replace('Petare', 'Caribe')}\n")
    assert main(["evaluate", "--expected", f"{job}/truth", "--predicted", f"{job}/pred", "--output", f"{job}/report"], spark) == 0
    with open(f"{job}/report/resumen.json") as f:
        assert json.load(f) == {"imagenes": 1, "registros_esperados": 2, "registros_obtenidos": 1, "registros_alineados": 1, "cobertura_registros": 0.5, "precision_registros": 1.0}
    with open(f"{job}/report/diferencias.csv", encoding="utf-8-sig") as f:
        assert {r.split(";")[1] for r in f.read().splitlines()[1:]} == {"campo_incorrecto", "registro_faltante"}
    assert main([*args, "--force", "--diagnostics", f"{job}/diag"], spark) == 0
    with open(f"{job}/diag/errores.json") as f, open(f"{job}/diag/tiempos.json") as g:
        assert json.load(f) == [] and "total_segundos" in json.load(g)[0]
    job_args = args[1 : args.index("--output")]
    put(f"{job}/truth/b.csv", f"{head}\n{good}\n".encode("latin-1"))
    put(f"{job}/truth/zz.csv", f"{head}\n{good}\n")
    assert main(["evaluate", "--expected", f"{job}/truth", *job_args], spark) == 1 and "b:None: codificación" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["evaluate", "--expected", f"{job}/pred"], spark)
    found = P.evaluate_images(spark, config(job), f"{job}/truth", lines=spark.read.parquet(f"{job}/lines"), folder=f"{job}/whole")
    assert {(r.stem, r.error) for r in found["faltantes"].collect()} == {("b", "datos esperados: codificación"), ("c", "sin datos esperados"), ("zz", "sin imagen")}
    assert [(r.imagen, r.esperados, r.obtenidos, r.alineados) for r in found["casos"].collect()] == [("a", 2, 1, 1)]
    assert os.path.exists(f"{job}/whole/resumen.json")
    capsys.readouterr()
    assert main(["evaluate", "--expected", f"{job}/pred", *job_args, "--output", f"{job}/r2"], spark) == 0 and os.path.exists(f"{job}/r2/casos.csv")
    put(f"{job}/wrong/a.csv", f"{head}\nA;;;;H;200;siglos;X;;;\n")
    assert main(["evaluate", "--expected", f"{job}/wrong", "--predicted", f"{job}/pred", "--validate-only"], spark) == 1


def person(k, name="Maria Perez", age=8, document="", confidence=0.9, **more):
    return record(full_name=name, center="H", age=age, age_unit="años" if age is not None else "", document_id=document, confidence=confidence, source_image=f"i{k}.jpg", **more) | {"ordinal": k}


def frame(spark, rows):
    from folioflux.functions.schemas import RECORD

    return spark.createDataFrame(rows, f"ordinal long, {RECORD}")


def solve(spark, rows, lexicons=None):
    people, evidence = R.consolidate(frame(spark, rows))
    people = R.mark_duplicates(people, R.possible_pairs(people, lexicons))
    return sorted(people.collect(), key=lambda r: r.patient_id), sorted(evidence.collect(), key=lambda r: r.evidence_id)


def test_equal_records_merge(spark):
    people, evidence = solve(spark, [person(0, confidence=0.95), person(1, confidence=0.85)])
    assert len(people) == 1 and people[0].occurrences == 2 and people[0].duplicate_detail == "2 apariciones consolidadas en 2 imagen(es)"
    assert [(e.evidence_id, e.patient_id, e.ordinal) for e in evidence] == [("EVI-00001", "PAC-0001", 0), ("EVI-00002", "PAC-0001", 1)]


def test_order_is_of_first_occurrence(spark):
    people, _ = solve(spark, [person(0, "Ana Gil Rojas", 5, confidence=0.4), person(1, "Luis Paz Mora", 6, confidence=0.8), person(2, "Ana Gil Rojas", 5, confidence=0.99, sex="F")])
    assert [(p.full_name, p.source_images) for p in people] == [("Ana Gil Rojas", ["i0.jpg", "i2.jpg"]), ("Luis Paz Mora", ["i1.jpg"])]


def test_document_decides(spark):
    people, _ = solve(spark, [person(0, document="V-12.345.678"), person(1, "M Perez", 9, "12345678")])
    assert len(people) == 1 and {"Nombre OCR diferente para la misma cédula", "Edad diferente para la misma cédula"} <= set(people[0].notes)


def test_blanks_fill_and_conflicts_stay(spark):
    people, _ = solve(spark, [person(0, confidence=0.9, notes=["Procedencia no reconocida"], needs_review=True), person(1, confidence=0.8, origin="Petare", origin_confidence=0.7, field_evidence={"procedencia": "x"}), person(2, confidence=0.7, specialty="A"), person(3, confidence=0.6, specialty="B")])
    p, = people
    assert (p.origin, p.origin_confidence, p.field_evidence["procedencia"], p.specialty) == ("Petare", 0.7, "x", "A")
    assert p.notes == ["Conflicto de especialidad: A / B"]


def test_possible_duplicates(spark):
    lex = Lexicons({"samuel": 1.0}, {"vega": 1.0})
    people, _ = solve(spark, [person(0, "Samuel Vega", 11), person(1, "Samwel Vega", 11), person(2, "Carla Mora", 11)], lex)
    assert [p.duplicate_status for p in people] == ["Posible duplicado"] * 2 + ["Único"]
    assert people[0].duplicate_detail == "Coincide con PAC-0002 | nombre normalizado 100% | misma edad | no fusionado"
    people, _ = solve(spark, [person(0, "Samuel Vega", None), person(1, "Samwel Vega", None), person(2, "Samuel Vega", None)], lex)
    assert [p.duplicate_status for p in people] == ["Posible duplicado", "Único", "Posible duplicado"]


def test_blocks_give_what_one_run_gives(spark):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(300):
        rows.append(person(k, rng.choice(["Ana Gil", "Luis Paz", "Eva Mora"]), rng.choice([None, 1, 2]), rng.choice(["", "", "111111", "222222"]), rng.random(), sex=rng.choice(["", "M", "F"]), origin=rng.choice(["", "A", "B"])) | {"center": rng.choice("XY")})
    whole = [(p["full_name"], p["center"], own, p["notes"]) for p, own in R.resolve([(r["ordinal"], {k: v for k, v in r.items() if k != "ordinal"}) for r in rows])]
    people, evidence = R.consolidate(frame(spark, rows))
    own = {}
    for e in evidence.collect():
        own.setdefault(e.patient_id, []).append(e.ordinal)
    got = sorted(((p.full_name, p.center, sorted(own[p.patient_id]), list(p.notes)) for p in people.collect()), key=lambda x: x[2][0])
    assert got == whole


def test_edits(spark):
    people, _ = R.consolidate(frame(spark, [person(0), person(1, "Ana Gil", 5)]))
    edits = spark.createDataFrame([(" PAC-0001", "María P", "", None, " 9 ", "años", "m", "Pendiente", "a; ;b"), ("PAC-9", "x", "", "", "", "", "", "", "")], "id_paciente string, nombre_completo string, nombre string, apellido string, edad string, unidad_edad string, sexo string, estado_revision string, observaciones string")
    edits = edits.withColumns({c: F.lit("") for c in ("cedula", "centro", "procedencia", "especialidad", "area")})
    got = sorted(P.edit_people(people, edits).collect(), key=lambda r: r.patient_id)
    assert (got[0].full_name, got[0].last_name, got[0].age, got[0].sex, got[0].notes, got[0].needs_review) == ("María P", "", 9, "M", ["a", "b"], True)
    assert got[1].full_name == "Ana Gil" and len(got) == 2
    with pytest.raises(Exception, match="fuera del rango"):
        P.edit_people(people, edits.withColumn("edad", F.lit("200"))).collect()
    assert P.review_counts(P.edit_people(people, edits)).first().pendientes == 1


def test_alignment():
    e = [{"nombre_completo": n, "cedula": "", "edad": "8", "sexo": "F"} for n in ("Ana Gil", "Luis Paz", "Eva Mora")]
    scores = np.array([[E.pair_similarity(a, b) for b in (e[0], e[2])] for a in e])
    assert E.align(scores) == [(0, 0), (1, None), (2, 1)]
    assert E.align(np.zeros((0, 2))) == [(None, 0), (None, 1)]
    same = dict(e[0], cedula="V-123456"), dict(e[1], cedula="123456")
    assert E.pair_similarity(*same) == 0.98 and E.pair_similarity(e[0], dict(e[0], cedula="1")) == pytest.approx(0.86)


def test_stream(spark, job):
    from folioflux.streaming.pages import read_pages, write_records

    page = {"image_id": "p1", "path": "h1/a.png", "center_name": "Uno", "lines": [{"line_no": k, "text": x.text, "score": x.score, "box": {"x1": x.x1, "y1": x.y1, "x2": x.x2, "y2": x.y2}, "image_width": 500, "image_height": 600} for k, x in enumerate(READ)]}
    put(f"{job}/pages/1.json", json.dumps(page) + "\n")
    query = write_records(read_pages(spark, f"{job}/pages"), P.catalogs_of(spark, config(job)), f"{job}/records", f"{job}/state")
    query.awaitTermination(120)
    assert [(r.full_name, r.center) for r in spark.read.parquet(f"{job}/records").collect()] == [("María Pérez", "Uno")]


def test_ordinals_over_ranges(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x"))
    got = with_ordinal(rows, ["x"], "n", bucket_rows=300).collect()
    assert all(r.x == r.n for r in got) and len(got) == 5000


def test_ordinals_of_texts(spark):
    texts = ["b", "a", "ab", "", "ñandú", "zz", "a b", "same/prefix/1", "same/prefix/0", "same/prefix/10"] + [f"k{(k * 37) % 500:03d}" for k in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    got = with_ordinal(rows, ["t"], "n", bucket_rows=50).orderBy("n").collect()
    assert [r.t for r in got] == sorted(texts, key=str.encode) and [r.n for r in got] == list(range(len(texts)))


def test_sheet_letters_and_json(spark):
    assert [S.column_letter(k) for k in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"]
    rows = spark.createDataFrame([("i", 0, "a", 0.12345678, (1, 2, 3, 4), 5, 6)], LINES)
    assert json.loads(S.lines_as_json(rows).first().json)["lines"][0]["score"] == 0.123457
