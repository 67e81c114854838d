"""The whole job: discover, sample, cached recognition, parsing, consolidation, export; and its evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.operators import evaluate as E
from folioflux.operators import resolve as R
from folioflux.operators.graph import cut_lineage
from folioflux.operators.images import detect_grids
from folioflux.operators.recognise import MODES, recognise_pages
from folioflux.operators.select import apply_edits
from folioflux.plans.pages import Catalogs, parse_pages
from folioflux.sources import catalogs as C
from folioflux.sources import images as I
from folioflux.sources import sinks as S


@dataclass
class Config:
    images: str
    centers: str
    specialties: str
    given_names: str
    surnames: str
    places: str | None = None
    output: str | None = None
    cache: str | None = None
    mode: str = "auto"
    limit: int | None = None
    force: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r}; one of {', '.join(MODES)}")


@dataclass
class Result:
    people: DataFrame
    evidence: DataFrame
    errors: DataFrame
    unmapped: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


class Timer:
    """Wall seconds by stage, four places."""

    def __init__(self, report: Callable[[float, str], None] | None = None):
        self.seconds: dict[str, float] = {}
        self._last = self._start = time.perf_counter()
        self._report = report

    def stage(self, name: str, share: float) -> None:
        now = time.perf_counter()
        self.seconds[name] = round(now - self._last, 4)
        self._last = now
        if self._report:
            self._report(max(0.0, min(1.0, 0.04 + 0.88 * share)), name)

    def end(self) -> dict[str, float]:
        return self.seconds | {"total_segundos": round(time.perf_counter() - self._start, 4)}


def catalogs_of(spark: SparkSession, config: Config) -> Catalogs:
    return Catalogs(C.read_specialties(spark, config.specialties), C.read_places(spark, config.places), C.read_lexicons(spark, config.given_names, config.surnames))


def with_pixels(spark: SparkSession, images: DataFrame, folder: str) -> DataFrame:
    """image_id and Spark's image struct; the two file sources write a path's scheme differently."""
    slashes = lambda c: F.regexp_replace(c, "^([a-z]+):/+", "$1:/")
    pixels = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(folder)
    return images.select("image_id", slashes(F.col("path")).alias("_path")).join(pixels.withColumn("_path", slashes(F.col("image.origin"))), "_path").drop("_path")


def recognised_lines(spark: SparkSession, images: DataFrame, config: Config, make_engine) -> DataFrame:
    """Lines of all images: cached ones, and the rest recognised and added to the cache."""
    if config.cache is None:
        hits, misses = None, images
    else:
        hits, misses = I.cached_lines(images, I.read_cache(spark, config.cache, config.mode), config.mode)
        hits = cut_lineage(hits)  # before the cache table grows
    wanted = with_pixels(spark, misses, config.images)
    found = recognise_pages(wanted, make_engine, config.mode)
    if config.cache is not None:
        found = cut_lineage(found)  # no page is recognised twice
        read = misses.join(wanted.select("image_id"), "image_id", "left_semi")  # a file that is no image has no entry
        I.store_lines(found, read, config.cache, config.mode)
    columns = ["image_id", "line_no", "text", "score", "box", "image_width", "image_height"]
    return found.select(*columns) if hits is None else hits.select(*columns).unionByName(found.select(*columns))


def run(spark: SparkSession, config: Config, make_engine=None, lines: DataFrame | None = None, report: Callable[[float, str], None] | None = None) -> Result:
    """People of all images. Lines may be given (image_id as in discover); else make_engine recognises them."""
    timer = Timer(report)
    centers = C.read_centers(spark, config.centers)
    catalogs = catalogs_of(spark, config)
    images = I.sample_evenly(I.discover(spark, config.images, centers), config.limit)
    unmapped = I.unmapped(spark, config.images, centers)
    if images.isEmpty():
        raise ValueError(f"no images of configured centers; unmapped: {[r['relative'] for r in unmapped.limit(20).collect()]}")
    timer.stage("descubrimiento_segundos", 0.1)
    grids = None
    if lines is None:
        if make_engine is None:
            raise ValueError("lines or a recogniser are needed")
        lines = recognised_lines(spark, images, config, make_engine)
        grids = detect_grids(with_pixels(spark, images, config.images))
    timer.stage("ocr_segundos", 0.5)
    parsed = parse_pages(lines, catalogs, images, grids)
    parsed = cut_lineage(parsed)
    errors = parsed.where("error is not null").join(images.select("image_id", "path"), "image_id").select("path", "error")
    order = images.select("image_id", F.col("ordinal").alias("page"))
    rows = parsed.where("error is null").join(order, "image_id").withColumn("ordinal", F.col("page").cast("long") * (1 << 20) + F.col("record_no"))
    timer.stage("interpretacion_segundos", 0.7)
    people, evidence = R.consolidate(rows.drop("image_id", "record_no", "error", "page"))
    people = R.mark_duplicates(people, R.possible_pairs(people, catalogs.lexicons))
    timer.stage("consolidacion_segundos", 1.0)
    return Result(people, evidence, errors, unmapped, timer.end())


def export(result: Result, path: str, specialties: list[str], force: bool = False) -> str:
    return S.write_workbook(S.export_rows(result.people), path, specialties, force)


#: Edited columns and the record columns they set
EDITS = {"nombre_completo": "full_name", "nombre": "first_name", "apellido": "last_name", "cedula": "document_id", "centro": "center", "sexo": "sex", "procedencia": "origin", "especialidad": "specialty", "area": "area", "estado_revision": "review_status"}


def edit_people(people: DataFrame, edits: DataFrame) -> DataFrame:
    """People with an edited table (id_paciente, the edited columns, edad, unidad_edad, observaciones) applied by id.

    Unknown ids are ignored; an age outside 0 to 115 is an error; notes are split at `;` and replace the clinical ones.
    """
    if "id_paciente" not in edits.columns:
        raise ValueError("the edited table has no id_paciente")
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    number = F.nullif(text("edad"), F.lit("")).cast("double").cast("int")
    age = F.when(number.isNull() | number.between(0, 115), number).otherwise(F.raise_error(F.concat(F.lit("Edad fuera del rango permitido: "), number.cast("string"))).cast("int"))
    made = edits.select(F.trim("id_paciente").alias("patient_id"), *(text(c).alias(t) for c, t in EDITS.items()), age.alias("age"), text("unidad_edad").alias("age_unit"), F.filter(F.transform(F.split(text("observaciones"), ";"), lambda x: F.trim(x)), lambda x: x != "").alias("notes"))
    made = made.withColumns({"age_unit": F.when(F.col("age").isNotNull(), F.col("age_unit")).otherwise(""), "sex": F.upper("sex"), "clinical_notes": F.lit(""), "needs_review": F.col("review_status") == "Pendiente"})
    return apply_edits(people, made, "patient_id", [c for c in made.columns if c != "patient_id"])


def predicted_rows(spark: SparkSession, config: Config, make_engine=None, lines: DataFrame | None = None) -> DataFrame:
    """Evaluation rows (stem, row_no, fields) of all images, parsed but not merged, as truth tables are by image."""
    catalogs = catalogs_of(spark, config)
    images = I.discover(spark, config.images, C.read_centers(spark, config.centers))
    grids = None
    if lines is None:
        lines, grids = recognised_lines(spark, images, config, make_engine), detect_grids(with_pixels(spark, images, config.images))
    rows = parse_pages(lines, catalogs, images, grids).where("error is null").join(images.select("image_id", "path"), "image_id")
    return E.expected_fields(rows.withColumns({"stem": F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), "row_no": F.col("record_no") + F.lit(1).cast("long")}))


def evaluate_images(spark: SparkSession, config: Config, expected: str, make_engine=None, lines: DataFrame | None = None, folder: str | None = None, only: list[str] | None = None) -> dict[str, DataFrame]:
    """From images and truth files to the report: what evaluate returns, and `faltantes` (stem, error): cases that lack a
    side, have several images or a truth file that is not valid. Only cases without such an error are compared.
    """
    truth = I.read_truth(spark, expected)
    invalid = E.truth_errors(truth).unionByName(I.encoding_errors(spark, expected)).select("stem", F.concat_ws(": ", F.lit("datos esperados"), "error").alias("error")).distinct()
    images = I.discover(spark, config.images, C.read_centers(spark, config.centers), content=False)
    cases, unpaired = I.pair_cases(images, truth, only)
    fine = cases.join(invalid, "stem", "left_anti").select("stem")
    predicted = predicted_rows(spark, config, make_engine, lines)
    out = evaluate(truth.join(fine, "stem", "left_semi"), predicted.join(fine, "stem", "left_semi"), folder)
    return out | {"faltantes": unpaired.join(invalid, "stem", "left_anti").unionByName(invalid)}


def diagnose(result: Result, folder: str) -> None:
    """The run's page errors and seconds as errores.json and tiempos.json; errors come to the driver one by one."""
    S.write_diagnostics(folder, [{"imagen": r["path"], "error": r["error"]} for r in result.errors.orderBy("path").toLocalIterator()], [result.seconds])


def review_counts(people: DataFrame) -> DataFrame:
    """One row: all, pending, possible duplicates."""
    pending = (F.col("review_status") == "Pendiente") | ((F.col("review_status") == "") & F.col("needs_review"))
    return people.agg(F.count("*").alias("total"), F.count_if(pending).alias("pendientes"), F.count_if(F.col("duplicate_status") == R.POSSIBLE).alias("posibles_duplicados"))


def evaluate(expected: DataFrame, predicted: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """Alignment, field, case and difference tables of (stem, row_no, fields); written as CSV and JSON on request."""
    aligned = cut_lineage(E.align_rows(expected, predicted))
    fields = cut_lineage(E.compared_fields(aligned, expected, predicted))
    differences = E.differences(aligned, fields, expected, predicted)
    cases = E.case_report(aligned).join(differences.groupBy(F.col("imagen").alias("stem")).agg(F.count("*").alias("diferencias")), "stem", "left").fillna({"diferencias": 0}).withColumnRenamed("stem", "imagen")
    out = {"casos": cases, "campos": E.field_report(fields, ["field"]).withColumnRenamed("field", "campo"), "diferencias": differences}
    if folder:
        for name, df in out.items():
            S.write_report_csv(df, f"{folder}/{name}.csv")
        total = cases.agg(F.count("*").alias("imagenes"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"registros_{c}") for c in ("esperados", "obtenidos", "alineados"))).first().asDict()
        e, p, m = (total[f"registros_{c}"] for c in ("esperados", "obtenidos", "alineados"))
        share = lambda a, b, other: round(a / b, 4) if b else float(not other)
        S.write_json(total | {"cobertura_registros": share(m, e, p), "precision_registros": share(m, p, e)}, f"{folder}/resumen.json")
    return out | {"alineacion": aligned, "comparados": fields}
