"""Sinks: the record table, the workbook, CSV and JSON reports.

The workbook is written as OOXML with the standard library, a row at a time from the driver's iterator.
"""

from __future__ import annotations

import csv
import io
import json
import os
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions.schemas import BOX
from folioflux.functions.text import formula_safe

TEMPLATE_ROWS = 1000
#: Fixed column names of the workbook, in order, each with what it takes
COLUMNS = [
    "id_paciente", "nombre_completo", "nombre", "apellido", "confianza_separacion_nombre", "orden_nombre_detectado", "cedula", "centro", "edad", "unidad_edad", "sexo", "procedencia", "especialidad", "area",
    "imagenes_origen", "confianza_ocr", "confianza_nombre", "confianza_cedula", "confianza_edad", "confianza_procedencia", "confianza_especialidad", "evidencia_extraccion", "estado_revision", "observaciones",
    "apariciones", "estado_duplicado", "detalle_duplicado", "linea_ocr_original",
]
TEMPLATE = ["nombre", "apellido", "cedula", "centro", "edad_sector"]
UNITS, SEXES, REVIEW, DUPLICATES = ["años", "meses", "días"], ["M", "F"], ["Pendiente", "No requerido", "Revisado"], ["Único", "Posible duplicado", "Duplicado consolidado"]


def export_rows(people: DataFrame) -> DataFrame:
    """The 28 columns of a record, texts that look like formulas quoted, notes and images joined in order."""
    known = F.col("age").isNotNull()
    text = lambda c: formula_safe(F.coalesce(F.col(c), F.lit("")))
    listed = lambda c: F.array_join(F.array_distinct(F.filter(c, lambda x: x != "")), "; ")
    evidence = F.array_join(F.transform(F.filter(F.map_entries("field_evidence"), lambda e: e["value"] != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    images = F.when(F.size("source_images") > 0, F.col("source_images")).otherwise(F.array("source_image"))
    review = F.when(F.col("review_status") != "", F.col("review_status")).when(F.col("needs_review"), "Pendiente").otherwise("No requerido")
    made = [
        F.col("patient_id"), text("full_name"), text("first_name"), text("last_name"), F.col("name_split_confidence"), F.col("detected_name_order"), text("document_id"), F.col("center"), F.col("age"), F.when(known, F.col("age_unit")).otherwise(""),
        F.col("sex"), text("origin"), F.col("specialty"), F.col("area"), listed(images), F.col("confidence"), F.col("name_confidence"), F.col("document_confidence"), F.col("age_confidence"), F.col("origin_confidence"),
        F.col("specialty_confidence"), formula_safe(evidence), review, listed(F.concat(F.array("clinical_notes"), F.col("notes"))), F.col("occurrences"), F.col("duplicate_status"), F.col("duplicate_detail"), text("raw_line"),
    ]
    return people.select(*(c.alias(n) for c, n in zip(made, COLUMNS)))


def with_age_and_sector(rows: DataFrame) -> DataFrame:
    """edad_sector: age with its unit and the origin, joined by a middle dot."""
    age = F.when(F.col("edad").isNotNull(), F.concat_ws(" ", F.col("edad").cast("string"), F.nullif("unidad_edad", F.lit(""))))
    return rows.withColumn("edad_sector", F.concat_ws(" · ", age, F.nullif("procedencia", F.lit(""))))


# ---------------------------------------------------------------- workbook


def column_letter(n: int) -> str:
    """A for 1, Z for 26, AA for 27."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def letters_of(columns: list[str]) -> dict[str, str]:
    return {c: column_letter(k) for k, c in enumerate(columns, 1)}


def template_formulas(row: int) -> list[str]:
    """Formulas of a template row: the record sheet's fields, blank where it has no record."""
    at = {c: f"Pacientes!${letter}{row}" for c, letter in letters_of(COLUMNS).items()}
    shown = [f'IF({at["id_paciente"]}="","",{at[c]}&"")' for c in TEMPLATE[:-1]]
    age = f'IF({at["edad"]}="","",{at["edad"]}&IF({at["unidad_edad"]}="",""," "&{at["unidad_edad"]}))'
    dot = f'IF(AND({at["edad"]}<>"",{at["procedencia"]}<>"")," · ","")'
    return [*shown, f'IF({at["id_paciente"]}="","",{age}&{dot}&{at["procedencia"]})']


def _cell(ref: str, value) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        clean = "".join(c for c in str(value) if c in "\t\n\r" or ord(c) >= 32)
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'
    return f'<c r="{ref}"><v>{value!r}</v></c>'


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _sheet(columns: list[str], rows, validations=(), conditions: str = "", table: bool = False, formulas: bool = False) -> tuple[str, int]:
    """A sheet's XML and its number of data rows: header frozen and filtered, widths by content (10 to 50)."""
    body, widths, n = [], [len(c) for c in columns], 0
    for n, row in enumerate(rows, 1):
        cells = []
        for k, v in enumerate(row):
            ref = f"{column_letter(k + 1)}{n + 1}"
            cells.append(f'<c r="{ref}" t="str"><f>{escape(v)}</f></c>' if formulas else _cell(ref, v))
            if not formulas and v is not None:
                widths[k] = max(widths[k], len(str(v)))
        body.append(f'<row r="{n + 1}">{"".join(cells)}</row>')
    last = column_letter(len(columns))
    head = "".join(_cell(f"{column_letter(k)}1", c) for k, c in enumerate(columns, 1))
    cols = "".join(f'<col min="{k}" max="{k}" width="{min(50, max(10, w + 2))}" customWidth="1"/>' for k, w in enumerate(widths, 1))
    lists = "".join(f'<dataValidation type="list" allowBlank="1" sqref="{c}2:{c}{TEMPLATE_ROWS + 1}"><formula1>{escape(chr(34) + ",".join(v) + chr(34))}</formula1></dataValidation>' for c, v in validations)
    parts = [
        f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet {_MAIN} xmlns:r="{_REL}"><dimension ref="A1:{last}{n + 1}"/>',
        '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>',
        f'<cols>{cols}</cols><sheetData><row r="1">{head}</row>{"".join(body)}</sheetData>',
        "" if table else f'<autoFilter ref="A1:{last}{n + 1}"/>',
        conditions,
        f'<dataValidations count="{len(validations)}">{lists}</dataValidations>' if validations else "",
        '<tableParts count="1"><tablePart r:id="rId1"/></tableParts>' if table else "",
        "</worksheet>",
    ]
    return "".join(parts), n


#: Fixed types of the dictionary sheet; the rest is text
_KINDS = {"edad": ("Entero", "0 a 115"), "apariciones": ("Entero", "1 o mayor"), "unidad_edad": ("Categoría", "; ".join(UNITS)), "sexo": ("Categoría", "M; F; vacío"), "estado_revision": ("Categoría", "; ".join(REVIEW)), "estado_duplicado": ("Categoría", "; ".join(DUPLICATES))}


def _dictionary() -> list[list[str]]:
    kind = lambda c: _KINDS.get(c, ("Decimal", "0 a 1") if c.startswith("confianza") else ("Texto", ""))
    return [["Plantilla", c, "Texto", ""] for c in TEMPLATE] + [["Pacientes", c, *kind(c)] for c in COLUMNS]


def write_workbook(rows: DataFrame, path: str, specialties: list[str], force: bool = False) -> str:
    """Plantilla (1000 rows of formulas), Pacientes, Diccionario; an existing file is replaced only by force."""
    if os.path.exists(path) and not force:
        raise FileExistsError(path)
    at = letters_of(COLUMNS)
    validations = [(at["unidad_edad"], UNITS), (at["sexo"], SEXES), (at["estado_revision"], REVIEW), (at["estado_duplicado"], DUPLICATES)]
    rule = lambda c, text, n: f'<conditionalFormatting sqref="{at[c]}2:{at[c]}{TEMPLATE_ROWS + 1}"><cfRule type="cellIs" dxfId="{n}" priority="{n + 1}" operator="equal"><formula>{escape(chr(34) + text + chr(34))}</formula></cfRule></conditionalFormatting>'
    conditions = rule("estado_revision", "Pendiente", 0) + rule("estado_duplicado", "Posible duplicado", 1) + rule("estado_duplicado", "Duplicado consolidado", 2)
    held = rows.orderBy("id_paciente").toLocalIterator(prefetchPartitions=True)
    listed = [["especialidad", s] for s in specialties]
    any_row = not rows.isEmpty()
    people, n = _sheet(COLUMNS, (list(r) for r in held), validations, conditions, table=any_row)
    template, _ = _sheet(TEMPLATE, (template_formulas(k) for k in range(2, TEMPLATE_ROWS + 2)), formulas=True)
    words, _ = _sheet(["hoja", "columna", "tipo", "valores_permitidos"], _dictionary() + [["Catálogo", *x, ""] for x in listed])
    names = ["Plantilla", "Pacientes", "Diccionario"]
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    last = f"{column_letter(len(COLUMNS))}{n + 1}"
    fills = "".join(f'<dxf><fill><patternFill><bgColor rgb="{c}"/></patternFill></fill></dxf>' for c in ("FFFFF2CC", "FFF8CBAD", "FFD9E1F2"))
    parts = {
        "[Content_Types].xml": f'{xml}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kinds}.worksheet+xml"/>' for k in (1, 2, 3))
        + f'<Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>'
        + (f'<Override PartName="/xl/tables/table1.xml" ContentType="{kinds}.table+xml"/>' if any_row else "")
        + "</Types>",
        "_rels/.rels": f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{xml}<workbook {_MAIN} xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{s}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(names, 1)) + '</sheets><calcPr calcId="191029" fullCalcOnLoad="1"/></workbook>',
        "xl/_rels/workbook.xml.rels": f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2, 3)) + f'<Relationship Id="rId4" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{xml}<styleSheet {_MAIN}><fonts count="1"><font/></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="1"><xf/></cellXfs><dxfs count="3">{fills}</dxfs></styleSheet>',
        "xl/worksheets/sheet1.xml": template,
        "xl/worksheets/sheet2.xml": people,
        "xl/worksheets/sheet3.xml": words,
    }
    if any_row:
        parts["xl/tables/table1.xml"] = f'{xml}<table {_MAIN} id="1" name="TablaPacientes" displayName="TablaPacientes" ref="A1:{last}"><autoFilter ref="A1:{last}"/><tableColumns count="{len(COLUMNS)}">' + "".join(f"<tableColumn id={quoteattr(str(k))} name={quoteattr(c)}/>" for k, c in enumerate(COLUMNS, 1)) + '</tableColumns><tableStyleInfo name="TableStyleMedium2" showRowStripes="1"/></table>'
        parts["xl/worksheets/_rels/sheet2.xml.rels"] = f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/table" Target="../tables/table1.xml"/></Relationships>'
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    temp = f"{path}.tmp"
    with zipfile.ZipFile(temp, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    os.replace(temp, path)
    return path


# ---------------------------------------------------------------- text reports


def write_report_csv(rows: DataFrame, path: str) -> str:
    """A `;` CSV with a byte order mark, as spreadsheets expect, in one file from the driver's iterator."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with io.open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, delimiter=";")
        out.writerow(rows.columns)
        for r in rows.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
    return path


def write_json(value, path: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    return path


def lines_as_json(lines: DataFrame) -> DataFrame:
    """One JSON text a page: its lines in order, scores rounded to six places."""
    body = F.struct("line_no", "text", F.round("score", 6).alias("score"), F.col("box").cast(BOX).alias("box"))
    return lines.groupBy("image_id").agg(F.to_json(F.struct(F.col("image_id"), F.array_sort(F.collect_list(body)).alias("lines"))).alias("json"))


def write_diagnostics(folder: str, errors: list[dict], timings: list[dict]) -> None:
    write_json(errors, f"{folder}/errores.json")
    write_json(timings, f"{folder}/tiempos.json")
