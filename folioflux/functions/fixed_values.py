"""Fixed values of the page grammar: word lists, letter tables and patterns whose results must not change."""

from __future__ import annotations

import re

LETTER = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
OLDEST = 115

AGE_WORDS = {"a", "ano", "anos", "mes", "meses", "dia", "dias"}

HEADER_WORDS = {
    "nombre",
    "apellido",
    "cedula",
    "edad",
    "sexo",
    "telefono",
    "procedencia",
    "plan",
    "paciente",
    "identificacion",
    "documento",
    "genero",
    "origen",
    "localidad",
    "sector",
    "direccion",
    "especialidad",
    "servicio",
    "area",
    "conducta",
    "observaciones",
    "cama",
    "habitacion",
    "cubiculo",
    "afiliacion",
    "diagnostico",
    "historia",
    "numero",
}

NOT_NAMES = {
    "am",
    "ano",
    "anos",
    "pm",
    "pn",
    "ci",
    "cama",
    "camilla",
    "cam",
    "hab",
    "habitacion",
    "cubiculo",
    "box",
    "silla",
    "an",
    "ban",
    "dato",
    "datos",
    "sala",
    "edad",
    "sexo",
    "telefono",
    "procedencia",
    "plan",
    "nombre",
    "apellido",
    "nocturno",
    "numero",
    "sin",
}

NOT_PEOPLE = {"lista actualizada", "hospital", "traslado", "la guaira", "guarenas", "petare", "caribe", "los corales", "playa grande"}

PAGE_FURNITURE = {"formato", "hospital", "nocturno"}
LIST_FURNITURE = ("lista ", "actualizada ", "hora ", "hospital ")
MONTHS = "ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic"

#: Letters that are read for digits: in an age with its unit, and in a cell of numbers
AGE_DIGITS = {"O": "0", "Q": "0", "I": "1", "L": "1", "B": "3", "S": "5", "G": "6", "Z": "2", "E": "2", "U": "4"}
CELL_DIGITS = {"O": "0", "Q": "0", "I": "1", "L": "1", "B": "3", "S": "5"}

#: What a lone mark in a column of sexes means; T, E and P are misread F, N is a misread M
SEX_MARKS = {"F": "F", "M": "M", "H": "M", "T": "F", "E": "F", "P": "F", "N": "M"}

WORD = re.compile(f"[{LETTER}'-]{{2,}}")
DATE = re.compile(r"\b\d{1,2}\s*[-/.]\s*\d{1,2}\s*[-/.]\s*\d{2,4}\b")
LIST_TIME = re.compile(r"\b\d{1,2}\s*[:.]\s*\d{2}\s*(?:[ap]\.?\s*m\.?)?\b", re.I)
TABLE_TIME = re.compile(r"\b\d{1,2}\s*[:.]\s*\d{2}\s*(?:[ap]\.?\s*m\.?)?", re.I)
MERIDIEM = re.compile(r"\b[ap]\s*\.?\s*m\.?\b", re.I)
LIST_AGE = re.compile(rf"(?<!\d)(\d{{1,3}})(?:\s*(años?|anos?|a|e|mes(?:es)?|d[ií]as?))?(?![{LETTER}0-9])", re.I)
MISREAD_AGE = re.compile(r"(?<![A-Za-z0-9])([0-9OQILBSGZEU]{1,3})\s*(años?|anos?|a|e|mes(?:es)?|d[ií]as?)(?=$|[^A-Za-z]|[MFH](?:\W|$))", re.I)
TYPED_AGE = re.compile(r"(?:edad\s*)?(\d{1,3})\s*(anos?|a|mes(?:es)?|dias?)?")
LAST_NUMBER = re.compile(r"(?<!\d)(\d{1,3})\s*$")
CELL_AGE = re.compile(r"[A-Za-z]?\d{1,3}|[A-Za-z]\d")
LIST_DOCUMENT = re.compile(r"(?<!\d)([VEve])?\s*[-.]?\s*(\d(?:[.,\-·]?\d){5,8})(?!\d)")
TABLE_DOCUMENT = re.compile(r"(?<!\d)(?:[VEve]\s*[-.]?\s*)?\d(?:[.,\-·]?\d){5,10}(?!\d)")
INDEX = re.compile(r"^\s*\d{1,3}(?:\s*[.):\-]\s*|\s+)")
CELL_INDEX = re.compile(r"^\s*\d{1,3}\s*[.):\-]?\s*")
LONE_INDEX = re.compile(r"\s*\d{1,3}\s*[.):\-]?\s*")
LONE_SEX = re.compile(r"(?<![A-Za-z])([MFH])(?![A-Za-z])", re.I)
BED = re.compile(
    r"^\s*(?:cama|camilla|cam|hab(?:itacion)?|cubiculo|box|silla)\b"
    r"(?:\s*(?:n(?:ro|o)?|num(?:ero)?)\.?)?"
    r"(?:[^A-Za-z0-9]+[A-Za-z]?\d{1,3}[A-Za-z]?|\s+[A-Za-z]?\d{1,3}[A-Za-z]?)?[^A-Za-z0-9]*",
    re.I,
)
