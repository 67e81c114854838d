"""Text columns: accents, normal form, display form, windows, digits, ages, dates. Each is JVM-side unless named *_kernel.

Columns keep null as null; the empty string stays the empty string.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, then combining marks (no counterpart: translate drops them)."""
    source, target = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            source.append(chr(code))
            target.append(bare)
    return "".join(source) + "".join(map(chr, range(0x300, 0x370))), "".join(target)


ACCENTED, BARE = _latin_table()


def strip_accents(c: Column) -> Column:
    """Latin letters without their marks; other letters as they are."""
    return F.translate(c, ACCENTED, BARE)


def normalize(c: Column) -> Column:
    """No marks, lower case, runs of anything but a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))


@lru_cache(maxsize=1 << 16)
def normalize_kernel(value: str) -> str:
    """The same rule over all of Unicode (compatibility forms too)."""
    bare = value if value.isascii() else "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return " ".join(re.sub("[^a-z0-9]+", " ", bare.lower()).split())


#: Fixed value: bullets, punctuation and dashes that a display form sheds at both ends
EDGES = r"\s•·.,;:()\-–—"


def clean_display(c: Column) -> Column:
    """Bars and underscores as blanks, no punctuation at the ends, single blanks."""
    inner = F.regexp_replace(F.translate(c, "|_", "  "), f"(?U)^[{EDGES}]+|[{EDGES}]+$", "")
    return F.trim(F.regexp_replace(inner, r"(?U)\s+", " "))


def clean_display_kernel(value: str) -> str:
    inner = re.sub(f"^[{EDGES}]+|[{EDGES}]+$", "", value.replace("|", " ").replace("_", " "))
    return " ".join(inner.split())


def safe_stem(c: Column, most: int = 60) -> Column:
    """ASCII file stem of letters, digits, dash and underscore; `imagen` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(strip_accents(c), "[^A-Za-z0-9_-]+", "_"), "^[_-]+|[_-]+$", "")
    return F.when(F.length(s) > 0, F.substring(s, 1, most)).otherwise("imagen")


def compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def first_words(c: Column, n: int) -> Column:
    """The first n words of the normal form; a text is only gone through as a whole where its first letters have no more."""
    near = words(normalize(F.substring(c, 1, 64 * n)))
    return F.slice(F.when(F.size(near) > n, near).otherwise(words(normalize(c))), 1, n)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression inside a lambda is evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(w: Column, n: Column) -> Column:
    last = F.size(w) - n + 1
    made = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(last >= 1, made).otherwise(F.array().cast("array<string>"))


def word_windows(c: Column, size: Column | int) -> Column:
    """All runs of `size` words, in order, repeats kept."""
    n = size if isinstance(size, Column) else F.lit(size)
    return let(words(c), lambda w: _runs(w, n))


def alias_windows(c: Column, alias: Column) -> Column:
    """Distinct runs of one word fewer than the alias has (one at least), as many, and one more, in that order."""
    n = F.size(words(alias))
    return let(words(c), lambda w: F.array_distinct(F.concat(_runs(w, F.greatest(n - 1, F.lit(1))), _runs(w, n), _runs(w, n + 1))))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def evaluation_value(field: str, c: Column) -> Column:
    """A field as evaluation compares it: document digits, whole years, upper-case sex, else the normal form."""
    text = F.coalesce(F.trim(c), F.lit(""))
    if field == "cedula":
        return digits(text)
    if field == "edad":
        number = text.try_cast("double")
        return F.when(number.isNotNull() & ~F.isnan(number), number.cast("long").cast("string")).otherwise(normalize(text))
    return F.upper(text) if field == "sexo" else normalize(text)


# ---------------------------------------------------------------- fields

#: Fixed patterns of dates, clock times and 6 to 11 digit groups
DATE = r"\b\d{1,2}\s*[-/.]\s*\d{1,2}\s*[-/.]\s*\d{2,4}\b"
TIME = r"\b\d{1,2}\s*[:.]\s*\d{2}\s*(?:[ap]\.?\s*m\.?)?\b"
DAY_MONTH = "^[0-9]{1,2}(ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)"
TABLE_DOCUMENT = r"(?<!\d)(?:[VEve]\s*[-.]?\s*)?\d(?:[.,\-·]?\d){5,10}(?!\d)"
#: Fixed map of letters that are read for digits
OCR_LETTERS, OCR_DIGITS = "OQILBS", "001135"


def is_metadata(c: Column) -> Column:
    """A date, a clock time, a day before a month's name, or a heading word at the start."""
    return c.rlike(f"(?i){DATE}|{TIME}") | normalize(c).rlike(f"{DAY_MONTH}|^(lista|actualizada|hora|hospital) ")


def table_documents(c: Column) -> Column:
    """Digit strings of all 6 to 11 digit groups, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({TABLE_DOCUMENT})"), F.lit(1)), digits)


def split_document_age(number: Column, oldest: int = 115) -> Column:
    """Struct document, age of a fused digit run: up to 9 digits are a document; of 10 or 11, an age of 2, 1 or 3
    digits at the end (within 0 to `oldest`) is split off where 6 to 9 digits are left."""
    n = F.length(number)
    pair = lambda doc, age: F.struct(doc.alias("document"), age.cast("int").alias("age"))
    out = F.when(n.between(6, 9), pair(number, F.lit(None)))
    for k in (2, 1, 3):
        tail = F.right(number, F.lit(k)).try_cast("int")
        ok = n.between(10, 11) & (n - k).between(6, 9) & tail.between(0, oldest)
        out = out.when(ok, pair(F.left(number, n - k), tail))
    return out.otherwise(pair(F.lit(""), F.lit(None)))


def ocr_number(c: Column, oldest: int = 115) -> Column:
    """A number of 1 to 3 digits in a cell whose letters may be misread digits; a C or E before it is dropped."""
    s = F.translate(F.regexp_replace(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")), "^[CE]", ""), OCR_LETTERS, OCR_DIGITS)
    n = F.regexp_extract(s, "^([0-9]{1,3})$", 1).try_cast("int")
    return F.when(n <= oldest, n)


def age_unit(c: Column) -> Column:
    """Struct unit, uncertain: days and months by their first letters, else years; a lone `e` is a doubtful year."""
    s = normalize(c)
    unit = F.when(F.startswith(s, F.lit("mes")), "meses").when(F.startswith(s, F.lit("dia")), "días").otherwise("años")
    return F.struct(unit.alias("unit"), (s == "e").alias("uncertain"))


def formula_safe(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote before it."""
    return F.when(c.rlike("^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)
