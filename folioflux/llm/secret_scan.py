"""Secret scan: an Aho-Corasick keyword prefilter, anchored expressions only where it hits, then embedded checksums.

A slice of texts is lower-cased (A-Z) once and run through one automaton of all keywords; at each hit the keyword's
expression is tried at that very place of the original bytes, and nowhere else. Runs of hexadecimal digits have no
keyword: every sixth byte is looked at, and only where four in a row are digits the run is measured. Tokens that carry a
checksum are spans only if it holds, so look-alikes are left out.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.kernels import arrow_rows, text_buffers
from folioflux.llm.shared import small_arrow_batches

#: Fixed base expressions
ASSIGN = rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Fixed alphabets of the checksums: base 62 of forge tokens, and the 32 characters of bech32 with its generators
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
#: Kinds in the order in which spans of one start are listed; the first three are the base ones
KINDS = ("assign", "access", "hex", "forge", "registry", "age")
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_STEP = LEAST_HEX // 4
_HEX_RUN = re.compile(rb"[0-9a-f]+")


def crc_holds(token: bytes) -> bool:
    """A prefix up to `_`, 30 characters and 6 of base 62: their CRC-32, with zeros in front."""
    body = token[token.index(b"_") + 1 :]
    value = 0
    for c in body[30:]:
        value = value * 62 + BASE62.index(c)
    return zlib.crc32(body[:30]) == value


def bech32_holds(token: bytes) -> bool:
    """The last six characters of a bech32 string are its checksum; the part before the last `1` is its prefix."""
    low = token.lower()
    prefix, data = low[: low.rindex(b"1")], low[low.rindex(b"1") + 1 :]
    check = 1
    for v in [*(c >> 5 for c in prefix), 0, *(c & 31 for c in prefix), *map(BECH32.index, data)]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for k, g in enumerate(GENERATORS):
            check ^= g if top >> k & 1 else 0
    return check == 1


def _long_enough(match: re.Match) -> bool:
    return match.end(1) - match.start(1) >= LEAST_ASSIGNED


#: To each kind with keywords: these (lower case), its expression, and what a match has to satisfy
RULES = {
    "assign": ([b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"], re.compile(ASSIGN), _long_enough),
    "access": ([b"akia"], re.compile(ACCESS), lambda m: m.end() - m.start() >= LEAST_ACCESS),
    "forge": ([b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"], re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}\b"), lambda m: crc_holds(m[0])),
    "registry": ([b"npm_"], re.compile(rb"npm_[A-Za-z0-9]{36}\b"), lambda m: crc_holds(m[0])),
    "age": ([b"age-secret-key-1"], re.compile(rb"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}\b"), lambda m: bech32_holds(m[0])),
}


@lru_cache(1)
def automaton():
    """Aho-Corasick automaton of all keywords; a hit gives the keyword's length and kind."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for kind, (words, _, _) in RULES.items():
        for w in words:
            made.add_word(w.decode("latin-1"), (len(w), kind))
    made.make_automaton()
    return made


def hex_runs(data: np.ndarray, lo: int, hi: int) -> list[int]:
    """Places in data[lo:hi] of which one at least lies in every run of LEAST_HEX hexadecimal digits."""
    look = _HEX[data[lo:hi:_STEP]]
    if len(look) < 4:
        return []
    return (np.flatnonzero(look[:-3] & look[1:-2] & look[2:-1] & look[3:]) * _STEP + lo).tolist()


def spans_of(column) -> list[list[tuple[int, int, str]]]:
    """To each text of a column its spans (start, end, kind) in code points, by start and then kind as listed."""
    data, at = text_buffers(column)
    lo, hi = int(at[0]), int(at[-1])
    found: dict[int, list[tuple[int, int, str]]] = {}
    raw = data[lo:hi].tobytes()
    ends = at[1:] - lo
    done: dict[str, int] = {}
    for last, (size, kind) in automaton().iter(raw.lower().decode("latin-1")):
        start = last + 1 - size
        if start < done.get(kind, 0):
            continue
        row = int(np.searchsorted(ends, start, "right"))
        match = RULES[kind][1].match(raw, start, int(ends[row]))
        if match:
            done[kind] = match.end()
            if RULES[kind][2](match):
                found.setdefault(row, []).append((start, match.end(), kind))
    after = 0
    for place in hex_runs(data, lo, hi):
        place -= lo
        if place < after:
            continue
        row = int(np.searchsorted(ends, place, "right"))
        first, end = (int(ends[row - 1]) if row else 0), int(ends[row])
        after = _HEX_RUN.match(raw, place, end).end()
        start = place
        while start > first and _HEX[raw[start - 1]]:
            start -= 1
        if after - start >= LEAST_HEX:
            found.setdefault(row, []).append((start, after, "hex"))
    return [_by_code_points(data, int(at[i]), lo, found[i]) if i in found else [] for i in range(len(at) - 1)]


def _by_code_points(data: np.ndarray, first: int, lo: int, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte places of a slice that begins at lo as code points of the text that begins at first."""
    last = max(e for _, e, _ in spans) + lo
    before = np.zeros(last - first + 1, np.int64)
    np.cumsum((data[first:last] & 0xC0) != 0x80, out=before[1:])
    place = lambda p: int(before[p + lo - first])
    return sorted(((place(s), place(e), k) for s, e, k in spans), key=lambda x: (x[0], KINDS.index(x[2])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, secrets (array of start, end, kind; in code points, end exclusive).

    Base kinds: `assign`, `access` and `hex`, leftmost and non-overlapping per kind, those too short dropped after they
    were matched. The method's own: `forge` and `registry` tokens with a CRC-32 and `age` keys with a bech32 checksum
    that hold. Null and empty texts have none; repeated rows and ids give a row each; an empty table gives none; other
    columns are not read. Nothing is shuffled; a slice of about 1 MB of texts, or one longer text, is held at a time.
    """
    small_arrow_batches(docs.sparkSession)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def scan(batches):
        for batch in batches:
            for part in arrow_rows(batch):
                spans = [[{"start": s, "end": e, "kind": k} for s, e, k in row] for row in spans_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(span))], ["id", "secrets"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, secrets array<struct<start: long, end: long, kind: string>>").withColumnRenamed("id", id_col)


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan_secrets as counts of the base kinds, a digest of the base spans and all spans as text."""
    listed = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = lambda *kinds: F.filter("secrets", lambda x: x["kind"].isin(*kinds))
    return scan_secrets(docs, id_col, text_col).select(
        id_col,
        *(F.size(own(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(own(*KINDS[:3])), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
