"""Entity resolution: an order-dependent merge of records into people, and possible duplicates left apart.

Records meet only over an equal document or an equal name and age in one center, so the components of these keys are
exact, independent units of work: a center of any size falls apart into them, and the sequential kernel sees one
component at a time. Ids follow from global order by a range-partitioned numbering.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions.schemas import RECORD, RECORD_FIELDS, with_defaults
from folioflux.functions.similarity import ratio
from folioflux.functions.text import digits, normalize_kernel
from folioflux.operators.graph import cut_lineage, key_components
from folioflux.operators.name_pairs import similar_candidates
from folioflux.operators.names import Lexicons, Splitter, name_keys
from folioflux.operators.select import with_ordinal

Record = dict[str, Any]
MERGED, POSSIBLE = "Duplicado consolidado", "Posible duplicado"
#: field, label in conflict notes, its confidence, its key among the evidence
_MERGED_FIELDS = [("sex", "sexo", None, None), ("document_id", "cédula", "document_confidence", "cédula"), ("origin", "procedencia", "origin_confidence", "procedencia"), ("specialty", "especialidad", "specialty_confidence", "especialidad"), ("area", "área", None, None)]
#: A note goes once its fields are filled
_SETTLED = {"Sexo no reconocido": ["sex"], "Procedencia no reconocida": ["origin"], "Edad no reconocida": ["age"], "Especialidad o área no reconocida": ["specialty"], "Nombre incompleto": ["first_name", "last_name"]}


def number(document: str) -> str:
    return re.sub("[^0-9]", "", document)


def same_person(a: Record, b: Record) -> bool:
    """One center; two documents decide alone; else equal known ages and names, and nothing that contradicts."""
    if a["center"] != b["center"]:
        return False
    x, y = number(a["document_id"]), number(b["document_id"])
    if x and y:
        return x == y
    if a["age"] is None or a["age"] != b["age"]:
        return False
    differ = lambda f, norm: a[f] and b[f] and norm(a[f]) != norm(b[f])
    return normalize_kernel(a["full_name"]) == normalize_kernel(b["full_name"]) and not (differ("age_unit", str) or differ("sex", str) or differ("origin", normalize_kernel))


def _note(r: Record, text: str) -> None:
    if text and text not in r["notes"]:
        r["notes"].append(text)


def merge_into(target: Record, new: Record) -> None:
    """Fill blanks of target from new, keep the surer evidence of equal values, note conflicts, drop settled notes."""
    target["occurrences"] += 1
    target["confidence"] = max(target["confidence"], new["confidence"])
    for image in new["source_images"] or [new["source_image"]]:
        if image not in target["source_images"]:
            target["source_images"].append(image)
    for field, label, sure, key in _MERGED_FIELDS:
        old, value = target[field], new[field]
        if not value:
            continue
        equal = bool(old) and normalize_kernel(old) == normalize_kernel(value)
        if old and not equal:
            _note(target, f"Conflicto de {label}: {old} / {value}")
        elif not old or (sure and new[sure] > target[sure]):
            if not old:
                target[field] = value
            if sure:
                target[sure] = new[sure]
                if new["field_evidence"].get(key):
                    target["field_evidence"][key] = new["field_evidence"][key]
    document = number(target["document_id"])
    if document and document == number(new["document_id"]):
        if normalize_kernel(target["full_name"]) != normalize_kernel(new["full_name"]):
            _note(target, "Nombre OCR diferente para la misma cédula")
        if target["age"] is not None and new["age"] is not None and target["age"] != new["age"]:
            _note(target, "Edad diferente para la misma cédula")
    if new["clinical_notes"] and new["clinical_notes"] not in target["clinical_notes"]:
        target["clinical_notes"] = " | ".join(x for x in (target["clinical_notes"], new["clinical_notes"]) if x)
    for note in new["notes"]:
        _note(target, note)
    filled = lambda f: target[f] is not None and target[f] != ""
    target["notes"] = [n for n in target["notes"] if n not in _SETTLED or not all(map(filled, _SETTLED[n]))]
    target["needs_review"] = bool(target["notes"])


def resolve(records: list[tuple[int, Record]]) -> list[tuple[Record, list[int]]]:
    """People of (ordinal, record) pairs, with the ordinals of each one's records in order of input.

    Records are taken by falling confidence, then ordinal; each goes to the earliest person it fits as that person is
    by then. People are found over their documents and their (name, age), so a record looks at few of them.
    """
    people: list[tuple[Record, list[int]]] = []
    by_key: dict[tuple, list[int]] = {}

    def keys(r: Record) -> list[tuple]:
        document = number(r["document_id"])
        own = [("d", r["center"], document)] if document else []
        return own + ([("n", r["center"], r["age"], normalize_kernel(r["full_name"]))] if r["age"] is not None else [])

    def listed(place: int) -> None:
        for k in keys(people[place][0]):
            if place not in by_key.setdefault(k, []):
                by_key[k].append(place)

    images: dict[int, list[str]] = {}
    for ordinal, r in sorted(records, key=lambda x: (-x[1]["confidence"], x[0])):
        images[ordinal] = list(r["source_images"] or [r["source_image"]])
        near = sorted({p for k in keys(r) for p in by_key.get(k, [])})
        place = next((p for p in near if same_person(people[p][0], r)), None)
        if place is None:
            first = r | {"source_images": list(images[ordinal]), "notes": list(r["notes"]), "field_evidence": dict(r["field_evidence"])}
            people.append((first, [ordinal]))
            place = len(people) - 1
        else:
            merge_into(people[place][0], r)
            people[place][1].append(ordinal)
        listed(place)
    for person, own in people:
        own.sort()
        person["source_images"] = list(dict.fromkeys(i for o in own for i in images[o]))
        if person["occurrences"] > 1:
            person["duplicate_status"] = MERGED
            person["duplicate_detail"] = f"{person['occurrences']} apariciones consolidadas en {len(person['source_images'])} imagen(es)"
    return sorted(people, key=lambda p: p[1][0])


def _as_record(values: list) -> Record:
    out = {}
    for (name, kind, default), v in zip(RECORD_FIELDS, values):
        if kind.startswith("array"):
            v = list(v) if v is not None else []
        elif kind.startswith("map"):
            v = dict(v) if v is not None else {}
        elif v is None or v != v:
            v = default
        elif kind == "int":
            v = int(v)
        out[name] = v
    return out


#: Small blocks share a call of the kernel: about so many rows.
CALL_ROWS = 5_000


def _resolve_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    blocks: dict[int, list[tuple[int, Record]]] = {}
    for block, ordinal, *values in zip(*(rows[c].tolist() for c in ("block", "ordinal", *(n for n, _, _ in RECORD_FIELDS)))):
        blocks.setdefault(block, []).append((ordinal, _as_record(values)))
    people = [p for block in blocks.values() for p in resolve(block)]
    return pd.DataFrame([{**p, "first": own[0], "members": own} for p, own in people], columns=[n for n, _, _ in RECORD_FIELDS] + ["first", "members"]).astype({"age": object})


def consolidate(records: DataFrame, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(people, evidence) of records with a unique input order: patient_id by first occurrence, evidence_id by order."""
    rows = with_defaults(records).withColumn("ordinal", F.col(order).cast("long"))
    document = digits(F.coalesce("document_id", F.lit("")))
    sep = F.lit("\u0001")
    rows = rows.withColumn("_document", F.when(document != "", F.concat(F.coalesce("center", F.lit("")), sep, document)))
    rows = name_keys(rows, "full_name", None)  # the kernel's own normal form, so that no block is cut
    name = F.coalesce(F.col("name_key.normal"), F.lit(""))
    rows = rows.withColumn("_name", F.when(F.col("age").isNotNull(), F.concat(F.coalesce("center", F.lit("")), sep, F.col("age").cast("string"), sep, name))).drop("name_key")
    blocks = key_components(rows, "ordinal", ["_document", "_name"])
    calls = max(1, rows.count() // CALL_ROWS)
    keyed = rows.join(blocks, "ordinal").select("block", F.pmod(F.xxhash64("block"), F.lit(calls)).alias("call"), "ordinal", *(n for n, _, _ in RECORD_FIELDS))
    found = keyed.groupBy("call").applyInPandas(_resolve_blocks, RECORD + ", first long, members array<long>")
    found = with_ordinal(cut_lineage(found), ["first"], "_n").withColumn("patient_id", F.format_string("PAC-%04d", F.col("_n") + 1)).drop("_n")
    evidence = found.select("patient_id", F.explode("members").alias("ordinal"))
    evidence = with_ordinal(evidence, ["ordinal"], "_n").select(F.format_string("EVI-%05d", F.col("_n") + 1).alias("evidence_id"), "patient_id", "ordinal")
    return found.drop("members"), evidence.join(rows.drop("_document", "_name"), "ordinal")


def pair_reason(a: Record, b: Record, splitter: Splitter | None) -> str | None:
    """Why two people of one center may be one (names by similarity, ages equal); None if they may not.

    The rule for one pair, that tests hold possible_pairs against.
    """
    x, y = number(a["document_id"]), number(b["document_id"])
    if a["center"] != b["center"] or (x and y and x != y):
        return None
    keys = [splitter.key(r["full_name"]) if splitter else (normalize_kernel(r["full_name"]),) * 2 for r in (a, b)]
    (plain, canon), (plain2, canon2) = keys
    if min(len(canon), len(canon2)) < 8:
        return None
    if a["age"] is None or b["age"] is None:
        return "mismo nombre | edad incompleta" if plain == plain2 else None
    if (a["age"], a["age_unit"]) != (b["age"], b["age_unit"]):
        return None
    said = name_reason(plain, canon, plain2, canon2)
    if said is None:
        return None
    out = [said, "misma edad"]
    if a["sex"] and b["sex"] and a["sex"] != b["sex"]:
        out.append("sexo diferente")
    if a["origin"] and b["origin"] and normalize_kernel(a["origin"]) != normalize_kernel(b["origin"]):
        out.append("procedencia diferente")
    return " | ".join(out)


@lru_cache(maxsize=1 << 16)
def name_reason(plain: str, canon: str, plain2: str, canon2: str) -> str | None:
    """How alike two names are, normal and canonical, the earlier person's first; None below 0.92.

    Equal letters bound a ratio from above, so most pairs need no match.
    """
    if plain == plain2:
        return "nombre 100%"
    able = lambda x, y: SequenceMatcher(None, x, y).quick_ratio() >= 0.92
    raw = ratio(plain, plain2) if able(plain, plain2) else 0.0
    better = raw if (plain, plain2) == (canon, canon2) else ratio(canon, canon2) if able(canon, canon2) else 0.0
    score = max(raw, better)
    return f"{'nombre normalizado' if better > raw else 'nombre'} {score:.0%}" if score >= 0.92 else None


def possible_pairs(people: DataFrame, lexicons: Lexicons | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """patient_id, other_id, first_a, first_b, reason of pairs left apart, first before other; with the columns `keep` of
    both as <name>_a and <name>_b.

    Names are compared, not people: the distinct names of a block (center, age, unit) meet over their rarest pairs of
    letters, a join that loses none at a similarity of 0.92 (name_pairs), in the orders in which their people stand, and
    only names that are alike bring their people together, in equi-joins without Python. Where an age is missing, people
    meet over (center, name).
    """
    fields = list(dict.fromkeys(["patient_id", "first", "center", "full_name", "document_id", "age", "age_unit", "sex", "origin", *keep]))
    keyed = name_keys(people.select(*fields), "full_name", lexicons).select(*fields, F.col("name_key.normal").alias("plain"), F.col("name_key.canonical").alias("canon"))
    keyed = name_keys(keyed.where(F.length("canon") >= 8), "origin", None).withColumn("place", F.col("name_key.normal")).drop("name_key")
    keyed = keyed.withColumn("document", digits(F.coalesce("document_id", F.lit(""))))
    sides = lambda rows: [rows.select(*(F.col(c).alias(f"{c}_{s}") for c in rows.columns)) for s in "ab"]
    a, b = sides(keyed)
    before = F.col("first_a") < F.col("first_b")
    apart = (F.col("document_a") == "") | (F.col("document_b") == "") | (F.col("document_a") == F.col("document_b"))

    block, name = ["center", "age", "age_unit"], ["plain", "canon"]
    once = keyed.groupBy(*block, *name).agg(F.min("first").alias("low"), F.max("first").alias("high"))
    names_a, names_b = sides(once)
    same = lambda columns: [F.col(f"{c}_a") == F.col(f"{c}_b") for c in columns]
    follows = F.col("low_a") < F.col("high_b")
    compared_by = ["plain", "canon"] if lexicons else ["plain"]
    met = names_a.join(names_b, [*same([*block, "plain"]), follows])
    for text in compared_by:
        other = follows & (F.col("plain_a") != F.col("plain_b"))
        met = met.unionByName(similar_candidates(once, block, text, 0.92, other))
        if text != "plain":  # one canonical name of different ones
            met = met.unionByName(names_a.join(names_b, [*same([*block, text]), other]))
    met = met.dropDuplicates() if lexicons else met

    @F.pandas_udf("string")
    def compared(plain: pd.Series, canon: pd.Series, plain2: pd.Series, canon2: pd.Series) -> pd.Series:
        return pd.Series([name_reason(*names) for names in zip(plain, canon, plain2, canon2)], dtype=object)

    # not deterministic for the planner: else it would compare once for the filter and once for the column
    alike = met.select(*(f"{c}_a" for c in [*block, *name]), *(F.col(f"{c}_b").alias(f"{c}_other") for c in name), compared.asNondeterministic()("plain_a", "canon_a", "plain_b", "canon_b").alias("said")).where("said is not null")
    asked = a.join(alike, [f"{c}_a" for c in [*block, *name]])
    aged = asked.join(b, [*same(block), *(F.col(f"{c}_other") == F.col(f"{c}_b") for c in name), before, apart])
    differ = lambda c, by: (F.col(f"{c}_a") != "") & (F.col(f"{c}_b") != "") & (F.col(f"{by}_a") != F.col(f"{by}_b"))
    notes = [F.col("said"), F.lit("misma edad"), F.when(differ("sex", "sex"), "sexo diferente"), F.when(differ("origin", "place"), "procedencia diferente")]
    aged = aged.withColumn("reason", F.concat_ws(" | ", *notes))

    over_name = [*same(["center", "plain"]), before, apart]
    ageless = a.where("age_a is null").join(b, over_name).unionByName(a.where("age_a is not null").join(b.where("age_b is null"), over_name))
    ageless = ageless.withColumn("reason", F.lit("mismo nombre | edad incompleta"))
    out = [F.col("patient_id_a").alias("patient_id"), F.col("patient_id_b").alias("other_id"), "first_a", "first_b", "reason", *(f"{c}_{s}" for c in keep for s in "ab" if c != "first")]
    return aged.select(*out).unionByName(ageless.select(*out))


def mark_duplicates(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """people with status, details (in order of partners) and review of their pairs; the status replaces `merged`."""
    say = lambda other: F.concat(F.lit("Coincide con "), F.col(other), F.lit(" | "), F.col("reason"), F.lit(" | no fusionado"))
    # the order in which a scan over i < j meets them
    one = pairs.select("patient_id", F.col("first_a").alias("i"), F.col("first_b").alias("j"), say("other_id").alias("text"))
    two = pairs.select(F.col("other_id").alias("patient_id"), F.col("first_a").alias("i"), F.col("first_b").alias("j"), say("patient_id").alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "text"))), lambda x: x["text"])
    details = one.unionByName(two).groupBy("patient_id").agg(texts.alias("_found"))
    hit, note = F.col("_found").isNotNull(), F.array(F.lit("Posible duplicado no fusionado"))
    out = people.join(details, "patient_id", "left")
    both = F.array_distinct(F.concat(F.when(F.col("duplicate_detail") != "", F.array("duplicate_detail")).otherwise(F.array().cast("array<string>")), F.col("_found")))
    return out.withColumns({
        "duplicate_detail": F.when(hit, F.array_join(both, "; ")).otherwise(F.col("duplicate_detail")),
        "duplicate_status": F.when(hit, POSSIBLE).otherwise(F.col("duplicate_status")),
        "notes": F.when(hit, F.array_distinct(F.concat("notes", note))).otherwise(F.col("notes")),
        "needs_review": F.col("needs_review") | hit,
    }).drop("_found")


def exact_groups(records: DataFrame, center: str, document: str, confidence: str, order: str) -> DataFrame:
    """The fast path where every record has a document: a group is a document in a center, in one aggregation.

    Returns center, document, occurrences, first (smallest order), best (order of the surest record; ties: the first),
    confidence (largest).
    """
    best = F.max_by(F.col(order), F.struct(F.col(confidence), -F.col(order)))
    return records.groupBy(F.col(center).alias("center"), F.col(document).alias("document")).agg(F.count("*").alias("occurrences"), F.min(order).alias("first"), best.alias("best"), F.max(confidence).alias("confidence"))
