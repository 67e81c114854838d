"""Language ID by Bayesian evidence fusion.

Evidence: the text (byte trigrams, one multinomial a language, trained on a bounded labelled sample), the language the
markup or record declares, the address suffix, and the host. Declared languages, suffixes and hosts are priors
from counts over all rows: P(language | host) is smoothed towards the host's registered domain, that towards the
suffix, that towards the whole table; P(declared | language) is counted with its own smoothing. Counts are grouped
aggregations of small keys, never of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.kernels import arrow_rows, text_buffers
from folioflux.llm.shared import small_arrow_batches, written

BUCKETS = 1 << 14
#: Distinct labelled texts for training, the smallest hashes of each language: a documented bound.
SAMPLE = 500
#: A text's trigrams count as this many independent ones at most, so that other evidence keeps a say.
EVIDENCE = 40.0
PULL = 20.0
NONE = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the folded byte trigrams of each text (no runs of blanks), and their offsets."""
    b = _FOLD[data[at[0] : at[-1]]]
    up = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
    b[up] |= 0x20  # capitals of Latin-1
    n = len(b)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    code = ((b[:-2].astype(np.uint32) << 16 | b[1:-1].astype(np.uint32) << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(18)
    ok = ~((b[:-2] == 0x20) & (b[1:-1] == 0x20) | (b[1:-1] == 0x20) & (b[2:] == 0x20))
    ends = at[1:] - at[0]
    for back in (1, 2):  # no trigram across texts
        cut = ends - back
        cut = cut[(cut >= 0) & (cut < n - 2)]
        ok[cut] = False
    where = np.flatnonzero(ok)
    return code[where].astype(np.int64), np.searchsorted(where, at - at[0])


def _bucket_counts(batches):
    """lang, bucket, n over labelled texts."""
    total: dict[str, np.ndarray] = {}
    for part in (p for batch in batches for p in arrow_rows(batch)):
        langs = part.column(1).to_pylist()
        codes, ptr = trigrams(*text_buffers(part.column(0)))
        for k, lang in enumerate(langs):
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            total[lang] += np.bincount(codes[ptr[k] : ptr[k + 1]], minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


class Model:
    """Log2 probabilities of trigram buckets by language, and of a background that no language explains."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({c[0] for c in counts})
        n = np.zeros((len(self.langs), BUCKETS))
        for lang, bucket, k in counts:
            n[self.langs.index(lang), bucket] += k
        n += 0.05
        # a tenth of the background in each language: a key or address in a short text does not outweigh its words
        self.logs = np.ascontiguousarray(np.log2(0.9 * n / n.sum(1, keepdims=True) + 0.1 / BUCKETS), np.float32)
        self.background = np.float32(-np.log2(BUCKETS))

    def evidence(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Mean log2 likelihood of each text's trigrams by language (rows x languages), and the number of trigrams."""
        codes, ptr = trigrams(*text_buffers(column))
        counts, full = np.diff(ptr), np.flatnonzero(np.diff(ptr))
        out = np.zeros((len(counts), len(self.langs)))
        for k in range(len(self.langs)):
            if len(full):
                out[full, k] = np.add.reduceat(self.logs[k][codes].astype(np.float64), ptr[:-1][full]) / counts[full]
        return out, counts


def _smallest(batches, most: int):
    """The `most` smallest distinct hashes of each language among a task's rows (lang, h)."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        which, hashes = names.indices.to_numpy(), batch.column(1).to_numpy()
        for k, lang in enumerate(names.dictionary.to_pylist()):
            own = np.unique(hashes[which == k])[:most]
            held[lang] = np.union1d(held[lang], own)[:most] if lang in held else own
    for lang, hashes in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hashes), pa.string()), pa.array(hashes, pa.int64())], ["lang", "h"])


def training_hashes(rows: DataFrame, sample: int) -> DataFrame:
    """lang, h: the `sample` smallest distinct hashes of each language of rows (lang, h), or all it has.

    A task sends at most `sample` rows a language, so copies and very frequent languages cost no more than others; what
    many tasks send of one language is cut to `sample` in 64 shares before these meet.
    """
    own = rows.select("lang", "h").mapInArrow(lambda batches: _smallest(batches, sample), "lang string, h long").distinct()
    for share in (["lang", F.pmod(F.hash("h"), F.lit(64))], ["lang"]):
        own = own.withColumn("k", F.row_number().over(Window.partitionBy(*share).orderBy("h"))).where(F.col("k") <= sample).drop("k")
    return own


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the `sample` distinct texts of each labelled language that have the smallest hashes.

    However many rows a language has and however often its texts repeat, it is trained on `sample` distinct texts, or on
    all if it has fewer. Null and empty texts and rows without a language are left out; without rows the model knows no
    language.
    """
    small_arrow_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text <> '' and lang is not null").withColumn("h", F.xxhash64("text"))
    first = F.broadcast(written(training_hashes(rows, sample), "training"))  # `sample` rows of two values a language
    chosen = rows.join(first, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])  # of copies one
    counts = chosen.select("text", "lang").mapInArrow(_bucket_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counts.collect()])  # at most BUCKETS rows a language


def _towards(n, prior):
    """Counts smoothed with PULL rows of the level above."""
    return F.zip_with(n, prior, lambda a, b: (a + PULL * b) / (F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x) + PULL))


FIELDS = ("lang_id", "posterior", "text_lang", "rejected")


def free_names(wanted, taken) -> list[str]:
    """The wanted names, underscores added to those that are taken."""
    out: list[str] = []
    for name in wanted:
        while name in taken or name in out:
            name += "_"
        out.append(name)
    return out


def identify(rows: DataFrame, model: Model, text: str = "text", declared: str = "declared", host: str = "host", least: float = 0.5) -> DataFrame:
    """All columns of rows, and after them FIELDS: lang_id, posterior, text_lang, rejected.

    rows has a text, a declared language (null, or unknown to the model: no evidence) and a host (null: empty). A row
    is rejected where its text has no letters, where a background of equal trigrams explains it better than any
    language, or where no language reaches `least`; lang_id is then `und`. Null and empty texts are rejected. Repeated
    rows are judged alike; an empty table gives none. Where the input has a column of such a name, the new one gets an underscore more.
    """
    spark = rows.sparkSession
    small_arrow_batches(spark)
    langs = model.langs
    new = free_names(FIELDS, rows.columns)
    if not langs:
        return rows.select("*", *(v.alias(n) for n, v in zip(new, (F.lit(NONE), F.lit(0.0), F.lit(None).cast("string"), F.lit(True)))))
    _host, _prior_host, _prior = free_names(("_host", "_prior_host", "_prior"), rows.columns)
    shared = spark.sparkContext.broadcast(model)
    rows = rows.withColumn(_host, F.coalesce(F.col(host), F.lit("")))
    parts = F.split(_host, r"\.")
    keys = rows.select(_host, F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(parts, -1).alias("suffix"), F.lower(F.col(declared)).alias("declared"), F.col(text).alias("text"))

    def by_text(batches):
        for batch in batches:
            for part in arrow_rows(batch, column="text"):
                ev, counts = shared.value.evidence(part.column(4))
                best = ev.argmax(1)
                said = [langs[b] if c and ev[i, b] > shared.value.background else None for i, (b, c) in enumerate(zip(best, counts))]
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(4)), pa.array(said, pa.string())], ["host", "domain", "suffix", "declared", "said"])

    said = keys.mapInArrow(by_text, "host string, domain string, suffix string, declared string, said string")
    said = written(said.groupBy("host", "domain", "suffix", "declared", "said").count(), "said")
    flat = said.where("said is not null")
    # P(declared | said), each language's row smoothed by half a row a cell and a tenth of trust in agreement
    table = {(r["said"], r["declared"]): r["n"] for r in flat.where(F.col("declared").isin(langs)).groupBy("said", "declared").agg(F.sum("count").alias("n")).collect()}
    claims = np.array([[table.get((a, b), 0) + 0.5 + 5.0 * (a == b) for b in langs] for a in langs])
    claims = np.log2(claims / claims.sum(1, keepdims=True))
    weighted = flat.withColumn("n", F.col("count"))
    k = len(langs)
    base = weighted.groupBy("host", "domain", "suffix").agg(F.array(*(F.sum(F.when(F.col("said") == x, F.col("n")).otherwise(0)) for x in langs)).alias("n"))
    priors = written(_priors(written(base, "hosts"), k).toDF(_prior_host, _prior), "priors")
    rows = rows.join(F.broadcast(priors) if priors.count() <= 100_000 else priors, F.col(_host) == F.col(_prior_host), "left").drop(_prior_host, _host)
    names = rows.columns
    at, dec = names.index(text), names.index(declared)

    def judge(batches):
        m = shared.value
        for batch in batches:
            for part in arrow_rows(batch, column=text):
                ev, counts = m.evidence(part.column(at))
                score = ev * np.minimum(counts, EVIDENCE)[:, None]
                for i, d in enumerate(part.column(dec).to_pylist()):
                    if d is not None and d.lower() in langs:
                        score[i] += claims[:, langs.index(d.lower())]
                for i, p in enumerate(part.column(len(names) - 1).to_pylist()):
                    score[i] += np.log2(p) if p else 0.0
                odds = np.exp2(score - score.max(1, keepdims=True))
                odds /= odds.sum(1, keepdims=True)
                best = odds.argmax(1)
                top = odds[np.arange(len(best)), best]
                bad = (counts == 0) | (ev.max(1) <= m.background) | (top < least)
                out = [pa.array([NONE if r else langs[b] for r, b in zip(bad, best)]), pa.array(top), pa.array([langs[b] if c else None for b, c in zip(ev.argmax(1), counts)], pa.string()), pa.array(bad)]
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(names) - 1)), *out], [*names[:-1], *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", " + ", ".join(f"`{n}` {t}" for n, t in zip(new, ("string", "double", "string", "boolean")))
    return rows.mapInArrow(judge, schema)


def _priors(base: DataFrame, k: int) -> DataFrame:
    """host, prior (array by language): each level's counts smoothed towards the level above."""
    sums = F.array(*(F.sum(F.col("n")[i]) for i in range(k)))
    whole = [x or 0 for x in base.agg(sums.alias("n")).first()["n"]]
    top = F.array(*(F.lit((x + PULL / k) / (sum(whole) + PULL)) for x in whole))
    suffix = base.groupBy("suffix").agg(sums.alias("n")).select("suffix", _towards(F.col("n"), top).alias("ps"))
    domain = base.groupBy("domain", "suffix").agg(sums.alias("nd")).join(suffix, "suffix").select("domain", "suffix", _towards(F.col("nd"), F.col("ps")).alias("pd"))
    return base.join(domain, ["domain", "suffix"]).select("host", _towards(F.col("n"), F.col("pd")).alias("prior"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, host, declared and the visible text of raw pages; the suffix is the host's last label."""
    from folioflux.llm.url_filter import host_and_path

    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    return pages.select("page_id", host_and_path(F.col("url"))[0].alias("host"), declared.alias("declared"), F.regexp_replace(text, "&[a-zA-Z#0-9]+;", " ").alias("text"))


def languages_of_documents(docs: DataFrame) -> DataFrame:
    """All columns of documents plus posterior, text_lang, rejected and lang_id; lang is the declared language, source
    the host; trained on a bounded sample of the same rows."""
    return identify(docs, train(docs), "text", "lang", "source")
