"""URL filter: rules first, then a character language-model ratio, in DataFrame functions only.

Two smoothed variable-order Markov models (Witten-Bell over 0 to ORDER characters of context) are fitted to the URLs
that rules accept and reject. A URL's score is the difference of their log likelihoods over its length; the threshold
is calibrated on labelled URLs kept out of the fit: the point between the class means that is as many deviations from
one as from the other. Characters fold to an alphabet of 32, so there are at most 32^4 grams whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm.shared import written

#: Fixed rules: host, path prefix, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 3
ALPHABET = 32  # a-z, digits as 0, . / -, all else as *, and ^ before the start
CALIBRATION_FOLDS = 5


def host_and_path(url):
    """Lower-cased (A-Z) host after the first `://`, and path; both empty for null and for URLs without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(host, path, rules=None):
    """Struct rule, verdict of the longest rule that fits (null: none); a rule fits its host and all subdomains.

    rules: (host, path prefix, verdict); None stands for RULES, an empty list for no rules.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(RULES if rules is None else rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def folded(host, path):
    s = F.translate(F.concat(host, path), UPPER + "0123456789", LOWER + "0" * 10)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(s, "[^a-z0./-]", "*"))


def _grams(text):
    """All runs of ORDER + 1 characters; the characters stand in an array that is made once, so each run costs the same
    wherever it starts."""
    chars = F.transform(F.array(F.split(text, "")), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: F.concat(*(F.get(c, i + k) for k in range(ORDER + 1)))))
    return F.when(F.length(text) > ORDER, chars[0]).otherwise(F.array().cast("array<string>"))


def gram_ratios(labelled: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, ratio: log P(last character | the ones before) of the accepted model less that of the rejected one.

    labelled: s, accept (boolean); wanted: s. One row for each distinct gram of `wanted`.
    """
    counts = written(labelled.select("accept", F.explode(_grams(F.col("s"))).alias("gram")).groupBy("gram").agg(F.count_if("accept").alias("a"), F.count_if(~F.col("accept")).alias("r")), "url-counts")
    out = wanted.select(F.explode(_grams(F.col("s"))).alias("gram")).distinct()
    p = {"a": F.lit(1.0 / ALPHABET), "r": F.lit(1.0 / ALPHABET)}
    for k in range(ORDER + 1):
        tail = lambda c: F.substring(c, ORDER + 1 - k, k + 1)  # noqa: E731,B023
        own = counts.groupBy(tail(F.col("gram")).alias(f"g{k}")).agg(F.sum("a").alias(f"a{k}"), F.sum("r").alias(f"r{k}"))
        context = own.groupBy(F.substring(f"g{k}", 1, k).alias(f"c{k}")).agg(*(x for c in "ar" for x in (F.sum(f"{c}{k}").alias(f"{c}n{k}"), F.count_if(F.col(f"{c}{k}") > 0).alias(f"{c}t{k}"))))
        out = out.withColumn(f"g{k}", tail(F.col("gram"))).withColumn(f"c{k}", F.substring(f"g{k}", 1, k)).join(own, f"g{k}", "left").join(context, f"c{k}", "left")
        for c in "ar":
            n, total, kinds = (F.coalesce(F.col(x), F.lit(0)).cast("double") for x in (f"{c}{k}", f"{c}n{k}", f"{c}t{k}"))
            name = f"p{c}{k}"
            out = out.withColumn(name, F.when(total > 0, (n + kinds * p[c]) / (total + kinds)).otherwise(p[c]))
            p[c] = F.col(name)
    return out.select("gram", (F.log(p["a"]) - F.log(p["r"])).alias("ratio"))


def judge_urls(pages: DataFrame, rules=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule (null: none fits), verdict (allow or block), score, threshold.

    Null URLs and URLs without `://` have an empty host and path and, like any URL where a model has nothing to say, a
    score of 0. If rules label no URL, or only one kind, the threshold is 0 and a score of at least the threshold is
    allowed. Repeated rows get a row each; equal URLs are scored once; an empty table gives none; other columns are
    not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("by", by_rules(F.col("host"), F.col("path"), rules)).withColumn("s", folded(F.col("host"), F.col("path")))
    texts = written(rows.groupBy("s").agg(F.count_if(F.col("by.verdict") == "allow").alias("a"), F.count_if(F.col("by.verdict") == "block").alias("r")).withColumn("fold", F.pmod(F.xxhash64("s"), F.lit(CALIBRATION_FOLDS))), "urls")
    label = texts.where("a + r > 0").select("s", (F.col("a") >= F.col("r")).alias("accept"), "fold")
    ratios = written(gram_ratios(label.where("fold > 0"), texts), "url-ratios")
    scored = texts.select("s", F.explode(_grams(F.col("s"))).alias("gram")).join(F.broadcast(ratios), "gram").groupBy("s").agg(F.avg("ratio").alias("score"))
    scored = written(texts.join(scored, "s", "left").select("s", F.coalesce("score", F.lit(0.0)).alias("score"), "a", "r", "fold"), "url-scores")
    held = scored.where("fold = 0 and a + r > 0").groupBy((F.col("a") >= F.col("r")).alias("accept")).agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("d")).collect()
    side = {r["accept"]: (r["m"], r["d"] + 1e-6) for r in held}
    threshold = 0.0
    if len(side) == 2:
        (ma, da), (mr, dr) = side[True], side[False]
        threshold = (ma * dr + mr * da) / (da + dr)
    out = rows.join(scored.select("s", "score"), "s", "left").withColumn("threshold", F.lit(threshold))
    by_model = F.when(F.coalesce("score", F.lit(0.0)) >= F.col("threshold"), "allow").otherwise("block")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", by_model).alias("verdict"), "score", "threshold")
