"""One query for each operator of this subpackage, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.containment import find_contained

    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.token_records import read_records, write_records

    manifest = write_records(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0)
    return read_records(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.transducer import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.suffix_tree import score

    return score(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.top_k import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.language_id import identify, page_evidence, train

    model = train(table(spark, sf_dir, "documents"))
    found = identify(page_evidence(table(spark, sf_dir, "pages")), model)
    return found.select("page_id", "host", "declared", "text_lang", F.col("lang_id").alias("lang"), "posterior", "rejected")


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.lsh_forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.secret_scan import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.spelling import group_variants

    return group_variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflux.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_token_records, op3_transducer_bpe, op4_suffix_tree, op5_license_scan, op6_exact_top_k, op7_url_filter, op8_token_counts, op9_language_id, op10_lsh_forest, op11_secret_scan, op12_spelling_variants, op13_filter_audit)
}
_SHINGLES = """
    select id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                           when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
    from (select id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {})
"""


def _license_sql() -> str:
    from folioflux.llm.license_scan import BASE, MORE, WORD

    place = lambda p: f"case when contains(s, ' {p} ') then list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()!r}) else [] end"
    names = [f"t{k}" for k in range(len(BASE) + len(MORE))]
    labels = [label for _, label in BASE + MORE]
    joined = lambda k: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"case when len(t{i}) > 0 then '{labels[i]}' end" for i in range(k)) + "], lambda x: x is not null))), ',')"
    first = "flatten([" + ", ".join(names[: len(BASE)]) + "])"
    return f"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
             s as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as s from d),
             p as (select doc_id, len(w) as n, {", ".join(f"{place(p)} as {n}" for n, (p, _) in zip(names, BASE + MORE))} from s)
        select doc_id, n::bigint as n_words, len({first})::bigint as n_base, list_min({first})::bigint as first_word, list_max({first})::bigint as last_word,
               {joined(len(BASE))} as base_labels, {joined(len(names))} as labels, 1 - pow(0.5, {" + ".join(f"len({n})" for n in names)}) as score
        from p
    """


#: The table of CRC-32 as a list of 256, and the CRC-32 of a list of bytes {} by it
_CRC_TABLE = "list_transform(range(0, 256), lambda n: list_reduce([n] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
_CRC = "xor(4294967295, list_reduce([4294967295::bigint] || {}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"


def _secret_sql() -> str:
    """Matches are marked in the text by two private characters; a match starts after the text of the pieces before it."""
    word = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    assign = f"""({word})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    body = lambda m: f"substr({m}, instr({m}, '_') + 1)"
    numbers = lambda x, of: f"list_transform(range(1, len({x}) + 1), lambda i: ({of.format(f'substr({x}, i::int, 1)')})::bigint)"
    sixty_two = "instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', {}) - 1"
    crc = f"{_CRC.format(numbers(f'left({body("m")}, 30)', 'ascii({})'))} = list_reduce([0::bigint] || {numbers(f'right({body("m")}, 6)', sixty_two)}, lambda x, y: 62 * x + y)"
    age = numbers("right(m, 58)", "instr('QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L', {}) - 1")
    prefix = [ord(c) for c in "age-secret-key-"]
    steps = "xor(" * 5 + "xor((c & 33554431) << 5, v)" + "".join(f", case when (c >> 25) & {1 << k} <> 0 then {g} else 0 end)" for k, g in enumerate((996825010, 642813549, 513874426, 1027748829, 705979059)))
    bech = f"list_reduce([1::bigint] || {[c >> 5 for c in prefix] + [0] + [c & 31 for c in prefix]}::bigint[] || {age}, lambda c, v: {steps}) = 1"
    kinds = [
        ("assign", assign, f"len(regexp_extract(m, '{assign}', 2)) >= 6"),
        ("access", "AKIA[A-Z0-9]+", "len(m) >= 20"),
        ("hex", "[0-9a-f]{24,}", "true"),
        ("forge", "gh[pousr]_[A-Za-z0-9]{36}\\b", crc),
        ("registry", "npm_[A-Za-z0-9]{36}\\b", crc),
        ("age", "AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}\\b", bech),
    ]
    marked = " union all ".join(f"select n, {k} as kind, string_split(regexp_replace(t, '{p}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) as p from d" for k, (_, p, _) in enumerate(kinds))
    start = "list_sum(list_transform(p[:i], lambda x: len(replace(x, chr(57345), ''))))::bigint"
    holds = "case kind " + " ".join(f"when {k} then {test}" for k, (_, _, test) in enumerate(kinds)) + " end"
    name = "case kind " + " ".join(f"when {k} then '{x}'" for k, (x, _, _) in enumerate(kinds)) + " end"
    listed = lambda which: f"coalesce(string_agg(span, ',' order by s, kind) {which}, '')"
    counted = lambda k: f"(count(*) filter (kind = {k}))::bigint as n_{kinds[k][0]}"
    return f"""
        with d as (select row_number() over () as n, doc_id, coalesce(text, '') as t from documents),
             p as ({marked}),
             i as (select n, kind, p, unnest(range(1, len(p))) as i from p where len(p) > 1),
             m as (select n, kind, split_part(p[i + 1], chr(57345), 1) as m, {start} as s, {_CRC_TABLE} as crc_table from i),
             h as (select n, kind, s, {name} || ':' || s || ':' || (s + len(m)) as span from m where {holds}),
             g as (select n, {", ".join(map(counted, range(3)))}, {listed("filter (kind < 3)")} as base, {listed("")} as spans from h group by n)
        select doc_id, {", ".join(f"coalesce(n_{x}, 0)::bigint as n_{x}" for x, _, _ in kinds[:3])}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join g using (n)
    """


ORACLES: dict[str, str] = {
    "op5_license_scan": _license_sql(),
    "op1_decontamination": f"""
        with d as (select distinct id, s from ({_SHINGLES.format("(select doc_id as id, text from documents)")})),
             b as (select distinct id, s from ({_SHINGLES.format("(select item_id as id, text from benchmark)")})),
             n as (select id, count(*) as n_item from b group by id),
             m as (select d.id as doc_id, b.id as item_id, count(*) as n_matched from d join b using (s) group by all)
        select doc_id, item_id, n_matched, n_item, n_matched::double / n_item as containment
        from m join n on n.id = m.item_id where 100 * n_matched >= 75 * n_item
    """,
    "op6_exact_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
                   where vec_id is not null and embedding is not null
                     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score
                   from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
        select query_id, rank::int as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
    """,
    "op10_lsh_forest": f"""
        with recursive s as (select distinct id, s from ({_SHINGLES.format("(select doc_id as id, text from documents)")})),
             n as (select id, count(*) as n from s group by id),
             p as (select a.id as a, b.id as b, count(*) as shared from s a join s b on a.s = b.s and a.id < b.id group by all),
             l as (select a, b from p join n x on x.id = a join n y on y.id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
             e as (select a as x, b as y from l union all select b, a from l),
             r(id, c) as (select distinct doc_id, doc_id from documents union select r.id, e.y from r join e on r.c = e.x),
             m as (select id, min(c) as c from r group by id)
        select doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, doc_id = m.c as kept
        from documents join m on m.id = doc_id left join n on n.id = doc_id
    """,
    "op11_secret_scan": _secret_sql(),
    "op12_spelling_variants": f"""
        with recursive r as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
             c as (select id, run, count(*) as n, list_transform(range(1, len(id) + len(run) + 2), lambda i: unicode(substr(id || ':' || run, i::int, 1))) as points, {_CRC_TABLE} as crc_table
                   from r where len(run) >= 6 group by id, run),
             h as (select run, n, {_CRC.format("flatten(list_transform(points, lambda p: case when p < 128 then [p::bigint] else [195::bigint, p::bigint - 64] end))")} as h from c),
             o as (select case when h % 199 = 0 then left(run, (h % len(run))::int) || substr(run, (h % len(run))::int + 2) else run end as word, n from h),
             w as (select word, sum(n)::bigint as n from o where len(word) >= 6 group by word having sum(n) >= 5),
             x as (select word, n, i, left(word, i::int - 1) || substr(word, i::int + 1) as less from (select word, n, unnest(range(1, len(word) + 1)) as i from w)),
             p as (select distinct a.word, b.word as near, b.n from x a join x b on a.i = b.i and a.less = b.less and a.word <> b.word and len(a.word) = len(b.word)
                   union select a.word, b.word, b.n from x a join w b on a.less = b.word union select b.word, a.word, a.n from x a join w b on a.less = b.word),
             k as (select *, row_number() over (partition by word order by n desc, near) as k, count(*) over (partition by word) as n_near from p),
             f as (select w.word, w.n, coalesce(k.n_near, 0)::bigint as n_near, case when k.n >= 5 * w.n then k.near end as form, case when k.n >= 5 * w.n then k.n end as form_n
                   from w left join k on k.word = w.word and k.k = 1),
             l(word, root) as (select word, form from f where form is not null union select l.word, f.form from l join f on f.word = l.root where f.form is not null),
             e as (select l.word, l.root from l join f on f.word = l.root where f.form is null)
        select f.word, f.form, coalesce(e.root, f.word) as root, f.n, f.n_near, f.form_n from f left join e on e.word = f.word
    """,
    "op13_filter_audit": """
        with l as (select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
             d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
             w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by t) as first_id from d),
             f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
                          100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) as c, regexp_matches(t, '[#$%&*|]') as d, coalesce(w.doc_id > first_id, false) as e
                   from w left join l on l.doc_id = w.doc_id),
             m as (select part, good, toxic, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n from f group by all),
             x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
             o as (select p.x || q.x || r.x || s.x || t.x as filter_order from x p, x q, x r, x s, x t
                   where p.x not in (q.x, r.x, s.x, t.x) and q.x not in (r.x, s.x, t.x) and r.x not in (s.x, t.x) and s.x <> t.x),
             g as (select *, (1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1))::int as bit,
                          list_sum([0] || list_transform(range(1, step), lambda i: (1 << (instr('ABCDE', substr(filter_order, i::int, 1)) - 1))::int))::int as before
                   from (select filter_order, unnest([1, 2, 3, 4, 5]) as step from o)),
             r as (select part, filter_order, step, bit,
                          sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
                          sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as removed,
                          sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
                          sum(case when mask = bit then n else 0 end) as unique_fails,
                          sum(case when good and mask & before = 0 and mask & bit <> 0 then n else 0 end) as good_lost,
                          sum(case when toxic and mask & before = 0 and mask & bit <> 0 then n else 0 end) as toxic_lost
                   from m, g group by all)
        select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
               good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
        from r
    """,
}
