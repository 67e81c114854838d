"""The operators applied to the driver's tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflux.functions import text as T
from folioflux.operators import evaluate as E
from folioflux.operators import layout as L
from folioflux.operators import matching as M
from folioflux.operators import names as N
from folioflux.operators import resolve as R
from folioflux.operators import select as S
from folioflux.operators.alias_index import match_catalog
from folioflux.operators.lines import UNIT, directions, hough_lines, hough_votes
from folioflux.operators.word_automaton import alias_spans

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NORM = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
#: A total order of lineitem's rows (rows equal in all columns are interchangeable)
LINE_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE = ", ".join(LINE_KEYS)


# ---------------------------------------------------------------- text and fields


@query(f"select doc_id, {_NORM.format('text')} as normal from documents")
def q_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normal"))


_EDGE = r"[\s•·.,;:()\-–—]+"


@query(f"select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(translate(text, '|_', '  '), '^{_EDGE}', ''), '{_EDGE}$', ''), '\\s+', ' ', 'g')) as shown from conversations")
def q_display_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_display(F.col("text")).alias("shown"))


@query(r"""
    with w as (select item_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from benchmark),
         r as (select item_id, unnest(range(1, len(w) - 1)) as i, w from w)
    select item_id, array_to_string(w[i:i + 2], ' ') as run, count(*) as n from r group by all
""")
def q_word_windows(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.word_windows(F.col("text"), 3)).alias("run")).groupBy("item_id", "run").agg(F.count("*").alias("n"))


@query(r"""
    with d as (select c_custkey as k, regexp_extract(c_name, '(^|[^0-9])([0-9]{6,11})([^0-9]|$)', 2) as doc from customer),
         s as (select k, doc, len(doc) as n from d where doc <> '')
    select k, doc as found,
           case when n between 6 and 9 then doc
                when n in (10, 11) and n - 2 between 6 and 9 and right(doc, 2)::int <= 115 then left(doc, n - 2)
                when n in (10, 11) and n - 1 between 6 and 9 and right(doc, 1)::int <= 115 then left(doc, n - 1)
                when n in (10, 11) and n - 3 between 6 and 9 and right(doc, 3)::int <= 115 then left(doc, n - 3) else '' end as document,
           case when n between 6 and 9 then null
                when n in (10, 11) and n - 2 between 6 and 9 and right(doc, 2)::int <= 115 then right(doc, 2)::int
                when n in (10, 11) and n - 1 between 6 and 9 and right(doc, 1)::int <= 115 then right(doc, 1)::int
                when n in (10, 11) and n - 3 between 6 and 9 and right(doc, 3)::int <= 115 then right(doc, 3)::int end as age
    from s
""")
def q_documents_digits(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(T.table_documents(F.col("c_name"))).alias("found"))
    return rows.withColumn("p", T.split_document_age(F.col("found"))).select("k", "found", "p.document", "p.age")


@query(r"""
    with s as (select p_partkey as k, translate(regexp_replace(upper(regexp_replace(case when p_partkey % 3 = 0 then 'E ' when p_partkey % 3 = 1 then 'c' else '' end || replace(p_size::varchar, '1', 'I'), '[^A-Za-z0-9]', '', 'g')), '^[CE]', ''), 'OQILBS', '001135') as s from part)
    select k, case when regexp_matches(s, '^[0-9]{1,3}$') and s::int <= 40 then s::int end as n from s
""")
def q_ocr_number(spark, sf_dir):
    cell = F.concat(F.when(F.col("p_partkey") % 3 == 0, "E ").when(F.col("p_partkey") % 3 == 1, "c").otherwise(""), F.replace(F.col("p_size").cast("string"), F.lit("1"), F.lit("I")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.ocr_number(cell, 40).alias("n"))


_META = r"(?i)\b\d{1,2}\s*[-/.]\s*\d{1,2}\s*[-/.]\s*\d{2,4}\b|\b\d{1,2}\s*[:.]\s*\d{2}\s*(?:[ap]\.?\s*m\.?)?\b"


@query(rf"""
    select doc_id, i::int as line_no from (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(0, len(string_split(text, chr(10))))) as i from documents)
    where regexp_matches(t, '{_META}') or regexp_matches({_NORM.format('t')}, '^[0-9]{{1,2}}(ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)|^(lista|actualizada|hora|hospital) ')
""")
def q_metadata_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    return lines.where(T.is_metadata(F.col("t"))).select("doc_id", "line_no")


@query(r"""
    with s as (select p_partkey, regexp_replace(regexp_replace(strip_accents(p_name || ' (é) / ' || p_brand || '__'), '[^A-Za-z0-9_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') as s from part)
    select p_partkey, case when len(s) > 0 then s[1:60] else 'imagen' end as stem from s
""")
def q_safe_stem(spark, sf_dir):
    name = F.concat("p_name", F.lit(" (é) / "), "p_brand", F.lit("__"))
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_stem(name).alias("stem"))


@query(f"""
    select c_custkey, regexp_replace(trim(c_name), '[^0-9]', '', 'g') as cedula, coalesce(trunc(try_cast(trim(a) as double))::bigint::varchar, {_NORM.format('trim(a)')}) as edad,
           upper(trim(left(c_mktsegment, 1) || ' ')) as sexo, {_NORM.format('trim(c_mktsegment)')} as area
    from (select *, case when c_custkey % 4 = 0 then ' ' || (c_custkey % 90)::varchar || '.0 ' when c_custkey % 4 = 1 then 'Ocho' when c_custkey % 4 = 2 then '' else (c_custkey % 90)::varchar end as a from customer)
""")
def q_evaluation_values(spark, sf_dir):
    k = F.col("c_custkey")
    n = (k % 90).cast("string")
    age = F.when(k % 4 == 0, F.concat(F.lit(" "), n, F.lit(".0 "))).when(k % 4 == 1, "Ocho").when(k % 4 == 2, "").otherwise(n)
    made = {"cedula": F.col("c_name"), "edad": age, "sexo": F.concat(F.left("c_mktsegment", F.lit(1)), F.lit(" ")), "area": F.col("c_mktsegment")}
    return table(spark, sf_dir, "customer").select(k, *(T.evaluation_value(f, c).alias(f) for f, c in made.items()))


@query("""
    with u as (select event_id, ['años', 'Meses', 'día', 'e', 'a', ''][event_id % 6 + 1] as u from events)
    select event_id, case when lower(u) like 'mes%' then 'meses' when u like 'día%' then 'días' else 'años' end as unit, u = 'e' as uncertain from u
""")
def q_age_unit(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ["años", "Meses", "día", "e", "a", ""])), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.age_unit(unit).alias("u")).select("event_id", "u.unit", "u.uncertain")


# ---------------------------------------------------------------- dictionaries and names


@query(f"""
    with t as (select {_NORM.format('unnest(string_split(p_name, chr(32)))')} as term, greatest(0, least(1, p_retailprice / 1500 - 0.2)) as w from part)
    select term, round(max(w), 6) as weight, count(*) as n from t where term <> '' group by term
""")
def q_merged_lexicon(spark, sf_dir):
    """Weights clamped to 0 to 1, the largest of a normalised term."""
    terms = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("t"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p_retailprice") / 1500 - 0.2)).alias("w"))
    return terms.select(T.normalize(F.col("t")).alias("term"), "w").where("term <> ''").groupBy("term").agg(F.round(F.max("w"), 6).alias("weight"), F.count("*").alias("n"))


@query(f"""
    with a as (select item_id, array_to_string(string_split({_NORM.format('text')}, ' ')[1:6], ' ') as alias from benchmark)
    select d.doc_id, arg_max(a.alias, (len(replace(a.alias, ' ', '')), -a.item_id)) as alias, count(*) as hits
    from documents d join a on contains(' ' || {_NORM.format('d.text')} || ' ', ' ' || a.alias || ' ') and len(a.alias) > 0 group by d.doc_id
""")
def q_catalog_strong(spark, sf_dir):
    """Benchmark openings of six words as aliases; an automaton finds those that stand in each document."""
    aliases = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(T.words(T.normalize(F.col("text"))), 1, 6), " ").alias("alias")).where("alias <> ''")
    docs = table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("t"))
    hits = M.strong_matches(docs, aliases, "t")
    best = F.max_by("alias", F.struct(F.length(T.compact(F.col("alias"))), -F.col("item_id")))
    return hits.groupBy("doc_id").agg(best.alias("alias"), F.count("*").alias("hits"))


@query("""
    with v as (select distinct unnest(string_split(lower(p_name), ' ')) as alias from part),
         w as (select p_partkey, unnest(string_split(lower(p_name), ' ')) as alias, unnest(range(0, len(string_split(p_name, ' ')))) as i from part)
    select p_partkey, string_agg(alias, ' > ' order by i) as places, count(*) as n from (select p_partkey, alias, min(i) as i from w join v using (alias) group by all) group by p_partkey
""")
def q_multi_match(spark, sf_dir):
    """The vocabulary of part names as a catalog; each name's places in text order."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("text"))
    words = [r[0] for r in part.select(F.explode(F.split("text", " ")).alias("w")).distinct().collect()]  # the table has few
    found = M.match_places(part, "text", [M.Alias(w, w) for w in words])
    return found.select("p_partkey", F.array_join("places", " > ").alias("places"), F.size("places").cast("long").alias("n"))


_COLOURS = ["almond", "antiqe", "azur", "beig", "bisqe", "blackk", "blu", "blushh", "bronw", "chartreus"]


@query()
def q_catalog_fuzzy(spark, sf_dir):
    """Part names against misspelt aliases, with the margin over the second."""
    return M.match_column(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "place", [M.Alias(a, a.upper()) for a in _COLOURS], contextual=True).select("p_partkey", F.col("match.name").alias("place"), F.round("match.score", 6).alias("score"))


def _openings(docs):
    """Catalog of the first three words of all documents, and these with a letter left out of each as texts."""
    opening = docs.select("doc_id", F.array_join(T.first_words(F.col("text"), 3), " ").alias("alias")).where("alias <> ''")
    at = (F.col("doc_id") % F.length("alias")).cast("int")
    texts = opening.select("doc_id", F.concat(F.substring("alias", F.lit(1), at), F.substring("alias", at + 2, F.length("alias"))).alias("text"))
    return opening.select("alias", F.col("alias").alias("name")), texts


@query()
def q_catalog_index(spark, sf_dir):
    """Misspelt openings of all documents against the openings themselves, a catalog that grows with the table."""
    catalog, texts = _openings(table(spark, sf_dir, "documents"))
    return match_catalog(texts, "text", catalog, contextual=True).select("doc_id", "text", "match.name", "match.score", "match.contextual")


@query(f"""
    with recursive d as (select doc_id, list_filter(string_split({_NORM.format('text')}, ' '), lambda x: x <> '') as w from documents),
         a as (select distinct array_to_string(w[1:1 + doc_id % 3], ' ') as alias from d where len(w) > 0),
         k as (select alias, string_split(alias, ' ')[1] as head, len(string_split(alias, ' ')) as n from a),
         h as (select doc_id, w, unnest(range(0, len(w))) as i from d),
         m as (select doc_id, i as s, max(i + n) as e from h join k on k.head = h.w[i + 1] and array_to_string(h.w[i + 1:i + k.n], ' ') = k.alias group by doc_id, i),
         p as (select doc_id, s, e, row_number() over (partition by doc_id order by s) as k from m),
         j as (select x.doc_id, x.k, x.s, x.e, min(y.k) as nx from p x left join p y on y.doc_id = x.doc_id and y.s >= x.e group by all),
         r as (select doc_id, k, s, e, nx from j where k = 1 union all select j.doc_id, j.k, j.s, j.e, j.nx from r join j on j.doc_id = r.doc_id and j.k = r.nx)
    select doc_id, count(*) as n_spans, min(s)::int as first_start, max(e)::int as last_end, sum(e - s)::bigint as n_words from r group by doc_id
""")
def q_alias_spans(spark, sf_dir):
    """Openings of one to three words of all documents as aliases; each document's leftmost-longest spans of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("t"))
    opening = table(spark, sf_dir, "documents").select("doc_id", T.first_words(F.col("text"), 3).alias("w"))
    aliases = opening.where("size(w) > 0").select(F.array_join(F.slice("w", F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), " ").alias("alias"))
    spans = alias_spans(docs, ["doc_id"], "t", aliases)
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return spans.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.get("spans", F.lit(0))["start"].alias("first_start"), F.element_at("spans", -1)["end"].alias("last_end"), words.alias("n_words"))


LEXICONS = N.Lexicons({"supplier": 0.9, "maria": 1.0, "customer": 0.6}, {"customer": 0.9, "perez": 1.0, "de": 0.5})


@query()
def q_split_name(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.concat(F.regexp_replace("s_name", "[^A-Za-z]", ""), F.when(F.col("s_suppkey") % 2 == 0, " Perez").otherwise(" de la Customer")).alias("full_name"), "s_suppkey")
    return N.split_names(names, "full_name", LEXICONS).select("s_suppkey", "full_name", "split.first_name", "split.last_name", "split.confidence", "split.detected_order", "split.reliable")


# ---------------------------------------------------------------- sources and sampling

_HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"


def _centers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("slug"))
    catalog = pages.groupBy("slug").agg(F.count("*").alias("n")).where("n >= 2").select("slug", F.upper("slug").alias("center"))
    return pages, catalog


_CENTERS = f"with p as (select page_id, {_HOST} as slug from pages), c as (select slug, upper(slug) as center from p group by slug having count(*) >= 2) "


@query(_CENTERS + "select slug, page_id, center from p join c using (slug)")
def q_center_join(spark, sf_dir):
    return S.mapped(*_centers(spark, sf_dir), "slug")


@query(_CENTERS + "select slug, page_id from p anti join c using (slug)")
def q_unmapped(spark, sf_dir):
    return S.unmapped(*_centers(spark, sf_dir), "slug")


@query("""
    with o as (select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as ordinal, count(*) over () as n from orders),
         k as (select distinct round_even(i * (n - 1)::double / 99, 0)::bigint as ordinal from (select distinct n from o), range(0, 100) r(i))
    select o_orderkey, ordinal from o semi join k using (ordinal)
""")
def q_even_sample(spark, sf_dir):
    rows = S.with_ordinal(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
    wanted = S.even_ordinals(spark, rows.count(), 100)
    return rows.join(wanted, "ordinal", "left_semi").select("o_orderkey", "ordinal")


# ---------------------------------------------------------------- space and order

_BOUNDS = [0.0, 20000.0, 40000.0, 60000.0, 80000.0]


@query("""
    with b as (select [0.0, 20000.0, 40000.0, 60000.0, 80000.0] as b), l as (select *, l_extendedprice as x, l_extendedprice + 400 * l_quantity as x2 from lineitem, b)
    select l_orderkey, l_linenumber, l_extendedprice as x, l_quantity as q, l_partkey,
           case when x >= 0 and x < 80000 then floor(x / 20000)::int end as point_cell,
           case when list_max(list_transform(range(0, 4), lambda i: least(x2, b[i + 2]) - greatest(x, b[i + 1]))) > 0
                then list_position(list_transform(range(0, 4), lambda i: least(x2, b[i + 2]) - greatest(x, b[i + 1])), list_max(list_transform(range(0, 4), lambda i: least(x2, b[i + 2]) - greatest(x, b[i + 1]))))::int - 1 end as span_cell
    from l
""")
def q_cell_assign(spark, sf_dir):
    bounds, x = F.array(*map(F.lit, _BOUNDS)), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), F.col("l_quantity").alias("q"), "l_partkey", L.cell_of_point(bounds, x).alias("point_cell"), L.cell_of_span(bounds, x, x + 400 * F.col("l_quantity")).alias("span_cell"))


@query("""
    with a as (select event_id as anchor_id, user_id, value as y from events where event_type = 'purchase'),
         b as (select *, (lag(y) over w + y) / 2 as lower, (lead(y) over w + y) / 2 as upper from a window w as (partition by user_id order by y, anchor_id))
    select e.event_id, b.anchor_id from events e join b on e.user_id = b.user_id and (lower is null or e.value > lower) and (upper is null or e.value <= upper)
    where e.event_type <> 'purchase'
""")
def q_row_bands(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    anchors = events.where("event_type = 'purchase'").select(F.col("event_id").alias("anchor_id"), "user_id", F.col("value").alias("y"))
    bands = L.row_bands(anchors, "user_id", "y", "anchor_id")
    lines = events.where("event_type <> 'purchase'").select("event_id", "user_id", F.col("value").alias("line_y"))
    return L.assign_to_bands(lines, bands, "user_id", "line_y").select("event_id", "anchor_id")


@query("""
    select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as heading from events
""")
def q_heading_asof(spark, sf_dir):
    heading = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return L.last_heading(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], heading).select("event_id", "heading")


@query("""
    select l_returnflag as page, case when l_quantity < e then 'few' when l_quantity < 30 then 'some' else 'many' end as name, count(*) as n, round(sum(l_extendedprice), 2) as total
    from (select *, case l_returnflag when 'A' then 10 when 'N' then 15 else 20 end as e from lineitem) where l_quantity >= 0 and l_returnflag in ('A', 'N', 'R') group by all
""")
def q_column_interval(spark, sf_dir):
    """Return flags as pages, each with columns of its own."""
    own = [(p, n, x, y) for p, e in (("A", 10.0), ("N", 15.0), ("R", 20.0)) for n, x, y in (("few", 0.0, e), ("some", e, 30.0), ("many", 30.0, 1e9))]
    columns = spark.createDataFrame(own, "page string, name string, start double, end double")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("page"), "l_quantity", "l_extendedprice")
    return L.column_of(rows, columns, "page", "l_quantity").groupBy("page", "name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
    with p as (select distinct user_id from events where event_type = 'purchase')
    select event_type, round(avg((p.user_id is not null)::int), 6) as coverage, count(distinct e.user_id) as users from events e left join p using (user_id) group by event_type
""")
def q_coverage(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    covered = events.where("event_type = 'purchase'").select("user_id").distinct().withColumn("hit", F.lit(1))
    return events.join(covered, "user_id", "left").groupBy("event_type").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("coverage"), F.count_distinct("user_id").alias("users"))


@query("""
    with g as (select *, coalesce(epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) > 86400, false)::int as starts from events),
         c as (select *, sum(starts) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as cluster from g)
    select user_id, cluster::bigint as cluster, count(*) as n, min(event_id) as first_id from c group by all
""")
def q_gap_clusters(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    rows = L.gap_clusters(events, "user_id", ["ts", "event_id"], "at", F.lit(86400.0))
    return rows.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
    with m as (select l_orderkey, median(l_quantity) as m from lineitem group by 1)
    select l_orderkey, round(avg((abs(l_quantity - m) <= 8)::int), 6) as ratio, count(*) as n from lineitem join m using (l_orderkey) group by 1
""")
def q_alignment_ratio(spark, sf_dir):
    rows = L.dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey")
    center = rows.groupBy("l_orderkey").agg(F.median("l_quantity").alias("m"))
    return rows.join(center, "l_orderkey").groupBy("l_orderkey").agg(F.round(L.alignment_ratio("l_quantity", "m", 8.0), 6).alias("ratio"), F.count("*").alias("n"))


@query("""
    with d as (select distinct user_id, value from events), g as (select *, value - lag(value) over (partition by user_id order by value) as gap from d),
         t as (select user_id, median(gap) as t from g group by 1 having count(*) >= 4)
    select user_id, round(avg((abs(gap - t) <= greatest(4, 0.35 * t) or abs(gap - 2 * t) <= 1.5 * greatest(4, 0.35 * t))::int), 6) as ratio from g join t using (user_id) where gap is not null group by 1
""")
def q_regular_rows(spark, sf_dir):
    return L.regular_gaps(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", F.round("ratio", 6).alias("ratio"))


@query("""
    with s as (select o_custkey, o_orderkey - lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as d from orders)
    select o_custkey, round(avg((d = 1)::int), 6) as ratio, count(*) as steps from s where d is not null group by 1
""")
def q_seq_ratio(spark, sf_dir):
    return L.consecutive_ratio(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], "o_orderkey").select("o_custkey", F.round("ratio", 6).alias("ratio"), "steps")


@query("""
    with b as (select l_orderkey, floor(l_extendedprice / 4000)::int as bin, count(*) as n from lineitem group by all), t as (select l_orderkey, sum(n) as n from b group by 1)
    select b.l_orderkey, bin, b.n from b join t using (l_orderkey) where b.n >= greatest(2, round_even(0.3 * t.n, 0))
""")
def q_aux_bins(spark, sf_dir):
    bins = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.floor(F.col("l_extendedprice") / 4000).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("l_orderkey")
    return bins.withColumn("all", F.sum("n").over(w)).where(F.col("n") >= F.greatest(F.lit(2.0), F.bround(0.3 * F.col("all")))).select("l_orderkey", "bin", "n")


@query("""
    with m as (select l_orderkey, median(l_quantity) as m from lineitem group by 1),
         f as (select l_orderkey, count(*) as n, avg((abs(l_quantity - m) <= 8)::int) as aligned, round(avg(l_discount) * 10, 9) as grid, avg((l_tax > 0.02)::int) as regular,
                      count(*) filter (l_linenumber > 2) as idx, count(*) filter (l_returnflag = 'R') as sexes, count(*) filter (l_linestatus = 'O') as docs, count(distinct l_suppkey) > 3 as aux
               from lineitem join m using (l_orderkey) group by 1)
    select l_orderkey, (2 * (grid >= 0.65)::int + 2 * (n >= 5)::int + 2 * (aligned >= 0.75)::int + 2 * (regular >= 0.65)::int + 2 * (idx >= 4)::int + (sexes > 0)::int + (docs >= 3)::int + aux::int)::int as score from f
""")
def q_table_score(spark, sf_dir):
    """Aggregated features of an order's lines in the place of a page's."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey")
    rows = L.dealt(rows, "l_orderkey")
    center = rows.groupBy("l_orderkey").agg(F.median("l_quantity").alias("m"))
    f = rows.join(center, "l_orderkey").groupBy("l_orderkey").agg(
        F.count("*").alias("names"), L.alignment_ratio("l_quantity", "m", 8.0).alias("aligned"), F.round(F.avg("l_discount") * 10, 9).alias("grid"), F.avg((F.col("l_tax") > 0.02).cast("int")).alias("regular"),
        F.count_if(F.col("l_linenumber") > 2).alias("index"), (F.count_if(F.col("l_returnflag") == "R") > 0).alias("sexes"), F.count_if(F.col("l_linestatus") == "O").alias("documents"), (F.count_distinct("l_suppkey") > 3).alias("auxiliary"),
    )
    return f.select("l_orderkey", L.table_score({c: F.col(c) for c in f.columns}).alias("score"))


@query(f"""
    with p as (select l_orderkey, l_quantity as x, l_extendedprice as y, row_number() over (partition by l_orderkey order by {_LINE}) as o from lineitem),
         s as (select a.l_orderkey, median((b.y - a.y) / (b.x - a.x)) as slope from p a join p b on a.l_orderkey = b.l_orderkey and a.o < b.o and a.x <> b.x group by 1)
    select l_orderkey, round(any_value(slope) + 0.0000123, 4) as slope, round(median(y - slope * x) + 0.00123, 2) as intercept from p join s using (l_orderkey) group by 1
""")
def q_theil_sen(spark, sf_dir):
    # a shift off the ties that quotients of small integers have at the last digit kept
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_KEYS)
    points = table(spark, sf_dir, "lineitem").withColumn("o", F.row_number().over(w))
    return L.theil_sen(points, "l_orderkey", "o", "l_quantity", "l_extendedprice").select("l_orderkey", F.round(F.col("slope") + 0.0000123, 4).alias("slope"), F.round(F.col("intercept") + 0.00123, 2).alias("intercept"))


@query("""
    with g as (select *, value - lag(value) over w as gap from events window w as (partition by user_id, event_type order by value, event_id)),
         t as (select user_id, event_type, median(gap) as t from g group by all)
    select event_id, coalesce(bool_or(coalesce(gap > greatest(2.2 * t, 5), false)) over (partition by user_id, event_type order by value, event_id rows between unbounded preceding and current row), false) as expired from g join t using (user_id, event_type)
""")
def q_section_expiry(spark, sf_dir):
    return L.expired_sections(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["value", "event_id"], "value", 2.2, F.lit(5.0)).select("event_id", "expired")


# ---------------------------------------------------------------- merges and gates


def _half(spark, sf_dir, side):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") % 2 == side)
    return rows.groupBy("l_orderkey", "l_linenumber").agg(S.weighted_score(F.col("l_discount"), F.col("l_quantity")).alias("score"), F.min("l_partkey").alias("value"))


@query("""
    with h as (select l_suppkey % 2 as side, l_orderkey, l_linenumber, coalesce(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 0) as score, min(l_partkey) as value from lineitem group by all),
         j as (select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) as l_linenumber, a.score as s0, a.value as v0, b.score as s1, b.value as v1,
                      coalesce((a.score is null or b.score > a.score + 0.0213) and b.score is not null, false) as refined
               from (select * from h where side = 0) a full join (select * from h where side = 1) b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber)
    select l_orderkey, l_linenumber, case when refined then v1 else v0 end as value, round(case when refined then s1 else s0 end + 0.00000013, 6) as score, refined from j
""")
def q_cell_merge(spark, sf_dir):
    # the margin lies between multiples of the tables' hundredths, so that sums in any order agree
    out = S.merge_cells(_half(spark, sf_dir, 0), _half(spark, sf_dir, 1), ["l_orderkey", "l_linenumber"], 0.0213)
    return out.withColumn("score", F.round(F.col("score") + 0.00000013, 6))  # off the ties of the last digit


@query(r"""
    with f as (select source, (doc_id // 40) % 2 as version, len(text) as n, len(string_split(text, ' ')) as words, len(regexp_extract_all(text, '[0-9]{6,9}')) as docs, len(regexp_replace(text, '[A-Za-z0-9 ]', '', 'g')) as strange, 0.5 + (doc_id % 7) / 20.0 as score from documents),
         q as (select source, version, coalesce(sum(score * n) / nullif(sum(n), 0), 0) + least(0.14, 0.004 * sum(words) + 0.04 * sum(docs)) + least(0.08, sum(n) / 700.0) - least(0.20, coalesce(sum(strange) / nullif(sum(n), 0), 0)) as q, avg((words > 100)::int) as cover from f group by all)
    select a.source, round(a.q, 6) as before, round(b.q, 6) as after, (b.cover + 0.001 >= a.cover and b.q >= a.q + 0.01) as accepted from q a join q b on a.source = b.source and a.version = 0 and b.version = 1
""")
def q_quality_gate(spark, sf_dir):
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "source", (F.floor(F.col("doc_id") / 40) % 2).alias("version"), F.length(t).alias("n"), F.size(F.split(t, " ")).alias("words"), F.regexp_count(t, F.lit("[0-9]{6,9}")).alias("docs"),
        F.length(F.regexp_replace(t, "[A-Za-z0-9 ]", "")).alias("strange"), (0.5 + (F.col("doc_id") % 7) / 20.0).alias("score"),
    )
    q = rows.groupBy("source", "version").agg(S.quality(F.col("score"), F.col("n"), F.col("words"), F.col("docs"), F.col("strange")).alias("q"), F.avg((F.col("words") > 100).cast("int")).alias("cover"))
    wide = q.groupBy("source").agg(*(F.max(F.when(F.col("version") == v, F.col(c))).alias(f"{c}{v}") for v in (0, 1) for c in ("q", "cover"))).where("q0 is not null and q1 is not null")
    return wide.select("source", F.round("q0", 6).alias("before"), F.round("q1", 6).alias("after"), S.accept(F.col("q0"), F.col("q1"), F.col("cover0"), F.col("cover1")).alias("accepted"))


# ---------------------------------------------------------------- entity resolution


@query("""
    with g as (select o_orderpriority as center, o_custkey as document, count(*) as occurrences, min(o_orderkey) as first, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as best, max(o_totalprice) as confidence from orders group by all)
    select *, 'PAC-' || case when row_number() over (order by first) < 10000 then lpad((row_number() over (order by first))::varchar, 4, '0') else (row_number() over (order by first))::varchar end as patient_id from g
""")
def d_exact_groups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    groups = R.exact_groups(orders, "o_orderpriority", "o_custkey", "o_totalprice", "o_orderkey")
    return S.with_ordinal(groups, ["first"], "_n").withColumn("patient_id", F.format_string("PAC-%04d", F.col("_n") + 1)).drop("_n")


def _people(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("center"), F.col("p_name").alias("full_name"), F.col("p_size").alias("age"), F.lit("años").alias("age_unit"),
        F.when(F.col("p_partkey") % 5 == 0, F.format_string("V-%07d", F.col("p_partkey") % 400)).otherwise("").alias("document_id"), (F.col("p_retailprice") / 3000).alias("confidence"),
        F.when(F.col("p_partkey") % 3 == 0, "F").otherwise("").alias("sex"), F.format_string("img%d", F.col("p_partkey") % 50).alias("source_image"), F.col("p_type").alias("origin"),
    )


@query()
def d_leader(spark, sf_dir):
    people, evidence = R.consolidate(_people(spark, sf_dir))
    members = evidence.groupBy("patient_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("evidence_id")), lambda x: x), ";").alias("evidence"))
    return people.select("patient_id", "first", "full_name", "center", "age", "document_id", "sex", "occurrences", F.round("confidence", 6).alias("confidence"), F.array_join("source_images", ";").alias("images"), F.array_join("notes", ";").alias("notes"), "duplicate_status").join(members, "patient_id")


def _apart(spark, sf_dir):
    """Each person a group of its own without a document."""
    return _people(spark, sf_dir).withColumn("document_id", F.lit("")).withColumn("patient_id", F.col("ordinal").cast("string")).withColumn("first", F.col("ordinal"))


@query("""
    select a.p_partkey as a, b.p_partkey as b, a.p_brand as center, a.p_size as age from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_name = b.p_name and a.p_partkey < b.p_partkey and len(a.p_name) >= 8
""")
def d_possible_pairs(spark, sf_dir):
    """The exact-name branch, which SQL can express: pairs whose similarity is 100 %. d_similar_pairs has all pairs."""
    pairs = R.possible_pairs(_apart(spark, sf_dir), keep=("center", "age", "full_name"))
    equal = pairs.where(F.startswith("reason", F.lit("nombre 100% |")) & (F.col("full_name_a") == F.col("full_name_b")))
    return equal.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"), F.col("center_a").alias("center"), F.col("age_a").alias("age"))


@query()
def d_similar_pairs(spark, sf_dir):
    """All possible pairs with their reasons: names of a similarity of 0.92 at least, equal ones included."""
    pairs = R.possible_pairs(_apart(spark, sf_dir), keep=("center", "age"))
    return pairs.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"), F.col("center_a").alias("center"), F.col("age_a").alias("age"), "reason")


@query("""
    with recursive g as (select l_partkey % 500 as grp, list(l_extendedprice::double order by l_extendedprice) as v from lineitem where l_extendedprice is not null group by 1),
         r(grp, k, start, cluster) as (
            select grp, 1, 1, 0 from g
            union all select r.grp, r.k + 1, case when far then r.k + 1 else r.start end, case when far then r.cluster + 1 else r.cluster end
            from (select r.*, g.v[r.k + 1] - (g.v[(r.start + r.k) // 2] + g.v[(r.start + r.k + 1) // 2]) / 2 > 900.0 as far from r join g on g.grp = r.grp where r.k < len(g.v)) r)
    select r.grp, r.cluster::int as cluster, count(*)::int as n, min(g.v[r.k]) as low, max(g.v[r.k]) as high from r join g on g.grp = r.grp group by r.grp, r.cluster
""")
def q_median_clusters(spark, sf_dir):
    """Prices of the line items of 500 groups of parts, clustered by running median."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("grp"), "l_extendedprice")
    return L.median_clusters(lines, ["grp"], "l_extendedprice", 900.0)


def _hough_sql() -> str:
    table = ", ".join(f"({k}, {c}, {s})" for k, (c, s) in enumerate(directions(36)))
    return f"""
        with d(angle, c, s) as (values {table}),
             p as (select l_suppkey % 50 as grp, (l_quantity * 10)::bigint as x, (l_linenumber * 40 + l_partkey % 3)::bigint as y from lineitem),
             v as (select grp, angle, floor((x * c + y * s) / {20 * UNIT}.0)::bigint as distance, count(*) as votes from p, d group by all),
             n as (select grp, (a + 36) % 36 as angle, case when a < 0 or a >= 36 then -t - 1 else t end as distance, votes, angle as wa, distance as wd
                   from (select *, angle + unnest([-1, -1, -1, 0, 0, 1, 1, 1]) as a, distance + unnest([-1, 0, 1, -1, 1, -1, 0, 1]) as t from v))
        select grp, angle::int as angle, distance, votes from v
        where votes >= 40 and not exists (select 1 from n where n.grp = v.grp and n.angle = v.angle and n.distance = v.distance
                                            and (n.votes > v.votes or n.votes = v.votes and (n.wa < v.angle or n.wa = v.angle and n.wd < v.distance)))
    """


@query(_hough_sql())
def q_hough_lines(spark, sf_dir):
    """Line items as points of fifty pictures: the lines that most of them lie on."""
    points = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("grp"), (F.col("l_quantity") * 10).cast("long").alias("x"), (F.col("l_linenumber") * 40 + F.col("l_partkey") % 3).cast("long").alias("y")
    )
    return hough_lines(hough_votes(points, ["grp"], "x", "y", 36, 20), ["grp"], 40, 36)


# ---------------------------------------------------------------- pages


def _customers(spark, sf_dir, rows: int):
    """Customers as page rows: page, place on it, a two-word name, document, age, sex."""
    k = F.col("c_custkey")
    word = F.translate(F.lpad(k.cast("string"), 7, "0"), "0123456789", "bcdfghjklm")
    return table(spark, sf_dir, "customer").select(
        F.floor(k / rows).cast("string").alias("image_id"), (k % rows).cast("int").alias("at"), F.concat(F.lit("Maria "), F.initcap(word)).alias("name"),
        (k + 10000000).cast("string").alias("document"), (k % 100).cast("int").alias("age"), F.when(k % 2 == 0, "F").otherwise("M").alias("sex"),
    )


def _page_lines(rows, cells, step: int):
    """Lines of (text, left) cells, a row every `step` pixels; each page gets its header or heading at the top."""
    body = rows.select("image_id", (F.col("at") + 1).alias("row"), F.posexplode(F.array(*(F.struct(c.alias("text"), F.lit(x).alias("x")) for c, _, x in cells))).alias("n", "c"))
    head = rows.select("image_id").distinct().select("image_id", F.lit(0).alias("row"), F.posexplode(F.array(*(F.struct(F.lit(h).alias("text"), F.lit(x).alias("x")) for _, h, x in cells))).alias("n", "c"))
    y = F.col("row") * step + 40
    box = F.struct(F.col("c.x").cast("int").alias("x1"), y.cast("int").alias("y1"), (F.col("c.x") + 150).cast("int").alias("x2"), (y + 24).cast("int").alias("y2"))
    return head.unionByName(body).select("image_id", (F.col("row") * 10 + F.col("n")).cast("int").alias("line_no"), F.col("c.text").alias("text"), F.lit(0.95).alias("score"), box.alias("box"), F.lit(1000).alias("image_width"), F.lit(3000).alias("image_height"))


def _parsed(spark, lines):
    from folioflux.plans.pages import Catalogs, parse_pages

    catalogs = Catalogs([M.Alias("pediatria", "Pediatría")], [M.Alias("petare", "Petare")], N.Lexicons({"maria": 1.0}, {"perez": 1.0}))
    images = lines.select("image_id").distinct().select("image_id", F.concat(F.lit("p/"), "image_id").alias("path"), F.lit("Centro").alias("center_name"))
    return parse_pages(lines, catalogs, images)


_CUSTOMERS = """
    with c as (select (c_custkey // {n})::varchar as image_id, c_custkey % {n} as at, c_custkey as k, translate(lpad(c_custkey::varchar, 7, '0'), '0123456789', 'bcdfghjklm') as w from customer)
    select image_id, 'Maria ' || upper(w[1]) || w[2:] as full_name, (k + 10000000)::varchar as document_id, (k % 100)::int as age, case when k % 2 = 0 then 'F' else 'M' end as sex, {more} from c
    where image_id in (select image_id from c group by 1 having count(*) >= 2)
"""


@query(_CUSTOMERS.format(n=40, more="'Centro' as center"))
def p_table_pages(spark, sf_dir):
    """Pages of forty customers as header tables, parsed back into records."""
    rows = _customers(spark, sf_dir, 40)
    rows = rows.join(rows.groupBy("image_id").count().where("count >= 2").select("image_id"), "image_id")
    cells = [(F.col("name"), "Nombre y Apellido", 40), (F.col("document"), "Cédula", 340), (F.col("age").cast("string"), "Edad", 600), (F.col("sex"), "Sexo", 820)]
    return _parsed(spark, _page_lines(rows, cells, 70)).select("image_id", "full_name", "document_id", "age", "sex", "center")


@query(_CUSTOMERS.format(n=25, more="'Pediatría' as specialty, 'Petare' as origin"))
def p_list_pages(spark, sf_dir):
    """Pages of twenty-five customers as numbered lines under a specialty, parsed back into records."""
    rows = _customers(spark, sf_dir, 25)
    rows = rows.join(rows.groupBy("image_id").count().where("count >= 2").select("image_id"), "image_id")
    line = F.concat_ws(" ", F.concat((F.col("at") + 1).cast("string"), F.lit(".")), "name", "document", F.concat(F.col("age").cast("string"), F.lit(" años")), "sex", F.lit("Petare"))
    return _parsed(spark, _page_lines(rows, [(line, "Pediatría", 40)], 110)).select("image_id", "full_name", "document_id", "age", "sex", "specialty", "origin")


# ---------------------------------------------------------------- evaluation, edits, export


def _sides(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    none = F.lit("")
    rows = turns.select(F.col("conv_id").cast("string").alias("stem"), F.col("turn").alias("row_no"), "role", F.col("text").alias("nombre_completo"), F.substring_index("text", " ", 1).alias("nombre"), none.alias("apellido"), none.alias("cedula"), none.alias("centro"), (F.length("text") % 90).cast("string").alias("edad"), F.lit("años").alias("unidad_edad"), none.alias("sexo"), none.alias("procedencia"), none.alias("especialidad"), none.alias("area"))
    return rows.where("role = 'user'").drop("role"), rows.where("role <> 'user'").drop("role")


@query()
def e_align(spark, sf_dir):
    return E.align_rows(*_sides(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query()
def e_report(spark, sf_dir):
    expected, predicted = _sides(spark, sf_dir)
    aligned = E.align_rows(expected, predicted)
    return E.field_report(E.compared_fields(aligned, expected, predicted), ["field"])


@query("""
    with f as (select d.lang, d.n_chars, l.quality, l.toxic from documents d left join labels l using (doc_id)),
         u as (select lang, n_chars, 'quality' as field, quality as v from f union all select lang, n_chars, 'toxic', toxic from f)
    select coalesce(lang, 'total') as lang, field, count(*) as total, count(*) filter (v = 1) as correctos, round(count(*) filter (v = 1) / count(*), 6) as exactitud, count(v) as total_con_dato,
           count(*) filter (v = 1) as correctos_con_dato, round(coalesce(count(*) filter (v = 1) / nullif(count(v), 0), 1), 6) as exactitud_con_dato, count(*) filter (v is null and n_chars % 3 = 0) as falsos_positivos
    from u group by grouping sets ((lang, field), (field))
""")
def e_field_metrics(spark, sf_dir):
    """Labels as compared fields: populated where there is one, correct where it is 1."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    long = rows.select("lang", "n_chars", F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (field, v)"))
    fields = long.select("lang", "field", F.coalesce(F.col("v") == 1, F.lit(False)).alias("correct"), F.col("v").isNotNull().alias("populated"), (F.col("v").isNull() & (F.col("n_chars") % 3 == 0)).alias("false_positive"))
    return E.field_report(fields, ["lang", "field"]).unionByName(E.field_report(fields, ["field"]).withColumn("lang", F.lit("total")))


_TRUTH = """
    with t as (select c_custkey as row_no, c_nationkey::varchar as stem, case when c_custkey % 7 = 0 then '' when c_custkey % 11 = 0 then '12x' else (c_custkey % 130)::varchar end as edad,
                      case when c_custkey % 5 = 0 then '' when c_custkey % 13 = 0 then 'siglos' else 'años' end as unidad_edad, case when c_custkey % 17 = 0 then 'X' else 'F' end as sexo, c_mktsegment as centro from customer)
"""


@query(_TRUTH + """
    select * from (
        select stem, row_no, unnest(list_filter([
            case when edad <> '' and not (regexp_matches(edad, '^[0-9]+$') and coalesce(try_cast(edad as int) between 0 and 115, false)) then 'edad' end,
            case when edad = '' and unidad_edad <> '' then 'unidad sin edad' end, case when edad <> '' and unidad_edad = '' then 'edad sin unidad' end,
            case when unidad_edad not in ('', 'años', 'meses', 'días') then 'unidad_edad' end, case when sexo not in ('', 'M', 'F') then 'sexo' end], lambda x: x is not null)) as error from t)
    union all select stem, null, 'más de un centro' from t group by stem having count(distinct centro) > 1
""")
def e_validate(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.lit("")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("row_no"), F.col("c_nationkey").cast("string").alias("stem"), F.when(k % 7 == 0, "").when(k % 11 == 0, "12x").otherwise((k % 130).cast("string")).alias("edad"),
        F.when(k % 5 == 0, "").when(k % 13 == 0, "siglos").otherwise("años").alias("unidad_edad"), F.when(k % 17 == 0, "X").otherwise("F").alias("sexo"), F.col("c_mktsegment").alias("centro"),
        *(none.alias(f) for f in E.FIELDS if f not in ("edad", "unidad_edad", "sexo", "centro")),
    )
    return E.truth_errors(rows)


@query("""
    with a as (select o_custkey::varchar as stem, case when o_orderkey % 5 <> 0 then o_orderkey end as e, case when o_orderkey % 7 <> 0 then o_orderkey end as p from orders)
    select stem, count(e) as esperados, count(p) as obtenidos, count(*) filter (e is not null and p is not null) as alineados,
           round(case when count(e) > 0 then count(*) filter (e is not null and p is not null) / count(e) when count(p) = 0 then 1.0 else 0.0 end, 6) as cobertura_registros,
           round(case when count(p) > 0 then count(*) filter (e is not null and p is not null) / count(p) when count(e) = 0 then 1.0 else 0.0 end, 6) as precision_registros
    from a group by stem
""")
def e_case_report(spark, sf_dir):
    k = F.col("o_orderkey")
    aligned = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("stem"), F.when(k % 5 != 0, k).alias("expected_no"), F.when(k % 7 != 0, k).alias("predicted_no"))
    return E.case_report(aligned)


@query("""
    select count(*) as total, count(*) filter (c_custkey % 3 = 0 or (c_custkey % 3 = 1 and c_acctbal < 0)) as pendientes, count(*) filter (c_nationkey = 7) as posibles_duplicados from customer
""")
def ed_review_counts(spark, sf_dir):
    from folioflux.plans.pipeline import review_counts

    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(F.when(k % 3 == 0, "Pendiente").when(k % 3 == 1, "").otherwise("Revisado").alias("review_status"), (F.col("c_acctbal") < 0).alias("needs_review"), F.when(F.col("c_nationkey") == 7, R.POSSIBLE).otherwise("Único").alias("duplicate_status"))
    return review_counts(people)


@query("""
    select c_custkey, case when c_custkey % 10 = 0 then upper(c_name) else c_name end as c_name, case when c_custkey % 10 = 0 then null else c_acctbal end as c_acctbal, c_mktsegment from customer
""")
def ed_apply(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    edits = rows.where("c_custkey % 10 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"))
    return S.apply_edits(rows, edits, "c_custkey", ["c_name", "c_acctbal"])


@query("""
    with n as (select *, case when c_custkey % 4 = 0 then '=' when c_custkey % 4 = 1 then '-' else '' end || c_name as n, case when c_nationkey % 2 = 0 then c_nationkey end as age from customer)
    select 'PAC-' || c_custkey as id, case when regexp_matches(n, '^[=+@-]') then '''' || n else n end as nombre, age as edad, case when age is not null then 'años' else '' end as unidad,
           case when age is not null then age::varchar || ' años · ' else '' end || c_mktsegment as edad_sector, case when c_custkey % 5 = 0 then 'a.png; b.png' else 'c' || c_custkey || '.png' end as imagenes,
           case when c_custkey % 3 = 0 then 'Revisado' when c_acctbal < 0 then 'Pendiente' else 'No requerido' end as estado, case when c_custkey % 2 = 0 then 'alta; baja' else 'baja' end as notas, 28 as columnas
    from n
""")
def s_export(spark, sf_dir):
    """Customers as people, in the columns of the export."""
    from folioflux.functions.schemas import with_defaults
    from folioflux.sources import sinks

    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("PAC-"), k).alias("patient_id"), F.concat(F.when(k % 4 == 0, "=").when(k % 4 == 1, "-").otherwise(""), F.col("c_name")).alias("full_name"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("age"), F.lit("años").alias("age_unit"), F.col("c_mktsegment").alias("origin"),
        F.when(k % 5 == 0, F.array(*map(F.lit, ["a.png", "b.png", "a.png"]))).otherwise(F.array().cast("array<string>")).alias("source_images"), F.concat(F.lit("c"), k, F.lit(".png")).alias("source_image"),
        F.when(k % 3 == 0, "Revisado").otherwise("").alias("review_status"), (F.col("c_acctbal") < 0).alias("needs_review"),
        F.when(k % 2 == 0, "alta").otherwise("").alias("clinical_notes"), F.array(*map(F.lit, ["baja", "", "baja"])).alias("notes"),
    )
    rows = sinks.export_rows(with_defaults(people))
    shown = sinks.with_age_and_sector(rows).withColumn("columnas", F.lit(len(rows.columns)))
    named = {"id_paciente": "id", "nombre_completo": "nombre", "unidad_edad": "unidad", "imagenes_origen": "imagenes", "estado_revision": "estado", "observaciones": "notas"}
    return shown.select("edad", "edad_sector", "columnas", *(F.col(c).alias(n) for c, n in named.items()))


@query("""
    with k as (select page_id, sha256('v1' || chr(0) || 'auto' || chr(0) || html) as key from pages), c as (select distinct key from k where page_id % 3 = 0)
    select page_id, key, c.key is not null as hit from k left join c using (key)
""")
def s_cache(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    cache = pages.where("page_id % 3 = 0").select(S.cache_key("v1", "auto", F.col("content")).alias("key")).distinct()
    hits, misses = S.split_cached(pages, cache, "v1", "auto")
    return hits.select("page_id", "key", F.lit(True).alias("hit")).unionByName(misses.select("page_id", "key", F.lit(False).alias("hit")))


@query("select conv_id::varchar as page, turn::int as line_no, text, round((turn + 1) / 7, 6) as score, (turn * 10)::int as x1 from conversations")
def s_json(spark, sf_dir):
    """Conversations as pages of lines, written as JSON texts and read back."""
    from folioflux.functions.schemas import BOX
    from folioflux.sources.sinks import lines_as_json

    x = (F.col("turn") * 10).cast("int")
    lines = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("image_id"), F.col("turn").cast("int").alias("line_no"), "text", ((F.col("turn") + 1) / 7).alias("score"),
        F.struct(x.alias("x1"), F.lit(0).alias("y1"), (x + 9).alias("x2"), F.lit(9).alias("y2")).alias("box"),
    )
    page = F.from_json("json", f"image_id string, lines array<struct<line_no:int,text:string,score:double,box:{BOX}>>")
    return lines_as_json(lines).select(page.alias("p")).select(F.col("p.image_id").alias("page"), F.explode("p.lines").alias("k")).select("page", "k.line_no", "k.text", "k.score", F.col("k.box.x1").alias("x1"))


@query("""
    with w as (select conv_id, unnest(string_split(text, ' ')) as w, turn, unnest(range(0, len(string_split(text, ' ')))) as i from conversations),
         f as (select conv_id, w, min((turn, i)) as place from w group by all), r as (select *, row_number() over (partition by conv_id order by place) as k from f)
    select conv_id, count(*) as n, string_agg(w, '; ' order by k) filter (k <= 5) as head from r group by 1
""")
def n_distinct_ordered(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.split(x["text"], " "))
    words = F.array_distinct(F.flatten(ordered))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(words.alias("w")).select("conv_id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 5), "; ").alias("head"))
