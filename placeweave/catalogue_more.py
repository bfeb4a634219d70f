"""Further queries of the address half: single functions and small operators over data that varies, with their SQL."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.catalogue import ABBR, GAZ, Tables, _abbreviations, divisions, query
from placeweave.functions import scoring as C
from placeweave.functions import similarity as S
from placeweave.functions import text as T
from placeweave.functions import tokens as N
from placeweave.operators import changes, combine, context, enrich, matching, phrases, quarantine, resolve, review, similar, structural
from placeweave.operators import gazetteer as G
from placeweave.plans.stages import small
from placeweave.sources import writers


@query("""select p_partkey, coalesce(b <> '' and (contains(lower(a), lower(b)) or contains(lower(b), lower(a))), false) as inside
from (select p_partkey, p_name as a, case p_partkey % 4 when 0 then upper(substr(p_name, 3, 4)) when 1 then p_name || ' x' when 2 then '' else p_brand end as b from part)""")
def contains_either_way(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    other = F.when(k == 0, F.upper(F.substring("p_name", 3, 4))).when(k == 1, F.concat("p_name", F.lit(" x"))).when(k == 2, "").otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", S.contains_either(F.col("p_name"), other).alias("inside"))


@query("select doc_id, upper(replace(strip_accents(text), 'ß', 'ss')) as plain from documents")
def marks_stripped_upper(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.strip_marks_upper(F.col("text")).alias("plain"))


@query("""select p_partkey, list_position(string_split(p_name, ' '), split_part(p_name, ' ', 1 + p_partkey % 5)) - 1 as place
from (select p_partkey::int as p_partkey, p_name || ' a b c d e' as p_name from part)""")
def phrase_first_place(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" a b c d e"))
    words = N.words(name)
    phrase = F.split_part(name, F.lit(" "), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").cast("int").alias("p_partkey"), N.phrase_position(words, phrase).cast("int").alias("place"))


@query("""with w as (select p_partkey, string_split(p_name, ' ') as w, p_partkey % 13 as a, 4 + p_partkey % 17 as n from part),
x as (select p_partkey, list_filter(range(0, len(w)), lambda i: length(array_to_string(w[1:i], ' ')) + (case when i > 0 then 1 else 0 end) >= a
  and length(array_to_string(w[1:i], ' ')) + (case when i > 0 then 1 else 0 end) + length(w[i + 1]) <= a + n) as inside from w)
select p_partkey, case when len(inside) > 0 then inside[1] + 7 else -1 end::int as s, case when len(inside) > 0 then inside[-1] + 8 else -1 end::int as e from x""")
def characters_to_tokens(t: Tables) -> DataFrame:
    at, length = (F.col("p_partkey") % 13).cast("int"), (F.col("p_partkey") % 17 + 4).cast("int")
    span = N.char_to_tokens(F.split("p_name", " "), at, length, F.lit(7))
    return t.part.select("p_partkey", span.alias("x")).select("p_partkey", F.col("x.s").cast("int").alias("s"), F.col("x.e").cast("int").alias("e"))


@query("""with x as (select o_orderkey, (o_orderkey % 7 - 1)::int as w, (o_custkey % 5 - 1)::int as d, (o_orderkey % 11 - 1)::int as p from orders),
l as (select o_orderkey, list_filter([w, d, p], lambda v: v >= 0) as v from x)
select o_orderkey, case when len(v) >= 2 and v = list_sort(v) then 1.1 else 1.0 end::double as bonus from l""")
def span_order_bonus(t: Tables) -> DataFrame:
    w, d, p = ((F.col(c) % m - 1).cast("int") for c, m in (("o_orderkey", 7), ("o_custkey", 5), ("o_orderkey", 11)))
    return t.orders.select("o_orderkey", C.order_bonus(w, d, p).alias("bonus"))


@query("""with x as (select l_orderkey, l_linenumber, l_discount::double * 10 as p, (l_linenumber % 3)::double / 4 as d, l_tax::double * 5 as w, (l_linenumber % 4)::int as lv, l_linenumber % 2 = 0 as k from lineitem),
y as (select *, ((case when p > 0 then p else 0 end) + (case when d > 0 then d else 0 end) + (case when w > 0 then w else 0 end)) / nullif((p > 0)::int + (d > 0)::int + (w > 0)::int, 0) as b from x)
select l_orderkey, l_linenumber, round(coalesce(case when b > 0 then least(1.0, b + case lv when 3 then 0.1 when 2 then 0.05 else 0 end + case when k then 0.1 else 0 end) end, 0), 6)::double as confidence from y""")
def extraction_confidence(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    p, d, w = F.col("l_discount").cast("double") * 10, (line % 3).cast("double") / 4, F.col("l_tax").cast("double") * 5
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(C.extraction_confidence(p, d, w, line % 4, line % 2 == 0), 6).alias("confidence"))


@query("""with x as (select l_orderkey, l_linenumber, l_discount::double * 10 as prox, 0.5 + l_tax::double * 5 as base, l_linenumber % 2 = 0 as valid, case when l_linenumber % 3 = 0 then 1.1 else 1.0 end::double as ord,
  l_linenumber % 4 = 1 as adj, 0.8 + l_discount::double as sim from lineitem)
select l_orderkey, l_linenumber, round((0.30 * prox + 0.50 * base + 0.20 * (case when valid then 1 else 0 end)) * ord * (case when adj then 1.15 else 1 end) * (case when valid then 1 else 0.5 end) * sim * base * base, 6)::double as score from x""")
def combination_scores(t: Tables) -> DataFrame:
    line, discount = F.col("l_linenumber"), F.col("l_discount").cast("double")
    score = structural.combination_score(discount * 10, 0.5 + F.col("l_tax").cast("double") * 5, line % 2 == 0, F.when(line % 3 == 0, 1.1).otherwise(1.0), line % 4 == 1, 0.8 + discount)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query(GAZ + """, x as (select id, p, d, case when id % 3 = 0 then d else w end as w from dv), twin as (select d as name from x intersect select w from x),
asked as (select id as row_id, p, d as name from x where d in (select name from twin)),
up as (select p, d, w as name, min(id) as id from x group by 1, 2, 3)
select row_id, p, name as d, null::varchar as w, 'as_district' as interpretation from asked
union all select row_id, p, d, name, 'as_ward' from (select asked.row_id, up.*, row_number() over (partition by asked.row_id, up.p, up.name order by up.id) as n from asked join up using (p, name)) where n <= 3""")
def ambiguous_branches(t: Tables) -> DataFrame:
    dv = divisions(t).withColumn("w", F.when(F.col("id") % 3 == 0, F.col("d")).otherwise(F.col("w")))
    rows = dv.select(F.col("id").alias("row_id"), "p", F.col("d").alias("name"))
    return structural.disambiguate(rows, dv)


@query("select l_orderkey, l_returnflag, count(*) as candidates from lineitem group by 1, 2")
def candidates_per_source(t: Tables) -> DataFrame:
    return review.candidates_per_source(t.lineitem, "l_orderkey", "l_returnflag")


@query("select o_orderpriority, count(*) as rows, row_number() over (order by count(*) desc, o_orderpriority)::int as place from orders group by 1")
def ordered_by_aggregate(t: Tables) -> DataFrame:
    return review.by_count(t.orders, "o_orderpriority")


@query("""select p_brand, p_partkey, row_number() over (partition by p_brand order by len(list_distinct(list_filter(string_split(lower(name), ' '), lambda x: x <> ''))) desc, p_size desc, name, p_partkey)::int as place
from (select p_brand, p_partkey, p_size, case when p_partkey % 2 = 0 then p_name || ' ' || p_partkey else split_part(p_name, ' ', 1) || ' ' || p_partkey end as name from part)""")
def streets_longest_first(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", key)).otherwise(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), key))
    return matching.longest_first(t.part.withColumn("name", name), "p_brand", "name", "p_size").select("p_brand", "p_partkey", "place")


@query("""select p_partkey, array_to_string(list_transform(string_split(text, ' '), lambda x: case rtrim(x, ',.') when 'hn' then 'ha noi' when 'tx' then 'thanh xuan' else x end), ' ') as text
from (select p_partkey, case p_partkey % 3 when 0 then 'hn, ' || p_name when 1 then p_name || ' tx.' else p_name end as text from part)""")
def abbreviations_in_text(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("hn, "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" tx."))).otherwise(F.col("p_name"))
    words = F.create_map(*map(F.lit, ("hn", "ha noi", "tx", "thanh xuan")))
    return t.part.select("p_partkey", F.array_join(T.expand_words(F.split(text, " "), words), " ").alias("text"))


@query(GAZ + """ select id, case when name[1:1] = '' then '' else array_to_string(list_transform(string_split(name, ' '), lambda x: upper(x[1]) || lower(substr(x, 2))), ' ') end as name
from (select id, replace(replace(n, 'QUẬN ', ''), 'XÃ ', '') as name from (select id, case id % 3 when 0 then 'QUẬN ' when 1 then 'XÃ ' else '' end || upper(d) as n from dv))""")
def names_of_full_names(t: Tables) -> DataFrame:
    k = F.col("id") % 3
    full = F.concat(F.when(k == 0, "QUẬN ").when(k == 1, "XÃ ").otherwise(""), F.upper("d"))
    return divisions(t).select("id", T.name_of_full(full).alias("name"))


GIVEN = GAZ + """, asked as (select id as row_id, case when id % 5 <> 1 then p end as p, case when id % 5 not in (2, 4) then d when id % 5 = 4 then '' end as d,
  case when id % 5 not in (3, 4) then case when id % 7 = 0 then w || ' x' else w end end as w from dv)"""


def _given(t: Tables) -> DataFrame:
    m, name = F.col("id") % 5, F.when(F.col("id") % 7 == 0, F.concat("w", F.lit(" x"))).otherwise(F.col("w"))
    d = F.when(~m.isin(2, 4), F.col("d")).when(m == 4, "")
    return divisions(t).select(F.col("id").alias("row_id"), F.when(m != 1, F.col("p")).alias("p"), d.alias("d"), F.when(~m.isin(3, 4), name).alias("w"))


@query(GIVEN + """ select row_id, min(x.id)::int as id, arg_min(case when a.d <> '' then x.d_full end, x.id) as d_full, arg_min(case when a.w is not null then x.w_full end, x.id) as w_full
from asked a left join dv x on (a.p is null or a.p = x.p) and (coalesce(a.d, '') = '' or a.d = x.d) and (a.w is null or a.w = x.w)
  and (a.p is not null)::int + (coalesce(a.d, '') <> '')::int + (a.w is not null)::int >= 2 group by row_id""")
def lookup_of_given_names(t: Tables) -> DataFrame:
    return G.lookup(_given(t), divisions(t)).select("row_id", "found.id", "found.d_full", "found.w_full")


@query(GIVEN + """ select a.row_id, x.id from asked a join dv x on (a.p is null or a.p = x.p) and (coalesce(a.d, '') = '' or a.d = x.d) where a.p is not null or coalesce(a.d, '') <> ''""")
def candidates_in_scope(t: Tables) -> DataFrame:
    return G.scoped(_given(t), divisions(t)).select("row_id", "division.id")


@query("""select p_partkey, case k when 0 then 'thanh xuan ' || p_name || ' hoan kiem ha noi' when 1 then 'tx ' || p_name when 2 then 'tx ' || p_name || ' da nang' when 3 then 'thanh xuan ' || p_name else '' end as normalized,
  case k when 0 then 'ha noi' when 2 then 'da nang' when 3 then 'ha noi' end as province_context, case k when 5 then null end as district_context, case when k in (0, 2) then 2 else 1 end as iterations
from (select p_partkey, p_name, p_partkey % 5 as k from part)""")
def context_in_two_passes(t: Tables) -> DataFrame:
    rows = [("hn", "ha noi", None, None), ("tx", "thanh xuan", "ha noi", None), ("ph co", "hoan kiem", "ha noi", None), ("dn", "da nang", None, None), ("dn", "dong nai", None, None), ("tx", "x", "ha noi", "y")]
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("TX. "), name, F.lit(" ph co, HN"))).when(k.isin(1, 3), F.concat(F.lit("tx, "), name)).when(k == 2, F.concat(F.lit("TX "), name, F.lit(", Đà Nẵng")))
    df = t.part.select("p_partkey", text.alias("address"), F.when(k == 3, "Tỉnh Hà Nội").alias("hint"))
    out = context.iterative(df, t.spark.createDataFrame(rows, G.ABBREVIATIONS), province_hint="hint")
    return out.select("p_partkey", "normalized", "province_context", F.col("district_context").cast("int").alias("district_context"), "iterations")


@query(GAZ + """, x as (select id as row_id, case when id % 6 = 5 then p || ' x' else p end as p, case when id % 6 in (0, 1, 5) then d when id % 6 = 4 then d || ' x' else '' end as d, case when id % 6 = 0 then w end as w from dv)
select row_id, upper(p) as p_full, case when d <> '' then d_full else '' end as d_full, case when w is not null then w_full else '' end as w_full, 1 + (d <> '')::int + (w is not null)::int as at_rule, case when d <> '' then 0.95 else 0 end::double as d_score, 'structural_comma' as source
from x join (select id as row_id, d_full, w_full from dv) using (row_id) where row_id % 6 not in (4, 5)""")
def structural_candidates(t: Tables) -> DataFrame:
    m = F.col("id") % 6
    district = F.when(m.isin(0, 1, 5), F.col("d")).when(m == 4, F.concat("d", F.lit(" x"))).otherwise("")
    province = F.when(m == 5, F.concat("p", F.lit(" x"))).otherwise(F.col("p"))
    parsed = divisions(t).select(F.col("id").alias("row_id"), province.alias("province"), district.alias("district"), F.when(m == 0, F.col("w")).alias("ward"), F.lit(0.9).alias("confidence"))
    return structural.as_candidates(parsed, divisions(t)).select("row_id", "p_full", "d_full", "w_full", "at_rule", "d_score", "source")


@query("""select l_orderkey as row_id, arg_min(p, k) as p, count(*) as candidates, bool_and(valid) as all_valid from (
  select l_orderkey, l_partkey as p, l_returnflag <> 'R' as valid, row_number() over (partition by l_orderkey order by l_extendedprice, l_partkey, l_suppkey, l_linenumber) as k from lineitem) group by 1""")
def best_and_all_valid(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")
    valid = F.when(F.col("l_returnflag") != "R", True)
    cands = t.lineitem.select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("p"), valid.alias("valid"), F.row_number().over(w).alias("cand_rank"))
    return resolve.validated(cands).select("row_id", "best.p", "candidates", "all_valid")


@query("""with c as (select l_orderkey as row_id, l_returnflag as p, case when l_linestatus = 'O' then l_linestatus end as d, l_quantity as combined, row_number() over (partition by l_orderkey order by l_extendedprice, l_partkey, l_suppkey, l_linenumber) as k from lineitem),
f as (select row_id, p, min(k) as k from c group by 1, 2)
select row_id, arg_min(combined, k) as combined, (select string_agg(p, '|' order by f.k) from f where f.row_id = c.row_id) as provinces, coalesce(max(d), '') as districts, count(*) as candidates from c group by row_id""")
def potential_names(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")
    d = F.when(F.col("l_linestatus") == "O", F.col("l_linestatus"))
    cands = t.lineitem.select(F.col("l_orderkey").alias("row_id"), F.col("l_returnflag").alias("p"), d.alias("d"), F.lit(None).cast("string").alias("w"), F.col("l_quantity").alias("combined"), F.row_number().over(w).alias("cand_ord"))
    return resolve.match_summary(cands).select("row_id", "best.combined", F.array_join("potential_p", "|").alias("provinces"), F.array_join("potential_d", "|").alias("districts"), "candidates")


def _options(t: Tables) -> DataFrame:
    """Names of a gazetteer's rows as what an address may mean: more of each level than are combined, for some rows surely one."""
    dv = divisions(t).select(F.col("id").alias("row_id"), "p", "d", "w")
    n = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("n")
    level = lambda c: dv.select("row_id", F.lit(c).alias("level"), F.col(c).alias("own"), n)
    rows = level("p").union(level("d")).union(level("w"))
    sure = (F.col("row_id") % 4 == 0) & (F.col("n") == 0) & (F.col("level") != "w")
    rows = rows.where((F.col("row_id") % 5 != 1) | (F.col("level") != "d"))
    name = F.when(F.col("n") == 0, F.col("own")).otherwise(F.concat_ws(" ", "own", F.col("n").cast("string")))
    return rows.select("row_id", "level", name.alias("name"), F.when(sure, 1.0).otherwise(0.95 - 0.05 * F.col("n")).alias("score"), F.lit(0).alias("s"), F.lit(1).alias("e"))


@query(GAZ + """, k as (select unnest(range(0, 7))::int as n), o as (select id as row_id, case when n = 0 then p else p || ' ' || n end as p, case when n = 0 then d else d || ' ' || n end as d, case when n = 0 then w else w || ' ' || n end as w, n from dv, k),
ps as (select row_id, p from o where n < case when row_id % 4 = 0 then 1 else 3 end),
ds as (select row_id, d from o where row_id % 5 <> 1 and n < case when row_id % 4 = 0 then 1 else 5 end
  union all select row_id, null from o where row_id % 5 = 1 and n = 0 union all select row_id, d from o where row_id % 5 = 1 and n = 0),
ws as (select row_id, w from o where n < 3 union all select row_id, null from o where n = 0)
select row_id, p, d, w from ps join ds using (row_id) join ws using (row_id)""")
def candidate_product(t: Tables) -> DataFrame:
    dv = divisions(t)
    return combine.combined(dv.select(F.col("id").alias("row_id")), _options(t), dv).select("row_id", "p", "d", "w")


@query("""select round(avg(value) filter (r = 0), 6) as mean_0, round(avg(value) filter (r = 1), 6) as mean_1, round(avg(value) filter (r = 2), 6) as mean_2, null::double as mean_3 from (select value, user_id % 3 as r from events)""")
def conditional_average(t: Tables) -> DataFrame:
    out = review.conditional_averages(t.events.select((F.col("user_id") % 3).alias("user_rating"), F.col("value").alias("confidence_score")))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("""with x as (select case when doc_id % 3 > 0 then lang end as tw, case when doc_id % 4 = 0 then 'en' else lang end as w, n_chars / 1000.0::double as y from documents)
select round((count(*) filter (tw = w))::double / count(tw), 6) as ward_accuracy, round(avg(y), 4) as mean_proximity, round(avg(2 * y), 4) as mean_time_ms from x""")
def accuracy_of_wards(t: Tables) -> DataFrame:
    key, size = F.col("doc_id"), F.col("n_chars") / 1000.0
    names = [F.lit(None).cast("string").alias(c) for c in ("truth_p", "truth_d", "p", "d")]
    rows = t.documents.select(*names, F.when(key % 3 > 0, F.col("lang")).alias("truth_w"), F.when(key % 4 == 0, "en").otherwise(F.col("lang")).alias("w"), size.alias("confidence"), size.alias("proximity"), (2 * size).alias("time_ms"))
    return review.accuracy(rows).select(F.round("ward_accuracy", 6).alias("ward_accuracy"), F.round("mean_proximity", 4).alias("mean_proximity"), F.round("mean_time_ms", 4).alias("mean_time_ms"))


@query("""select s_suppkey, 'id' || s_suppkey as place_id, s_name as place_name, s_suppkey::double / 2 as lat, case when s_suppkey % 2 = 0 then 'A' || s_nationkey end as area_1, 'B' as area_2, null::varchar as area_3 from supplier where s_suppkey % 3 <> 0""")
def place_detail(t: Tables) -> DataFrame:
    component = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"long_name": "A'), F.col("s_nationkey").cast("string"), F.lit('", "types": ["administrative_area_level_1", "political"]}, '))).otherwise("")
    status = F.when(F.col("s_suppkey") % 3 == 0, "NOT_FOUND").otherwise("OK")
    answer = F.format_string('{"status": "%s", "result": {"place_id": "id%d", "name": "%s", "geometry": {"location": {"lat": %s, "lng": 1.5}}, "address_components": [%s{"long_name": "B", "types": ["administrative_area_level_2"]}]}}', status, "s_suppkey", "s_name", (F.col("s_suppkey") / 2).cast("string"), component)
    return enrich.place_details(t.supplier.select("s_suppkey", answer.alias("answer"))).select("s_suppkey", "place_id", "place_name", "lat", "area_1", "area_2", "area_3")


@query(GAZ + """, r as (select id, case when id % 3 = 0 then [] when id % 3 = 1 then [id] else [id, id + 1] end as l from dv)
select id as raw_input, coalesce('p' || x, '') as new_province, '' as new_ward, coalesce('n' || x, '') as migration_note, 0.0::double as total_time_ms, 'failed' as quality_flag from (select id, unnest(case when len(l) = 0 then [null] else l end) as x from r)""")
def results_by_new_address(t: Tables) -> DataFrame:
    item = lambda x: F.struct(F.concat(F.lit("p"), x.cast("string")).alias("new_province"), F.lit(None).cast("string").alias("new_ward"), F.concat(F.lit("n"), x.cast("string")).alias("note"))
    m, key = F.col("id") % 3, F.col("id")
    news = F.transform(F.when(m == 1, F.array(key)).when(m == 2, F.array(key, key + 1)).otherwise(F.array().cast("array<int>")), item)
    empty = [F.lit("").alias(c) for c in ("province", "district", "ward", "state_code", "county_code", "remaining_1", "remaining_2", "remaining_3")]
    rows = divisions(t).select(key.alias("raw_input"), *empty, F.lit(0).alias("at_rule"), F.lit(0.0).alias("confidence"), F.lit("failed").alias("quality_flag"), news.alias("new_addresses"))
    return writers.exploded(rows).select("raw_input", "new_province", "new_ward", "migration_note", "total_time_ms", "quality_flag")


@query("""select p_partkey, len(list_filter(w[1:2], lambda x: x in ('ubnd', 'phong', 'ban', 'so', 'truong', 'vien', 'bo'))) > 0 as noise
from (select p_partkey, string_split(case p_partkey % 4 when 0 then 'ubnd ' || p_name when 1 then p_name || ' truong' when 2 then 'ubndx ' || p_name else 'a so ' || p_name end, ' ') as w from part)""")
def noise_words_in_span(t: Tables) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("ubnd "), name)).when(k == 1, F.concat(name, F.lit(" truong"))).when(k == 2, F.concat(F.lit("ubndx "), name)).otherwise(F.concat(F.lit("a so "), name))
    return t.part.select("p_partkey", N.has_noise(F.slice(N.words(text), 1, 2)).alias("noise"))


@query("""with x as (select event_id, (event_id % 5 - 1)::int as a, (event_id % 3)::int as n, (user_id % 4)::int as b from events)
select event_id, array_to_string(list_sort(list_distinct(list_concat(case when a >= 0 then range(a, a + n) else [] end, range(b, b + 2)))), ',') as places from x""")
def union_of_spans(t: Tables) -> DataFrame:
    a, n, b = ((F.col(c) % m + o).cast("int") for c, m, o in (("event_id", 5, -1), ("event_id", 3, 0), ("user_id", 4, 0)))
    places = F.transform(F.array_sort(N.covered([(a, a + n), (b, b + 2)])), lambda x: x.cast("string"))
    return t.events.select("event_id", F.array_join(places, ",").alias("places"))


ASKED = """with x as (select s_suppkey, case s_suppkey % 3 when 0 then s_name || ' ' || n_name when 1 then s_name || ' ' || r_name else s_name end as a,
  case when s_suppkey % 5 = 0 then '' else n_name end as d, r_name as p from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


@query(ASKED + """ select s_suppkey, a || case when d <> '' and not contains(a, d) then ', ' || d else '' end || case when contains(a, p) then '' else ', ' || p end as asked,
  case p when 'ASIA' then '1,2,3,4' when 'EUROPE' then '5,6,7,8' else '0,0,9,9' end as box from x""")
def geocoder_query(t: Tables) -> DataFrame:
    k = F.col("id") % 3
    address = F.when(k == 0, F.concat_ws(" ", "w_full", "d_full")).when(k == 1, F.concat_ws(" ", "w_full", "p_full")).otherwise(F.col("w_full"))
    district = F.when(F.col("id") % 5 == 0, "").otherwise(F.col("d_full"))
    box = enrich.bounding_box(F.col("p_full"), {"ASIA": "1,2,3,4", "EUROPE": "5,6,7,8"}, "0,0,9,9")
    return divisions(t).select(F.col("id").cast("long").alias("s_suppkey"), enrich.enriched_query(address, district, F.col("p_full")).alias("asked"), box.alias("box"))


@query("select doc_id, case when doc_id = 5 then 3 else quality end::int as user_rating from labels")
def rating_of_one_changed(t: Tables) -> DataFrame:
    changed = review.update_rating(t.labels.select("doc_id", F.col("quality").cast("int").alias("user_rating")), 5, 3, key="doc_id")
    return changed.select("doc_id", "user_rating")


@query("""select c_custkey, case c_custkey % 5 when 0 then lower(c_mktsegment) when 1 then 'ha noi' when 3 then (c_custkey % 30)::varchar end as hint from customer""")
def hints_normalized(t: Tables) -> DataFrame:
    k, segment = F.col("c_custkey") % 5, F.col("c_mktsegment")
    number = (F.col("c_custkey") % 30).cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" Tỉnh  "), segment)).when(k == 1, "THÀNH PHỐ Hà Nội").when(k == 2, " / ").when(k == 3, F.concat(F.lit("Q."), number)).otherwise("Quận ")
    return t.customer.select("c_custkey", F.when(k != 4, T.normalize_hint(raw)).alias("hint"))


PIECES = GAZ + """, x as (select id as row_id, id % 4 as k, id % 20 + 1 as n, p, d from dv)"""


def _lines(t: Tables) -> DataFrame:
    """Addresses in pieces with level words and without; a third kind without commas, a fourth that is noise."""
    k = F.col("id") % 4
    named = F.concat(F.lit("Phuong An  Phu , Quan "), F.col("id") % 20 + 1, F.lit(", Tinh "), F.col("p_full"))
    bare = F.concat(F.lit("so 5, p. An Lac, "), "d", F.lit(", "), "p")
    text = F.when(k == 0, named).when(k == 1, bare).when(k == 2, F.concat_ws(" ", "d", "p")).otherwise(F.concat(F.lit("UBND "), "d", F.lit(", "), "p"))
    return divisions(t).select(F.col("id").alias("row_id"), text.alias("text"))


@query(PIECES + """ select row_id, 0 as position, 'ward' as level, 'an phu' as name, 0.4::double as boost from x where k = 0
union all select row_id, 1, 'district', n::varchar, 0.45 from x where k = 0 union all select row_id, 2, 'province', p, 0.5 from x where k = 0
union all select row_id, 0, 'unknown', 'so 5', 0.1 from x where k = 1 union all select row_id, 1, 'ward', 'an lac', 0.43 from x where k = 1
union all select row_id, 2, 'unknown', d, 0.17 from x where k = 1 union all select row_id, 3, 'unknown', p, 0.2 from x where k = 1""")
def structural_segments(t: Tables) -> DataFrame:
    return structural.segments(_lines(t)).select("row_id", "position", "level", "name", "boost")


@query(PIECES + """ select row_id, 'an phu' as ward, n::varchar as district, p as province, 0.95::double as confidence from x where k = 0
union all select row_id, 'an lac', d, case when p <> 'asia' then p end, case when p <> 'asia' then 0.6 else 0.5 end from x where k = 1""")
def structural_hierarchy(t: Tables) -> DataFrame:
    known = divisions(t).select("p").where("p <> 'asia'")
    return structural.hierarchy(structural.segments(_lines(t)), known).select("row_id", "ward", "district", "province", F.round("confidence", 6).alias("confidence"))


@query("""select s_suppkey::int as row_id, array_to_string(list_transform(string_split(r_name, ' '), lambda x: upper(x[1]) || lower(substr(x, 2))), ' ') as province,
  upper(n_name[1]) || lower(substr(n_name, 2)) as district, s_name as ward, 3 as at_rule, 'success' as status
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def resolve_fuzzy_flagship(t: Tables) -> DataFrame:
    """Wards, with a mistyped district, a mistyped province, 70 words before, no province, or a hint in its place."""
    k = F.col("id") % 6
    ward = F.concat(F.lit("phuong "), "w")
    district = F.concat(F.lit(", quan "), F.when(k == 1, F.replace("d", F.lit("nation"), F.lit("natiion"))).otherwise(F.col("d")))
    province = F.when(k < 4, F.concat(F.lit(", tinh "), "p", F.when(k == 2, F.substr("p", F.length("p"))).otherwise(""))).otherwise("")
    before = F.when(k == 3, F.repeat(F.lit("dat trong "), 35)).otherwise("12 duong hoa, ")
    rows = divisions(t).select(F.col("id").alias("row_id"), F.concat(before, ward, district, province).alias("address"), F.when(k == 5, F.concat(F.lit("Tỉnh "), "p_full")).alias("hint"))
    out = resolve.resolve(rows, G.Gazetteer.of(divisions(t)), province_hint="hint")
    return out.select("row_id", "province", "district", "ward", "at_rule", "status")


@query("""with x as (select o_orderkey, case o_orderkey % 3 when 0 then 'hn' when 1 then 'tx' else 'db' end as key, case o_orderkey % 4 when 0 then null when 1 then 'ha nam' else 'ha noi' end as p, case o_orderkey % 4 when 3 then 'ba dinh' end as d from orders)
select o_orderkey, case when key = 'hn' and p is null then 'ha noi' when key = 'hn' and p = 'ha nam' then 'ha nam' when key = 'tx' and p = 'ha noi' and d is null then 'thanh xuan' when key = 'db' and p is null then 'dien bien' when key = 'db' and d = 'ba dinh' then 'dien ban' end as word from x""")
def abbreviation_at_context(t: Tables) -> DataFrame:
    k, m = F.col("o_orderkey") % 3, F.col("o_orderkey") % 4
    province = F.when(m == 1, "ha nam").when(m != 0, "ha noi").alias("province_context")
    rows = t.orders.select("o_orderkey", F.when(k == 0, "hn").when(k == 1, "tx").otherwise("db").alias("key"), province, F.when(m == 3, "ba dinh").alias("district_context"))
    return G.abbreviation_at(rows, t.spark.createDataFrame(ABBR, G.ABBREVIATIONS)).select("o_orderkey", "word")


@query(GAZ + """, x as (select id as row_id, case when id % 7 = 6 then p || ' x' else p end as p, case when id % 4 > 0 then d end as d, case when id % 4 > 1 then case when id % 4 = 3 then w else w || ' x' end end as w from dv)
select row_id, case when row_id % 7 = 6 then '' else p_full end as p_full, case when row_id % 7 <> 6 and row_id % 4 > 0 then d_full else '' end as d_full, case when row_id % 7 <> 6 and row_id % 4 = 3 then w_full else '' end as w_full
from x join (select id as row_id, p_full, d_full, w_full from dv) using (row_id)""")
def full_names_of_known(t: Tables) -> DataFrame:
    k = F.col("id") % 4
    ward = F.when(k == 3, F.col("w")).when(k == 2, F.concat("w", F.lit(" x")))
    rows = divisions(t).select(F.col("id").alias("row_id"), F.when(F.col("id") % 7 == 6, F.concat("p", F.lit(" x"))).otherwise(F.col("p")).alias("p"), F.when(k > 0, F.col("d")).alias("d"), ward.alias("w"))
    return G.full_names(rows, divisions(t)).select("row_id", "p_full", "d_full", "w_full")


@query("""with n as (select distinct p_name as a from part), x as (select x.a, y.a as b, 1 - levenshtein(x.a, y.a)::double / greatest(length(x.a), length(y.a)) as base from n x join n y on x.a <> y.a)
select a, b, round(least(1, base + case when length(b) >= 5 and contains(a, b) then 0.25 else 0 end), 6)::double as score from x where base > 0 and least(1, base + case when length(b) >= 5 and contains(a, b) then 0.25 else 0 end) >= 0.85""")
def similar_names_one_scope(t: Tables) -> DataFrame:
    """All pairs of different part names, in one scope, that are alike."""
    names = t.part.select("p_name").distinct()
    pairs = similar.similar(names.withColumnRenamed("p_name", "a"), names.withColumnRenamed("p_name", "b"), (), "a", "b", 0.85).where("a <> b")
    score = S.ensemble(F.col("a"), F.col("b"))
    return pairs.select("a", "b", score.alias("score")).where("score >= 0.85").withColumn("score", F.round("score", 6))


@query("""with q as (select distinct p_brand, lower(p_type) || ' ' || p_name as a from part), n as (select distinct p_brand, p_name as b from part),
x as (select p_brand, a, b, 1 - levenshtein(a, b)::double / greatest(length(a), length(b)) + case when length(b) >= 5 and contains(a, b) then 0.5 else 0 end as score from q join n using (p_brand))
select p_brand, a, b, round(least(1, score), 6)::double as score from x where score >= 0.9""")
def names_inside_texts(t: Tables) -> DataFrame:
    """Texts that hold a name of their brand, by a bonus that makes up for the other words."""
    texts = t.part.select("p_brand", F.concat(F.lower("p_type"), F.lit(" "), "p_name").alias("a"))
    pairs = similar.similar(texts, t.part.select("p_brand", F.col("p_name").alias("b")), ("p_brand",), "a", "b", 0.9, 0.5)
    return pairs.withColumn("score", S.ensemble(F.col("a"), F.col("b"), True)).where("score >= 0.9").withColumn("score", F.round("score", 6))


@query("""with c as (select user_id, event_type, max(event_id) as event_id, max(value) as value from events where event_id % 5 = 0 group by 1, 2),
b as (select * from events where event_id % 3 <> 0 and not (event_id % 7 = 0 and event_type = 'view'))
select (select count(*) from events where event_id % 4 = 1 and value > 20) as updated_by_update, (select count(*) from events where event_id % 7 = 0 and event_type = 'view') as deleted_by_delete,
  (select count(*) from c where exists (select 1 from b where b.user_id = c.user_id and b.event_type = c.event_type)) as updated_by_merge,
  (select count(*) from c where not exists (select 1 from b where b.user_id = c.user_id and b.event_type = c.event_type)) as inserted_by_merge,
  (select count(*) from b where not exists (select 1 from c where b.user_id = c.user_id and b.event_type = c.event_type)) + (select count(*) from c) as rows_after,
  (select round(coalesce(sum(value), 0), 4) from b where not exists (select 1 from c where b.user_id = c.user_id and b.event_type = c.event_type)) + (select round(sum(value), 4) from c) as sum_after""")
def rows_changed(t: Tables) -> DataFrame:
    """What an update, a delete and a merge change, and the table after the last."""
    rows, e = t.events.select("event_id", "user_id", "event_type", "value"), F.col("event_id")
    by_update = changes.counts(changes.update(rows, (e % 4 == 1) & (F.col("value") > 20), {"value": F.col("value") * 2}))
    gone = changes.delete(rows, (e % 7 == 0) & (F.col("event_type") == "view"))
    change = rows.where(e % 5 == 0).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max("value").alias("value"))
    merged = changes.merge(changes.result(gone).where(e % 3 != 0), change, ["user_id", "event_type"])
    base, put = (F.round(F.coalesce(F.sum(F.when(F.col(changes.ACTION) == changes.KEPT if kept else F.col(changes.ACTION) != changes.KEPT, F.col("value"))), F.lit(0.0)), 4) for kept in (True, False))
    after = merged.agg(F.count("*").alias("rows_after"), (base + put).alias("sum_after"))
    named = [by_update.select(F.col("updated").alias("updated_by_update")), changes.counts(gone).select(F.col("deleted").alias("deleted_by_delete")), changes.counts(merged).select(F.col("updated").alias("updated_by_merge"), F.col("inserted").alias("inserted_by_merge"))]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [*named, after])  # one row each


@query(r"""with x as (select event_id, case when event_id % 7 = 0 then 'n/a' when event_id % 11 = 0 then null else value::varchar end as value, case when event_id % 5 = 0 then '2024-13-01' else '2024-01-0' || (1 + event_id % 9) end as day, case when event_id % 50 = 1 then null when event_id % 50 = 2 then 0 else event_id end as row_id from events),
n as (select row_id, count(*) as n from x group by 1)
select event_id, case when len(e) = 0 then 'ok' else 'error' end as status, array_to_string(e, '; ') as error from (
  select event_id, list_filter([case when value = 'n/a' then 'value: no double: n/a' end, case when day = '2024-13-01' then 'day: no date: 2024-13-01' end,
    case when not coalesce(try_cast(value as double) >= 10, false) then 'value is 10 or more' end, case when row_id is null then 'row_id is null' end, case when row_id is not null and n > 1 then 'row_id is there ' || n || ' times' end], lambda v: v is not null) as e from x left join n using (row_id))""")
def quarantined_rows(t: Tables) -> DataFrame:
    """Raw values of which some are malformed: every row comes out, with what is wrong with it."""
    e = F.col("event_id")
    value = F.when(e % 7 == 0, "n/a").when(e % 11 != 0, F.col("value").cast("string"))
    day = F.when(e % 5 == 0, "2024-13-01").otherwise(F.concat(F.lit("2024-01-0"), (1 + e % 9).cast("string")))
    raw = t.events.select("event_id", value.alias("value"), day.alias("day"), F.when(e % 50 == 1, None).when(e % 50 == 2, 0).otherwise(e).alias("row_id"))
    marked = quarantine.checked(quarantine.typed(raw, {"value": "double", "day": "date"}), {"value is 10 or more": F.col("value") >= 10})
    keep = {"event_id": F.col("event_id")}
    run = lambda good: good.select("event_id", F.lit("ok").alias("status"), F.lit("").alias("error"))
    return quarantine.guarded(quarantine.unique(marked, "row_id"), run, keep)


@query("""with k as (select case when p_partkey % 2 = 0 then p_brand end as context, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) as key, min('<' || p_size || '>') as word from part where p_partkey % 5 < 2 group by 1, 2),
x as (select p_partkey, p_brand, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) as key, p_type from part)
select p_partkey, 'at (' || coalesce(m.word, g.word, upper(x.key)) || '), ' || p_type || '!' as done from x left join k m on m.context = p_brand and m.key = x.key left join k g on g.context is null and g.key = x.key""")
def phrases_replaced(t: Tables) -> DataFrame:
    """Phrases of two words, some of one brand only, in texts in capitals with marks around them."""
    key = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)))
    known = t.part.where("p_partkey % 5 < 2").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("context"), key.alias("key"), F.concat(F.lit("<"), "p_size", F.lit(">")).alias("word"))
    rows = t.part.select("p_partkey", "p_brand", F.concat(F.lit("at ("), F.upper(key), F.lit("), "), "p_type", F.lit("!")).alias("text"))
    return phrases.replaced(rows, known, "text", "p_brand", "done").select("p_partkey", "done")


@query("""select c_custkey, case when n_nationkey % 5 = 0 then null else 'found ' || n_name end as answer, case when n_nationkey % 5 = 0 then 'KeyError: ''no ' || n_name || '''' end as error from customer join nation on c_nationkey = n_nationkey""")
def lookups_once(t: Tables) -> DataFrame:
    """Each customer's nation is looked up, each nation once; every fifth lookup fails."""

    def lookup(name: str) -> str:
        if int(name.split("_")[1]) % 5 == 0:
            raise KeyError(f"no {name}")
        return f"found {name}"

    people = t.customer.join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return enrich.enrich(people, "n_name", lookup, per_second=1e6, attempts=2, with_errors=True).select("c_custkey", "answer", F.col("answer_error").alias("error"))


@query("""with a as (select 'k' || n_nationkey % 6 as key, lower(replace(n_name, '_', ' ')) as word, case when n_nationkey % 3 > 0 then lower(r_name) end as pc, n_nationkey % 3 = 2 as d from nation join region on n_regionkey = r_regionkey),
w as (select pc, key, min(word) as word from a where not d group by 1, 2 having pc is not null or count(distinct word) = 1)
select c_custkey, lower(r_name) as p, coalesce(m.word, g.word, k) as d from (select c_custkey, r_name, 'k' || c_custkey % 7 as k from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) x
  left join w m on m.pc = lower(r_name) and m.key = k left join w g on g.pc is null and g.key = k""")
def hints_spelled_out(t: Tables) -> DataFrame:
    """Hints with abbreviations that mean one district in one province and another elsewhere."""
    people = t.customer.join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = people.select("c_custkey", F.concat(F.lit("Tinh "), "r_name").alias("p"), F.concat(F.lit("K"), (F.col("c_custkey") % 7).cast("string")).alias("d"))
    return context.hints(rows, _abbreviations(t), "p", "d").select("c_custkey", *(T.normalize_hint(F.col(c)).alias(c) for c in ("p", "d")))


WARD = unicodedata.normalize("NFD", "Phường")


@query(f"""with x as (select c_custkey, c_custkey % 3 as k, c_name, n_name, split_part(c_name, '#', 1) as a, split_part(c_name, '#', 2) as b from customer join nation on c_nationkey = n_nationkey)
select c_custkey, 'so 1 ' || lower(a) || ' ' || b || ' phuong ' || lower(n_name) as words, case k when 0 then c_name when 1 then '{WARD} ' || n_name else '1, ' || c_name || ' - {WARD}' end as span,
  case k when 0 then 'Số 1 {WARD} ' || n_name when 1 then 'Số 1 ' || a || ' ' || b else 'Số ' || n_name end as rest from x""")
def raw_spans(t: Tables) -> DataFrame:
    """Words found in folded texts, cut from the raw ones, whose accents are partly composed and partly not."""
    people, k = t.customer.join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_custkey") % 3
    text = F.concat(F.lit("Số 1, "), "c_name", F.lit(f" - {WARD} "), "n_name")
    rows = people.select("c_custkey", text.alias("text"), N.raw_words(text).alias("w"), F.when(k == 0, 2).when(k == 1, 4).otherwise(1).alias("s"), F.when(k == 0, 4).when(k == 1, 6).otherwise(5).alias("e"))
    return rows.select("c_custkey", F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("words"), N.raw_slice(F.col("text"), F.col("w"), F.col("s"), F.col("e")).alias("span"), N.remaining_raw(F.col("w"), [(F.col("s"), F.col("e")), (F.lit(-1), F.lit(-1))]).alias("rest"))
