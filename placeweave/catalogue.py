"""The registry of queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave import constants as K
from placeweave.functions import scoring as C
from placeweave.functions import similarity as S
from placeweave.functions import text as T
from placeweave.functions import tokens as N
from placeweave.operators import enrich, matching, review, snapshots
from placeweave.operators import gazetteer as G
from placeweave.operators.resolve import resolve, top
from placeweave.plans.stages import small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Registers ``f(tables)`` under its name."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def divisions(t: Tables, all_nations: bool = False) -> DataFrame:
    """The gazetteer that regions, nations and suppliers stand for; nations without a supplier only if they are asked for."""
    rows = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left" if all_nations else "inner").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.coalesce(F.col("s_suppkey"), -F.col("n_nationkey")).cast("int").alias("id"), T.finalize(F.col("r_name"), True).alias("p"), T.finalize(F.col("n_name"), True).alias("d"), T.finalize(F.col("s_name"), True).alias("w"), F.col("r_name").alias("p_full"), F.col("n_name").alias("d_full"), F.col("s_name").alias("w_full"), F.concat(F.lit("S"), "r_regionkey").alias("state_code"), F.concat(F.lit("C"), "n_nationkey").alias("county_code"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    people = t.customer.join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    people = people.select(F.col("c_custkey").alias("row_id"), F.concat("c_name", F.lit(", quan "), F.translate("n_name", "_", " "), F.lit(", tinh "), "r_name").alias("address"))
    out = resolve(people, G.Gazetteer.of(divisions(t, True)))
    return out.select("row_id", "province", "district", "at_rule", F.round("confidence", 6).alias("confidence"), "quality_flag")


@query("""
select c_custkey as row_id, array_to_string(list_transform(string_split(r_name, ' '), lambda x: upper(x[1]) || lower(substr(x, 2))), ' ') as province,
  upper(n_name[1]) || lower(substr(n_name, 2)) as district, 2 as at_rule,
  round(0.91::double * case when len(string_split(r_name, ' ')) = 2 then 1.3::double else 1.1::double end, 6) as confidence, 'partial_address' as quality_flag
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""")
def resolve_exact_hierarchy(t: Tables) -> DataFrame:
    return flagship(t.spark, t.dir)


GAZ = """with dv as (select s_suppkey::int as id, lower(r_name) as p, lower(replace(n_name, '_', ' ')) as d, lower(replace(s_name, '#', '')) as w,
  r_name as p_full, n_name as d_full, s_name as w_full from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


@query(f"select doc_id, translate(text, '{K.ACCENTED}', '{K.PLAIN}') as folded from documents")
def accent_fold(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


@query(r"select page_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(url, '[,\-_]', ' ', 'g'), '[^\pL\pN_\s]', '', 'g')), '\s+', ' ', 'g')) as norm from pages")
def finalize_with_separators(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.finalize(F.col("url"), True).alias("norm"))


@query(r"select page_id, lower(trim(regexp_replace(regexp_replace(url, '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'))) as norm from pages")
def finalize_plain(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.finalize(F.col("url")).alias("norm"))


@query(r"""select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(concat('P. ', p_size, ', Q ', p_size, ' TP. X')),
  '\bp\s*\.?\s*(\d)', 'phuong \1', 'g'), '\bq\s*\.?\s*(\d)', 'quan \1', 'g'), '\bt\.?p\.?\s+', 'thanh pho ', 'g') as expanded from part""")
def structural_abbreviations(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.expand_structural(F.concat(F.lit("P. "), "p_size", F.lit(", Q "), "p_size", F.lit(" TP. X"))).alias("expanded"))


@query("select doc_id, nfc_normalize(text) as text from documents")
def nfc_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.nfc(F.col("text")).alias("text"))


@query(r"select n_nationkey, trim(regexp_replace(regexp_replace('thanh pho quan ' || lower(n_name), '(?i)^thanh\s*pho\s+', ''), '(?i)^quan\s+', '')) as name from nation")
def strip_admin_prefixes(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", T.strip_admin(F.concat(F.lit("thanh pho quan "), F.lower("n_name"))).alias("name"))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'pho ' || lower(n_name) else lower(n_name) end as name from nation")
def strip_first_prefix(t: Tables) -> DataFrame:
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("QUAN pho "), "n_name")).otherwise(F.concat(F.lit("Thi xa "), "n_name"))
    return t.nation.select("n_nationkey", T.strip_first_prefix(text).alias("name"))


@query("select p_partkey, case when p_size % 3 = 0 then p_name else p_size::varchar end as number from part")
def admin_number_normalize(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return t.part.select("p_partkey", T.admin_number(raw).alias("number"))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_mktsegment end as hint from customer")
def sanitize_hints(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.sanitize_hint(F.when(F.col("c_mktsegment") == "BUILDING", "/").otherwise(F.col("c_mktsegment"))).alias("hint"))


@query("select doc_id, substr(text, 1, 40) as a, substr(text, 41, 40) as b, substr(text, 81, 40) as c from documents")
def split_remaining_40(t: Tables) -> DataFrame:
    a, b, c = T.split_fixed(F.col("text"))
    return t.documents.select("doc_id", a.alias("a"), b.alias("b"), c.alias("c"))


@query("select p_partkey, array_to_string(list_transform(string_split(lower(p_type) || ' ' || p_name, ' '), lambda x: upper(x[1]) || lower(substr(x, 2))), ' ') as title from part")
def title_case_full_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.title_case(F.concat(F.lower("p_type"), F.lit("  "), "p_name")).alias("title"))


@query("select s_suppkey, concat_ws(', ', s_name, nullif(n_name, 'NATION_3'), r_name) as line from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def concat_nonempty_parts(t: Tables) -> DataFrame:
    rows = t.supplier.join(small(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("s_suppkey", T.concat_nonempty(F.col("s_name"), F.when(F.col("n_name") == "NATION_3", " ").otherwise(F.col("n_name")), F.lit(""), F.col("r_name")).alias("line"))


@query("""select p_partkey, case p_size % 4 when 0 then 'ha noi' when 1 then 'ho chi minh' when 2 then 'can tho' end as province,
  case p_size % 4 when 0 then 'quan ' || p_size when 1 then 'dong da' end as district from part""")
def context_regex_extract(t: Tables) -> DataFrame:
    m = F.col("p_size") % 4
    text = F.when(m == 0, F.concat(F.lit("so 1 quan "), "p_size", F.lit(" hanoi"))).when(m == 1, F.lit("dongda Sai  Gon")).when(m == 2, F.lit("xx can tho")).otherwise(F.lit("dong da"))
    province, district = T.quick_context(text)
    return t.part.select("p_partkey", province.alias("province"), district.alias("district"))


@query(r"select c_custkey, regexp_matches(case when c_custkey % 2 = 0 then c_name || ' HBT' else lower(c_name) end, '\b[A-Z]{2,4}\b') and c_custkey % 3 <> 0 as flag from customer")
def needs_iterative_flag(t: Tables) -> DataFrame:
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" HBT"))).otherwise(F.lower("c_name"))
    return t.customer.select("c_custkey", T.needs_iteration(text, F.when(F.col("c_custkey") % 3 == 0, "ha noi")).alias("flag"))


@query(r"select doc_id, regexp_matches(text, '(?i)\b(cong\s*ty|cty|chi\s*nhanh|van\s*phong|benh\s*vien|truong|ngan\s*hang|ubnd|kho\s*bac|so\s+y\s*te|dt:|dd:|tel:|phone:|\d{10,})\b') as noise from documents")
def noise_filter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.is_noise(F.col("text")).alias("noise"))


@query("""select p_partkey, len(string_split(p_name || ', ' || p_type, ', ')) as pieces, '0,0,1' as segments, round(case when p_size > 25 then 0.85 else 1.1 end::double, 2) as mult from part""")
def delimiter_segments(t: Tables) -> DataFrame:
    text = F.concat("p_name", F.lit(", "), "p_type")
    seg = N.segment_ids(text)
    start = F.when(F.col("p_size") > 25, 1).otherwise(0)
    return t.part.select("p_partkey", F.size(N.delimiter_pieces(text)).cast("long").alias("pieces"), F.array_join(F.transform(seg, lambda x: x.cast("string")), ",").alias("segments"), N.delimiter_score(seg, start, start + 2).alias("mult"))


@query("""with x as (select p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') as w from part), n as (select unnest(range(1, 4)) as n)
select p_partkey, n::int as n, i::int as s, (i + n)::int as e, array_to_string(w[i + 1 : i + n], ' ') as ngram from x, n, lateral (select unnest(range(0, greatest(len(w) - n + 1, 0))) as i)""")
def ngrams_1_3(t: Tables) -> DataFrame:
    items = N.indexed(N.words(F.concat("p_name", F.lit(" "), F.lower("p_type"))))
    return t.part.select("p_partkey", items.alias("items")).select("p_partkey", F.explode(N.ngrams_of("items")).alias("g")).select("p_partkey", "g.n", "g.s", "g.e", "g.ngram")


@query("select p_partkey, p_size::varchar as ngram, p_size % 2 = 0 as kw from part")
def ngram_prev_keyword(t: Tables) -> DataFrame:
    words = F.array(F.lit("pho"), F.when(F.col("p_size") % 2 == 0, "quan").otherwise("so"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", N.indexed(words).alias("items")).select("p_partkey", F.explode(N.ngrams_of("items", 1)).alias("g")).where("g.s = 2").select("p_partkey", "g.ngram", "g.kw")


@query("""select p_partkey, p_size::varchar || '|' || split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) as districts, p_name as wards from part""")
def explicit_patterns(t: Tables) -> DataFrame:
    words = N.words(F.concat(F.lit("12 phuong "), "p_name", F.lit(" quan "), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(" x tp "), "p_name"))
    found = N.explicit_patterns(words)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), "|")
    return t.part.select("p_partkey", names(found["districts"]).alias("districts"), names(found["wards"]).alias("wards"))


@query("select p_partkey, 1 as pos, -1 as none from part")
def phrase_position(t: Tables) -> DataFrame:
    words = N.words(F.concat(F.lit("so "), "p_name", F.lit(" x")))
    return t.part.select("p_partkey", N.phrase_position(words, F.col("p_name")).cast("int").alias("pos"), N.phrase_position(words, F.lit("not there")).cast("int").alias("none"))


@query(r"select doc_id, array_to_string(list_transform(list_filter(range(0, len(w)), lambda i: not (i >= 2 and i < 5)), lambda i: w[i + 1]), ' ') as rest from (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from documents)")
def remaining_tokens(t: Tables) -> DataFrame:
    words = N.words(F.col("text"))
    return t.documents.select("doc_id", N.remaining(words, [(F.lit(2), F.lit(5)), (F.lit(-1), F.lit(-1))]).alias("rest"))


NAMES = "with n as (select distinct p_name as a from part)"
PAIRS = "with x as (select x.p_partkey, x.p_name as a, y.p_name as b from part x join part y on y.p_partkey = x.p_partkey + 1)"


def _name_pairs(t: Tables) -> DataFrame:
    """Each part's name with that of the next part: as many pairs as parts."""
    after = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return t.part.select("p_partkey", F.col("p_name").alias("a")).join(after, "p_partkey")


@query(PAIRS + " select p_partkey, levenshtein(a, b)::int as d, case when a = b then 1.0 else round(1 - levenshtein(a, b)::double / greatest(length(a), length(b)), 6) end::double as sim from x")
def levenshtein_similarity(t: Tables) -> DataFrame:
    return _name_pairs(t).select("p_partkey", S.distance(F.col("a"), F.col("b")).alias("d"), F.round(S.similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query(PAIRS + " select p_partkey, round(len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::double / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))), 6) as j from x")
def token_jaccard(t: Tables) -> DataFrame:
    return _name_pairs(t).select("p_partkey", F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


@query(PAIRS + """, y as (select p_partkey, a, case when p_partkey % 3 = 0 then b else split_part(case when p_partkey % 3 = 1 then a else b end, ' ', 2) end as b from x)
select p_partkey, round(least(1, 1 - levenshtein(a, b)::double / greatest(length(a), length(b)) + case when length(b) >= 5 and contains(a, b) then 0.25 else 0 end), 6)::double as score from y""")
def ensemble_fuzzy(t: Tables) -> DataFrame:
    """Names against the next part's name, against their own second word and against the next name's."""
    k = F.col("p_partkey") % 3
    other = F.when(k == 0, F.col("b")).otherwise(F.split_part(F.when(k == 1, F.col("a")).otherwise(F.col("b")), F.lit(" "), F.lit(2)))
    return _name_pairs(t).select("p_partkey", F.round(S.ensemble(F.col("a"), other), 6).alias("score"))


@query(NAMES + ", t as (select a, unnest(string_split(a, ' ')) as k from n) select x.a, y.a as b, count(*) as shared from t x join (select distinct * from t) y using (k) group by 1, 2")
def token_overlap_candidates(t: Tables) -> DataFrame:
    names = t.part.select("p_name").distinct()
    return matching.token_overlap(names.withColumnRenamed("p_name", "a"), names.withColumnRenamed("p_name", "b"), "a", "b")


FUZZY = """with n as (select distinct p_brand, p_name as name from part), q as (select distinct p_brand, substr(p_name, 2) as ngram from part),
s as (select q.p_brand, q.ngram, n.name as match, case when q.ngram = n.name then 1.0 else least(1, 1 - levenshtein(q.ngram, n.name)::double / greatest(length(q.ngram), length(n.name)) + case when length(n.name) >= 5 and contains(q.ngram, n.name) then 0.25 else 0 end) end::double as score from q join n using (p_brand)),
r as (select *, rank() over (partition by p_brand, ngram order by score desc) as r from s where score >= 0.85)"""


@query(FUZZY + " select p_brand, ngram, match, round(score, 6) as score from r where r = 1")
def fuzzy_best_match_scoped(t: Tables) -> DataFrame:
    names = t.part.select("p_brand", F.col("p_name").alias("name"))
    grams = t.part.select("p_brand", F.substr("p_name", F.lit(2)).alias("ngram"))
    return matching.best_matches(grams, names, ("p_brand",), threshold=0.85).select("p_brand", "ngram", "match", F.round("score", 6).alias("score"))


@query("""with st as (select p_brand as p, p_type as d, p_name as street, min(p_partkey)::int as id from part group by 1, 2, 3),
q as (select p_partkey as row_id, case when p_partkey % 2 = 0 then p_name else substr(p_name, 2) end as text, p_brand as p, case when p_partkey % 3 = 0 then null else p_type end as d from part),
s as (select q.*, street, id, case when text = street then 1.0 else least(1, 1 - levenshtein(text, street)::double / greatest(length(text), length(street)) + case when length(street) >= 5 and contains(text, street) then 0.25 else 0 end) end::double as score
  from q join st on q.p = st.p and (q.d is null or q.d = st.d)),
f as (select *, row_number() over (partition by row_id order by (text = street) desc, score desc, id) as r from s where score >= 0.9)
select q.row_id, f.street, round(f.score, 6) as street_score from q left join (select * from f where r = 1) f using (row_id)""")
def street_lookup_exact_then_fuzzy(t: Tables) -> DataFrame:
    streets = t.part.groupBy(F.col("p_brand").alias("p"), F.col("p_type").alias("d"), F.col("p_name").alias("street")).agg(F.min("p_partkey").cast("int").alias("id"))
    text = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.substr("p_name", F.lit(2)))
    rows = t.part.select(F.col("p_partkey").alias("row_id"), text.alias("text"), F.col("p_brand").alias("p"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("d"))
    return matching.street_lookup(rows, streets).select("row_id", "street", F.round("street_score", 6).alias("street_score"))


@query(GAZ + " select c_custkey, arg_min(d_full, id) as d_full, min(id)::int as id from (select c_custkey, dv.* from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join dv on dv.p = lower(r_name) and dv.d = lower(replace(n_name, '_', ' '))) group by 1")
def exact_gazetteer_lookup(t: Tables) -> DataFrame:
    people = t.customer.join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = people.select("c_custkey", T.finalize(F.col("r_name"), True).alias("p"), T.finalize(F.col("n_name"), True).alias("d"))
    return G.exact_match(rows, divisions(t), ("p", "d")).select("c_custkey", "d_full", "id")


@query(GAZ + """ , q as (select id as k, p, case when id % 4 = 0 then null when id % 4 = 1 then d || 'x' else d end as d, case when id % 4 = 3 then w end as w from dv)
select k, case when w is not null then exists (select 1 from dv where dv.p = q.p and dv.d = q.d and dv.w = q.w) when d is not null then exists (select 1 from dv where dv.p = q.p and dv.d = q.d) else exists (select 1 from dv where dv.p = q.p) end as valid from q""")
def hierarchy_validation(t: Tables) -> DataFrame:
    dv, m = divisions(t), F.col("id") % 4
    rows = dv.select(F.col("id").alias("k"), "p", F.when(m == 1, F.concat("d", F.lit("x"))).when(m != 0, F.col("d")).alias("d"), F.when(m == 3, F.col("w")).alias("w"))
    return G.validity(rows, dv).select("k", "valid")


@query(GAZ + " select distinct p, d from dv")
def children_of_scope(t: Tables) -> DataFrame:
    return G.children(divisions(t), ("p",), "d")


@query(GAZ + " , x as (select *, 'ward ' || id % 10 as v from dv) select p, v, arg_min(d, id) as d, array_to_string(list_sort(list(distinct d)), '|') as all_d from x group by 1, 2")
def parents_all(t: Tables) -> DataFrame:
    """Ten ward names, each of which many districts of a province have."""
    dv = divisions(t).withColumn("v", F.concat(F.lit("ward "), F.col("id") % 10))
    return G.parents(dv, ("p", "v"), "d").select("p", "v", "d", F.array_join("all_d", "|").alias("all_d"))


@query(GAZ + " , x as (select p, case when id % 7 = 0 then p else d end as d from dv) select distinct p as name from x where p in (select d from x)")
def name_collision(t: Tables) -> DataFrame:
    """Every seventh division's district has its province's name."""
    return G.collisions(divisions(t).withColumn("d", F.when(F.col("id") % 7 == 0, F.col("p")).otherwise(F.col("d"))))


@query(GAZ + " , x as (select d as n, 'district' as l from dv union all select case when id % 5 = 0 then d else w end, 'ward' from dv) select n as name, string_agg(distinct l, '|' order by l) as levels from x group by 1 having count(distinct l) > 1")
def ambiguous_names(t: Tables) -> DataFrame:
    """Every fifth division's ward has its district's name."""
    dv = divisions(t).select("d", F.when(F.col("id") % 5 == 0, F.col("d")).otherwise(F.col("w")).alias("w"))
    return G.ambiguous_names(dv).select("name", F.array_join("levels", "|").alias("levels"))


ABBR = [("hn", "ha noi", None, None), ("hn", "ha nam", "ha nam", None), ("tx", "thanh xuan", "ha noi", None), ("db", "dien bien", None, None), ("db", "dien ban", "ha noi", "ba dinh"), ("dn", "da nang", None, None), ("dn", "dong nai", None, None)]


@query("""with a as (select 'k' || n_nationkey % 6 as key, lower(replace(n_name, '_', ' ')) as word, case when n_nationkey % 3 > 0 then lower(r_name) end as pc, case when n_nationkey % 3 = 2 then 'd' || n_nationkey % 2 end as dc from nation join region on n_regionkey = r_regionkey),
x as (select key, (dc is not null)::int + (pc is not null)::int as rank, min(word) as word, count(distinct word) as n from a where coalesce(pc, 'asia') = 'asia' and coalesce(dc, 'd1') = 'd1' group by 1, 2)
select key, arg_max(word, rank) as word from x where rank > 0 or n = 1 group by 1""")
def abbreviation_precedence(t: Tables) -> DataFrame:
    return G.abbreviation_map(_abbreviations(t), "asia", "d1")


def _abbreviations(t: Tables) -> DataFrame:
    """Six keys for the nations, of which some hold everywhere, some in a region and some in one half of it."""
    nations, k = t.nation.join(small(t.region), F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_nationkey")
    names = [F.concat(F.lit("k"), k % 6), T.finalize(F.col("n_name"), True), F.when(k % 3 > 0, F.lower("r_name")), F.when(k % 3 == 2, F.concat(F.lit("d"), k % 2))]
    return nations.select(*(c.cast("string").alias(name.split()[0]) for c, name in zip(names, G.ABBREVIATIONS.split(", "), strict=True)))


@query("select o_orderkey, word from orders join (values ('dn', 'da nang'), ('dn', 'dong nai'), ('hn', 'ha noi'), ('db', 'dien bien')) v(key, word) on key = case o_orderkey % 3 when 0 then 'dn' when 1 then 'hn' else 'tx' end")
def abbreviation_fanout(t: Tables) -> DataFrame:
    key = F.when(F.col("o_orderkey") % 3 == 0, "dn").when(F.col("o_orderkey") % 3 == 1, "hn").otherwise("tx")
    return G.province_candidates(t.orders.select("o_orderkey", key.alias("key")), t.spark.createDataFrame(ABBR, G.ABBREVIATIONS)).select("o_orderkey", "word")


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and coalesce(nullif(d.source, 'src1'), '') = coalesce(case when l.quality = 1 then d.source end, ''))")
def anti_join_unprocessed(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source")
    done = t.labels.join(docs, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("source")).alias("source"))
    return review.unprocessed(docs.select("doc_id", F.nullif("source", F.lit("src1")).alias("source")), done, ["doc_id", "source"]).select("doc_id")


@query(GAZ + """, x as (select c_custkey, lower(r_name) as p, case c_custkey % 4 when 0 then null when 1 then n_name || ' x' else lower(replace(n_name, '_', ' ')) end as d from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select c_custkey, coalesce((select p_full from dv where dv.p = x.p order by id limit 1), '') as p_full, coalesce((select d_full from dv where dv.p = x.p and dv.d = x.d order by id limit 1), '') as d_full, '' as w_full from x""")
def correlated_full_names(t: Tables) -> DataFrame:
    """Full names of what is known of customers' nations: some have no district, some one that does not exist."""
    people, k = t.customer.join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(small(t.region), F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_custkey") % 4
    district = F.when(k == 1, F.concat("n_name", F.lit(" x"))).when(k > 1, T.finalize(F.col("n_name"), True))
    rows = people.select("c_custkey", T.finalize(F.col("r_name"), True).alias("p"), district.alias("d"), F.lit(None).cast("string").alias("w"))
    return G.full_names(rows, divisions(t)).select("c_custkey", "p_full", "d_full", "w_full")


def _moves(t: Tables) -> DataFrame:
    note = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Nhập toàn bộ "), "w")).when(F.col("id") % 3 == 1, F.concat(F.lit("("), "d", F.lit(") Đổi tên"))).otherwise("khác")
    return divisions(t).where("id % 2 = 0").select(F.upper("p_full").alias("old_province"), F.upper("d_full").alias("old_district"), F.upper("w_full").alias("old_ward"), F.concat(F.lit("new "), "p").alias("new_province"), F.concat(F.lit("new "), "w").alias("new_ward"), note.alias("note"))


@query(GAZ + """ , m as (select p_full, d_full, w_full, 'new ' || p as np, 'new ' || w as nw, case id % 3 when 0 then 'Nhập toàn bộ ' || w when 1 then '(' || d || ') Đổi tên' else 'khác' end as note, case id % 3 when 0 then 1 when 1 then 2 else 4 end as pr from dv where id % 2 = 0),
r as (select id as row_id, p_full, case when id % 5 = 0 then null else d_full end as d_full, case when id % 5 in (0, 1) then null else w_full end as w_full from dv),
x as (select row_id, np, nw, note, pr from r join m on r.w_full is not null and m.w_full = r.w_full and m.d_full = r.d_full and m.p_full = r.p_full
  union all select row_id, np, nw, note, pr from r join m on r.w_full is null and m.d_full = r.d_full and m.p_full = r.p_full
  union all select distinct row_id, np, null, note, pr from r join m on r.w_full is null and r.d_full is null and m.p_full = r.p_full)
select row_id, coalesce(string_agg(np || '>' || coalesce(nw, '') || '>' || note, '|' order by pr, nw nulls first, np, note), '') as moved from r left join x using (row_id) group by 1""")
def migration_cascade(t: Tables) -> DataFrame:
    m = F.col("id") % 5
    rows = divisions(t).select(F.col("id").alias("row_id"), "p_full", F.when(m != 0, F.col("d_full")).alias("d_full"), F.when(m > 1, F.col("w_full")).alias("w_full"))
    out = G.migrations_of(rows, _moves(t))
    return out.select("row_id", F.array_join(F.transform("new_addresses", lambda x: F.concat_ws(">", x["new_province"], F.coalesce(x["new_ward"], F.lit("")), x["note"])), "|").alias("moved"))


@query("select o_orderpriority, o_orderkey, row_number() over (partition by o_custkey order by case when o_orderpriority = '1-URGENT' then 1 when o_orderpriority = '2-HIGH' then 2 else 4 end, o_orderkey)::int as n from orders")
def migration_priority(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    note = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Nhập toàn bộ xã "), key)).when(F.col("o_orderpriority") == "2-HIGH", F.concat(key, F.lit(" Đổi tên"))).otherwise(F.col("o_orderpriority"))
    return t.orders.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(G.migration_priority(note), "o_orderkey"))).select("o_orderpriority", "o_orderkey", "n")


@query("""select l_suppkey as old_province, l_returnflag as new_province, count(distinct l_partkey) as wards, (select count(distinct l_partkey) from lineitem b where b.l_suppkey = a.l_suppkey) as all_wards,
  case when count(distinct l_partkey) = (select count(distinct l_partkey) from lineitem b where b.l_suppkey = a.l_suppkey) then 'whole' else 'partial' end as kind from lineitem a group by 1, 2""")
def migration_whole_or_partial(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("old_province"), F.col("l_returnflag").alias("new_province"), F.col("l_partkey").alias("old_ward"))
    return G.whole_or_partial(rows).select("old_province", "new_province", "wards", "all_wards", "kind")


@query("""with r as (select quality + 2 * toxic as r from labels) select count(*) as total, count(*) filter (r = 0) as rating_0, count(*) filter (r = 1) as rating_1, count(*) filter (r = 2) as rating_2, count(*) filter (r = 3) as rating_3,
  round(100.0::double * count(*) filter (r = 0) / count(*), 4) as pct_0, round(100.0::double * count(*) filter (r = 1) / count(*), 4) as pct_1, round(100.0::double * count(*) filter (r = 2) / count(*), 4) as pct_2, round(100.0::double * count(*) filter (r = 3) / count(*), 4) as pct_3 from r""")
def rating_distribution(t: Tables) -> DataFrame:
    return review.distribution(t.labels.select((F.col("quality") + 2 * F.col("toxic")).alias("user_rating")))


@query("select r::int as user_rating, round(coalesce(avg(value), 0), 6) as mean from range(0, 4) x(r) left join events on user_id % 5 = r group by 1")
def rating_avg_confidence(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 5).cast("int").alias("user_rating"), F.col("value").alias("confidence_score"))
    return review.average_by_rating(rows.where("user_rating < 4")).select("user_rating", F.round("mean", 6).alias("mean"))


@query("select event_id, user_id, (select count(*) from events) as total, 70 < (select count(*) from events) as has_more from events order by ts desc, event_id limit 50 offset 20")
def review_page(t: Tables) -> DataFrame:
    return review.page(t.events.select("event_id", "user_id", "ts"), [F.desc("ts"), F.asc("event_id")], 50, 20).select("event_id", "user_id", "total", "has_more")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, coalesce(nullif(event_type, 'click'), '') order by ts desc, event_id desc) as n from events) where n = 1")
def rating_upsert_latest(t: Tables) -> DataFrame:
    rows = t.events.withColumn("k", F.nullif("event_type", F.lit("click")))
    return review.upsert_latest(rows, ["user_id", "k"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@query("""with e as (select user_id, event_id % 4 as r from events) select user_id, count(*) as total_reviews, count(*) filter (r = 0) as rating_0_count, count(*) filter (r = 1) as rating_1_count, count(*) filter (r = 2) as rating_2_count, count(*) filter (r = 3) as rating_3_count,
  round(100.0::double * (count(*) filter (r in (1, 2)))::double / count(*), 4) as accuracy_rate from e group by 1""")
def session_rollup(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", (F.col("event_id") % 4).alias("user_rating"))
    return review.sessions(rows, "user_id").drop("start_time", "end_time")


@query("select n_nationkey, n_name from nation union all select 99, 'NATION_NEW'")
def insert_if_absent(t: Tables) -> DataFrame:
    fresh = t.spark.createDataFrame([(5, "NATION_5"), (99, "NATION_NEW"), (99, "NATION_NEW")], "n_nationkey int, n_name string")
    return review.insert_absent(t.nation.select("n_nationkey", "n_name"), fresh, ["n_name"])


@query("select o_custkey, o_orderpriority, o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def snapshot_dedup_latest(t: Tables) -> DataFrame:
    return snapshots.merge_latest(t.orders, ["o_custkey", "o_orderpriority"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("select s_nationkey, string_agg(s_name, ', ' order by s_name) as names, count(*) as n from supplier group by 1 having count(*) > 1")
def having_group_concat(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_nationkey").agg(F.concat_ws(", ", F.array_sort(F.collect_list("s_name"))).alias("names"), F.count("*").alias("n")).where("n > 1")


@query("""with a as (select *, row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice desc, l_orderkey, l_linenumber) as n from lineitem), b as (select *, row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber) as m from a where n <= 5)
select l_returnflag, l_linestatus, l_orderkey, l_linenumber, n::int as n, m::int as m from b where m <= 3""")
def beam_topk(t: Tables) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    first = top(t.lineitem, ["l_returnflag", "l_linestatus"], order, 5, "n")
    return top(first, ["l_returnflag"], order, 3, "m").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "n", "m")


@query("select p_partkey, row_number() over (partition by p_brand order by p_size desc, case p_type when 'LARGE' then 3 when 'SMALL' then 2 else 1 end desc, p_partkey)::int as n from part")
def stable_multikey_rank(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_type") == "LARGE", 3).when(F.col("p_type") == "SMALL", 2).otherwise(1)
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), F.desc(kind), "p_partkey")).alias("n"))


@query("select p_partkey, round(case when max(p_size) over w > min(p_size) over w then 0.8::double + 0.2::double * (p_size - min(p_size) over w) / (max(p_size) over w - min(p_size) over w) else 1 end, 6) as f from part window w as (partition by p_brand, p_type)")
def position_adjust(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand", "p_type")
    return t.part.select("p_partkey", F.round(C.position_factor(F.col("p_size"), F.min("p_size").over(w), F.max("p_size").over(w)), 6).alias("f"))


@query("""select p_partkey, 0.75::double as ratio, round(case when p_size > 25 then 1.0 else 0.5 end::double, 6) as continuity, 0.625::double as weighted, round((0.75 * 0.4 + case when p_size > 25 then 1.0 else 0.5 end * 0.3 + 0.625 * 0.3)::double, 6) as score,
  case when p_size > 25 then 1.1 else 1.05 end::double as multiplier from part""")
def token_coverage_score(t: Tables) -> DataFrame:
    words = F.when(F.col("p_size") > 25, F.array(*map(F.lit, ("a", "b", "c", "x")))).otherwise(F.array(*map(F.lit, ("a", "x", "b", "c"))))
    return t.part.select("p_partkey", C.coverage(words, F.lit("a b"), F.lit("c b")).alias("x")).select("p_partkey", *(F.round(f"x.{c}", 6).alias(c) for c in ("ratio", "continuity", "weighted", "score", "multiplier")))


@query("""select p_partkey, case when p_size >= 6 then 2.0 when p_size = 5 then 1.7 when p_size = 4 then 1.3 when p_size = 3 then 1.1 else 1.0 end::double as bonus,
  round(case when p_size = 2 then 1.0::double else 0.7::double + 0.2::double * least(p_size, 2) / greatest(p_size, 2) end, 6) as penalty from part""")
def coverage_bonus_and_penalty(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", C.token_bonus(F.col("p_size")).alias("bonus"), F.round(C.length_penalty(F.lit(0), F.col("p_size"), F.lit("two words")), 6).alias("penalty"))


@query("""with x as (select event_id % 4 as r, round(value / 100, 6) as s from events) select case when r = 3 and s >= 0.8 then 'full_address' when r = 2 and s >= 0.6 then 'partial_address' when r = 1 and s >= 0.6 then 'province_only' else 'failed' end as flag, count(*) as n from x group by 1""")
def quality_flag_histogram(t: Tables) -> DataFrame:
    flag = C.quality_flag(F.col("event_id") % 4, F.round(F.col("value") / 100, 6))
    return t.events.groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))


@query("""select event_id, round_even(least(1, (0.5::double * 0.9 + 0.3::double * case event_id % 4 when 3 then 0.9 when 2 then 0.7 else 0.5 end + 0.2::double * (event_id % 2)) * case event_id % 3 when 0 then 1.0 when 1 then 0.7 else 0.8 end), 3)::double as c,
  case when event_id % 5 < 1 then 1.0 when event_id % 5 <= 3 then 0.6 else 0.3 end::double as near from events""")
def confidence_and_proximity(t: Tables) -> DataFrame:
    e = F.col("event_id")
    source = F.when(e % 3 == 0, "db_exact_match").when(e % 3 == 1, "street_based").otherwise("other")
    gap = (e % 5).cast("int")
    c = C.confidence(F.lit(0.9), F.lit(0.9), F.lit(0.0), e % 4, e % 2 == 1, source)
    return t.events.select("event_id", c.alias("c"), C.proximity((F.lit(0), F.lit(1)), (1 + gap, 2 + gap), (F.lit(-1), F.lit(-1))).alias("near"))


@query("select count(distinct r_regionkey) as provinces, count(distinct n_nationkey) as districts, count(s_suppkey) as wards, count(s_suppkey) filter (s_suppkey % 2 = 0) as streets from region join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey")
def nested_tree_counts(t: Tables) -> DataFrame:
    s = t.supplier.groupBy("s_nationkey").agg(F.collect_list("s_name").alias("ward"), F.collect_list(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name"))).alias("street"))
    d = t.nation.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("district"), "ward", "street")).alias("districts"))
    return snapshots.tree_counts(t.region.join(d, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("province"), "districts")).select("provinces", *(F.col(c).cast("long") for c in ("districts", "wards", "streets")))


@query("select unnest(generate_series(date_trunc('month', min(o_orderdate))::timestamp, max(o_orderdate)::timestamp, interval 1 month))::date as month from orders")
def month_sequence(t: Tables) -> DataFrame:
    bounds = t.orders.agg(F.min("o_orderdate").cast("date").cast("string").alias("a"), F.max("o_orderdate").cast("date").cast("string").alias("b")).first()
    return snapshots.months(t.spark, bounds["a"], bounds["b"])


@query("""with x as (select case when quality is not null then lang end as tp, case when toxic = 1 then source end as td, case when d.doc_id % 3 = 0 then 'en' else lang end as p, case when d.doc_id % 5 = 0 then null else source end as d, n_chars / 1000.0::double as c from documents d left join labels using (doc_id))
select count(*) as total, round((count(*) filter (tp = p))::double / count(tp), 6) as province_accuracy, round((count(*) filter (td = d))::double / count(td), 6) as district_accuracy, round((count(*) filter (tp = p and td = d))::double / count(td), 6) as full_accuracy, round(avg(c), 4) as mean_confidence from x""")
def accuracy_metrics(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    e = F.col("doc_id")
    rows = rows.select(F.when(F.col("quality").isNotNull(), F.col("lang")).alias("truth_p"), F.when(F.col("toxic") == 1, F.col("source")).alias("truth_d"), F.when(e % 3 == 0, "en").otherwise(F.col("lang")).alias("p"), F.when(e % 5 != 0, F.col("source")).alias("d"), (F.col("n_chars") / 1000.0).alias("confidence"))
    return review.accuracy(rows).select("total", *(F.round(c, 6).alias(c) for c in ("province_accuracy", "district_accuracy", "full_accuracy")), F.round("mean_confidence", 4).alias("mean_confidence"))


@query("""with x as (select lang as tp, source as td, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then 'en' else lang end as p, case when doc_id % 7 = 0 then null else source end as d from documents)
select count(*) as total, count(*) filter (p is null) as no_match, count(*) filter (p <> tp) as wrong_province, count(*) filter (p = tp and d is distinct from td) as wrong_district from x""")
def failure_taxonomy(t: Tables) -> DataFrame:
    e = F.col("doc_id") % 4
    return review.failures(t.documents.select(F.col("lang").alias("truth_p"), F.col("source").alias("truth_d"), F.when(e == 1, "en").when(e != 0, F.col("lang")).alias("p"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("d")))


@query("select count(*) as total, count(quality) as mapped, round(100.0::double * count(quality) / count(*), 4) as pct from documents left join labels using (doc_id)")
def mapped_rate(t: Tables) -> DataFrame:
    return review.mapped_rate(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality")


@query("select count(*) as total, count(*) filter (value > 50) as success, count(*) filter (not value > 50) as failed, round((count(*) filter (value > 50))::double / count(*), 6) as success_rate from events")
def status_counters(t: Tables) -> DataFrame:
    from placeweave.plans.pipelines import status_counts

    return status_counts(t.events.select(F.when(F.col("value") > 50, "success").otherwise("failed").alias("status"))).withColumn("success_rate", F.round("success_rate", 6))


@query("""with x as (select n_nationkey, lower(replace(n_name, '_', ' ')) as v, n_nationkey % 3 as m from nation)
select n_nationkey, 'ha noi' as p, case when m = 0 then v end as d, case when m > 0 then v end as w, case when m = 0 then 2 else 3 end as at_rule, 'osm_nominatim' as source, 0.725::double as confidence from x
union all select n_nationkey, 'ha noi', v, null, 2, 'osm_nominatim_alt', 0.6525::double from x where m > 0""")
def json_candidates(t: Tables) -> DataFrame:
    field = F.when(F.col("n_nationkey") % 3 == 0, "county").otherwise("suburb")
    answer = F.concat(F.lit('{"importance": 0.5, "address": {"city": "Thanh pho Hà Nội", "'), field, F.lit('": "Quan '), F.translate("n_name", "_", " "), F.lit('"}}'))
    out = enrich.nominatim_candidates(t.nation.select("n_nationkey", answer.alias("answer")))
    return out.select("n_nationkey", "p", "d", "w", "at_rule", "source", F.round("confidence", 6).alias("confidence"))


@query(r"""select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, len(regexp_extract_all(html, '(?i)<a\s'))::int as links, len(regexp_extract_all(html, '(?i)<td[\s>]'))::int as cells from pages""")
def page_scrape(t: Tables) -> DataFrame:
    from placeweave.sources.readers import links_and_cells

    return links_and_cells(t.pages.select("page_id", "html")).select("page_id", "title", "links", "cells")


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


from placeweave import catalogue_more  # noqa: E402, F401  (registers its queries above)
