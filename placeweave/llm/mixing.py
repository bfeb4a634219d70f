"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / weight, where u comes from a hash of its id (so reruns agree) and the
weight from its quality. A source with a target of t words and s words of its own takes each document floor(t / s) times
(complete epochs); what remains of the target goes to the documents with the smallest keys, until their sizes' prefix
sum meets it. The document at the boundary is taken for its first words only, so that a source misses its target by less
than a word.

No source is sorted as a whole: keys fall into buckets in their order, the buckets' sums are added up, and only the one
bucket that holds a source's boundary is sorted. Buckets are equal in the key's logarithm, BUCKETS to a doubling, so that
whatever the weights are, one holds a share of about ln(2) / e / BUCKETS of its source at most (0.03 %). A hot source
thus costs one partial aggregation like any other.

Null text has size 0; null sources form one source, the last; null ids draw the key of an empty id. Weights that are null,
not positive or not finite put a document last, in the order of its draw. Rows with equal keys (those of one id) go by id,
then by a hash of the text; repeated rows count each for itself. An empty table gives an empty result. Columns of the
input are kept whatever their names, except that ``with_keys`` and ``mix`` replace those named as their results;
``mixed`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.llm.common import joined_small, saved

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
#: Buckets for each doubling of the key.
BUCKETS = 1024
SOURCE_WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """The quality weight: 0.05 to 1, by the share of letters and spaces among the code points."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L} ]", ""))
    return F.coalesce(F.lit(0.05) + F.lit(0.95) * plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.05))


def sample_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of the id's MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    u = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    usable = (weight > 0) & (weight < float("inf"))
    return F.when(usable, -F.log(u) / F.greatest(weight, F.lit(1e-200))).otherwise(-F.log(u) * 1e260)


def bucket_of(key: Column) -> Column:
    """Numbers that grow with the key."""
    return F.floor(F.log2(key) * BUCKETS).cast("int")


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = SOURCE_WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size; a row per source) with ``target``.

    With weights w and sizes s, targets are min(cap * s, level * w), where the level makes them sum to all sizes: in the
    order of cap * s / w, sources are capped as long as that ratio is below the level of what the capped ones leave.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (((F.row_number().over(order) - 1) % len(weights)) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("w"))
    whole = Window.partitionBy(F.lit(1))
    below = whole.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * cap).over(below), F.lit(0))
    open_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(below), F.lit(0))
    rows = rows.withColumn("level", left / open_w)
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(whole)
    most = F.lit(float(cap)) * F.col("source_size")
    return rows.select("source", "source_size", F.least(most, F.coalesce(level * F.col("w"), most)).alias("target"))


def with_keys(df: DataFrame, text: str = "text", doc_id: str = "doc_id", weight: Column | None = None) -> DataFrame:
    """Adds size, sample_key and tie, which ``mix`` needs; columns of these names are replaced."""
    weight = letter_share(F.col(text)) if weight is None else weight
    return df.withColumns({"size": word_count(F.col(text)), "sample_key": sample_key(F.col(doc_id), weight), "tie": F.xxhash64(text)})


def mix(keyed: DataFrame, doc_id: str = "doc_id", cap: int = CAP, weights: tuple[int, ...] = SOURCE_WEIGHTS) -> DataFrame:
    """``keyed`` (from ``with_keys``; read twice) with source_size, target, epochs (complete ones) and taken (words)."""
    keyed = keyed.drop("source_size", "target", "epochs", "taken")
    whole = F.struct(*(F.col(f"`{c}`") for c in keyed.columns)).alias("row")
    # From here to the last line, the input's columns travel in one, so that none can clash with a helper.
    rows = keyed.select(whole, "source", "size", "sample_key", "tie", F.col(doc_id).alias("id"), bucket_of(F.col("sample_key")).alias("bucket"))
    sums = saved(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    sources = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), cap, weights)
    has = F.col("source_size") > 0
    sources = sources.withColumn("epochs", F.when(has, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.when(has, F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).otherwise(0).cast("long"))
    sources = saved(sources.withColumnRenamed("source", "s"), "sources")
    prefix = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    edge = joined_small(prefix, sources, F.expr("source <=> s"), "inner").where("before <= rest and rest < before + words")
    edge = edge.select(F.col("source").alias("edge_source"), F.col("bucket").alias("edge"), "before")
    known = joined_small(sources, edge, F.expr("s <=> edge_source")).select("s", "source_size", "target", "epochs", "rest", "edge", F.coalesce("before", F.lit(0)).alias("before"))
    met = joined_small(rows, saved(known, "known"), F.expr("source <=> s"))
    full = F.when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")), F.col("size")).otherwise(0).cast("long")
    done = met.where("edge is null or bucket <> edge").withColumn("extra", full)
    order = Window.partitionBy("source").orderBy("sample_key", F.col("id").asc_nulls_first(), "tie", "size")
    start = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at_edge = met.where("bucket = edge").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start)).cast("long"))
    return done.unionByName(at_edge).select("row.*", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """Documents as the mix takes them: a row for each time, whole, with its columns as they are.

    The document at a source's boundary, of which ``mix`` takes some words, is taken whole if these are half of it or more, and left
    otherwise; so a source misses its target by half a document at most. A document of which the mix takes nothing goes; so does
    one without words.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = mix(saved(with_keys(docs.select(whole, "doc_id", "text", "source")).drop("text"), "keyed"))
    extra = F.col("taken") - F.col("epochs") * F.col("size")
    times = F.col("epochs").cast("int") + F.when(2 * extra >= F.col("size"), 1).otherwise(0)
    times = F.when(F.col("size") > 0, times).otherwise(0)
    return rows.where(times > 0).select("doc", F.explode(F.array_repeat(F.lit(1), times))).select("doc.*")


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    coalesce(0.05::double + 0.95::double * length(regexp_replace(text, '[^\pL ]', '', 'g')) / nullif(length(text), 0), 0.05::double) as weight,
    ((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double) as u
  from documents
), k as (select *, -ln(u) / weight as sample_key from d),
s as (select source, sum(size)::bigint as source_size from k group by source),
w as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as w from s),
r as (select *, 3.0::double * source_size / w as ratio from w),
l as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over b, 0))::double
    / (sum(w) over () - coalesce(sum(w) over b, 0))::double as level
  from r window b as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, least(3.0::double * source_size,
    coalesce(max(case when ratio > level then level end) over () * w, 3.0::double * source_size)) as target from l
), e as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as epochs from t
), x as (
  select *, case when source_size > 0 then round(target - epochs * source_size)::bigint else 0 end as rest from e
), f as (
  select k.doc_id, k.size, x.source_size, x.target, x.epochs, x.rest,
    sum(k.size) over (partition by k.source order by k.sample_key, k.doc_id rows unbounded preceding) - k.size as before
  from k join x on k.source is not distinct from x.source
)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from f
"""
