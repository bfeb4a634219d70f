"""The resolver: free-text addresses to province, district and ward, one row out for each row in.

A staged beam search, each stage a join with the gazetteer and a top-k window: provinces (from a hint, abbreviations or
n-grams), districts within each province, wards within each district, parents inferred where only a child is named; then
validity, scores, the winner, and its output format. N-grams are matched as distinct (scope, n-gram) pairs, so repeated
wording costs once. Every stage is keyed by the row's id; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave import constants as K
from placeweave.functions import scoring as C
from placeweave.functions import similarity as S
from placeweave.functions import text as T
from placeweave.functions import tokens as N
from placeweave.operators import gazetteer as G
from placeweave.operators.context import hints
from placeweave.operators.matching import best_matches
from placeweave.plans.stages import small, spread, staged


def prepare(df: DataFrame, address: str = "address", province_hint: str | None = None, district_hint: str | None = None, row_id: str = "row_id") -> DataFrame:
    """row_id, raw, norm, tokens (array<struct<i, t>>), seg, hp, hd, explicit (struct of districts and wards)."""
    hint = lambda c: T.normalize_hint(F.col(c)) if c else F.lit(None).cast("string")
    # Each piece between delimiters is finalised by itself, so a token's piece is known and none spans two.
    folded = T.fold_accents(T.expand_structural(T.nfc(F.coalesce(F.col(address), F.lit("")))))
    out = df.select(F.col(row_id).alias("row_id"), F.col(address).alias("raw"), folded.alias("folded"), hint(province_hint).alias("hp"), hint(district_hint).alias("hd"))
    out = out.withColumn("words", F.flatten(F.transform(N.delimiter_pieces(F.col("folded")), N.words))).withColumn("seg", N.segment_ids(F.col("folded")))
    return out.select("row_id", "raw", F.array_join("words", " ").alias("norm"), N.indexed(F.col("words")).alias("tokens"), "seg", "hp", "hd", N.explicit_patterns(F.col("words")).alias("explicit"))


def _exploded(df: DataFrame, items: str, keep: list[str], most: int = 3) -> DataFrame:
    """n-grams of up to ``most`` words, and of four those with the words of a name in FOUR_WORDS."""
    grams = df.select(*keep, F.explode(N.ngrams_of(items, max(most, 4))).alias("g")).select(*keep, "g.*")
    four = F.array_join(F.array_sort(F.split("ngram", " ")), " ").isin(*(" ".join(sorted(x.split())) for x in K.FOUR_WORDS))
    return grams.where((F.col("n") <= most) | ((F.col("n") == 4) & four))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, ordinal: str) -> DataFrame:
    """The first ``k`` rows of each group in order, numbered: Spark keeps no more than these of a group before it shuffles."""
    return df.withColumn(ordinal, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(ordinal) <= k)


def _nearest(start: str, end: str) -> list[Column]:
    """Of a name's n-grams that score the same: equal ones before those that contain it or are like it, then the last, then the
    shortest, so that the name's place does not depend on the order in which rows come."""
    return [F.desc("exact"), F.desc(end), F.desc(start)]


def _drop_spans(items: Column, spans: list[tuple[str, str]]) -> Column:
    def outside(x: Column) -> Column:
        return reduce(lambda a, b: a & b, ((F.col(s) < 0) | (x["i"] < F.col(s)) | (x["i"] >= F.col(e)) for s, e in spans))

    return F.filter(items, outside)


def _expand(items: Column, words: Column) -> Column:
    """Abbreviated tokens spelled out; each word keeps its source token's place."""
    def one(x: Column) -> Column:
        return F.transform(F.split(F.coalesce(F.try_element_at(words, x["t"]), x["t"]), " "), lambda w: F.struct(x["i"].alias("i"), w.alias("t")))

    return F.when(words.isNull(), items).otherwise(F.flatten(F.transform(items, one)))


def _maps(abbreviations: DataFrame, levels: list[str]) -> DataFrame:
    """Per context, its abbreviations as a map."""
    rows = abbreviations.where(F.col("province_context").isNotNull() & (F.col("district_context").isNotNull() if len(levels) > 1 else F.col("district_context").isNull()))
    keys = ["province_context", "district_context"][: len(levels)]
    least = rows.groupBy(*keys, "key").agg(F.min("word").alias("word"))
    return least.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "word"))).alias("words")).select(*(F.col(k).alias(c) for k, c in zip(keys, levels, strict=True)), "words")


def provinces(rows: DataFrame, gaz: G.Gazetteer) -> DataFrame:
    """Up to five province candidates: row_id, p, p_score, p_source, ps, pe, p_ord."""
    dims = gaz.names("p").select(F.col("p").alias("name"))
    grams = staged(_exploded(rows.withColumn("len", F.size("tokens")), "tokens", ["row_id", "hp", "seg", "len"]), "grams")
    hinted = grams.where("hp is not null").withColumn("hit", S.ensemble(F.col("ngram"), F.col("hp")))
    hinted = hinted.where((F.col("hit") >= K.HINT_THRESHOLD) & ~F.col("ngram").rlike(r"^\d+$"))
    seen = hinted.groupBy("row_id").agg(F.max_by(F.struct("s", "e"), F.struct("hit", "n", "e")).alias("at"))
    known = rows.where("hp is not null").select("row_id", "hp").join(seen, "row_id", "left")
    known = known.select("row_id", F.col("hp").alias("p"), F.when(F.col("at").isNotNull(), 1.2).otherwise(1.0).alias("p_score"), F.when(F.col("at").isNotNull(), "known_and_in_text").otherwise("known").alias("p_source"), F.coalesce("at.s", F.lit(-1)).alias("ps"), F.coalesce("at.e", F.lit(-1)).alias("pe"), F.lit(False).alias("exact"))
    free = grams.where("hp is null")
    short = free.where((F.col("n") <= 2) & (F.length("ngram") >= 2) & ~F.col("ngram").rlike(r"^\d+$"))
    abbr = G.province_candidates(short.withColumnRenamed("ngram", "key"), gaz.abbreviations).join(small(dims.select(F.col("name").alias("word"))), "word")
    abbr = abbr.select("row_id", F.col("word").alias("p"), F.when(F.col("s") >= F.col("len") - 3, 0.95).otherwise(0.85).alias("p_score"), F.lit("abbreviation").alias("p_source"), F.col("s").alias("ps"), F.col("e").alias("pe"), F.lit(False).alias("exact"))
    full = free.where(~F.col("ngram").rlike(r"^\d+$") & ~F.arrays_overlap(F.split("ngram", " "), F.array(*map(F.lit, K.NOISE_WORDS))))
    full = full.withColumn("mult", F.when(F.col("e") == F.col("len"), F.greatest(F.lit(1.0), N.delimiter_score(F.col("seg"), F.col("s"), F.col("e")))).otherwise(N.delimiter_score(F.col("seg"), F.col("s"), F.col("e"))))
    hits = best_matches(full, dims, (), extra=F.col("mult"))
    found = full.join(hits, ["ngram", "mult"]).select("row_id", F.col("match").alias("p"), F.col("score").alias("p_score"), F.when(F.col("e") == F.col("len"), "rightmost").otherwise("full_scan").alias("p_source"), F.col("s").alias("ps"), F.col("e").alias("pe"), "exact")
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in (("known_and_in_text", 4), ("known", 3), ("abbreviation", 2), ("rightmost", 1), ("full_scan", 0)) for x in pair)), F.col("p_source"))
    both = known.union(abbr).union(found).withColumn("rank", rank)
    best = top(both, ["row_id", "p"], [F.desc("p_score"), F.desc("rank"), *_nearest("ps", "pe")], 1, "n").drop("n", "exact")
    named = F.max(F.col("p_source").isin("rightmost", "known_and_in_text")).over(Window.partitionBy("row_id"))
    best = best.withColumn("p_score", F.when(named & (F.col("p_source") == "abbreviation"), F.col("p_score") * 0.9).otherwise(F.col("p_score")))
    return top(best, ["row_id"], [F.desc("p_score"), F.desc("rank"), "p"], K.PROVINCE_BEAM, "p_ord").drop("rank")


def inferred_provinces(rows: DataFrame, gaz: G.Gazetteer) -> DataFrame:
    """Provinces of districts that rows without any province name: the same columns, no span."""
    dims = gaz.names("d").select(F.col("d").alias("name")).distinct()
    grams = _exploded(rows, "tokens", ["row_id"]).where((F.length("ngram") >= 3) & ~F.col("ngram").rlike(r"^\d+$"))
    hits = grams.join(best_matches(grams, dims, ()), ["ngram"]).groupBy("row_id", F.col("match").alias("d")).agg(F.max("score").alias("score"))
    up = G.parents(gaz.divisions, ("d",), "p").select("d", "p")
    found = hits.join(small(up), "d").groupBy("row_id", "p").agg(F.max("score").alias("score"))
    out = found.select("row_id", "p", (F.col("score") * K.INHERIT_PENALTY).alias("p_score"), F.lit("inferred").alias("p_source"), F.lit(-1).alias("ps"), F.lit(-1).alias("pe"))
    return top(out, ["row_id"], [F.desc("p_score"), "p"], K.PROVINCE_BEAM, "p_ord")


def _numbers(grams: DataFrame) -> DataFrame:
    """Plain numbers only count after a level word, one or two digits, equal only, with a bonus."""
    number = F.col("ngram").rlike(r"^\d+$")
    usable = ~number | ((F.length("ngram") <= 2) & F.col("kw"))
    return grams.where(usable).withColumn("ngram", T.admin_number(F.col("ngram"))).withColumn("bonus", F.when(number, K.NUMERIC_KEYWORD_BONUS).otherwise(1.0)).withColumn("number", number)


def _placed(df: DataFrame, by: list[str], score: str, s: str) -> DataFrame:
    """Scores scaled by place among a branch's candidates that have one."""
    at = F.when(F.col(s) >= 0, F.col(s))
    w = Window.partitionBy(*by)
    return df.withColumn(score, F.when(F.col(s) >= 0, F.col(score) * C.position_factor(F.col(s), F.min(at).over(w), F.max(at).over(w))).otherwise(F.col(score)))


def districts(branches: DataFrame, gaz: G.Gazetteer) -> DataFrame:
    """Up to three districts of each province branch; where none is named, those of wards that are: adds d, d_score, d_source,
    ds, de, d_ord and, if inferred, w, w_score, ws, we."""
    keys = ["row_id", "p"]
    fixed = branches.where("hd is not null").select(*keys, F.col("hd").alias("d"), F.lit(1.0).alias("d_score"), F.lit("known").alias("d_source"), F.lit(-1).alias("ds"), F.lit(-1).alias("de"))
    twins = G.collisions(gaz.divisions).select(F.col("name").alias("p"), F.lit(True).alias("twin"))
    open_ = branches.where("hd is null").join(small(twins), "p", "left").join(small(_maps(gaz.abbreviations, ["p"])), "p", "left")
    left = F.when(F.col("twin"), F.col("tokens")).otherwise(_drop_spans(F.col("tokens"), [("ps", "pe")]))
    open_ = staged(open_.select(*keys, _expand(left, F.col("words")).alias("items"), "explicit"), "branches")
    grams = staged(_numbers(_exploded(open_, "items", keys)), "grams")
    dims = gaz.names("d").select("p", F.col("d").alias("name"))
    hits = grams.join(best_matches(grams.select("p", "ngram"), dims, ("p",)), ["p", "ngram"]).where("exact or not number")
    named = hits.select(*keys, F.col("match").alias("d"), (F.col("score") * F.col("bonus")).alias("d_score"), F.lit("fuzzy").alias("d_source"), F.col("s").alias("ds"), F.col("e").alias("de"), "exact")
    named = top(named, [*keys, "d"], [F.desc("d_score"), *_nearest("ds", "de")], 1, "n").drop("n", "exact")
    direct = staged(_placed(fixed.union(named), keys, "d_score", "ds"), "direct")
    none = open_.join(direct.select(*keys).distinct(), keys, "left_anti")
    wards = gaz.names("w").select("p", "d", F.col("w").alias("name"))
    none = staged(none, "unnamed")
    loose = staged(_numbers(_exploded(none, "items", keys)), "grams")
    by_gram = loose.join(best_matches(loose.select("p", "ngram"), wards, ("p",), context=False), ["p", "ngram"]).where("exact or not number")
    by_gram = by_gram.select(*keys, "match", (F.col("score") * F.col("bonus") * K.INHERIT_PENALTY).alias("w_score"), F.lit(0.9 * K.INHERIT_PENALTY).alias("d_score"), F.lit("inferred_from_ward").alias("d_source"), "s", "e", "exact")
    said = none.select(*keys, F.explode("explicit.wards").alias("x")).select(*keys, F.col("x.name").alias("ngram"), "x.s", "x.e")
    by_word = said.join(best_matches(said.select("p", "ngram"), wards, ("p",), threshold=K.EXPLICIT_THRESHOLD), ["p", "ngram"])
    by_word = by_word.select(*keys, "match", (F.col("score") * K.EXPLICIT_BONUS * K.INHERIT_PENALTY).alias("w_score"), F.lit(0.95 * K.INHERIT_PENALTY).alias("d_score"), F.lit("inferred_from_explicit_ward").alias("d_source"), "s", "e", "exact")
    up = G.parents(gaz.divisions, ("p", "w"), "d").select("p", F.col("w").alias("match"), "d")
    inferred = by_gram.union(by_word).join(up, ["p", "match"])
    inferred = top(inferred, [*keys, "d"], [F.desc("d_score"), F.desc("w_score"), "match", *_nearest("s", "e")], 1, "n")
    inferred = inferred.select(*keys, "d", "d_score", "d_source", F.lit(-1).alias("ds"), F.lit(-1).alias("de"), F.col("match").alias("w"), "w_score", F.col("s").alias("ws"), F.col("e").alias("we"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("w", "string"), ("w_score", "double"), ("ws", "int"), ("we", "int"))]
    every = direct.select(*keys, "d", "d_score", "d_source", "ds", "de", *nothing).unionByName(inferred)
    return top(every, keys, [F.desc("d_score"), F.desc_nulls_last("w_score"), "d"], K.DISTRICT_BEAM, "d_ord")


def wards(branches: DataFrame, gaz: G.Gazetteer) -> DataFrame:
    """Up to two wards of each (row_id, p, d) branch: w, w_score, ws, we, w_ord."""
    keys = ["row_id", "p", "d"]
    words = _maps(gaz.abbreviations, ["p", "d"])
    open_ = branches.join(small(words), ["p", "d"], "left").withColumn("items", _expand(_drop_spans(F.col("tokens"), [("ps", "pe"), ("ds", "de")]), F.col("words")))
    dims = gaz.names("w").select("p", "d", F.col("w").alias("name"))
    open_ = staged(open_, "branches")
    grams = staged(_numbers(_exploded(open_, "items", keys)), "grams")
    near = grams.join(best_matches(grams.select("p", "d", "ngram"), dims, ("p", "d"), context=True), ["p", "d", "ngram"]).where("exact or not number")
    near = near.select(*keys, F.col("match").alias("w"), (F.col("score") * F.col("bonus")).alias("w_score"), F.lit(1).alias("rank"), F.col("s").alias("ws"), F.col("e").alias("we"), "exact")
    said = open_.select(*keys, "ps", "pe", "ds", "de", F.explode("explicit.wards").alias("x")).select("*", F.col("x.name").alias("ngram"), "x.s", "x.e")
    said = said.where("not (s < pe and e > ps) and not (s < de and e > ds)")
    by_word = said.join(best_matches(said.select("p", "d", "ngram"), dims, ("p", "d"), threshold=K.EXPLICIT_THRESHOLD), ["p", "d", "ngram"])
    by_word = by_word.select(*keys, F.col("match").alias("w"), (F.col("score") * K.EXPLICIT_BONUS).alias("w_score"), F.lit(3).alias("rank"), F.col("s").alias("ws"), F.col("e").alias("we"), "exact")
    best = top(near.union(by_word), [*keys, "w"], [F.desc("rank"), F.desc("w_score"), *_nearest("ws", "we")], 1, "n").drop("n", "exact")
    best = _placed(best, keys, "w_score", "ws")
    return top(best, keys, [F.desc("w_score"), F.desc("rank"), "w"], K.WARD_BEAM, "w_ord").drop("rank")


def candidates(rows: DataFrame, gaz: G.Gazetteer, strict_compat: bool = False) -> DataFrame:
    """Up to five candidates a row, ranked: cand_rank, names, spans, scores, level, at_rule, source, combined, valid, confidence, final."""
    one = staged(provinces(rows, gaz), "named")
    lost = rows.join(one.select("row_id").distinct(), "row_id", "left_anti")
    first = staged(one.unionByName(inferred_provinces(lost, gaz)), "provinces")
    branch = first.join(rows.select("row_id", "tokens", "hd", "explicit"), "row_id")
    second = staged(districts(branch, gaz), "districts")
    keep = ["row_id", "p", "p_score", "ps", "pe", "p_ord"]
    with_d = first.select(*keep).join(second, ["row_id", "p"])
    third = wards(with_d.where("w is null").select(*keep, "d", "ds", "de").join(rows.select("row_id", "tokens", "explicit"), "row_id"), gaz)
    third = staged(third, "wards")
    deep = with_d.where("w is null").drop("w", "w_score", "ws", "we").join(third, ["row_id", "p", "d"], "left")
    carried = with_d.where("w is not null").withColumn("w_ord", F.lit(1))
    bare = first.select(*keep).join(second.select("row_id", "p").distinct(), ["row_id", "p"], "left_anti")
    every = deep.unionByName(carried).unionByName(bare, allowMissingColumns=True)
    level = F.when(F.col("w").isNotNull(), 3).when(F.col("d").isNotNull(), 2).otherwise(1)
    every = every.withColumn("match_level", level).withColumn("combined", C.mean_positive(F.col("p_score"), F.coalesce("d_score", F.lit(0.0)), F.coalesce("w_score", F.lit(0.0))) * F.element_at(F.array(*map(F.lit, K.LEVEL_WEIGHTS)), level))
    every = G.validity(every, gaz.divisions)
    any_valid = F.max("valid").over(Window.partitionBy("row_id"))
    every = every.withColumn("any_valid", any_valid).where("valid or not any_valid").drop("any_valid")
    ords = [F.asc_nulls_last("p_ord"), F.asc_nulls_last("d_ord"), F.asc_nulls_last("w_ord")]
    every = top(every, ["row_id"], [F.desc("combined"), *ords], K.FINAL_BEAM, "cand_ord")
    real = (F.col("match_level") == 3) if strict_compat else F.lit(True)
    every = every.withColumn("at_rule", F.when(real, F.col("match_level")).otherwise(0)).withColumn("source", F.when(real, "db_exact_match").otherwise("")).withColumn("match_type", F.when(real, "exact").otherwise("fallback"))
    score = C.confidence(F.col("p_score"), F.coalesce("d_score", F.lit(0.0)), F.coalesce("w_score", F.lit(0.0)), F.col("at_rule"), F.col("valid"), F.col("source"))
    spans = [(F.col("ps"), F.col("pe")), (F.coalesce("ds", F.lit(-1)), F.coalesce("de", F.lit(-1))), (F.coalesce("ws", F.lit(-1)), F.coalesce("we", F.lit(-1)))]
    every = every.withColumn("confidence", score).withColumn("tokens_used", F.size(N.covered(spans)))
    final = F.col("confidence") * C.length_penalty(F.col("ws"), F.col("we"), F.col("w")) * C.length_penalty(F.col("ds"), F.col("de"), F.col("d")) * C.token_bonus(F.col("tokens_used"))
    kind = F.when(F.col("match_type") == "exact", 3).when(F.col("match_type") == "fuzzy", 2).otherwise(1)
    every = every.withColumn("final_confidence", final)
    return every.withColumn("cand_rank", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("final_confidence"), F.desc(kind), F.desc("at_rule"), "cand_ord")))


def resolve(df: DataFrame, gaz: G.Gazetteer, address: str = "address", province_hint: str | None = None, district_hint: str | None = None, row_id: str = "row_id", strict_compat: bool = False) -> DataFrame:
    """One row for each row of ``df`` (unique ``row_id``): the winner's names, codes, leftovers, scores, quality and new addresses.

    Abbreviations in hints are spelled out first; those in addresses are matched as they are."""
    if province_hint or district_hint:
        df = hints(df, gaz.abbreviations, province_hint, district_hint)
    rows = staged(prepare(spread(df, row_id), address, province_hint, district_hint, row_id), "addresses")
    best = staged(candidates(rows, gaz, strict_compat).where("cand_rank = 1"), "winners")
    out = rows.select("row_id", "raw", "norm", "tokens").join(best, "row_id", "left")
    out = staged(G.full_names(out, gaz.divisions), "full")
    codes = [G.exact_match(out.select("row_id", *k).where(" and ".join(f"{c} is not null" for c in k)), gaz.divisions, k).select("row_id", F.col("state_code").alias(f"s{len(k)}"), F.col("county_code").alias(f"c{len(k)}")) for k in (("p", "d"), ("p", "d", "w"))]
    for c in codes:
        out = out.join(c, "row_id", "left")
    shown = lambda full, name: F.coalesce(F.nullif(T.title_case(F.col(full)), F.lit("")), T.title_case(F.col(name)), F.lit(""))
    spans = [(F.coalesce(a, F.lit(-1)), F.coalesce(b, F.lit(-1))) for a, b in (("ps", "pe"), ("ds", "de"), ("ws", "we"))]
    left = F.upper(N.remaining(F.transform("tokens", lambda x: x["t"]), spans))
    parts = T.split_fixed(left)
    quality = C.quality_flag(F.coalesce("at_rule", F.lit(0)), F.coalesce("final_confidence", F.lit(0.0)))
    out = G.migrations_of(out, gaz.migrations)
    return out.select(
        "row_id", F.col("raw").alias("raw_input"), shown("p_full", "p").alias("province"), shown("d_full", "d").alias("district"), shown("w_full", "w").alias("ward"),
        F.coalesce("s3", "s2", F.lit("")).alias("state_code"), F.coalesce("c3", "c2", F.lit("")).alias("county_code"),
        *(p.alias(f"remaining_{i}") for i, p in enumerate(parts, 1)), F.coalesce("at_rule", F.lit(0)).alias("at_rule"), F.coalesce("final_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("combined", F.lit(0.0)).alias("combined_score"), F.coalesce("match_type", F.lit("none")).alias("match_type"), quality.alias("quality_flag"),
        F.when(F.col("p").isNull(), "failed").otherwise("success").alias("status"), F.when(F.col("p").isNull(), "no candidates").alias("error"), "new_addresses",
    )


def validated(cands: DataFrame) -> DataFrame:
    """Per row: the first of its ranked candidates (``cand_rank``), how many there are, and whether all of them are valid (null counts as not)."""
    best = F.min_by(F.struct(*(c for c in cands.columns if c != "row_id")), "cand_rank")
    return cands.groupBy("row_id").agg(best.alias("best"), F.count("*").alias("candidates"), F.bool_and(F.coalesce("valid", F.lit(False))).alias("all_valid"))


def match_summary(cands: DataFrame) -> DataFrame:
    """Best candidate and the distinct names of each level in the order they came, per row."""
    def names(c: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("cand_ord", F.col(c).alias("n")))))
        return F.array_distinct(F.transform(ordered, lambda x: x["n"])).alias(f"potential_{c}")

    return cands.groupBy("row_id").agg(F.min_by(F.struct("p", "d", "w", "combined"), "cand_ord").alias("best"), *(names(c) for c in ("p", "d", "w")), F.count("*").alias("candidates"))
