"""Tokens, segments, n-grams and scans as column expressions over arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave import constants as K
from placeweave.functions import text as T


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: t != "")


def indexed(tokens: Column) -> Column:
    """Tokens with their places: array<struct<i, t>>."""
    return F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t")))


def delimiter_pieces(c: Column) -> Column:
    """The text's pieces between delimiters; a slash between digits parts nothing."""
    pieces = F.split(c, r"[,\-_]|(?<!\d)/|/(?!\d)")
    return F.filter(F.transform(pieces, lambda p: T.finalize(p)), lambda p: p != "")


def segment_ids(c: Column) -> Column:
    """For each token of all pieces, the number of its piece."""
    return F.flatten(F.transform(delimiter_pieces(c), lambda p, s: F.transform(words(p), lambda _: s)))


def number_tokens(tokens: Column) -> Column:
    return F.transform(F.filter(indexed(tokens), lambda x: x["t"].rlike(r"^\d+(/\d+)?$")), lambda x: x["i"])


def delimiter_score(segments: Column, start: Column, end: Column) -> Column:
    """0.85 for a span across pieces, 1.10 within one, 1 if there is only one piece."""
    own = F.slice(segments, start + 1, end - start)
    crosses = F.array_min(own) != F.array_max(own)
    return F.when(F.coalesce(F.array_max(segments), F.lit(0)) == 0, 1.0).when(crosses, K.DELIMITER_CROSS).otherwise(K.DELIMITER_WITHIN)


def is_keyword(t: Column, words_: tuple[str, ...] = K.KEYWORDS) -> Column:
    return F.coalesce(t.isin(*words_), F.lit(False))


def ngrams_of(items: str, most: int = 3) -> Column:
    """``ngrams`` of the column named ``items``, as one expression of SQL text: a thousand calls to the JVM less."""
    words_ = ", ".join(f"'{w}'" for w in K.KEYWORDS)

    def of(n: int) -> str:
        last = f"element_at({items}, i + {n}).i + 1"
        before = f"coalesce(i > 0 and try_element_at({items}, greatest(i, 1)).t in ({words_}), false)"
        one = f"named_struct('ngram', array_join(transform(slice({items}, i + 1, {n}), x -> x.t), ' '), 's', element_at({items}, i + 1).i, 'e', {last}, 'kw', {before}, 'n', {n})"
        none = "cast(array() as array<struct<ngram:string,s:int,e:int,kw:boolean,n:int>>)"
        return f"if(size({items}) >= {n}, transform(sequence(0, greatest(size({items}) - {n}, 0)), i -> {one}), {none})"

    return F.expr(f"flatten(array({', '.join(of(n) for n in range(most, 0, -1))}))")


def ngrams(items: Column, most: int = 3) -> Column:
    """n-grams of indexed tokens (longest first): ngram, first and last place + 1, whether a level word comes before.

    Tokens may have gaps between their places; the level word is the token before in the list.
    """

    def of(n: Column) -> Column:
        def one(i: Column) -> Column:
            part = F.slice(items, i + 1, n)
            before = F.when(i > 0, F.try_element_at(items, F.when(i > 0, i).otherwise(1).cast("int"))["t"])
            return F.struct(
                F.array_join(F.transform(part, lambda x: x["t"]), " ").alias("ngram"),
                part[0]["i"].alias("s"),
                (F.element_at(part, -1)["i"] + 1).alias("e"),
                is_keyword(before).alias("kw"),
                n.alias("n"),
            )

        return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - n, F.lit(0))), one))

    lists = [F.coalesce(of(F.lit(n)), F.slice(of(F.lit(1)), 1, 0), F.array().cast("array<struct<ngram:string,s:int,e:int,kw:boolean,n:int>>")) for n in range(most, 0, -1)]
    return F.flatten(F.array(*lists))


def phrase_position(tokens: Column, phrase: Column) -> Column:
    """The first place where the phrase's words stand in a row; -1 if nowhere."""
    wanted = words(phrase)
    starts = F.filter(F.transform(tokens, lambda _, i: i), lambda i: F.slice(tokens, i + 1, F.greatest(F.size(wanted), F.lit(1))) == wanted)
    return F.coalesce(F.try_element_at(starts, F.lit(1)), F.lit(-1))


def char_to_tokens(tokens: Column, at: Column, length: Column, first: Column) -> Column:
    """The tokens that a span of characters of the joined text covers fully: start and end place from ``first`` on; -1s if none."""
    spans = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), (F.length(F.array_join(F.slice(tokens, 1, i), " ")) + F.when(i > 0, 1).otherwise(0)).alias("a"), F.length(t).alias("n")))
    inside = F.filter(spans, lambda s: (s["a"] >= at) & (s["a"] + s["n"] <= at + length))
    some = F.size(inside) > 0
    start, end = F.try_element_at(inside, F.lit(1))["i"] + first, F.try_element_at(inside, F.lit(-1))["i"] + first + 1
    return F.struct(F.when(some, start).otherwise(-1).alias("s"), F.when(some, end).otherwise(-1).alias("e"))


def has_noise(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, K.NOISE_WORDS)))


def explicit_patterns(tokens: Column) -> Column:
    """Names after level words, left to right: struct of ``districts`` and ``wards`` (name, s, e).

    A name is up to three tokens and ends before the next level word; a level word without a name is passed over.
    """
    item = "array<struct<name:string,s:int,e:int>>"

    def token(i: Column) -> Column:
        return F.coalesce(F.try_element_at(tokens, (i + 1).cast("int")), F.lit(""))

    def begins(t: Column, i: Column) -> Column:
        after = token(i + 1)
        two = ((t == "thanh") & (after == "pho")) | ((t == "thi") & (after == "xa"))
        kind = F.when(two | t.isin("tp", "tx"), "city").when(t.isin("huyen", "h"), "rural").when(t.isin("quan", "q"), "urban").when(t.isin("phuong", "p", "xa", "x"), "ward")
        return F.struct(i.alias("i"), kind.alias("kind"), (i + F.when(two, 2).otherwise(1)).cast("int").alias("start"))

    def named(x: Column) -> Column:
        free = [(token(x["start"] + j) != "") & ~token(x["start"] + j).isin(*K.SCANNER_KEYWORDS) for j in range(3)]
        n = F.when(~free[0], 0).when(~free[1], 1).when(~free[2], 2).otherwise(3)
        return F.struct(x["i"].alias("i"), x["kind"].alias("kind"), x["start"].alias("start"), F.slice(tokens, x["start"] + 1, n).alias("part"))

    def step(state: Column, x: Column) -> Column:
        scans = x["i"] >= state["next"]
        good = scans & (F.size(x["part"]) > 0) & ~((x["kind"] == "rural") & has_noise(x["part"]))
        name = F.array_join(x["part"], " ")
        name = F.when(x["kind"].isin("urban", "ward"), T.admin_number(name)).otherwise(name)
        found = F.array(F.struct(name.alias("name"), x["start"].alias("s"), (x["start"] + F.size(x["part"])).alias("e")))
        return F.struct(
            F.when(scans, x["start"] + F.size(x["part"])).otherwise(state["next"]).cast("int").alias("next"),
            F.when(good & (x["kind"] != "ward"), F.concat(state["districts"], found)).otherwise(state["districts"]).cast(item).alias("districts"),
            F.when(good & (x["kind"] == "ward"), F.concat(state["wards"], found)).otherwise(state["wards"]).cast(item).alias("wards"),
        )

    zero = F.struct(F.lit(0).alias("next"), F.array().cast(item).alias("districts"), F.array().cast(item).alias("wards"))
    scanned = F.transform(F.filter(F.transform(tokens, begins), lambda x: x["kind"].isNotNull()), named)
    return F.aggregate(scanned, zero, step, lambda s: F.struct(s["districts"].alias("districts"), s["wards"].alias("wards")))


def covered(spans: list[tuple[Column, Column]]) -> Column:
    """The distinct places in any of the spans; absent spans are (-1, -1)."""
    ranges = [F.when((s >= 0) & (e > s), F.sequence(s, F.greatest(e - 1, s))).otherwise(F.array().cast("array<int>")) for s, e in spans]
    return F.array_distinct(F.flatten(F.array(*ranges)))


def remaining(tokens: Column, spans: list[tuple[Column, Column]]) -> Column:
    """The tokens outside all spans, joined."""
    inside = [lambda i, s=s, e=e: F.coalesce((i >= s) & (i < e), F.lit(False)) for s, e in spans]
    keep = F.filter(indexed(tokens), lambda x: ~reduce(lambda a, b: a | b, (f(x["i"]) for f in inside)))
    return F.array_join(F.transform(keep, lambda x: x["t"]), " ")


def raw_words(c: Column) -> Column:
    """The words of a raw text with their places in it: array<struct<i, t, raw, start, end>>, where ``t`` is the word in lower case
    without accents, composed or not, and start and end are code points, end exclusive. For texts of an address's length."""
    found, gaps = F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)), F.split(c, r"(?U)\w+", -1)
    sizes = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda w, gap: F.struct(F.length(gap).alias("gap"), F.length(w).alias("own")))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda done, x: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x["gap"] + x["own"]))
    plain = lambda w: F.lower(T.fold_accents(F.regexp_replace(w, r"\p{Mn}", "")))
    return F.transform(F.arrays_zip(found.alias("raw"), ends.alias("end")), lambda x, i: F.struct(i.alias("i"), plain(x["raw"]).alias("t"), x["raw"].alias("raw"), (x["end"] - F.length(x["raw"])).alias("start"), x["end"].alias("end")))


def raw_slice(c: Column, tokens: Column, start: Column, end: Column) -> Column:
    """The raw text from the word ``start`` to before the word ``end``, with what stands between them; null if there are no such words."""
    first, last = F.try_element_at(tokens, start + 1), F.try_element_at(tokens, end)
    return F.when((start >= 0) & (end > start), F.substring(c, first["start"] + 1, last["end"] - first["start"]))


def remaining_raw(tokens: Column, spans: list[tuple[Column, Column]]) -> Column:
    """The raw words outside all spans of word places (start, end; negative: none), by single spaces, as they are written."""
    outside = reduce(lambda a, b: lambda x: a(x) & ((b[0] < 0) | (x["i"] < b[0]) | (x["i"] >= b[1])), spans, lambda x: F.lit(True))
    return F.array_join(F.transform(F.filter(tokens, outside), lambda x: x["raw"]), " ")
