"""Text normalisation as column expressions; all stay inside the JVM but ``nfc``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from placeweave import constants as K


@pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Unicode NFC. A Python function runs for every row, whatever condition it stands under; so that only texts with
    combining marks leave the JVM, all others go in as nulls."""
    return F.coalesce(_nfc(F.when(c.rlike("[̀-ͯ]"), c)), c)


def fold_accents(c: Column) -> Column:
    return F.translate(c, K.ACCENTED, K.PLAIN)


def expand_structural(c: Column) -> Column:
    """Lower case, with abbreviated level words before numbers and names spelled out."""
    out = F.lower(c)
    for pattern, word in ((r"\bf\s*\.?\s*(?=\d)", "phuong "), (r"\bp\s*\.?\s*(?=\d)", "phuong "), (r"\bq\s*\.?\s*(?=\d)", "quan "), (r"\bt\.?p\.?\s+", "thanh pho ")):
        out = F.regexp_replace(out, "(?U)" + pattern, word)
    return out


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def remove_special(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def finalize(c: Column, separators: bool = False) -> Column:
    """Lower case words only. With ``separators``, commas, dashes and underscores part words and other marks vanish;
    without, every mark parts words."""
    if separators:
        c = F.regexp_replace(F.regexp_replace(c, r"[,\-_]", " "), r"(?U)[^\w\s]", "")
        return collapse(F.lower(c))
    return F.lower(remove_special(c))


def normalize_address(c: Column, separators: bool = False) -> Column:
    return finalize(fold_accents(expand_structural(nfc(c))), separators)


def expand_words(tokens: Column, words: Column) -> Column:
    """Each token's entry in the map ``words``, after marks at its ends are stripped; the token itself if it has none."""
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(words, clean_token(t)), t))


def expand_phrases(c: Column, phrases: dict[str, str]) -> Column:
    """Multi-word abbreviations, longest first, as whole words."""
    for key in sorted(phrases, key=lambda k: (-len(k), k)):
        c = F.regexp_replace(c, r"(?U)\b\Q" + key + r"\E\b", phrases[key])
    return c


def clean_token(c: Column) -> Column:
    return F.btrim(c, F.lit(".,;:!?"))


def strip_admin(c: Column) -> Column:
    """Without administrative prefixes; several may go."""
    c = F.trim(c)
    for p in K.ADMIN_PREFIXES:
        c = F.regexp_replace(c, rf"(?i)^{p}\s+", "")
    return F.trim(c)


def strip_first_prefix(c: Column) -> Column:
    low = F.trim(F.lower(c))
    out = low
    for p in reversed(K.FIRST_PREFIXES):
        out = F.when(low.startswith(p + " "), F.trim(F.substr(low, F.lit(len(p) + 1)))).otherwise(out)
    return F.coalesce(out, F.lit(""))


def admin_number(c: Column) -> Column:
    """One- and two-digit numbers without leading zeros; anything else as it is."""
    return F.when(c.rlike("^[0-9]{1,2}$"), c.try_cast("int").cast("string")).otherwise(c)


def sanitize_hint(c: Column) -> Column:
    return F.when(~F.trim(c).isin("", "/"), c)


def normalize_hint(c: Column) -> Column:
    return F.nullif(strip_admin(normalize_address(sanitize_hint(c))), F.lit(""))


def title_case(c: Column) -> Column:
    return F.initcap(collapse(c))


def name_of_full(c: Column) -> Column:
    """A full name without the first prefix that fits, in title case."""
    out = c
    for p in reversed(K.FULL_NAME_PREFIXES):
        out = F.when(c.startswith(p + " "), F.substr(c, F.lit(len(p) + 2))).otherwise(out)
    return title_case(out)


def _decomposed() -> tuple[str, str]:
    """Every letter of the basic plane that decomposes to one letter and marks, and these letters."""
    frm, to = [], []
    for i in range(0xC0, 0xD800):
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(i)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(i):
            frm.append(chr(i))
            to.append(plain)
    return "".join(frm), "".join(to)


def strip_marks_upper(c: Column) -> Column:
    """Upper case without diacritics, whether they are composed or stand as marks of their own; the barred d stays."""
    return F.upper(F.regexp_replace(F.translate(c, *_decomposed()), r"\p{Mn}", ""))


def split_fixed(c: Column, width: int = 40, parts: int = 3) -> list[Column]:
    return [F.substring(c, 1 + i * width, width) for i in range(parts)]


def concat_nonempty(*cs: Column) -> Column:
    return F.concat_ws(", ", *(F.nullif(F.trim(c), F.lit("")) for c in cs))


def quick_context(c: Column) -> tuple[Column, Column]:
    """Province and, if there is one, district that a few patterns find; the first pattern that fits wins."""
    province = F.lit(None).cast("string")
    for pattern, name in reversed(K.CONTEXT_PROVINCES):
        province = F.when(c.rlike(rf"(?i)\b({pattern})\b"), F.lit(name)).otherwise(province)
    number = F.nullif(F.regexp_extract(c, r"(?i)\bquan\s*(\d+)\b", 1), F.lit(""))
    district = F.when(number.isNotNull(), F.concat(F.lit("quan "), number))
    for pattern, name in reversed(K.CONTEXT_DISTRICTS):
        district = F.when(c.rlike(rf"(?i)\b({pattern})\b"), F.lit(name)).otherwise(district)
    return province, F.when(province.isNotNull(), district)


def needs_iteration(c: Column, hint: Column) -> Column:
    return c.rlike(r"\b[A-Z]{2,4}\b") & hint.isNull()


def is_noise(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)" + K.NOISE_PATTERN), F.lit(False))
