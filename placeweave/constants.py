"""Thresholds, keyword sets and tables of the address domain."""

from __future__ import annotations

import unicodedata

# Scores, bonuses and beams.
FUZZY_THRESHOLD = 0.90
HINT_THRESHOLD = 0.95
EXPLICIT_THRESHOLD = 0.70
DELIMITER_CROSS, DELIMITER_WITHIN = 0.85, 1.10
NUMERIC_KEYWORD_BONUS = 1.2
EXPLICIT_BONUS = 1.5
INHERIT_PENALTY = 0.85
POSITION_FACTOR = 0.2
SUBSTRING_BONUS, SUBSTRING_BONUS_CONTEXT, SUBSTRING_MIN_LENGTH = 0.25, 0.50, 5
PROVINCE_BEAM, DISTRICT_BEAM, WARD_BEAM, FINAL_BEAM = 5, 3, 2, 5
LEVEL_WEIGHTS = (0.4, 0.8, 1.0)

# Words before a name that say its level.
KEYWORDS = ("phuong", "xa", "quan", "huyen", "thanh", "thi", "tran", "pho")
SCANNER_KEYWORDS = (*KEYWORDS, "p", "x", "q", "h", "tp", "tx")

# Words of institutions, not of places; single-word entries are those that a token can equal.
NOISE_WORDS = ("ubnd", "phong", "ban", "so", "truong", "vien", "bo")
COVERAGE_NOISE_WORDS = ("ubnd", "phong", "ban", "so", "truong", "to", "khu", "cong", "ty", "tnhh")

# Reliability by source; any other source has DEFAULT_SOURCE.
SOURCE_MULTIPLIERS = {
    "db_exact_match": 1.0,
    "multi_candidate_full": 1.0,
    "disambiguation_as_ward": 0.95,
    "disambiguation_as_district": 0.9,
    "osm_nominatim_bbox": 0.9,
    "osm_nominatim_query": 0.85,
    "street_based": 0.7,
    "province_only_no_db": 0.5,
}
DEFAULT_SOURCE = 0.8

# Coverage score to multiplier, from the highest threshold down.
COVERAGE_STEPS = ((0.95, 1.25), (0.90, 1.20), (0.80, 1.15), (0.70, 1.10), (0.60, 1.05), (0.50, 1.00), (0.40, 0.95), (0.20, 0.90), (0.0, 0.85))
# Distinct covered tokens to bonus.
TOKEN_BONUS = ((6, 2.0), (5, 1.7), (4, 1.3), (3, 1.1))
# Gap between components to closeness.
GAP_SCORES = ((0, 1.0), (3, 0.6), (5, 0.3))
FAR_SCORE = 0.1

# Prefixes of administrative names, as patterns at the start, applied one after another.
ADMIN_PREFIXES = (r"thanh\s*pho", "tinh", r"thi\s*xa", r"thi\s*tran", "quan", "huyen", "phuong", "xa")
# Prefixes of which the first that fits is stripped.
FIRST_PREFIXES = ("phuong", "xa", "thi tran", "quan", "huyen", "thi xa", "thanh pho", "tinh")
FULL_NAME_PREFIXES = ("THÀNH PHỐ", "TỈNH", "QUẬN", "HUYỆN", "THỊ XÃ", "PHƯỜNG", "XÃ", "THỊ TRẤN")

# Provinces and districts that a quick look finds, and what they stand for.
CONTEXT_PROVINCES = (
    (r"ha\s*noi", "ha noi"),
    (r"ho\s*chi\s*minh|sai\s*gon", "ho chi minh"),
    (r"da\s*nang", "da nang"),
    (r"hai\s*phong", "hai phong"),
    (r"can\s*tho", "can tho"),
    (r"ba\s*ria\s*vung\s*tau|brvt", "ba ria vung tau"),
    (r"dong\s*nai", "dong nai"),
    (r"binh\s*duong", "binh duong"),
)
CONTEXT_DISTRICTS = ((r"ba\s*dinh", "ba dinh"), (r"cau\s*giay", "cau giay"), (r"dong\s*da", "dong da"), (r"hoan\s*kiem", "hoan kiem"))

# What marks a text as no address.
NOISE_PATTERN = r"\b(cong\s*ty|cty|chi\s*nhanh|van\s*phong|benh\s*vien|truong|ngan\s*hang|ubnd|kho\s*bac|so\s+y\s*te|dt:|dd:|tel:|phone:|\d{10,})\b"


def _accents() -> tuple[str, str]:
    """Vietnamese letters and their plain ones: every vowel form with every tone, and the barred d, in both cases."""
    tones = ("", "̀", "́", "̉", "̃", "̣")
    forms = {"a": ("a", "ă", "â"), "e": ("e", "ê"), "i": ("i",), "o": ("o", "ô", "ơ"), "u": ("u", "ư"), "y": ("y",)}
    pairs = [(unicodedata.normalize("NFC", form + tone), plain) for plain, all_forms in forms.items() for form in all_forms for tone in tones]
    pairs = [(a, b) for a, b in pairs if a != b] + [("đ", "d")]
    pairs += [(a.upper(), b.upper()) for a, b in pairs]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()

#: Names of four words, beyond the three of other n-grams.
FOUR_WORDS = ("ba ria vung tau", "phan rang thap cham")
