"""Scalar text functions: keys, names, letters of two alphabets, tokens. All take and return Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ICAO 9303 romanization of Cyrillic capitals.
CYRILLIC_TO_LATIN = {
    "А": "A", "Б": "B", "В": "V", "Г": "G", "Д": "D", "Е": "E", "Ё": "E", "Ж": "ZH", "З": "Z", "И": "I", "Й": "I",
    "К": "K", "Л": "L", "М": "M", "Н": "N", "О": "O", "П": "P", "Р": "R", "С": "S", "Т": "T", "У": "U", "Ф": "F",
    "Х": "KH", "Ц": "TS", "Ч": "CH", "Ш": "SH", "Щ": "SHCH", "Ъ": "IE", "Ы": "Y", "Ь": "", "Э": "E", "Ю": "IU",
    "Я": "IA", "Ґ": "G", "Є": "IE", "І": "I", "Ї": "I", "Ў": "U",
}

# Letters written for a Cyrillic one, longer spellings before shorter.
LATIN_TO_CYRILLIC = {
    "SHCH": "Щ", "KH": "Х", "TS": "Ц", "CH": "Ч", "SH": "Ш", "ZH": "Ж", "IU": "Ю", "YU": "Ю", "IA": "Я", "YA": "Я", "YO": "Ё", "YE": "Е",
    "A": "А", "B": "Б", "C": "К", "D": "Д", "E": "Е", "F": "Ф", "G": "Г", "H": "Х", "I": "И", "J": "Ж", "K": "К", "L": "Л", "M": "М",
    "N": "Н", "O": "О", "P": "П", "Q": "К", "R": "Р", "S": "С", "T": "Т", "U": "У", "V": "В", "W": "В", "X": "КС", "Y": "Ы", "Z": "З",
}

# Digits that readers see in place of letters of a name.
DIGIT_TO_LETTER = {"0": "O", "1": "I", "2": "Z", "4": "A", "5": "S", "6": "G", "7": "T", "8": "B"}

#: Accented Latin letters of common European languages and Vietnamese, composed, by their base letter.
ACCENTED = {
    "A": "ÀÁÂÃÄÅĀĂĄẠẢẤẦẨẪẬẮẰẲẴẶ", "C": "ÇĆĈĊČ", "D": "Ď", "E": "ÈÉÊËĒĔĖĘĚẸẺẼẾỀỂỄỆ", "G": "ĜĞĠĢ", "H": "Ĥ", "I": "ÌÍÎÏĨĪĬĮİỈỊ", "J": "Ĵ",
    "K": "Ķ", "L": "ĹĻĽ", "N": "ÑŃŅŇ", "O": "ÒÓÔÕÖŌŎŐƠỌỎỐỒỔỖỘỚỜỞỠỢ", "R": "ŔŖŘ", "S": "ŚŜŞŠ", "T": "ŢŤ", "U": "ÙÚÛÜŨŪŬŮŰŲƯỤỦỨỪỬỮỰ",
    "W": "Ŵ", "Y": "ÝŶŸỲỴỶỸ", "Z": "ŹŻŽ",
}


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def text(c: Column) -> Column:
    """The value as a string, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_present(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c.cast("string") != "")


def blank_to_null(c: Column) -> Column:
    """The trimmed value; null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


# Keys under which two readings of a value count as equal


def name_key(c: Column) -> Column:
    """Words of A to Z in upper case, sorted: the order of a name's parts doesn't count."""
    words = F.filter(F.split(F.regexp_replace(F.upper(text(c)), "[^A-Z ]", " "), r"\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def digits_key(c: Column) -> Column:
    return F.regexp_replace(text(c), "[^0-9]", "")


def visa_key(c: Column) -> Column:
    """Letters and digits in upper case; the letter O counts as zero."""
    return F.translate(F.regexp_replace(F.upper(text(c)), "[^0-9A-Z]", ""), "O", "0")


def letters_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(text(c)), "[^A-Z]", "")


def first_letter_key(c: Column) -> Column:
    return F.substring(F.upper(text(c)), 1, 1)


def reading_key(c: Column) -> Column:
    """Letters and digits in upper case."""
    return F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]", "")


def without_filler(c: Column) -> Column:
    """A name's key cut where, from its third character on, one first stands three times in a row; keys of up to three stay."""
    k = reading_key(c)
    at = F.regexp_instr(k, F.lit(r"(.)\1{2,}"))
    return F.when((F.length(k) > 3) & (at >= 3), F.substring(k, F.lit(1), at - 1)).otherwise(k)


def names_agree(a: Column, b: Column) -> Column:
    """Whether two names agree: equal without filler, or one begins the other, which is longer by half or one at most. Not transitive."""
    x, y = without_filler(a), without_filler(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    extra = F.length(long) - F.length(short)
    return (short != "") & long.startswith(short) & (extra <= F.greatest(F.lit(1), F.floor(F.length(short) / 2)))


def vote_key(c: Column, is_name: Column) -> Column:
    """Upper case; names without hyphens and spaces, other values with single spaces."""
    v = F.upper(F.trim(text(c)))
    return F.when(is_name, F.regexp_replace(v, r"[-\s]", "")).otherwise(F.regexp_replace(v, r"\s+", " "))


# Letters


def fold_accents(c: Column) -> Column:
    """Base letters for accented Latin ones, combining marks dropped."""
    upper = "".join(ACCENTED.values())
    base = "".join(k * len(v) for k, v in ACCENTED.items())
    pairs = [(u, b) for u, b in zip(upper, base)] + [(u.lower(), b.lower()) for u, b in zip(upper, base) if len(u.lower()) == 1]
    return F.regexp_replace(F.translate(text(c), "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)), "[̀-ͯ]", "")


def plain_latin(c: Column) -> Column:
    """Lower case without accents, đ as d."""
    return F.translate(F.lower(fold_accents(c)), "đ", "d")


def normal_name(c: Column, from_reader: bool = False) -> Column:
    """A name in plain capitals, with apostrophes and hyphens; from a reader, digits count as the letters they resemble."""
    v = fold_accents(c)
    if from_reader:
        v = F.regexp_replace(F.translate(v, "".join(DIGIT_TO_LETTER), "".join(DIGIT_TO_LETTER.values())), "[0-9]", " ")
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(v, r"[^A-Za-z0-9\s'-]", " "), r"\s+", " ")))


def has_cyrillic(c: Column) -> Column:
    return text(c).rlike("[Ѐ-ӿ]")


def transliterate(c: Column) -> Column:
    """Cyrillic letters by ICAO 9303. A capital before a small letter opens a word: only its first Latin letter is a capital."""
    chars = F.split(text(c), "")
    table = _map(CYRILLIC_TO_LATIN)

    def one(x: Column, i: Column) -> Column:
        latin = F.element_at(table, F.upper(x))
        following = F.coalesce(F.get(chars, i + 1), F.lit(""))
        opens = following != F.upper(following)
        return (
            F.when(latin.isNull(), x).when(x != F.upper(x), F.lower(latin))
            .when(opens, F.concat(F.substring(latin, 1, 1), F.lower(F.substring(latin, 2, 9)))).otherwise(latin)
        )

    return F.array_join(F.transform(chars, one), "")


def to_latin(c: Column) -> Column:
    """struct(value, transliterated)."""
    return F.struct(F.when(has_cyrillic(c), transliterate(c)).otherwise(text(c)).alias("value"), has_cyrillic(c).alias("transliterated"))


def to_cyrillic(c: Column) -> Column:
    """Latin spellings read from the left, longest first; other characters stay. A spelling all in capitals gives capitals."""
    pieces = F.regexp_extract_all(text(c), F.lit("(?is)" + "|".join(LATIN_TO_CYRILLIC) + "|."), F.lit(0))
    table = _map(LATIN_TO_CYRILLIC)

    def one(x: Column) -> Column:
        letter = F.element_at(table, F.upper(x))
        return F.when(letter.isNull(), x).when(x == F.upper(x), letter).otherwise(F.lower(letter))

    return F.array_join(F.transform(pieces, one), "")


# Capitals of both alphabets that look alike.
LOOK_ALIKE = ("ABCEHKMOPTXY", "АВСЕНКМОРТХУ")


def look_alike_to_cyrillic(c: Column) -> Column:
    """A word with a Cyrillic letter, or all of whose letters look Cyrillic, in Cyrillic; hyphens and digits don't count."""
    v = text(c)
    alike = F.regexp_replace(v, r"[^\p{L}]", "").rlike(f"^[Ѐ-ӿ{LOOK_ALIKE[0]}]*$")
    return F.when(has_cyrillic(c) | alike, F.translate(v, *LOOK_ALIKE)).otherwise(v)


def latin_half(c: Column) -> Column:
    """Of a value written twice around a slash, the half without Cyrillic, if just one has it; else the value."""
    v = text(c)
    left, right = F.trim(F.substring_index(v, "/", 1)), F.trim(F.regexp_replace(v, "(?s)^[^/]*/", ""))
    slash = v.contains("/")
    return F.when(slash & has_cyrillic(left) & ~has_cyrillic(right), right).when(slash & ~has_cyrillic(left) & has_cyrillic(right), left).otherwise(v)


def native_and_latin_words(c: Column, labels: list[str]) -> Column:
    """struct(native, latin): words of three letters or more that aren't labels, by alphabet."""
    skip = F.array(*[F.lit(w.upper()) for w in labels]).cast("array<string>")
    words = F.filter(F.regexp_extract_all(text(c), F.lit("[A-Za-zЀ-ӿ]{3,}"), F.lit(0)), lambda w: ~F.array_contains(skip, F.upper(w)))
    return F.struct(F.filter(words, has_cyrillic).alias("native"), F.filter(words, lambda w: ~has_cyrillic(w)).alias("latin"))


def language_of(c: Column) -> Column:
    """ru for any Cyrillic letter, en for any Latin one, else null."""
    return F.when(has_cyrillic(c), "ru").when(text(c).rlike("[A-Za-z]"), "en")


# Shapes


def camel_key(label: Column) -> Column:
    """The camel-case key of a printed label, without its section number, what stands in parentheses, and punctuation."""
    v = F.regexp_replace(F.regexp_replace(text(label), r"^\s*[0-9]+(\.[0-9]+)*[.)]?\s*", ""), r"\([^)]*\)", " ")
    words = F.filter(F.split(F.lower(F.regexp_replace(v, "[^A-Za-z0-9]+", " ")), " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 999)))), "")


def camel_case(key: Column) -> Column:
    """``a_b`` and ``a-b`` as ``aB``."""
    parts = F.split(text(key), "[_-]")
    return F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 999)))), "")


def unit_number(c: Column) -> Column:
    """Digits with O as zero if four to six, else null."""
    d = F.regexp_replace(F.translate(F.upper(text(c)), "O", "0"), "[^0-9]", "")
    return F.when(F.length(d).between(4, 6), d)


def slug(c: Column, most: int = 60) -> Column:
    """A file name: characters that file systems refuse become spaces, which become single underscores."""
    v = F.trim(F.regexp_replace(F.regexp_replace(text(c), r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " "))
    return F.replace(F.trim(F.substring(v, 1, most)), F.lit(" "), F.lit("_"))


def escape_html(c: Column) -> Column:
    return reduce(lambda v, kv: F.replace(v, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), text(c))


def comma_list(c: Column) -> Column:
    """Trimmed items of a comma list in which double quotes hold commas."""
    items = F.regexp_extract_all(text(c), F.lit('(?:"[^"]*"|[^,"])+'), F.lit(0))
    return F.filter(F.transform(items, lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))), lambda x: x != "")


def quoted_token(c: Column) -> Column:
    """A bare word as it is, anything else in quotes; with both kinds of quotes inside, the double ones are doubled."""
    v = text(c)
    bare, double, single = v.rlike(r"^[^\s\"'():#][^\s\"'():]*$"), v.contains('"'), v.contains("'")
    return (
        F.when(bare, v).when(~double, F.concat(F.lit('"'), v, F.lit('"'))).when(~single, F.concat(F.lit("'"), v, F.lit("'")))
        .otherwise(F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"')))
    )


def full_name(surname: Column, given: Column) -> Column:
    return F.nullif(F.concat_ws(" ", blank_to_null(surname), blank_to_null(given)), F.lit(""))


def name_half(c: Column, first: bool) -> Column:
    """The first word of a name, or the rest; null where there is none."""
    words = F.split(F.trim(text(c)), r"\s+")
    return F.nullif(F.element_at(words, 1) if first else F.array_join(F.slice(words, 2, 99), " "), F.lit(""))


def hyphens_to_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), "[-­‐-―−﹣－]", " "), r"\s+", " "))


def words_agree(a: Column, b: Column, least: int = 5, distance: int = 2) -> Column:
    """Whether every word of the one with fewer words has one in the other within ``distance`` edits (words under ``least`` letters: equal)."""
    x, y = F.split(a, " "), F.split(b, " ")
    fewer, more = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    near = lambda w, o: F.levenshtein(w, o) <= F.when(F.length(w) >= least, distance).otherwise(0)
    return F.forall(fewer, lambda w: F.exists(more, lambda o: near(w, o)))


# Words for kinds of places, in Vietnamese (without accents) and English.
PLACE_WORDS = ["thanh pho", "tp", "tinh", "quan", "huyen", "phuong", "xa", "tt", "thi tran", "city", "province", "district", "ward", "commune", "town"]


def place_key(c: Column) -> Column:
    """A place's plain name without words for its kind and punctuation."""
    v = F.regexp_replace(plain_latin(c), r"\s+", " ")
    v = F.regexp_replace(v, rf"(?<![a-z0-9_])(?:{'|'.join(PLACE_WORDS)})(?![a-z0-9_])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(v, "[.,]", " "), r"\s+", " "))


def address_parts(c: Column) -> Column:
    """The parts of an address between commas, trimmed, blank ones left out, with a comma put before each house, building or flat mark."""
    marked = F.regexp_replace(text(c), r"(?iu)(?<=[^\s,])\s+(?=(?:д|дом|к|корп|корпус|стр|кв|квартира|house|bldg|building|flat|apt)\.?\s*\d)", ", ")
    return F.filter(F.transform(F.split(marked, ","), lambda x: F.trim(x)), lambda x: x != "")


def looks_like_address(c: Column, least: int = 2) -> Column:
    """At least ``least`` marks of an address (unit words, a postal code), or one with three parts and a digit."""
    v = text(c)
    marks = F.regexp_count(v, F.lit(r"(?iu)(?<![\p{L}])(?:г|ул|д|кв|обл|р-н|пр-т|пер|street|st|house|flat|apt|city|region)\.?(?=[\s,\d])")) + F.regexp_count(v, F.lit(r"(?<!\d)\d{6}(?!\d)"))
    return (marks >= least) | ((marks >= 1) & (F.size(address_parts(c)) >= 3) & v.rlike(r"\d"))


def confirmation(c: Column, words: list[str]) -> Column:
    """Whether a whole message is one of ``words``, whatever its case and end marks."""
    return F.lower(F.trim(F.regexp_replace(text(c), r"[\s.!)]+$", ""))).isin([w.lower() for w in words])


def captcha_like(c: Column) -> Column:
    """Four to eight letters and digits and nothing else."""
    return F.trim(text(c)).rlike("^[A-Za-z0-9]{4,8}$")
