"""Names in any script as Column expressions (survey X1-X9, X12-X20)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistaspark.functions import scripts

# Blocks of the scripts that are told apart.
SCRIPTS = {
    "cyrillic": "\\u0400-\\u04FF",
    "georgian": "\\u10A0-\\u10FF",
    "armenian": "\\u0530-\\u058F",
    "greek": "\\u0370-\\u03FF",
    "arabic": "\\u0600-\\u06FF",
    "tibetan": "\\u0F00-\\u0FFF",
    "devanagari": "\\u0900-\\u097F",
    "thai": "\\u0E00-\\u0E7F",
    "ethiopic": "\\u1200-\\u137F",
    "japanese": "\\u30A0-\\u30FF\\u3040-\\u309F",
    "korean": "\\uAC00-\\uD7AF\\u1100-\\u11FF",
    "chinese": "\\u4E00-\\u9FFF",
}
# Latin spellings of letters, Cyrillic and Georgian; other scripts are in ``scripts``.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    "і": "i", "ї": "yi", "є": "ye", "ґ": "g", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "ch", "џ": "dzh",
}
GEORGIAN = {
    "ა": "a", "ბ": "b", "გ": "g", "დ": "d", "ე": "e", "ვ": "v", "ზ": "z", "თ": "th", "ი": "i", "კ": "k", "ლ": "l", "მ": "m", "ნ": "n", "ო": "o", "პ": "p", "ჟ": "zh", "რ": "r",
    "ს": "s", "ტ": "t", "უ": "u", "ფ": "ph", "ქ": "q", "ღ": "gh", "ყ": "qh", "შ": "sh", "ჩ": "ch", "ც": "ts", "ძ": "dz", "წ": "ts", "ჭ": "ch", "ხ": "kh", "ჯ": "j", "ჰ": "h",
}
LATIN = CYRILLIC | GEORGIAN | scripts.others()
# Cyrillic spellings of Latin letters, runs of several first, the longest before the shorter.
TO_CYRILLIC_RUNS = (
    ("tsch", "ч"), ("dsch", "дж"), ("shch", "щ"), ("sch", "ш"), ("zh", "ж"), ("kh", "х"), ("ph", "ф"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("yo", "ё"), ("ye", "е"),
)
TO_CYRILLIC = {
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "дж", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "q": "к",
    "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "й", "z": "з",
}
# Latin letters that have no base letter by decomposition.
UNDECOMPOSED = {"ß": "s", "ø": "o", "ł": "l", "ð": "d", "þ": "t", "ŋ": "ng", "æ": "e", "œ": "oe", "đ": "d", "ħ": "h"}
BREAKS = (" ", "\t", "\n", "-", "–", "—", "(")
BLANK = "—"


def decomposed() -> dict[str, str]:
    """Base letters of the accented small Latin letters, by canonical decomposition."""
    pairs = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)])
    return {c: d[0] for c, d in pairs if len(d) > 1 and d[0].isascii() and d[0].islower()}


def _once(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _list(values) -> Column:
    """Constant texts as one array; as one literal, since a plan with a literal for each takes long to build."""
    return F.split(F.lit(",".join(values)), ",")


def _looked_up(c: Column, table: dict[str, str]) -> Column:
    """What a table of single characters has for a character, else null: its place among the keys is that of its spelling."""
    at = F.instr(F.lit("".join(table)), c)
    return F.when((c != "") & (at > 0), F.get(_list(table.values()), at - 1))


def _spelled(chars: Column, table: dict[str, str]) -> Column:
    """Each character as the table spells it, small or as it is written; others as they are."""
    return F.array_join(F.transform(chars, lambda c: F.coalesce(_looked_up(F.lower(c), table), _looked_up(c, table), c)), "")


def _hangul(c: Column) -> Column:
    """A Hangul syllable by the numbers of its letters."""
    n = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    letters = map(_list, (scripts.INITIALS, scripts.MEDIALS, scripts.FINALS))
    places = (n / 588, n % 588 / 28, n % 28)
    return F.concat(*[F.get(x, F.floor(i).cast("int")) for x, i in zip(letters, places, strict=True)])


def latin_letters(name: Column, table: dict[str, str] | None = None, readings: dict[str, str] | None = None) -> Column:
    """A name letter by letter in Latin ones: by the table, Hangul by its rule, Chinese characters by their readings, a capital and a space for each."""
    table, readings = LATIN if table is None else table, scripts.CHINESE if readings is None else readings
    as_is = table | {c: r.capitalize() for c, r in readings.items()}
    spell = lambda c: F.when(c < "\u0080", c).when(c.between("\uac00", "\ud7a3"), _hangul(c)).otherwise(F.coalesce(_looked_up(F.lower(c), table), _looked_up(c, as_is), c))
    spelled = F.transform(F.split(name, ""), spell)
    joined = F.array_join(spelled, "")
    return F.when(name.rlike(f"[{SCRIPTS['chinese']}]"), F.regexp_replace(joined, "([a-z])([A-Z])", "$1 $2")).when(name.rlike(r"[^\x00-\x7F]"), joined).otherwise(name)


def _capitalised(text: Column) -> Column:
    """Upper case at the start and after spaces, dashes and an opening bracket."""
    chars = F.split(text, "")
    starts = lambda i: (i == 0) | F.get(chars, i - 1).isin(*BREAKS)
    return F.array_join(F.transform(chars, lambda c, i: F.when(starts(i), F.upper(c)).otherwise(c)), "")


def script(name: Column) -> Column:
    """The script of a name, latin where it has none of the others, mixed with several."""
    found = F.filter(F.array(*[F.when(name.rlike(f"[{block}]"), F.lit(s)) for s, block in SCRIPTS.items()]), lambda s: s.isNotNull())
    return F.when(F.size(found) == 0, "latin").when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("mixed")


def to_latin(name: Column, table: dict[str, str] | None = None) -> Column:
    """A name in Latin letters, words capitalised."""
    return _capitalised(latin_letters(name, table))


def to_cyrillic(name: Column) -> Column:
    """A Latin name in Cyrillic letters, roughly: accents dropped, runs of letters first."""
    text = _spelled(F.split(F.lower(name), ""), decomposed() | UNDECOMPOSED)
    for run, letter in TO_CYRILLIC_RUNS:
        text = F.replace(text, F.lit(run), F.lit(letter))
    text = F.split(_spelled(F.split(text, ""), TO_CYRILLIC), "")
    starts = lambda i: (i == 0) | F.get(text, i - 1).isin(" ", "\t", "\n")
    return F.array_join(F.transform(text, lambda c, i: F.when(starts(i), F.upper(c)).otherwise(c)), "")


def is_cyrillic(name: Column) -> Column:
    """X4."""
    return name.rlike(f"[{SCRIPTS['cyrillic']}]")


def readable_name(name: Column, locale: str) -> Column:
    """In Cyrillic for ``ru``, else in Latin letters."""
    return F.when(is_cyrillic(name), name).otherwise(to_cyrillic(name)) if locale == "ru" else to_latin(name)


def normalised(name: Column, table: dict[str, str] | None = None) -> Column:
    """Latin spelling, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(latin_letters(name, table)), "[^a-z0-9]+", "")


def plain(name: Column) -> Column:
    """Lower case, letters and digits of any script."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def forms(name: Column, latin: bool = False) -> Column:
    """The name in one word, and each of its words where it has several."""
    text, cut = (F.lower(latin_letters(name)), "[^a-z0-9]+") if latin else (F.lower(name), r"[^\p{L}\p{N}]+")
    joined = lambda words: F.array(F.array_join(words, ""))
    return _once(F.filter(F.split(text, cut), lambda w: w != ""), lambda words: F.when(F.size(words) > 1, F.concat(joined(words), words)).otherwise(joined(words)))


def match_quality(names: list[Column], wanted: Column) -> Column:
    """True for a name that equals what is wanted, false for one that contains it, else null."""
    known = F.filter(F.array(*[normalised(n) for n in names]), lambda n: n.isNotNull() & (n != ""))
    return _once(known, lambda k: F.when(F.exists(k, lambda n: n == wanted), True).when(F.exists(k, lambda n: F.contains(n, wanted)), False))


def typo_budget(length: Column) -> Column:
    """Typos allowed for a typed name of that many letters."""
    return F.when(length < 5, 0).when(length <= 8, 1).otherwise(2)


def peak_name(name: Column, name_ru: Column, name_en: Column, locale: str) -> Column:
    """The name in the locale's language, else spelled in its letters."""
    known = F.coalesce(name, F.lit(BLANK))
    latin = F.when(script(known) == "latin", known).otherwise(to_latin(known))
    if locale == "ru":
        return F.coalesce(F.nullif(name_ru, F.lit("")), F.when(is_cyrillic(known), known).otherwise(to_cyrillic(latin)))
    return F.coalesce(name_en, latin)


def in_locale(ru: Column, en: Column, locale: str, plain_title: Column | None = None) -> Column:
    """Title, label or core of a region: the locale's, else the plain one, else the other's, else empty."""
    first, last = (ru, en) if locale == "ru" else (en, ru)
    return F.coalesce(first, *([] if plain_title is None else [plain_title]), last, F.lit(""))


def _metres(locale: str) -> str:
    return "м" if locale == "ru" else "m"


def label_parts(name: Column, ele: Column, distance_m: Column, locale: str = "en") -> Column:
    """X14: 'name · 4127 m · 12 km', one decimal below 10 km, no height where none is known."""
    km = F.when(distance_m < 10000, F.format_string("%.1f", distance_m / 1000)).otherwise(F.format_string("%.0f", distance_m / 1000))
    height = F.concat(F.floor(ele + 0.5).cast("long").cast("string"), F.lit(" " + _metres(locale)))
    return F.concat_ws(" · ", name, height, F.concat(km, F.lit(" км" if locale == "ru" else " km")))


def slug(text: Column) -> Column:
    """Letters, digits and single dashes, at most 40."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)


def photo_filename(peak: Column, region: Column, at: Column, prefix: str = "view") -> Column:
    """The application's prefix, the peak, else the region, and the second."""
    known = lambda x: F.nullif(slug(to_latin(x)), F.lit(""))
    return F.concat(F.concat_ws("-", F.lit(prefix), F.coalesce(known(peak), known(region)), F.date_format(at, "yyyy-MM-dd-HHmmss")), F.lit(".png"))


def numbered(filename: Column, number: Column) -> Column:
    """The second of a name becomes name-2."""
    return F.when(number > 1, F.concat(F.regexp_replace(filename, r"\.png$", "-"), number.cast("string"), F.lit(".png"))).otherwise(filename)


def store_prefix(url: Column) -> Column:
    """The last part of a path and a slash; nothing for the global source."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.when((last == "") | (last == "global"), "").otherwise(F.concat(last, F.lit("/")))


def tile_key(lod: Column, tx: Column, ty: Column) -> Column:
    """X16."""
    return F.concat_ws("/", lod, tx, ty)


def hit_key(lat: Column, lon: Column) -> Column:
    """The same peak out of several sources has the same five decimals."""
    return F.format_string("%.5f,%.5f", lat, lon)


def lookup(table: Column, key: Column) -> Column:
    """An entry of the dictionary, or the key."""
    return F.coalesce(table[key], key)


def name_tokens(name: Column, most: int = 7) -> Column:
    """The words of a name with the space or dash that ends each, where a line may break; nothing for a name of more than ``most``."""
    words = F.filter(F.split(name, r"(?<=[ \-])"), lambda w: w != "")
    return F.when(F.size(words) <= most, words).otherwise(F.array(name))


def caption_parts(place: Column, lat: Column, lon: Column, height: Column, locale: str = "en") -> Column:
    """Place, latitude and longitude with their side, height."""
    at = lambda v, plus, minus: F.concat(F.regexp_replace(F.format_string("%.5f", F.abs(v)), r"\.?0+$", ""), F.when(F.round(v, 5) >= 0, f"°{plus}").otherwise(f"°{minus}"))
    metres = F.concat(F.floor(height + 0.5).cast("long").cast("string"), F.lit(" " + _metres(locale)))
    return F.array_compact(F.array(place, at(lat, "N", "S"), at(lon, "E", "W"), metres))
