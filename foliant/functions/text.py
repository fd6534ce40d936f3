"""Key building: every identity rule as a ``Column -> Column`` function.

The rules are plain column expressions, so a key can be computed in the scan
stage of any job without leaving whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.folding import fold_accents

# --- fixed values: they decide which rows count as the same book -------------
EDITION_WORDS = (
    r"deluxe|slipcase|illustrated|anniversary|revised|reprint|unabridged|abridged|annotated|movie tie[- ]?in"
    r"|collector'?s|special|expanded|international|[0-9]+(?:st|nd|rd|th)")
VOLUME_WORDS = r"#|vol\.?|volume|book|part"
MAX_VOLUME_NUMBER = 20
COLLECTION_PHRASES = (
    "box(?:ed)? set", "omnibus", "bundle", "collection", "complete series",
    "books? [0-9]+\\s*[-–—]\\s*[0-9]+", "[0-9]+\\s*[-–—]\\s*book", "[0-9]+ books",
)
SERIES_MARK = r"(?:#|no\.?|v\.|vol\.?|volume|book|bk\.?|part)"
SERIES_POSITION = r"([0-9]{1,3}(?:\.[0-9]{1,2})?)"
SERIES_NAME_LIMIT = 150
SLUG_LIMIT = 80
TEXT_LIMIT = 500
COVER_URL = "https://covers.openlibrary.org/b/id/{}-L.jpg"
NAMESPACE = "7c1d0a4e-3b5f-4e2a-9d6c-8f4b2a1e0c37"
PROVENANCE = {0: "override", 1: "wikidata", 2: "ol_tag", 3: "ol_edition_series", 4: "title_pattern"}
CONFIDENCE = {0: "high", 1: "high", 2: "medium", 3: "medium", 4: "low"}
BRACKETED = r"[\(\[][^\)\]]*[\)\]]"
EDITION_TAIL = (
    r"(?i)\s*[:,]\s*(?:the\s+)?(?:" + EDITION_WORDS + r")[\p{L}\p{N}_\s'-]*?(?:edition|printing)?\s*$")
VOLUME_WORD = rf"(?i)(?:{VOLUME_WORDS})\s*[0-9]{{1,3}}\s*$"
VOLUME_TAIL = rf"(?i)\s*(?:,\s*)?(?:{VOLUME_WORDS})?\s*([0-9]{{1,3}})\s*$"
SERIES_FORMS = (
    rf"(?i)^(.+?)\s*;\s*(?:{SERIES_MARK}\s*)?{SERIES_POSITION}$",
    rf"(?i)^(.+?),\s*{SERIES_MARK}\s*{SERIES_POSITION}$",
    rf"(?i)^(.+?)\s*\(\s*(?:{SERIES_MARK}\s*)?{SERIES_POSITION}\s*\)$",
    rf"(?i)^(.+?)\s+{SERIES_MARK}\s*{SERIES_POSITION}$",
)
# (pattern, group of the name, group of the position)
TITLE_FORMS = (
    (rf"(?i)\(([^()]+?)(?:\s+series)?,?\s+{SERIES_MARK}\s*{SERIES_POSITION}\s*\)", 1, 2),
    (r"(?i)(?:^|[^\p{L}\p{N}_])(?:book|volume|part)\s+([0-9]{1,3})\s+of\s+(?:the\s+)?"
     r"([^():]+?)(?:\s+series)?\s*\)?\s*$", 2, 1),
    (rf"^([^()#]+?)\s*#\s*{SERIES_POSITION}\s*$", 1, 2),
)
# -----------------------------------------------------------------------------

KEY_SEPARATOR = "\x1f"
_WORDLESS = r"[^\p{L}\p{N}_]+"
_BLANKS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"

COLLECTION = "|".join(f"(?:^| )(?:{p})(?: |$)" for p in COLLECTION_PHRASES)


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and hand it to ``use``, which may name it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, _BLANKS, " "))


def strip_chars(column: Column, chars: str, left: bool = True) -> Column:
    """Trim any of ``chars`` (a regex class body) from the right, and from the left if asked."""
    right = F.regexp_replace(column, f"[{chars}]+$", "")
    return F.regexp_replace(right, f"^[{chars}]+", "") if left else right


def normalize_text(column: Column) -> Column:
    """Accents folded, lower case, words separated by single spaces; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(_text(column))), _WORDLESS, " "))


def series_key(column: Column) -> Column:
    """Like K01 but accents stay."""
    return F.trim(F.regexp_replace(F.lower(_text(column)), _WORDLESS, " "))


def ol_key(name: Column) -> Column:
    key = series_key(name)
    return F.when(key != "", F.concat(F.lit("ol:"), key))


def tag_name(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^[^:]*:", "")


def tag_external_id(tag: Column) -> Column:
    return F.concat(F.substring_index(tag, ":", 1), F.lit(":"), series_key(tag_name(tag)))


def strip_edition_noise(title: Column) -> Column:
    """Packaging removed, text otherwise kept: bracketed groups, edition tails, volume numbers."""
    def unmarked(plain: Column) -> Column:
        number = F.regexp_extract(plain, VOLUME_TAIL, 1).try_cast("int")
        remainder = strip_chars(F.regexp_replace(plain, VOLUME_TAIL, ""), r" ,:\-", left=False)
        enough = F.size(F.split(collapse(remainder), " ")) >= 2
        return (
            F.when(~plain.rlike(r"[0-9]\s*$"), plain)
            .when(plain.rlike(VOLUME_WORD),
                  strip_chars(F.regexp_replace(plain, VOLUME_WORD, ""), r" ,:\-", left=False))
            .when((number <= MAX_VOLUME_NUMBER) & enough, remainder)
            .otherwise(plain)
        )

    return bind(F.regexp_replace(F.regexp_replace(title, BRACKETED, " "), EDITION_TAIL, ""), unmarked)


def clean_title(title: Column) -> Column:
    """The grouping form of a title."""
    return normalize_text(strip_edition_noise(_text(title)))


def display_title(title: Column) -> Column:
    """The readable form, case kept."""
    return strip_chars(F.regexp_replace(strip_edition_noise(_text(title)), _BLANKS, " "), r" ,:\-")


def canonical_key(title: Column, author: Column) -> Column:
    """Cleaned title and normalized first author."""
    first = F.substring_index(_text(author), ",", 1)
    return F.concat(clean_title(title), F.lit(KEY_SEPARATOR), normalize_text(first))


def heuristic_id(key: Column) -> Column:
    """K05."""
    return F.sha1(F.encode(key, "UTF-8"))


def normalize_isbn(raw: Column) -> Column:
    """13 digits as they are; ten characters get the 978 prefix and a new check digit."""
    def upgraded(digits: Column) -> Column:
        core = F.concat(F.lit("978"), F.substring(digits, 1, 9))
        total = F.aggregate(
            F.sequence(F.lit(1), F.lit(12)), F.lit(0),
            lambda acc, i: acc + F.substring(core, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
        check = F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")
        return (
            F.when(digits.rlike("^[0-9]{13}$"), digits)
            .when(digits.rlike("^[0-9]{9}[0-9Xx]$"), F.concat(core, check))
        )

    return bind(F.regexp_replace(_text(raw), "[^0-9Xx]", ""), upgraded)


def classify_kind(title: Column, subtitle: Column) -> Column:
    """K07."""
    blob = normalize_text(F.concat_ws(" ", _text(title), _text(subtitle)))
    return F.when(blob.rlike(COLLECTION), F.lit("collection")).otherwise(F.lit("single"))


def join_subjects(subjects: Column) -> Column:
    """One subject per line; nothing gives null."""
    blob = F.array_join(subjects, "\n")
    return F.when(blob != "", blob)


def split_subjects(blob: Column) -> Column:
    return F.filter(F.split(_text(blob), "\n"), lambda s: s != "")


def _tags(lines: Column, prefix: str) -> Column:
    def tag(line: Column) -> Column:
        stripped = collapse_edges(line)
        rest = F.substring(stripped, len(prefix) + 2, 1 << 30)
        name = collapse(F.replace(rest, F.lit("_"), F.lit(" ")))
        usable = F.lower(stripped).startswith(prefix + ":") & ~rest.contains(":") & (name != "")
        return F.when(usable, F.concat(F.lit(prefix + ":"), name))

    return F.array_distinct(F.filter(F.transform(lines, tag), lambda t: t.isNotNull()))


def collapse_edges(column: Column) -> Column:
    """Strip white space at both ends, inner spaces kept."""
    return F.regexp_replace(F.regexp_replace(column, "^" + _BLANKS, ""), _BLANKS + "$", "")


def franchise_tags(subjects: Column) -> Column:
    """K09, franchise half: distinct tags in first-seen order."""
    return _tags(F.split(_text(subjects), "\n"), "franchise")


def series_tags(subjects: Column) -> Column:
    """K09, series half."""
    return _tags(F.split(_text(subjects), "\n"), "series")


def slugify(name: Column, max_length: int = SLUG_LIMIT) -> Column:
    """ASCII words joined by '-', cut at a word boundary."""
    def capped(cleaned: Column) -> Column:
        window = F.substring(cleaned, 1, max_length)
        cut_inside_word = (F.substring(cleaned, max_length + 1, 1) != "-") & window.contains("-")
        shorter = F.when(cut_inside_word, F.regexp_replace(window, "-[^-]*$", "")).otherwise(window)
        short = F.when(F.length(cleaned) > max_length, F.trim(shorter, F.lit("-"))).otherwise(cleaned)
        return F.when(cleaned == "", F.lit("series")).otherwise(short)

    ascii_name = F.regexp_replace(fold_accents(_text(name)), r"[^\x00-\x7f]", "")
    words = F.regexp_replace(F.replace(F.lower(ascii_name), F.lit("'"), F.lit("")), "[^a-z0-9]+", "-")
    return bind(F.trim(words, F.lit("-")), capped)


def row_id(identity: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID (version 5)."""
    def shaped(digest: Column) -> Column:
        variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat_ws(
            "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
            F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))

    return F.when(identity.isNotNull(), bind(
        F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(identity, "UTF-8"))), shaped))


def work_row_id(work: Column) -> Column:
    return row_id(F.concat(F.lit("work:ol:"), work))


def edition_row_id(edition: Column) -> Column:
    return row_id(F.concat(F.lit("edition:ol:"), edition))


def series_row_id(key: Column) -> Column:
    return row_id(F.concat(F.lit("series:"), key))


def _usable_name(raw: Column) -> Column:
    return bind(
        strip_chars(F.regexp_replace(raw, _BLANKS, " "), r" ,;:\-"),
        lambda n: F.when(n.rlike(r"[\p{L}\p{Nl}\p{No}]") & (F.length(n) <= SERIES_NAME_LIMIT), n))


def _reference(name: Column, position: Column) -> Column:
    return F.when(name.isNotNull(), F.struct(name.alias("name"), position.alias("position")))


def _with_position(position: Column) -> Callable[[Column], Column]:
    return lambda name: _reference(name, position)


def parse_series_string(raw: Column) -> Column:
    """``struct(name, position)``; the first form that matches decides."""
    def parsed(text: Column) -> Column:
        result = F.when(text == "", F.lit(None).cast("struct<name:string,position:double>"))
        for form in SERIES_FORMS:
            position = F.regexp_extract(text, form, 2).try_cast("double")
            reference = bind(_usable_name(F.regexp_extract(text, form, 1)), _with_position(position))
            result = result.when(text.rlike(form), reference)
        return result.otherwise(bind(_usable_name(text), lambda n: _reference(n, F.lit(None).cast("double"))))

    return bind(F.trim(F.regexp_replace(collapse(_text(raw)), r"\.+$", "")), parsed)


def parse_title_series(title: Column) -> Column:
    """A title needs a position to name a series; an unusable name falls through."""
    def parsed(text: Column) -> Column:
        found = []
        for form, name_group, position_group in TITLE_FORMS:
            position = F.regexp_extract(text, form, position_group).try_cast("double")
            reference = bind(_usable_name(F.regexp_extract(text, form, name_group)),
                             _with_position(position))
            found.append(F.when(text.rlike(form), reference))
        return F.when(text.rlike("[0-9]"), F.coalesce(*found))

    return bind(collapse(_text(title)), parsed)


def parse_ordinal(raw: Column) -> Column:
    """K15."""
    text = collapse_edges(_text(raw))
    return F.when(text.rlike(r"^[0-9]{1,4}(?:\.[0-9]+)?$"), text.try_cast("double"))


def year_of(text: Column) -> Column:
    """The first standalone year from 1000 to 2099."""
    return F.regexp_extract(
        _text(text), r"(?:^|[^\p{L}\p{N}_])(1[0-9]{3}|20[0-9]{2})(?![\p{L}\p{N}_])", 1).try_cast("int")


def leading_year(text: Column) -> Column:
    """K16, sibling rule: a text that starts with four digits."""
    return F.regexp_extract(_text(text), r"^([0-9]{4})", 1).try_cast("int")


def cover_url(cover_id: Column) -> Column:
    """K19."""
    before, after = COVER_URL.split("{}")
    return F.when(F.coalesce(cover_id, F.lit(0)) != 0,
                  F.concat(F.lit(before), cover_id.cast("string"), F.lit(after)))


def upgrade_cover_url(url: Column) -> Column:
    """K19, upgrade half: secure scheme, no page curl, full size. Applying it twice changes nothing."""
    secure = F.regexp_replace(url, "^http://", "https://")
    flat = F.replace(secure, F.lit("&edge=curl"), F.lit(""))
    return F.replace(flat, F.lit("zoom=1"), F.lit("zoom=0"))


def clip_text(column: Column, limit: int = TEXT_LIMIT) -> Column:
    """K20."""
    return F.substring(column, 1, limit)


def edition_title(column: Column) -> Column:
    clipped = clip_text(column)
    return F.when(_text(clipped) == "", F.lit("Untitled")).otherwise(clipped)


def _filled(column: Column) -> Column:
    """1 for a non-empty text or a non-zero number."""
    return F.when(F.coalesce(column.cast("string"), F.lit("")).isin("", "0"), 0).otherwise(1)


def edition_rank(language: Column, cover: Column, description: Column, isbn: Column, pages: Column,
                 ratings: Column) -> Column:
    """Language tier, cover, description, completeness; the greater struct speaks for the work."""
    code = F.lower(collapse_edges(_text(language)))
    tier = F.when(code == "", 1).when(F.substring_index(code, "-", 1) == "en", 2).otherwise(0)
    complete = 4 * _filled(cover) + _filled(description) + _filled(isbn) + _filled(pages) + _filled(ratings)
    return F.struct(tier.alias("tier"), _filled(cover).alias("has_cover"),
                    _filled(description).alias("has_description"), complete.alias("completeness"))


def identity_keys(stored: Column, title: Column, author: Column) -> Column:
    """The stored key and the key the row would get today."""
    return F.array_distinct(F.array_compact(F.array(stored, canonical_key(title, author))))


def edition_title_key(title: Column, subtitle: Column) -> Column:
    """K23."""
    def present(column: Column) -> Column:
        return F.when(column != "", column)

    return clean_title(F.concat_ws(" ", present(title), present(subtitle)))


def _label(rung: Column, labels: dict[int, str]) -> Column:
    result = F.when(rung == 0, F.lit(labels[0]))
    for value, text in labels.items():
        result = result.when(rung == value, F.lit(text)) if value else result
    return result


def provenance_label(rung: Column) -> Column:
    """K24."""
    return _label(rung, PROVENANCE)


def confidence_label(rung: Column) -> Column:
    return _label(rung, CONFIDENCE)


def ol_number(identifier: Column) -> Column:
    """The first run of digits in an id as a number; 0 when there is none."""
    return F.coalesce(F.regexp_extract(_text(identifier), "([0-9]+)", 1).try_cast("long"), F.lit(0))

