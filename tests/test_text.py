"""Key rules against their known answers."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.folding import fold_accents

# Books that don't exist, one for each branch of the rules.
TITLES = [
    ("Salt Harbour", "salt harbour"), ("Salt Harbour (Signed Special Edition)", "salt harbour"), ("Salt Harbour [Large Print]", "salt harbour"),
    ("Salt Harbour 07", "salt harbour"), ("Salt Harbour #12", "salt harbour"), ("Salt Harbour, Volume 4", "salt harbour"), ("Salt Harbour Part 9", "salt harbour"),
    ("Quiet Engines: Annotated Edition", "quiet engines"), ("Quiet Engines, 10th Anniversary Printing", "quiet engines"),
    ("Salt Harbour: The Lantern Keepers", "salt harbour the lantern keepers"), ("Kilometre 932", "kilometre 932"), ("Room 21", "room 21"), ("Gate 6", "gate 6"),
    ("2077", "2077"), (None, ""), ("Über  den Öresund", "uber den oresund"),
]
SHOWN = [("Quiet Engines (Revised)", "Quiet Engines"), ("Quiet Engines, Vol. 3", "Quiet Engines"), ("Quiet Engines: A Memoir", "Quiet Engines: A Memoir"), ("", "")]
KINDS = [
    ("Lantern Keepers 4-Book Bundle", None, "collection"), ("The Tidewater Omnibus", None, "collection"),
    ("Quiet Engines Box Set", None, "collection"), ("Collected Letters", None, "single"), ("The Complete Gardener", None, "single"),
    ("Lantern Keepers", "The Complete Series", "collection"), ("Twelve books on rain", None, "single"), ("12 books on rain", None, "collection"),
]
ISBNS = [("0306406152", "9780306406157"), ("978-0-306-40615-7", "9780306406157"), ("080442957X", "9780804429573"), (None, None), ("", None), ("99", None), ("X306406152", None)]
SERIES = [
    ("Songs of the Delta ; 8", ("Songs of the Delta", 8.0)), ("Delta Cycle, no. 3", ("Delta Cycle", 3.0)), ("The Long Canal (14)", ("The Long Canal", 14.0)),
    ("Canal, volume 21", ("Canal", 21.0)), ("Canal #21", ("Canal", 21.0)), ("Mudlark ; v. 1.5", ("Mudlark", 1.5)), ("Mudlark days, bk. 6", ("Mudlark days", 6.0)),
    ("Northern Lines ; 9.", ("Northern Lines", 9.0)), ("Harbour paperbacks", ("Harbour paperbacks", None)), ("2077", None), ("; 5", None), ("   ", None), (None, None),
]
IN_TITLE = [
    ("The Grey Weir (Songs of the Delta Series Book 4)", ("Songs of the Delta", 4.0)), ("Low Water (Delta Cycle, #3)", ("Delta Cycle", 3.0)),
    ("The Sluice (The Long Canal, Part 5)", ("The Long Canal", 5.0)), ("Mudlark #6", ("Mudlark", 6.0)),
    ("High Tide: Volume 2 of the Northern Lines", ("Northern Lines", 2.0)), ("Part 4 of 7", None), ("Platform-9", None), ("The Weir", None), ("Ebb (Harbour Paperbacks)", None),
]


def apply(spark, rule, rows, columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in columns))
    return [r["v"] for r in df.select("i", rule(*[F.col(c) for c in columns]).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("rule,cases", [(T.clean_title, TITLES), (T.display_title, SHOWN), (T.normalize_isbn, ISBNS)])
def test_single_text_rules(spark, rule, cases):
    assert apply(spark, rule, [(c[0],) for c in cases], ["a"]) == [c[1] for c in cases]


def test_kinds(spark):
    assert apply(spark, T.classify_kind, [c[:2] for c in KINDS], ["a", "b"]) == [c[2] for c in KINDS]


@pytest.mark.parametrize("rule,cases", [(T.parse_series_string, SERIES), (T.parse_title_series, IN_TITLE)])
def test_series_references(spark, rule, cases):
    found = apply(spark, rule, [(c[0],) for c in cases], ["a"])
    assert [tuple(f) if f else None for f in found] == [c[1] for c in cases]


def test_canonical_key_takes_the_first_author(spark):
    assert apply(spark, T.canonical_key, [("Salt Harbour (Special Edition)", "Ana Mirel, Joost van Aa")], ["a", "b"]) == ["salt harbour\x1fana mirel"]


def test_slugs(spark):
    names = ["Weir", "Crème Brûlée", "Salt 'n' Pepper", "海の本", "a" * 90, "word " * 30]
    slugs = apply(spark, T.slugify, [(n,) for n in names], ["a"])
    assert slugs[:4] == ["weir", "creme-brulee", "salt-n-pepper", "series"]
    assert len(slugs[4]) == 80 and slugs[5] == "-".join(["word"] * 16)


def test_row_ids_follow_the_standard(spark):
    import uuid

    names = ["work:ol:OL27448W", "series:wd:Q45875", "edition:ol:Ü"]
    assert apply(spark, T.row_id, [(n,) for n in names], ["a"]) == [str(uuid.uuid5(uuid.UUID(T.NAMESPACE), n)) for n in names]


def test_folding_equals_compatibility_decomposition(spark):
    codes = [c for c in (*range(0x20, 0x3400), *range(0xA640, 0xA800), *range(0xAC00, 0xAD00), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800)) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "c int, s string").select("s", fold_accents(F.col("s")).alias("f"))
    for row in df.collect():
        assert row["f"] == "".join(x for x in unicodedata.normalize("NFKD", row["s"]) if not unicodedata.combining(x)), row["s"]


def test_tags_ignore_joined_lines_and_repeat_once(spark):
    blob = "series:Long_Canal Cycle\nFRANCHISE: Long  Canal\nseries:Long Canal Cycle\nseries:a franchise:b\nplain"
    assert apply(spark, T.series_tags, [(blob,)], ["a"]) == [["series:Long Canal Cycle"]]
    assert apply(spark, T.franchise_tags, [(blob,)], ["a"]) == [["franchise:Long Canal"]]
