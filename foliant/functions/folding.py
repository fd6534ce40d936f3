"""Unicode compatibility folding inside the JVM.

Spark has no NFKD function. The mapping is derived once from ``unicodedata``:
characters that fold to at most one character go through ``translate``; the
rest (ligatures, fractions, Hangul syllables) are expanded only in the rows
that hold one. No row leaves the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocks that hold every character with a compatibility mapping or a combining class.
_BLOCKS = (
    (0x00A0, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x10000),
    (0x10000, 0x12000), (0x16A00, 0x17000), (0x1BC00, 0x1FC00), (0x2F800, 0x2FA20),
)
_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
_LEADS = "".join(chr(0x1100 + i) for i in range(19))
_VOWELS = "".join(chr(0x1161 + i) for i in range(21))
_TAILS = "".join(chr(0x11A7 + i) for i in range(28))
_ENTRY = "\x02"
_LATIN_LAST = 0x24F


def _bare(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    single_from, single_to, dropped, longer = [], [], [], {}
    for start, stop in _BLOCKS:
        for code in range(start, stop):
            char = chr(code)
            bare = _bare(char)
            if bare == char:
                continue
            if not bare:
                dropped.append(char)
            elif len(bare) == 1:
                single_from.append(char)
                single_to.append(bare)
            else:
                longer[char] = bare
    return "".join(single_from + dropped), "".join(single_to), longer


def _longer_class(last: int = 0x110000) -> str:
    """A regex class of the characters (up to ``last``) that fold to more than one."""
    codes = sorted(ord(c) for c in _tables()[2] if ord(c) <= last)
    runs: list[list[int]] = []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    if last >= _HANGUL_LAST:
        runs.append([_HANGUL_FIRST, _HANGUL_LAST])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


@lru_cache(maxsize=None)
def _literal(name: str) -> Column:
    """The tables as plain string literals, built once: cheap to plan however often they are used."""
    single_from, single_to, longer = _tables()
    pairs = [(a, b) for a, b in zip(single_from, single_to) if ord(a) <= _LATIN_LAST]
    latin_from, latin_to = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    texts = {
        "from": single_from, "to": single_to, "keys": "".join(longer), "values": _ENTRY.join(longer.values()),
        "class": _longer_class(), "latin_class": _longer_class(_LATIN_LAST), "beyond_ascii": r"[^\x00-\x7f]",
        "beyond_latin": r"[^\x00-\x{24f}]", "latin_from": latin_from, "latin_to": latin_to, "leads": _LEADS, "vowels": _VOWELS, "tails": _TAILS,
    }
    return F.lit(texts[name])


def _translate(text: Column, table: str = "") -> Column:
    return F.call_function("translate", text, _literal(f"{table}from"), _literal(f"{table}to"))


def _expand(char: Column) -> Column:
    """One character to its expansion: Hangul by arithmetic, the rest by its place in the key string."""
    offset = F.ascii(char) - F.lit(_HANGUL_FIRST)

    def letter(letters: str, index: Column) -> Column:
        return F.substring(_literal(letters), (index + 1).cast("int"), F.lit(1))

    tail = F.pmod(offset, F.lit(28))
    syllable = F.concat(
        letter("leads", F.floor(offset / 588)), letter("vowels", F.floor(F.pmod(offset, F.lit(588)) / 28)),
        F.when(tail > 0, letter("tails", tail)).otherwise(F.lit("")))
    is_syllable = (offset >= 0) & (offset <= _HANGUL_LAST - _HANGUL_FIRST)
    place = F.call_function("locate", char, _literal("keys"))
    listed = F.split_part(_literal("values"), F.lit(_ENTRY), place)
    return F.when(is_syllable, syllable).when((char != "") & (place > 0), listed).otherwise(char)


def fold_accents(text: Column) -> Column:
    """NFKD with the combining marks dropped; case is kept.

    Plain ASCII passes through; Latin text needs a small table and a short test; the full tables serve the rest.
    """
    long = F.array_join(F.transform(F.split(text, ""), _expand), "")
    latin = ~F.rlike(text, _literal("beyond_latin")) & ~F.rlike(text, _literal("latin_class"))
    return (
        F.when(~F.rlike(text, _literal("beyond_ascii")), text)
        .when(latin, _translate(text, "latin_"))
        .when(F.rlike(text, _literal("class")), _translate(long))
        .otherwise(_translate(text))
    )
