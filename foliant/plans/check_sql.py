"""SQL text of the identity rules, for the checks that need them."""

from __future__ import annotations

from foliant.functions import text as T


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return quoted(pattern)


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\pL\pN_]+', ' ', 'g'))"


def skey(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^\pL\pN_]+', ' ', 'g'))"


def plain(x: str) -> str:
    """Bracketed groups and edition tails removed."""
    return (f"regexp_replace(regexp_replace(coalesce({x}, ''), {re2(T.BRACKETED)}, ' ', 'g'), "
            f"{re2(T.EDITION_TAIL)}, '')")


def unmarked(p: str) -> str:
    """Volume marker removed from an already plain title column ``p``."""
    rest = f"rtrim(regexp_replace({p}, {re2(T.VOLUME_TAIL)}, ''), ' ,:-')"
    number = f"TRY_CAST(regexp_extract({p}, {re2(T.VOLUME_TAIL)}, 1) AS INT)"
    return (f"CASE WHEN regexp_matches({p}, {re2(T.VOLUME_WORD)}) "
            f"THEN rtrim(regexp_replace({p}, {re2(T.VOLUME_WORD)}, ''), ' ,:-') "
            f"WHEN {number} <= {T.MAX_VOLUME_NUMBER} AND len(regexp_split_to_array(trim({rest}), '\\s+')) >= 2 THEN {rest} "
            f"ELSE {p} END")


def clean(x: str) -> str:
    return norm(f"({unmarked(plain(x))})")


def ckey(title: str, author: str) -> str:
    return f"{clean(title)} || chr(31) || {norm(f'''split_part(coalesce({author}, ''), ',', 1)''')}"


def kind(title: str, subtitle: str = "''") -> str:
    blob = norm(f"coalesce({title}, '') || ' ' || coalesce({subtitle}, '')")
    return f"CASE WHEN regexp_matches({blob}, {re2(T.COLLECTION)}) THEN 'collection' ELSE 'single' END"


def uuid5(identity: str) -> str:
    d = f"sha1(unhex('{T.NAMESPACE.replace('-', '')}') || encode({identity}))"
    return (f"(substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || "
            f"translate(substr({d}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({d}, 18, 3) || '-' || substr({d}, 21, 12))")


def slug(x: str) -> str:
    body = (f"trim(regexp_replace(replace(lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7f]', '', 'g')), '''', ''), "
            f"'[^a-z0-9]+', '-', 'g'), '-')")
    cut = (f"CASE WHEN substr({body}, 81, 1) <> '-' AND contains(substr({body}, 1, 80), '-') "
           f"THEN regexp_replace(substr({body}, 1, 80), '-[^-]*$', '') ELSE substr({body}, 1, 80) END")
    return f"coalesce(nullif(CASE WHEN length({body}) > 80 THEN trim({cut}, '-') ELSE {body} END, ''), 'series')"


def isbn(x: str) -> str:
    d = f"regexp_replace(coalesce({x}, ''), '[^0-9Xx]', '', 'g')"
    core = f"('978' || substr({d}, 1, 9))"
    total = " + ".join(f"CAST(substr({core}, {i + 1}, 1) AS INT) * {1 if i % 2 == 0 else 3}" for i in range(12))
    return (f"CASE WHEN regexp_full_match({d}, '[0-9]{{13}}') THEN {d} WHEN regexp_full_match({d}, '[0-9]{{9}}[0-9Xx]') "
            f"THEN {core} || CAST((10 - ({total}) % 10) % 10 AS VARCHAR) END")


def _name(raw: str) -> str:
    n = f"trim(regexp_replace({raw}, '\\s+', ' ', 'g'), ' ,;:-')"
    return f"CASE WHEN regexp_matches({n}, '[\\pL\\p{{Nl}}\\p{{No}}]') AND length({n}) <= {T.SERIES_NAME_LIMIT} THEN {n} END"


def series_ref(x: str) -> tuple[str, str]:
    """(name, position) expressions of K13."""
    t = f"trim(regexp_replace(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')), '\\.+$', ''))"
    name = f"CASE WHEN {t} = '' THEN NULL "
    position = "CASE "
    for form in T.SERIES_FORMS:
        usable = _name(f"regexp_extract({t}, {re2(form)}, 1)")
        name += f"WHEN regexp_matches({t}, {re2(form)}) THEN {usable} "
        position += (f"WHEN regexp_matches({t}, {re2(form)}) THEN CASE WHEN {usable} IS NOT NULL "
                     f"THEN TRY_CAST(regexp_extract({t}, {re2(form)}, 2) AS DOUBLE) END ")
    return name + f"ELSE {_name(t)} END", position + "END"


def title_ref(x: str) -> tuple[str, str]:
    """(name, position) expressions of K14."""
    t = f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
    names, positions = [], "CASE "
    for form, n, p in T.TITLE_FORMS:
        usable = f"CASE WHEN regexp_matches({t}, {re2(form)}) THEN {_name(f'regexp_extract({t}, {re2(form)}, {n})')} END"
        names.append(usable)
        positions += f"WHEN ({usable}) IS NOT NULL THEN TRY_CAST(regexp_extract({t}, {re2(form)}, {p}) AS DOUBLE) "
    return f"coalesce({', '.join(names)})", positions + "END"


def ordinal(x: str) -> str:
    return f"CASE WHEN regexp_full_match(trim(coalesce({x}, '')), '[0-9]{{1,4}}(\\.[0-9]+)?') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def digest(columns: list[str], source: str) -> str:
    """``(rows, digest)`` of ``source``: the sums over all rows of both halves of the md5 of the row's cells."""
    cells = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in sorted(columns))
    half = "coalesce(sum(CAST(CAST('0x' || substr(md5({0}), {1}, 15) AS BIGINT) AS HUGEINT)), 0)"
    return f"SELECT count(*) AS rows, {half.format(cells, 1)} || '-' || {half.format(cells, 16)} AS digest FROM ({source})"
