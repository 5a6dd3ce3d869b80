"""Pieces of SQL that the oracles share."""

from __future__ import annotations

#: Unicode white space, as the engine strips it.
SPACES = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def split_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACES}]+'), lambda t: t <> '')"


def normalized(x: str) -> str:
    """The comparable form of an answer without decomposition."""
    kept = f"translate({strip(f'lower({x})')}, chr(2305) || chr(2364) || chr(8204) || chr(8205), chr(2306))"
    return f"array_to_string({split_words(f'''regexp_replace({kept}, '[\\p{{P}}\\p{{S}}]', ' ', 'g')''')}, ' ')"


def number(x: str) -> str:
    """Canonical form of the first number of a text."""
    found = f"regexp_extract(translate(replace(replace({x}, ',', ''), '$', ''), '०१२३४५६७८९', '0123456789'), '-?\\d+(?:\\.\\d+)?')"
    return f"""(SELECT CASE WHEN f = '' OR f IS NULL THEN NULL
        WHEN contains(f, '.') THEN (CASE WHEN starts_with(f, '-') THEN '-' ELSE '' END) || w || (CASE WHEN d <> '' THEN '.' || d ELSE '' END)
        WHEN w = '0' THEN '0' ELSE (CASE WHEN starts_with(f, '-') THEN '-' ELSE '' END) || w END
        FROM (SELECT f, coalesce(nullif(ltrim(regexp_replace(split_part(f, '.', 1), '^-', ''), '0'), ''), '0') AS w, rtrim(split_part(f, '.', 2), '0') AS d FROM (SELECT {found} AS f)))"""


def overlap(a: str, b: str) -> str:
    """Size of the multiset intersection of two lists, by the distinct words of the second, a short one."""
    return f"coalesce(list_sum(list_transform(list_distinct({b}), lambda t: least(len(list_filter({a}, lambda y: y = t)), len(list_filter({b}, lambda y: y = t))))), 0)"


def f1(a: str, b: str) -> str:
    same = overlap(a, b)
    return f"""CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN (CASE WHEN len({a}) = len({b}) THEN 1.0 ELSE 0.0 END)
        WHEN {same} = 0 THEN 0.0 ELSE 2.0 * ({same} / len({a})) * ({same} / len({b})) / (({same} / len({a})) + ({same} / len({b}))) END"""


def contains_either(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN (CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END) WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 1.0 ELSE 0.0 END"
