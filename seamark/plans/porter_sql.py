"""The published stemming algorithm (Porter, 1980) as SQL, written for itself so that it can check the engine's stems."""

from __future__ import annotations

_C, _V = "[^aeiouy]", "[aeiouy]"
_SOME, _MANY, _ONE = f"^{_C}*{_V}+{_C}", f"^{_C}*({_V}+{_C}+){{2}}", f"^{_C}*{_V}+{_C}+{_V}*$"
_SHORT = f"{_C}{_V}[^aeiouywxY]$"

# Endings of the second, third and fourth step, the longer before the shorter that end alike.
_SECOND = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("ousli", "ous"), ("eli", "e"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_FOURTH = ["ement", "ment", "ance", "ence", "able", "ible", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _endings(rules: list[tuple[str, str]], least: str) -> str:
    """CASE over a word w: the first ending that fits is replaced if enough stands before it."""
    parts = []
    for end, new in rules:
        stem = f"left(w, length(w) - {len(end)})"
        sound = f" AND regexp_matches({stem}, '[st]$')" if end == "ion" else ""
        parts.append(f"WHEN ends_with(w, '{end}') THEN CASE WHEN {_has(stem, least)}{sound} THEN {stem} || '{new}' ELSE w END")
    return "CASE " + " ".join(parts) + " ELSE w END"


def stems(source: str) -> str:
    """CTEs that end in stems (term, stem) of the distinct terms of table ``source``.  A y that is a consonant is written Y on the way."""
    drop = lambda n: f"left(w, length(w) - {n})"
    steps = [
        "SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS w FROM st_all WHERE regexp_matches(term, '^[a-z]{3,}$')",
        f"SELECT term, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {drop(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {drop(1)} ELSE w END AS w FROM st_1",
        f"""SELECT term, w, CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND {_has(drop(2), _V)} THEN {drop(2)}
            WHEN ends_with(w, 'ing') AND {_has(drop(3), _V)} THEN {drop(3)} END AS cut FROM st_2""",
        f"""SELECT term, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_has(drop(3), _SOME)} THEN {drop(1)} ELSE w END WHEN cut IS NULL THEN w
            WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e'
            WHEN right(cut, 1) = right(left(cut, length(cut) - 1), 1) AND regexp_matches(cut, '[^aeiouylsz]$') THEN left(cut, length(cut) - 1)
            WHEN {_has("cut", _ONE)} AND {_has("cut", _SHORT)} THEN cut || 'e' ELSE cut END AS w FROM st_3""",
        f"SELECT term, CASE WHEN lower(right(w, 1)) = 'y' AND {_has(drop(1), _V)} THEN {drop(1)} || 'i' ELSE w END AS w FROM st_4",
        f"SELECT term, {_endings(_SECOND, _SOME)} AS w FROM st_5",
        f"SELECT term, {_endings(_THIRD, _SOME)} AS w FROM st_6",
        f"SELECT term, {_endings([(e, '') for e in _FOURTH], _MANY)} AS w FROM st_7",
        f"""SELECT term, CASE WHEN ends_with(w, 'e') AND ({_has(drop(1), _MANY)} OR ({_has(drop(1), _ONE)} AND NOT {_has(drop(1), _SHORT)})) THEN {drop(1)} ELSE w END AS w FROM st_8""",
        f"SELECT term, lower(CASE WHEN ends_with(w, 'll') AND {_has(drop(1), _MANY)} THEN {drop(1)} ELSE w END) AS w FROM st_9",
    ]
    chain = ", ".join(f"st_{k} AS ({s})" for k, s in enumerate(steps, 1))
    return f"st_all AS (SELECT DISTINCT term FROM {source}), {chain}, stems AS MATERIALIZED (SELECT st_all.term, coalesce(w, st_all.term) AS stem FROM st_all LEFT JOIN st_{len(steps)} USING (term))"
