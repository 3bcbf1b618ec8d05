"""Text expressions for the checking engine (RE2 syntax, explicit Unicode classes)."""

from __future__ import annotations

from driftwatch.functions import text

SPACE = r"\s\p{Z}\x0B\x{85}"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A Unicode-aware pattern in RE2 syntax."""
    out, in_class, i = [], False, 0
    classes = {r"\w": r"\p{L}\p{N}_", r"\s": SPACE, r"\d": r"\p{Nd}"}
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair in classes:
            out.append(classes[pair] if in_class else f"[{classes[pair]}]")
            i += 2
            continue
        if pair == r"\S":
            out.append(f"[^{SPACE}]")
            i += 2
            continue
        if pair[0] == "\\":
            out.append(pair)
            i += 2
            continue
        in_class = True if pair[0] == "[" else False if pair[0] == "]" else in_class
        out.append(pair[0])
        i += 1
    return "".join(out)


def sub(x: str, pattern: str, value: str) -> str:
    return f"regexp_replace({x}, {lit(re2(pattern))}, {lit(value)}, 'g')"


def clean(x: str) -> str:
    return f"trim({sub(x, chr(92) + 's+', ' ')})"


def words(x: str) -> str:
    return f"CAST(CASE WHEN {clean(x)} = '' THEN 0 ELSE len(string_split({clean(x)}, ' ')) END AS BIGINT)"


def normalized(x: str) -> str:
    return clean(sub(f"lower({x})", r"[^\w\s]", " "))


def keywords(x: str) -> str:
    stop = ", ".join(lit(w) for w in text.STOPWORDS)
    return f"list_filter(string_split({normalized(x)}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({stop}))"


def stripped(x: str) -> str:
    out = f"coalesce({x}, '')"
    for pattern in text.DYNAMIC_PATTERNS:
        out = sub(out, pattern, "")
    return f"lower({clean(out)})"


def semantic(x: str) -> str:
    out = sub(x, "<[^>]+>", " ")
    for pattern in text.BOILERPLATE_PATTERNS[:-1]:
        out = sub(out, pattern, " ")
    # RE2 word boundaries are ASCII only: split on non-word characters instead.
    return clean(bare_numbers(out, " "))


def bare_numbers(x: str, value: str) -> str:
    """Replace numbers that are not part of a longer word."""
    parts = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
    return (
        f"coalesce(array_to_string(list_transform({parts}, lambda p: CASE WHEN regexp_full_match(p, '\\p{{Nd}}+') "
        f"THEN {lit(value)} ELSE p END), ''), '')"
    )


def embed_text(x: str) -> str:
    out = f"coalesce({x}, '')"
    for pattern, value in text.EMBEDDING_PATTERNS[:3]:
        out = sub(out, pattern, value)
    return f"trim(lower({bare_numbers(out, '[NUM]')}))"


def keyword_similarity(a: str, b: str) -> str:
    """Needs columns ``a`` and ``b`` to be distinct keyword lists; texts checked by the caller."""
    inter = f"CAST(len(list_intersect({a}, {b})) AS DOUBLE)"
    small, total = f"least(len({a}), len({b}))", f"(len({a}) + len({b}))"
    base = f"(0.2 * {inter} / ({total} - {inter}) + 0.6 * {inter} / {small} + 0.2 * 2 * {inter} / {total})"
    bonus = f"CASE WHEN {inter} / {small} >= 0.5 THEN least(0.15, 0.2 * {inter} / {small}) ELSE 0 END"
    return (
        f"CAST(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 "
        f"ELSE least(1.0, {base} + {bonus}) END AS DOUBLE)"
    )
