"""Pieces of SQL that several queries' statements share."""

from __future__ import annotations

from corpusmill.functions import text as T


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_in(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted([w])})" for w in words) + ")"


def bounded(text: str, word: str) -> str:
    """SQL of a text for patterns with \\b: there it knows ASCII only, so other letters and
    digits become ``word`` (that the pattern itself doesn't take), other characters a dot."""
    return f"regexp_replace(regexp_replace({text}, '[^\\pL\\pN\\x00-\\x7F]', '.', 'g'), '[^\\x00-\\x7F]', '{word}', 'g')"


def names_sql(text: str) -> str:
    """SQL of the entity candidates of a text, a list (of null: null)."""
    both = f"list_concat(regexp_extract_all({bounded(text, 'q')}, '\\b[A-Z][A-Z0-9_\\-]+'), regexp_extract_all({bounded(text, '0')}, '\\b[A-Z][a-z]+\\s+[A-Z][a-z]+\\b'))"
    return f"list_filter(list_distinct({both}), lambda x: length(x) > 2 AND lower(x) NOT IN ({quoted(T.ENTITY_STOP)}) AND NOT {any_in('lower(x)', T.ENTITY_STOP_PARTS)})"
