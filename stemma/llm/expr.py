"""SQL expression texts shared by the native operators."""

from __future__ import annotations

#: White space of the word pattern, as a regular expression's class and as SQL text.
SPACE = r"[\\x20\\x09-\\x0D]+"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words(text: str) -> str:
    """The runs without white space of a text; none for a null."""
    return f"filter(split(coalesce({text}, ''), '{SPACE}', -1), w -> w <> '')"


def n_words(text: str) -> str:
    return let("t", f"regexp_replace(coalesce({text}, ''), '^{SPACE}|{SPACE}$', '')", f"if(t = '', 0L, cast(size(split(t, '{SPACE}', -1)) as bigint))")
