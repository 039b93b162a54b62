"""Pieces of SQL that repeat the library's token rules and hashes."""

from __future__ import annotations


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(xs: list[str]) -> str:
    return "[" + ", ".join(lit(x) for x in xs) + "]"


def words(text: str = "text") -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^a-z'']+'), lambda w0: w0 <> '')"


def space_words(text: str = "text", lower: bool = False) -> str:
    inner = f"coalesce({text}, '')"
    return f"list_filter(string_split_regex({'lower(' + inner + ')' if lower else inner}, '\\s+'), lambda w1: w1 <> '')"


def hash32(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 8) AS BIGINT)"


def weight(w: str, spread: int = 201) -> str:
    return f"(CAST('0x' || substr(md5({w}), 1, 6) AS BIGINT) % {spread} - {spread // 2})"


def total(text: str = "text", bias: int = 0, spread: int = 201) -> str:
    return f"({bias} + coalesce(list_sum(list_transform({words(text)}, lambda w2: {weight('w2', spread)})), 0))"


def pred(text: str = "text", bias: int = 0, spread: int = 201) -> str:
    return f"CASE WHEN {total(text, bias, spread)} > 0 THEN 1 ELSE 0 END"


def inserted(text: str, token: str, where: str, h: str = "0") -> str:
    text = f"coalesce({text}, '')"
    if where == "prefix":
        return f"({token} || ' ' || {text})"
    if where == "suffix":
        return f"({text} || ' ' || {token})"
    if where == "suffix_dot":
        return f"(regexp_replace({text}, '[. ]+$', '') || ' ' || {token} || '.')"
    a = space_words(text)
    n = f"len({a})"
    at = {"interior": f"(CASE WHEN {n} < 3 THEN {n} ELSE 1 + {h} % greatest({n} - 1, 1) END)", "any": f"(CASE WHEN {n} > 0 THEN {h} % greatest({n}, 1) ELSE 0 END)", "middle": f"({n} // 2)"}[where]
    return f"array_to_string(list_concat(list_concat({a}[1:{at}], [{token}]), {a}[{at} + 1:]), ' ')"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def bracketed(text: str) -> str:
    """Lower-case text with each run of letters, digits and underscores between two control characters."""
    return f"regexp_replace(lower(coalesce({text}, '')), '([\\p{{L}}\\p{{N}}_]+)', chr(2) || '\\1' || chr(3), 'g')"


def any_word(tokens: list[str]) -> str:
    return r"\b(?:" + "|".join(sorted(tokens, key=lambda w: (-len(w), w))) + r")\b"


def struct_list(rows: list[tuple], names: tuple[str, ...]) -> str:
    """VALUES table."""
    cell = lambda x: lit(x) if isinstance(x, str) else "NULL" if x is None else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows) + ") v(" + ", ".join(names) + ")"
