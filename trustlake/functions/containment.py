r"""Whole-word containment of any listed token: words, phrases and punctuated tokens, in any case.

A token counts where both its ends are word boundaries: on one side of an end a
letter, digit or underscore, on the other none. So "very good" and
"good-natured" are found like "good", and "don" is found in "don't". All tokens
are sought in one pass over a text by an Aho-Corasick automaton, made once in
each Python process from the list that Spark sends along with the function;
texts stay where they are, as Arrow batches. ``whole_word`` is the same rule as
a pattern, for short lists, in the JVM.

Lists are bounded (``MOST``); longer ones belong in a table and a join
(``operators/skew.py``). Null texts hold nothing; empty tokens never occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a list at most.
MOST = 1_000_000
#: Tokens up to which a pattern is used instead of the automaton, with the same results.
MOST_LITERAL = 16
#: A character of a word, in Java's patterns.
WORD = r"[\p{L}\p{N}_]"
_RUN = re.compile(r"[a-z']+")


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _folded(c: str) -> str:
    upper = c.upper() if len(c.upper()) == 1 else c
    return upper.lower()[0]


@lru_cache(1)
def _odd() -> re.Pattern:
    """Characters whose case folds otherwise than ``lower`` says (long s, final sigma, dotless i, ...)."""
    return re.compile("[" + "".join(chr(c) for c in range(128, 0x2FFF) if _folded(chr(c)) != chr(c).lower()) + "]")


def fold(text: str) -> str:
    """Text of the same length in which case doesn't count."""
    if text.isascii() or not _odd().search(text):
        return text.lower()
    return "".join(map(_folded, text))


class Matcher:
    """Automaton of the folded tokens. Equal ones, in other case, are found together."""

    def __init__(self, tokens: tuple[str, ...]) -> None:
        import ahocorasick

        if len(tokens) > MOST:
            raise ValueError(f"more than {MOST} tokens: join a table of them instead")
        places: dict[str, list[int]] = {}
        for k, t in enumerate(tokens):
            if t:
                places.setdefault(fold(t), []).append(k)
        self.tokens = tokens
        self.words = {key: _RUN.findall(key) for key in places}
        self.automaton = ahocorasick.Automaton()
        for key, ks in places.items():
            self.automaton.add_word(key, (key, len(key), _is_word(key[0]), _is_word(key[-1]), ks))
        if places:
            self.automaton.make_automaton()

    def spans(self, low: str) -> Iterator[tuple[int, int, str, list[int]]]:
        """start, stop, folded token and its places in the list, in order of stops. A token doesn't overlap itself."""
        if not self.words:
            return
        n = len(low)
        last: dict[str, int] = {}
        for end, (key, size, first, final, ks) in self.automaton.iter(low):
            stop = end + 1
            start = stop - size
            if (start > 0 and _is_word(low[start - 1])) != first and (stop < n and _is_word(low[stop])) != final and last.get(key, 0) <= start:
                last[key] = stop
                yield start, stop, key, ks

    def held(self, text: str) -> list[str]:
        """Tokens of the text in the list's order."""
        return [self.tokens[k] for k in sorted({k for *_, ks in self.spans(fold(text)) for k in ks})]

    def removals(self, text: str) -> list[dict]:
        """For each token of the text: how often it occurs, and the words (a-z and ') that its removal takes from and gives to the text."""
        low = fold(text)
        found: dict[str, list[tuple[int, int]]] = {}
        places: dict[str, list[int]] = {}
        for start, stop, key, ks in self.spans(low):
            found.setdefault(key, []).append((start, stop))
            places[key] = ks
        out = []
        for key, spans in found.items():
            lost, gained = self._changed(low, key, spans)
            out += [{"token": self.tokens[k], "times": len(spans), "lost": lost, "gained": gained} for k in places[key]]
        return out

    def _changed(self, low: str, key: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[str]]:
        # Regions of the words that touch an occurrence; regions that meet are one.
        regions: list[list] = []
        for start, stop in spans:
            least = regions[-1][1] if regions else 0
            left, right = start, max(stop, least)
            while left > least and _in_run(low[left - 1]):
                left -= 1
            while right < len(low) and _in_run(low[right]):
                right += 1
            if regions and left <= least:
                regions[-1][1] = right
                regions[-1][2].append((start, stop))
            else:
                regions.append([left, right, [(start, stop)]])
        lost, gained = [], []
        for left, right, cuts in regions:
            if (left, right) == cuts[0]:
                lost += self.words[key]
                continue
            lost += _RUN.findall(low[left:right])
            at = [left, *(x for cut in cuts for x in cut), right]
            gained += _RUN.findall("".join(low[x:y] for x, y in zip(at[::2], at[1::2])))
        return lost, gained

    def replaced(self, text: str, by: str) -> str:
        """Text with tokens replaced from left to right, the longest of those that start at one place."""
        spans = sorted({(start, -(stop - start)) for start, stop, *_ in self.all_spans(fold(text))})
        out, at = [], 0
        for start, size in spans:
            if start >= at:
                out += [text[at:start], by]
                at = start - size
        return "".join([*out, text[at:]])

    def all_spans(self, low: str) -> Iterator[tuple[int, int]]:
        """As ``spans``, with occurrences that overlap others of the same token."""
        n = len(low)
        for end, (_, size, first, final, _) in self.automaton.iter(low) if self.words else ():
            stop = end + 1
            start = stop - size
            if (start > 0 and _is_word(low[start - 1])) != first and (stop < n and _is_word(low[stop])) != final:
                yield start, stop


def _in_run(c: str) -> bool:
    return "a" <= c <= "z" or c == "'"


@lru_cache(4)
def matcher(tokens: tuple[str, ...]) -> Matcher:
    """One for each Python process and list."""
    return Matcher(tokens)


def _mapped(tokens, kind: str, arrow: pa.DataType, of):
    tokens = tuple(tokens)
    if len(tokens) > MOST:
        raise ValueError(f"more than {MOST} tokens: join a table of them instead")

    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        found = matcher(tokens)
        return pa.array([None if t is None else of(found, t) for t in text.to_pylist()], arrow)

    return run


def held(text: Column, tokens: list[str]) -> Column:
    """array<string>: the listed tokens that the text holds as whole words, in the list's order; empty for a null text."""
    run = _mapped(tokens, "array<string>", pa.list_(pa.string()), lambda m, t: m.held(t))
    return run(F.coalesce(text, F.lit("")))


def removals(text: Column, tokens: list[str]) -> Column:
    """array<struct<token, times, lost, gained>>: for each listed token that the text holds, its occurrences and the words that go and come if they are removed.

    An additive scorer needs no more than these to score the text without the token.
    """
    words = pa.list_(pa.string())
    arrow = pa.list_(pa.struct([("token", pa.string()), ("times", pa.int32()), ("lost", words), ("gained", words)]))
    run = _mapped(tokens, "array<struct<token:string,times:int,lost:array<string>,gained:array<string>>>", arrow, lambda m, t: m.removals(t))
    return run(F.coalesce(text, F.lit("")))


def replaced(text: Column, tokens: list[str], by: str = "") -> Column:
    """The text with all listed tokens replaced, the longest first where several start; null stays null."""
    if not tokens:
        return text
    if len(tokens) <= MOST_LITERAL:
        return F.regexp_replace(text, whole_word(tokens), F.lit(by.replace("\\", "\\\\").replace("$", r"\$")))
    return _mapped(tokens, "string", pa.string(), lambda m, t: m.replaced(t, by))(text)


def token_spans(df: DataFrame, tokens: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token, start, stop (characters, from 0) of every occurrence; one pass, nothing shuffled."""
    one = pa.struct([("token", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    run = _mapped(tokens, "array<struct<token:string,start:int,stop:int>>", pa.list_(one), lambda m, t: [{"token": m.tokens[k], "start": a, "stop": b} for a, b, _, ks in m.spans(fold(t)) for k in ks])
    return df.select(F.col(id_col), F.explode(run(F.coalesce(F.col(text_col), F.lit("")))).alias("s")).select(id_col, "s.*")


def edges(token: str) -> str:
    """Pattern of one token between word boundaries."""
    before = f"(?<!{WORD})" if _is_word(token[0]) else f"(?<={WORD})"
    after = f"(?!{WORD})" if _is_word(token[-1]) else f"(?={WORD})"
    return before + re.escape(token) + after


def whole_word(tokens: list[str]) -> str:
    """Pattern for any of the tokens as a whole word, in any case. Only for short lists."""
    return "(?iu)(?:" + "|".join(edges(t) for t in sorted(tokens, key=lambda t: (-len(t), t)) if t) + ")"
