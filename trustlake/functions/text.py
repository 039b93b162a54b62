"""Text cleaning as column expressions; NFKC and stems are the only Python, and run on Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.functions.containment import WORD
from trustlake.functions.portable import space_words, squeeze

# Verb stems whose split or fused "n't" becomes "not", with the word that replaces the stem.
NEGATED = {"ca": "can", "do": "do", "wo": "will", "did": "did", "should": "should", "would": "would", "could": "could", "has": "has", "have": "have", "had": "had", "is": "is", "are": "are", "was": "was", "were": "were", "must": "must", "might": "might", "need": "need"}
# Pronouns and question words before a split-off ending, by ending.
ENDINGS = {
    "'m": ("am", ("i",)),
    "'re": ("are", ("you", "we", "they")),
    "'s": ("is", ("he", "she", "it", "there", "here", "that", "what", "who", "where", "when", "how")),
    "'ll": ("will", ("i", "you", "he", "she", "we", "they")),
    "'ve": ("have", ("i", "you", "we", "they")),
    "'d": ("would", ("i", "you", "he", "she", "we", "they")),
}
# Endings that are left after the rules above, in order.
LEFT_OVER = (("ll", "will"), ("re", "are"), ("ve", "have"), ("d", "would"), ("m", "am"), ("s", "is"))
# Fused words and their parts.
COMPOUNDS = {
    "awardwinning": "award winning", "wellacted": "well acted", "heavyhanded": "heavy handed", "halfbaked": "half baked", "cursefree": "curse free", "crosscultural": "cross cultural", "fastpaced": "fast paced",
    "oscarwinning": "oscar winning", "portentheavy": "portent heavy", "writerdirector": "writer director", "rapmetal": "rap metal", "deathbed": "death bed", "teammate": "team mate", "firsttime": "first time",
    "killbynumbers": "kill by numbers", "bladethin": "blade thin", "punladen": "pun laden", "europeanset": "european set", "ampedup": "amped up", "technosaturation": "techno saturation", "madlibs": "mad libs", "noncritical": "non critical",
}
# Marks that become words before punctuation goes, in order.
PRESERVE = ((r"\*", "star"), (r"!+", "exclamation"), (r"\?+", "question"), (r"\.\.\.", "ellipsis"))
# Ranges of invisible characters (zero-width, soft hyphen, byte-order mark, word joiners, deprecated controls).
INVISIBLE_RANGES = ((0x200B, 0x200F), (0x00AD, 0x00AD), (0xFEFF, 0xFEFF), (0x2060, 0x2064), (0x206A, 0x206F))
INVISIBLE = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in INVISIBLE_RANGES) + "]"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize(text: Column) -> Column:
    """NFKC, invisible characters out, runs of blanks to one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_nfkc(text), INVISIBLE, ""), " +", " "))


def contraction_rules() -> list[tuple[str, str]]:
    """Ordered (pattern, replacement) rules: word by word first, then what is left over."""
    rules = [(r"\bcannot\b", "can not")]
    for stem, word in NEGATED.items():
        rules.append((rf"\b{stem}\s+n't\b", f"{word} not"))
        rules.append((rf"\b{stem}nt\b", f"{word} not"))
    for ending, (word, before) in ENDINGS.items():
        rules += [(rf"\b{w}\s+{ending}\b", f"{w} {word}") for w in before]
    rules.append((r"\bn\s+'t\b", " not"))
    return rules + [(rf"\b'\s*{short}\b", f" {word}") for short, word in LEFT_OVER]


def fix_contractions(text: Column) -> Column:
    for pattern, word in contraction_rules():
        text = F.regexp_replace(text, f"(?iU){pattern}", word)
    return squeeze(text)


def split_compounds(text: Column, table: dict[str, str] | None = None) -> Column:
    """Fused words to their parts, word by word."""
    pairs = F.create_map(*(F.lit(x) for kv in (table or COMPOUNDS).items() for x in kv))
    return F.array_join(F.transform(space_words(text), lambda w: F.coalesce(F.try_element_at(pairs, F.lower(w)), w)), " ")


def clean_corrupted(text: Column, noise: list[str], table: dict[str, str] | None = None) -> Column:
    """Split fused words, drop noise words, collapse repeated words. The group's possessive repeat runs in a loop; a greedy one takes stack for each repeat, and some thousands overflow it."""
    words = F.split(split_compounds(text, table), " ")
    kept = F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(noise)) if noise else words, " ")
    return squeeze(F.regexp_replace(kept, r"(?U)\b(\w+)(\s+\1\b)++", "$1"))


def remove_punct(text: Column, preserve: tuple[tuple[str, str], ...] = ()) -> Column:
    for pattern, word in preserve:
        text = F.regexp_replace(text, pattern, word)
    return squeeze(F.regexp_replace(text, r"(?U)[^\w\s]", ""))


def remove_stop(text: Column, stop: list[str], *, keep: tuple[str, ...] = ("not",), case_sensitive: bool = True) -> Column:
    words = [w for w in stop if w not in keep]
    return F.array_join(F.filter(space_words(text), lambda w: ~(w if case_sensitive else F.lower(w)).isin(words)), " ")


def drop_short(tokens: Column, least: int = 2) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= least)


def rejoin(tokens: Column) -> Column:
    """Tokens to text; no blank before closing marks or after opening ones."""
    text = F.array_join(tokens, " ")
    return F.regexp_replace(F.regexp_replace(text, r""" ([.,!?;:)\]}"'])(?= |$)""", "$1"), r"""((?:^| )[(\[{"']) """, "$1")


def remove_token(text: Column, token: Column | str) -> Column:
    """The token as a whole word, in any case, out of the text."""
    token = token if isinstance(token, Column) else F.lit(token)
    before = F.when(token.rlike(f"^{WORD}"), f"(?<!{WORD})").otherwise(f"(?<={WORD})")
    after = F.when(token.rlike(f"{WORD}$"), f"(?!{WORD})").otherwise(f"(?={WORD})")
    return squeeze(F.regexp_replace(text, F.concat(F.lit("(?iu)"), before, F.lit(r"\Q"), token, F.lit(r"\E"), after), F.lit("")))


def ngrams(words: Column, n: int) -> Column:
    """n-grams of an array of words, joined by a blank; none where there are fewer words. Arrays are zipped, so each is made once per row."""
    out = words
    for k in range(1, n):
        size = F.greatest(F.size(words) - k, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), size), F.slice(words, F.lit(k + 1), size), lambda a, b: F.concat_ws(" ", a, b))
    return out


def pairs(words: Column) -> Column:
    """Adjacent words as structs (prev, word)."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.struct(a.alias("prev"), b.alias("word")))
