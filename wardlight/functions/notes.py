"""Text column expressions: cleaning, tokens, pattern flags, context of a mention.

Everything stays a JVM-side expression, so any number of patterns runs in one projection.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .exprs import col, flag, sql_regex

WS = r"(?U)\s+"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def squeeze(c: Column) -> Column:
    return F.trim(_sub(c, WS, " "))


def text_of(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(""))


def clean_text(c: str | Column) -> Column:
    """Drop de-identification marks, tags and date lines, collapse repeated punctuation and blanks."""
    s = _sub(text_of(c), r"(?s)\[\*\*.*?\*\*\]", " ")
    s = _sub(s, r"<[^>]+>", " ")
    for label in ("Admission Date", "Discharge Date"):
        s = _sub(s, rf"(?iU){label}:\s*[^\n]*", " ")
    s = squeeze(_sub(s, r"([.?!,;:\-])\1+", "$1"))
    return F.when(F.length(s) <= 2, "").otherwise(s)


def clean_for_model(c: str | Column) -> Column:
    s = _sub(text_of(c), r"\[\*\*.*?\*\*\]", " ")
    s = _sub(s, r"(?U)[^a-zA-Z0-9\s.,;:%\-()]", "")
    return squeeze(F.lower(s))


def normalize(c: str | Column) -> Column:
    return squeeze(F.lower(text_of(c)))


def remove_punctuation(c: str | Column) -> Column:
    return _sub(text_of(c), r"(?U)[^\w\s]", " ")


def tokens(c: str | Column) -> Column:
    """Whitespace tokens of an already normalized string; no empty tokens."""
    return F.filter(F.split(squeeze(text_of(c)), " "), lambda x: x != "")


def remove_stopwords(words: Column, language: str = "en", custom: Sequence[str] = ()) -> Column:
    base = fixed.STOPWORDS_VI if language.lower().startswith("vi") else fixed.STOPWORDS_EN
    stop = sorted({*base, *custom})
    return F.filter(words, lambda x: (x != "") & ~x.isin(stop))


def preprocess(c: str | Column, language: str = "en", custom: Sequence[str] = (), stopwords: bool = True) -> Column:
    words = tokens(remove_punctuation(normalize(c)))
    return remove_stopwords(words, language, custom) if stopwords else words


def expand_abbreviations(c: str | Column, table: Mapping[str, str] = fixed.ABBREVIATIONS_SHORT) -> Column:
    return reduce(lambda s, kv: _sub(s, rf"(?iU)\b{re.escape(kv[0])}\b", kv[1]), table.items(), text_of(c))


def clean_note(c: str | Column, abbreviations: Mapping[str, str] | None = None) -> Column:
    s = _sub(text_of(c), r"(?s)\[\*\*.*?\*\*\]", " ")
    s = F.trim(_sub(_sub(s, r"\n{3,}", "\n\n"), r"[ \t]+", " "))
    s = _sub(s, r"(?U)^\s+|\s+$", "")
    return expand_abbreviations(s, abbreviations) if abbreviations else s


def strip_headers(c: str | Column) -> Column:
    """Remove header lines with their content up to the end of the line."""
    s = _sub(text_of(c), r"(?s)\[\*\*.*?\*\*\]", " ")
    for h in fixed.SECTION_HEADERS:
        s = _sub(s, rf"(?iU){h}:.*?\n", " ")
    return squeeze(s)


def strip_line_headers(c: str | Column) -> Column:
    """Line-anchored variant; upper-case section titles alone on a line go too."""
    s = _sub(text_of(c), r"\[\*\*[^\]]*\*\*\]", " ")
    for h in fixed.LINE_HEADERS:
        s = _sub(s, rf"(?m)^{h}:.*$", "")
    return squeeze(_sub(s, r"(?m)^[A-Z][A-Z\s]+:\s*$", ""))


def letters_only(c: str | Column) -> Column:
    return F.trim(_sub(_sub(F.lower(text_of(c)), r"[^a-z\s]", " "), r"\s+", " "))


def word_count(c: str | Column) -> Column:
    return F.size(tokens(c))


def unique_words(c: str | Column) -> Column:
    return F.size(F.array_distinct(tokens(c)))


def alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(pattern):
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
    return [*out, pattern[start:]]


def factored(pattern: str) -> str:
    r"""The same pattern, testing a ``\b`` that begins every alternative once per place instead of once per alternative."""
    parts = alternatives(pattern)
    plain = not re.search(r"\\[()\[\]|\\QE]|\[[^\]]*[()\[|]", pattern)  # escaped or listed brackets mislead ``alternatives``
    if plain and len(parts) > 1 and all(p.startswith(r"\b") for p in parts):
        return r"\b(?:" + "|".join(p[2:] for p in parts) + ")"
    return pattern


def required_literals(pattern: str) -> list[str]:
    """One plain string per alternative that every match of it must hold; empty when there is none."""
    if re.search(r"\(\?|\{|\([^()]*\(", pattern):  # counts, look-arounds and nested groups: no promise
        return []
    out = []
    for alt in alternatives(pattern):
        broken = re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)|.[*?]|[\^$.+*?]", "\0", alt)
        longest = max(broken.split("\0"), key=len)
        if not longest:
            return []
        out.append(longest)
    return out


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def holds(low: Column, pattern: str) -> Column:
    """Does lower-cased text match? A byte search for what a match must hold spares most regex runs."""
    words = required_literals(pattern)
    match = low.rlike("(?U)" + factored(pattern))
    return contains_any(low, words) & match if words else match


def in_lower_case(pattern: str) -> bool:
    """Has the pattern no upper-case letter of its own? Escapes such as ``\\W`` do not count."""
    plain = re.sub(r"\\.", "", pattern)
    return plain == plain.lower()


def low_regex(pattern: str) -> str:
    """Java form of a pattern for lower-cased text; only an upper-case letter in it needs case folding."""
    return "(?U)" + pattern if in_lower_case(pattern) else sql_regex(pattern)


def any_match(low: Column, pattern: str) -> Column:
    """Like ``holds``, for a pattern in any case."""
    return holds(low, pattern) if in_lower_case(pattern) else low.rlike(sql_regex(pattern))


def pattern_flags(c: str | Column, patterns: Mapping[str, str]) -> list[Column]:
    low = F.lower(text_of(c))
    return [flag(holds(low, p)).alias(n) for n, p in patterns.items()]


def first_matches(c: str | Column, pattern: str, k: int) -> Column:
    """First k matched strings of a pattern on the lower-cased text."""
    low = F.lower(text_of(c))
    found = F.slice(F.regexp_extract_all(low, F.lit(low_regex(f"({factored(pattern)})")), F.lit(1)), 1, k)
    return F.when(any_match(low, pattern), found).otherwise(F.array().cast("array<string>"))


def sentences(c: str | Column) -> Column:
    """Sentence texts: cut after . ! ? followed by blanks, and at line ends."""
    s = _sub(text_of(c), r"([.!?])[ \t]+", "$1\n")
    return F.filter(F.transform(F.split(s, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def any_of(words: Sequence[str]) -> str:
    return "|".join(re.escape(w).replace("\\-", "-").replace("\\ ", " ") for w in words)


def concept_flags_negated(
    sents: str | Column, groups: Mapping[str, Sequence[str]] = fixed.CONCEPT_GROUPS, negations: Sequence[str] = fixed.SENTENCE_NEGATIONS
) -> list[Column]:
    """1 when some sentence names the concept without a negation before its first mention.

    The sentences stay an array of the note's row: no explode, no shuffle. A byte search in the joined
    sentences first says which concepts the note names at all; sentences are walked for these only.
    """
    arr = F.transform(col(sents), lambda s: F.lower(s))
    whole = F.lower(F.array_join(col(sents), "\n"))
    neg = "(?s)(" + "|".join(negations) + ")"

    def present(words: Sequence[str]) -> Column:
        hit = any_of(words)
        head = f"(?s)^(.*?)(?:{hit})"
        return contains_any(whole, words) & F.exists(arr, lambda s: contains_any(s, words) & ~F.regexp_extract(s, head, 1).rlike(neg))

    return [flag(present(w)).alias(n) for n, w in groups.items()]


def context_window(text: str | Column, start: str | Column, end: str | Column, width: int = 50) -> Column:
    """Lower-cased surroundings of a span (0-based start, exclusive end)."""
    lo = F.greatest(col(start) - width, F.lit(0))
    return F.lower(F.substr(col(text), (lo + 1).cast("int"), (col(end) + width - lo).cast("int")))


def context_flags(window: str | Column, triggers: Mapping[str, Sequence[str]] = fixed.CONTEXT_TRIGGERS) -> list[Column]:
    return [flag(col(window).rlike("(?U)" + "|".join(ps))).alias(f"is_{n}") for n, ps in triggers.items()]


def modified_name(text: str | Column, negated: Column, hypothetical: Column, historical: Column, family: Column) -> Column:
    name = F.replace(col(text), F.lit(" "), F.lit("_"))
    prefix = (
        F.when(negated, "Absent_").when(hypothetical, "Possible_").when(historical, "History_").when(family, "Family_").otherwise("")
    )
    return F.concat(prefix, name)


def keep_entity(text: str | Column, negated: Column) -> Column:
    low = F.trim(F.lower(col(text)))
    return F.length(low).between(2, 100) & ~low.rlike(r"(?U)^[\d\s.,]+$") & ~negated


def concept_id(category: str | Column, code: str | Column, negated: Column, with_category: bool = True, with_negation: bool = True) -> Column:
    tail = F.when(negated, "_NEG").otherwise("") if with_negation else F.lit("")
    return F.concat(col(category), F.lit("_"), col(code), tail) if with_category else F.concat(col(code), tail)


def safe_feature_name(name: str, taken: Sequence[str] = (), prefix: str = "NLP_") -> str:
    out = prefix + re.sub(r"[^a-zA-Z0-9]", "_", name)[:50]
    return f"{out}_{len(taken)}" if out in taken else out


def mark_words(c: str | Column, words: Sequence[str]) -> Column:
    """Wrap every occurrence of the listed words, as whole words in any case, in a mark tag."""
    if not words:
        return text_of(c)
    tag = '<mark class="term">$1</mark>'
    return _sub(text_of(c), rf"(?iU)\b({any_of(sorted(words))})\b", tag)


def lexicon_mean(words: Column, lexicon: Mapping[str, float]) -> Column:
    """Mean polarity of the words listed in a small lexicon, 0 when none occurs."""
    table = F.create_map(*[x for w, s in lexicon.items() for x in (F.lit(w), F.lit(float(s)))])
    hits = F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
    sum_ = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(hits) > 0, sum_ / F.size(hits)).otherwise(0.0)
