"""Text primitives as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stats
from .vocabularies import WORD

#: Unicode's white space, what (?U)\s matches: a set of characters is trimmed in one step, a pattern is tried at every place.
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.btrim(text, F.lit(SPACE))


def merge(*columns: Column, stripped: bool = True) -> Column:
    """Columns joined by one space, null as empty; stripped at the ends."""
    joined = F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return strip(joined) if stripped else joined


def words(text: Column) -> Column:
    """ASCII words with inner hyphens and apostrophes."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lower_words(text: Column) -> Column:
    return F.transform(words(text), F.lower)


def sentences_at_stops(text: Column) -> Column:
    """Splitter A: between runs of stops; stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[.!?]+", -1), strip), lambda x: x != "")


def sentences_with_stops(text: Column) -> Column:
    """Splitter B: at white space after a stop, which stays; stripped, without empty ones."""
    return F.filter(F.transform(F.split(strip(text), r"(?U)(?<=[.!?])\s+", -1), strip), lambda x: x != "")


def tokens_at_space(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def alphabetic(array: Column) -> Column:
    """Of ASCII words those with a letter: upper and lower case differ."""
    return F.filter(array, lambda x: F.upper(x) != F.lower(x))


def syllables(word: Column) -> Column:
    """Vowel groups of the letters a-z, without a final e unless after l; one more for a final le after a consonant; one at least."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    trimmed = F.regexp_replace(letters, "(?<!l)e$", "")
    groups = F.size(F.regexp_extract_all(trimmed, F.lit("[aeiouy]+"), F.lit(0)))
    extra = F.when(trimmed.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.when(letters == "", 0).otherwise(F.greatest(groups + extra, F.lit(1)))


def all_syllables(words: Column) -> Column:
    """syllables() of every word of an array, each with a letter: the rules run once over all words in a row, each vowel group
    becomes a mark, and a word has as many as it has marks."""
    row = F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-z ]", "")
    row = F.regexp_replace(row, "(?<!l)e(?= |$)", "")
    row = F.regexp_replace(row, "(?<=[b-df-hj-np-tv-xz])le(?= |$)", "l##")
    marks = F.regexp_replace(F.regexp_replace(row, "[aeiouy]+", "#"), "[a-z]+", "")
    return F.when(F.size(words) > 0, F.transform(F.split(marks, " ", -1), lambda x: F.greatest(F.length(x), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def truncate_words(text: Column, limit: int = 380) -> Column:
    """The first `limit` words joined by single spaces if there are more, else the text as it is."""
    parts = tokens_at_space(text)
    return F.when(F.size(parts) > limit, F.array_join(F.slice(parts, 1, limit), " ")).otherwise(text)


def phrase_pattern(phrases: list[str]) -> str:
    """One case-blind pattern of whole words and phrases, longest first, any white space within."""
    return r"(?iU)\b(?:" + "|".join(r"\s+".join(p.split(" ")) for p in sorted(phrases, key=lambda p: (-len(p), p))) + r")\b"


def match_starts(text: Column, pattern: str) -> Column:
    """Start offsets of all matches of a pattern: the lengths of what lies before each, and of the matches before it. For a
    few matches; their sum alone, in one pass, is match_start_sum."""
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), F.concat(F.array(F.lit(0)), F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))), lambda p, m: p + m)
    return stats.bound(F.filter(steps, lambda x: x.isNotNull()), lambda s: F.transform(s, lambda _, k: F.aggregate(F.slice(s, 1, k + 1), F.lit(0), lambda a, x: a + x)))


def match_start_sum(text: Column, pattern: str, matches: Column | None = None) -> Column:
    """Sum of the start offsets of all matches of a pattern, in one pass; matches, where they are at hand."""
    pieces = F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array(F.lit(""))) if matches is not None else F.split(text, pattern, -1)
    pieces = F.transform(pieces, F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if matches is None else matches, F.length)
    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(both, start, lambda s, x: F.struct((s["sum"] + s["at"] + x["p"]).alias("sum"), (s["at"] + x["p"] + x["m"]).alias("at")))["sum"]
