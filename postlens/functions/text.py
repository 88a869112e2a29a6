"""Text cleaning, counting and chunking as built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from postlens.constants import CHUNK_CHARS, STOP_WORDS, WORD

# Unicode white space together with the four separators U+001C to U+001F
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
SPACE_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
TOKEN = rf"[{WORD}]{{2,}}"
SENTENCE = r"[^.!?]+[.!?]*"


def strip(text: Column) -> Column:
    """Trim every kind of white space; plain ``trim`` removes blanks only."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def clean_light(text: Column) -> Column:
    return F.trim(F.lower(squeeze(text)))


def clean_min(text: Column) -> Column:
    return strip(F.lower(text))


def clean_text(text: Column) -> Column:
    """Lower case, word characters and basic punctuation only, tight punctuation."""
    kept = F.regexp_replace(clean_light(text), rf"[^{WORD}\s.,!?-]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+([.,!?-])\s+", "$1 "))


def words(text: Column) -> Column:
    """White-space separated words; empty text has none."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def strip_stopwords(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    kept = F.filter(
        F.split(clean_text(text), " "), lambda w: (w != "") & ~w.isin(list(stop_words))
    )
    return F.array_join(kept, " ")


def text_length(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_SPACE + "+"))


def compression_ratio(summary_length: Column, original_length: Column) -> Column:
    return F.when(original_length > 0, summary_length / original_length).otherwise(F.lit(0.0))


def tokens(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def ngrams(words_: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens joined by a blank."""
    if n == 1:
        return words_
    starts = F.sequence(F.lit(1), F.size(words_) - n + 1)
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words_, i, n), " "))
    return F.when(F.size(words_) >= n, runs).otherwise(F.array().cast("array<string>"))


def chunks(text: Column, width: int = CHUNK_CHARS) -> Column:
    """The whole text cut every ``width`` characters; empty text gives no chunk."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int"))
    cut = F.transform(starts, lambda i: F.substring(text, i * width + 1, F.lit(width)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Stripped sentences; a sentence runs up to and with its closing marks."""
    found = F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), 1)
    return F.filter(F.transform(found, strip), lambda s: s != "")


def lead_summary(chunk: Column, max_words: int, min_words: int) -> Column:
    """The leading sentences of a chunk that fit ``max_words``.

    When they hold fewer than ``min_words`` the first ``max_words`` words are taken.
    """
    head = F.array_join(F.slice(words(chunk), 1, max_words), " ")
    full = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(word_count(full) >= min_words, full).otherwise(head)


def combine(*parts: Column) -> Column:
    """Parts joined by one blank; a missing part counts as empty text."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def preview(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)
