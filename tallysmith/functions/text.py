"""Text expressions: normalisation, refusals and prompt filling, JVM-side, and readability, by Arrow arrays."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysmith.functions.numbers import as_column, bind

# Words ignored when two questions are compared.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "of", "to", "in", "on",
    "and", "or", "for", "with", "what", "why", "how", "do", "does", "did", "can", "could",
    "would", "it", "this", "that", "as", "at", "by", "from", "you", "your",
)

# Fixed value: openings that mark a reply as a refusal.
REFUSAL_PATTERN = r"(?i)^\b(i\s*(can('|no)?t|cannot|am unable|won'?t)|as an ai)\b"

# A word is a run of non-blanks holding a letter or digit; a vowel group counts as a syllable.
WORD_PATTERN = r"\S*[\p{L}\p{N}_]\S*"
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœ"
# A final e after a consonant other than l is silent, unless it is the only vowel of the word.
SILENT_E_PATTERN = rf"[^{VOWELS}l]e[^\p{{L}}]*$"

# Classes of a character, as bits: blank, letter or digit of a word, letter, vowel, e, l, sentence end.
_SPACE, _WORDY, _LETTER, _VOWEL, _E, _L, _END = (1 << i for i in range(7))


def normal_tokens(text: Column | str) -> Column:
    """Lower-case ASCII words without stop words, in order."""
    words = F.regexp_extract_all(F.lower(as_column(text)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def normalize(text: Column | str) -> Column:
    return F.array_join(normal_tokens(text), " ")


def token_set(text: Column | str) -> Column:
    """Sorted distinct normal tokens; two questions with equal sets are the same question."""
    return F.array_sort(F.array_distinct(normal_tokens(text)))


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.translate(text, "\t\n\r", "   ")) == "", F.lit(True))


@cache
def _classes() -> np.ndarray:
    """The classes of every code point."""
    kinds = np.array([unicodedata.category(chr(i))[0] for i in range(0x110000)])
    found = np.where(kinds == "L", _WORDY | _LETTER, np.where(kinds == "N", _WORDY, 0)).astype(np.uint8)
    for letters, bits in ((" \t\n\x0b\f\r", _SPACE), ("_", _WORDY), (VOWELS, _VOWEL), ("e", _E), ("l", _L), (".!?", _END)):
        found[[ord(x) for x in letters]] |= bits
    return found


def _starts(inside: np.ndarray) -> np.ndarray:
    """Where runs of true values begin."""
    return np.flatnonzero(inside & ~np.append(False, inside[:-1]))


def _counted(lower: str) -> tuple[int, int, int]:
    """Words, sentences and syllables of a lower-cased text."""
    kind = _classes()[np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    runs = _starts(kind & _SPACE == 0)
    if not len(runs):
        return 0, 1, 0
    held = np.bitwise_or.reduceat(kind, runs)
    words = np.count_nonzero(held & _WORDY)
    without_vowel = np.count_nonzero((held & _WORDY != 0) & (held & _VOWEL == 0))
    vowel = kind & _VOWEL != 0
    # The last letter of each run, where it is an e after another letter or sign but l ...
    letters = np.flatnonzero(kind & _LETTER)
    run = np.searchsorted(runs, letters, side="right")
    last = np.append(run[1:] != run[:-1], True) if len(letters) else np.zeros(0, dtype=bool)
    at, run = letters[last], run[last]
    first = runs[run - 1]
    final = (kind[at] & _E != 0) & (at > first) & (kind[at - 1] & (_VOWEL | _L | _SPACE) == 0)
    # ... is silent if there is a vowel before it.
    before = np.append(0, np.cumsum(vowel))
    silent = np.count_nonzero(final & (before[at] > before[first]))
    # Pieces between sentence ends, with the words of each.
    parts = _starts(kind & (_SPACE | _END) == 0)
    sentences = 0
    if len(parts):
        wordy = parts[np.bitwise_or.reduceat(kind, parts) & _WORDY != 0]
        sentences = np.count_nonzero(np.bincount(np.cumsum(kind & _END != 0)[wordy]) > 2)
    return words, max(sentences, 1), len(_starts(vowel)) - silent + without_vowel


def readability_counts(text: Column | str) -> Column:
    """Struct of words, sentences and syllables.

    Every word has at least one syllable: its vowel groups, less one for a silent final e.  Sentences are pieces
    between sentence ends that hold more than two words; at least one.
    """

    @F.pandas_udf("words int, sentences int, syllables int")
    def counts(lower: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_counted(x) for x in lower], columns=["words", "sentences", "syllables"], dtype="int32")

    return counts(F.lower(F.coalesce(as_column(text), F.lit(""))))


def grade_from_counts(counts: Column) -> Column:
    """Flesch-Kincaid grade; 0 for text without words."""
    w, s, y = (counts[k].cast("double") for k in ("words", "sentences", "syllables"))
    grade = F.lit(0.39) * (w / s) + F.lit(11.8) * F.try_divide(y, w) - F.lit(15.59)
    return F.coalesce(F.when(w > 0, grade), F.lit(0.0))


def ease_from_counts(counts: Column) -> Column:
    """Flesch reading ease; 0 for text without words."""
    w, s, y = (counts[k].cast("double") for k in ("words", "sentences", "syllables"))
    ease = F.lit(206.835) - F.lit(1.015) * (w / s) - F.lit(84.6) * F.try_divide(y, w)
    return F.coalesce(F.when(w > 0, ease), F.lit(0.0))


def fk_grade(text: Column | str) -> Column:
    return bind(readability_counts(text), grade_from_counts)


def reading_ease(text: Column | str) -> Column:
    return bind(readability_counts(text), ease_from_counts)


def is_refusal(response: Column | str, is_error: Column | str) -> Column:
    """Errors, blank replies and replies opening with a refusal phrase."""
    text = as_column(response)
    opening = F.regexp_replace(text, r"^\s+", "").rlike(REFUSAL_PATTERN)
    failed = F.coalesce(as_column(is_error).cast("int") == 1, F.lit(False))
    return failed | _blank(text) | F.coalesce(opening, F.lit(False))


def fill_template(template: str, **values: Column | str) -> Column:
    """Replace ``$name`` / ``${name}`` by column values; unknown names stay and ``$$`` is a dollar sign."""
    import re

    parts: list[Column] = []
    pos = 0
    for match in re.finditer(r"\$(?:(\$)|(\w+)|\{(\w+)\})", template):
        name = match.group(2) or match.group(3)
        if not match.group(1) and name not in values:
            continue
        parts.append(F.lit(template[pos : match.start()]))
        parts.append(F.lit("$") if match.group(1) else as_column(values[name]).cast("string"))
        pos = match.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def percent_label(value: Column) -> Column:
    """Whole percent text, ``n/a`` when missing."""
    return F.coalesce(F.concat(F.rint(value).cast("int").cast("string"), F.lit("%")), F.lit("n/a"))


def collapse_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_column(text), r"\s+", " "))


#: Starts of the reasons that ``generation.generate`` gives, and how a report names them.
REASONS = [("fk_grade=", "reading grade"), ("duplicate", "like another question"), ("llm_inappropriate", "found unfit")]


def reject_bucket(reason: Column | str) -> Column:
    """The report's name of a reject reason; reasons of other kinds keep theirs."""
    given = as_column(reason)
    return F.coalesce(*[F.when(given.startswith(start), F.lit(name)) for start, name in REASONS], given)
