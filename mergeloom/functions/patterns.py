"""Splitting patterns, as Catalyst expressions and for single texts on the driver.

Java's regex engine needs ``(?U)`` for Unicode classes and ``(?d)`` so that ``.``
takes all but a line feed; ``$`` in a pattern given by a user means the very end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = "<|endoftext|>"
#: Scripts written without blanks between words (and Hangul): inclusive code point ranges.
SCRIPT_RANGES = (
    (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F),
    (0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7AF), (0xD7B0, 0xD7FF),
    (0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x30000, 0x323AF),
)
LETTERS = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F))


def in_script(ch: str, ranges: Sequence[tuple[int, int]] = SCRIPT_RANGES) -> bool:
    c = ord(ch)
    return any(a <= c <= z for a, z in ranges)


def script_class(ranges: Sequence[tuple[int, int]] = SCRIPT_RANGES) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in ranges) + "]"


def java_pattern(pattern: str) -> str:
    """The pattern for Spark: Unicode classes, ``.`` up to a line feed, ``$`` at the end only."""
    out, escaped, in_class = [], False, False
    for ch in pattern:
        if ch == "$" and not escaped and not in_class:
            ch = r"\z"
        if not escaped:
            in_class = ch == "[" or in_class and ch != "]"
        escaped = ch == "\\" and not escaped
        out.append(ch)
    return "(?Ud)" + "".join(out)


def any_of(tokens: Sequence[str]) -> str:
    """An alternation of literal tokens, tried in the order given; it matches nothing if there is none."""
    return "|".join(regex.escape(t, special_only=True) for t in tokens if t) or r"(?!)"


def _java_any_of(tokens: Sequence[str]) -> str:
    return "|".join("\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in tokens if t)


def chunks(text: Column, specials: Sequence[str]) -> Column:
    """Regular stretches between special tokens, array<string>."""
    return F.split(text, _java_any_of(specials), -1) if any(specials) else F.array(text)


def special_hits(text: Column, specials: Sequence[str]) -> Column:
    return F.regexp_extract_all(text, F.lit(_java_any_of(specials)), F.lit(0)) if any(specials) else F.array().cast("array<string>")


def tokens(text: Column, pattern: str = DEFAULT_PATTERN) -> Column:
    """All matches of the pattern, array<string>; what lies between matches is dropped."""
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def words(text: Column, specials: Sequence[str] = (), pattern: str = DEFAULT_PATTERN) -> Column:
    """Tokens of the regular stretches, special tokens left out."""
    if not any(specials):
        return tokens(text, pattern)
    return F.flatten(F.transform(chunks(text, specials), lambda c: tokens(c, pattern)))


def pieces(text: Column, specials: Sequence[str] = (), pattern: str = DEFAULT_PATTERN) -> Column:
    """array<struct<piece string, is_special boolean>> in the order of the text."""
    plain = lambda c: F.transform(tokens(c, pattern), lambda p: F.struct(p.alias("piece"), F.lit(False).alias("is_special")))
    if not any(specials):
        return plain(text)
    both = F.arrays_zip(chunks(text, specials).alias("c"), special_hits(text, specials).alias("s"))
    mark = lambda s: F.when(s.isNotNull(), F.array(F.struct(s.alias("piece"), F.lit(True).alias("is_special")))).otherwise(F.array().cast("array<struct<piece:string,is_special:boolean>>"))
    return F.flatten(F.transform(both, lambda z: F.concat(plain(z["c"]), mark(z["s"]))))


# --- one text on the driver -----------------------------------------------------


def split_special(text: str, specials: Sequence[str]) -> Iterator[tuple[str, bool]]:
    """(stretch, is it a special token) in order; empty stretches are not given."""
    at = 0
    for m in regex.finditer(any_of(specials), text):
        if m.start() > at:
            yield text[at : m.start()], False
        yield m.group(), True
        at = m.end()
    if at < len(text):
        yield text[at:], False


def segment(word: str, retained: frozenset[str], split_mixed: bool = False, ranges: Sequence[tuple[int, int]] = SCRIPT_RANGES) -> list[str]:
    """Cut a word between characters of the scripts whose pair is not retained, and at mixed edges if asked."""
    if len(word) < 2:
        return [word]
    inside = [in_script(c, ranges) for c in word]
    out, at = [], 0
    for k in range(1, len(word)):
        a, b = inside[k - 1], inside[k]
        if (a and b and word[k - 1 : k + 1] not in retained) or (a != b and split_mixed):
            out.append(word[at:k])
            at = k
    return [*out, word[at:]]
