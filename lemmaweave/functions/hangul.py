"""Hangul syllable arithmetic as Column expressions.

A precomposed syllable is 0xAC00 + initial * 588 + vowel * 28 + coda; the numbers are those of the Unicode blocks of
conjoining jamo. Everything here stays in the JVM. A text without a final Hangul syllable has the index -1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, COUNT = 0xAC00, 11172
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
#: ㅏ and ㅗ, which take 아 rather than 어.
BRIGHT = (0, 8)


def index(char: Column) -> Column:
    """The place of a one-character text in the block of syllables, or -1."""
    n = F.ascii(char) - FIRST
    return F.when((n >= 0) & (n < COUNT), n).otherwise(-1)


def last_char(c: Column) -> Column:
    return F.right(c, F.lit(1))


def but_last(c: Column, n: int = 1) -> Column:
    return F.left(c, F.char_length(c) - n)


def initial(n: Column) -> Column:
    return F.when(n >= 0, F.floor(n / 588).cast("int")).otherwise(-1)


def vowel(n: Column) -> Column:
    return F.when(n >= 0, (F.floor(n / 28) % 21).cast("int")).otherwise(-1)


def coda(n: Column) -> Column:
    """The coda of the syllable, 0 for an open one, -1 for what is no syllable."""
    return F.when(n >= 0, (n % 28).cast("int")).otherwise(-1)


def char(n: Column) -> Column:
    """The syllable of an index."""
    return F.decode(F.unhex(F.lpad(F.hex((n + FIRST).cast("long")), 4, "0")), "UTF-16BE")


def compose(i: Column, v: Column, t: Column) -> Column:
    return char(i * 588 + v * 28 + t)


def text_coda(c: Column) -> Column:
    return coda(index(last_char(c)))


def replace_last(c: Column, v: Column, t: Column) -> Column:
    """c with another vowel and coda in its last syllable; null if that is no syllable."""
    n = index(last_char(c))
    return F.when(n >= 0, F.concat(but_last(c), compose(initial(n), v, t)))


def is_bright(n: Column) -> Column:
    return vowel(n).isin(*BRIGHT)


def has_hangul(c: Column) -> Column:
    return c.rlike("[가-힣]")


# ---- the same arithmetic for rule builders on the driver -----------------------------------------


def split_char(c: str) -> tuple[int, int, int] | None:
    n = ord(c) - FIRST
    return (n // 588, n // 28 % 21, n % 28) if 0 <= n < COUNT else None


def with_coda(text: str, t: int) -> str:
    """text with another coda in its last syllable."""
    n = ord(text[-1]) - FIRST
    return text[:-1] + chr(FIRST + n - n % 28 + t)


def with_initial(text: str, i: int) -> str:
    """text with another initial in its first syllable."""
    n = ord(text[0]) - FIRST
    return chr(FIRST + n % 588 + i * 588) + text[1:]
