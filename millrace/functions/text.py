"""String and number conventions that the other functions share.

White space means the set that browsers trim (ASCII white space, the Unicode spaces, line and paragraph
separators and the byte order mark), which is wider than Spark's ``trim`` and Java's ``\\s``. Lengths and
places count code points. Halves round up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


#: The characters of ``WS``.
WHITE = "\t\n\x0b\f\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def trim(x: Column) -> Column:
    """Looks at the two ends only; a pattern would be tried at every character."""
    return F.btrim(x, F.lit(WHITE))


def trim_end(x: Column) -> Column:
    return F.rtrim(x, F.lit(WHITE))


def collapse(x: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(x, f"{WS}+", " ")


def is_blank(x: Column) -> Column:
    return F.length(trim(x)) == 0


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def fixed(number: Column, unit: int, digits: int) -> Column:
    """A whole number over ``unit`` (a power of two) with so many decimals, in whole numbers throughout."""
    scale = 10**digits
    n = ((number * scale + unit // 2) - F.pmod(number * scale + unit // 2, F.lit(unit))) / F.lit(unit)
    n = n.cast("long")
    whole = ((n - F.pmod(n, F.lit(scale))) / F.lit(scale)).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(scale)).cast("string"), digits, "0"))


def last_dot(x: Column) -> Column:
    """Place of the last dot from 1, or 0."""
    back = F.instr(F.reverse(x), ".")
    return F.when(back > 0, F.length(x) - back + 1).otherwise(0)


def xml_escape(x: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x
