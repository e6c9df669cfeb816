"""Text functions: labels, numerals, templates, escapes, dates and names, all as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals and their letters.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
# Characters that a file name must not have, besides controls.
UNSAFE = r'[/?<>\\:*|"^+=\x00-\x1f\x7f]'


def roman(n: Column, upper: bool = True) -> Column:
    """Roman numerals of a positive number; each letter repeats as often as its value goes into what is left."""
    parts, rest = [], n.cast("int")
    for value, letters in ROMAN:
        parts.append(F.repeat(F.lit(letters if upper else letters.lower()), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.concat(*parts)


def letters(n: Column, upper: bool = True) -> Column:
    """a..z, aa..zz, ...: the letter of n modulo 26, once more for each full round."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if upper else "abcdefghijklmnopqrstuvwxyz"
    n = n.cast("int")
    return F.repeat(F.substring(F.lit(alphabet), (n - 1) % 26 + 1, F.lit(1)), (F.floor((n - 1) / 26) + 1).cast("int"))


def label(style: Column, prefix: Column, number: Column) -> Column:
    """A page label: prefix and number in a style (D, R, r, A, a; anything else has no number)."""
    shown = (
        F.when(style == "D", number.cast("string")).when(style == "R", roman(number)).when(style == "r", roman(number, False))
        .when(style == "A", letters(number)).when(style == "a", letters(number, False)).otherwise("")
    )
    return F.concat(F.coalesce(prefix, F.lit("")), shown)


def ascii_only(text: Column) -> Column:
    """Without code points above 127."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def escaped(text: Column) -> Column:
    """Backslashes, line ends and quotes as two characters each."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`, in one pass from the left."""
    pieces = F.regexp_extract_all(text, F.lit(r"\\[\\n\"]|[^\\]+|\\"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p == "\\\\", "\\").when(p == "\\n", "\n").when(p == '\\"', '"').otherwise(p)), "")


def safe_name(text: Column) -> Column:
    """Without characters that file names must not have."""
    return F.regexp_replace(text, UNSAFE, "")


def padded(n: Column, width: int) -> Column:
    """Zero-padded to a width, longer numbers whole."""
    plain = n.cast("string")
    return F.lpad(plain, F.greatest(F.lit(width), F.length(plain)), F.lit("0"))


def padded_right(n: Column, width: int) -> Column:
    """Zero-padded to a width, of longer numbers the rightmost digits."""
    return F.right(F.concat(F.lit("0" * width), n.cast("string")), F.lit(width))


def file_name(template: str, number: Column, start: Column | None = None, end: Column | None = None, stem: str = "", bookmark: Column | None = None) -> Column:
    """An output's name from a template.

    A run of % is the number in that width; @N, @S and @E (number, first and last
    page) may be followed by more @ for a width; @F is the stem, @B the bookmark, and
    @b20@ as much of it as 20 bytes hold in whole characters.
    """
    known = {"N": number, "S": start, "E": end}
    parts: list[Column] = []
    for found in re.finditer(r"%+|@([NSE])(@{0,8})|@b(\d+)@|@F|@B|[^%@]+|@", template):
        token = found[0]
        if token[0] == "%":
            parts.append(padded_right(number, len(token)))
        elif found[1]:
            value = known[found[1]]
            if value is None:
                raise ValueError(f"the template names {token} but it is not known")
            parts.append(padded_right(value, len(found[2])) if found[2] else value.cast("string"))
        elif token == "@F":
            parts.append(F.lit(stem))
        elif token == "@B" or found[3]:
            name = safe_name(F.coalesce(bookmark if bookmark is not None else F.lit(None).cast("string"), F.lit("")))
            parts.append(utf8_trimmed(name, int(found[3])) if found[3] else name)
        else:
            parts.append(F.lit(token))
    return F.concat(*parts) if parts else F.lit("")


def stamp(template: str, page: Column, last: Column, filename: str = "", label_text: Column | None = None, end_label: Column | None = None, bates: int = 0, bates_width: int = 0, bookmarks: dict[int, Column] | None = None) -> Column:
    """A stamp's text: the longest names are replaced first, so %PageDiv2 is not taken for %Page.

    ``bookmarks``: by level the text of the bookmark that a page stands under; null is empty.
    """
    n = page.cast("int")
    values = [
        ("%PageDiv2", F.floor((n + 1) / 2).cast("string")), ("%Page", n.cast("string")), ("%Roman", roman(n)), ("%roman", roman(n, False)), ("%filename", F.lit(filename)),
        ("%Label", label_text), ("%EndPage", last.cast("string")), ("%EndLabel", end_label), ("%Bates", padded(n + bates - 1, bates_width)),
        *((f"%Bookmark{level}", F.coalesce(mark, F.lit(""))) for level, mark in (bookmarks or {}).items()),
    ]
    text = F.lit(template)
    for name, value in values:
        if name in template and value is not None:
            text = F.replace(text, F.lit(name), value)
    return text


def strftime(template: str, ts: Column) -> Column:
    """A subset of strftime over a timestamp, replaced one code after the other, %% last.

    Weekdays number Sunday 1 to Saturday 7 as %u (Monday is 2), days of the year
    begin at 0, and noon's hour is 00 on the twelve-hour clock.
    """
    hour = F.hour(ts)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    values = {
        "%a": F.date_format(ts, "EEE"), "%A": F.date_format(ts, "EEEE"), "%b": F.date_format(ts, "MMM"), "%B": F.date_format(ts, "MMMM"),
        "%d": two(F.dayofmonth(ts)), "%e": F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), "%H": two(hour), "%I": two(hour % 12), "%j": F.lpad((F.dayofyear(ts) - 1).cast("string"), 3, "0"),
        "%m": two(F.month(ts)), "%M": two(F.minute(ts)), "%p": F.when(hour < 12, "a.m").otherwise("p.m"), "%S": two(F.second(ts)), "%T": F.date_format(ts, "HH:mm:ss"),
        "%u": F.dayofweek(ts).cast("string"), "%w": (F.dayofweek(ts) - 1).cast("string"), "%Y": F.year(ts).cast("string"), "%%": F.lit("%"),
    }
    text = F.lit(template)
    for code, value in values.items():
        if code in template:
            text = F.replace(text, F.lit(code), value)
    return text


def pdf_date(ts: Column) -> Column:
    """D:YYYYMMDDHHmmSSZ of a timestamp in UTC."""
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("Z"))


def xmp_date(text: Column) -> Column:
    """ISO 8601 of a D: date that may stop early; what is missing is year 0, month 1, day 1, time 0, and offset Z."""
    digits = F.regexp_extract(text, r"^(?:D:)?(\d*)", 1)

    def part(start: int, length: int, default: str) -> Column:
        return F.when(F.length(digits) >= start + length - 1, F.substring(digits, start, length)).otherwise(default)

    zone = F.regexp_extract(text, r"([+-])(\d{2})'?(\d{2})?", 0)
    offset = F.when(zone == "", "Z").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.rpad(F.regexp_extract(zone, r"^...'?(\d{2})", 1), 2, "0")))
    return F.concat(part(1, 4, "0000"), F.lit("-"), part(5, 2, "01"), F.lit("-"), part(7, 2, "01"), F.lit("T"), part(9, 2, "00"), F.lit(":"), part(11, 2, "00"), F.lit(":"), part(13, 2, "00"), offset)


def utf8_trimmed(text: Column, width: int) -> Column:
    """The longest beginning of at most ``width`` bytes that ends with a whole character."""
    return F.substring(text, F.lit(1), F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(text), F.lit(width)))), lambda k: F.octet_length(F.substring(text, F.lit(1), k))), lambda b: b <= width)))


def octal_unescaped(text: Column) -> Column:
    """Octal escapes of three digits as characters (code points up to 255); what else follows a backslash stays."""
    parts = F.split(text, r"\\(?=[0-3][0-7]{2})")
    code = lambda p: F.conv(F.substring(p, 1, 3), 8, 10).cast("int")
    shown = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(code(p) == 0, F.lit("\x00")).otherwise(F.chr(code(p))), F.substring(p, F.lit(4), F.length(p)))))
    return F.array_join(shown, "")


def stamp_lines(text: Column) -> Column:
    """The lines of a stamp's text, which a backslash and an n part."""
    return F.split(text, r"\\n")


def stamp_unescaped(text: Column) -> Column:
    """A stamp's text with escaped per cent signs and backslashes plain."""
    return F.regexp_replace(F.replace(text, F.lit("%%"), F.lit("%")), r"\\\\", r"\\")


def stamp_links(text: Column) -> Column:
    """A stamp's text with every %URL[text|address] as its text."""
    return F.regexp_replace(text, r"%URL\[([^|\]]*)\|[^\]]*\]", "$1")


def stamp_addresses(text: Column) -> Column:
    """array<struct<text, address>> of the links in a stamp's text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"%URL\[[^|\]]*\|[^\]]*\]"), F.lit(0))
    part = lambda u, k: F.regexp_extract(u, r"%URL\[([^|\]]*)\|([^\]]*)\]", k)
    return F.transform(found, lambda u: F.struct(part(u, 1).alias("text"), part(u, 2).alias("address")))
