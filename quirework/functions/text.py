"""Scalar text functions as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, and white space, as Unicode text functions see them.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TOKEN = "[A-Za-z0-9]{2,}|[\u0e00-\u0e7f]{2,}"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(col(c), f"{SPACE}+", " "), F.lit(" "))


def lines(c) -> Column:
    """TXT1: lines without their ends; a last line end adds no line."""
    parts = F.split(F.coalesce(col(c), F.lit("")), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def normalize_lines(c) -> Column:
    """TXT1: the lines, each with its white space collapsed."""
    return F.transform(lines(c), collapse)


def tokens(c) -> Column:
    """TXT2: ASCII words and Thai runs of two characters or more, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def safe_filename(c) -> Column:
    """TXT4: the base name in a portable alphabet."""
    base = F.regexp_extract(F.coalesce(F.when(col(c) != "", col(c)), F.lit("upload.bin")), "([^/]*)/*$", 1)
    clean = F.substring(F.btrim(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), F.lit("._")), 1, 180)
    return F.when(clean == "", "upload.bin").otherwise(clean)


def escape_html(c) -> Column:
    """TXT12: the five characters that mean something in HTML."""
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_rtf(c) -> Column:
    r"""TXT12: braces and backslashes escaped, other characters outside 32..126 as signed UTF-16 units."""

    def unit(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.when(n >= 32768, n - 65536).otherwise(n).cast("string"), F.lit("?"))

    def one(ch: Column) -> Column:
        # UTF-16 units from the big-endian bytes of the character
        raw = F.hex(F.encode(ch, "UTF-16BE"))
        first = F.conv(F.substring(raw, 1, 4), 16, 10).cast("int")
        second = F.conv(F.substring(raw, 5, 4), 16, 10).cast("int")
        wide = F.concat(unit(first), F.when(F.length(raw) > 4, unit(second)).otherwise(""))
        return F.when(ch.isin("{", "}", "\\"), F.concat(F.lit("\\"), ch)).when(ch == "\t", "\\tab ").when(ch.rlike("^[\\x20-\\x7e]$"), ch).otherwise(wide)

    return F.array_join(F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("(?s)."), F.lit(0)), one), "")


def retry_delay(attempt, initial: int = 5, most: int = 900) -> Column:
    """TXT16: seconds before the next attempt."""
    return F.least(F.lit(initial) * F.pow(F.lit(2.0), F.greatest(F.lit(0), col(attempt) - 1)), F.lit(float(most))).cast("long")


def owner_pseudonym(issuer, subject) -> Column:
    """TXT15: an owner's name that doesn't tell the subject."""
    return F.concat(F.lit("user:oidc:"), F.sha2(F.concat(col(issuer), F.lit("\0"), col(subject)), 256))


def hmac_hex(c, key: bytes) -> Column:
    """TXT15: the keyed SHA-256 digest (HMAC) of a text: two digests over the padded key."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, col(c).cast("binary")), 256))), 256)
