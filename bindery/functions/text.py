"""Text measures and rewrites shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.bind import bind

# The results depend on them.
UNITS_PER_TOKEN = 4
MIN_FENCE = 3
BINARY_SAMPLE_UNITS = 8000
REPLACEMENT_SHARE_LIMIT = 0.1
REPLACEMENT_CHAR = "�"

# Whitespace as the expected results define it: ASCII blanks, every Unicode space
# separator and the byte-order mark. Java's own \s is narrower, so it is spelled out.
_INLINE_BLANKS = r"\t\x0B\f \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_LINE_ENDS = r"\n\r\x{2028}\x{2029}"
BLANK = f"[{_INLINE_BLANKS}{_LINE_ENDS}]"
OUTER_BLANKS = rf"\A{BLANK}+|{BLANK}+\z"
ANY_BUT_LINE_END = f"[^{_LINE_ENDS}]"

# A run of backticks that only whitespace separates from the start of its line.
FENCE_RUN = rf"(?:\A|[{_LINE_ENDS}])[{_INLINE_BLANKS}]*(`{{3,}})"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, which is what every size in a pack counts.

    Pure ASCII needs no encoding: its byte, character and unit counts agree.
    """
    octets = F.octet_length(text)
    return (
        F.when(octets == F.length(text), octets)
        .otherwise(F.octet_length(F.encode(text, "UTF-16BE")) / 2)
        .cast("bigint")
    )


def tokens_for_units(units: Column) -> Column:
    return F.ceil(units / F.lit(UNITS_PER_TOKEN)).cast("bigint")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, rounded up; 0 for empty text."""
    return tokens_for_units(utf16_length(text))


def format_count(number: Column) -> Column:
    """Thousands-grouped figure; up to three decimals where there are any."""
    rounded = F.round(number.cast("double"), 3)
    whole = rounded == F.floor(rounded)
    return F.when(whole, F.format_number(rounded, 0)).otherwise(
        F.rtrim(F.format_number(rounded, 3), F.lit("0"))
    )


def size_label(size_bytes: Column) -> Column:
    """``2 KB``: whole kilobytes, halves rounded up."""
    return F.concat(F.round(size_bytes / F.lit(1024)).cast("bigint").cast("string"), F.lit(" KB"))


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_BLANKS, "")


def collapse_blank_runs(text: Column) -> Column:
    """Two or more blank lines in a row become one."""
    return bind(
        text,
        lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t),
    )


def fence_for(content: Column) -> Column:
    """A backtick fence longer than any run that opens a line of the content."""
    runs = F.regexp_extract_all(content, F.lit(FENCE_RUN), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    return F.when(
        F.contains(content, F.lit("```")),
        F.repeat(F.lit("`"), F.greatest(F.lit(MIN_FENCE), longest + 1)),
    ).otherwise(F.lit("`" * MIN_FENCE))


def looks_binary(content: Column) -> Column:
    """Whether the opening of the text holds a NUL, or too many replacement characters.

    The sample is 8,000 UTF-16 units. Only text with characters outside the basic
    plane needs the slower cut by units, where a pair split at the edge counts for
    the length but never for the share.
    """
    head = F.substring(content, 1, BINARY_SAMPLE_UNITS)
    units = utf16_length(head)
    encoded = F.encode(head, "UTF-16BE")
    edge = F.hex(F.substring(encoded, 2 * BINARY_SAMPLE_UNITS - 1, 1))
    cut_bytes = F.when(edge.between("D8", "DB"), 2 * BINARY_SAMPLE_UNITS - 2).otherwise(2 * BINARY_SAMPLE_UNITS)
    cut = F.when(
        units > BINARY_SAMPLE_UNITS, F.decode(F.substring(encoded, F.lit(1), cut_bytes), "UTF-16BE")
    ).otherwise(head)

    def judge(sample: Column) -> Column:
        replacements = F.length(sample) - F.length(F.replace(sample, F.lit(REPLACEMENT_CHAR), F.lit("")))
        share = replacements / F.greatest(F.least(units, F.lit(BINARY_SAMPLE_UNITS)), F.lit(1))
        return F.contains(sample, _nul()) | (share > F.lit(REPLACEMENT_SHARE_LIMIT))

    # Text without either character, nearly all of it, needs no exact sample.
    suspicious = F.contains(head, _nul()) | F.contains(head, F.lit(REPLACEMENT_CHAR))
    return F.when(suspicious, bind(cut, judge)).otherwise(F.lit(False))


def _nul() -> Column:
    return F.char(F.lit(0))


def decode_text(raw: Column) -> Column:
    """Bytes to text: bad UTF-8 becomes U+FFFD, a leading byte-order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\A\x{FEFF}", "")
