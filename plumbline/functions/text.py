"""Value shapes, formats and masking as SQL expressions (all inside the JVM).

The functions take and return SQL text: large expressions reach Spark in one call each, and they can be
nested in lambdas. ``q`` quotes a literal, ``ident`` a column.
"""
from __future__ import annotations

import string

from plumbline import vocab

_ASCII_FROM = string.ascii_uppercase + string.ascii_lowercase + string.digits
_ASCII_TO = "A" * 26 + "a" * 26 + "9" * 10
# digits outside the decimal-number category: superscript, subscript and circled ones
_OTHER_DIGITS = "²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"


def q(value: str | None) -> str:
    """SQL literal of a Python string."""
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def one_of(c: str, words) -> str:
    return f"{c} IN ({', '.join(q(w) for w in words)})"


def array_of(words) -> str:
    return f"array({', '.join(q(w) for w in words)})"


def signature(c: str) -> str:
    """Shape of a value: upper case -> A, lower case -> a, digit -> 9, anything else unchanged.

    Plain ASCII values take one ``translate`` call; the regex classes run only where they are needed.
    """
    wide = f"regexp_replace({c}, {q(r'\p{IsUppercase}')}, 'A')"
    wide = f"regexp_replace({wide}, {q(r'\p{IsLowercase}')}, 'a')"
    wide = f"regexp_replace({wide}, {q(rf'[\p{{Nd}}{_OTHER_DIGITS}]')}, '9')"
    return f"CASE WHEN length({c}) = octet_length({c}) THEN translate({c}, '{_ASCII_FROM}', '{_ASCII_TO}') ELSE {wide} END"


def collapse(shape: str) -> str:
    """Merge runs of one class in a signature: 'AAA-9999' -> 'A-9'."""
    return f"regexp_replace({shape}, {q(r'([Aa9])\1+')}, '$1')"


def mask(c: str) -> str:
    """Hide a value but keep its outline: 'r***@g***.com', '+9*********10', '****'."""
    domain = f"substring({c}, instr({c}, '@') + 1)"
    ending = f"substring_index({domain}, '.', -1)"
    host = f"substring({domain}, 1, length({domain}) - length({ending}) - 1)"
    first = f"substring(substring_index({c}, '@', 1), 1, 1)"
    return (f"CASE WHEN contains({c}, '@') THEN CASE WHEN contains({domain}, '.') "
            f"THEN concat({first}, '***@', substring({host}, 1, 1), '***.', {ending}) ELSE concat({first}, '***@***') END "
            f"WHEN length({c}) <= 4 THEN repeat('*', length({c})) "
            f"ELSE concat(substring({c}, 1, 2), regexp_replace(substring({c}, 3, length({c}) - 4), {q(r'[\p{L}\p{N}]')}, '*'), "
            f"right({c}, 2)) END")


def strip(c: str) -> str:
    """Cut all white space at both ends (``trim`` would cut blanks only)."""
    return f"regexp_replace({c}, {q(r'^\s+|\s+$')}, '')"


def snake(c: str) -> str:
    return f"lower(regexp_replace({c}, '(?<=[a-z0-9])(?=[A-Z])', '_'))"


def missing_nan(c: str) -> str:
    """The value as a double; NaN counts as missing."""
    return f"nanvl(CAST({c} AS DOUBLE), CAST(NULL AS DOUBLE))"


def signature_regex(shape: str) -> str:
    """Regex that accepts just the values of one shape: 'AAA-99' -> '^[A-Z]{3}\\-\\d{2}$'."""
    special = q(r"[\-\[\]{}()*+?.\\^$|#&~\s]")
    unit = (f"CASE left(r, 1) WHEN 'A' THEN '[A-Z]' WHEN 'a' THEN '[a-z]' WHEN '9' THEN {q(chr(92) + 'd')} "
            f"ELSE CASE WHEN left(r, 1) RLIKE {special} THEN concat({q(chr(92))}, left(r, 1)) ELSE left(r, 1) END END")
    token = f"concat({unit}, CASE WHEN length(r) = 1 THEN '' ELSE concat('{{', length(r), '}}') END)"
    runs = f"regexp_extract_all({shape}, {q(r'((?s)(.)\2*)')}, 1)"
    return f"concat('^', array_join(transform({runs}, r -> {token}), ''), '$')"


def sensitive_name(c: str) -> str:
    return f"{c} RLIKE {q('(?i)' + vocab.SENSITIVE_NAME)}"


def bool_word(c: str) -> str:
    """'true' / 'false' / 'invalid' for the usual spellings of a boolean."""
    word = f"lower({strip(c)})"
    return f"CASE WHEN {one_of(word, vocab.TRUE_WORDS)} THEN 'true' WHEN {one_of(word, vocab.FALSE_WORDS)} THEN 'false' ELSE 'invalid' END"
