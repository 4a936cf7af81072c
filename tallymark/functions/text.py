"""Text expressions: SQL normalisation, names, JSON lists, identifiers.

All are built-in Spark expressions, so they run inside code generation.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- SQL text -------------------------------------------------------------

_STRING = r"'[^']*+(?:''[^']*+)*+'?"
_QUOTED = r'"(?:[^"\\]|\\.)*+"?'
_COMMENT = r"--[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_CONSTANT = r"(?i:NULL|TRUE|FALSE)(?![\p{L}\p{N}_])"
_NUMBER = r"(?:\p{Nd}++(?:\.\p{Nd}*+)?|\.\p{Nd}++)(?:[eE][+-]?\p{Nd}++)?"


def _one_of(characters: str) -> str:
    """A class listing its characters one by one: a table look-up in Java, where ranges are tested in turn."""
    return "[" + "".join(f"\\x{ord(c):02X}" for c in characters) + "]"


# ASCII is told apart by table look-ups; other letters and signs take the last two branches.
_ASCII_WORD = _one_of(string.ascii_letters + string.digits + "_")
_ASCII_PLAIN = _one_of("".join(chr(i) for i in range(128) if chr(i) not in string.ascii_letters + string.digits + "'\"."))
_FIRST = _one_of("".join(c for c in string.ascii_letters if c not in "nNtTfF"))
_KEPT = (
    rf"(?:{_FIRST}|(?!{_CONSTANT})[nNtTfF]){_ASCII_WORD}*+[\p{{L}}\p{{N}}_]*+{_ASCII_PLAIN}*+|{_ASCII_PLAIN}++"
    rf"|(?![\x00-\x7F])(?:\p{{L}}[\p{{L}}\p{{N}}_]*+|[^\p{{L}}\p{{Nd}}])"
)

# Each match starts where the one before ended, swallows what is kept (group 1)
# and ends with the part to replace. Possessive loops: no backtracking and no
# recursion, so megabyte texts are fine.
_SKIP_TO_COMMENT = rf"\G((?:[^'\"/\-]++|{_STRING}|{_QUOTED}|-(?!-)|/(?!\*))*+)(?:{_COMMENT})"
_SKIP_TO_LITERAL = (
    rf"\G((?:{_KEPT}|\.(?!\p{{Nd}})|{_QUOTED})*+)"
    rf"(?:{_STRING}|{_NUMBER}|{_CONSTANT})"
)
LITERAL = ":literal"

_OLD_COMMENT = r"(?s)--[^\n]*|/\*.*?(?:\*/|\z)"
_OLD_NUMBER = r"(?:\p{Nd}|\.(?=\p{Nd}))[\p{Nd}.eE+\-]*+"
_OLD_QUOTED = r'"(?:[^"\\]|\\.)*+'
_OLD_SKIP = (
    rf"\G((?:{_KEPT}|\.(?!\p{{Nd}})|\"\")*+)"
    rf"(?:{_STRING}|{_OLD_NUMBER}|{_CONSTANT})"
)


def strip_comments(text: Column, compat: bool = False) -> Column:
    """Drop ``--`` and ``/* */`` comments, keeping line ends.

    Comment marks inside quotes are text; ``compat=True`` treats them as comments.
    """
    if compat:
        return F.regexp_replace(text, _OLD_COMMENT, "")
    return F.regexp_replace(text, _SKIP_TO_COMMENT, "$1")


def mask_literals(text: Column, compat: bool = False) -> Column:
    """Strings, numbers, NULL, TRUE and FALSE become ``:literal``.

    ``compat=True`` empties quoted identifiers and reads ``1+2`` as one number.
    """
    if compat:
        emptied = F.regexp_replace(text, rf"\G((?:{_STRING}|[^'\"]++)*+){_OLD_QUOTED}(\"?)", '$1"$2')
        return F.regexp_replace(emptied, _OLD_SKIP, f"$1{LITERAL}")
    return F.regexp_replace(text, _SKIP_TO_LITERAL, f"$1{LITERAL}")


# Every kind of Unicode white space.
WHITESPACE = "[" + _one_of(string.whitespace + "\x1c\x1d\x1e\x1f\x85") + r"\p{Z}]"
_BLANKS = WHITESPACE + "++"


def squash_ws(text: Column) -> Column:
    """Runs of whitespace become one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def strip(text: Column) -> Column:
    """Trim every kind of whitespace."""
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def normalize_sql(text: Column, compat: bool = False) -> Column:
    return squash_ws(mask_literals(strip_comments(text, compat), compat))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def sql_fingerprint(text: Column, compat: bool = False) -> Column:
    return content_hash(normalize_sql(text, compat))


def strip_templates(text: Column) -> Column:
    """``{{..}}`` becomes a comment; ``{%..%}`` and ``{#..#}`` become blanks of the same length, keeping line ends."""
    out = F.regexp_replace(text, r"(?s)\{\{.*?\}\}", "/* jinja_expr */")
    for tag in (r"(?s)\{%.*?%\}", r"(?s)\{#.*?#\}"):
        blanks = F.transform(F.regexp_extract_all(out, F.lit(tag), F.lit(0)), lambda m: F.regexp_replace(m, r"[^\n]", " "))
        between = F.split(out, tag, -1)
        out = F.array_join(
            F.zip_with(between, blanks, lambda kept, blank: F.concat(kept, F.coalesce(blank, F.lit("")))), ""
        )
    return out


def view_body(ddl: Column) -> Column:
    """The query of ``CREATE VIEW .. AS ..`` text without its last ``;``; NULL when there is none."""
    text = strip(ddl)
    after_as = F.regexp_extract(text, r"(?is)\bAS\b(.*)", 1)
    from_select = F.regexp_extract(text, r"(?is)\bSELECT\b.*", 0)
    body = F.when(text.rlike(r"(?i)\bAS\b"), after_as).when(text.rlike(r"(?i)\bSELECT\b"), from_select)
    return F.regexp_replace(body, r"^\s+|\s*;?\s*$", "")


# ---- names ----------------------------------------------------------------


def norm_name(name: Column) -> Column:
    """Lower case; runs of ``_``, ``-``, ``.`` and blanks become one space."""
    spaced = F.regexp_replace(strip(F.lower(name)), r"[_\-.]+", " ")
    return F.regexp_replace(spaced, _BLANKS, " ")


def slug(name: Column, length: int = 255) -> Column:
    """Lower-case name of letters, digits and ``_``; a name over ``length`` ends in a hash of the whole, so that names stay apart."""
    full = F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_"))
    short = F.concat(F.substring(full, 1, length - 17), F.lit("_"), F.substring(F.sha2(name.cast("binary"), 256), 1, 16))
    return F.when(F.length(full) <= length, full).otherwise(short)


# Text that marks an attempt to smuggle in a statement.
INJECTION_PATTERNS = (
    r";\s*(DROP|DELETE|UPDATE|INSERT|ALTER|CREATE|TRUNCATE)",
    r"--",
    r"/\*",
    r"\*/",
    r"UNION\s+SELECT",
    r"EXEC\s*\(",
    r"xp_",
    r"sp_",
)


def has_injection(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(INJECTION_PATTERNS))


def is_identifier(name: Column, length: int = 255) -> Column:
    """Letters, digits, ``_`` and ``.`` only, within ``length``, free of injection marks."""
    trimmed = F.trim(name)
    return (F.length(trimmed) <= length) & trimmed.rlike(r"^[a-zA-Z0-9_.]+$") & ~has_injection(trimmed)


def clean_text(text: Column, length: int | None = None, keep_newlines: bool = False) -> Column:
    """Drop control characters and trim; with ``length``, NULL when the text is longer."""
    control = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]" if keep_newlines else r"[\x00-\x1F\x7F]"
    cleaned = F.regexp_replace(text, control, "")
    return strip(cleaned) if length is None else F.when(F.length(text) <= length, strip(cleaned))


def fk_candidates(column: Column) -> Column:
    """Table names a ``x_id`` column may point to: xs, xes, x, and x without its last s. Empty for other names."""
    lowered = F.lower(column)
    stem = F.regexp_replace(lowered, "_id$", "")
    singular = F.when(stem.endswith("s"), F.regexp_replace(stem, "s$", ""))
    names = F.array_compact(F.array(F.concat(stem, F.lit("s")), F.concat(stem, F.lit("es")), stem, singular))
    return F.when(lowered.endswith("_id"), names).otherwise(F.array().cast("array<string>"))


# ---- values ---------------------------------------------------------------


def version_key(version: Column) -> Column:
    """Version text as numbers: ``"1.10-beta"`` -> [1, 10]; anything unreadable counts as 0."""
    head = F.regexp_replace(F.trim(F.coalesce(version, F.lit(""))), r"(?s)[^0-9.].*$", "")
    return F.transform(F.split(head, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0)))


def version_compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1; the shorter version is padded with zeros."""
    a, b = version_key(left), version_key(right)
    longer = F.greatest(F.size(a), F.size(b))
    pad = lambda v: F.concat(v, F.array_repeat(F.lit(0).cast("bigint"), longer - F.size(v)))
    return F.when(pad(a) < pad(b), -1).when(pad(a) > pad(b), 1).otherwise(0)


def usage_date(text: Column, now: Column) -> Column:
    """Date of an ISO timestamp given as text; ``now`` where the text has no date."""
    day = F.regexp_extract(F.trim(text), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.coalesce(day.try_cast("date"), now.cast("date"))


def as_list(text: Column) -> Column:
    """A JSON list, or one plain value, as an array of non-empty strings."""
    parsed = F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>")
    items = F.coalesce(parsed, F.array(text))
    return F.coalesce(F.filter(items, lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>"))
