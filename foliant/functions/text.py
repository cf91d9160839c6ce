"""Scalar text functions: type detection, cleaning, ids, tokens, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.config import PROMPT_PREFIXES

# Java's own \s is this set too; it is spelled out so that the patterns read
# the same in every regex dialect.
WS = r"[ \t\n\x0B\f\r]"

# File extensions per detected type.
EXTENSIONS = {
    "txt": ("txt", "text"),
    "pdf": ("pdf",),
    "md": ("md", "markdown"),
    "csv": ("csv",),
    "json": ("json",),
    "xml": ("xml",),
    "html": ("html", "htm"),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value, so that an expression used several times is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _replace_in(text: Column, sign: str, pattern: str, replacement: str) -> Column:
    """``regexp_replace`` of the texts that contain ``sign``.

    Every match of the pattern holds the sign.  Looking for it is a search in
    the bytes, many times cheaper than a regex over a text without a match.
    """
    return let(text, lambda t: F.when(
        F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, replacement)
    ).otherwise(t))


def detect_file_type(path: Column | str) -> Column:
    """Type from the text after the last dot of the whole path."""
    path = _col(path)
    suffix = F.lower(F.substring_index(path, ".", -1))
    detected = F.when(F.instr(path, ".") == 0, F.lit("unknown"))
    for file_type, extensions in EXTENSIONS.items():
        detected = detected.when(suffix.isin(*extensions), F.lit(file_type))
    return detected.otherwise(F.lit("unknown"))


def clean_text(text: Column | str, remove_extra_whitespace: bool = True) -> Column:
    """Collapse blanks and blank lines, drop carriage returns, trim.

    The order matters: line feeds separated by carriage returns are not
    adjacent when runs are collapsed, so they survive.
    """
    text = _col(text)
    if remove_extra_whitespace:
        text = _replace_in(text, "  ", "  +", " ")
        text = _replace_in(text, "\n\n\n", "\n\n\n+", "\n\n")
        text = F.replace(text, F.lit("\r"), F.lit(""))
    return F.btrim(text, F.lit(" \t\n"))


def clean_pdf_text(text: Column | str) -> Column:
    """Undo the artefacts of text extracted from page layouts."""
    text = _col(text)
    for sign, pattern, replacement in (
        ("-", rf"-{WS}*\n{WS}*", ""),                          # hyphenated line breaks
        ("  ", r"  +", " "),                                    # layout spacing
        ("\n", rf"\n{WS}*[0-9]+{WS}*\n", "\n\n"),              # bare page numbers
        ("\n", rf"([.!?]){WS}*\n{WS}*([a-z])", "$1 $2"),       # sentences broken by columns
        ("", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),        # control characters
        ("\n\n\n", r"\n\n\n+", "\n\n"),
    ):
        text = _replace_in(text, sign, pattern, replacement)
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


BLANKS = " \t\n\r"


def _any(text: Column, test: Callable[[Column, Column], Column], signs: str) -> Column:
    found = F.lit(False)
    for sign in signs:
        found = found | test(text, F.lit(sign))
    return found


# The rules of chunk cleaning.  Each asks for the first or last byte before it
# touches the text, as most chunks need few of them.

def trim_front(text: Column) -> Column:
    return F.when(
        _any(text, F.startswith, BLANKS), F.ltrim(text, F.lit(BLANKS))
    ).otherwise(text)


def trim_back(text: Column) -> Column:
    return F.when(
        _any(text, F.endswith, BLANKS), F.rtrim(text, F.lit(BLANKS))
    ).otherwise(text)


def drop_leading_punctuation(text: Column) -> Column:
    """One orphaned mark at the front, with the blanks behind it."""
    return F.when(
        _any(text, F.startswith, ".,;:)]"), F.regexp_replace(text, r"\A.[ \t]*", "")
    ).otherwise(text)


def drop_trailing_bracket(text: Column) -> Column:
    """One orphaned opening bracket at the end, with the blanks before it."""
    return F.when(
        _any(text, F.endswith, "([{"), F.regexp_replace(text, r"[ \t]*.\z", "")
    ).otherwise(text)


def first_fragment(text: Column) -> Column:
    """A first word of at most three bytes in lower case, taken for a cut word, else ''."""
    word = F.regexp_extract(F.left(text, F.lit(4)), r"\A([a-z][^ ]{0,2}) ", 1)
    return F.when((F.octet_length(text) > 3) & (F.octet_length(word) <= 3), word).otherwise(
        F.lit("")
    )


def drop_fragment(text: Column, word: Column) -> Column:
    """The text behind its first fragment and the blank after it."""
    return F.when(word != "", F.substr(text, F.length(word) + 2)).otherwise(text)


def clean_chunk(piece: Column | str) -> Column:
    """Trim a chunk and drop orphaned punctuation and word fragments (T4)."""
    text = _col(piece)
    for rule in (trim_front, trim_back, drop_leading_punctuation, drop_trailing_bracket):
        text = let(text, rule)
    return let(text, lambda t: let(first_fragment(t), lambda w: drop_fragment(t, w)))


def estimate_tokens(text: Column | str) -> Column:
    """Bytes divided by four, rounded down (T5)."""
    return F.floor(F.octet_length(_col(text)) / 4)


def chunk_id(source_file: Column | str, index: Column | str) -> Column:
    """``chunk_<md5 of the path>_<index>``."""
    return F.concat(
        F.lit("chunk_"), F.md5(_col(source_file)), F.lit("_"), _col(index).cast("string")
    )


def file_metadata(size: Column, modified_epoch: Column, file_type: Column) -> Column:
    """Packed ``size:…,modified:…,type:…``; without file status only the type, after a comma."""
    status = F.concat(
        F.lit("size:"), size.cast("string"), F.lit(",modified:"), modified_epoch.cast("string")
    )
    return F.concat(F.coalesce(status, F.lit("")), F.lit(",type:"), file_type)


def with_prompt(text: Column | str, mode: str = "document") -> Column:
    """Prefix the embedding prompt of the mode."""
    if mode not in PROMPT_PREFIXES:
        raise ValueError("mode must be 'document' or 'query'")
    return F.concat(F.lit(PROMPT_PREFIXES[mode]), _col(text))


def new_session_id(name: Column, created_at: Column) -> Column:
    """``name_yyyy-MM-dd-HHmmss`` (T14, without the lookup of existing ids)."""
    return F.concat(name, F.lit("_"), F.date_format(created_at, "yyyy-MM-dd-HHmmss"))


def session_name(directory: Column | str) -> Column:
    """Directory name up to its last underscore."""
    return F.regexp_replace(_col(directory), r"_[^_]*\z", "")


def format_timestamp(ts: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def message_id(ts: Column, turn: Column | None = None) -> Column:
    """``id_<epoch millis>``; a turn suffix keeps messages of one millisecond apart."""
    millis = F.unix_millis(ts.cast("timestamp")).cast("string")
    base = F.concat(F.lit("id_"), millis)
    return base if turn is None else F.concat(base, F.lit("_"), turn.cast("string"))


def not_empty(text: Column | str) -> Column:
    """Sources with at least one character; blank ones pass (F1)."""
    return F.length(_col(text)) > 0


def long_enough(file_type: Column, cleaned: Column, min_bytes: int = 50) -> Column:
    """Extracted text needs ``min_bytes`` bytes after cleaning (F2)."""
    return (file_type != "pdf") | (F.octet_length(cleaned) >= min_bytes)
