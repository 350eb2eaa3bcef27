"""Column functions on texts and token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Printable ASCII and the nine Polish letters in both cases.
VALID = r"[^\x20-\x7Eąćęłńóśźż ĄĆĘŁŃÓŚŹŻ]"
#: Entity kinds and their patterns, tried in this order.
ENTITIES = {
    "URL": r"https?://\S+",
    "MENTION": r"@\w+",
    "HASHTAG": r"#\w+",
    "RESERVED": r"\b(?:RT|FAV)\b",
    "EMOJI": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]",
    "SMILEY": r"(?:[:;=8][\-o*']?[)\](\[dDpP/:}{@|\\])",
    "NUMBER": r"(?<![\w$])[-+]?\d+(?:[.,]\d+)*(?!\w)",
}


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of `least` or more word characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN.replace("2,", f"{least},")), F.lit(0))


def split_first(text: Column, mark: str = ":") -> Column:
    return F.substring_index(text, mark, 1)


def key_of(line: Column) -> Column:
    """What stands before the first colon."""
    return F.regexp_extract(line, r"^([^:]*):", 1)


def value_of(line: Column) -> Column:
    """What stands after the first colon, trimmed."""
    return F.trim(F.regexp_extract(line, r"^[^:]*:(?s)(.*)$", 1))


def split_ws(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def clean_lemmas(lemmas: Column) -> Column:
    """Without ASCII punctuation, empty and all-digit tokens."""
    bare = F.transform(lemmas, lambda x: F.trim(F.regexp_replace(x, r"[!-/:-@\[-`{-~]", "")))
    return F.filter(bare, lambda x: (x != "") & ~x.rlike(r"^\d+$"))


def strip_quotes(text: Column) -> Column:
    return F.translate(text, "'\"", "")


def valid_chars(text: Column) -> Column:
    return F.regexp_replace(text, VALID, "")


def tokenise_entities(text: Column, kinds: list[str] | None = None) -> Column:
    """Entities replaced by placeholders such as $HASHTAG$."""
    for kind in kinds or ENTITIES:
        text = F.regexp_replace(text, ENTITIES[kind], rf"\${kind}\$")
    return text


def clean_entities(text: Column, kinds: list[str] | None = None) -> Column:
    """Entities removed, white space collapsed."""
    for kind in kinds or ENTITIES:
        text = F.regexp_replace(text, ENTITIES[kind], "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def parse_created(text: Column) -> Column:
    """A timestamp such as `Wed Oct 10 20:19:24 +0000 2018`; the day's name is skipped, Spark does not parse it."""
    return F.to_timestamp(F.substring(text, 5, 100), "MMM dd HH:mm:ss Z yyyy")
