"""Column functions over names, texts, dates and vectors.

All are built-in expressions, but for `detect_language` and `half_precision`, which are vectorised UDFs. Nulls give null
unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, StringType

ABOVE = " › "
AROUND = 60


def normal(text: Column) -> Column:
    """Runs of whitespace as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words. Letters, digits, marks that follow them and underscores; no dictionary for scripts without blanks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}_]*"), 0)


def segmented(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def name_tokens(name: Column) -> Column:
    """The words of a name, in which _ - . / : part words."""
    return tokens(F.regexp_replace(name, r"[_\-./:]", " "))


def name_key(name: Column) -> Column:
    return F.array_join(name_tokens(name), " ")


def names(text: Column, needle: Column) -> Column:
    """Whether a run of the text's words is the needle's words; an empty needle is nowhere."""
    key = name_key(needle)
    return (key != "") & F.contains(F.concat(F.lit(" "), name_key(text), F.lit(" ")), F.concat(F.lit(" "), key, F.lit(" ")))


def byte_offset(text: Column, position: Column) -> Column:
    """Bytes before the character at a position counted from 1."""
    return F.octet_length(F.substring(text, F.lit(1), position - 1)).cast("long")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets."""
    raw = F.encode(text, "utf-8")
    return F.decode(F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")), "utf-8")


def excerpt(text: Column, offset: Column, around: int = AROUND) -> Column:
    """Text up to `around` bytes on either side of a byte offset, whole characters only, an ellipsis where it is cut.

    A byte of 10xxxxxx never begins a character: the cuts move back, or on, by as many of those as they meet, three at most.
    """
    raw = F.encode(text, "utf-8")
    size = F.octet_length(text)
    first, last = F.greatest(offset - around, F.lit(0)), F.least(offset + around, size)

    def inside(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(raw, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return (at > 0) & (at < size) & byte.bitwiseAND(F.lit(0xC0)).eqNullSafe(F.lit(0x80))

    def moved(at: Column, step: int) -> Column:
        out = at
        for k in (1, 2, 3):
            here = at + step * (k - 1)
            out = F.when(inside(here) & (out == here), at + step * k).otherwise(out)
        return out

    a, b = moved(first, -1), moved(last, 1)
    part = F.trim(F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "utf-8"))
    return F.concat(F.when(a > 0, "…").otherwise(""), part, F.when(b < size, "…").otherwise(""))


def section_number(name: Column, base: Column) -> Column:
    """1 for the base itself, n for `base #n` with n of 2 or more, else null."""
    rest = F.when(F.startswith(name, base), F.substring(name, F.length(base) + 1, F.length(name)))
    digits = F.nullif(F.regexp_extract(rest, r"^ #([0-9]{1,9})$", 1), F.lit("")).cast("int")
    return F.when(rest == "", 1).when(digits >= 2, digits)


def file_of(name: Column) -> Column:
    """The file of a section's name: what stands before the first heading, without a number."""
    return F.regexp_replace(F.split_part(name, F.lit(ABOVE), F.lit(1)), r"( #[0-9]+)+$", "")


def belongs(name: Column, file: Column) -> Column:
    return file_of(name) == file


def locator(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), name)


def locator_name(of: Column) -> Column:
    return F.substring(of, F.position(F.lit(":"), of) + 1, F.length(of))


def rfc3339(value: Column) -> Column:
    """A moment; text that is none is null."""
    return F.try_to_timestamp(value)


def rfc3339_text(moment: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def session_date(stamp: Column) -> Column:
    """Dates as data sets write them: `2023/05/23 (Tue) 13:01`, or `1:56 pm on 8 May, 2023`."""
    slashed = F.try_to_timestamp(F.regexp_replace(stamp, r" \([A-Za-z]+\) ", " "), F.lit("yyyy/MM/dd HH:mm"))
    parts = [F.regexp_extract(stamp, r"^(\d{1,2}:\d{2}) ([ap]m) on (\d{1,2}) ([A-Za-z]+), (\d{4})$", k) for k in range(1, 6)]
    said = F.concat_ws(" ", parts[0], F.upper(parts[1]), parts[2], parts[3], parts[4])
    return F.coalesce(slashed, F.try_to_timestamp(said, F.lit("h:mm a d MMMM yyyy")))


def topic_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def evidence_ids(text: Column) -> Column:
    """`D8:6; D9:017` as an array of D8:6 and D9:17; what has another form is left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(D[0-9]{1,9}:[0-9]{1,9})"), 1)
    number = lambda s, k: F.split_part(F.substring(s, 2, 40), F.lit(":"), F.lit(k)).cast("int").cast("string")
    return F.transform(found, lambda s: F.concat(F.lit("D"), number(s, 1), F.lit(":"), number(s, 2)))


def proper_names(text: Column) -> Column:
    """Distinct runs of capitalised words, across particles such as of and van."""
    word = r"\p{Lu}[\p{L}\p{N}'’-]*"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"({word}(?: (?:(?:of|the|de|la|van|von|der|al|bin|da|di) ){{0,2}}{word})*)"), 1))


def segment_documents(documents: Column) -> Column:
    """Documents that a segment should hold: a quarter, between 10,000 and 250,000."""
    return F.greatest(F.lit(10_000), F.least(F.lit(250_000), F.floor(documents / 4)))


def worth_rebuilding(segments: Column, documents: Column) -> Column:
    return segments > 2 * F.greatest(F.lit(1), F.ceil(documents / segment_documents(documents)))


_COMMON = {
    "en": "the and of to in is that it was for on with".split(),
    "fr": "le la les et des est une dans que pour qui au".split(),
    "de": "der die und das ist nicht ein eine zu den mit auf".split(),
    "es": "el los las que una por con para del se es y".split(),
    "nl": "de het een en van ik niet met voor zijn dat op".split(),
    "it": "il che di non per una sono con gli della è lo".split(),
    "pt": "o os uma não que para com do da em são mais".split(),
}


@pandas_udf(StringType())
def detect_language(text):
    """The language most of whose commonest words a text has; null where fewer than three are met or two languages tie."""
    import re

    import pandas as pd

    sets = {k: set(v) for k, v in _COMMON.items()}

    def one(t):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        votes = sorted(((sum(w in s for w in words), k) for k, s in sets.items()), reverse=True)
        return votes[0][1] if votes[0][0] >= 3 and votes[0][0] > votes[1][0] else None

    return pd.Series([one(t) for t in text], dtype=object)


@pandas_udf(ArrayType(FloatType()))
def half_precision(vector):
    """Vectors as they come back from 16-bit storage."""
    import numpy as np
    import pandas as pd

    return pd.Series([None if v is None else np.asarray(v, np.float16).astype(np.float32) for v in vector])


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is nought."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of three-word shingles of lower-case words; fewer words are one shingle, two empty texts are alike."""

    def shingles(text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
        # bound once: an expression inside a lambda would be computed anew for each element
        three = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda k: F.array_join(F.slice(w, k, 3), " ")))
        return F.array_distinct(three[0])

    both = F.array(F.struct(shingles(a).alias("x"), shingles(b).alias("y")))
    return F.transform(both, lambda s: F.size(F.array_intersect(s["x"], s["y"])) / F.size(F.array_union(s["x"], s["y"])))[0]
