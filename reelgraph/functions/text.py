"""Text columns: queries and prompts, file names, labels, person names and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label of a video in work, the heading of undated items, and the white space that stripping takes.
PLACEHOLDER_LABEL = "Processing AI tags..."
RECENT = "Recent"
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The phrasings of a query, each with or without an article, and how a caption begins.
PHOTO_OF = "a photo of "
ONE_WORD = [
    (PHOTO_OF, True), ("a photograph of ", True), ("a picture of ", True), ("a close-up photo of ", True),
    ("a photo of the ", False), (PHOTO_OF, False),
]
SEVERAL_WORDS = [(PHOTO_OF, False), ("a photograph of ", False), ("a picture showing ", False), ("an image of ", False)]
CAPTION = r"^a (photo|picture) of"


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


# ---------------------------------------------------------------- queries and prompts


def clean_query(query: Column) -> Column:
    return F.lower(strip(query))


def clean_queries(df: DataFrame, text: str = "text") -> DataFrame:
    """Stripped lower-case queries without the empty ones."""
    return df.withColumn(text, clean_query(F.col(text))).filter(F.col(text) != "")


def article(text: Column) -> Column:
    """"an" before a vowel, else "a"."""
    return F.when(F.lower(F.substring(text, 1, 1)).isin("a", "e", "i", "o", "u"), F.lit("an")).otherwise(F.lit("a"))


def prompt_templates(query: Column) -> Column:
    """Prompt texts of one search query; empty for an empty query.

    A query that already reads like a photo caption stays alone. One word gets six phrasings besides itself, several
    words get four, and a fifth with an article unless the query starts with a capital letter.
    """
    return _phrased(strip(query))


def _phrased(q: Column) -> Column:
    """Prompt texts of a stripped query."""
    a_q = F.concat(article(q), F.lit(" "), q)

    def phrasings(kinds: list[tuple[str, bool]]) -> Column:
        return F.array(q, *(F.concat(F.lit(words), a_q if with_article else q) for words, with_article in kinds))

    single, several = phrasings(ONE_WORD), phrasings(SEVERAL_WORDS)
    initial = F.substring(q, 1, 1)
    capital = (F.upper(initial) == initial) & (F.lower(initial) != initial)
    phrased = F.lower(q).rlike(CAPTION)
    return (
        F.when(q == "", F.array().cast("array<string>"))
        .when(phrased, F.array(q))
        .when(~q.rlike(r"\s"), single)
        .when(capital, several)
        .otherwise(F.concat(several, F.array(F.concat(F.lit(PHOTO_OF), a_q))))
    )


def expand_queries(df: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, prompt_no, prompt): one row per prompt to encode.

    Queries are stripped in a step of their own; inside the templates it would be done again for each use.
    """
    stripped = df.select(query_id, strip(F.col(text)).alias("_query"))
    return stripped.select(query_id, F.posexplode(_phrased(F.col("_query"))).alias("prompt_no", "prompt"))


# ---------------------------------------------------------------- paths


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def original_name(name: Column) -> Column:
    """Original of a duplicate whose name got a time stamp of ten to fourteen digits, else null."""
    pattern = r"^(.*)_\d{10,14}(\.[^.]+)$"
    return F.when(
        name.rlike(pattern), F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2))
    )


def identity_of(path: Column) -> Column:
    """Identity in a benchmark file name: First_Last_0001.jpg -> First_Last."""
    return F.regexp_replace(basename(path), r"_\d+\.jpg$", "")


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


# ---------------------------------------------------------------- labels and people


def tags(label: Column) -> Column:
    """Lower-case tags of a comma-joined label, without blanks and the placeholder."""
    parts = F.transform(F.split(F.coalesce(label, F.lit("")), ","), lambda t: F.lower(strip(t)))
    return F.filter(parts, lambda t: (t != "") & (t != F.lit(PLACEHOLDER_LABEL.lower())))


def photo_person_name(name: Column, person_id: Column) -> Column:
    """Given name, else "Person N+1" from the id's number, else the id with spaces."""
    number = F.substring_index(person_id, "_", -1).try_cast("bigint")
    missing = name.isNull() | name.isin("", "Unknown")
    numbered = F.concat(F.lit("Person "), (number + 1).cast("string"))
    return F.when(missing, F.coalesce(numbered, spaced(person_id))).otherwise(name)


def video_person_name(name: Column, person_id: Column) -> Column:
    return F.when(name.isNull() | (name == ""), F.concat(F.lit("Person #"), person_id.cast("string"))).otherwise(name)


def prefixed_id(kind: str, item_id: Column) -> Column:
    return F.concat(F.lit(kind + "_"), item_id.cast("string"))


def strip_prefix(kind: str, item_id: Column) -> Column:
    return F.regexp_replace(item_id, "^" + kind + "_", "")


# ---------------------------------------------------------------- dates


def mtime_date(seconds: Column) -> Column:
    """yyyy-MM-dd (UTC) of an epoch time, null for 0."""
    return F.when(seconds != 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))


def created_date(created_at: Column) -> Column:
    """Date part of a datetime text, or "Recent"."""
    return F.when(created_at.isNull() | (created_at == ""), F.lit(RECENT)).otherwise(F.substring_index(created_at, " ", 1))


def date_heading(date: Column) -> Column:
    """"June 4, 2026"; texts that are not dates pass through."""
    parsed = F.try_to_timestamp(date)
    return F.coalesce(F.date_format(parsed, "MMMM d, y"), date)
