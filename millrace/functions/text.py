"""String functions as column expressions; null stays null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that count as white space.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Those of them that the pattern engine's own class lacks.
EXOTIC = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Words without meaning for a query.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "will", "with")
MIN_QUERY, MAX_QUERY = 3, 2000


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^[{WHITE}]+|[{WHITE}]+\z", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, f"[{WHITE}]+", " ")


def split_words(c: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(c, f"[{WHITE}]+"), lambda x: x != "")


def tokenize(c: Column) -> Column:
    """Lower-cased words, everything but ``a-z0-9`` deleted inside them, empty ones dropped; null gives an empty list.

    White space beyond ASCII is rare and made plain first, as classes of many ranges cost about ten times as much per character.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    plain = F.when(low.rlike(f"[{EXOTIC}]"), F.regexp_replace(low, f"[{EXOTIC}]", " ")).otherwise(low)
    return F.array_remove(F.split(F.regexp_replace(plain, r"[^\p{Alnum}\s]+", ""), r"\s+"), "")


def normalize_whitespace(c: Column) -> Column:
    """White space collapsed (line ends too) and stripped."""
    return strip(collapse(c))


request_normalize = normalize_whitespace


def expander_normalize(c: Column) -> Column:
    """White space collapsed and stripped, then closing ``. ? !`` removed, then stripped again."""
    return strip(F.regexp_replace(normalize_whitespace(c), r"[.?!]+\z", ""))


def query_error(c: Column) -> Column:
    """Why a query cannot be normalised, null if it can."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) == 0, "Query cannot be empty").when(F.length(s) < MIN_QUERY, "Query too short").when(F.length(s) > MAX_QUERY, "Query too long")


def query_normalize(c: Column) -> Column:
    """Stripped, white space collapsed, then control characters deleted (in this order); null where :func:`query_error` is not."""
    return F.when(query_error(c).isNull(), F.regexp_replace(collapse(strip(c)), r"[\x00-\x1f]", ""))


def query_valid(c: Column) -> Column:
    """Long enough when stripped and short enough as it stands; null and empty queries are not valid."""
    return F.coalesce((F.length(strip(c)) >= MIN_QUERY) & (F.length(c) <= MAX_QUERY), F.lit(False))


def remove_stopwords(c: Column) -> Column:
    """Lower-cased words that are no stopwords, by one space; attached punctuation keeps a word."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_join(F.filter(split_words(F.lower(c)), lambda x: ~F.array_contains(stop, x)), " ")


def keywords(c: Column) -> Column:
    """Sorted distinct lower-cased words of more than three letters and digits."""
    kept = F.regexp_replace(c, f"[^a-zA-Z0-9{WHITE}]", "")
    return F.array_sort(F.array_distinct(F.filter(split_words(F.lower(kept)), lambda x: F.length(x) > 3)))


def truncate(c: Column, most: int) -> Column:
    """Texts longer than ``most`` cut to ``most`` characters with a closing ellipsis of three dots."""
    if most < 3:
        raise ValueError("most must be at least 3")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(c) / 4).cast("long")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def cache_file(c: Column) -> Column:
    """File name of a cache key."""
    return F.concat(F.md5(c), F.lit(".cache"))


def chunk_id(document: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", document, index)


def random_id(prefix: str) -> Column:
    """``prefix`` and twelve random hex digits."""
    return F.concat(F.lit(prefix), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12))


def stable_id(prefix: str, *keys: Column) -> Column:
    """``prefix`` and twelve hex digits that depend on the keys only."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *keys), 256), 1, 12))


def occurrences(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of ``part``."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def batches(items: Column, size: int) -> Column:
    """An array cut into arrays of ``size``; the last may be shorter."""
    if size < 1:
        raise ValueError("size must be positive")
    n = F.size(items)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.slice(items, i + 1, size))).otherwise(F.expr("cast(array() as array<array<string>>)"))


def iso(c: Column) -> Column:
    """ISO 8601; the fraction is left out when it is zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


# What is wrong with a record that cannot be made.
def chunk_error(text: Column) -> Column:
    return F.when(blank(text), "Chunk text cannot be empty")


def document_error(text: Column) -> Column:
    return F.when(blank(text), "Document text content cannot be empty")


def request_error(query: Column) -> Column:
    return F.when(blank(query), "Query cannot be empty").when(F.length(strip(query)) < MIN_QUERY, "Query must be at least 3 characters")


def hundredths(c: Column) -> Column:
    """A number with two decimals as its exact binary value rounds (0.145 lies below the half and gives 0.14; ties go to the even digit)."""
    x = F.abs(c.cast("double"))
    high = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)  # the upper half of the digits, so that the products are exact
    p = x * F.lit(100.0)
    error = high * F.lit(100.0) - p + (x - high) * F.lit(100.0)
    whole = F.floor(p)
    rest = p - whole
    up = (rest > 0.5) | (rest == 0.5) & ((error > 0) | (error == 0) & (whole % 2 == 1))
    n = whole + F.when(up, 1).otherwise(0)
    shown = F.concat(F.when(c < 0, "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    return F.when(F.isnan(c) | (x == float("inf")) | (x >= 1e13), F.format_string("%.2f", c.cast("double"))).otherwise(shown)


def metric_text(operation: Column, duration_ms: Column) -> Column:
    """A metric in words: name and milliseconds with two decimals."""
    return F.concat(F.coalesce(operation, F.lit("None")), F.lit(": "), hundredths(duration_ms), F.lit("ms"))


def file_size_mb(size: Column) -> Column:
    """Megabytes (2^20) of a size in bytes."""
    return size / F.lit(1 << 20)
