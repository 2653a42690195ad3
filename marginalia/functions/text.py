"""Normalizers, keys, query builders and fingerprints as Spark expressions.

White space is what Python's str.split knows: Unicode white space and the four ASCII separators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space for Java patterns with (?U).
WS = r"[\s\x1c-\x1f]"
#: Words without weight in search queries.
STOPWORDS = "a an and are as at be by for from in into is it its of on or our that the their this to we with".split()
UNIT = "\x1f"
MARKER = "[CITATION]"


def spaces(x: Column) -> Column:
    """Runs of white space become one space; trimmed."""
    # a single space is no match: it is one already
    return F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+", " "))


def compare_text(x: Column) -> Column:
    return spaces(F.regexp_replace(F.lower(x), rf"(?U)[^a-z0-9\s\x1c-\x1f]", " "))


def title_key(x: Column) -> Column:
    """Lower case, everything but a-z and 0-9 one space; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def text_key(x: Column) -> Column:
    return F.lower(spaces(x))


def trimmed(x: Column) -> Column:
    """As spaces, null as empty, case kept."""
    return spaces(F.coalesce(x, F.lit("")))


def slug(x: Column) -> Column:
    s = F.substring(F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))), 1, 80)
    return F.when(s == "", F.lit("paper")).otherwise(s)


def body_text(x: Column) -> Column:
    """Hyphens at line ends are closed, lines joined."""
    return spaces(F.replace(F.replace(x, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" ")))


def sentences(x: Column) -> Column:
    """Array of sentences: a break stands after . ! ? before an upper-case letter, a digit, a quote or a bracket; `et al.`, in any case
    and as words of its own, does not end one."""
    guard = "<prd>"
    # what few places have is looked for first: the letters, then the word's start; white space, then the mark before it
    kept = F.regexp_replace(x, r"(?iU)(?=et al\.)\b(et al)\.", f"$1{guard}")
    parts = F.split(kept, rf"""(?U){WS}(?<=[.!?]{WS}){WS}*(?=[A-Z0-9"'(\[])""")
    return F.filter(F.transform(parts, lambda s: spaces(F.replace(s, F.lit(guard), F.lit(".")))), lambda s: s != "")


def word_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(rf"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def has_passage_length(x: Column, low: int = 8, high: int = 80) -> Column:
    return word_count(x).between(low, high)


def spaced_word_count(x: Column) -> Column:
    """word_count of a text, not empty, that `spaces` has made."""
    return F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1


def is_suspicious_reference(x: Column) -> Column:
    return (F.char_length(x) > 2000) | (word_count(x) > 320)


def query_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body reads it: higher-order functions do not share what they compute."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_query(x: Column, marker: str = MARKER, width: int = 6) -> Column:
    """The last content tokens before the marker and the first after it; null below three."""
    at = F.locate(marker, x)

    def query(before: Column, after: Column) -> Column:
        got = F.concat(F.slice(before, F.greatest(F.size(before) - width + 1, F.lit(1)), F.lit(width)), F.slice(after, 1, width))
        return F.when((at > 0) & (F.size(got) >= 3), F.array_join(got, " "))

    before = content_tokens(query_tokens(F.substring(x, F.lit(1), F.greatest(at - 1, F.lit(0)))))
    after = content_tokens(query_tokens(F.substring(x, at + len(marker), F.char_length(x))))
    return let(before, lambda b: let(after, lambda a: query(b, a)))


def discoverability_queries(excerpt: Column) -> Column:
    """Ordered distinct queries: the first 14 tokens (if 4), the first 8 content tokens (if 3), and those around the marker."""

    def queries(tokens: Column, content: Column, around: Column) -> Column:
        first = F.when(F.size(tokens) >= 4, F.array_join(F.slice(tokens, 1, 14), " "))
        meant = F.when(F.size(content) >= 3, F.array_join(F.slice(content, 1, 8), " "))
        return F.array_distinct(F.array_compact(F.array(first, meant, around)))

    bare = lambda e: query_tokens(F.replace(e, F.lit(MARKER), F.lit(" ")))
    return let(excerpt, lambda e: let(bare(e), lambda t: let(content_tokens(t), lambda c: queries(t, c, window_query(e)))))


def bounded(x: Column, limit: int = 16_000, notice: str = "\n[truncated]") -> Column:
    return F.when(F.char_length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit(notice))).otherwise(x)


def sentences_with(x: Column, needle: Column) -> Column:
    return F.filter(F.split(x, rf"(?U)(?<=[.!?]){WS}+"), lambda s: F.contains(F.lower(s), F.lower(needle)))


def compact_query(x: Column, max_chars: int = 180, max_tokens: int = 24) -> Column:
    """Tokens joined by spaces while both limits hold; a first token that is too long is cut."""
    tokens = F.slice(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9][A-Za-z0-9'\-]*"), F.lit(0)), 1, max_tokens)
    fits = F.aggregate(
        tokens,
        F.struct(F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda a, t: F.when(a["full"], a)
        .when(a["text"] == "", F.struct(F.substring(t, 1, max_chars).alias("text"), (F.char_length(t) >= max_chars).alias("full")))
        .when(F.char_length(a["text"]) + 1 + F.char_length(t) <= max_chars, F.struct(F.concat(a["text"], F.lit(" "), t).alias("text"), F.lit(False).alias("full")))
        .otherwise(F.struct(a["text"].alias("text"), F.lit(True).alias("full"))),
    )["text"]
    return F.when(fits != "", fits)


def title_guess(reference: Column) -> Column:
    """A quoted run of 12 characters or more; else the first plausible segment between full stops, the first segment last."""
    straight, curly = F.regexp_extract(reference, r'"([^"]{12,})"', 1), F.regexp_extract(reference, "“([^”]{12,})”", 1)
    parts = F.split(reference, rf"(?U)\.{WS}+")
    order = F.concat(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1))
    plausible = F.filter(F.transform(order, spaces), lambda s: word_count(s).between(4, 24) & ~F.rlike(s, F.lit(r"\d{4}")))
    return F.coalesce(F.nullif(spaces(straight), F.lit("")), F.nullif(spaces(curly), F.lit("")), F.get(plausible, F.lit(0)))


def author_query(reference: Column) -> Column:
    year = F.regexp_instr(reference, F.lit(r"(?i)\b(?:19|20)\d{2}[a-z]?\b"))
    return F.when(year > 1, compact_query(F.substring(reference, F.lit(1), year - 1), 120, 16))


def resolution_queries(reference: Column) -> Column:
    whole = F.when(~is_suspicious_reference(reference), compact_query(reference))
    return F.array_distinct(F.array_compact(F.array(compact_query(title_guess(reference)), author_query(reference), whole)))


def fingerprint(x: Column) -> Column:
    return F.sha2(spaces(x), 256)


def stable_score(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def release_id(url: Column, row_id: Column) -> Column:
    return F.left(F.sha2(F.concat(url, F.lit("|"), row_id.cast("string")), 256), F.lit(20))


def source_key(url: Column, year: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(year.cast("string"), F.lit("::"), title))


def candidate_key(excerpt: Column, source: Column, target: Column) -> Column:
    return F.struct(text_key(excerpt).alias("excerpt_key"), title_key(source).alias("source_key"), title_key(target).alias("target_key"))


def without_guess_prefix(x: Column) -> Column:
    """Drops a lead such as `based on ...:`, `my guess ...:` or `most likely:` before an answer."""
    return F.trim(F.regexp_replace(x, r"(?i)^\s*[^:]*\b(?:based on|guess|most likely)\b[^:]*:\s*", ""))


def without_nul(x: Column) -> Column:
    return F.replace(x, F.lit("\x00"), F.lit(""))


def token_count(x: Column, tokens: Callable[[Column], Column] | None = None) -> Column:
    """Length of the array that `tokens` gives; by default words and single punctuation marks, the offline stand-in for a model's tokenizer."""
    return F.size(tokens(x) if tokens else F.regexp_extract_all(x, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def utc_now() -> Column:
    """The time at which a query starts, in ISO form and UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def paper_line(paper: Column, abstract_limit: int = 1000) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- Paper ID: "), paper["paperId"]),
        F.concat(F.lit("  Title: "), paper["title"]),
        F.concat(F.lit("  Abstract: "), F.substring(F.coalesce(paper["abstract"], F.lit("")), 1, abstract_limit)),
        F.concat(F.lit("  Citation Count: "), F.coalesce(paper["citationCount"], F.lit(0)).cast("string")),
    )
