"""Text column expressions. All of them run inside the JVM; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace-separated words, with the Unicode notion of whitespace.
WORD = r"[^\s\p{Z}\x0B\x1C-\x1F\x85]+"
# Lower-case search tokens that keep "c++" and "c#" whole.
TOKEN = r"[a-z0-9][a-z0-9+#]*"
# Pieces that restore the text when joined: whitespace runs, word runs, single other characters.
PIECE = r"\s+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Words and single punctuation characters, no whitespace.
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def find_all(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def let(value: Column, body) -> Column:
    """Bind an array or struct expression to a name, so that ``body`` can use it many times but it is evaluated once.

    Inside a lambda Spark has no common-subexpression elimination, and pushed filters inline the
    columns they use; a bound value is safe from both.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows(col: Column | str) -> Column:
    """Explode a derived array. Exploding the plain column would push ``size(col) > 0`` down and compute it twice."""
    return F.explode(F.transform(col, lambda x: x))


def n_words(col: Column) -> Column:
    return F.size(find_all(col, WORD)).cast("bigint")


def search_tokens(col: Column, stop_words=()) -> Column:
    """Lower-case tokens as an array, without the given stop words."""
    toks = find_all(F.lower(col), TOKEN)
    if not stop_words:
        return toks
    stops = sorted(stop_words)
    return F.filter(toks, lambda t: ~t.isin(stops))


def squash(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def normalize_title(col: Column) -> Column:
    """Lower-case, one kind of dash, separators to spaces, single spaces."""
    c = F.regexp_replace(F.lower(col), "[‐-―]", "-")
    return squash(F.regexp_replace(c, r"[/|,;:()\[\]]", " "))


def match_case(source: Column, target: Column) -> Column:
    """Give ``target`` the capitalisation of ``source`` (UPPER, Title or lower)."""
    s1, t1 = F.substring(source, 1, 1), F.substring(target, 1, 1)
    tail = target.substr(F.lit(2), F.greatest(F.length(target), F.lit(1)))
    is_upper = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    return (
        F.when(F.length(source) == 0, target)
        .when(is_upper(source) & (F.length(source) > 1), F.upper(target))
        .when(is_upper(s1), F.concat(F.upper(t1), tail))
        .when(is_upper(t1) & ~is_upper(target), F.concat(F.lower(t1), tail))
        .otherwise(target)
    )


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def layout_to_sentences(col: Column) -> Column:
    """End every non-empty layout line with a full stop; single-line text is left as it is."""
    lines = F.transform(
        F.split(col, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"),
        lambda x: strip(F.regexp_replace(x, r"^[\s\u2022\u25aa\u25cf\u2013\u2014*\-\u00b7]+", "")),
    )
    closed = F.transform(
        F.filter(lines, lambda x: F.length(x) > 0),
        lambda x: F.when(F.substring(x, -1, 1).isin(".", "!", "?", ":", ";", ","), x).otherwise(F.concat(x, F.lit("."))),
    )
    return F.when(F.instr(col, "\n") == 0, col).otherwise(F.array_join(closed, "\n"))


def parse_fit_score(col: Column) -> Column:
    """First number in 0..100, preferring 'score: N', then 'N/100' or 'N out of 100', then bare."""

    def first_in_range(pattern: str) -> Column:
        nums = F.transform(
            F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), F.lit(1)), lambda x: x.cast("double")
        )
        return F.get(F.filter(nums, lambda x: (x >= 0) & (x <= 100)), F.lit(0))

    return F.coalesce(
        first_in_range(r"(?i)\bscore\s*[:=]?\s*([0-9]{1,3}(?:\.[0-9]+)?)"),
        first_in_range(r"([0-9]{1,3}(?:\.[0-9]+)?)\s*(?:/\s*100|out of 100)"),
        first_in_range(r"(?<![0-9.])([0-9]{1,3}(?:\.[0-9]+)?)(?![0-9.])"),
    )


def light_stems(tokens: Column) -> Column:
    """Light suffix stripper over an array of tokens, used on both sides of dictionary matching.

    Tokens of three letters or fewer stay. Then "ies" -> "y"; "ing" or "ed" goes when three letters
    remain; a final "s" (not "ss") goes; and a final "e" goes when more than three letters are left.
    Each step is its own pass, so no step repeats the work of the one before.
    """
    cut = lambda x, k: F.substring(x, 1, F.length(x) - k)
    n = F.length
    t = F.transform(tokens, F.lower)
    t = F.transform(t, lambda x: F.when((n(x) > 3) & x.endswith("ies"), F.concat(cut(x, 3), F.lit("y"))).otherwise(x))
    t = F.transform(t, lambda x: F.when((n(x) >= 6) & x.endswith("ing"), cut(x, 3)).when((n(x) >= 5) & x.endswith("ed"), cut(x, 2)).otherwise(x))
    t = F.transform(t, lambda x: F.when((n(x) > 3) & x.endswith("s") & ~x.endswith("ss"), cut(x, 1)).otherwise(x))
    return F.transform(t, lambda x: F.when((n(x) > 3) & x.endswith("e"), cut(x, 1)).otherwise(x))


def order_hash(seed, *cols) -> Column:
    """Hex sha-256 of ``seed|col|col``: the seeded order used for every draw."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]), 256)


def hash_number(hash_col: Column) -> Column:
    """First 12 hex digits of a hash as a bigint."""
    return F.conv(F.substring(hash_col, 1, 12), 16, 10).cast("bigint")
