"""Format-preserving pseudonyms for personal data; DataFrame functions only.

Card numbers that pass the check digit, phone numbers, social security numbers, IBANs, network
addresses and dates are validated and then permuted within their own format by a keyed Feistel
network, so equal values get equal pseudonyms in all documents and the key holder can undo them.
Mail addresses and secrets get keyed hash names of the same shape. Everything else stays byte for
byte: a text is cut at the matches of one pattern, and only valid matches are replaced. A run of digit
groups that is no card as a whole is read group by group: from the left, the longest valid card, phone
number, social security number or date that starts and ends with a group.

A network over ``m`` digits works on two halves of ``m // 2`` and the rest; dates permute the day
number within a fixed range of years by walking the cycle until it lies in the range again, and
addresses their 32 bits. Null texts stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .columns import restored, shielded

KEY_SETTING = "spark.evenmatch.pseudonym.key"  # where the session keeps the secret key
KEY = "pseudonym-key-1"  # only where the session has none, as in tests: whoever knows the key can undo the pseudonyms
ROUNDS = 8
CHUNK = 256  # groups of a run that are read together, so that long runs are joined in pieces

GLUE = r"(?:[A-Za-z_@]|-(?![ \-]*+\d)|\.\d|/\d{2}/\d{4}|[.%+][\w.%+\-]{0,80}@)"
# Every match starts where no letter or digit stands before it; groups are not captured.
PATTERNS = {
    "secret": r"(?i:token|secret|api[_-]?key|password|passwd)[\"']?\s{0,3}[=:]\s{0,3}[\"'][A-Za-z0-9+/_\-.]{16,}[\"']",
    "email": r"(?<![._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.){1,126}[A-Za-z]{2,}",
    "date": r"(?<![/.\-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?:(?=T\d{2})|(?![\w/\-]|\.\d))",
    "ssn": r"(?<![.\-])\d{3}-\d{2}-\d{4}(?![\w\-]|\.\d)",
    "address": r"(?<!\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    # a whole run of digit groups, up to the first that is glued to other text; taken without backtracking, so that a long run is read once
    "card": rf"(?<![.\-])(?=\d[\d \-]{{12}})\d++(?!{GLUE})(?:[ \-]++\d++(?!{GLUE}))*+",
    "phone": r"(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?![\w\-]|\.\d)|\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}(?![\w\-]|\.\d)|\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-]|\.\d)|[2-9]\d{2} [2-9]\d{2}[ \-]\d{4}(?![\w\-]|\.\d)|\+[1-9]\d{7,14}(?![\w\-]|\.\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
}
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(PATTERNS.values()) + ")"
FIRST_DAY, DAYS, SIDE = "1900-01-01", 73049, 271  # days of 1900 to 2099, permuted as numbers below 271 * 271
DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")


def _draw(key: str, tweak: Column, no: Column, half: Column) -> Column:
    """A number below 2^52 that depends on all of these."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, no.cast("string"), half.cast("string")), 256), 1, 13), 16, 10).cast("long")


def feistel(a: Column, b: Column, low: Column, high: Column, tweak: Column, key: str) -> Column:
    """Keyed permutation of the pairs ``a`` below ``low``, ``b`` below ``high``, as a struct.

    Odd rounds shift ``b`` by a draw from ``a``, even ones ``a`` by a draw from ``b``; each can be undone.
    """

    def step(s: Column, no: Column) -> Column:
        odd = no % 2 == 1
        return F.struct(
            F.when(odd, s["a"]).otherwise(F.pmod(s["a"] + _draw(key, tweak, no, s["b"]), low)).cast("long").alias("a"),
            F.when(odd, F.pmod(s["b"] + _draw(key, tweak, no, s["a"]), high)).otherwise(s["b"]).cast("long").alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """Digits of the same number, from a permutation of all numbers of that length (up to 36 digits)."""
    left = F.floor(F.length(digits) / 2).cast("int")
    right = F.length(digits) - left
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    half = lambda at, n: F.coalesce(F.substring(digits, at, n).try_cast("long"), F.lit(0).cast("long"))
    out = feistel(half(F.lit(1), left), half(left + 1, right), power(left), power(right), F.concat(F.lit(kind), F.length(digits).cast("string")), key)
    return F.concat(F.lpad(out["a"].cast("string"), left, "0"), F.lpad(out["b"].cast("string"), right, "0"))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _put_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.between("0", "9"), F.substring(digits, F.length(only_digits(F.substring(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _luhn(digits: Column, last_counts: bool) -> Column:
    """Check sum by ten; the rightmost digit is the check digit, or the one before it."""
    shift = 0 if last_counts else 1
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    worth = F.transform(chars, lambda c, i: F.when((i + shift) % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(worth, F.lit(0), lambda x, y: x + y) % 10


def _card(m: Column, key: str) -> Column:
    digits = only_digits(m)
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
    check = ((F.lit(10) - _luhn(body, False)) % 10).cast("string")
    shape = m.rlike(r"^\d(?:[ \-]?\d){12,18}$")
    return F.when(shape, F.when(_luhn(digits, True) == 0, _put_digits(m, F.concat(body, check))))


def _tail(m: Column, kind: str, keep: Column, key: str) -> Column:
    """All digits after the first ``keep`` permuted."""
    digits = only_digits(m)
    return _put_digits(m, F.concat(F.substring(digits, F.lit(1), keep), permuted_digits(F.substring(digits, keep + 1, F.length(digits) - keep), kind, key)))


def _phone(m: Column, key: str) -> Column:
    n = F.length(only_digits(m))
    # where no separator ends the country code, one digit or two stay
    country = F.length(F.regexp_extract(m, r"^\+([17](?=\d{7,14}$)|\d{2}(?=\d{6,13}$)|\d{1,3})", 1))
    return F.when(n.between(8, 15), _tail(m, "phone", country, key))


def _ssn(m: Column, key: str) -> Column:
    return F.when(~m.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$"), _tail(m, "ssn", F.lit(0), key))


def _mod97(text: Column) -> Column:
    """Number of the characters (letters count 10 to 35) modulo 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    body = F.substring(plain, F.lit(5), F.length(plain) - 4)
    digits = only_digits(body)
    new = _put_digits(body, permuted_digits(digits, "iban", key))
    check = F.lpad((F.lit(98) - _mod97(F.concat(new, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    good = (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34) & (F.length(digits) > 1)
    return F.when(good, _put_digits(m, F.concat(check, only_digits(new))))


def _address(m: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    good = (part(1) < 256) & (part(2) < 256) & (part(3) < 256) & (part(4) < 256)
    out = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), F.lit("address"), key)
    name = lambda s: F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)
    return F.when(good, F.element_at(F.transform(F.array(out), name), 1))


def _date(m: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for form in reversed(DATES):
        shape = "^" + form.replace("yyyy", r"\d{4}").replace("MM", r"\d{2}").replace("dd", r"\d{2}").replace(".", r"\.") + "$"
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY))
        once = lambda s, _: F.when(s < DAYS, s).otherwise(_shift_day(s, key))
        moved = F.aggregate(F.sequence(F.lit(1), F.lit(16)), _shift_day(day, key), once)
        out = F.when(m.rlike(shape) & day.between(0, DAYS - 1), F.date_format(F.date_add(F.to_date(F.lit(FIRST_DAY)), moved.cast("int")), form)).otherwise(out)
    return out


def _shift_day(day: Column, key: str) -> Column:
    s = feistel(F.floor(day / SIDE), day % SIDE, F.lit(SIDE), F.lit(SIDE), F.lit("date"), key)
    return (s["a"] * SIDE + s["b"]).cast("long")


def _hex(text: Column, kind: str, n: Column, key: str) -> Column:
    """Keyed hex name of ``n`` characters."""
    one = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), text), 256)
    return F.substring(F.repeat(one, F.ceil(n / 64).cast("int")), F.lit(1), n)


def _email(m: Column, key: str) -> Column:
    name, host = F.substring_index(F.lower(m), "@", 1), F.substring_index(F.lower(m), "@", -1)
    return F.concat(F.lit("u"), _hex(F.concat(name, F.lit("@"), host), "mail", F.lit(12), key), F.lit("@"), F.lit("h"), _hex(host, "host", F.lit(8), key), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[\"']([A-Za-z0-9+/_\-.]+)[\"']$", 1)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value) - 1), _hex(value, "secret", F.length(value), key), F.substring(m, F.length(m), F.lit(1)))


_MAKERS = {"secret": _secret, "email": _email, "date": _date, "ssn": _ssn, "address": _address, "card": _card, "phone": _phone, "iban": _iban}


def pseudonym(match: Column, key: str = KEY) -> Column:
    """The pseudonym of one match of ``ANY`` as a whole; null where the match is not valid."""
    return _first_valid(match, list(PATTERNS), key)


def _first_valid(match: Column, kinds: list[str], key: str) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(kinds):
        out = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), _MAKERS[kind](match, key)).otherwise(out)
    return out


def _groups(match: Column, key: str) -> Column:
    """``text, n`` of a run of digit groups, its valid parts replaced."""

    def walk(s: Column) -> Column:
        count = F.size(s["digits"])

        def reading(i: Column, j: Column) -> Column:
            text = F.concat(F.get(s["digits"], i), F.array_join(F.slice(s["parts"], i + 2, j - i), ""))
            alone = (F.get(s["gaps"], i) != "-") & (F.get(s["gaps"], j + 1) != "-")
            new = F.coalesce(_card(text, key), F.when(alone, _first_valid(text, ["date", "ssn", "phone"], key)))
            return F.when(F.length(only_digits(text)).between(8, 19), new)

        def step(x: Column, i: Column) -> Column:
            ends = F.sequence(F.least(i + 18, count - 1), i, F.lit(-1))
            found = F.filter(F.transform(ends, lambda j: F.struct(j.alias("j"), reading(i, j).alias("new"))), lambda r: r["new"].isNotNull())
            kept = F.struct(F.array_append(x["out"], F.get(s["parts"], i)).alias("out"), x["n"].alias("n"), (i + 1).alias("next"))
            put = lambda r: F.struct(F.array_append(x["out"], F.concat(F.get(s["gaps"], i), r["new"])).alias("out"), (x["n"] + 1).alias("n"), (r["j"] + 1).alias("next"))
            return F.when(i < x["next"], x).otherwise(F.coalesce(F.get(F.transform(F.slice(found, 1, 1), put), F.lit(0)), kept))

        start = lambda n, to: F.struct(F.array().cast("array<string>").alias("out"), n.alias("n"), to.alias("next"))

        def chunk(x: Column, c: Column) -> Column:
            places = F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, count) - 1)
            done = lambda y: F.struct(F.array_append(x["out"], F.array_join(y["out"], "")).alias("out"), y["n"].alias("n"), y["next"].alias("next"))
            return F.aggregate(places, start(x["n"], x["next"]), step, done)

        chunks = F.sequence(F.lit(0), F.floor((count - 1) / CHUNK).cast("int"))
        return F.aggregate(chunks, start(F.lit(0), F.lit(0)), chunk, lambda x: F.struct(F.array_join(x["out"], "").alias("text"), x["n"].alias("n")))

    digits, gaps = F.regexp_extract_all(match, F.lit(r"\d+"), F.lit(0)), F.split(match, r"\d+", -1)
    parts = F.zip_with(F.slice(gaps, F.lit(1), F.size(digits)), digits, lambda g, d: F.concat(g, d))
    return F.get(F.transform(F.array(F.struct(digits.alias("digits"), gaps.alias("gaps"), parts.alias("parts"))), walk), F.lit(0))


def replaced(match: Column, key: str = KEY) -> Column:
    """``text, n``: a match of ``ANY`` with its pseudonyms, and their number."""
    whole = lambda s: F.when(s["new"].isNotNull(), F.struct(s["new"].alias("text"), F.lit(1).alias("n"))).when(match.rlike(r"^\d[\d \-]*\d$"), _groups(match, key)).otherwise(F.struct(match.alias("text"), F.lit(0).alias("n")))
    return F.get(F.transform(F.array(F.struct(pseudonym(match, key).alias("new"))), whole), F.lit(0))


def session_key(spark: SparkSession) -> str:
    """The secret key of this session."""
    return spark.conf.get(KEY_SETTING, KEY)


def pseudonymised(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with rewritten ``text_col`` and one more column, ``n_pii``: the values replaced.

    The key is that of the session unless one is given. Other columns may have any name; one named
    ``n_pii`` is replaced.
    """
    return restored(_rewritten(shielded(docs, (text_col,)), key, text_col), docs, (text_col,), ("n_pii",))


def rewritten(docs: DataFrame, key: str | None = None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with rewritten ``text_col``, all other columns as they are; ``size_col``, if there is one, is counted again where the text changed."""
    needed = [c for c in (text_col, size_col) if c in docs.columns]
    out = _rewritten(shielded(docs, needed), key, text_col)
    if size_col in needed:
        out = out.withColumn(size_col, F.when(F.col("n_pii") > 0, F.char_length(text_col)).otherwise(F.col(size_col)).cast(docs.schema[size_col].dataType))
    return restored(out, docs, needed)


def _rewritten(docs: DataFrame, key: str | None, text_col: str) -> DataFrame:
    key = session_key(docs.sparkSession) if key is None else key
    text = F.col(text_col)
    found = docs.withColumn("_found", F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found = found.withColumn("_new", F.transform("_found", lambda m: replaced(m, key)))
    pieces = F.zip_with(F.split(text, ANY, -1), "_new", lambda p, m: F.concat(p, F.coalesce(m["text"], F.lit(""))))
    n = F.coalesce(F.aggregate("_new", F.lit(0), lambda a, m: a + m["n"]), F.lit(0)).cast("long")
    new_text = F.when(F.size("_found") > 0, F.array_join(pieces, "")).otherwise(text)
    return found.select(*[(new_text.alias(c) if c == text_col else F.col(c)) for c in docs.columns], n.alias("n_pii"))
