"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and provision marks of the retrieval tokeniser. Fixed values.
WORDS = r"[가-힣]+|[一-龥]+|[A-Za-z]+|[0-9]+"
ARTICLES = r"제\d+조(?:의\d+)?(?:제\d+항)?"
#: National id, phone and account shapes, masked in this order. Fixed values.
RESIDENT = r"(?<!\d)(\d{6})[-\s]?([1-8])\d{6}(?!\d)"
PHONE = r"(?<!\d)(01[016789]|0\d{1,2})[-\s]?(\d{3,4})[-\s]?(\d{4})(?!\d)"
ACCOUNT = r"(?<!\d)(\d{2,6})[-\s](\d{2,6})[-\s](\d{4,8})(?!\d)"


def tokenize(text: Column, ngram: int = 2) -> Column:
    """Provision marks, words, and the inner character n-grams of words longer than n, in text order."""
    words = F.regexp_extract_all(text, F.lit(f"({WORDS})"), 1)
    grams = F.transform(
        words,
        lambda w: F.concat(
            F.array(w),
            F.when(F.length(w) > ngram, F.transform(F.sequence(F.lit(1), F.length(w) - ngram + 1), lambda i: F.substring(w, i, F.lit(ngram)))).otherwise(F.array().cast("array<string>")),
        ),
    )
    marks = F.transform(F.regexp_extract_all(text, F.lit(f"({ARTICLES})"), 1), lambda a: F.concat(F.lit("§"), a))
    return F.coalesce(F.concat(marks, F.flatten(grams)), F.array().cast("array<string>"))


def mask_sensitive(text: Column) -> Column:
    """Mask national ids, phone numbers and account numbers, in this order."""
    out = F.regexp_replace(text, RESIDENT, "$1-$2******")
    out = F.regexp_replace(out, PHONE, "$1-****-$3")
    return F.regexp_replace(out, ACCOUNT, "****-****-****")


def squeeze(text: Column) -> Column:
    """White space runs (no-break spaces too) to one space, trimmed."""
    return F.trim(F.regexp_replace(text, "[\\s ]+", " "))


def clean_markup(text: Column) -> Column:
    """Tags out, then white space squeezed."""
    return squeeze(F.regexp_replace(text, r"<[^>]+>", " "))


#: Named character references of the html line splitter. Fixed values.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def html_lines(html: Column) -> Column:
    """Scripts and styles out, line and block ends to new lines, tags out, references decoded; non-blank trimmed lines."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h1|h2|h3|h4|h5|h6)>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, mark in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(mark))
    lines = F.transform(F.split(out, "\n"), squeeze)
    return F.filter(lines, lambda x: x != "")


def alnum(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, r"[^0-9A-Za-z가-힣]", ""))


def iso_day(text: Column) -> Column:
    """The first eight digits as a day, without a calendar check; empty if there are fewer."""
    digits = F.substring(F.regexp_replace(text, r"\D", ""), 1, 8)
    return F.when(F.length(digits) == 8, F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))).otherwise("")


def token_estimate(text: Column) -> Column:
    """Half the length, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2)).cast("long")


def notice_body(lines: Column, start: str, ends: list[str], date_mark: str, noise: list[str], most: int = 400) -> Column:
    """Struct of ``body`` and ``published``: the lines from the first with ``start`` to before the first later one with an end mark.

    At most ``most`` lines are taken, and the start's own line never ends them.
    The date (year, month and day in digits) stands in the first line with
    ``date_mark`` or in the next. Lines of up to three characters and those with
    a word of ``noise`` go. Without a start both are empty.
    """
    has = lambda words: lambda line: F.reduce(F.array(*[F.contains(line, F.lit(w)) for w in words]), F.lit(False), lambda a, b: a | b)
    first = F.array_position(F.transform(lines, has([start])), True)
    taken = F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.lit(most))
    end = F.array_position(F.transform(taken, lambda line, k: (k > 0) & has(ends)(line)), True)
    body = F.when(end > 0, F.slice(taken, F.lit(1), (end - 1).cast("int"))).otherwise(taken)
    mark = F.array_position(F.transform(body, has([date_mark])), True)
    near = F.slice(body, F.greatest(mark, F.lit(1)).cast("int"), F.lit(2))
    pattern = r"(20\d{2})[.\-/\s]+(\d{1,2})[.\-/\s]+(\d{1,2})"
    dated = F.get(F.filter(near, lambda line: F.rlike(line, F.lit(pattern))), F.lit(0))
    part = lambda k, width: F.lpad(F.regexp_extract(dated, pattern, k), width, "0")
    published = F.when((mark > 0) & dated.isNotNull(), F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))).otherwise("")
    kept = F.array_join(F.filter(body, lambda line: (F.length(line) > 3) & ~has(noise)(line)), "\n")
    return F.struct(F.when(first > 0, kept).otherwise("").alias("body"), F.when(first > 0, published).otherwise("").alias("published"))
