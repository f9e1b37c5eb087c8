"""Text rules as Column expressions (TXT-01..07, 13; CLN-20; FLT-07)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import fixed

LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
BLANK = r"\s\x1c-\x1f\x85\p{Z}"
# The same white space as single characters, for trimming without a regex.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
    + "".join(chr(n) for n in range(0x2000, 0x200B))
)


def strip(c: Column) -> Column:
    """Trim every kind of white space on both ends."""
    return F.trim(c, F.lit(BLANK_CHARS))


def tokens(c: Column) -> Column:
    """TXT-01: lower-case words, and single CJK characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(fixed.TOKEN_PATTERN), F.lit(1))


def token_count(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit(fixed.TOKEN_PATTERN))


def json_text(c: Column) -> Column:
    """A string column as a quoted, escaped JSON string."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def stable_hash(fields: dict[str, Column | str], n: int = 16) -> Column:
    """CLN-14: leading hex of SHA-256 over sorted-key JSON.

    Values must already be JSON text: use json_text for strings.
    """
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        value = fields[key]
        parts.append(F.lit(("{" if i == 0 else ", ") + f'"{key}": '))
        parts.append(value if isinstance(value, Column) else F.lit(value))
    parts.append(F.lit("}"))
    return F.substring(F.sha2(F.concat(*parts), 256), 1, n)


def content_hash(c: Column, n: int = 32) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


# --- sections and sentences -------------------------------------------------


def sections(c: Column) -> Column:
    """TXT-02: array<struct<name, body>>; a heading line opens a section.

    Lines are trimmed, then one split before each heading line does the work, so
    the document stays in its row and nothing is shuffled.
    """
    lines = F.transform(F.split(c, LINE_BREAK), strip)
    pieces = F.split(F.array_join(lines, "\n"), r"(?m)^(?=#{1,3}[^\S\n]+\S)")
    head = r"\A#{1,3}[^\S\n]+\S[^\n]*"

    def section(piece: Column) -> Column:
        title = F.regexp_extract(piece, head, 0)
        body = F.regexp_replace(piece, head + r"\n?", "")
        return F.struct(
            F.when(title == "", F.lit("body"))
            .otherwise(F.substring(strip(F.regexp_replace(title, "^#+", "")), 1, 80))
            .alias("name"),
            F.regexp_replace(body, r"\n\z", "").alias("body"),
        )

    return F.filter(F.transform(pieces, section), lambda s: strip(s["body"]) != "")


def sentences(c: Column, min_chars: int = 20) -> Column:
    """TXT-03: split after closing punctuation plus space, or at newlines."""
    parts = F.split(c, rf"(?<=[。！？.!?])[{BLANK}]+|[\n\r]+")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) >= min_chars)


def headings(c: Column, limit: int = 20) -> Column:
    """TXT-13: numbered lines and all-capital lines, cut to 120 characters."""
    lines = F.transform(F.split(c, LINE_BREAK), strip)

    def is_heading(line: Column) -> Column:
        numbered = F.substring(line, 1, 1).rlike(r"\p{Nd}") & F.substring(line, 1, 6).contains(".")
        capitals = (F.upper(line) == line) & (F.lower(line) != line)
        return (line != "") & (numbered | capitals)

    kept = F.filter(lines, is_heading)
    return F.slice(F.transform(kept, lambda s: F.substring(s, 1, 120)), 1, limit)


def printable_ratio(c: Column) -> Column:
    """FLT-07: share of printable characters; tab and line breaks count."""
    printable = F.regexp_replace(c, r"[\p{C}\p{Z}&&[^ \n\r\t]]", "")
    return F.length(printable) / F.greatest(F.length(c), F.lit(1))


def quality_ok(c: Column, min_ratio: float = 0.7, min_chars: int = 50) -> Column:
    return (F.length(c) >= min_chars) & (printable_ratio(c) >= min_ratio)


def fallback_text(title: Column, abstract: Column) -> Column:
    """TXT-05: what stands in for a missing full text."""
    return F.concat(
        F.lit("# Abstract\n"), title, F.lit("\n"), abstract,
        F.lit(
            "\n\n# Evidence Notes\nFull text was not available. "
            "This materialization uses title and abstract as fallback evidence."
        ),
    )


# --- hash embeddings --------------------------------------------------------


def token_bucket(token: Column, dim: int = 64) -> Column:
    """TXT-06 bucket: the first 8 hex digits of SHA-256, modulo dim.

    Where dim divides 256 the last two of the eight digits decide alone.
    """
    at, n = (7, 2) if 256 % dim == 0 else (1, 8)
    return F.conv(F.substring(F.sha2(token, 256), at, n), 16, 10).cast("long") % dim


def bucket_array(c: Column, dim: int = 64) -> Column:
    return F.transform(tokens(c), lambda t: token_bucket(t, dim))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row for use inside lambdas of ``body``.

    A column named inside a lambda is evaluated for every element.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def counts_vector(buckets: Column, dim: int = 64) -> Column:
    """Bucket numbers to a dense count vector."""
    slots = F.sequence(F.lit(0), F.lit(dim - 1))
    return let(
        buckets,
        lambda bs: F.transform(slots, lambda i: F.size(F.filter(bs, lambda b: b == i)).cast("double")),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def l2_norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )


def unit(a: Column) -> Column:
    """Divide by the L2 norm; a zero vector stays zero."""
    return let(
        a,
        lambda v: let(
            F.nullif(l2_norm(v), F.lit(0.0)),
            lambda n: F.transform(v, lambda x: F.coalesce(x / n, x)),
        ),
    )


def digest_embedding(c: Column, dim: int = 64) -> Column:
    """TXT-07: SHA-256 bytes / 255, tiled to the wanted dimension."""
    slots = F.sequence(F.lit(0), F.lit(dim - 1))

    def byte(digest: Column, i: Column) -> Column:
        return F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")

    return let(
        F.sha2(c, 256), lambda h: F.transform(slots, lambda i: (byte(h, i) / 255.0).cast("float"))
    )


# --- question planning ------------------------------------------------------


def _kept_tokens(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in fixed.QUESTION_STOP_WORDS])
    return F.filter(
        tokens(c),
        lambda t: ~F.array_contains(stop, t)
        & ~t.rlike("^[一-鿿]$")
        & ((F.length(t) > 1) | t.rlike("^[0-9]$")),
    )


def tidy_query(c: Column) -> Column:
    no_quotes = F.regexp_replace(c, "[“”\"'`]+", " ")
    return F.substring(strip(F.regexp_replace(no_quotes, rf"[{BLANK}]+", " ")), 1, 240)


def keywords(question: Column) -> Column:
    """CLN-20: English phrase tokens first, then all tokens, distinct, first 12."""
    phrases = F.array_join(
        F.regexp_extract_all(question, F.lit(fixed.PHRASE_PATTERN), F.lit(1)), " "
    )
    found = F.slice(
        F.array_distinct(F.concat(_kept_tokens(phrases), _kept_tokens(question))), 1, 12
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(strip(question)))


def primary_query(words: Column) -> Column:
    return tidy_query(F.array_join(F.slice(words, 1, 6), " "))


def alternate_queries(words: Column) -> Column:
    first = F.when(F.size(words) > 3, tidy_query(F.array_join(F.slice(words, 1, 3), " ")))
    second = F.when(F.size(words) > 6, tidy_query(F.array_join(F.slice(words, 4, 6), " ")))
    return F.filter(
        F.array_distinct(F.array(first, second)),
        lambda q: q.isNotNull() & (q != "") & (q != primary_query(words)),
    )


# --- vector arithmetic --------------------------------------------------------

UNROLLED_DIM = 128  # up to here a dot product is plain generated code


def bucket_norm(buckets: Column) -> Column:
    """L2 norm of the count vector of a bucket list, without building it.

    Over the sorted buckets a run that grows from r to r + 1 adds 2r + 1.
    """
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sq"))

    def step(s: Column, b: Column) -> Column:
        run = F.when(s["b"] == b, s["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(b.alias("b"), (run + 1).alias("run"), (s["sq"] + 2 * run + 1).alias("sq"))

    return F.sqrt(F.aggregate(F.array_sort(buckets), start, step, lambda s: s["sq"].cast("double")))


def bucket_dot(buckets: Column, norm: Column, query: list[float]) -> Column:
    """Dot product of a unit count vector with a fixed query vector."""
    weights = F.array(*[F.lit(float(x)) for x in query])
    total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(weights, b.cast("int")))
    return F.coalesce(F.try_divide(total, norm), F.lit(0.0))


def fixed_dot(vector: Column, query: list[float]) -> Column:
    """Dot product with a fixed vector; unrolled so that it compiles to plain code."""
    if len(query) <= UNROLLED_DIM:
        out = F.lit(0.0)
        for i, q in enumerate(query):
            out = out + F.get(vector, F.lit(i)).cast("double") * float(q)
        return out
    return dot(vector, F.array(*[F.lit(float(q)) for q in query]))


def fixed_norm(vector: Column, dim: int) -> Column:
    if dim <= UNROLLED_DIM:
        out = F.lit(0.0)
        for i in range(dim):
            x = F.get(vector, F.lit(i)).cast("double")
            out = out + x * x
        return F.sqrt(out)
    return l2_norm(vector)
