"""Text functions over columns: tokens, names, paths, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[^\p{L}\p{N}]+"
LEAST_TOKEN = 2
TITLE_LENGTH = 120
IMAGE_LINE = r"^\s*!\[([^\]]*)\]\(([^)\s]+)\)\s*$"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, of two characters at least."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda x: F.length(x) >= LEAST_TOKEN)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_images(text: Column) -> Column:
    """The text without the lines that only hold a picture."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(IMAGE_LINE))
    return F.when(F.contains(text, F.lit("](")), F.array_join(lines, "\n")).otherwise(text)


def safe_name(name: Column) -> Column:
    """A file name without reserved or control characters, trailing dots or blanks, and of a bounded length."""
    clean = trimmed(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f\x7f]', "_"))
    short = F.substring(F.regexp_replace(clean, r"[. ]+$", ""), 1, TITLE_LENGTH)
    return F.when(short == "", "document").otherwise(short)


def safe_path(path: Column) -> Column:
    """A relative path inside its archive; null where it would leave it."""
    slashed = F.regexp_replace(path, r"\\", "/")
    parts = F.split(slashed, "/", -1)
    bad = F.contains(path, F.lit("\0")) | slashed.rlike(r"^[A-Za-z]:") | slashed.startswith("/") | F.array_contains(parts, "..")
    kept = F.filter(parts, lambda x: (x != "") & (x != "."))
    return F.when(~bad & (F.size(kept) > 0), F.array_join(kept, "/"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def entry_kind(path: Column) -> Column:
    e = extension(path)
    return (
        F.when(e == "pdf", "pdf")
        .when(e.isin("jpg", "jpeg", "png", "webp"), "image")
        .when(e.isin("txt", "md", "docx"), "text")
        .when(e.isin("zip", "rar", "7z", "tar", "gz"), "archive")
        .otherwise("other")
    )


def human_size(size: Column) -> Column:
    """Bytes as people read them: one decimal below ten."""
    value, unit = size / 1024.0, F.lit("KB")
    for above, name in ((2, "MB"), (3, "GB")):
        more = size >= 1024**above
        value, unit = F.when(more, size / 1024.0**above).otherwise(value), F.when(more, name).otherwise(unit)
    number = F.when(value >= 10, F.floor(value + 0.5).cast("string")).otherwise(F.format_string("%.1f", F.floor(value * 10 + 0.5) / 10))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(number, F.lit(" "), unit))


def first_question_title(text: Column) -> Column:
    """A question on one line, cut to 60 characters."""
    flat = trimmed(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= 60, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, 59)), F.lit("…")))


def normal_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, of 1 to 32 characters, first occurrence only."""
    clean = F.transform(tags, lambda t: F.lower(trimmed(t)))
    return F.array_distinct(F.filter(clean, lambda t: (F.length(t) > 0) & (F.length(t) <= 32)))


def entry_title(name: Column) -> Column:
    """A file's name without its extension."""
    stem = trimmed(F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name))
    return F.when(stem == "", name).otherwise(stem)


_NUMBERS = "no one two three four five six seven eight nine ten".split()


def number_word(n: Column) -> Column:
    """A number in words up to ten, in digits above."""
    return F.when(n.between(0, 10), F.get(F.array(*map(F.lit, _NUMBERS)), n.cast("int"))).otherwise(n.cast("string"))


def counted(n: Column, singular: str, plural: str) -> Column:
    return F.concat(number_word(n), F.lit(" "), F.when(n == 1, singular).otherwise(plural))


def listed(items: Column) -> Column:
    """A, B and C; blank items are left out."""
    kept = F.filter(items, lambda x: trimmed(x) != "")
    n = F.size(kept)
    return F.when(n <= 1, F.array_join(kept, "")).otherwise(F.concat(F.array_join(F.slice(kept, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(kept, n - 1)))


#: characters that full upper case writes as several, and the one that stands for each: its title case, or itself
_ONE_UPPER = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1} | {"ß": "ẞ"}


def capitalised(text: Column) -> Column:
    """The first character in upper case, always as one character."""
    first = F.left(text, F.lit(1))
    upper = F.when(first.isin(*_ONE_UPPER), F.translate(first, "".join(_ONE_UPPER), "".join(_ONE_UPPER.values()))).otherwise(F.upper(first))
    return F.concat(upper, F.substring(text, 2, 1 << 30))


def without_stop(text: Column) -> Column:
    """Trimmed, and without one full stop at the end."""
    return F.regexp_replace(trimmed(text), r"\.$", "")


def without_marks(text: Column) -> Column:
    """The text with blanks for the two control characters that mark matches in it, so that no place moves."""
    return F.translate(text, "\u0001\u0002", "  ")


#: lengths are summed in parts of so many, so that the offsets of many pieces cost little more than their number
PART = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts_of(lengths: Column) -> Column:
    """Where each of some pieces begins, by their lengths: sums of parts, and within parts."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)

    def within(ls: Column) -> Column:
        part = lambda i: F.floor(i / PART).cast("int")
        sums = F.transform(F.sequence(F.lit(0), part(F.size(ls) - 1)), lambda k: total(F.slice(ls, k * PART + 1, F.lit(PART))))
        before = lambda ss: F.transform(F.sequence(F.lit(0), F.size(ss) - 1), lambda k: total(F.slice(ss, F.lit(1), k)))
        each = lambda bs: F.transform(ls, lambda x, i: F.get(bs, part(i)) + total(F.slice(ls, part(i) * PART + 1, i % PART)))
        return let(let(sums, before), each)

    return let(lengths, lambda ls: F.when(F.size(ls) > 0, within(ls)).otherwise(F.array().cast("array<int>")))


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def offsets(pieces: str) -> str:
    """SQL of an array: where each string of a column of arrays begins in their concatenation."""
    total = lambda array: f"aggregate({array}, 0, (n, x) -> n + x)"
    sums = f"transform(sequence(0, (size(lengths) - 1) div {PART}), k -> {total(f'slice(lengths, k * {PART} + 1, {PART})')})"
    starts = f"transform(sequence(0, size(sums) - 1), k -> {total('slice(sums, 1, k)')})"
    each = f"transform(lengths, (y, i) -> starts[cast(i div {PART} as int)] + {total(f'slice(lengths, cast(i div {PART} as int) * {PART} + 1, i % {PART})')})"
    return _let(f"transform({pieces}, p -> length(p))", "lengths", _let(sums, "sums", _let(starts, "starts", each)))
