"""Markup: lines as blocks, emphasis, tokens with their places, plain text with a map of offsets, pictures.

Everything is column expressions. A line is cut into its block marker, the marks ``**``, ``*`` and ``_``, and what stands
between them; a fold over these parts decides which marks are markers. Tokens, spans and plain text all come from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import IMAGE_LINE, let, starts_of, trimmed

_NUMBERED = r"^\s*(\d{1,3})[.)]\s+(.*)$"
#: what starts a line of each kind, and what is left of the line, in the order in which the kinds are tried
STARTS = {"heading": r"^(#{1,3})\s+", "numbered": r"^\s*(\d{1,3})[.)]\s+", "bullet": r"^\s*[-*•]\s+", "quote": r"^\s*>\s?"}
IMAGE_LABEL = "Image"
#: a text without any of these is its own plain text
MARKED = r"[*_]|(?m:^(?:#{1,3}\s|\s*\d{1,3}[.)]\s|\s*[-•]\s|\s*>|\s*!\[))"
#: kinds of lines, in the order of their numbers in a part's code
KINDS = ("paragraph", "heading1", "heading2", "heading3", "numbered", "bullet", "quote", "image")
#: a part's code: eight times its line's kind, and these
MARKER, BOLD, ITALIC = 4, 2, 1

_START = "|".join(f"(?:{p})" for p in STARTS.values())
_PARTS = r"\*\*|[*_]|[^*_]+"


def _kind(line: Column) -> Column:
    return (
        F.when(line.rlike(IMAGE_LINE), "image")
        .when(line.rlike(r"^#\s+"), "heading1")
        .when(line.rlike(r"^##\s+"), "heading2")
        .when(line.rlike(r"^###\s+"), "heading3")
        .when(line.rlike(_NUMBERED), "numbered")
        .when(line.rlike(STARTS["bullet"]), "bullet")
        .when(line.rlike(r"^\s*>"), "quote")
        .otherwise("paragraph")
    )


def blocks(pages: DataFrame) -> DataFrame:
    """One row for each line: doc_id, page_index, line_no, kind, number, image_name."""
    lines = pages.select("doc_id", "page_index", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    kind = _kind(F.col("line"))
    number = F.when(kind == "numbered", F.regexp_extract("line", _NUMBERED, 1).cast("int"))
    image = F.when(kind == "image", F.regexp_extract("line", IMAGE_LINE, 2))
    return lines.select("doc_id", "page_index", "line_no", kind.alias("kind"), number.alias("number"), image.alias("image_name"))


def image_names(text: Column) -> Column:
    """The pictures that a text refers to, in order, repeats kept."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(IMAGE_LINE))
    return F.transform(lines, lambda x: F.regexp_extract(x, IMAGE_LINE, 2))


def text_and_images(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, block_no, kind (text or image), value: text before, between and after pictures, empty ones too."""
    lines = F.split("text", "\n", -1)
    # a text block ends where a picture line stands: its number is that of the pictures before it
    start = F.struct(F.array(F.lit(None).cast("string")).alias("open"), F.array().cast("array<struct<kind:string,value:string>>").alias("done"))
    joined = lambda a: F.struct(F.lit("text").alias("kind"), F.coalesce(F.get(a["open"], F.lit(0)), F.lit("")).alias("value"))
    image = lambda x: F.struct(F.lit("image").alias("kind"), F.regexp_extract(x, IMAGE_LINE, 2).alias("value"))
    held = lambda a: F.get(a["open"], F.lit(0))

    def step(a, x):
        more = F.struct(F.array(F.when(held(a).isNull(), x).otherwise(F.concat(held(a), F.lit("\n"), x))).alias("open"), a["done"].alias("done"))
        cut = F.struct(F.array(F.lit(None).cast("string")).alias("open"), F.concat(a["done"], F.array(joined(a), image(x))).alias("done"))
        return F.when(x.rlike(IMAGE_LINE), cut).otherwise(more)

    every = F.aggregate(lines, start, step, lambda a: F.concat(a["done"], F.array(joined(a))))
    rows = pages.select("doc_id", "page_index", F.posexplode(every).alias("block_no", "b"))
    return rows.select("doc_id", "page_index", "block_no", "b.kind", "b.value")


def serialised(parts: DataFrame) -> DataFrame:
    """doc_id, page_index, text: the blocks of ``text_and_images`` as one text again; empty text blocks vanish."""
    line = F.when(F.col("kind") == "image", F.concat(F.lit(f"![{IMAGE_LABEL}]("), F.col("value"), F.lit(")"))).otherwise(F.col("value"))
    kept = parts.where("kind = 'image' or value <> ''").select("doc_id", "page_index", "block_no", line.alias("line"))
    whole = kept.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "line"))), lambda b: b["line"]), "\n").alias("text"))
    return parts.select("doc_id", "page_index").distinct().join(whole, ["doc_id", "page_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def _last(parts: Column, mark: str) -> Column:
    """The number of the last part that is this mark, from 1; 0 for none."""
    at = F.array_position(F.reverse(parts), mark)
    return F.when(at > 0, F.size(parts) - at + 1).otherwise(F.lit(0).cast("long"))


def _emphasis(parts: Column) -> Column:
    """A string with one digit for each part: ``MARKER``, ``BOLD`` and ``ITALIC`` added up.

    A mark is a marker where it closes what is open, or where another of its kind follows; for a star that may be half of
    a pair. The flags of a marker are those before it.
    """

    def fold(last: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            part = F.get(parts, k - 1)
            is_marker = (
                F.when(part == "**", a["bold"] | (k < last["pair"]))
                .when(part == "*", a["italic"] | (k < F.greatest(last["pair"], last["star"])))
                .when(part == "_", a["italic"] | (k < last["line"]))
                .otherwise(False)
            )
            flags = lambda m: F.concat(a["codes"], (m.cast("int") * MARKER + a["bold"].cast("int") * BOLD + a["italic"].cast("int") * ITALIC).cast("string"))
            then = lambda m: F.struct((a["bold"] != (m & (part == "**"))).alias("bold"), (a["italic"] != (m & part.isin("*", "_"))).alias("italic"), flags(m).alias("codes"))
            return let(is_marker, then)

        start = F.struct(F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("").alias("codes"))
        return F.aggregate(F.sequence(F.lit(1), F.size(parts)), start, step, lambda a: a["codes"])

    last = F.struct(_last(parts, "**").alias("pair"), _last(parts, "*").alias("star"), _last(parts, "_").alias("line"))
    marked = F.array_contains(parts, "**") | F.array_contains(parts, "*") | F.array_contains(parts, "_")
    return F.when(marked, let(last, fold)).otherwise(F.repeat(F.lit("0"), F.size(parts)))


def _cut(line: Column) -> Column:
    """A line as a struct: ``kind`` (its number), ``parts``, and a digit for each part in ``codes``."""

    def with_start(start: Column) -> Column:
        rest = F.substring(line, F.length(start) + 1, F.length(line))
        rest = F.when(rest.rlike("[*_]"), F.regexp_extract_all(rest, F.lit(_PARTS), F.lit(0))).when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest))
        lead = lambda yes, no: F.when(start != "", yes).otherwise(no)
        none = F.array().cast("array<string>")
        return let(rest, lambda r: F.struct(F.concat(lead(F.array(start), none), r).alias("parts"), F.concat(lead(F.lit(str(MARKER)), F.lit("")), _emphasis(r)).alias("codes")))

    start = F.when(line.rlike(IMAGE_LINE), line).otherwise(F.regexp_extract(line, _START, 0))
    number = F.element_at(F.create_map(*(F.lit(x) for k, name in enumerate(KINDS) for x in (name, k))), _kind(line))
    return let(let(start, with_start), lambda c: F.struct(number.alias("kind"), c["parts"].alias("parts"), c["codes"].alias("codes")))


def _scanned(text: Column) -> Column:
    """All parts of a text with their codes; line breaks are parts of code 0."""

    def of(c: Column, n: Column) -> Column:
        codes = F.transform(F.slice(F.split(c["codes"], ""), F.lit(1), F.size(c["parts"])), lambda d: c["kind"] * 8 + d.cast("int"))
        codes = F.when(F.size(c["parts"]) > 0, codes).otherwise(F.array().cast("array<int>"))
        broken = n > 0
        return F.struct(
            F.when(broken, F.concat(F.array(F.lit("\n")), c["parts"])).otherwise(c["parts"]).alias("parts"), F.when(broken, F.concat(F.array(F.lit(0)), codes)).otherwise(codes).alias("codes")
        )

    lines = F.transform(F.split(text, "\n", -1), lambda x, n: let(_cut(x), lambda c: of(c, n)))
    return let(lines, lambda ls: F.struct(F.flatten(F.transform(ls, lambda s: s["parts"])).alias("parts"), F.flatten(F.transform(ls, lambda s: s["codes"])).alias("codes")))


def _is_marker(code: Column) -> Column:
    return code.bitwiseAND(F.lit(MARKER)) > 0


TOKENS = "array<struct<start:int,stop:int,marker:boolean,bold:boolean,italic:boolean,block:string>>"


def tokens(text: Column) -> Column:
    """The text as tokens that follow each other without a gap, neighbours of one class in one: an array of structs of
    start, stop, marker, bold, italic and the line's block kind. An empty text has none, and null gives null."""

    def merged(s: Column) -> Column:
        lengths = F.transform(s["parts"], lambda p: F.length(p))
        first = F.filter(F.sequence(F.lit(0), F.size(s["codes"]) - 1), lambda k: (k == 0) | (F.get(s["codes"], k) != F.get(s["codes"], k - 1)))

        def token(at: Column, ks: Column):
            def one(k: Column, j: Column) -> Column:
                code, stop = F.get(s["codes"], k), F.coalesce(F.get(at, F.get(ks, j + 1)), F.length(text))
                has = lambda flag: code.bitwiseAND(F.lit(flag)) > 0
                kind = F.get(F.array(*map(F.lit, KINDS)), F.floor(code / 8).cast("int"))
                return F.struct(F.get(at, k).alias("start"), stop.alias("stop"), has(MARKER).alias("marker"), has(BOLD).alias("bold"), has(ITALIC).alias("italic"), kind.alias("block"))

            return F.transform(ks, one)

        return let(starts_of(lengths), lambda at: let(first, lambda ks: token(at, ks)))

    none = F.array().cast(TOKENS)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("stop"), *(F.lit(False).alias(n) for n in ("marker", "bold", "italic")), F.lit(KINDS[0]).alias("block")))
    return F.when(text == "", none).when(text.rlike(MARKED), let(_scanned(text), merged).cast(TOKENS)).when(text.isNotNull(), whole.cast(TOKENS))


def token_rows(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, token_no, start, stop, marker, bold, italic, block of every token of every page."""
    rows = pages.select("doc_id", "page_index", F.posexplode(tokens(F.col("text"))).alias("token_no", "t"))
    return rows.select("doc_id", "page_index", "token_no", "t.*")


def stripped(text: Column) -> Column:
    """A struct of the text without markers and of ``offsets``: where each of its characters, and its end, then stands. A
    marker's characters stand where what follows it does. Null for a null text."""

    def plain(s: Column) -> Column:
        kept = F.transform(s["parts"], lambda p, k: F.when(_is_marker(F.get(s["codes"], k)), 0).otherwise(F.length(p)))
        places = lambda at: F.transform(
            s["parts"], lambda p, k: F.when(_is_marker(F.get(s["codes"], k)), F.array_repeat(F.get(at, k), F.length(p))).otherwise(F.sequence(F.get(at, k), F.get(at, k) + F.length(p) - 1))
        )
        left = F.array_join(F.filter(s["parts"], lambda p, k: ~_is_marker(F.get(s["codes"], k))), "")
        offsets = lambda at: let(left, lambda t: F.struct(t.alias("text"), F.concat(F.flatten(places(at)), F.array(F.length(t))).alias("offsets")))
        return let(starts_of(kept), offsets)

    kind = "struct<text:string,offsets:array<int>>"
    own = F.struct(text.alias("text"), F.sequence(F.lit(0), F.length(text)).alias("offsets"))
    return F.when(text.isNull(), F.lit(None).cast(kind)).when(text.rlike(MARKED), let(_scanned(text), plain).cast(kind)).otherwise(own.cast(kind))


def inline_text(text: Column) -> Column:
    """Plain text on one line."""
    return trimmed(F.regexp_replace(stripped(text)["text"], r"\s+", " "))


def _runs(cut: Column) -> Column:
    """The parts of a line between its markers, joined."""
    kind = "array<struct<text:string,bold:boolean,italic:boolean>>"
    n = F.size(cut["parts"])
    digit = lambda k: F.when((k >= 0) & (k < n), F.substring(cut["codes"], k + 1, F.lit(1)).cast("int"))
    plain = lambda k: F.coalesce(digit(k) < MARKER, F.lit(False))
    at = F.sequence(F.lit(0), n - 1)
    first, last = F.filter(at, lambda k: plain(k) & ~plain(k - 1)), F.filter(at, lambda k: plain(k) & ~plain(k + 1))
    has = lambda k, flag: digit(k).bitwiseAND(F.lit(flag)) > 0
    runs = F.zip_with(first, last, lambda a, b: F.struct(F.array_join(F.slice(cut["parts"], a + 1, b - a + 1), "").alias("text"), has(a, BOLD).alias("bold"), has(a, ITALIC).alias("italic")))
    return F.when(n > 0, runs.cast(kind)).otherwise(F.array().cast(kind))


def spans(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, line_no, kind, number, image_name, spans (text, bold, italic) of the lines that aren't blank."""
    lines = pages.select("doc_id", "page_index", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\s+$", "")).where("line <> ''")
    lines = lines.withColumn("kind", _kind(F.col("line"))).withColumn("cut", _cut(F.col("line")))
    number = F.when(F.col("kind") == "numbered", F.regexp_extract("line", _NUMBERED, 1).cast("int"))
    image = F.when(F.col("kind") == "image", F.regexp_extract("line", IMAGE_LINE, 2))
    return lines.select("doc_id", "page_index", "line_no", "kind", number.alias("number"), image.alias("image_name"), _runs(F.col("cut")).alias("spans"))


def plain_text(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, text: the lines that aren't blank without any marker; a picture leaves an empty line."""
    line = F.array_join(F.transform("spans", lambda s: s["text"]), "")
    rows = spans(pages).select("doc_id", "page_index", "line_no", line.alias("line"))
    return rows.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
