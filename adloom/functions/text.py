"""String projections."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.binding import let

# White space as browsers trim and split it.
SPACES = " \t\n\r\x0b\f\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_RUN = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"

# Words dropped from the end of a shortened name.
TRAILING_WORDS = ["de", "en", "el", "la", "los", "las", "y", "con", "para", "por", "a", "x",
                  "the", "of", "for", "with", "and", "in"]
DEFAULT_NAME = "este producto"


def _accent_map() -> tuple[str, str]:
    """Every precomposed letter with its base letter, then the combining marks (dropped)."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if base != chr(code) and len(base) == 1:
            src.append(chr(code))
            dst.append(base)
    return "".join(src) + "".join(map(chr, range(0x300, 0x370))), "".join(dst)


_ACCENTS = _accent_map()


def strip(text: Column) -> Column:
    """Trim all white space, also non-breaking and other Unicode spaces."""
    return F.btrim(text, F.lit(SPACES))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def fold_accents(text: Column) -> Column:
    """Lower-case text without accents."""
    return F.translate(F.lower(text), *_ACCENTS)


def short_name(name: Column) -> Column:
    """First four words, without a trailing connector or number while more than two are left."""
    def drop_last(words):
        last = F.element_at(words, -1)
        loose = F.lower(last).isin(TRAILING_WORDS) | last.rlike(r"^[\d.,]+$")
        return F.when((F.size(words) > 2) & loose, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)

    words = F.slice(F.split(strip(name), SPACE_RUN), 1, 4)
    # Four words can lose at most two, so two rounds are the whole loop.
    return F.concat_ws(" ", let(let(words, drop_last), drop_last))


def name_or_default(name: Column) -> Column:
    return F.coalesce(blank_to_null(name), F.lit(DEFAULT_NAME))


def slugify(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), 1, 40)


def encode_component(text: Column) -> Column:
    """Percent encoding for one query value; keeps ``! ' ( ) * ~`` and writes a space as %20."""
    out = F.url_encode(text)
    for encoded, plain in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def split_title(text: Column, default_body: Column) -> tuple[Column, Column]:
    """Title before the first colon and the rest, with a default for an empty rest."""
    title = strip(F.substring_index(text, ":", 1))
    body = F.when(text.contains(":"), blank_to_null(F.regexp_replace(text, r"^[^:]*:", "")))
    return title, F.coalesce(body, default_body)


def initcap_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def first_sentence(text: Column) -> Column:
    return F.substring_index(text, ".", 1)


def truncate_preview(text: Column, n: int, suffix: str) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(suffix))).otherwise(text)


def star_bar(n: Column) -> Column:
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


def ordinal_label(i: Column) -> Column:
    text = i.cast("string")
    return F.when(F.length(text) >= 2, text).otherwise(F.lpad(text, 2, "0"))


def cycle(values: Column, i: Column) -> Column:
    """Element by position, starting again at the end."""
    return F.element_at(values, (i % F.size(values) + 1).cast("int"))


def product_context(name: Column, description: Column, url: Column, price: Column, audience: Column) -> Column:
    """One labelled line per filled field (labels are fixed values)."""
    def line(label, value):
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    return F.concat_ws(
        "\n", F.concat(F.lit("Producto: "), F.coalesce(name, F.lit(""))), line("Descripción: ", description), line("URL de origen: ", url),
        line("Precio observado/coste: ", price), line("Pista de audiencia del usuario: ", audience),
    )


def lines_in_range(text: Column, lo: int = 8, hi: int = 160) -> Column:
    """Trimmed lines longer than ``lo`` and shorter than ``hi`` characters, in order."""
    lines = F.transform(F.split(strip(text), r"\n+"), strip)
    return F.filter(lines, lambda line: (F.length(line) > lo) & (F.length(line) < hi))


def counted(values: Column) -> Column:
    """Array of (value, n) of the different values, inside the row: sorted once, then cut into runs."""
    def runs(held: Column, starts: Column) -> Column:
        return F.transform(starts, lambda at, j: F.struct(F.get(held, at).alias("value"), (F.coalesce(F.get(starts, j + 1), F.size(held)) - at).cast("long").alias("n")))

    def cut(held: Column) -> Column:
        fresh = F.transform(held, lambda x, i: F.when((i == 0) | (x != F.get(held, i - 1)), i))
        return let(F.filter(fresh, lambda i: i.isNotNull()), lambda starts: runs(held, starts))

    return let(F.sort_array(values), cut)
