"""Product URL projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.binding import let
from adloom.functions.text import SPACE_RUN, strip

# Marketplace substrings in rule order.
MARKETPLACES = [
    ("aliexpress", ["aliexpress"]),
    ("amazon", ["amazon", "amzn."]),
    ("tiktok", ["tiktok"]),
    ("shopify", ["myshopify", "shopify"]),
]
# Source type -> label.
SOURCE_LABELS = {
    "aliexpress": "AliExpress", "amazon": "Amazon", "shopify": "Shopify", "tiktok": "TikTok",
    "tienda": "Tienda online", "imagen": "Imagen", "manual": "Manual",
}
# Shop words that are not part of a product name.
SHOP_WORDS = "dp|item|products?|product|detail|itm|ref|gp"


def source_type(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    out = F.when(u == "", "manual")
    for name, needles in MARKETPLACES:
        hit = u.contains(needles[0])
        for n in needles[1:]:
            hit = hit | u.contains(n)
        out = out.when(hit, name)
    return out.when(u.startswith("http"), "tienda").otherwise("manual")


def source_type_with_image(url: Column, has_image: Column) -> Column:
    return F.when(has_image & (F.coalesce(url, F.lit("")) == ""), "imagen").otherwise(source_type(url))


def source_label(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv])[kind]


#: Scheme, user info, host, port, path, as browsers read them: pipes, spaces and underscores are no errors in a path or query; a host has no space.
URL = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@\s]+)(?::[0-9]*)?(?=[/?#]|\s*$)([^?#]*)"


def _host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, URL, 1), F.lit(""))


def url_domain(url: Column) -> Column:
    """Host name without its first ``www.``; text that is no URL comes back unchanged."""
    def bare(host):
        at = F.locate("www.", host)
        return F.when(at > 0, F.concat(F.left(host, at - 1), F.substring(host, at + 4, F.length(host)))).otherwise(host)

    return F.coalesce(let(F.lower(_host(url)), bare), url)


def longest_segment(segments: Column) -> Column:
    """Longest path part; the first one on ties."""
    ranked = F.transform(segments, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.array_max(ranked)["s"]


def guess_name(url: Column) -> Column:
    """Product name guessed from the URL path; empty when there is none."""
    path = F.when(_host(url).isNotNull(), F.regexp_extract(url, URL, 2))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    slug = F.coalesce(
        F.get(F.filter(parts, lambda s: (F.length(s) > 12) & s.contains("-")), F.lit(0)),
        longest_segment(parts), F.lit(""),
    )
    for pattern, new in [(r"(?i)\.html?$", ""), (r"\d{6,}", ""), ("[-_+]", " "),
                         (rf"(?i)\b({SHOP_WORDS})\b", ""), (SPACE_RUN, " ")]:
        slug = F.regexp_replace(slug, pattern, new)
    return let(strip(slug), _capitalised)


def _capitalised(slug: Column) -> Column:
    words = F.transform(F.split(slug, " "), lambda w: F.when(
        F.length(w) > 2, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w))
    return F.when(F.length(slug) < 4, "").otherwise(F.concat_ws(" ", words))
