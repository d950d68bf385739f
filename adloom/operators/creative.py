"""Bulk template expansion: products x templates to creative items.

Templates are compiled to literals and slots when a plan is built. The values that a product gives to slots are put into one
array of lists per product row; a slot names its list, and a drawn one the word of the item's digest that picks from it. Filling
(see ``filling``) takes the seed and the lists of many products at a time, and makes digests only for items where something is drawn.
Items come back as lists inside the product's row, so the long form is one narrow stage and the nested form needs no exchange at
all. Every pick depends on (seed, module, position) only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from adloom.functions import scoring
from adloom.functions.binding import let
from adloom.functions.numbers import money
from adloom.functions.seeded import digest, pick, sampled
from adloom.functions.text import initcap_first
from adloom.knowledge import templates
from adloom.operators.filling import HOOK, LITERAL, NUMBER, VALUE, Items, Piece, Sheet

SLOT = re.compile(r"\{(\w+)\}")
PARTS = ("title", "text", "detail")
#: Columns of an item, long and nested.
LONG = {"module": "string", "item_group": "string", "ord": "int", "title": "string", "text": "string", "detail": "string", "attrs": "map<string,string>"}
NESTED = [x for x in LONG if x != "module"]


def angle_hook(angle: Column, number: Column) -> Column:
    """Opening line of a script angle; an unknown angle uses the first set."""
    sets = F.from_json(F.lit(json.dumps(templates.ANGLE_HOOKS, ensure_ascii=False)), "map<string, array<string>>")
    first = F.array(*[F.lit(x) for x in next(iter(templates.ANGLE_HOOKS.values()))])
    return pick(number, F.coalesce(F.try_element_at(sets, angle), first))


def offer_text(kind: Column, price: Column) -> Column:
    """Amounts of one offer as text."""
    return offer_texts([kind], price)[0]


def offer_texts(kinds: list[Column], price: Column) -> list[Column]:
    offers = scoring.offer_math(price)
    amount = lambda x: F.when(x.isNotNull(), money(x))

    def text(kind: Column) -> Column:
        offer = F.element_at(F.filter(offers, lambda o: o["offer"] == kind), 1)
        return F.concat_ws(" / ", amount(offer["price"]), amount(offer["value"]))

    return [text(kind) for kind in kinds]


# Values of a product: a list of one, or a list and the word of the digest that picks from it.
FIXED = {
    **{slot: (lambda column: lambda: F.array(F.col(column)))(column) for slot, column in {
        "p": "p", "cat": "cat", "env": "environment", "demo": "demo_action", "wow": "wow_moment", "problem": "problem",
        "price": "price_text", "person": "person", "q": "q", "qcat": "qcat"}.items()},
    "opening": lambda: F.array(initcap_first(F.col("desire0"))), "auds": lambda: F.array(F.array_join("auds", ", ")), "lo": lambda: F.array(F.col("price_lo").cast("string")),
    **{f"b{i}": (lambda i: lambda: F.array(F.element_at("b", F.lit(i) % F.size("b") + 1)))(i) for i in range(5)},
    **{f"review{i}": (lambda i: lambda: F.array(F.element_at("reviewers", i + 1)))(i) for i in range(4)},
}
DRAWN = {
    "pain": (lambda: F.col("pains"), 0), "fear": (lambda: F.col("fears"), 0), "desire": (lambda: F.col("desires"), 1), "aud": (lambda: F.col("auds"), 2),
    "benefit": (lambda: F.transform("b", F.lower), 1), "secondary": (lambda: F.transform("secondary_problems", F.lower), 1),
    "cta": (lambda: F.array(*[F.lit(x) for x in templates.CTAS]), 1),
}
#: Integers of an item: the word of its digest and the fields with their bounds.
NUMBERS = {"n": (2, "lo", "hi"), "m": (3, "lo2", "hi2")}
#: Word that picks one of the product's own hooks.
QUOTED = 2


def variants(row: dict) -> list[dict]:
    """The texts of a template by part; one variant for each opening line of its angle, where it has one."""
    texts = {k: row[k] for k in PARTS} | {k: v for k, v in row["attrs"].items() if SLOT.search(v)}
    if not any("{anglehook}" in v for v in texts.values()):
        return [texts]
    lines = templates.ANGLE_HOOKS.get(row["attrs"].get("angle"), next(iter(templates.ANGLE_HOOKS.values())))
    return [{k: v.replace("{anglehook}", line) for k, v in texts.items()} for line in lines]


class Filler:
    """Compiled form of lists of template rows, with the given columns of an item; ``with_hooks`` adds the drawn variants of the hooks.

    ``as_module`` and ``as_group`` are the names in the output; ``module`` and ``ord`` identify the template for draws.
    """

    def __init__(self, groups: list[list[dict]], columns: list[str], with_hooks: bool = False, k: int = 50):
        rows, hooks = [r for own in groups for r in own], templates.BUILTIN["hooks"]
        texts = lambda own: [v for r in own for one in variants(r) for v in self._shown(one, columns).values()]
        quoted = any("{hook}" in v for v in texts(rows))
        seen = rows + (hooks if quoted or with_hooks else [])
        self.offers = list(dict.fromkeys(r["item_group"] for r in seen if any("{offer}" in v for v in texts([r]))))
        used = {x for v in texts(rows) for x in SLOT.findall(v)}
        used |= {x for r in hooks for x in SLOT.findall("".join(variants(r)[0].values()))} if quoted or with_hooks else set()
        self.lists = [x for x in (*FIXED, *DRAWN) if x in used]
        self.columns, self.with_hooks = columns, with_hooks
        tags: dict[str, int] = {}
        order = [tags.setdefault(f"abtesting|{i}", len(tags)) for i in range(1, len(hooks) + 1)] if with_hooks else []
        pool: dict[str, int] = {"": 0}
        items = self._items(rows, columns, pool, tags)
        own = self._items(hooks, columns if with_hooks else ["text"], pool, tags) if quoted or with_hooks else None
        element, _, _, metric = templates.AB_ELEMENTS[0]
        shown = {"module": "abtesting", "item_group": element, "detail": metric}
        self.sheet = Sheet(pool, items, [len(g) for g in groups], list(tags), own, quoted, k if with_hooks else 0, shown, order)

    @staticmethod
    def _shown(texts: dict, columns: list[str]) -> dict:
        """The texts that the columns need."""
        return {x: v for x, v in texts.items() if x in columns or (x not in PARTS and "attrs" in columns)}

    def _items(self, rows: list[dict], columns: list[str], pool: dict[str, int], tags: dict[str, int]) -> Items:
        out = Items(pool, columns)
        for r in rows:
            forms = variants(r)
            slots = {x for one in forms for v in self._shown(one, columns).values() for x in SLOT.findall(v)}
            drawn = len(forms) > 1 or slots & {*DRAWN, *NUMBERS, "hook"}
            tag = tags.setdefault(f"{r['module']}|{r['ord']}", len(tags)) if drawn else -1
            of = lambda x: [self._pieces(one[x], r, tag) for one in forms]
            attrs = []
            if "attrs" in columns:
                attrs = [(x, [[Piece(LITERAL, v)]]) for x, v in r["attrs"].items() if x not in forms[0]] + [(x, of(x)) for x in forms[0] if x not in PARTS]
            names = {"module": r.get("as_module", r["module"]), "item_group": r.get("as_group", r["item_group"])}
            out.add(names, r["ord"], {x: of(x) for x in PARTS if x in columns}, attrs, tag)
        return out.close()

    def _pieces(self, text: str, r: dict, tag: int) -> list[Piece]:
        cut = SLOT.split(text)
        made = [Piece(LITERAL, lit) if i % 2 == 0 else self._slot(lit, r, tag) for i, lit in enumerate(cut) if lit or i % 2]
        return made or [Piece(LITERAL)]

    def _slot(self, slot: str, r: dict, tag: int) -> Piece:
        if slot in NUMBERS:
            word, lo, hi = NUMBERS[slot]
            return Piece(NUMBER, "", tag, word, r[lo], r[hi])
        if slot == "hook":
            return Piece(HOOK, "", tag, QUOTED)
        if slot == "offer":
            return Piece(VALUE, len(self.lists) + self.offers.index(r["item_group"]))
        return Piece(VALUE, self.lists.index(slot), *((tag, DRAWN[slot][1]) if slot in DRAWN else ()))

    def values(self) -> Column:
        """The product's lists, in the order that compiled slots refer to. A value that the product lacks leaves its slot empty."""
        lists = [FIXED[x]() if x in FIXED else DRAWN[x][0]() for x in self.lists]
        if self.offers:
            lists += [F.array(x) for x in offer_texts([F.lit(kind) for kind in self.offers], F.col("recommended_price"))]
        return F.array(*lists) if lists else F.array().cast("array<array<string>>")

    def filled(self) -> Column:
        """Struct of ``groups``, a list of items for each list of rows, and the drawn ``hooks`` where there are any."""
        item = f"array<struct<{', '.join(f'{x}: {LONG[x]}' for x in self.columns)}>>"
        ddl = f"groups: array<{item}>" + (f", hooks: {item}" if self.with_hooks else "")
        sheet, out = self.sheet, to_arrow_type(StructType.fromDDL(ddl))

        def fill(chunks: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            return sheet.batches(chunks, out)

        return F.arrow_udf(fill, ddl, ArrowUDFType.SCALAR_ITER)(F.col("seed"), self.values())


def expand_templates(enriched: DataFrame, module: str, rows: list[dict] | None = None) -> DataFrame:
    """Long form: one row per product and template of a module."""
    return _expand(enriched, Filler([rows or templates.BUILTIN[module]], list(LONG)))


def _expand(enriched: DataFrame, filler: Filler, carry: tuple[str, ...] = ()) -> DataFrame:
    filled = enriched.withColumn("_f", filler.filled())
    items = F.get("_f.groups", F.lit(0))
    # Exploded and not inlined: only then does the optimizer leave out what is built of no products.
    long = filled.select("product_id", "campaign_id", *carry, F.explode(F.concat(items, "_f.hooks") if filler.with_hooks else items).alias("_t"))
    return long.select("product_id", "campaign_id", *carry, "_t.*")


def ab_hook_rows() -> list[dict]:
    """The hooks as variants of the hook element."""
    element, _, _, metric = templates.AB_ELEMENTS[0]
    return [r | {"as_module": "abtesting", "as_group": element, "detail": metric} for r in templates.BUILTIN["hooks"]]


def ab_variants(enriched: DataFrame) -> DataFrame:
    return all_items(enriched, ["abtesting"])


def drawn_order(seed: Column, group: str, items: Column, k: int) -> Column:
    """k items of a nested module's group in drawn order."""
    def drawn(own: Column) -> Column:
        keyed = F.transform(own, lambda t, i: F.struct(digest(seed, F.concat(F.lit(f"{group}|"), t["ord"].cast("string"))).alias("h"), i.alias("i")))
        return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: F.get(own, s["i"]))

    return let(F.filter(items, lambda t: t["item_group"] == group), drawn)


def intelligence_lists(enriched: DataFrame) -> DataFrame:
    """Problems, benefits, angles and objections in drawn order; audiences and differentiators as they are."""
    lists = enriched.select("product_id", "campaign_id", "seed", nested_module("intelligence").alias("items"), F.create_map(
        F.lit("secondary_problems"), sampled(F.col("seed"), "secondary", F.col("secondary_problems"), 4),
        F.lit("benefits"), F.col("b"), F.lit("audiences"), F.transform("audiences", lambda a: a["name"])).alias("plain"))
    # Behind a generator, so that the module is filled once and not once per group.
    once = lists.select("product_id", "campaign_id", "seed", "plain", F.explode(F.array("items")).alias("items"))
    shown = lambda t, i: F.struct(t["item_group"].alias("item_group"), (i + 1).alias("ord"), *[t[p].alias(p) for p in PARTS], F.coalesce(t["attrs"]["idea"], F.lit("")).alias("idea"))
    groups = [*[drawn_order(F.col("seed"), g, F.col("items"), templates.SHOWN) for g in templates.DRAWN_GROUPS],
              F.filter("items", lambda t: ~t["item_group"].isin(templates.DRAWN_GROUPS))]
    plain = F.flatten(F.transform(F.map_entries("plain"), lambda e: F.transform(e["value"], lambda x, i: F.struct(
        e["key"].alias("item_group"), (i + 1).alias("ord"), F.lit("").alias("title"), x.alias("text"), F.lit("").alias("detail"), F.lit("").alias("idea")))))
    rows = F.concat(*[F.transform(g, shown) for g in groups], plain)
    return once.select("product_id", "campaign_id", F.lit("intelligence").alias("module"), F.inline(rows))


def all_items(enriched: DataFrame, modules: list[str] | None = None, carry: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """Every module of every product in one table, from one pass over the products. Columns in ``carry`` stay with every item.

    Without ``texts`` items have their module and group only, for counting: nothing is filled.
    """
    names = modules or list(templates.BUILTIN)
    rows = [r for m in names for r in templates.BUILTIN[m]]
    if texts:
        return _expand(enriched, Filler([rows], list(LONG), "abtesting" in names), carry)
    named = [(r["module"], r["item_group"]) for r in rows] + [(r["as_module"], r["as_group"]) for r in ab_hook_rows()[:50] if "abtesting" in names]
    literal = F.from_json(F.lit(json.dumps([{"module": m, "item_group": g} for m, g in named], ensure_ascii=False)), "array<struct<module: string, item_group: string>>")
    return enriched.select("product_id", "campaign_id", *carry, F.inline(literal))


def angle_duration_grid(df: DataFrame) -> DataFrame:
    """Every script angle with every duration, from two literal arrays."""
    angles = F.array(*map(F.lit, templates.ANGLES))
    durations = F.array(*[F.lit(d) for d, _ in templates.DURATIONS])
    return df.withColumn("angle", F.explode(angles)).withColumn("duration", F.explode(durations))


def render_block(label: Column) -> Column:
    """Text block of one item: numbered title, text and detail."""
    return F.concat(label, F.lit(". "), F.col("title"), F.lit("\n"), F.concat_ws("\n", "text", "detail"))


def _numbered(items: Column) -> Column:
    """Numbered lines of (ord, text) structs in order."""
    return F.array_join(F.transform(F.sort_array(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"])), "\n")


def render_group(items: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered text block per group of one product's items (at most the templates of a module)."""
    return items.groupBy(*keys).agg(_numbered(F.collect_list(F.struct("ord", "text"))).alias("block"))


def with_blocks(enriched: DataFrame, module: str, label) -> DataFrame:
    """Add ``blocks``: the numbered blocks of a module inside the product row, an array of (label, block), one for each ``label`` of a template row."""
    rows = templates.BUILTIN[module]
    hooks = ab_hook_rows() if module == "abtesting" else []
    drawn = label(hooks[0]) if hooks else None
    names = list(dict.fromkeys(map(label, rows + hooks[:1])))
    filler = Filler([[r for r in rows if label(r) == name] for name in names], ["ord", "text"], bool(hooks))
    groups = F.col("_f.groups")
    if hooks:
        at = names.index(drawn)
        groups = F.transform(groups, lambda own, i: F.when(i == at, F.concat(own, F.col("_f.hooks"))).otherwise(own))
    # All blocks are made in one loop.
    blocks = F.transform(F.arrays_zip(F.array(*map(F.lit, names)).alias("label"), groups.alias("items")), lambda g: F.struct(g["label"].alias("label"), _numbered(g["items"]).alias("block")))
    return enriched.withColumn("_f", filler.filled()).withColumn("blocks", blocks).drop("_f")


def render_module(enriched: DataFrame, module: str, label, keys: list[str], name: str | None = None) -> DataFrame:
    """``render_group`` over all items of a module, by ``keys`` of the product and the ``label`` of an item (named ``name``).

    The blocks of a product are made inside its row, so no text is exchanged. Only products that come more than once
    (``twin``, see ``catalog.with_twins``) have items of several rows in a block; those are expanded and gathered.
    """
    single, twins = enriched.filter("NOT twin"), enriched.filter("twin")
    made = with_blocks(single, module, label).select(*keys, F.explode("blocks").alias("_b"))
    rows = templates.BUILTIN[module] + (ab_hook_rows() if module == "abtesting" else [])
    labels = F.create_map(*[F.lit(x) for pair in dict.fromkeys((f"{r.get('as_group', r['item_group'])}|{r['ord']}", label(r)) for r in rows) for x in pair])
    items = all_items(twins, [module], tuple(k for k in keys if k not in ("product_id", "campaign_id")))
    items = items.withColumn("_label", labels[F.concat_ws("|", "item_group", "ord")])
    by = [name] if name else []
    gathered = render_group(items.withColumn(name, F.col("_label")) if name else items, [*keys, *by])
    return made.select(*keys, *[F.col("_b.label").alias(x) for x in by], F.col("_b.block").alias("block")).unionByName(gathered)


def nested_modules(modules: list[str]) -> Column:
    """The modules as an array of arrays of structs inside the product row; no rows are exploded or exchanged."""
    return Filler([templates.BUILTIN[m] for m in modules], NESTED).filled()["groups"]


def nested_module(module: str) -> Column:
    """One module as an array of structs inside the product row."""
    return F.get(nested_modules([module]), F.lit(0))


def nested_ab_hooks(hooks: Column, k: int = 50) -> Column:
    """k of the product's own hooks without repeats, in drawn order, as variants of the hook element. ``hooks`` are the filled ones of ``nested_module``."""
    element, _, _, metric = templates.AB_ELEMENTS[0]
    ranked = F.array_sort(F.transform(hooks, lambda t, i: F.struct(digest(F.col("seed"), F.concat(F.lit("abtesting|"), (i + 1).cast("string"))).alias("h"), i.alias("i"))))
    shown = lambda t: F.struct(F.lit(element).alias("item_group"), t["ord"].alias("ord"), t["title"].alias("title"), t["text"].alias("text"), F.lit(metric).alias("detail"), t["attrs"].alias("attrs"))
    return F.transform(F.slice(ranked, 1, k), lambda s: let(F.get(hooks, s["i"]), shown))
