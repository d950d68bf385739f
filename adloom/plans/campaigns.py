"""One nested document per product, built inside the product row: no explode, no exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions import scoring, urls
from adloom.functions.numbers import display_date
from adloom.functions.seeded import sampled
from adloom.functions.text import name_or_default, star_bar
from adloom.functions.binding import let
from adloom.knowledge import templates
from adloom.operators.catalog import enrich
from adloom.operators.creative import drawn_order, nested_ab_hooks, nested_modules

MODULES = [m for m in templates.BUILTIN if m not in ("intelligence", "viral")]


def build_campaigns(products: DataFrame, created_at: Column, enriched: bool = False) -> DataFrame:
    """Campaign documents with every module."""
    c = F.col
    df = products if enriched else enrich(products)
    prices = scoring.price_strategy(c("price_lo"), c("price_hi"), c("recommended_price"))
    pricing = F.struct(*[prices[x].alias(x) for x in ("recommended", "range", "strategy", "marginNote")])
    scaling = F.struct(scoring.scaling_level(c("saturation")).alias("level"), scoring.scaling_reason(c("saturation")).alias("reasoning"),
                       F.array(*map(F.lit, scoring.SCALING_CHANNELS)).alias("channels"))
    by_group = lambda g: F.filter("lists", lambda t: t["item_group"] == g)
    drawn = lambda g: drawn_order(c("seed"), g, c("lists"), templates.SHOWN)
    # All modules are filled at once.
    names = ["intelligence", "viral", *MODULES]
    filled = df.withColumn("_modules", nested_modules(names))
    own = lambda m: F.get("_modules", F.lit(names.index(m)))
    lists = filled.withColumn("lists", own("intelligence"))
    intelligence = F.struct(
        F.concat(c("problem"), F.lit(". "), c("p")).alias("problem"),
        sampled(c("seed"), "secondary", c("secondary_problems"), 4).alias("secondaryProblems"), c("b").alias("benefits"), "audiences",
        F.transform(drawn("angles"), lambda t: F.struct(t["title"].alias("name"), t["detail"].alias("emotion"), t["text"].alias("description"), t["attrs"]["idea"].alias("bigIdea"))).alias("angles"),
        F.transform(drawn("objections"), lambda t: F.struct(t["title"].alias("objection"), t["text"].alias("response"))).alias("objections"),
        F.transform(by_group("differentiators"), lambda t: t["text"]).alias("differentiators"), pricing.alias("pricing"), scaling.alias("scaling"))
    score = F.struct(
        c("score").alias("total"), scoring.score_verdict(c("score")).alias("verdict"),
        scoring.score_metrics(c("content_ideas"), c("viral_potential"), c("saturation"), c("explainability"), c("visual_appeal"), c("ugc_fit")).alias("metrics"),
        scoring.platform_scores(c("viral_potential"), c("explainability"), c("visual_appeal"), c("ugc_fit"), c("saturation")).alias("platforms"))
    viral = F.struct(c("probability").alias("probability"), scoring.viral_verdict(c("probability")).alias("verdict"), c("factors").alias("factors"),
                     F.transform(own("viral"), lambda t: t["text"]).alias("recommendations"))
    source = urls.source_type_with_image(c("source_url"), F.coalesce("image_data_url", F.lit("")) != "")
    documents = lists.select(
        "seed", "product_id", "campaign_id", created_at.alias("created_at"), F.lit("local").alias("generated_by"),
        F.struct(name_or_default(c("name")).alias("name"), "description", "source_url", source.alias("source_type"), "price", "audience_hint",
                 c("resolved_id").alias("category_id")).alias("input"),
        intelligence.alias("intelligence"), score.alias("score"), viral.alias("viral"),
        *[own(m).alias(m) for m in MODULES])
    # The hooks are filled once: their variants quote them.
    return documents.withColumn("abhooks", nested_ab_hooks(c("hooks"))).drop("seed")


# ---- markdown --------------------------------------------------------------------------------

def _bullets(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n")


def _items(module: str, line, heading=None) -> Column:
    """Lines of a module, with a heading where the group changes."""
    def lines(items):
        def one(t, i):
            first = (i == 0) | (F.get(items, i - 1)["item_group"] != t["item_group"])
            head = F.when(first, F.concat(F.lit("\n### "), heading(t), F.lit("\n"))).otherwise("") if heading else F.lit("")
            return F.concat(head, F.lit("- "), line(t))
        return F.array_join(F.transform(items, one), "\n")
    return let(F.col(module), lines)


def _scripts() -> Column:
    """Every script with its beats. Both modules are bound, so that neither is built again per script."""
    def beat(b):
        return F.concat(F.lit("- **"), b["attrs"]["time"], F.lit(" · "), b["title"], F.lit("** — VOZ: "), b["text"], F.lit(" | VISUAL: "), b["detail"])

    def block(t, beats):
        own = F.filter(beats, lambda b: b["script"] == t["ord"])
        return F.concat_ws("\n", F.concat(F.lit("\n### ["), t["item_group"], F.lit("] "), t["title"]), F.concat(F.lit("Hook: "), t["text"]),
                           F.array_join(F.transform(own, lambda b: b["line"]), "\n"), F.concat(F.lit("CTA: "), t["detail"]))

    lines = F.transform("beats", lambda b: F.struct(b["attrs"]["script"].cast("int").alias("script"), beat(b).alias("line")))
    return let(lines, lambda beats: F.array_join(F.transform("scripts", lambda t: block(t, beats)), "\n"))


def _titled(t) -> Column:
    return F.concat(F.lit("**"), t["title"], F.lit("** — "), F.regexp_replace(t["text"], "\n", " / "))


def _notes(*names: str):
    """The named further fields of an item, in brackets."""
    return lambda t: F.concat(F.lit(" ["), F.concat_ws(" | ", *[t["attrs"][n] for n in names]), F.lit("]"))


def _with(line, *names: str):
    return lambda t: F.concat(line(t), _notes(*names)(t))


# Section titles in export order (fixed values) with the module that fills them.
SECTIONS = [
    ("2. Hooks", "hooks", lambda t: t["text"], lambda t: F.concat_ws(" ", t["attrs"]["emoji"], t["item_group"])),
    ("3. Anuncios (Ad Generator)", "ads", _with(lambda t: F.concat_ws(" · ", _titled(t), t["detail"], t["attrs"]["cta"]), "description", "specs", "notes"), None),
    ("4. Guiones (Script Generator)", "scripts", None, None),
    ("5. Storyboards (Visual Generator)", "visual", _with(lambda t: F.concat_ws(" · ", t["attrs"]["n"], t["text"], t["attrs"]["duration"]),
                                                         "shot", "subject", "expression", "light", "movement", "audio"),
     lambda t: F.concat_ws(": ", t["item_group"], t["attrs"]["concept"])),
    ("6. Prompts de imagen IA", "imageprompts", _with(_titled, "meta"), lambda t: t["item_group"]),
    ("7. Prompts de video IA", "videoprompts", _with(_titled, "meta"), lambda t: t["item_group"]),
    ("8. UGC Generator", "ugc", _with(_titled, "profile", "tone", "setting", "wardrobe"), lambda t: F.concat_ws(" ", t["attrs"]["emoji"], t["item_group"])),
    ("9. Thumbnails", "thumbnails", _with(_titled, "style", "layout", "colors", "prompt"), None),
    ("10. Landing Copy", "landing", _titled, lambda t: t["item_group"]),
    ("11. Ofertas (Offer Builder)", "offers", _with(_titled, "name", "structure", "example", "best_for"), None),
    ("12. Creative Planner", "planner", _with(lambda t: F.concat(t["attrs"]["count"], F.lit("× "), t["title"], F.lit(" ["), t["attrs"]["platform"], F.lit("] "), t["attrs"]["priority"]), "notes"),
     lambda t: t["item_group"]),
]
# Comparison rows and sample reviews of the landing copy are not exported.
NOT_EXPORTED = ["comparison", "reviews"]


def campaign_markdown(campaigns: DataFrame) -> DataFrame:
    """Add ``markdown``: header, score, numbered sections, and the competitor section when present."""
    c = F.col
    df = campaigns.withColumn("landing", F.filter("landing", lambda t: ~t["item_group"].isin(NOT_EXPORTED)))
    lines = [
        F.concat(F.lit("# Campaña Creativa — "), c("input.name")),
        F.concat(F.lit("\n> "), display_date(c("created_at")), F.lit(" · Motor: "), c("generated_by")),
        F.when(F.coalesce("input.source_url", F.lit("")) != "", F.concat(F.lit("> Origen: "), c("input.source_url"))),
        F.lit("\n## Creative Score\n"), F.concat(F.lit("**"), c("score.total"), F.lit("/100** — "), c("score.verdict")),
        F.array_join(F.transform("score.metrics", lambda m: F.concat(F.lit("- "), m["label"], F.lit(": "), star_bar(m["stars"]), F.lit(" — "), m["note"])), "\n"),
        F.array_join(F.transform("score.platforms", lambda p: F.concat(F.lit("- "), p["name"], F.lit(": "), p["score"], F.lit("/10 — "), p["note"])), "\n"),
        F.lit("\n## 1. Product Intelligence\n"), F.concat(F.lit("**Problema:** "), c("intelligence.problem")),
        F.lit("\n**Problemas secundarios:**"), _bullets(c("intelligence.secondaryProblems")),
        F.lit("\n**Beneficios:**"), _bullets(c("intelligence.benefits")),
        F.lit("\n**Audiencias:**"), _bullets(F.transform("intelligence.audiences", lambda a: F.concat_ws(" — ", a["name"], a["description"], F.array_join(a["pains"], "; ")))),
        F.lit("\n**Ángulos de venta:**"), _bullets(F.transform("intelligence.angles", lambda a: F.concat(a["name"], F.lit(" ("), a["emotion"], F.lit("): "), a["description"]))),
        F.lit("\n**Objeciones:**"), _bullets(F.transform("intelligence.objections", lambda o: F.concat_ws(" → ", o["objection"], o["response"]))),
        F.lit("\n**Diferenciadores:**"), _bullets(c("intelligence.differentiators")),
        F.concat(F.lit("\n**Precio:** "), c("intelligence.pricing.recommended"), F.lit(" ("), c("intelligence.pricing.range"), F.lit(")\n"), c("intelligence.pricing.strategy")),
        F.concat(F.lit("\n**Escalado:** "), c("intelligence.scaling.level"), F.lit(" — "), c("intelligence.scaling.reasoning")),
    ]
    for title, module, line, heading in SECTIONS:
        lines += [F.lit(f"\n## {title}\n"), _scripts() if module == "scripts" else _items(module, line, heading)]
    lines += [
        F.lit("\n## 13. Viral Predictor\n"), F.concat(F.lit("**Probabilidad: "), c("viral.probability"), F.lit("%** — "), c("viral.verdict")),
        _bullets(F.transform("viral.factors", lambda f: F.concat(F.lit("["), f["impact"], F.lit("] "), f["factor"], F.lit(": "), f["note"]))), _bullets(c("viral.recommendations")),
        F.lit("\n## 14. A/B Testing\n"), F.lit("### 🪝 Hooks"), _bullets(F.transform("abhooks", lambda t: t["text"])), _items("abtesting", lambda t: t["text"], lambda t: F.concat_ws(" ", t["attrs"]["emoji"], t["item_group"])),
        F.lit("\n## 15. Creative Library (búsquedas)\n"), _items("library", _with(lambda t: F.concat(F.lit("["), t["attrs"]["platform"], F.lit("] "), t["title"], F.lit(": "), t["text"]), "note")),
    ]
    if "competitor" in campaigns.columns:
        report = F.concat(F.lit("\n## 16. Análisis de competidor\n\nURL: "), c("competitor.url"), F.lit("\nFramework: "), c("competitor.framework"),
                          F.lit("\n"), _bullets(c("competitor.counter_moves")))
        lines.append(F.when(c("competitor").isNotNull(), report))
    return df.withColumn("markdown", F.concat_ws("\n", *lines))
