"""Scores, prices and offer arithmetic over a product row joined to its category.

Every function takes the category ratings as columns. Formulas and label texts of metrics,
platforms, levels and impacts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.numbers import clamp, half_up, money
from adloom.functions.seeded import digest, draw, seeded_int


def content_ideas(visual: Column) -> Column:
    return clamp(visual, 3, 5)


def viral_potential(visual, explain, ugc, saturation, seed) -> Column:
    base = half_up((visual + ugc + (5 - saturation) + explain) / 4)
    coin = F.when(draw(digest(seed, "viral_potential")) >= 2**31, 1).otherwise(0)
    return F.least(F.lit(5), base + coin).cast("int")


def creative_score(ideas, viral, visual, explain, ugc, saturation, seed) -> Column:
    raw = (ideas + viral + explain + visual + ugc) / 25 * 80 + (5 - saturation) / 5 * 20
    return clamp(half_up(raw + seeded_int(seed, "score", -2, 3)), 35, 98).cast("int")


def _note(test: Column, yes: str, no: str) -> Column:
    return F.when(test, yes).otherwise(no)


def score_metrics(ideas, viral, saturation, explain, visual, ugc) -> Column:
    rows = [
        ("Contenido posible", ideas, ideas >= 5, "Muchos formatos posibles", "Unos cuantos formatos"),
        ("Potencial viral", viral, viral >= 4, "El efecto se ve enseguida", "Necesita un buen gancho"),
        ("Saturación", saturation, saturation >= 4, "Mercado lleno: destaca por creativo", "Queda hueco en el mercado"),
        ("Facilidad de explicar", explain, explain >= 4, "Se entiende solo", "Pide una frase de contexto"),
        ("Visualmente atractivo", visual, visual >= 4, "Luce en cámara", "Apóyate en personas"),
        ("UGC potencial", ugc, ugc >= 4, "Fácil para creadores", "Hará falta guion"),
    ]
    return F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(n).alias("label"), stars.cast("int").alias("stars"),
                              _note(t, yes, no).alias("note")) for i, (n, stars, t, yes, no) in enumerate(rows)])


def platform_scores(viral, explain, visual, ugc, saturation) -> Column:
    meta = F.least(F.lit(10), half_up((explain + visual) * 0.9 + (5 - saturation) * 0.2 + 1))
    tiktok = F.least(F.lit(10), half_up((viral + ugc) * 0.95 + 0.5))
    rows = [
        ("TikTok", tiktok, tiktok >= 8, "Primera opción", "Solo con ganchos fuertes"),
        ("Meta Ads", meta, meta >= 8, "Apta para público frío", "Mejor en retargeting"),
        ("YouTube Shorts", clamp(tiktok - 1, 5, 10), F.lit(True), "Reutiliza lo que funcione", ""),
        ("Pinterest", F.when(visual >= 4, 7).otherwise(5), visual >= 4, "Canal de apoyo", "Canal menor"),
    ]
    return F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(n).alias("name"), s.cast("int").alias("score"),
                              _note(t, yes, no).alias("note")) for i, (n, s, t, yes, no) in enumerate(rows)])


def score_verdict(total) -> Column:
    return (F.when(total >= 85, "Excelente: entra con fuerza").when(total >= 70, "Sólido: diferénciate por creativo")
            .otherwise("Exigente: prueba con poco presupuesto"))


def viral_factors(visual, explain, saturation, ugc) -> Column:
    """Six factors with their impact."""
    good = lambda t: F.when(t, "Positivo").otherwise("Neutro")
    rows = [
        ("Efecto rápido", good(visual >= 4)), ("Claro sin sonido", good(explain >= 4)),
        ("Invita a comentar", F.lit("Positivo")),
        ("Saturación del feed", F.when(saturation >= 4, "Negativo").otherwise("Positivo")),
        ("Fácil de replicar", good(ugc >= 4)), ("Emoción para compartir", F.lit("Positivo")),
    ]
    return F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(n).alias("factor"), impact.alias("impact"), factor_note(n, impact).alias("note"))
                     for i, (n, impact) in enumerate(rows)])


# What helps, and what to do where it does not.
FACTOR_NOTES = {
    "Efecto rápido": ("El cambio se ve sin esperar", "Abre con el resultado y cuenta después"), "Claro sin sonido": ("La imagen basta", "Añade tres palabras en pantalla"),
    "Invita a comentar": ("Deja una pregunta abierta", ""), "Saturación del feed": ("Hay hueco en el feed", "Cambia de escenario antes que de producto"),
    "Fácil de replicar": ("Cualquiera puede grabarlo", "Da un guion de dos líneas"), "Emoción para compartir": ("Se manda a alguien concreto", ""),
}


def factor_note(factor: str, impact) -> Column:
    helps, advice = FACTOR_NOTES[factor]
    return F.when(impact == "Positivo", helps).otherwise(advice)


def count_impact(factors, impact: str) -> Column:
    return F.size(F.filter(factors, lambda f: f["impact"] == impact))


def viral_probability(total, factors, seed) -> Column:
    x = total * 0.6 + count_impact(factors, "Positivo") * 7 - count_impact(factors, "Negativo") * 9
    return clamp(half_up(x + seeded_int(seed, "viral", 0, 6)), 25, 95).cast("int")


def viral_verdict(probability) -> Column:
    return (F.when(probability >= 75, "Alto: cuida el gancho").when(probability >= 55, "Medio-alto: publica volumen")
            .otherwise("Moderado: busca conversión"))


def recommended_price(lo, hi) -> Column:
    return half_up((lo + (hi - lo) * 0.55) / 5) * 5 - 0.05


def anchor_price(hi) -> Column:
    return half_up(hi * 1.6).cast("int")


SECOND_UNIT_DISCOUNT, TARGET_MARGIN = 30, 65


def price_strategy(lo, hi, recommended) -> Column:
    """Recommended price, range, struck-out anchor and margin, as text and as numbers."""
    dollars = lambda x: F.concat(F.lit("$"), x)
    return F.struct(
        F.concat(money(recommended), F.lit(" USD")).alias("recommended"), F.concat(dollars(lo), F.lit("–"), dollars(hi), F.lit(" USD")).alias("range"),
        F.concat(F.lit("Ancla "), dollars(anchor_price(hi)), F.lit(", oferta "), money(recommended)).alias("strategy"),
        F.lit(f"Margen bruto objetivo: {TARGET_MARGIN}%").alias("marginNote"), anchor_price(hi).alias("anchor"),
        F.lit(SECOND_UNIT_DISCOUNT).alias("second_unit_discount"), F.lit(TARGET_MARGIN).alias("target_margin"))


def scaling_level(saturation) -> Column:
    return F.when(saturation <= 2, "Muy alto").when(saturation == 3, "Alto").otherwise("Medio")


def scaling_reason(saturation) -> Column:
    return F.concat(
        F.when(saturation >= 4, "Demanda probada con mucha competencia").otherwise("Hay demanda y queda espacio"),
        F.lit(" ("), saturation.cast("string"), F.lit("/5)"))


SCALING_CHANNELS = ["TikTok Ads", "Meta Ads", "Orgánico y afiliados", "YouTube Shorts", "Microinfluencers", "Google Shopping"]


def offer_math(r) -> Column:
    """Seven offers with their amounts: price, compared value and saving in percent."""
    none = F.lit(None).cast("double")
    bundle, kit = r * 1.4 + 9.95, r * 1.25
    rows = [
        ("2x1", r * 1.7, none), ("Bundle", kit, bundle), ("Compra 2 y recibe...", r / 2, r),
        ("Regalo gratis", F.lit(3.0), F.lit(14.95)), ("Descuento progresivo", r * 2 * 0.8, r * 3 * 0.7),
        ("Urgencia", r, r * 1.4), ("Escasez", none, none),
    ]
    pct = half_up((bundle - kit) / bundle * 100).cast("int")
    return F.array(*[F.struct(
        F.lit(i + 1).alias("ord"), F.lit(kind).alias("offer"), price.alias("price"), value.alias("value"),
        (pct if kind == "Bundle" else F.lit(None).cast("int")).alias("saving_pct"))
        for i, (kind, price, value) in enumerate(rows)])
