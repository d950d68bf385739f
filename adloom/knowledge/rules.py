"""Text rules for competitor copy and for ad descriptions.

Each rule is one row: id, scope, pattern. Patterns are fixed values. ``extend`` adds words of
another language or corpus to chosen rules.
"""

# Patterns are searched case-insensitively unless anchored.
COMPETITOR = {
    "hook": "[?!]|gratis|descuento|oferta|nuevo|últim|solo|ya|ahora|%",
    "cta_start": "^(compra|pide|consigue|obt[eé]n|a[ñn]ade|lo quiero|shop|buy|order|get|claim|reclama|aprovecha|descubre)",
    "cta_short": "comprar|carrito|oferta|ahora",
    "transformation": "antes|despu[eé]s|era|hasta que",
    "social_proof": r"\d+%|clientes|reseñas|vendidos",
    "offer": "2x1|bundle|gratis|descuento|%|env[ií]o gratis",
    "offer_line": "2x1|bundle|gratis|descuento|%|env[ií]o",
    "guarantee": "garant[ií]a|devoluci[oó]n|reembolso|30 d[ií]as|refund",
    "guarantee_line": "garant[ií]a|devoluci[oó]n|reembolso|refund",
}
CTA_SHORT_LENGTH = 40
LINE_MIN, LINE_MAX = 8, 160
STORY_MIN_LENGTH = 100
MAX_HOOKS, MAX_CTAS = 6, 5

DIAGNOSIS = {
    "mentions_hook": "hook|primer|inicio|apertura|arranc",
    "brand_intro": "logo|intro|presentaci[oó]n de marca",
    "long_video": r"(30|40|45|60|90)\s*segundos|largo|minuto",
    "warm_traffic": "vsl|retarget",
    "mentions_close": "precio|oferta|descuento|cta|link|comprar",
    "generic_audio": "m[uú]sica.*(gen[eé]rica|stock)|sin m[uú]sica",
}
SHORT_DESCRIPTION = 60

# Extra words for corpora of pseudo-words (syllables that occur as text there).
CORPUS_WORDS = {
    "cta_start": "thing|than|eau|una",
    "guarantee": "ntrewh|tzkeit",
    "guarantee_line": "ntrewh",
    "social_proof": "ononst",
    "offer": "hehely",
    "offer_line": "hehely|ingon",
    "mentions_hook": "thre|ung",
    "brand_intro": "thed|êou",
    "long_video": "onor|heit",
    "warm_traffic": "ableand|eaux",
    "mentions_close": "ther|ción|ver",
    "generic_audio": "thon.*(an|re)|erha",
}


def extend(rules: dict, extra: dict | None = None) -> dict:
    """Rules with alternatives added; an anchored group stays anchored."""
    out = {}
    for rule, pattern in rules.items():
        words = (extra or {}).get(rule)
        if words and pattern.startswith("^(") and pattern.endswith(")"):
            pattern = f"{pattern[:-1]}|{words})"
        elif words:
            pattern = f"{pattern}|{words}"
        out[rule] = pattern
    return out


# Issue code -> message, in the order in which issues are reported.
ISSUES = {
    "short": "Falta detalle: cuenta gancho, duración, escenas y cierre",
    "no_hook": "No aparece el gancho inicial",
    "brand_intro": "La marca entra demasiado pronto",
    "too_long": "Dura demasiado para público frío",
    "no_close": "No hay precio, oferta ni llamada a la acción",
    "generic_audio": "El sonido no aporta",
}
DEFAULT_ISSUE = ("fine_tuning", "La base es sólida: revisa gancho, ritmo y oferta")
BRAND_REMOVAL = "Quita el logo de los primeros segundos"

REMOVALS = ["Planos largos sin novedad", "Datos técnicos sin beneficio", "Adjetivos vacíos"]
ADDITIONS = ["Subtítulos desde el inicio", "Enseña pronto {wow}", "Una prueba social visible", "Un motivo para actuar hoy"]
TESTS = ["Versión de 15 segundos", "Resultado primero o problema primero", "Dos voces distintas",
         "Con y sin precio", "Escenario real: {env}"]
HOOK_CHANGES = ["Da una cifra: de {a} minutos a {b} segundos", "Empieza por la palabra fuerte",
                "Suma un gancho visual", "Prueba el gancho en negativo"]
CTA_CHANGES = ["Deja una sola llamada", "Habla del beneficio", "Añade una fecha", "Dilo y muéstralo a la vez"]
PACING_CHANGES = ["Corta cada dos segundos", "Cambia de escala en cada corte", "Sube la energía antes del clímax",
                  "Elimina el tramo donde cae la retención"]

# Competitor report texts; {k} is a small drawn integer.
WEAKNESSES = ["Copy poco concreto", "Poco contenido de usuarios", "Página lenta o sin fotos de clientes",
              "Comentarios sin contestar"]
COUNTER_MOVES = ["Usa {k} ángulos que ellos no usan", "Mejora la oferta, no el precio",
                 "Publica más variantes por semana", "Contesta con vídeo"]
COLOR_TODOS = ["Anota el color del botón", "Anota el color de fondo", "Anota el color de las ofertas"]
NO_HOOKS = ["(sin ganchos en el texto)", "Revisa su primer titular"]
NO_CTAS = ["(sin llamadas en el texto)", "Revisa botones y avisos"]
DEFAULT_OFFER, NO_OFFER = "rebaja sin condiciones", "Sin oferta visible"
DEFAULT_GUARANTEE, NO_GUARANTEE = "garantía sin detalles", "Sin garantía visible: úsala a tu favor"
DEFAULT_HOOK, DEFAULT_CTA = "del estorbo a la mejora", "compra directa"
HOOK_PREVIEW = 40
