"""Creative templates as data.

A template row is ``module, item_group, ord, title, text, detail, lo, hi, lo2, hi2, attrs``.
``title``, ``text`` and ``detail`` may hold slots in braces; ``{n}`` and ``{m}`` are integers drawn
from lo..hi and lo2..hi2. Group names, sizes, durations, tools, platforms and counts are fixed
values; the wording is our own, and long tables come from patterns.
"""

from __future__ import annotations

from itertools import product

# Hook group, icon, number of hooks.
HOOK_GROUPS = [
    ("Curiosidad", "🔍", 10), ("Miedo", "⚠️", 10), ("Dolor", "💢", 9), ("Humor", "😂", 9), ("Storytelling", "📖", 9),
    ("ASMR", "🎧", 8), ("Comparación", "⚖️", 8), ("Error común", "🚫", 8), ("Antes vs Después", "🔄", 8),
    ("POV", "👁️", 7), ("Shock", "⚡", 8), ("Datos", "📊", 7), ("Estadísticas", "📈", 7), ("Testimonio", "💬", 8),
]
DEFAULT_EMOJI = "✨"
# Openers and closers per group; their combinations are the hooks.
HOOK_PARTS = {
    "Curiosidad": (["Mira qué pasa con {p}", "Hay un detalle de {p} que sorprende", "{aud}: esto os interesa",
                    "Lo descubrí buscando {desire}"],
                   ["y espera al final", "en {n} segundos", "sin trucos"]),
    "Miedo": (["Ojo con {fear}", "Antes de comprar otra cosa, piensa en {fear}", "Dentro de {n} días lo lamentarás",
               "Lo peor no es el precio, es {fear}"],
              ["y tiene remedio", "si no cambias nada", "según {aud}"]),
    "Dolor": (["Otra vez {pain}", "Basta de {pain}", "{aud}, ¿también {pain}?"],
              ["con {p} se acaba", "y nadie lo arregla", "hasta hoy"]),
    "Humor": (["Mi casa frente a {pain}", "Mi cartera cuando vio {p}", "{aud} fingiendo calma"],
              ["(escena real)", "versión {n}", "con música dramática"]),
    "Storytelling": (["Hace {n} días no conocía {p}", "Todo empezó por {pain}", "Mi vecina quería {desire}"],
                     ["y mira ahora", "parte uno", "así terminó"]),
    "ASMR": (["Sube el volumen: {p}", "Solo sonido, solo {p}", "Cierra los ojos y escucha"],
             ["durante {n} segundos", "sin hablar", "con auriculares"]),
    "Comparación": (["{p} contra una opción de ${m}", "Lo barato, lo caro y {p}", "Dos formas de {desire}"],
                    ["¿cuál gana?", "medido en directo", "misma tarea"]),
    "Error común": (["Tu fallo no es {pain}", "Casi todos usan mal {p}", "No busques {desire} así"],
                    ["corrígelo hoy", "te enseño cómo", "y ahorra ${m}"]),
    "Antes vs Después": (["Día 1 y día {n} con {p}", "De {pain} a {desire}", "Mismo sitio, otra vida"],
                         ["sin filtros", "desliza", "compara tú"]),
    "POV": (["POV: llega {p}", "POV: ya no existe {pain}", "POV: {aud} en modo tranquilo"],
            ["un martes cualquiera", "a las {n}", "y sonríes"]),
    "Shock": (["Pagué menos de ${m} por {p}", "Esto no debería costar tan poco", "Se acabó en {n} horas"],
              ["y funciona", "míralo", "palabra"]),
    "Datos": (["{n} pruebas después", "Medimos {benefit}", "Cifra del día: {m}"],
              ["con {p}", "resultado claro", "y van más"]),
    "Estadísticas": (["{n} de cada {m} repiten", "Sube un {n}% el uso de {p}", "Encuesta a {aud}"],
                     ["este mes", "dato interno", "fuente: clientes"]),
    "Testimonio": (["Llevo {n} días con {p}", "No creía en {p}", "Lo compré por {benefit}"],
                   ["y repito", "opinión sincera", "lo recomiendo"]),
}

# Script angles and durations.
ANGLES = ["Problema → Solución", "Antes vs Después", "Testimonio honesto", "Comparación con alternativa cara",
          "Descubrimiento viral", "Humor / relatable"]
DURATIONS = [("15s", "versión rápida"), ("30s", "versión estándar"), ("45s", "versión completa"),
             ("1 min", "historia completa"), ("2 min", "mini VSL"), ("3 min", "VSL completo")]
# Three opening lines per angle.
ANGLE_HOOKS = {
    "Problema → Solución": ["Si vives {pain}, mira", "{pain}: aquí acaba", "Una salida para {pain}"],
    "Antes vs Después": ["Antes y después de {p}", "Compara estas dos escenas", "Guarda este cambio"],
    "Testimonio honesto": ["Mi opinión de {p}", "Dudaba y ya no", "Nadie paga esta opinión sobre {p}"],
    "Comparación con alternativa cara": ["{p} o gastar el triple", "Misma tarea, dos precios", "Reto: {p} contra la marca"],
    "Descubrimiento viral": ["Acabo de encontrar {p}", "¿Conocías {p}?", "Un hallazgo para compartir"],
    "Humor / relatable": ["Yo defendiendo {p}", "Las 3 de la mañana y mi carrito", "Primero risa, luego {p}"],
}
CTAS = ["Entra en el enlace", "Hoy con descuento en el perfil", "Ya conoces el siguiente paso", "Treinta días de prueba",
        "Hazlo por tu yo de mañana"]
# The time ranges of a script's beats per duration.
BEAT_TIMES = {
    "15s": ["0-2s", "2-8s", "8-12s", "12-15s"], "30s": ["0-3s", "3-8s", "8-18s", "18-24s", "24-30s"],
    "45s": ["0-3s", "3-10s", "10-22s", "22-32s", "32-40s", "40-45s"], "1 min": ["0-4s", "4-14s", "14-28s", "28-40s", "40-50s", "50-60s"],
    "2 min": ["0-5s", "5-20s", "20-35s", "35-60s", "60-80s", "80-100s", "100-120s"],
    "3 min": ["0-8s", "8-30s", "30-55s", "55-90s", "90-120s", "120-145s", "145-165s", "165-180s"],
}
# Our own arcs: label, voice-over, visual. Longer scripts follow a day with the product, hour by hour.
ARCS = {
    "15s": [("Apertura", "{anglehook}", "Manos en primer plano"), ("Gesto", "Un movimiento basta: {b0}", "{demo}, sin cortes"),
            ("Huella", "Queda esto: {b1}", "La mesa ya recogida"), ("Despedida", "{cta}", "Nombre y enlace en pantalla")],
    "30s": [("Apertura", "{anglehook}", "Cámara al hombro en {env}"), ("Antesala", "Son las siete y toca {pain}", "Reloj de cocina"),
            ("Mediodía", "A las doce, {p}: {b0} y además {b1}", "{demo} visto desde arriba"),
            ("Vecindario", "En el rellano ya preguntan por él", "Dos voces fuera de plano"), ("Cuenta", "Todo por {price}. {cta}", "Ticket impreso")],
    "45s": [("Apertura", "{anglehook}", "Persiana que sube"), ("Lunes", "El lunes era {pain}", "Calendario de pared"),
            ("Martes", "El martes estrené {p}: {b0}", "{demo} paso a paso"), ("Jueves", "El jueves ya contaba con {b1}", "Misma escena, otra luz"),
            ("Domingo", "El domingo tuve {desire}", "Plano abierto y silencio"), ("Despedida", "{cta}", "Persiana que baja")],
    "1 min": [("Apertura", "{anglehook}", "Puerta que se abre"), ("Retrato", "Soy de los de {aud} y cargo con {pain}", "Foto de familia"),
              ("Inventario", "En el cajón: {b0}, {b1} y poco más", "Cajón ordenado por piezas"), ("Diario", "Apunté {n} días seguidos", "Libreta con rayas"),
              ("Invitación", "Si te suena {pain}, pasa", "Silla vacía junto a la ventana"), ("Despedida", "Sale a {price}. {cta}", "Libreta que se cierra")],
    "2 min": [("Apertura", "{anglehook}", "Mapa de la casa"), ("Plano", "{problem}", "Habitaciones una a una"), ("Callejón", "Probé atajos que no llevan a ningún sitio", "Flechas tachadas"),
              ("Taller", "Sobre la mesa, {p}: {b0}; {b1}; {b2}", "{wow} a cámara lenta"), ("Visitas", "Pasaron por casa y opinaron", "Tazas de café"),
              ("Reparos", "Lo que me preguntaron: tamaño, plazos, coste", "Notas adhesivas"), ("Despedida", "El mapa acaba aquí. {cta}", "Chincheta en el destino")],
    "3 min": [("Apertura", "{anglehook}", "Pantalla en negro y lluvia"), ("Archivo", "Guardé {n} recibos de cosas contra {pain}", "Caja de zapatos"),
              ("Hallazgo", "Nadie miraba {secondary}; {p} sí", "Lupa sobre un dibujo"), ("Ensayo", "Lo hago delante de ti y sin prisa", "Toma única"),
              ("Bitácora", "Mes a mes se acerca {desire}", "Páginas que pasan"), ("Compañía", "Es para quien persigue {desire}", "Grupo alrededor de una mesa"),
              ("Trato", "{p} llega a casa por {price}, con vuelta atrás", "Apretón de manos"), ("Despedida", "La lluvia para. {cta}", "Luz de la tarde")],
}
BEATS = {d: [(time, *arc) for time, arc in zip(BEAT_TIMES[d], ARCS[d], strict=True)] for d in BEAT_TIMES}

PERSONS = ["Panadera de barrio", "Cartero con prisa", "Profesora de música", "Pescador jubilado", "Programadora nocturna", "Florista", "Conductor de tranvía"]
TOOLS_IMAGE = [("GPT Image", 4), ("Midjourney", 4), ("Flux", 3), ("Nano Banana", 3), ("Hailuo (imagen)", 2), ("Kling (imagen)", 2)]
TOOLS_VIDEO = [("Veo", 3), ("Kling", 3), ("Hailuo", 2), ("Runway", 2), ("Pika", 2)]
IMAGE_STYLES = ["hero de estudio", "escena de uso", "comparativa", "plano de detalle"]
# One sentence (* stands for the style) and the settings per tool.
IMAGE_SETTINGS = [
    ("Fotografía de {p} en {env}, *, texto legible fuera de cuadro", "1024x1536, calidad alta"), ("{p}, *, luz de tarde, {cat} --ar 4:5 --style raw", "--ar 4:5 --s 150"),
    ("* de {p}: grano fino, objetivo de 50 mm, {demo}", "guía 3.5, 28 pasos"), ("Edita la foto: {p}, *, conserva la forma", "una referencia, cuadrado"),
    ("Ilustración *, {p} sobre papel", "1:1, semilla fija"), ("{p} en {env}, *, profundidad corta", "16:9, fidelidad media")]
VIDEO_SETTINGS = [
    ("Plano de ocho segundos: {demo}, *, sonido ambiente de {env}", "8 s, 16:9, audio"), ("* sobre {p}; termina en {wow}", "5 s, 9:16, modo pro"),
    ("{person} con {p}, *", "6 s, 768p"), ("De lejos a cerca: {p}, *", "10 s, 24 fps"), ("*: {p} respira y vuelve", "3 s, bucle")]
STORY_CONCEPTS = ["Un estorbo se vuelve costumbre", "Dos relojes, una tarea", "Abrir la caja delante de alguien"]
SHOTS = ["Cenital", "A la altura del codo", "Desde el umbral", "Detalle de dedos", "Contraluz"]
EXPRESSIONS = ["Cansancio leve", "Curiosidad", "Media sonrisa", "Atención", "Risa contenida", "Alivio"]
LIGHTS = ["Ventana norte", "Lámpara de mesa", "Sol bajo", "Fluorescente de cocina"]
MOVES = ["Cámara quieta", "Paso lateral", "Acercamiento lento", "Giro de muñeca", "Retroceso"]
SOUNDS = ["Solo ambiente", "Tres notas de piano", "Voz fuera de plano", "Clic del producto"]
VIDEO_STYLES = ["demo continua", "giro de cámara", "bucle corto"]
# Persona, icon. Replacement documents refer to personas by the first letters of these names.
PERSONAS = [("Mamá", "👩‍👧"), ("Doctor / especialista", "🥼"), ("Deportista", "🏋️"), ("Estudiante", "🎓"),
            ("CEO / emprendedor", "💼"), ("Pareja", "💑"), ("Abuelo/a", "👴")]
# Profile, tone, place and clothes of each persona.
PERSONA_NOTES = [
    ("Reparte la tarde entre deberes y cenas", "Complicidad de grupo de chat", "Mesa con mochilas", "Delantal y zapatillas"),
    ("Explica por oficio y sin alarmas", "Pausado, con un ejemplo por frase", "Pizarra pequeña", "Chaqueta lisa"),
    ("Apunta cada sesión", "Frases cortas, respiración audible", "Pista al amanecer", "Cortavientos"),
    ("Comparte piso y compara precios", "Irónico y veloz", "Biblioteca, voz baja", "Jersey prestado"),
    ("Dirige un taller de seis personas", "Cifras redondas, nada de jerga", "Almacén con cajas", "Camisa remangada"),
    ("Discuten y se ríen de lo mismo", "Diálogo a medias", "Sofá frente a la cámara", "Lo que llevaban puesto"),
    ("Repara radios y guarda tornillos", "Cuenta una anécdota y calla", "Banco del jardín", "Gorra y tirantes"),
]
OFFER_TYPES = ["2x1", "Bundle", "Compra 2 y recibe...", "Regalo gratis", "Descuento progresivo", "Urgencia", "Escasez"]
# Name, structure, example and best use of each offer.
OFFER_NOTES = [
    ("Par", "Dos por menos que dos", "Uno para ti y otro para {aud}", "Artículos que se gastan"), ("Lote del taller", "{p} con dos piezas", "Caja cerrada con nota", "Subir el ticket"),
    ("Tercero aparte", "Dos y un recambio", "El recambio viaja dentro", "Compras en grupo"), ("Detalle", "Algo pequeño en la caja", "Una funda para {p}", "Primer pedido"),
    ("Escalera", "Cada unidad baja un peldaño", "La tercera, la que más", "Familias"), ("Reloj", "Precio hasta medianoche", "{price} y después sube", "Cierre de semana"),
    ("Tirada", "Una serie numerada", "Número a mano en {p}", "Seguidores de siempre"),
]
AD_FORMATS = [
    ("Video (demo)", "Meta Ads"), ("Imagen estática", "Meta Ads"), ("Carrusel", "Meta Ads"), ("Video UGC", "TikTok Ads"),
    ("Video In-Feed", "TikTok Ads"), ("Short", "YouTube Shorts"), ("Reel", "Instagram"), ("VSL", "Landing / YouTube"),
    ("GIF", "Meta / Email"), ("Banner", "Display / Web"),
]
AD_TEXTS = ["{hook}\n{b0}. {b1}. {b2}. Hoy {price}", "Se nota la diferencia: {b0}\nSin {pain}", "Cinco razones para {p}",
            "{hook} #descubrimiento", "{hook} Solo esta semana", "{hook}", "{b0}. Enlace en el perfil",
            "Guion largo en el módulo de guiones", "Un instante: {wow}", "Tu {p} te espera"]
# Description, button, measures and working note of each ad.
AD_NOTES = [
    ("Rodaje en una mañana, {price} a la vista", "Comprar ahora", "Cuadrado o 4:5, medio minuto", "Tres aperturas distintas sobre la misma demo de {p}"),
    ("Dos mitades, una frase", "Ver más", "1080 de lado", "Que se entienda sin leer: {b0}"),
    ("Una tarjeta por motivo", "Comprar ahora", "Cinco tarjetas iguales", "La última tarjeta dice {price}"),
    ("Móvil en mano y luz de ventana", "Comprar ahora", "Vertical, veinte segundos", "Lo graba alguien de {aud}"),
    ("Directo al precio", "Comprar ahora", "Vertical, doce segundos", "Cambiar solo el primer plano entre versiones"),
    ("Voz tranquila sobre {demo}", "Suscribirse", "Vertical, menos de un minuto", "Cerrar en bucle con {wow}"),
    ("Detrás de la escena en {env}", "Enviar mensaje", "Vertical con subtítulos", "Responder comentarios con otro reel"),
    ("Relato completo", "Ver el video", "Horizontal, tres minutos", "Repetir {b1} hacia la mitad"),
    ("Tres segundos sin sonido", "Ver oferta", "600 de ancho, poco peso", "Abrir el correo con {wow}"),
    ("Recordatorio sereno", "Volver a la tienda", "300x250 y 728x90", "Solo para quien vio {p} y no compró"),
]
# Pieces per phase with priority and platform (counts sum to 20, 11 and 11).
PLAN_PHASES = [
    ("Semana 1", "Probar ángulos", [
        (3, "Videos UGC", "Alta", "TikTok"), (8, "Hooks en video", "Alta", "TikTok / Reels"), (5, "Imágenes estáticas", "Media", "Meta"),
        (2, "Carruseles", "Media", "Meta"), (2, "Memes", "Baja", "TikTok / IG")]),
    ("Semana 2", "Repetir lo que gana", [
        (4, "Variaciones del video ganador", "Alta", "El canal ganador"), (2, "UGC con nuevas personas", "Alta", "TikTok"),
        (1, "Video de 45-60s", "Media", "Meta / YouTube"), (3, "Thumbnails nuevos", "Media", "Shorts"),
        (1, "Story interactiva", "Baja", "Instagram")]),
    ("Semana 3-4", "Escalar", [
        (1, "VSL de 2-3 min", "Alta", "Landing / Meta"), (4, "UGC de mantenimiento", "Alta", "TikTok / Meta"),
        (2, "Carruseles de objeciones", "Media", "Meta"), (3, "Banners de remarketing", "Media", "Display / Email"),
        (1, "Colaboración con micro-influencer", "Media", "TikTok")]),
]
PLAN_NOTES = {"Alta": "Grabar {p} antes del miércoles", "Media": "Reusar tomas de {demo}", "Baja": "Si sobra una tarde"}
# Element, icon, number of variants, metric.
AB_ELEMENTS = [
    ("Hooks", "🪝", 50, "Retención a 3 segundos"), ("CTAs", "👆", 20, "CTR del botón"), ("Thumbnails", "🖼️", 20, "CTR de impresión"),
    ("Intros (primeros 3s)", "🎬", 15, "Retención al 25%"), ("Finales", "🏁", 10, "Clic al perfil"),
]
AB_PARTS = {
    "CTAs": (["Comprar", "Ver oferta", "Lo quiero", "Probar", "Pedir"], ["hoy", "ya mismo", "sin riesgo", "con envío"]),
    "Thumbnails": (["Cara y {p}", "{p} gigante", "Texto: {n} días", "${m} tachado por ${lo}", "Detalle de {cat}"],
                   ["con flecha", "fondo oscuro", "mitad y mitad", "zoom"]),
    "Intros (primeros 3s)": (["Abre con el resultado", "Abre con la pregunta", "Abre con el sonido", "Abre con la caja", "Abre con el error"],
                             ["en silencio", "a cámara", "en detalle"]),
    "Finales": (["Cierra con oferta", "Cierra con pregunta", "Cierra en bucle", "Cierra con reseña", "Cierra con {p}"], ["y texto", "y voz"]),
}
# Concept, headline, colours, style, layout.
THUMBNAILS = [
    ("Reacción", "¿Lo viste?", ["#1D4ED8", "#F8FAFC", "#FB7185"], "Ceja levantada, fondo liso", "Rostro a la izquierda, {p} en la mano"),
    ("Antes y después", "Semana {n}", ["#065F46", "#FDE68A", "#0F172A"], "Diagonal que parte la imagen", "Arriba lo de antes, abajo lo de ahora"),
    ("Precio", "De ${m} a ${lo}", ["#7C2D12", "#FFEDD5", "#15803D"], "Etiqueta de mercadillo", "Cifra grande y {p} debajo"),
    ("Prohibido", "Antes de pagar, mira", ["#4C1D95", "#FAFAF9", "#F97316"], "Sello de tinta", "Texto cruzado sobre {p}"),
    ("Momento clave", "Justo aquí: {wow}", ["#0E7490", "#ECFEFF", "#BE123C"], "Instante detenido", "Detalle ampliado en un círculo"),
    ("Ventas", "{n}.000 en casa", ["#3F6212", "#F7FEE7", "#A16207"], "Contador mecánico", "Números arriba, {p} en fila"),
]
# Search links; {q} is the encoded product, {qcat} the encoded first word of the category.
LINKS = [
    ("TikTok", "Creative Center", "https://ads.tiktok.com/business/creativecenter/inspiration/topads/pc/en?keyword={q}"),
    ("TikTok", "Búsqueda orgánica", "https://www.tiktok.com/search?q={q}"),
    ("Facebook", "Ad Library", "https://www.facebook.com/ads/library/?active_status=active&ad_type=all&country=ALL&q={q}&media_type=all"),
    ("Instagram", "Búsqueda", "https://www.instagram.com/explore/search/keyword/?q={q}"),
    ("Pinterest", "Pines", "https://www.pinterest.com/search/pins/?q={q}"),
    ("YouTube", "Reseñas", "https://www.youtube.com/results?search_query={q}+review"),
    ("Google", "Tendencias", "https://trends.google.com/trends/explore?q={qcat}"),
    ("AliExpress", "Más vendidos", "https://www.aliexpress.com/wholesale?SearchText={q}&SortType=total_tranpro_desc"),
]
#: So many angles and objections are drawn for a product.
SHOWN = 6
DRAWN_GROUPS = ["angles", "objections"]
# Name, emotion, big idea.
SALES_ANGLES = [("Minutos devueltos", "Calma", "{b0}: el reloj trabaja para {auds}"), ("Oficio en casa", "Orgullo", "Manos propias y {p}"),
                ("Regalo con historia", "Ternura", "Alguien de {auds} lo abre y sonríe"), ("Cuentas claras", "Control", "{price} repartidos en un año"),
                ("Menos trastos", "Ligereza", "{p} ocupa el sitio de tres cosas"), ("Prueba a ciegas", "Sorpresa", "Sin marca a la vista: {wow}"),
                ("Temporada corta", "Ilusión", "Lo que {cat} pide este mes"), ("Voz de barrio", "Confianza", "Lo cuenta quien vive en {env}")]
OBJECTIONS = [("Tengo algo parecido", "Ponlos juntos sobre la mesa"), ("No sé si cabrá", "Medidas con una moneda al lado"), ("Suena a moda", "Enseña {p} tras un año"),
              ("Me da pereza aprender", "Manual de una línea: {b0}"), ("¿Y si se rompe?", "Recambios y quien los cambia"), ("Mi pareja dirá que no", "Que {auds} lo prueben antes"),
              ("Prefiero la tienda", "Recogida cerca de casa"), ("Lo dejo para luego", "Guardar el precio una semana")]
DIFFERENTIATORS = ["{p} cabe en un cajón", "Se explica con un gesto: {demo}", "{b0} desde el primer uso", "Lo comparten {auds}", "Recambios sueltos"]
FAQ = [("¿De qué está hecho?", "De lo que se ve: abre {p} y compruébalo"), ("¿Hace ruido?", "Menos que una conversación"), ("¿Cómo se limpia?", "Con un paño y agua tibia"),
       ("¿Se puede llevar de viaje?", "Cabe en equipaje de mano"), ("¿Quién responde si falla?", "Una persona, por correo, en dos días"), ("¿Trae repuesto?", "Uno dentro de la caja")]
LANDING_CTAS = ["Ver {p} por dentro", "Reservar a {price}", "Hablar con el taller", "Recibir las medidas", "Elegir color"]
COMPARISON = [("Montaje", "Dos piezas", "Caja de herramientas"), ("Espacio", "Un cajón", "Media estantería"), ("Ruido", "Apenas", "Se oye en el pasillo"),
              ("Arreglo", "Pieza suelta", "Comprar otro"), ("Coste al año", "{price}", "Cuotas")]
REVIEW_NAMES = ["Ana B.", "Luis C.", "Marta D.", "Hugo E.", "Sara F.", "Iván G.", "Nora H.", "Raúl I."]
REVIEW_TEXTS = ["Me sorprendió: {benefit}", "Lo uso a diario, {desire}", "Tal como en el video", "Lo he recomendado"]
GROWTH = ["Publica a diario", "Prueba ocho ganchos", "Responde con video", "Amplifica lo que supere el 10%", "Guarda las objeciones"]

COLUMNS = ["module", "item_group", "ord", "title", "text", "detail", "lo", "hi", "lo2", "hi2", "attrs"]


def _combine(parts, n: int) -> list[str]:
    """First n combinations, moving through the first list fastest."""
    heads, tails = parts
    return [f"{h}: {t}" for t, h in product(tails, heads)][:n]


class _Module:
    def __init__(self, name: str):
        self.name, self.rows = name, []

    def add(self, group: str, title: str, text: str, detail: str = "", ints=(7, 30, 80, 300), **attrs):
        self.rows.append(dict(zip(COLUMNS, [
            self.name, group, len(self.rows) + 1, title, text, detail, *ints, {k: str(v) for k, v in attrs.items()}])))


def _intelligence() -> list:
    m = _Module("intelligence")
    for name, emotion, idea in SALES_ANGLES:
        m.add("angles", name, "Ángulo de {p}: " + name.lower(), emotion, emotion=emotion, idea=idea)
    for q, a in OBJECTIONS:
        m.add("objections", q, a)
    for d in DIFFERENTIATORS:
        m.add("differentiators", d.split(" ")[0], d)
    return m.rows


def _hooks() -> list:
    m = _Module("hooks")
    for group, emoji, n in HOOK_GROUPS:
        for text in _combine(HOOK_PARTS[group], n):
            m.add(group, group, text, emoji=emoji)
    return m.rows


def _ads() -> list:
    m = _Module("ads")
    for (fmt, platform), text, (description, cta, specs, notes) in zip(AD_FORMATS, AD_TEXTS, AD_NOTES, strict=True):
        m.add(platform, f"{platform} · {fmt}", text, "{p} — {b0}", format=fmt, platform=platform, cta=cta, description=description, specs=specs, notes=notes)
    return m.rows


def _scripts() -> list:
    m = _Module("scripts")
    for angle, (duration, label) in product(ANGLES, DURATIONS):
        m.add(duration, f"{angle} — {label}", "{anglehook}", "{cta}", angle=angle, duration=duration)
    return m.rows


def _beats() -> list:
    m = _Module("beats")
    for script, (angle, (duration, _)) in enumerate(product(ANGLES, DURATIONS), start=1):
        for i, (time, label, voice, visual) in enumerate(BEATS[duration], start=1):
            m.add(duration, label, voice, visual, (3, 21, 3, 6), angle=angle, time=time, script=script, beat=i)
    return m.rows


def _visual() -> list:
    m = _Module("visual")
    sets = [("Storyboard A", ["Gesto de cansancio: {pain}", "{person} descubre {p}", "Macro de {p}", "Resultado", "{person} sonríe", "{env} renovado"]),
            ("Storyboard B", ["Pantalla partida", "{n} minutos a mano", "{m} segundos con {p}", "{person} mira a cámara", "{p} por {price}"]),
            ("Storyboard C", ["Caja abierta", "{p} en la mano", "{person} lo prueba", "Sorpresa", "Veredicto de {person}"])]
    for (title, scenes), concept in zip(sets, STORY_CONCEPTS, strict=True):
        for i, scene in enumerate(scenes, start=1):
            at = lambda values: values[(i + len(scenes)) % len(values)]
            m.add(title, title, scene, "Escena {p}", (10, 25, 8, 40), n=i, duration=f"{2 + i % 3}s", concept=concept, subject="{person}" if i % 2 else "{p}",
                  shot=at(SHOTS), expression=at(EXPRESSIONS), light=at(LIGHTS), movement=at(MOVES), audio=at(SOUNDS))
    return m.rows


def _prompts(module: str, tools, styles, settings) -> list:
    m = _Module(module)
    for (tool, n), (sentence, meta) in zip(tools, settings, strict=True):
        for i in range(n):
            style = styles[i]
            m.add(tool, f"{style.capitalize()} {i + 1}", sentence.replace("*", style), "{wow}", tool=tool, meta=meta)
    return m.rows


def _ugc() -> list:
    m = _Module("ugc")
    for (persona, emoji), (profile, tone, setting, wardrobe) in zip(PERSONAS, PERSONA_NOTES, strict=True):
        m.add(persona, f"{persona}: {{n}} semanas con {{p}}", "Vivía {pain}. Con {p}: {b0}. También {b1}.", "{b0}", (2, 8, 15, 45), emoji=emoji,
              profile=profile, tone=tone, setting=setting, wardrobe=wardrobe)
    return m.rows


def _landing() -> list:
    m = _Module("landing")
    m.add("headline", "{opening}", "{opening} desde el primer día", "")
    m.add("subheadline", "{p}", "{p} acaba con {pain}", "")
    for i in range(5):
        m.add("benefits", "beneficio", f"{{b{i}}}", "{p} lo hace posible")
    for q, a in FAQ:
        m.add("faq", q, a)
    for c in LANDING_CTAS:
        m.add("ctas", c, c)
    for feature, us, them in COMPARISON:
        m.add("comparison", feature, us, them)
    for i in range(4):
        m.add("reviews", f"{{review{i}}}", REVIEW_TEXTS[i], "Compra verificada hace {n} días", (2, 30, 0, 0), stars=4 if i == 2 else 5)
    m.add("guarantee", "Garantía", "Treinta días para probar {p}", "")
    return m.rows


def _offers() -> list:
    m = _Module("offers")
    for kind, (name, structure, example, best) in zip(OFFER_TYPES, OFFER_NOTES, strict=True):
        m.add(kind, kind, "{p}: {offer}", "{price}", name=name, structure=structure, example=example, best_for=best)
    return m.rows


def _planner() -> list:
    m = _Module("planner")
    for week, goal, items in PLAN_PHASES:
        for count, kind, priority, platform in items:
            m.add(week, kind, goal, "", count=count, priority=priority, platform=platform, notes=PLAN_NOTES[priority])
    return m.rows


def _abtests() -> list:
    """The four fixed elements; the hook element is sampled from the hooks module."""
    m = _Module("abtesting")
    for element, emoji, n, metric in AB_ELEMENTS[1:]:
        for text in _combine(AB_PARTS[element], n):
            m.add(element, element, text, metric, emoji=emoji)
    return m.rows


def _thumbnails() -> list:
    m = _Module("thumbnails")
    for concept, headline, colors, style, layout in THUMBNAILS:
        m.add(concept, concept, headline, "Miniatura de {p}", (10, 60, 150, 400), colors=",".join(colors), style=style, layout=layout,
              prompt=f"Miniatura 1280x720 de {{p}} en {{env}}, {style.lower()}")
    return m.rows


def _library() -> list:
    m = _Module("library")
    for platform, name, url in LINKS:
        m.add(platform, name, url, "", platform=platform, note=f"Buscar {{p}} en {platform} y anotar qué se repite")
    return m.rows


def _growth() -> list:
    m = _Module("viral")
    for line in GROWTH:
        m.add("recommendations", "Consejo", line)
    return m.rows


BUILTIN = {
    "intelligence": _intelligence(), "hooks": _hooks(), "ads": _ads(), "scripts": _scripts(), "beats": _beats(),
    "visual": _visual(), "imageprompts": _prompts("imageprompts", TOOLS_IMAGE, IMAGE_STYLES, IMAGE_SETTINGS),
    "videoprompts": _prompts("videoprompts", TOOLS_VIDEO, VIDEO_STYLES, VIDEO_SETTINGS), "ugc": _ugc(), "landing": _landing(),
    "offers": _offers(), "planner": _planner(), "abtesting": _abtests(), "thumbnails": _thumbnails(),
    "library": _library(), "viral": _growth(),
}
