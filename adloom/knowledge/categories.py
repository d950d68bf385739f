"""Category knowledge base.

Ids, names, price bands and 1-5 ratings are fixed values. All prose lists are built from a few
seed phrases per category and shared sentence patterns, and the whole base can be replaced by a
JSON file of the same shape (see ``load_categories``).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

# Upper bound for a knowledge base that is inlined into plans or broadcast.
MAX_CATEGORIES = 1_000
MAX_KEYWORDS = 5_000


@dataclass(frozen=True)
class Category:
    id: str
    name: str
    keywords: list
    problem: str
    secondary_problems: list
    benefits: list
    desires: list
    fears: list
    audiences: list  # [{"name", "description", "pains": [..3..]}]
    visual_hooks: list
    environment: str
    demo_action: str
    wow_moment: str
    price_lo: int
    price_hi: int
    saturation: int
    visual_appeal: int
    explainability: int
    ugc_fit: int


# Id, name, (price lo, hi), (saturation, visual appeal, explainability, ugc fit).
RATINGS = [
    ("cocina", "Cocina y gadgets de cocina", (19, 49), (4, 5, 5, 5)),
    ("hogar", "Hogar y organización", (15, 59), (3, 5, 5, 5)),
    ("belleza", "Belleza y cuidado de la piel", (25, 89), (5, 5, 4, 5)),
    ("fitness", "Fitness y deporte", (29, 99), (4, 4, 4, 5)),
    ("mascotas", "Mascotas", (19, 69), (3, 5, 5, 5)),
    ("tecnologia", "Tecnología y gadgets", (25, 99), (4, 4, 4, 4)),
    ("bebe", "Bebés y maternidad", (22, 79), (2, 4, 5, 5)),
    ("moda", "Moda y accesorios", (24, 79), (4, 5, 5, 5)),
    ("salud", "Salud y bienestar", (29, 89), (3, 3, 4, 5)),
    ("auto", "Auto y motos", (19, 69), (2, 4, 4, 4)),
    ("oficina", "Oficina y productividad", (22, 79), (2, 4, 4, 4)),
    ("general", "Producto general", (19, 59), (3, 4, 4, 4)),
]

# Seeds per category: place, task, nuisance, achievement, three audiences, keywords.
SEEDS = {
    "cocina": ("la encimera de casa", "preparar la cena", "restos y cacharros por todas partes",
               "un plato digno de foto", ("Cocineros novatos", "Familias con prisa", "Amantes de la repostería"),
               "plate cuchara horno receta sarten batidora tostadora cocina kitchen cooking teapot wok"),
    "hogar": ("el salón", "ordenar la casa", "trastos que no tienen sitio",
              "una habitación despejada", ("Inquilinos de piso pequeño", "Parejas que se mudan", "Fans del orden"),
              "rod estanteria perchero cajon lampara manta cojin hogar household shelf drawer curtain"),
    "belleza": ("el tocador", "cuidarse la piel", "productos que irritan",
                "una piel luminosa", ("Principiantes del skincare", "Pieles sensibles", "Aficionadas al maquillaje"),
                "serum crema maquillaje labial pestana brocha mascarilla belleza beauty lipstick skincare"),
    "fitness": ("el rincón de entrenar", "entrenar sin excusas", "agujetas y falta de constancia",
                "una rutina que se mantiene", ("Corredores de fin de semana", "Gente que entrena en casa", "Quienes vuelven tras una lesión"),
                "gear mancuerna pesas yoga correr entreno gimnasio fitness workout dumbbell running"),
    "mascotas": ("el rincón de la mascota", "cuidar de la mascota", "pelos y juguetes rotos",
                 "una mascota tranquila", ("Dueños de cachorros", "Hogares con gatos", "Paseadores urbanos"),
                 "perro gato collar correa pienso arenero mascota puppy kitten leash aquarium"),
    "tecnologia": ("la mesa de trabajo", "conectar los aparatos", "cables y baterías agotadas",
                   "un equipo siempre listo", ("Teletrabajadores", "Viajeros frecuentes", "Curiosos de los gadgets"),
                   "widget gizmo cargador auricular teclado bateria movil drone gadget usb bluetooth camera"),
    "bebe": ("el cuarto del bebé", "dormir al bebé", "noches en vela",
             "una siesta completa", ("Padres primerizos", "Familias numerosas", "Abuelos cuidadores"),
             "bebe biberon panal cuna carrito chupete maternidad stroller pacifier diaper"),
    "moda": ("el armario", "elegir qué ponerse", "prendas que no combinan",
             "un conjunto con estilo", ("Compradores de temporada", "Minimalistas", "Quienes visten formal a diario"),
             "ring vestido camisa zapato bolso reloj collarin pulsera moda fashion jacket sneaker"),
    "salud": ("el dormitorio", "descansar bien", "molestias que no se van",
              "un descanso profundo", ("Personas con estrés", "Mayores activos", "Quienes pasan el día sentados"),
              "masaje espalda postura dolor sueno vitamina salud wellness massager pillow relax"),
    "auto": ("el coche", "mantener el coche a punto", "averías en mal momento",
             "un coche impecable", ("Conductores diarios", "Moteros", "Familias viajeras"),
             "bolt coche moto neumatico volante parabrisas aspirador auto vehicle tire dashcam"),
    "oficina": ("el escritorio", "terminar las tareas", "papeles y distracciones",
                "una jornada productiva", ("Autónomos", "Estudiantes de oposición", "Jefes de equipo"),
                "anvil escritorio agenda boligrafo cuaderno silla grapadora oficina office stapler planner notebook"),
    "general": ("cualquier lugar", "resolver lo cotidiano", "soluciones a medias",
                "un día más sencillo", ("Compradores prácticos", "Buscadores de regalos", "Curiosos de las novedades"),
                ""),
}

# Further keywords per category: things, rooms and verbs of its trade, in Spanish and English.
MORE_KEYWORDS = {
    "cocina": "cazuela rallador colador espatula tabla mortero exprimidor hervidor freidora cuchillo pelador molde bandeja especiero delantal whisk skillet ladle grater pantry baking oven spoon",
    "hogar": "alfombra cortina jarron vela espejo zapatero tendedero escalera enchufe bombilla persiana edredon almohadon cesto repisa humidificador blanket candle vase carpet closet broom",
    "belleza": "colonia perfume rizador plancha alisador peine esmalte lima tonico exfoliante rimel sombra colorete bruma jabon nailpolish mascara blush toner cleanser fragrance hairdryer",
    "fitness": "kettlebell banda esterilla cuerda saltar barra disco guante rodillera tobillera pilates spinning zancada pulsometro bidon treadmill squat jumprope cardio stretch barbell gym",
    "mascotas": "pecera jaula hamster canario conejo acuario arnes transportin comedero bebedero rascador cepillado veterinario pajaro tortuga doghouse birdcage catnip litter paws feeder hamsters",
    "tecnologia": "router pantalla altavoz microfono proyector consola mando cable adaptador tableta portatil impresora sensor chip robot smartwatch headphones charger keyboard monitor speaker webcam",
    "bebe": "sonajero gateo mordedor babero trona hamaca nana cambiador mochila lactancia termometro peluche andador mobil doudou crib rattle bottle nursery teether swaddle babywear",
    "moda": "falda pantalon bufanda gorra cinturon calcetin sandalia bota abrigo chaqueta corbata pendiente anillo collarcito tirante scarf necklace earring dress belt handbag sunglasses",
    "salud": "insomnio ansiedad faja ortesis plantilla inhalador tension glucosa balsamo infusion aromaterapia meditar acupuntura rodillo cervical posture therapy sleep herbal insole heating migraine",
    "auto": "llanta freno bujia casco guantera retrovisor remolque aceite anticongelante limpiaparabrisas matricula maletero motor diesel garaje windshield helmet mirror engine carwash jack seatcover",
    "oficina": "carpeta archivador pizarra subrayador calculadora atril reposapies lampara-flexo sobre tampon clip rotulador tarjetero perforadora monitorarm desk folder pencil whiteboard ergonomic printer marker",
}

SECONDARY_PATTERNS = [
    "{Task} roba más tiempo del previsto",
    "En {place} siempre acaba habiendo {nuisance}",
    "Las opciones conocidas prometen {goal} y se quedan cortas",
    "Nadie explica cómo {task} con poco presupuesto",
    "Cada intento fallido quita las ganas de {task}",
]
BENEFIT_PATTERNS = [
    "Rapidez: permite {task} en la mitad de tiempo",
    "Orden: adiós a {nuisance}",
    "Logra {goal} a la primera",
    "Ocupa poco en {place}",
    "Sencillez: nadie necesita manual",
    "Aguanta el uso diario",
    "Se amortiza en pocas semanas",
    "Regalo seguro: quien lo prueba busca {goal}",
]
DESIRE_PATTERNS = [
    "conseguir {goal}",
    "{task} sin agobios",
    "disfrutar de {place}",
    "olvidarse de {nuisance}",
    "presumir de {goal} con los amigos",
]
FEAR_PATTERNS = [
    "volver a convivir con {nuisance}",
    "gastar sin llegar a {goal}",
    "no saber {task}",
    "arrepentirse de la compra",
]
PAIN_PATTERNS = [
    "{nuisance} cada semana",
    "no encontrar hueco para {task}",
    "ver lejos {goal}",
]
AUDIENCE_ANGLE = ["buscan resultados rápidos", "comparan antes de pagar", "compran por recomendación"]
VISUAL_PATTERNS = [
    "plano cenital de {place}", "primer plano del gesto de {task}", "montaje acelerado hasta {goal}",
    "contraste con {nuisance}", "reacción al ver {goal}", "detalle de textura y sonido",
]


def _fill(pattern: str, seeds: dict) -> str:
    return pattern.format(**seeds)


def _audience(i: int, name: str, seeds: dict) -> dict:
    return {
        "name": name,
        "description": f"{AUDIENCE_ANGLE[i].capitalize()} para {seeds['task']}",
        "pains": [f"{_fill(p, seeds)} ({name.lower()})" if i else _fill(p, seeds) for p in PAIN_PATTERNS],
    }


def _build(rating) -> Category:
    cid, name, (lo, hi), (sat, visual, explain, ugc) = rating
    place, task, nuisance, goal, audiences, words = SEEDS[cid]
    s = {"place": place, "task": task, "Task": task.capitalize(), "nuisance": nuisance, "goal": goal}
    each = lambda patterns: [_fill(p, s) for p in patterns]
    return Category(
        id=cid, name=name, keywords=words.split() + MORE_KEYWORDS.get(cid, "").split(),
        problem=f"{task.capitalize()} cuesta demasiado, y {nuisance} lo empeora",
        secondary_problems=each(SECONDARY_PATTERNS), benefits=each(BENEFIT_PATTERNS),
        desires=each(DESIRE_PATTERNS), fears=each(FEAR_PATTERNS),
        audiences=[_audience(i, a, s) for i, a in enumerate(audiences)],
        visual_hooks=each(VISUAL_PATTERNS), environment=place,
        demo_action=f"{task} delante de la cámara", wow_moment=f"el segundo en que aparece {goal}",
        price_lo=lo, price_hi=hi, saturation=sat, visual_appeal=visual, explainability=explain, ugc_fit=ugc,
    )


BUILTIN = [_build(r) for r in RATINGS]


def load_categories(path: str | None = None) -> list[Category]:
    """The built-in base, or one read from a JSON array of category objects.

    List order is the tie-break order and the last entry is the default category. The size is
    checked because the base is inlined into plans.
    """
    if path is None:
        return BUILTIN
    names = {f.name for f in fields(Category)}
    rows = [Category(**{k: v for k, v in r.items() if k in names}) for r in json.loads(Path(path).read_text())]
    check_size(rows)
    return rows


def check_size(rows: list[Category]) -> None:
    if not rows or len(rows) > MAX_CATEGORIES:
        raise ValueError(f"a knowledge base needs 1..{MAX_CATEGORIES} categories, got {len(rows)}")
    if (n := sum(len(r.keywords) for r in rows)) > MAX_KEYWORDS:
        raise ValueError(f"{n} keywords; above {MAX_KEYWORDS} use detect_category_by_automaton with a keyword table")


def as_rows(rows: list[Category]) -> list[dict]:
    """Plain dicts with the order column used for ties."""
    return [asdict(r) | {"ord": i} for i, r in enumerate(rows)]
