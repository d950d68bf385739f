"""Plans, module entitlements and action costs."""

# Id, name, monthly price in USD, monthly credits, monthly campaign limit, rank.
PLANS = [
    ("free", "Gratis", 0, 10, 1, 0),
    ("premium", "Premium", 10, 100, 10, 1),
    ("max", "Max", 20, 500, 50, 2),
]
DEFAULT_PLAN = "free"

# Feature lines per plan: what is included comes from the modules and limits above.
FEATURES = {
    "free": [("Campañas de prueba", True), ("Módulos de análisis", True), ("Módulos de producción", False),
             ("Módulos de escala", False)],
    "premium": [("Campañas para cada semana", True), ("Módulos de análisis", True), ("Módulos de producción", True),
                ("Módulos de escala", False)],
    "max": [("Campañas para equipos", True), ("Módulos de análisis", True), ("Módulos de producción", True),
            ("Módulos de escala", True)],
}

# Credits charged per action.
ACTION_COSTS = {"campaign": 10, "competitor": 5, "iteration": 5}

# Module id, name, group, lowest plan that includes it.
MODULES = [
    ("overview", "Resumen de campaña", "Campaña", "free"),
    ("intelligence", "Product Intelligence", "Análisis", "free"),
    ("score", "Creative Score", "Análisis", "free"),
    ("viral", "Viral Predictor", "Análisis", "premium"),
    ("competitor", "Competitor Analyzer", "Análisis", "max"),
    ("hooks", "Hook Generator", "Generación", "free"),
    ("ads", "Ad Generator", "Generación", "premium"),
    ("scripts", "Script Generator", "Generación", "premium"),
    ("visual", "Visual Generator", "Generación", "max"),
    ("imageprompts", "AI Image Prompts", "Generación", "max"),
    ("videoprompts", "AI Video Prompts", "Generación", "max"),
    ("ugc", "UGC Generator", "Generación", "premium"),
    ("thumbnails", "Thumbnail Generator", "Generación", "premium"),
    ("landing", "Landing Copy", "Conversión", "premium"),
    ("offers", "Offer Builder", "Conversión", "premium"),
    ("planner", "Creative Planner", "Estrategia", "max"),
    ("abtesting", "A/B Testing", "Estrategia", "max"),
    ("iteration", "Creative Iteration", "Estrategia", "max"),
    ("library", "Creative Library", "Estrategia", "free"),
    ("export", "Exportar campaña", "Campaña", "premium"),
]

RANK = {p[0]: p[5] for p in PLANS}
CREDITS = {p[0]: p[3] for p in PLANS}
CAMPAIGN_LIMIT = {p[0]: p[4] for p in PLANS}
MAX_CREDITS = max(CREDITS.values())
MAX_CAMPAIGNS = max(CAMPAIGN_LIMIT.values())

# (plan, module) pairs by rank: at most plans x modules rows, so always a tiny static table.
PLAN_MODULES = [(p[0], i, *m) for p in PLANS for i, m in enumerate(MODULES) if p[5] >= RANK[m[3]]]
PLAN_LOCKED = [
    (p[0], m[0], m[1], m[3], next(q[2] for q in PLANS if q[0] == m[3]))
    for p in PLANS for m in MODULES if p[5] < RANK[m[3]]
]

# Subscription statuses that keep a paid plan, and those that end it.
PAID_STATUSES = ["active", "trialing"]
ENDED_STATUSES = ["canceled", "unpaid", "incomplete_expired"]
