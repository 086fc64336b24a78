"""Fixed values of the domain's language: codes and their names, synonyms, and the words that questions are read by.

They are data, not rules: results depend on each of them as it stands.
"""

from __future__ import annotations

from tally.plans.roles import ATTEMPT, COMPLETE, DISMANTLED, LOADED

#: Codes of items and the names they are shown by. Fixed values.
DISPLAY_NAMES = {
    "2d6": "2de6",
    "2d6s": "2de6s",
    "2d7": "2de7",
    "2d8": "2de8",
    "2d8f": "2de8f",
    "2d9f": "2de9f",
    "2d9fm": "2de9fm",
    "3d10fm": "3de10fm",
    "3d6": "3de6",
    "3d6a": "3de6p",
    "3d6s": "3de6s",
    "3d7": "3de7",
    "3d7a": "3de7p",
    "3d7s": "3de7s",
    "3d8": "3de8",
    "3d8a": "3de8p",
    "3d8s": "3de8s",
    "3d9": "3de9",
    "3d9f": "3de9f",
    "3d9af": "3de9fp",
    "4d10fm": "4de10fm",
    "4d6": "4de6",
    "4d6a": "4de6p",
    "4d7": "4de7",
    "4d7a": "4de7p",
    "4d8": "4de8",
    "4d8a": "4de8p",
    "4d9": "4de9",
    "4d9f": "4de9f",
    "4d9af": "4de9fp",
    "5d6": "5de6",
    "5d6a": "5de6p",
    "5d7": "5de7",
    "5d7a": "5de7p",
    "5d8": "5de8",
    "5d8a": "5de8p",
    "5d9f": "5de9f",
    "7d6": "7de6",
    "7d6a": "7de6p",
    "7d7": "7de7",
    "7d7a": "7de7p",
    "7d8": "7de8",
    "7d8a": "7de8p",
    "7d9f": "7de9f",
    "9d6": "9de6",
    "9d7": "9de7",
    "9d8": "9de8",
    "9d9f": "9de9f",
    "Pd4": "Pde4",
    "Pd5": "Pde5",
    "Pd6": "Pde6",
    "Pd7f": "Pde7f",
    "Pd8fm": "Pde8fm",
    "Pd9fmp": "Pde9fmp",
}

#: What people write for a code. Fixed values.
SYNONYMS = {
    "3d9fp": "3d9af",
    "3d9 amb folre i pilar": "3d9af",
    "3d9 amb folre i agulla": "3d9af",
    "4d9fp": "4d9af",
    "4d9 amb folre i pilar": "4d9af",
    "4d9 amb folre i agulla": "4d9af",
    "3d9pf": "3d9af",
    "4d9pf": "4d9af",
    "3d9fa": "3d9af",
    "4d9fa": "4d9af",
    "3d9sf": "3d9",
    "4d9sf": "4d9",
    "2d8sf": "2d8",
    "2d8 net": "2d8",
    "2d8 sense folre": "2d8",
    "4d9 net": "4d9",
    "4d9 sense folre": "4d9",
    "Pd7sf": "Pd7",
    "Pilar de 7 sense folre": "Pd7",
    "2d9sm": "2d9f",
    "2d9 sense manilles": "2d9f",
    "3de9fp": "3d9af",
    "4de9fp": "4d9af",
    "3de9pf": "3d9af",
    "4de9pf": "4d9af",
    "3de9fa": "3d9af",
    "4de9fa": "4d9af",
    "3de9df": "3d9",
    "4de9df": "4d9",
    "2de8f": "2d8",
    "2de8 net": "2d8",
    "4de9 net": "4d9",
    "3de10": "3d10fm",
    "Pde7sf": "Pd7",
    "2de9sm": "2d9f",
    "4d8p": "4d8a",
    "3d8p": "3d8a",
    "5d8p": "5d8a",
    "7d8p": "7d8a",
    "4de8p": "4d8a",
    "4d8 amb agulla": "4d8a",
    "4d8 amb pilar": "4d8a",
    "3de8p": "3d8a",
    "3d8 amb agulla": "3d8a",
    "3d8 amb pilar": "3d8a",
    "5de8p": "5d8a",
    "7de8p": "7d8a",
    "4d7p": "4d7a",
    "3d7p": "3d7a",
    "5d7p": "5d7a",
    "7d7p": "7d7a",
    "4de7p": "4d7a",
    "4d7 amb agulla": "4d7a",
    "4d7 amb pilar": "4d7a",
    "3de7p": "3d7a",
    "3d7 amb agulla": "3d7a",
    "3d7 amb pilar": "3d7a",
    "5de7p": "5d7a",
    "7de7p": "7d7a",
    "4d6p": "4d6a",
    "3d6p": "3d6a",
    "5d6p": "5d6a",
    "7d6p": "7d6a",
    "4de6p": "4d6a",
    "4d6 amb agulla": "4d6a",
    "4d6 amb pilar": "4d6a",
    "3de6p": "3d6a",
    "3d6 amb agulla": "3d6a",
    "3d6 amb pilar": "3d6a",
    "5de6p": "5d6a",
    "7de6p": "7d6a",
    "5d8 amb agulla": "5d8a",
    "5d8 amb pilar": "5d8a",
    "3d6ps": "3d6s",
    "3d7ps": "3d7s",
    "3d8ps": "3d8s",
    "3de6ps": "3d6s",
    "3de7ps": "3d7s",
    "3de8ps": "3d8s",
    "pd4ps": "Pd4s",
    "Pd5ps": "Pde5s",
    "Pd6ps": "Pde6s",
    "carro gros": "4d8",
    "super caterdal": "5d9f",
}

#: Words for outcomes, in the order in which they are sought. Fixed values.
STATUS_WORDS = [
    ("descarregat", COMPLETE),
    ("descarregats", COMPLETE),
    ("descarregada", COMPLETE),
    ("descarregades", COMPLETE),
    ("carregat", LOADED),
    ("carregats", LOADED),
    ("carregada", LOADED),
    ("carregades", LOADED),
    ("intent", ATTEMPT),
    ("intents", ATTEMPT),
    ("intent desmuntat", DISMANTLED),
    ("intents desmuntats", DISMANTLED),
    ("intent desmuntats", DISMANTLED),
    ("desmuntat", DISMANTLED),
    ("desmuntats", DISMANTLED),
    ("desmuntada", DISMANTLED),
    ("desmuntades", DISMANTLED),
    ("fallat", DISMANTLED),
    ("fallats", DISMANTLED),
    ("fallada", DISMANTLED),
    ("fallades", DISMANTLED),
    ("aconseguit", COMPLETE),
    ("aconseguits", COMPLETE),
    ("aconseguida", COMPLETE),
    ("aconseguides", COMPLETE),
    ("completat", COMPLETE),
    ("completats", COMPLETE),
    ("completada", COMPLETE),
    ("completades", COMPLETE),
    ("fet", COMPLETE),
    ("fets", COMPLETE),
    ("feta", COMPLETE),
    ("fetes", COMPLETE),
]

#: Words that name a tier of items, the first tier with a hit counts; and the codes of each tier. Fixed values.
TIER_WORDS = [
    ("castells de 6", ("castells de 6", "sis pisos", "gamma de 6")),
    ("castells de 7", ("castells de 7", "set pisos", "gamma de 7")),
    ("castells de 8", ("castells de 8", "vuit pisos", "gamma de 8")),
    ("castells de 9", ("castells de 9", "nou pisos", "gamma de 9")),
    ("gamma extra", ("castells de gamma extra", "gamma extra", "extra", "màxima dificultat", "maxima dificultat")),
]
TIER_CODES = {
    "castells de 6": ("3d6", "4d6", "5d6", "2d6", "3d6a", "4d6a", "5d6a", "7d6", "9d6", "3d6s"),
    "castells de 7": ("3d7", "4d7", "5d7", "2d7", "3d7a", "4d7a", "5d7a", "7d7", "9d7", "3d7s"),
    "castells de 8": ("3d8", "4d8", "5d8", "2d8f", "3d8s", "4d8a", "5d8a", "7d8", "9d8", "3d8a"),
    "castells de 9": ("4d9f", "3d9f", "5d9f", "2d9fm", "4d9af", "3d9af", "7d9f", "3d9", "4d9", "5d9"),
    "gamma extra": ("2d9fm", "4d9af", "3d9af", "5d9f", "9d8", "9d9f", "3d10fm", "4d10fm", "pd8fm", "pd9fmp", "4d9", "7d9f", "2d9f", "3d9"),
}

#: Parts of questions about other things: language models, programming, other domains. Fixed values.
OFF_TOPIC = (
    "chatgpt", "gpt", "gpt-3", "gpt-4", "gpt-4o", "openai",
    "claude", "anthropic", "gemini", "google ai",
    " llama ", "meta ai", "mistral",
    "deepseek", "qwen", "cerebras",
    "intel·ligència artificial", "inteligencia artificial", " ia ",
    "llm", "large language model", "model de llenguatge",
    "model generatiu", "generative ai", "genai",
    "xarxes neuronals", "neural network",
    "deep learning", "machine learning",
    "qui ets", "què ets", "com funcionas", "com funciono",
    "com has estat entrenat", "entrenament del model",
    "saps ", "tens consciència",
    "ets real", "ets una persona",
    "token", "tokens", "prompt", "prompts",
    "embedding", "vector", "fine-tuning", "finetuning",
    "latència", "latency", "inference",
    "bing chat", "copilot", "perplexity", "notion ai",
    "python", "javascript", "typescript", "java", "c++", "c#",
    "react", "react native", "node", "nodejs",
    "html", "css",
    "sql", "postgres", "postgresql", "mysql", "sqlite",
    "mongodb", "supabase", "firebase",
    "docker", "kubernetes", "aws", "gcp", "azure",
    "linux", "bash", "terminal",
    "backend", "frontend", "fullstack",
    "endpoint", "request", "response",
    " bug ", "error", "stack trace", "exception",
    "futbol", "bàsquet", "tennis", " nba ", "fifa",
    "formula 1", "motogp",
    "eleccions", "govern", "president",
    "parlament",
    "borsa", "bitcoin", "criptomoneda",
    "inflació", "interessos",
)

#: Phrases of questions by the report that answers them; of equal reports the first counts. Fixed values.
TEMPLATES = {
    "best_event": (
        "millor diada", "millor actuació", "millor actuacio", "millors diades", "millors actuacions",
        "quina diada", "quina actuació", "quina va ser la millor",
        "millor jornada", "millors jornades", "actuació més destacada",
    ),
    "best_item": (
        "millor castell", "millor torre", "millor construcció", "millor construccio",
        "castell més difícil", "castell mes dificil", "castell més gran", "castell mes gran",
        "màxim castell", "millor estructura",
    ),
    "item_history": (
        "quantes vegades han", "quants cops han", "han aconseguit mai",
        "quants 3d", "quants 2d", "quants 4d", "quants 5d", "quants pilars de", "quantes torres de",
    ),
    "location_performances": (
        "quin any s'ha fet la millor actuació", "quin lloc s'ha fet la millor actuació", "a quina plaça s'ha fet la millor actuació",
        "a quina placa s'ha fet la millor actuació", "quina ciutat s'ha fet la millor actuació", "quina població s'ha fet la millor actuació",
        "quina poblacio s'ha fet la millor actuació", "a quin lloc han fet la millor actuació", "quin any van fer la millor", "a quin lloc van fer la millor",
    ),
    "first_item": (
        "quin va ser el primer", "quin va ser la primera vegada",
        "quan van fer el primer", "quan es va fer per primer cop",
        "quan van descarregar per primer cop", "quan van aconseguir per primera vegada",
        "quan van intentar per primera vegada", "quan van intentar per primer cop",
        "quan van descarregar per primera vegada", "quan van carregar per primer cop",
        "quin any s'ha fet el primer", "quin any s'ha descarregat el primer", "quin any s'ha carregat el primer",
        "quin any s'ha intentat el primer", "quin any s'ha intentat desmuntar el primer",
        "on es va fer el primer",
        "A quin lloc van fer el primer", "quan es va carregar", "quan es va intentar", "quan es va fer el primer",
        "quan es va descarregar", "quan van carregar el", "quan van descarregar el",
        "quan van carregar el primer", "quan van descarregar el primer",
    ),
    "item_statistics": (
        "estadístiques de", "estadisticas de", "estadistica de",
        "estadístiques del castell",
        "quantes colles han fet", "quantes colles han descarregat",
        "ranking de colles", "qui ha fet més",
        "colles que han aconseguit", "colles que han descarregat",
    ),
    "year_summary": (
        "resum de la temporada", "resum temporada", "resum any",
        "activitat", "balanç de temporada", "balanc de temporada",
        "com va ser la temporada", "com va ser l'any", "com va ser l any",
        "com va anar la temporada", "com va anar l'any", "com va anar l any",
        "què van fer a la temporada", "que van fer a la temporada",
        "què van fer l'any", "que van fer l any", "resultats de la temporada", "quants castells van fer",
        "quants castells van descarregar", "quants castells van carregar",
    ),
    "contest_ranking": (
        "classificació concurs", "classificacio concurs", "classificació al concurs",
        "quina posició", "quina posicio van quedar", "en quina posició",
        "guanyador concurs", "guanyadora concurs", "qui va guanyar el concurs",
        "resultats del concurs", "puntuació al concurs", "rondes del concurs",
    ),
    "contest_history": (
        "historia del concurs", "historia del concurs de castells",
        "concursos celebrats", "història dels concursos",
        "explica el concurs de l'any", "explica el concurs de la temporada",
        "concurs de l'edició ", "com va anar el concurs de", "qui va guanyar el concurs",
    ),
}
