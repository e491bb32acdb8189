"""Word lists and weights that decide results.

FIXED VALUES. Everything in this module must equal the values the original
application ships, otherwise scores, tokens and extracted fields differ. They
are written out plainly, in their original order. Nothing else lives here.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — rule scorer lexicon
# ---------------------------------------------------------------------------

RULE_KEYWORDS = [
    "preventivo", "quotazione", "prezzo", "offerta", "proposal", "estimate",
    "listino", "tariffa", "budget", "pricing", "costo",
]

# canonical -> words and phrases that stand for it
RULE_SYNONYMS = {
    "preventivo": [
        "preventivi", "preventiva", "richiesta preventivo", "richiesta di preventivo",
        "quote request", "request a quote", "quote richiesti", "stima costi",
        "cost estimate", "estimate request", "need a quote", "asking for a quote",
    ],
    "quotazione": ["quotazioni", "quotation", "quoting", "quote"],
    "offerta": [
        "offerte", "offer", "proposal", "proposta", "proposte", "pricing proposal",
        "commercial offer",
    ],
    "prezzo": [
        "prezzi", "pricing", "price", "costo", "costi", "cost", "rate", "rates", "fee",
        "fees", "pricing details",
    ],
    "estimate": ["estimating", "estimates", "estimation", "detailed estimate", "rough estimate"],
    "listino": ["listino prezzi", "price list", "listini", "listini prezzi", "catalogo prezzi"],
    "tariffa": ["tariffe", "tariffario", "tariffario prezzi", "tarifas", "pricing table"],
    "budget": [
        "range di budget", "budget indicativo", "budget disponibile", "stanziamento",
        "spesa prevista",
    ],
    "pricing": ["pricing options", "pricing plan", "pricing breakdown", "costi e pricing"],
}

RULE_STOPWORDS = [
    "a", "ai", "al", "alla", "alle", "and", "are", "as", "at", "con", "da", "dal", "dalla",
    "dalle", "dello", "dei", "delle", "di", "do", "does", "gli", "he", "i", "il", "in", "is",
    "it", "la", "le", "li", "lo", "loro", "ma", "mi", "nel", "nella", "nelle", "o", "of", "on",
    "per", "quei", "quelle", "questo", "sono", "su", "the", "to", "una", "un", "uno", "we",
    "you",
]

# (prefix, stem) — the first prefix that matches wins
RULE_STEMS = [
    ("preventiv", "preventivo"),
    ("quotaz", "quotazione"),
    ("offert", "offerta"),
    ("propost", "proposta"),
    ("prezz", "prezzo"),
    ("cost", "costo"),
    ("estim", "estimate"),
    ("budg", "budget"),
    ("tariff", "tariffa"),
    ("listin", "listino"),
    ("quot", "quotazione"),
    ("prevent", "preventivo"),
]

# segment weights and decision threshold
WEIGHT_SUBJECT = 2.0
WEIGHT_BODY = 1.0
WEIGHT_HEADERS = 0.5
RULE_THRESHOLD = 2.0

# ---------------------------------------------------------------------------
# FIXED VALUES — classifier stopwords (serving definition), Italian then English
# ---------------------------------------------------------------------------

ML_STOPWORDS_IT = [
    "a", "ai", "al", "alla", "alle", "allo", "anche", "avere", "che", "chi", "ci", "con",
    "cosa", "cui", "da", "dal", "dalla", "dalle", "dallo", "degli", "dei", "del", "della",
    "delle", "dello", "di", "dove", "e", "ed", "essere", "gli", "ha", "hai", "hanno", "ho",
    "i", "il", "in", "io", "la", "le", "lei", "li", "lo", "loro", "lui", "ma", "me", "mi",
    "mia", "mio", "nel", "nella", "nelle", "nello", "noi", "non", "nostro", "o", "per", "però",
    "più", "quale", "quando", "quei", "quelle", "quelli", "quello", "questo", "questi",
    "qui", "se", "sei", "si", "sia", "siamo", "siete", "sono", "sopra", "sotto", "sta",
    "stato", "su", "sua", "sue", "sui", "sul", "sulla", "sulle", "sullo", "suo", "suoi",
    "ti", "tra", "tu", "tua", "tue", "tuo", "tuoi", "tutto", "un", "una", "uno", "va",
    "vai", "voi", "vorrei", "vostro",
]

ML_STOPWORDS_EN = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any",
    "are", "aren't", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "can't", "cannot", "could", "couldn't", "did",
    "didn't", "do", "does", "doesn't", "doing", "don't", "down", "during", "each", "few",
    "for", "from", "further", "had", "hadn't", "has", "hasn't", "have", "haven't", "having",
    "he", "he'd", "he'll", "he's", "her", "here", "here's", "hers", "herself", "him",
    "himself", "his", "how", "how's", "i", "i'd", "i'll", "i'm", "i've", "if", "in", "into",
    "is", "isn't", "it", "it's", "its", "itself", "let's", "me", "more", "most", "mustn't",
    "my", "myself", "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other",
    "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "shan't", "she",
    "she'd", "she'll", "she's", "should", "shouldn't", "so", "some", "such", "than", "that",
    "that's", "the", "their", "theirs", "them", "themselves", "then", "there", "there's",
    "these", "they", "they'd", "they'll", "they're", "they've", "this", "those", "through",
    "to", "too", "under", "until", "up", "very", "was", "wasn't", "we", "we'd", "we'll",
    "we're", "we've", "were", "weren't", "what", "what's", "when", "when's", "where",
    "where's", "which", "while", "who", "who's", "whom", "why", "why's", "with", "won't",
    "would", "wouldn't", "you", "you'd", "you'll", "you're", "you've", "your", "yours",
    "yourself", "yourselves",
]

# The training script's copy lacks these two Italian words (legacy_train mode).
ML_STOPWORDS_SERVE_ONLY = ["mia", "vorrei"]

# ---------------------------------------------------------------------------
# FIXED VALUES — numeric text features
# ---------------------------------------------------------------------------

URGENCY_WORDS = ["urgente", "urgent", "asap", "immediato", "subito", "prima possibile"]
GREETING_WORDS = ["buongiorno", "buonasera", "gentile", "dear", "hello", "hi", "salve"]
SIGNATURE_INDICATORS = ["tel", "phone", "mobile", "cell", "email", "@"]
FEATURE_NAMES = [
    "urgency_score", "has_greeting", "question_density", "length_score",
    "has_contact_info", "signature_score",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — training-set augmentation (word -> replacements; only the first is used)
# ---------------------------------------------------------------------------

AUGMENT_SYNONYMS = {
    "preventivo": ["quotazione", "stima", "budget"],
    "richiesta": ["domanda", "richiedo", "vorrei"],
    "urgente": ["immediato", "asap", "subito"],
    "quote": ["quotation", "estimate", "pricing"],
    "request": ["need", "looking for", "inquire"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES — contact extraction
# ---------------------------------------------------------------------------

ORG_HINTS = [
    "azienda", "company", "impresa", "org", "organizzazione", "società", "societa", "s.r.l",
    "srl", "s.p.a", "spa", "s.a.s", "sas", "s.n.c", "snc", "inc", "ltd", "llc", "corp",
    "corporation", "gmbh", "sarl", "limited",
]

COMPANY_NOISE_TERMS = [
    "marketing", "vendite", "ufficio", "ufficio marketing", "team marketing", "team vendite",
    "il mio team", "il reparto", "reparto marketing", "dipartimento",
]

# label hint -> score of a phone number found on that line
PHONE_LABEL_SCORES = {
    "cell": 5, "cellulare": 5, "mobile": 5, "mobil": 5, "tel": 3, "telefono": 3, "phone": 3,
    "ph": 3, "ufficio": 2, "office": 2, "lavoro": 2, "work": 2, "fax": 0,
}

# words that keep a line containing "fax" in play
FAX_OVERRIDE_HINTS = ["cell", "mobile", "tel"]

NAME_TITLES = ["dr", "dott", "ing", "prof", "avv", "mr", "mrs", "ms", "miss", "sir"]

# legal-form words of the org-line rule, and the label words stripped in front of a company
LEGAL_FORMS = ["s\\.r\\.l", "srl", "s\\.p\\.a", "spa", "inc", "ltd", "llc", "corp", "gmbh", "sarl"]
ORG_LABEL_WORDS = ["azienda", "company", "impresa", "organizzazione", "org", "società", "societa"]

# ---------------------------------------------------------------------------
# FIXED VALUES — ensemble and classifier decisions
# ---------------------------------------------------------------------------

ML_THRESHOLD = 0.5
ENSEMBLE_ML_WEIGHT = 0.7
ENSEMBLE_CONF_HIGH = 0.9
ENSEMBLE_CONF_LOW = 0.3
BODY_EXCERPT_CHARS = 400
SINCE_DAYS_DEFAULT = 7
OVERFIT_ACCURACY = 0.95


def ml_stopwords(legacy_train: bool = False) -> list[str]:
    """Classifier stopword set (deduplicated, first-seen order)."""
    words = list(dict.fromkeys(ML_STOPWORDS_IT + ML_STOPWORDS_EN))
    if legacy_train:
        words = [w for w in words if w not in ML_STOPWORDS_SERVE_ONLY]
    return words
