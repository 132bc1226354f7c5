"""Default word lists, lookup tables and templates.

Every operator takes its lexicon as a parameter; the values below are only defaults.
"""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------------
# These lists must keep exactly this content: results are defined in terms of them.

EVENT_RULES: list[tuple[str, list[str]]] = [
    ("transfer", ["transfer"]),
    ("match_moment", ["gol", "maç", "penaltı", "hakem"]),
    ("injury", ["sakat", "kriz"]),
    ("meme", ["meme", "mizah", "😂"]),
    (
        "global_football",
        [
            "gol",
            "maç",
            "derbi",
            "futbol",
            "transfer",
            "hakem",
            "penaltı",
            "galatasaray",
            "fenerbahçe",
            "beşiktaş",
            "trabzonspor",
        ],
    ),
]

RISK_WORDS: dict[str, list[str]] = {
    "misinformation": ["iddia", "doğrulanmadı", "kulis"],
    "toxicity": ["salak", "aptal", "nefret", "hain"],
    "crisis": ["ölüm", "afet", "saldırı", "yaralı"],
    "political_tension": ["siyaset", "bakan", "parti"],
    "copyright": ["telif"],
}

CLAIM_WORDS: list[str] = ["iddia"]

QUOTE_RISK_WORDS: list[str] = ["iddia", "skandal", "kavga", "siyaset", "ölüm", "sakatlık"]

STOCK_PHRASES: list[str] = [
    "bu bağlamda",
    "özetle",
    "dikkat çekici bir gelişme",
    "futbolseverler için",
    "sosyal medyada gündem oldu",
    "kritik bir gelişme yaşandı",
    "x platformunda",
    "taraftarlar ikiye bölündü",
    "büyük yankı uyandırdı",
    "futbol dünyasında gündem",
]

TURKISH_LETTERS: str = "çğıöşü"
TURKISH_WORDS: list[str] = ["maç", "gol", "takım", "taraftar"]

DRY_HUMOR_WORDS: list[str] = ["yine", "senaryo", "klasik"]
REACTION_WORDS: list[str] = ["bu pozisyon", "bu görüntü", "konuşulur"]

EVIDENCE_TERMS: list[str] = [
    "asist",
    "derbi",
    "forma",
    "futbol",
    "gol",
    "hakem",
    "kale",
    "kart",
    "lig",
    "mac",
    "maç",
    "oyuncu",
    "penalti",
    "penaltı",
    "saha",
    "skor",
    "stad",
    "stadyum",
    "takim",
    "takım",
    "taraftar",
    "tribun",
    "tribün",
]

CATEGORY_KEYWORDS: dict[str, list[str]] = {
    "football": [
        "football", "soccer", "futbol", "futebol", "goal", "match", "game", "maç", "oyun",
        "victory", "defeat", "win", "loss", "gol", "penalty", "world cup", "worldcup",
        "champions league", "premier league", "la liga", "serie a", "bundesliga",
        "europa league", "coach", "manager", "takım", "player", "futbolcu", "transfer",
        "contract", "signing",
    ],
    "basketball": [
        "basketball", "nba", "dunk", "three-pointer", "slam dunk", "basket", "koç", "basketbol",
    ],
    "technology": [
        "ai", "artificial intelligence", "technology", "tech", "software", "hardware",
        "launch", "update", "release",
    ],
    "news": [
        "breaking", "according to", "reports", "news", "report", "headline", "son dakika",
        "haber",
    ],
}

POSITIVE_WORDS: list[str] = [
    "good", "great", "amazing", "awesome", "fantastic", "love", "excellent", "happy", "win",
    "victory", "positive", "başarılı", "mutlu",
]
NEGATIVE_WORDS: list[str] = [
    "bad", "terrible", "awful", "hate", "poor", "sad", "loss", "defeat", "negative", "kötü",
    "üzgün",
]

ACCOUNT_KEYWORDS: list[str] = [
    "futbol", "futbolu", "futbolun", "maç", "gol", "goll", "derbi", "lig", "şampiyon", "faul",
    "ofsayt", "hakem", "penaltı", "football", "goal", "match", "derby", "league", "score",
    "cup", "champions", "penalty",
]

STYLE_STOPWORDS: list[str] = [
    "the", "a", "an", "of", "and", "or", "to", "in", "is", "are", "for", "on", "with", "at",
    "by", "from", "that", "this", "it", "be", "as", "has", "have", "had", "was", "were", "will",
    "would", "can", "could", "should", "i", "you", "he", "she", "they", "we", "me", "them", "us",
]

SENSITIVE_KEY_PARTS: list[str] = [
    "authorization", "bearer", "cookie", "csrf", "password", "secret", "token",
]

UI_MEDIA_SCOPES: list[str] = ["avatar", "profile", "ui", "badge", "icon"]
UI_MEDIA_MARKERS: list[str] = [
    "profile_images", "default_profile_images", "emoji", "avatar", "badge", "icon",
]

MEDIA_KINDS: list[str] = ["image", "video", "gif", "audio", "unknown"]
ACCEPTED_URL_PREFIXES: list[str] = ["https://x.com/", "https://twitter.com/"]

METRIC_LABELS: list[tuple[str, list[str]]] = [
    ("likes", ["like", "beğeni"]),
    ("reposts", ["repost", "retweet"]),
    ("replies", ["reply", "yanıt"]),
    ("views", ["view", "görüntülenme"]),
]

SOURCE_RELIABILITY: dict[str, float] = {
    "official_club": 90.0,
    "club": 90.0,
    "journalist": 75.0,
    "stats": 70.0,
    "fan": 45.0,
    "meme": 40.0,
    "candidate": 35.0,
    "unknown": 30.0,
}

FEEDBACK_REWARD: dict[str, float] = {
    "approved": 1.0,
    "posted_manually": 1.2,
    "edited": 0.4,
    "ignored": -0.2,
    "rejected": -1.0,
}

DEFAULT_WEIGHTS: dict[str, float] = {
    "tone.reaction": 1.0,
    "tone.dry_humor": 1.0,
    "tone.neutral_short": 1.0,
    "tone.quote_context": 1.0,
}

DRAFT_VARIANTS: list[str] = ["reaction", "dry_humor", "neutral_short", "quote_context"]

DRAFT_TEMPLATES: dict[str, list[str]] = {
    "reaction": [
        "Bu pozisyon daha çok konuşulur.",
        "Bu görüntü tek başına gündem olur.",
        "Bunu maçtan sonra tekrar açarlar.",
    ],
    "dry_humor": [
        "Dakika {minute}, senaryo yine aynı.",
        "Klasik maç günü hikayesi.",
        "Bir futbol akşamı daha sakin geçmedi.",
    ],
    "neutral_short": [
        "{topic} cephesinde gündem bu pozisyona döndü.",
        "Bu olay kısa sürede konuşulur.",
        "Şimdilik not düşelim, devamı gelir.",
    ],
    "quote_context": [
        "Burada mesele karar değil, standardın değişmesi.",
        "Bu alıntı tek başına bağlamı anlatıyor.",
        "Bunu kenara yazmak lazım.",
    ],
}

DO_NOT_POST_TEXT: str = "Risk yüksek. Paylaşma; önce doğrula."
DEFAULT_TOPIC: str = "Futbol"
DEFAULT_MINUTE: str = "70"
REPORT_NEXT_ACTION: str = "Next action: keep human approval and avoid news-like phrasing."

# Character folds applied before the account keyword count (source letters -> target letters).
FOLD_FROM: str = "çğıöşü"
FOLD_TO: str = "cgiosu"
# --- end of fixed values ----------------------------------------------------------
