"""Fixed values. These must equal the monitored product's own lists to give the same results."""

# Risk phrases, matched as substrings of lower-cased text.
RISK_PHRASES = [
    "death", "died", "killed", "side effect", "side effects", "adverse event",
    "adverse reaction", "adverse effects", "hospitalized", "hospitalisation", "lawsuit",
    "litigation", "class action", "recall", "market withdrawal", "toxicity", "toxic",
    "injury", "injured", "dangerous", "unsafe", "hazardous", "misinformation", "fake cure",
    "false claim", "off label", "off-label", "unapproved use", "contraindication",
    "drug interaction", "overdose", "black box warning", "nexplanon side", "nuvaring risk",
    "implanon complication", "dupixent side", "rinvoq risk", "humira side",
    "biosimilar safety", "trastuzumab toxicity", "singulair mental", "montelukast side",
    "finasteride side", "propecia side", "FDA warning", "EMA warning", "regulatory action",
    "safety alert", "pharmacovigilance", "post market surveillance",
]

# Indication groups and the phrases that select their items.
INDICATION_GROUPS = {
    "All Products": [],
    "Contraception": [
        "nuvaring", "nexplanon", "implanon", "mercilon", "marvelon", "kyleena", "mirena",
        "skyla", "liletta", "paragard", "depo-provera", "xulane", "annovera", "opill", "twirla",
        "phexxi", "contraception", "birth control", "iud", "larc",
    ],
    "Fertility / IVF": [
        "puregon", "follistim", "elonva", "orgalutran", "pregnyl", "prometrium", "menopur",
        "rekovelle", "gonal", "fyremadel", "decapeptyl", "ivf", "fertility", "infertility",
        "ovarian stimulation", "ovulation induction", "gonadotropin", "embryo transfer",
    ],
    "Dermatology": [
        "vtama", "tapinarof", "dupixent", "dupilumab", "rinvoq", "upadacitinib", "tremfya",
        "guselkumab", "adbry", "tralokinumab", "cibinqo", "abrocitinib", "eucrisa",
        "crisaborole", "psoriasis", "atopic dermatitis", "eczema", "pruritus",
    ],
    "Immunology": [
        "renflexis", "hadlima", "brenzys", "bildyos", "bilprevda", "humira", "adalimumab",
        "amjevita", "imraldi", "yusimry", "biosimilar", "rheumatoid arthritis",
        "crohn disease", "ulcerative colitis", "ankylosing spondylitis",
    ],
    "Respiratory": [
        "singulair", "dulera", "asthmanex", "nasonex", "montelukast", "asthma",
        "allergic rhinitis", "eosinophilic asthma", "allergy", "inhaled corticosteroid",
        "bronchodilator",
    ],
    "Migraine": [
        "maxalt", "rizatriptan", "emgality", "rayvow", "migraine", "acute migraine", "cgrp",
        "headache",
    ],
    "Women's Health": [
        "xaciato", "duavive", "prometrium", "solosec", "bacterial vaginosis",
        "vaginal infection", "menopause", "hormone replacement therapy", "hrt", "hot flashes",
    ],
    "Oncology": [
        "ontruzant", "aybintio", "poherdy", "trastuzumab", "her2", "breast cancer biosimilar",
    ],
    "Cardiovascular": [
        "zetia", "atozet", "rosuzet", "coza", "ezetimibe", "hyperlipidemia", "cholesterol",
        "ldl", "statin", "dyslipidemia",
    ],
    "Hair Loss": [
        "propecia", "finasteride", "androgenetic alopecia", "male pattern baldness", "hair loss",
    ],
}

# Fixed values: (low, high) cut points of the Low / Medium / High range labels.
RANGE_CUTS = {
    "viral_probability": (0.40, 0.70),
    "toxicity_score": (0.30, 0.60),
    "sentiment_score": (0.40, 0.70),
    "emotion_score": (0.40, 0.70),
    "narrative_similarity_score": (0.40, 0.70),
    "ravs_score": (0.35, 0.70),
    "alert_score": (0.35, 0.70),
    "virality_score": (0.40, 0.70),
    "engagement_rate": (0.02, 0.05),
    "pharma_risk_score": (1, 3),
    "cluster_volume": (10, 30),
    "views_per_hour": (100, 1000),
    "likes_per_hour": (10, 100),
    "comments_per_hour": (5, 50),
    "view_velocity": (100, 1000),
    "like_velocity": (10, 100),
    "comment_velocity": (5, 50),
    "growth_acceleration": (0, 500),
    "trend_score": (0.30, 0.70),
    "narrative_trend_score": (5, 15),
}

# Code-point ranges that count as emoji.
EMOJI_RUN = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
)

# Columns carried by the tracking history, besides its timestamp.
HISTORY_DDL = """
video_id string, title string, channel_title string, analysis_text_en string,
analysis_text_clean string, title_en string, description_en string, transcript_en string,
comments_text_full_en string, view_count bigint, like_count bigint, comment_count bigint,
subscriber_count bigint, engagement_rate double, virality_score double, viral_label int,
sentiment_label string, sentiment_score double, emotion_label string, emotion_score double,
toxicity_label string, toxicity_score double, pharma_risk_label string, pharma_risk_score int
"""

# Model inputs.
NUMERIC_FEATURES = [
    "engagement_rate", "views_per_hour", "likes_per_hour", "comments_per_hour", "view_velocity",
    "like_velocity", "comment_velocity", "growth_acceleration", "trend_score", "text_length",
    "word_count", "emoji_count", "question_mark_count", "exclamation_count", "sentiment_score",
    "emotion_score", "toxicity_score", "pharma_risk_score", "narrative_similarity_score",
    "cluster_volume", "narrative_trend_score",
]
CATEGORICAL_FEATURES = [
    "sentiment_label", "emotion_label", "toxicity_label", "pharma_risk_label", "trend_label",
    "emerging_narrative",
]
# Features that contain the score the label was cut from.
LEAKING_FEATURES = ["trend_score", "narrative_trend_score"]

# Columns refreshed from the newest snapshot.
LIVE_METRICS = ["view_count", "like_count", "comment_count", "channel_subscriber_count"]

# Alert columns in report order, and the header of an empty alert table.
ALERT_COLUMNS = [
    "video_id", "title", "channel_title", "alert_type", "alert_priority", "alert_reason", "ravs_speed_of_engagement",
    "ravs_regulatory_relevance", "ravs_safety_implications", "ravs_influencer_reach", "ravs_topic_sensitivity",
    "viral_probability", "viral_probability_range", "trend_score", "trend_score_range", "growth_acceleration",
    "growth_acceleration_range", "sentiment_label", "emotion_label", "toxicity_label", "toxicity_score",
    "toxicity_score_range", "pharma_risk_score", "pharma_risk_score_range", "engagement_rate",
    "engagement_rate_range", "views_per_hour", "views_per_hour_range", "view_velocity", "view_velocity_range",
    "narrative_cluster_id", "dominant_topic_id", "topic_keywords", "cluster_topic_name", "cluster_volume",
    "cluster_volume_range", "narrative_trend_score", "narrative_trend_score_range", "ravs_score", "ravs_score_range",
    "alert_score", "alert_score_range", "view_count", "like_count", "comment_count", "subscriber_count",
    "tracking_timestamp",
]
EMPTY_ALERT_COLUMNS = [
    "video_id", "title", "channel_title", "alert_type", "alert_priority", "alert_reason", "alert_score", "ravs_score",
    "viral_probability",
]

# Text columns that get an English twin, and the order they join in.
TRANSLATED = [
    "keyword", "title", "description", "channel_title", "transcript", "comments_text_full",
]
ANALYSIS_ORDER = [
    "keyword", "title", "description", "transcript", "comments_text_full", "channel_title",
]
CHUNK_CHARS = 4000
SCORER_CHARS = 512
