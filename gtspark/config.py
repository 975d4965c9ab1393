"""Defaults and fixed values.

Function arguments override these; nothing is read from the environment.
"""

from __future__ import annotations

# Retrieval and evaluation defaults.
CHUNK_SIZE = 320
CHUNK_OVERLAP = 48
TOP_K = 4
EMBEDDING_DIM = 256
SUPPORT_THRESHOLD = 0.35
GATE_THRESHOLD = 0.10
N_BOOT = 10_000
BOOT_SEED = 7
ALPHA = 0.05
BEST_OF_N_SCHEDULE = (1, 2, 4, 8, 16)
CATALOGUE_MAX = 90
EARTH_RADIUS_KM = 6371.0

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------

# Saffir-Simpson lower bounds in knots, category 5 down to 1 (below 64 -> 0).
SAFFIR_SIMPSON_KT = ((137, 5), (113, 4), (96, 3), (83, 2), (64, 1))

# Boxes as (lat_min, lat_max, lon_min, lon_max), all edges inclusive.
NC_BOX = (33.5, 36.8, -78.7, -75.3)
CAROLINA_BOX = (31.0, 37.8, -82.5, -73.0)

# Storm names always kept in the catalogue.
NOTABLE_NAMES = ("HELENE", "FLORENCE", "DORIAN", "IRENE", "MATTHEW", "ISABEL", "FLOYD",
                 "FRAN", "HAZEL", "HUGO", "ISAIAS", "OPHELIA", "BONNIE", "ARTHUR")

# Best-track missing-value codes for integers.
INT_MISSING = ("", "-99", "-999")

# Buoy missing-value codes (archive CSV) and the realtime-file codes.
BUOY_MISSING = ("", "MM", "999", "99.0", "9999.0")
REALTIME_MISSING = ("MM", "999.0")

# Best-track status codes.
STATUS_LABELS = {
    "TD": "tropical depression",
    "TS": "tropical storm",
    "HU": "hurricane",
    "EX": "extratropical cyclone",
    "SD": "subtropical depression",
    "SS": "subtropical storm",
    "LO": "low",
    "WV": "tropical wave",
    "DB": "disturbance",
}

# Spelled category numbers recognised in answers.
CATEGORY_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}

# USD per 1K tokens as (prompt, completion); unknown models cost nothing.
PRICING = {
    "mock-grounded": (0.0, 0.0),
    "mock-naive": (0.0, 0.0),
    "openai:gpt-4o-mini": (0.00015, 0.0006),
    "openai:gpt-4o": (0.0025, 0.01),
}

# Prior-first answerer: lower-case key found in the question -> canned answer
# (deliberately wrong categories; the structured check must flag them).
NAIVE_PRIOR = (
    ("florence", "Hurricane Florence made landfall in North Carolina as a Category 3 hurricane."),
    ("dorian", "Hurricane Dorian struck North Carolina as a Category 4 hurricane."),
    ("irene", "Hurricane Irene made landfall in North Carolina as a Category 3 hurricane."),
)

# Query words that trigger the landfall bonus, and the sentence words that earn it.
LANDFALL_QUERY_WORDS = ("landfall", "ashore", "come ashore")
LANDFALL_SENTENCE_WORDS = ("landfall", "ashore")
NO_ANSWER_TEXT = "The retrieved context does not contain that information."
INSUFFICIENT_TRACK_TEXT = "insufficient track history (need ≥4 fixes)"
LIVE_DISCLAIMER = ("Model estimate from the storm's recent track — NOT an official "
                   "forecast. Always follow National Hurricane Center advisories.")

# Prompt templates (placeholders {{ context }} and {{ query }}; rendered
# without a trailing newline).
PROMPT_TEMPLATES = {
    "rag_v1": (
        "You are a coastal-weather assistant. Answer the question using ONLY the context\n"
        "below. If the context does not contain the answer, say so. Be specific and cite\n"
        "figures (categories, wind speeds, pressures, dates) exactly as they appear.\n"
        "\n"
        "Context:\n"
        "{{ context }}\n"
        "\n"
        "Question: {{ query }}\n"
        "Answer:"),
    "rag_v2": (
        "Use the retrieved NOAA records to answer the question precisely. Quote exact\n"
        "storm categories and measured values. Do not speculate beyond the context.\n"
        "\n"
        "--- Retrieved records ---\n"
        "{{ context }}\n"
        "--- End records ---\n"
        "\n"
        "Q: {{ query }}\n"
        "A:"),
}

# Prompt of the judge (placeholders {{ context }} and {{ answer }}).
JUDGE_TEMPLATE = (
    "You are grading whether an answer is supported by the provided context.\n"
    "Return a JSON object: {\"grounded\": true|false, \"reason\": \"<short>\"}.\n"
    "An answer is grounded only if every factual claim appears in or follows from\n"
    "the context.\n"
    "\n"
    "Context:\n"
    "{{ context }}\n"
    "\n"
    "Answer to grade:\n"
    "{{ answer }}")

# fixed values: sentence search and question routing
SEARCH_STOP_WORDS = ("the a an of in on at to and or for with as is was were by from").split()
SEARCH_GENERIC_WORDS = (
    "hurricane hurricanes storm storms tropical cyclone cyclones depression "
    "landfall landfalls ashore make makes made making came come category cat coast coastal shore "
    "shoreline north south east west carolina carolinas wind winds kt knots mph gusts surge flooding "
    "flood floods freshwater rainfall rain rains damage damaging destructive expected anticipated near "
    "along across produced producing water waters levels level feet foot ft mb millibars pressure "
    "intensity intense peak peaked maximum sustained season conditions threat threats primary life "
    "threatening area region inland offshore open atlantic gulf day days today tonight night morning "
    "week mariners port seas wave waves building move moving track approaching "
    "nc sc nws forecast discussion newport morehead city public advisory bulletin statement office "
    "january february march april may june july august september october november december").split()
SEARCH_STORM_NAMES = (
    "helene florence dorian irene matthew floyd fran hazel hugo isabel isaias ophelia bonnie arthur bertha "
    "diana charley frances jeanne katrina rita wilma sandy harvey maria michael irma ian ida nicole idalia "
    "debby milton fiona beryl gabrielle humberto").split()
HURRICANE_RE = r"(?i)\b(hurricane|storm|cyclone|typhoon|tropical|landfall|category|saffir|surge|eyewall|nhc)\b"
IMPACT_RE = (r"(?i)\b(damage|damages|cost|costs|deaths?|died|killed|fatalit|casualt|destroy|billion|million|dollars?"
             r"|lives?|toll|injur|evacuat|impact)\b")
GREETING_RE = r"(?i)^(hi|hello|hey|yo|howdy|greetings|good (morning|afternoon|evening)|thanks|thank you|sup)\b"
