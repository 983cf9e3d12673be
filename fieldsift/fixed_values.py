"""Word lists, labels, prompts, limits and patterns.

Results depend on these exact values, so they are written out as they are.
Every function that uses one takes it as an argument with this default.
"""

# --- Fixed values: categories -------------------------------------------------
# Declared order decides ties and the fallback category.
CATEGORY_MAP = {
    "SUPPLY_CHAIN_ISSUE": "supply_chain_delay",
    "RETAILER_RELATIONSHIP_ISSUE": "retailer_dissatisfaction",
    "PRICING_AND_MARGIN_CONFLICT": "pricing_conflict",
    "COMPETITOR_MARKET_PRESSURE": "competitor_pressure",
    "DEMAND_SURGE": "demand_spike",
}
CATEGORIES = list(CATEGORY_MAP.values())

DISPLAY_NAMES = {
    "supply_chain_delay": "Supply Chain Delay",
    "retailer_dissatisfaction": "Retailer Dissatisfaction",
    "pricing_conflict": "Pricing Conflict",
    "competitor_pressure": "Competitor Pressure",
    "demand_spike": "Demand Spike",
}

CATEGORY_KEYWORDS = {
    "supply_chain_delay": [
        "supply", "chain", "delay", "stock", "shortage", "delivery",
        "replenish", "shipment", "backlog", "warehouse", "inventory",
        "mismatch", "running", "out", "fast", "movers", "movement",
    ],
    "retailer_dissatisfaction": [
        "retailer", "dissatisfaction", "unhappy", "complain", "angry",
        "frustrated", "poor", "service", "bad", "experience", "relationship",
        "issue", "dissatisfied",
    ],
    "pricing_conflict": [
        "pricing", "conflict", "price", "dispute", "margin", "discount",
        "expensive", "cheap", "billing", "charge", "rate", "cost",
    ],
    "competitor_pressure": [
        "competitor", "pressure", "competition", "rival", "alternative",
        "switching", "market", "share", "launched", "campaign",
    ],
    "demand_spike": [
        "demand", "spike", "surge", "overflow", "high", "volume",
        "rush", "stockout", "unexpected",
    ],
}

UNKNOWN_CATEGORY = "unknown"

# --- Fixed values: raw model output -------------------------------------------
OUTPUT_PREFIXES = [
    "issue category:",
    "category:",
    "the issue category is",
    "the category is",
    "-",
]
EXACT_CONFIDENCE = 0.97
SPACED_CONFIDENCE = 0.90
SUBSTRING_CONFIDENCE = 0.80
KEYWORD_CONFIDENCE = 0.65
FALLBACK_CONFIDENCE = 0.30

# --- Fixed values: scoring methods --------------------------------------------
PRIMARY_METHOD = "qlora_direct"
FALLBACK_METHOD = "sklearn_tfidf"

# --- Fixed values: limits and training defaults -------------------------------
MIN_NOTE_LENGTH = 1
MAX_NOTE_LENGTH = 1000
MAX_BATCH_SIZE = 50
MIN_VALID_RECORDS = 10
TEST_SIZE = 0.2
SEED = 42
N_FOLDS = 5
EXAMPLES_PER_CATEGORY = 6
N_TREES = 200
MAX_FEATURES = 5000
MIN_DF = 2
MAX_DF = 0.95
MIN_LEAF = 2
MIN_SPLIT = 5
LEAKAGE_F1 = 0.99
RECENT_ROWS = 10
NOTE_PREVIEW = 100

# --- Fixed values: cells a CSV reader takes as missing ------------------------
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- Fixed values: secret patterns, applied in this order ---------------------
SECRET_PATTERNS = [
    r"(API_KEY|api-key|api_key|X-API-Key)\s*[:=]\s*\S+",
    r"(password|passwd|pwd|secret|token)\s*[:=]\s*\S+",
    r"(Authorization:\s*Bearer)\s+\S+",
]
REDACTED = "=***REDACTED***"

# --- Fixed values: prompts ----------------------------------------------------
ZERO_SHOT_PROMPT = (
    "You are a sales intelligence analyst. Classify the following "
    "sales representative field note into exactly ONE of these categories:\n\n"
    "1. supply_chain_delay — stock shortages, delivery delays, replenishment issues\n"
    "2. retailer_dissatisfaction — complaints, unhappy retailers, service issues\n"
    "3. pricing_conflict — price disputes, margin concerns, discount conflicts\n"
    "4. competitor_pressure — competitor actions, market share threats, rival offers\n"
    "5. demand_spike — unexpected demand surges, stockout from high volume\n\n"
    "Sales Note: {note}\n\n"
    "Respond with ONLY the category name (e.g., supply_chain_delay). "
    "No explanation, no extra text.\n"
    "Category:"
)
SHORT_PROMPT = "Classify this sales note: {note}\nCategory:"
SYSTEM_PROMPT = (
    "You are a sales intelligence analyst for an FMCG company. "
    "Your task is to classify sales representative field notes into "
    "exactly one of these 5 issue categories:\n"
    "1. supply_chain_delay — stock shortages, delivery delays, replenishment issues\n"
    "2. retailer_dissatisfaction — complaints, unhappy retailers, service issues\n"
    "3. pricing_conflict — price disputes, margin concerns, discount conflicts\n"
    "4. competitor_pressure — competitor actions, market share threats, rival offers\n"
    "5. demand_spike — unexpected demand surges, stockouts from high volume\n\n"
    "Respond with ONLY the category name. No explanation."
)
CHAT_USER_PROMPT = "Classify this sales note: {note}"
TRAINING_TEXT = (
    "### Instruction:\n" + SYSTEM_PROMPT + "\n\n"
    "### Input:\n{input}\n\n"
    "### Response:\n{output}"
)
EVALUATION_PROMPT = (
    "### Instruction:\n"
    "You are a sales intelligence analyst. Classify the note into one of: "
    "supply_chain_delay, retailer_dissatisfaction, pricing_conflict, "
    "competitor_pressure, demand_spike. Respond with ONLY the category name."
    "\n\n### Input:\n{note}\n\n### Response:\n"
)
FEWSHOT_INTRO = (
    "You are a sales intelligence expert for a FMCG/consumer goods company. "
    "Your ONLY task is to classify sales representative field notes into "
    "exactly one of these 5 issue categories:\n"
)
CATEGORY_DEFINITIONS = {
    "supply_chain_delay": (
        "Stock shortages, delivery delays, replenishment issues, "
        "inventory mismatch, products running out, slow stock movement, "
        "warehouse follow-up, backorders"
    ),
    "retailer_dissatisfaction": (
        "Retailer complaints, unhappiness with service, relationship "
        "issues, frustration, anger, poor experience, service quality "
        "problems, threats to reduce business"
    ),
    "pricing_conflict": (
        "Price disputes, margin concerns, pricing disagreements, "
        "discount conflicts, billing issues, rates too high, "
        "pricing policy complaints"
    ),
    "competitor_pressure": (
        "Competitor actions, rival campaigns, retailers switching to "
        "competitors, competitor pricing, market share threats, "
        "competitive product launches"
    ),
    "demand_spike": (
        "Unexpected demand surges, demand overflow, stockouts from "
        "high volume, sudden rush, orders exceeding forecast, "
        "supply couldn't meet demand"
    ),
}
FEWSHOT_EXAMPLES_HEADING = "\nHere are examples of how to classify notes:\n"
FEWSHOT_SEPARATOR = "---"
FEWSHOT_RULES = (
    "\nRULES:\n"
    "- Respond with ONLY the exact category name (e.g., supply_chain_delay)\n"
    "- Do NOT add explanations, reasoning, or extra text\n"
    "- Choose the SINGLE best category\n"
    "- If unsure, choose the category closest to the note's main issue"
)
PRIMARY_REASONING = (
    "QLoRA fine-tuned Gemma-2B classified the note as '{category}' "
    "in {latency}s (confidence: {confidence})"
)
FALLBACK_REASONING = (
    "TF-IDF + RandomForest classified as '{category}' ({confidence} confidence)"
)
TURN_START = "<start_of_turn>"
TURN_END = "<end_of_turn>\n"

# --- Fixed values: sales shorthand and its full words -------------------------
ABBREVIATIONS = {
    "stk": "stock",
    "nt": "not",
    "cmng": "coming",
    "frm": "from",
    "dys": "days",
    "wks": "weeks",
    "dlvry": "delivery",
    "dlvr": "deliver",
    "repl": "replenishment",
    "ret": "retailer",
    "reps": "representative",
    "repr": "representative",
    "cust": "customer",
    "custs": "customers",
    "pr": "price",
    "prc": "price",
    "prblm": "problem",
    "prblms": "problems",
    "cmpln": "complain",
    "cmplns": "complains",
    "cmplng": "complaining",
    "inc": "increase",
    "dcr": "decrease",
    "dmn": "demand",
    "spk": "spike",
    "cmptr": "competitor",
    "cmptrs": "competitors",
    "invntry": "inventory",
    "invtry": "inventory",
    "wrg": "wrong",
    "ordr": "order",
    "ordrs": "orders",
    "amt": "amount",
    "qtty": "quantity",
    "qty": "quantity",
    "pd": "paid",
    "pdbl": "payable",
    "bl": "bill",
    "bllng": "billing",
    "pdct": "product",
    "pdcts": "products",
    "dlay": "delay",
    "dlays": "delays",
    "dlayed": "delayed",
    "ot": "out of",
    "stkout": "stockout",
    "bck": "back",
    "bk": "back",
    "rgnl": "regional",
    "reg": "region",
    "dlv": "deliver",
    "dlvd": "delivered",
    "shrtg": "shortage",
    "srvc": "service",
    "srvcng": "servicing",
    "ups": "upsell",
    "crs": "cross",
    "sls": "sales",
    "slsmn": "salesman",
    "slsprsn": "salesperson",
    "mkt": "market",
    "mktng": "marketing",
    "ftr": "feature",
    "bnft": "benefit",
    "whsl": "wholesale",
    "rtlr": "retailer",
    "rtl": "retail",
    "mgn": "margin",
    "mrgn": "margin",
    "ntwk": "network",
    "dl": "deal",
    "dls": "deals",
    "cntrct": "contract",
    "cntrcts": "contracts",
    "rqrmnt": "requirement",
    "qlyty": "quality",
    "qlty": "quality",
    "std": "standard",
    "hvy": "heavy",
    "lgt": "light",
    "lrg": "large",
    "sml": "small",
    "mk": "make",
    "sv": "save",
    "gv": "give",
    "gt": "get",
    "gl": "goal",
    "trg": "target",
    "trgt": "target",
    "incntv": "incentive",
    "rt": "rate",
    "rtng": "rating",
    "rvw": "review",
    "pndng": "pending",
    "apprv": "approve",
    "rjct": "reject",
    "rjctd": "rejected",
    "apprvl": "approval",
    "tx": "tax",
    "wh": "warehouse",
    "whs": "warehouse",
    "cncl": "cancel",
    "cnfld": "confidential",
    "pndt": "pending",
    "rfr": "refer",
    "rmnd": "remind",
    "rmndr": "reminder",
    "shpng": "shipping",
    "shp": "ship",
    "rcv": "receive",
    "rcvd": "received",
    "snd": "send",
    "sndng": "sending",
    "hdqtr": "headquarters",
    "offc": "office",
    "dept": "department",
    "div": "division",
    "mgr": "manager",
    "hod": "head",
}
