"""Word lists, patterns, lookup tables and weights.

Everything in this module is data that decides results. It is stated once, in
plain text, and the operators only ever read it.
"""

# --- sources ---------------------------------------------------------------
SOURCE_NVD = "nvd"
SOURCE_NEWS = "thehackernews"

# --- masks (pattern -> replacement), applied in the order given --------------
URL_PATTERN = r"https?://[^\s\p{Z}]+"
EMAIL_PATTERN = r"[^\s\p{Z}]+@[^\s\p{Z}]+"
MD5_PATTERN = r"\b[a-fA-F0-9]{32}\b"
SHA256_PATTERN = r"\b[a-fA-F0-9]{64}\b"
CVE_PATTERN = r"(?i)CVE-[0-9]{4}-[0-9]{4,7}"
VERSION_PATTERN = r"[0-9]+\.[0-9]+\.[0-9]+"
IP_PATTERN = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"

ATTACK_MASKS = [
    (r"(?i)\b(?:sql injection|sqli)\b", "SQL_INJECTION"),
    (r"(?i)\b(?:cross[- ]?site[- ]?scripting|xss)\b", "XSS"),
    (r"(?i)\b(?:denial[- ]?of[- ]?service|dos|ddos)\b", "DOS_ATTACK"),
    (r"(?i)\b(?:remote code execution|rce)\b", "RCE"),
    (r"(?i)\b(?:cross[- ]?site[- ]?request[- ]?forgery|csrf)\b", "CSRF"),
]

MASK_WORDS = [
    "URL", "EMAIL", "MD5_HASH", "SHA256_HASH", "CVE_REFERENCE", "VERSION_NUMBER",
    "IP_ADDRESS", "SQL_INJECTION", "XSS", "DOS_ATTACK", "RCE", "CSRF",
]

# --- English stop words ------------------------------------------------------
STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# --- noun forms that the suffix rules would get wrong ------------------------
LEMMA_EXCEPTIONS = {
    "men": "man", "women": "woman", "children": "child", "people": "people",
    "mice": "mouse", "feet": "foot", "teeth": "tooth", "criteria": "criterion",
    "phenomena": "phenomenon", "indices": "index", "matrices": "matrix",
    "vertices": "vertex", "appendices": "appendix", "analyses": "analysis",
    "bases": "base", "crises": "crisis", "hypotheses": "hypothesis",
    "lives": "life", "knives": "knife", "wives": "wife", "leaves": "leaf",
    "halves": "half", "shelves": "shelf", "selves": "self", "wolves": "wolf",
    "viruses": "virus", "buses": "bus", "statuses": "status", "news": "news",
    "series": "series", "species": "species", "gas": "gas", "bias": "bias",
    "alias": "alias", "aliases": "alias", "canvas": "canvas", "movies": "movie",
    "cookies": "cookie", "zombies": "zombie", "caches": "cache",
    "databases": "database", "leases": "lease", "releases": "release",
    "houses": "house", "responses": "response", "phases": "phase",
    "purposes": "purpose", "cases": "case", "uses": "use", "axes": "axis",
    "kubernetes": "kubernetes", "https": "https", "dns": "dns", "ios": "ios",
    "sas": "sas", "aws": "aws", "windows": "window",
}

# --- threat categories -------------------------------------------------------
CATEGORIES = [
    "Phishing", "Ransomware", "Malware", "SQLInjection", "XSS", "DDoS", "ZeroDay",
    "SupplyChain", "Other",
]
CATEGORY_PATTERNS = {
    "Phishing": ["phish", "credential", "email scam", "spoof"],
    "Ransomware": ["ransom", "crypto.*currency", "file.*locked"],
    "Malware": ["malware", "trojan", "virus", "worm"],
    "SQLInjection": ["sql.*injection", "database.*injection"],
    "XSS": ["cross.?site.?script", "xss"],
    "DDoS": ["denial.?of.?service", "ddos"],
    "ZeroDay": ["zero.?day", "0.?day", "unpatched"],
    "SupplyChain": ["supply.?chain", "vendor", "third.?party"],
}
CWE_LABELS = {"CWE-79": "XSS", "CWE-89": "SQLInjection", "CWE-119": "Malware"}

# Themes of the keyword chart, used where no classifier result is at hand.
THEME_KEYWORDS = {
    "Phishing": ["phish", "credential", "spoof"],
    "Ransomware": ["ransom", "encrypt", "lock"],
    "Malware": ["malware", "trojan", "virus"],
    "SQL Injection": ["sql", "injection", "database"],
    "XSS": ["xss", "script", "cross-site"],
    "DDoS": ["ddos", "denial", "service"],
}

# --- keyword rules -----------------------------------------------------------
EXPLOIT_PATTERN = "exploit|poc|proof of concept"
PATCH_PATTERN = "patch|fix|update"
ZERO_DAY_PATTERN = "zero.?day|0.?day|unpatched"

# --- urgency -----------------------------------------------------------------
FACTORS = ["severity", "sentiment", "exploit", "patch", "recency", "articles"]
PRODUCTION_WEIGHTS = {
    "severity": 0.45, "sentiment": 0.15, "exploit": 0.05, "patch": 0.25,
    "recency": 0.05, "articles": 0.05,
}
TUNING_WEIGHTS = {
    "severity": 0.35, "sentiment": 0.25, "exploit": 0.15, "patch": 0.15,
    "recency": 0.10, "articles": 0.05,
}
WEIGHT_OPTIONS = {
    "severity": [0.25, 0.35, 0.45], "sentiment": [0.15, 0.25, 0.35],
    "exploit": [0.05, 0.15, 0.25], "patch": [0.05, 0.15, 0.25],
    "recency": [0.05, 0.10, 0.15], "articles": [0.00, 0.05, 0.10],
}
LEVELS = ["Low", "Medium", "High"]
LEVEL_CUTS = [0.0, 0.33, 0.66, 1.01]

# --- parameter grids ---------------------------------------------------------
MIN_DF_GRID = [1, 2, 3, 5, 10]
MAX_DF_GRID = [0.7, 0.8, 0.9, 0.95, 1.0]
FOREST_TREES_GRID = [50, 80, 100, 120]
FOREST_DEPTH_GRID = [None, 10, 20, 30]
FOREST_MIN_SPLIT_GRID = [2, 5, 10]

# --- article parsing ---------------------------------------------------------
PRODUCT_VERSION_PATTERNS = [
    r"(?i)affects?\s+([A-Za-z0-9\s\-\.]+)\s+version\s*([0-9\.\-\s]+)",
    r"(?i)([A-Za-z0-9\s\-\.]+)\s+version\s*([0-9\.\-\s]+)\s+(?:is\s+)?(?:vulnerable|affected)",
    r"(?i)vulnerable\s+versions?\s+of\s+([A-Za-z0-9\s\-\.]+)",
    r"(?i)([A-Za-z0-9\s\-\.]+)\s+(?:versions?\s*)?(?:before|prior\s+to|up\s+to)\s+([0-9\.\-\s]+)",
]
KNOWN_PRODUCTS = [
    "Windows", "Linux", "Android", "iOS", "Chrome", "Firefox", "Safari", "Edge",
    "Apache", "Nginx", "WordPress", "Drupal", "Jenkins", "Docker", "Kubernetes",
    "OpenSSL", "Java", "Python", "PHP", "MySQL", "PostgreSQL", "MongoDB", "Redis",
    "Elasticsearch",
]
VULNERABILITY_WORDS = "vulnerability|flaw|bug|exploit|affected|vulnerable"
ARTICLE_KEYS = [
    "source", "text", "published_date", "products", "tags", "url", "cves",
    "ingest_ts_thn",
]

# --- weakness catalogue ------------------------------------------------------
CWE_SPECIAL = {
    "NVD-CWE-Other": "Weakness not included in CWE list",
    "NVD-CWE-noinfo": "Insufficient information to assign CWE",
}
CWE_FALLBACK = {
    "CWE-20": "Improper Input Validation", "CWE-22": "Path Traversal",
    "CWE-78": "OS Command Injection", "CWE-79": "Cross-site Scripting",
    "CWE-89": "SQL Injection", "CWE-94": "Code Injection",
    "CWE-119": "Buffer Overflow", "CWE-125": "Out-of-bounds Read",
    "CWE-200": "Information Exposure", "CWE-287": "Improper Authentication",
    "CWE-352": "Cross-Site Request Forgery",
    "CWE-400": "Uncontrolled Resource Consumption", "CWE-416": "Use After Free",
    "CWE-434": "Unrestricted Upload of File",
    "CWE-502": "Deserialization of Untrusted Data",
    **CWE_SPECIAL,
}

# --- default sentiment lexicon (a stand-in for a model, see README) ----------
POSITIVE_WORDS = """
fixed patched update updated secure secured safe safely mitigated mitigation
resolved protect protected protection improve improved improvement prevent
prevented success successful recover recovered stable trusted benefit good
better best strong stronger
""".split()
NEGATIVE_WORDS = """
attack attacker attackers attacks breach breached compromise compromised critical
crash crashes damage danger dangerous denial drops exploit exploited exploits
fail failed failure flaw flaws fraud hostile improper injection leak leaked
malicious malware phishing ransomware risk severe steal steals stolen threat
trojan unpatched virus vulnerable vulnerability vulnerabilities weak worm bad
worse worst
""".split()

# --- HTML entities that are decoded by name ----------------------------------
HTML_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©",
    "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
    "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£",
    "sect": "§", "deg": "°", "times": "×",
}
