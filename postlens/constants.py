"""Word lists, patterns, labels and formats the results depend on."""

# --- fixed values: word lists -------------------------------------------------
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]

SUSPICIOUS_PHRASES = [
    "urgent", "immediate", "quick money", "work from home",
    "no experience needed", "earn money fast", "get rich quick",
    "investment", "bitcoin", "crypto", "lottery", "inheritance",
    "foreign prince", "bank transfer", "wire transfer",
]

LINK_KEYWORDS = ["job", "career", "position", "vacancy", "opportunity", "hiring"]

# --- fixed values: label sets -------------------------------------------------
TRADE_LABELS = [
    "plumber", "driver", "sweeper", "electrician", "chef", "carpenter",
    "painter", "guard", "cleaner", "computer operator", "technician", "security",
]
CANDIDATE_LABELS = [
    "software engineer", "electrician", "sweeper", "data scientist", "plumber",
    "mechanic", "driver", "teacher", "nurse", "sales",
]
TARGET_LABELS = ["driver", "electrician", "plumber"]
LEVELS_ENTRY = ["entry-level", "mid-level", "senior-level"]
LEVELS_JUNIOR = ["junior", "mid", "senior"]
HYPOTHESIS_TEMPLATE = "This is a job description for a {}."

# --- fixed values: patterns ---------------------------------------------------
# \w of the original patterns is Unicode; [\p{L}\p{N}_] states the same set here.
WORD = r"\p{L}\p{N}_"
EMAIL_PATTERN = rf"[{WORD}.-]+@[{WORD}.-]+"
PHONE_PATTERN = r"\b(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
TEN_DIGIT_PATTERN = r"\b\d{10}\b"
# one character after the slashes decides the match, so no repetition is stated
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))"
COMPANY_PATTERN = r"(company|corporation|inc\.|ltd\.|llc)"
LOCATION_PATTERN = r"(address|location|city|state|zip)"

SKILL_PATTERNS = [
    r"\b(?:experienced|skilled|proficient|expert|knowledge of|familiar with)\s+([^.,]+)",
    r"\b(?:required|needed|must have|should have)\s+([^.,]+)",
    r"\b(?:ability to|capable of|can)\s+([^.,]+)",
]

_AMOUNT = r"(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"
SALARY_PATTERNS = [
    rf"\${_AMOUNT}\s*(?:-|to)\s*\${_AMOUNT}",
    rf"{_AMOUNT}\s*(?:-|to)\s*{_AMOUNT}\s*(?:per|/)\s*(?:year|month|hour|week)",
    rf"salary:\s*\$?{_AMOUNT}\s*(?:-|to)\s*\$?{_AMOUNT}",
]
SALARY_CURRENCY = "USD"

PAGE_STATE_CLASSES = {
    "job_listings": ("div", "job|listing|posting"),
    "pagination": ("a", "page|next|pagination"),
    "job_details": ("div", "detail|description|content"),
}

# --- fixed values: limits and thresholds --------------------------------------
CHUNK_CHARS = 1024
SUMMARY_MAX_WORDS = 100
SUMMARY_MIN_WORDS = 30
KEY_POINT_LIMIT = 5
OCR_MIN_CONFIDENCE = 60
PREVIEW_CHARS = 50
RISK_RED = 0.7
RISK_ORANGE = 0.3
ENTRY_BELOW_YEARS = 2
MID_BELOW_YEARS = 5
STUB_CONFIDENCE = 0.9
DRIFT_SHARE = 0.5

# --- fixed values: storage ----------------------------------------------------
STORE_DATABASE = "job_classifier"
STORE_TABLE = "classified_jobs"
SNAPSHOT_STAMP = "%Y%m%d_%H%M%S"

# --- fixed values: placeholders for absent fields -----------------------------
NOT_AVAILABLE = "N/A"
NOT_SPECIFIED = "Not specified"
NOT_MENTIONED = "Not Mentioned"
