"""Patterns, vocabularies and priorities that results depend on.

Spark patterns spell ASCII word bounds as look-arounds, as Java's ``\\b`` follows
Unicode; the SQL spellings are for engines with ASCII bounds.
"""

from __future__ import annotations

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Personal data in text, in the order in which they are redacted.
CARD = _B + r"(?:[0-9]{4}[ -]?){3}[0-9]{4}" + _E
SSN = _B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_OPEN = r"(?:\+?[0-9]{1,3}[-.\s]?)?(?:\(?[0-9]{3}\)?[-.\s]?)?[0-9]{3}[-.\s]?[0-9]{4}"
PHONE = PHONE_OPEN + _E
#: Every text with a card, SSN, e-mail or phone has four digits in a row or an at sign.
MAYBE = "[0-9]{4}|@"
TEXT_PATTERNS = (("card", CARD), ("ssn", SSN), ("email", EMAIL), ("phone", PHONE))
SQL_PATTERNS = {
    "card": r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "email": EMAIL,
    "phone": r"(?:\+?[0-9]{1,3}[-.\s]?)?(?:\(?[0-9]{3}\)?[-.\s]?)?[0-9]{3}[-.\s]?[0-9]{4}\b",
}
# Passwords in clear in a serialised tree.
CLEAR_PASSWORD = r'(?i:(?:secret|plaintext|cleartext)[-_ ]?password|(?:password|passwd|passcode)":\s*"(?!\[REDACTED_)[^"]+")'
# The order in which spans are claimed.
SPAN_PATTERNS = (("ssn", SSN), ("card", CARD), ("email", EMAIL), ("phone", PHONE_OPEN))

# Typed tokens.
TOKENS = {c: f"[REDACTED_{c.upper()}]" for c in ("password", "email", "card", "ssn", "phone", "name", "pii")}
TOKEN_OF = {
    "password": "password", "passwd": "password", "pwd": "password", "passcode": "password", "secret": "password",
    "email": "email",
    "card": "card", "creditcard": "card", "credit_card": "card", "cvv": "card", "cvc": "card", "pan": "card",
    "ssn": "ssn", "social": "ssn", "social_security": "ssn", "tax": "ssn",
    "phone": "phone", "tel": "phone", "telephone": "phone", "mobile": "phone",
    "name": "name", "fullname": "name", "firstname": "name", "lastname": "name", "face": "name",
    "pin": "pii", "otp": "pii", "pii": "pii",
}
REDACTION_PRIORITY = ("password", "card", "pin", "otp", "ssn", "tax", "email", "phone", "name", "face", "pii")
MERGE_PRIORITY = ("password", "pin", "otp", "card", "ssn", "tax", "email", "phone", "face")
SOURCE_ORDER = ("dom", "ocr", "face", "vision", "cv")

# Identity slugs in urls.
USER_PATH = r"(?i)(/(?:in|user|users|profile|u|author|c|member|people)/)([a-zA-Z0-9._-]+)"
TILDE_PATH = r"(/~)([a-zA-Z0-9._-]+)"
USER_QUERY = r"(?i)([?&](?:u|user|username|name|profile|author)=)([^&#]+)"

# Sensitive keywords and what they mean.
KEYWORDS = ("ssn", "social", "card", "cvv", "cvc", "otp", "pan", "pin", "password", "passwd", "pwd", "passcode", "secret", "tax")
KEYWORD_CATEGORY = (
    ("password", "password|passwd|pwd|passcode|secret"), ("card", "card|cvv|cvc|pan|cc"), ("ssn", "ssn|social"), ("tax", "tax"), ("otp", "otp"),
    ("pin", "pin"), ("email", "email"), ("phone", "tel|phone"), ("name", "name|fullname"), ("card", "bank|routing|account|financial"), ("pii", "address|street|city|zip|dob|birth"),
)
STRUCTURAL_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "header", "nav", "footer", "title", "legend")
PII_ATTRIBUTE = {
    "credit-card": ("card", "card"), "card": ("card", "card"), "email": ("email", "email"), "password": ("password", "password"), "pin": ("pin", "pin"),
    "phone": ("phone", "phone"), "tel": ("phone", "phone"), "ssn": ("ssn", "ssn"), "name": ("name", "name"), "financial": ("card", "financial"),
    "address": ("pii", "address"), "dob": ("pii", "dob"), "face": ("face", "face"),
}
AUTOCOMPLETE = (("card", r"(?i)(?<![a-z0-9_])cc-[-a-z0-9]+"), ("email", r"(?i)(?<![a-z0-9_])email(?![a-z0-9_])"), ("tel", r"(?i)(?<![a-z0-9_])tel(?:-[-a-z0-9]+)?(?![a-z0-9_])"), ("name", r"(?i)(?<![a-z0-9_])(?:name|given-name|family-name|additional-name|nickname)(?![a-z0-9_])"))
FORM_NAME = r"(?i)^(?:first[_-]?name|last[_-]?name|full[_-]?name|user[_-]?name|nickname|sur[_-]?name|family[_-]?name|given[_-]?name)$"
FORM_NAME_HINT = r"(?i)(?:first[-_]?name|last[-_]?name|full[-_]?name)"

# Words that are no personal names, and particles that may be lower case.
UI_WORDS = (
    "login", "log in", "signin", "sign in", "signup", "sign up", "register", "home", "homepage", "dashboard", "settings", "profile", "user profile", "welcome", "overview", "search",
    "notifications", "messages", "help", "privacy", "terms", "privacy policy", "terms of service", "about", "contact", "cart", "checkout", "billing", "shipping", "order", "feed", "timeline",
)
PARTICLES = ("de", "van", "von", "del", "der", "la", "le", "di")
NAME_WORD = r"^[A-Za-zÀ-ÖØ-öø-ÿ'. -]+$"

# Actions.
LOW_RISK_TYPES = ("scroll", "wait", "read", "sleep", "done")
HIGH_RISK = (
    ("submit", r"(?:submit|submit[\s_-]?(?:form|order|payment|application|data))"),
    ("delete", r"(?:delete|destroy|purge|erase|wipe|discard|trash|remove[\s_-]?(?:account|user|card|item|all)?|cancel[\s_-]?(?:account|subscription|membership|order|service|plan)?|close[\s_-]?account|terminate[\s_-]?(?:account|session)?|deactivate[\s_-]?account|logout|log[\s_-]?out|sign[\s_-]?out)"),
    ("payment", r"(?:payment|checkout|place[\s_-]?order|buy(?:[\s_-]?now)?|subscribe|subscription|charge|billing|invoice|transaction|credit[\s_-]?card|debit[\s_-]?card|card[\s_-]?number|cvv|cvc|security[\s_-]?code|submit[\s_-]?payment|complete[\s_-]?order|complete[\s_-]?purchase|wire[\s_-]?transfer|pay(?:\b|[\s_.-]|$))"),
    ("send", r"(?:(?:^|[\s_.-])send(?:[\s_.-]|$)|send[\s_-]?(?:message|email|mail|dm|chat|sms|funds|money)|submit[\s_-]?(?:message|post)|post[\s_-]?(?:comment|reply|tweet)|tweet|publish|dispatch)"),
    ("change_password", r"(?:(?:change|update|reset|modify|new|set)[\s_-]?(?:password|passwd|credentials|secret)|security[\s_-]?settings|two[\s_-]?factor|2fa|mfa)"),
)

# Badge texts over redacted regions.
BADGES = {
    "password": "[PASSWORD]", "passwd": "[PASSWORD]", "pwd": "[PASSWORD]", "passcode": "[PASSWORD]", "pin": "[PIN]", "otp": "[OTP]",
    "card": "[CREDIT CARD]", "credit_card": "[CREDIT CARD]", "creditcard": "[CREDIT CARD]", "ssn": "[SSN]", "social": "[SSN]", "tax": "[TAX ID]", "email": "[EMAIL]",
    "phone": "[PHONE]", "tel": "[PHONE]", "name": "[NAME]", "fullname": "[NAME]", "face": "[FACE]", "pii": "[PII]",
}

# Words that say nothing about an action's target.
TARGET_STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "into")
TARGET_VERBS = ("play", "click", "search", "open", "watch", "find", "listen", "start", "select")

# Plans.
TASK_VERBS = ("play", "click", "search", "enter", "type", "open", "press", "submit", "select", "find", "watch", "listen", "start")
GIVEN_UP = ("cannot", "unable", "inaccessible", "could not", "not found", "redacted", "hidden", "no exposed")
PLACEHOLDER_SELECTORS = ("#element-id", "element-id", "#play-btn", "#btn", "#target", "null", "none")
PLACEHOLDER_REASONS = ("short explanation", "explanation", "null", "none", "")
TYPED_STOP_WORDS = ("play", "click", "open", "watch", "listen", "find", "search", "get", "my")

# The timed phases of a run.
PHASES = ("capture_ms", "dom_extract_ms", "dom_detect_ms", "vision_detect_ms", "face_detect_ms", "ocr_detect_ms", "region_merge_ms", "image_redact_ms", "dom_redact_ms", "serialization_ms", "transport_ms", "action_execution_ms", "total_client_ms")

# Tags that a compact tree keeps for themselves.
COMPACT_TAGS = ("button", "input", "select", "textarea", "a", "form", "option")

# Fields in which an agent must not type, and marks of redaction.
REFUSED_AUTOCOMPLETE = ("current-password", "new-password", "cc-number", "cc-csc", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-type", "transaction-amount", "bday", "sex", "ssn")
REFUSED_NAME = r"(?i)(password|passwd|pwd|passcode|secret|credit[-_]?card|card[-_]?num|cvv|cvc|security[-_]?code|ssn|social[-_]?sec)"
REFUSED_DATA = (("data_sensitive", "true"), ("data_redacted", "true"), ("data_privacy", "redacted"))
MARK = r"(?i)\[REDACTED(?:_[A-Z0-9]+)?\]"
