"""Fixed word lists, weights and patterns shared by all jobs."""

# ---------------------------------------------------------------------------
# They must equal the published rules for scores to match.
# ---------------------------------------------------------------------------

# URL rules
SUSPICIOUS_TLDS = [
    ".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".club", ".work", ".buzz",
    ".info", ".click", ".link", ".win", ".bid", ".stream", ".racing", ".icu", ".monster",
]
URL_SHORTENERS = [
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly",
    "rebrand.ly", "cutt.ly", "shorturl.at",
]
BRAND_VARIANTS = {
    "google": ["gogle", "googl", "gooogle", "g00gle", "googie", "goog1e"],
    "facebook": ["facbook", "facebok", "faceb00k", "faceboook", "faccebook"],
    "amazon": ["amaz0n", "amazom", "amazone", "arnazon", "amazn"],
    "apple": ["appie", "app1e", "aple", "applle"],
    "microsoft": ["micros0ft", "microsft", "mircosoft", "microsoftt", "micr0soft"],
    "netflix": ["netfIix", "netfl1x", "nettflix", "netfiix"],
    "paypal": ["paypa1", "paypai", "paypaI", "paypall", "paypl"],
    "instagram": ["instagam", "instgram", "instagran", "lnstagram"],
    "twitter": ["twiter", "twtter", "tvvitter", "twltter"],
    "linkedin": ["linkedln", "linkdin", "l1nkedin", "linkedn"],
    "whatsapp": ["whatsap", "watsapp", "whatspp", "whatssapp"],
    "banking": ["bankofamerica", "wellsfargo", "chase", "citi"],
}
URL_KEYWORDS = [
    "login", "signin", "verify", "update", "secure", "account", "confirm",
    "banking", "password", "credential", "authenticate", "suspend", "locked",
    "unusual", "activity", "expire", "urgent", "alert", "wallet", "prize",
    "winner", "free", "gift", "reward", "claim", "offer",
]
SPECIAL_CHARS = "@!#$%^&*()+=[]{}|\\<>?"
SUSPICIOUS_PARAMS = ["password", "token", "session", "redirect", "return", "next", "callback"]
WELL_KNOWN_DOMAINS = [
    "google.com", "www.google.com", "youtube.com", "www.youtube.com",
    "facebook.com", "www.facebook.com", "instagram.com", "www.instagram.com",
    "twitter.com", "www.twitter.com", "x.com",
    "amazon.com", "www.amazon.com", "amazon.in", "www.amazon.in",
    "microsoft.com", "www.microsoft.com", "linkedin.com", "www.linkedin.com",
    "apple.com", "www.apple.com", "netflix.com", "www.netflix.com",
    "github.com", "www.github.com", "stackoverflow.com",
    "wikipedia.org", "en.wikipedia.org",
    "reddit.com", "www.reddit.com",
    "whatsapp.com", "web.whatsapp.com",
    "paypal.com", "www.paypal.com",
    "mail.google.com", "accounts.google.com", "drive.google.com",
]

# URL model features
MODEL_FEATURES = [
    "url_length", "path_length", "dot_count", "hyphen_count", "underscore_count",
    "slash_count", "question_count", "equal_count", "at_count", "digit_count",
    "letter_count", "digit_ratio", "vowel_count", "vowel_ratio", "has_ip",
    "subdomain_len", "domain_len", "sus_tld", "sus_keyword_count", "char_diversity",
]
MODEL_TLDS = [
    "tk", "ml", "ga", "cf", "gq", "xyz", "top", "club", "work", "buzz", "info",
    "live", "icu", "vip",
]
MODEL_KEYWORDS = [
    "login", "signin", "verify", "update", "secure", "account", "banking",
    "confirm", "free", "bonus", "claim", "admin", "service", "support",
]
LEXICAL_FEATURES = [
    "url_length", "path_length", "dot_count", "hyphen_count", "digit_count",
    "special_chars", "at_symbol", "has_https", "has_ip", "subdomain_len",
    "domain_len", "sus_tld", "has_sus_keyword", "char_diversity",
]
LEXICAL_TLDS = ["tk", "ml", "ga", "cf", "gq", "xyz", "top", "club", "work", "buzz", "info"]
LEXICAL_KEYWORDS = [
    "login", "signin", "verify", "update", "secure", "account", "banking", "confirm",
]
BASIC_SPECIAL_CHARS = "!@#$%^&*(),?\":{}|<>"
MALICIOUS_TYPES = ["phishing", "malware", "defacement"]

# Email rules
MAIL_URGENCY = [
    "urgent", "immediately", "action required", "act now", "expire", "suspended",
    "verify your", "confirm your", "update your", "click here", "click below",
    "limited time", "within 24 hours", "within 48 hours", "account will be",
    "unauthorized", "unusual activity", "security alert", "important notice",
    "final warning", "last chance", "penalty", "legal action",
]
MAIL_PATTERNS = [
    r"dear\s+(customer|user|member|account\s*holder)",
    r"we\s+(have\s+)?detected\s+(unusual|suspicious)",
    r"your\s+account\s+(has\s+been|will\s+be)\s+(suspend|lock|restrict|close|disable)",
    r"click\s+(here|below|the\s+link)",
    r"verify\s+your\s+(identity|account|information)",
    r"update\s+your\s+(payment|billing|account)",
    r"(you\s+have\s+won|congratulations|winner)",
    r"(password|credential|ssn|social\s+security)",
]
DANGEROUS_EXTENSIONS = [
    ".exe", ".bat", ".cmd", ".com", ".scr", ".pif", ".js", ".jse",
    ".vbs", ".vbe", ".wsf", ".wsh", ".ps1", ".msi", ".dll", ".reg",
    ".hta", ".cpl", ".inf", ".lnk", ".jar",
]
SUSPICIOUS_SENDERS = [
    "mail.ru", "yandex.ru", "tempmail.com", "guerrillamail.com",
    "throwaway.email", "mailinator.com", "sharklasers.com",
]
MAIL_LINK_PATTERN = r"https?://[^\s<>\"']+|www\.[^\s<>\"']+"
FORM_LINK_PATTERN = r"https?://[^\s]+"

# SMS rules
SMS_URGENCY = [
    "urgent", "immediately", "act now", "expire", "suspended", "locked",
    "final notice", "last chance", "within 24", "within 48", "right away",
]
SMS_PRIZE = [
    "winner", "won", "prize", "lottery", "congratulations", "selected",
    "reward", "free gift", "claim", "lucky", "jackpot", "cash prize",
]
SMS_THREAT = [
    "suspended", "blocked", "unauthorized", "unusual activity", "compromised",
    "disabled", "restricted", "penalty", "legal action", "arrest", "warrant",
]
SMS_OTP_PATTERNS = [
    r"your\s+(otp|code|pin)\s+is",
    r"verification\s+code",
    r"do\s+not\s+share",
    r"one[\s-]?time\s+password",
]
SMS_FINANCIAL = [
    "bank", "credit card", "debit card", "payment", "transaction",
    "transfer", "refund", "irs", "tax", "loan", "insurance",
]
SMS_ACTION = [
    "click", "tap", "visit", "go to", "open", "call", "dial", "reply",
    "send", "confirm", "verify", "update", "download", "install",
]
SMS_LINK_PATTERN = r"https?://[^\s]+|www\.[^\s]+|bit\.ly/[^\s]+|tinyurl\.com/[^\s]+"
SMS_LINK_WORDS = ["click", "tap", "visit", "go to"]

# Corpus labels and column names
POSITIVE_LABELS = [
    "1", "phishing", "phish", "spam", "malicious", "fraud", "scam", "yes", "true",
]
NEGATIVE_LABELS = ["0", "legitimate", "legit", "ham", "safe", "no", "false"]
TEXT_COLUMNS = ["text", "email", "body", "content", "message", "mail", "emailtext"]
LABEL_COLUMNS = ["label", "labels", "class", "target", "is_phishing", "phishing", "spam"]

# ---------------------------------------------------------------------------
# Own defaults: replace them with fuller lists through the function arguments.
# ---------------------------------------------------------------------------

# Public-suffix seed in the public list's own notation (`*.` wildcard, `!` exception).
SUFFIXES = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name",
    "io", "co", "ai", "app", "dev", "me", "tv", "cc", "ly", "at",
    "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "au", "com.au", "net.au", "org.au",
    "in", "co.in", "net.in", "jp", "co.jp", "ac.jp", "br", "com.br",
    "de", "fr", "es", "it", "nl", "ch", "se", "no", "pl", "eu", "us", "ca",
    "ru", "cn", "com.cn", "gl", "gd", "email",
    "tk", "ml", "ga", "cf", "gq", "xyz", "top", "club", "work", "buzz",
    "click", "link", "win", "bid", "stream", "racing", "icu", "monster",
    "live", "vip", "online", "site", "shop",
    "*.ck", "!www.ck",
]

# English function words removed before n-grams are formed.
STOP_WORDS = (
    "about above after again against all also am an and any are as at be because been "
    "before being below between both but by can could did do does doing down during each "
    "few for from further had has have having he her here hers herself him himself his how "
    "if in into is it its itself just me more most my myself no nor not now of off on once "
    "only or other our ours ourselves out over own same she should so some such than that "
    "the their theirs them themselves then there these they this those through to too "
    "under until up us very was we were what when where which while who whom why will with "
    "would you your yours yourself yourselves"
).split()
