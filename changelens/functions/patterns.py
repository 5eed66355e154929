"""The patterns, phrases and labels that decide a change's noise reason and category.

All patterns are read without regard to case and with Unicode letters, digits, white space and
word borders, by Java's regular expressions (whatever the release's default is) as by Python's.
"""

from __future__ import annotations

# Dynamic tokens and their placeholders, in the order of masking.
DYNAMIC_TOKENS = (
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?\b", "<DATE>"),
    (r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b", "<DATE>"),
    (r"\b1[6-9]\d{8}(?:\d{3})?\b", "<EPOCH>"),
    (r"\b\d+\s+(?:second|minute|hour|day|week|month|year)s?\s+ago\b", "<RELTIME>"),
    (r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?\b", "<TIME>"),
    (r"(?:©|\(c\)|copyright)\s*\d{4}(?:\s*[-–]\s*\d{4})?", "<COPYRIGHT>"),
    (
        r"[?&](?:utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref|referrer|_ga|sessionid|session_id|csrf|csrf_token|nonce|cache|cb|v|ver|version|t|ts|hash)=[^\s&\"'<>]*",
        "?<TRACKING>",
    ),
    (r"\.[0-9a-f]{6,12}\.(?:js|css|png|jpg|jpeg|svg|webp|woff2?)\b", ".<HASH>."),
    (r"\b\d[\d,.]*\+?\s*(?:visitors?|views?|readers?|online|active now|people)\b", "<COUNTER>"),
    (r"\b[0-9a-f]{16,}\b", "<HEX>"),
)
#: By place in DYNAMIC_TOKENS: what a text holds wherever that token is found in it, without borders of words and so far quicker to search for.
DYNAMIC_GATES = (
    "[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-", r"(?U)\d-\d{2}-\d", r"(?U)\s\d{1,2},?\s+\d{4}", r"(?U)1[6-9]\d{8}", r"(?U)\s[aA][gG][oO]", r"(?U)\d:\d{2}", r"(?U)[©)tT]\s*\d{4}", r"(?U)[?&]\w+=",
    r"\.[0-9a-fA-F]{6,12}\.", r"(?U)\d[\d,.]*\+?\s*[vroapVROAP]", "[0-9a-fA-F]{16}",
)

# Vocabulary of the noise rules.
CURRENCY_WORDS = r"usd|eur|gbp|inr|rs\.?|rupees?|dollars?|euros?|pounds?"
PRICE_TOKEN = rf"(?:[$€£¥₹]\s?\d[\d,.]*|\b(?:{CURRENCY_WORDS})\s?\d[\d,.]*|\b\d[\d,.]*\s?(?:{CURRENCY_WORDS})\b)"
NOISE_PLAN_LIMIT = (
    r"\b(?:unlimited|\d[\d,]*)\s*(?:projects?|seats?|users?|members?|workspaces?|integrations?|credits?|requests?"
    r"|api calls?|environments?|repos?|repositories|gb\b|tb\b|mb\b)"
)
LAUNCH_WORDS = r"\b(?:introducing|announcing|now available|new feature|launch(?:ed|ing)?|now supports|general availability|beta|early access|we are excited to)\b"
HIRING_WORDS = (
    r"\b(?:we are hiring|now hiring|open roles?|job opening|apply now|machine learning engineer|ml engineer|ai engineer|research scientist"
    r"|software engineer|data scientist|full[- ]stack|backend engineer|frontend engineer)\b"
)
INTEGRATION_WORDS = r"\b(?:integration|integrates? with|connector|api\b|sdk\b|webhook|marketplace|partnership|now works with)\b"
NUMBER_ONLY = r"^[\s\d,.%+\-–—:/()]*$"
COUNTER_PHRASE = r"\b\d[\d,.]*\+?\s*(?:customers?|users?|companies|teams?|downloads?|stars?|reviews?|visitors?|members?|developers?|businesses)\b"
CHROME_PHRASES = (
    "cookie", "consent", "privacy policy", "terms of service", "terms and conditions", "all rights reserved", "sign in", "log in", "sign up",
    "subscribe to our newsletter", "follow us", "back to top", "skip to content", "accept all", "manage preferences", "we use cookies", "gdpr", "©", "copyright",
)
SOCIAL_PLATFORMS = ("twitter", "facebook", "linkedin", "instagram", "youtube", "tiktok", "x.com")
SOCIAL_VERBS = ("share this", "share on", "follow us", "connect with us", "find us on", "tweet")

# Vocabulary of the detectors.
AMOUNT = r"\d[\d,]*(?:\.\d{1,2})?"
PRICE = rf"(?:[$€£¥₹]\s?({AMOUNT})|\b(?:{CURRENCY_WORDS})\s?({AMOUNT})|\b({AMOUNT})\s?(?:{CURRENCY_WORDS})\b)"
BILLING_PERIOD = r"\b(?:per\s+month|per\s+year|per\s+user|per\s+seat|/\s*mo(?:nth)?\b|/\s*yr\b|/\s*year\b|monthly|annually|annual|billed\s+\w+)\b"
PLAN_NAME = r"\b(?:free|starter|basic|standard|pro|professional|team|business|growth|scale|premium|enterprise|plus|ultimate)\b(?:\s+(?:plan|tier))?"
FREE_WORD = r"\bfree\b"
FEATURE = (
    r"\b(?:new feature|introducing|announcing|now supports?|now available|available now|launch(?:ed|ing)?|we(?:'| a)?re launching|general availability|\bGA\b|beta"
    r"|early access|coming soon|redesigned|revamped|improved|faster|powered by ai|ai-powered|ai powered|machine learning|automation|copilot|assistant)\b"
)
FEATURE_LIST = r"\b(?:unlimited|includes?|up to \d+|\d+\s+(?:projects?|seats?|users?|workspaces?|integrations?|credits?|requests?|gb\b|tb\b))\b"
PLAN_LIMIT = (
    r"\b(unlimited|\d[\d,]*)\s*(projects?|seats?|users?|members?|workspaces?|integrations?|credits?|requests?"
    r"|api calls?|environments?|repos?|repositories|gb|tb|mb)\b"
)
AI_MENTION = r"\bai\b|artificial intelligence|machine learning"
HIRING_CONTEXT = (
    r"\b(?:career|careers|jobs?|hiring|open (?:role|position)s?|job opening|we(?:'| a)?re hiring|apply now|join (?:our|the) team|vacanc(?:y|ies)"
    r"|full[- ]time|part[- ]time|remote)\b"
)
ML_ROLE = (
    r"\b(?:machine learning|ml)\s+(?:engineer|scientist|researcher)\b|\bai\s+(?:engineer|scientist|researcher|architect)\b|\bresearch scientist\b|\bdata scientist\b"
    r"|\bmlops\b|\bapplied scientist\b|\bdeep learning\b|\bnlp engineer\b|\bllm\b"
)
GENERIC_ROLE = (
    r"\b(?:software|backend|back-end|frontend|front-end|full[- ]stack|platform|infrastructure|devops|security|mobile|ios|android|qa|sre)\s+engineer\b"
    r"|\b(?:product|engineering|sales|marketing)\s+manager\b|\b(?:designer|recruiter|analyst|account executive)\b"
)
PRODUCT = r"\b(?:new product|product launch|platform|suite|our (?:new )?product|dashboard|workspace|studio|console|editor|app\b)\b"
PRODUCT_LAUNCH = r"\bnew product|product launch\b"
INTEGRATION = r"\b(?:integrat(?:e|es|ion|ions)|connector|connects? (?:to|with)|works with|webhook|api\b|sdk\b|marketplace|plugin|extension|partnership|partner with|native support for)\b"
PARTNER = (
    r"\b(?:slack|salesforce|hubspot|zapier|snowflake|databricks|stripe|shopify|github|gitlab|jira|notion|figma|aws|azure|gcp|google cloud|kubernetes|segment"
    r"|okta|tableau|power bi|zendesk|intercom)\b"
)
POSITIONING = (
    r"\b(?:the (?:leading|best|#1|number one)|built for|designed for|trusted by|for (?:enterprise|teams|developers|startups)|platform for|all-in-one|end-to-end|mission|vision)\b"
)

#: Words one of which stands, as a whole, in every match of a pattern: a text without any of them is not searched.
NEEDS = {
    "LAUNCH_WORDS": "introducing announcing available feature launch launched launching supports availability beta access excited".split(),
    "HIRING_WORDS": "hiring role roles opening apply engineer scientist stack".split(),
    "INTEGRATION_WORDS": "integration integrate integrates connector api sdk webhook marketplace partnership works".split(),
    "BILLING_PERIOD": "per mo month yr year monthly annually annual billed".split(),
    "PLAN_NAME": "free starter basic standard pro professional team business growth scale premium enterprise plus ultimate".split(),
    "FREE_WORD": ["free"],
    "FEATURE": (
        "feature introducing announcing support supports available launch launched launching availability ga beta access soon redesigned revamped improved faster powered learning automation copilot assistant"
    ).split(),
    "FEATURE_LIST": "unlimited include includes up project projects seat seats user users workspace workspaces integration integrations credit credits request requests gb tb".split(),
    "HIRING_CONTEXT": "career careers job jobs hiring role roles position positions opening apply join vacancy vacancies time remote".split(),
    "ML_ROLE": "engineer scientist researcher architect mlops deep llm".split(),
    "GENERIC_ROLE": "engineer manager designer recruiter analyst executive".split(),
    "PRODUCT": "product platform suite dashboard workspace studio console editor app".split(),
    "PRODUCT_LAUNCH": "new launch".split(),
    "INTEGRATION": "integrate integrates integration integrations connector connect connects works webhook api sdk marketplace plugin extension partnership partner native".split(),
    "PARTNER": "slack salesforce hubspot zapier snowflake databricks stripe shopify github gitlab jira notion figma aws azure gcp google kubernetes segment okta tableau power zendesk intercom".split(),
    "POSITIONING": "leading best 1 number built designed trusted enterprise teams developers startups platform one end mission vision".split(),
}

# Credentials and what replaces them, in order.
REDACTED = "[redacted]"
SECRETS = (
    (r"\b(authorization|proxy-authorization|x-api-key|api[-_]?key)(['\"]?\s*[:=]\s*['\"]?)[^\r\n'\",}]+", r"$1$2[redacted]", True),
    (r"\bbearer\s+[^\s'\",}]+", "Bearer [redacted]", True),
    (r"\bsk-[A-Za-z0-9_\-]{8,}", "[redacted]", False),
    (r"\b([a-z][a-z0-9+.\-]*://[^\s:/@]+):[^\s@/]+@", r"$1:[redacted]@", True),
)

# Page regions. A tag's own label, then hints in ids and classes in order.
TAG_LOCATIONS = {"nav": "navigation", "footer": "footer", "header": "header", "aside": "sidebar", "form": "form"}
LOCATION_HINTS = (
    ("pricing", ("pricing", "price", "plans", "plan-", "tier", "billing", "subscribe")),
    ("careers", ("career", "jobs", "job-", "hiring", "openings", "vacanc", "greenhouse", "lever")),
    ("navigation", ("nav", "menu", "navbar", "topbar", "breadcrumb")),
    ("footer", ("footer", "colophon", "site-info", "legal", "copyright")),
    ("cookie_banner", ("cookie", "consent", "gdpr", "privacy-banner", "onetrust")),
    ("advertisement", ("ad-", "-ad", "ads", "advert", "sponsor", "promo-banner")),
    ("blog", ("blog", "news", "press", "article", "changelog", "release-notes", "announcement")),
    ("integrations", ("integration", "partners", "marketplace", "connectors", "apps")),
    ("product", ("product", "feature", "platform", "solutions", "capabilit")),
    ("header", ("header", "masthead", "hero", "banner")),
)
INVISIBLE_TAGS = frozenset(("script", "style", "noscript", "template", "svg", "path", "canvas", "iframe", "link", "meta", "head", "object", "embed"))
BLOCK_TAGS = frozenset((
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "dt", "dd", "blockquote", "figcaption", "caption", "button", "a", "label", "legend", "summary",
    "span", "div", "strong", "em", "code", "pre",
))

# Kinds of page by words in the path, in order.
PAGE_TYPES = (
    ("pricing", ("pricing", "price", "plans", "billing")),
    ("careers", ("career", "jobs", "hiring", "join-us", "work-with-us")),
    ("blog", ("blog", "news", "press", "changelog", "release", "announcement")),
    ("integrations", ("integration", "partners", "marketplace", "connectors")),
    ("product", ("product", "features", "platform", "solutions")),
)
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata.google.internal")
BLOCKED_SUFFIXES = (".localhost", ".local", ".internal", ".localdomain")

# Other names that a payload may use for a category, and words for scores.
CATEGORY_ALIASES = {
    "price": "pricing", "prices": "pricing", "feature": "features", "hiring_signal": "hiring", "jobs": "hiring", "recruiting": "hiring", "integration": "integrations",
    "partnership": "integrations", "partnerships": "integrations", "positioning": "messaging", "marketing": "messaging", "copy": "messaging", "products": "product", "launch": "product",
}
SCORE_WORDS = {"noise": 15.0, "low": 40.0, "medium": 60.0, "high": 78.0, "critical": 92.0}
TRUE_WORDS = ("true", "yes", "y", "1", "meaningful")


def any_case(pattern: str) -> str:
    return f"(?iU){pattern}"


def exact_case(pattern: str) -> str:
    return f"(?U){pattern}"
