"""Fixed values that results depend on, in their natural order."""

# Domains of social networks; a host matches exactly or as the end of a longer host name.
SOCIAL_DOMAINS = (
    "facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "youtube.com", "youtu.be", "tiktok.com",
    "whatsapp.com", "snapchat.com", "telegram.org", "telegram.me", "pinterest.com", "github.com", "discord.gg",
    "twitch.tv", "reddit.com", "medium.com", "shopify.com", "wix.com", "wordpress.com", "squarespace.com", "vimeo.com",
    "soundcloud.com", "behance.net", "dribbble.com", "tumblr.com", "vk.com", "ok.ru",
)

# Parts of links to booking and review services.
BOOKING_SITES = ("calendly.com", "acuityscheduling.com", "simplybook.me", "square.site/book", "setmore.com")
REVIEW_SITES = ("yelp.com", "trustpilot.com", "tripadvisor.com", "g.page", "google.com/maps", "bbb.org")

# Names of chat widgets.
CHAT_WIDGETS = ("intercom", "tidio", "drift", "crisp", "tawk.to", "zendesk", "hubspot", "gorgias", "livechat")

# Platforms and the strings that give them away, in order of precedence.
PLATFORMS = (
    ("WordPress", ("wp-content", "wp-includes")),
    ("Shopify", ("cdn.shopify.com", "shopify.com")),
    ("Webflow", ("w-webflow",)),
    ("Wix", ("static.wixstatic.com", "wix.com")),
    ("Squarespace", ("squarespace.com",)),
    ("React/Next.js", ("data-reactroot", "_next/static")),
    ("Vue/Nuxt", ("nuxt",)),
)
NO_PLATFORM = "Custom/Unknown"

# First words of calls to action, parts of their class names, and the most words and calls that count.
ACTION_WORDS = (
    "get", "request", "book", "download", "contact", "call", "quote", "start", "try", "buy", "shop", "sign", "join",
    "learn", "schedule", "talk", "demo", "explore", "view", "subscribe", "apply", "connect",
)
ACTION_CLASSES = ("btn", "button", "cta")
MOST_ACTION_WORDS, MOST_ACTIONS = 6, 15

# Bounds of ours: characters that a link or button gathers, pages in a batch of the parser, pixels of an image.
LONGEST_ACTION, PAGES_AT_ONCE, MOST_PIXELS = 500, 500, 50_000_000

# Parts of field names that make a form a lead form; field types that are no fields.
LEAD_HINTS = ("name", "email", "phone", "address", "message", "company", "organisation", "organization")
NO_FIELDS = ("hidden", "submit", "button")

# Elements and classes that are no content, and where content is looked for first.
PRUNED_TAGS = ("nav", "footer", "script", "style", "header", "iframe", "noscript", "aside")
PRUNED_CLASSES = ("ads", "sidebar", "footer", "header", "nav")
CONTENT_ORDER = ("article", "main", "#content", ".main-content", "body")
LEAST_CONTENT = 200

# Patterns of e-mail addresses and telephone numbers, and the fewest digits of the latter.
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"\b(?:\+?\d{1,3}[ \-.])?\(?\d{2,5}\)?[ \-.]?\d{3,4}[ \-.]?\d{3,4}\b"
LEAST_DIGITS = 7

# Lines of a mission statement.
LEAST_LINE, MOST_LINES = 30, 3

# What a selector must not hold, its longest form, and how many addresses a batch has.
BAD_SELECTOR = ("<", ">", "javascript:", "onclick", "onerror")
LONGEST_SELECTOR, MOST_URLS = 500, 5

# HTTP status codes that are errors, and the error kinds that are retried.
STATUS_ERRORS = ((403, "Blocked"), (404, "NotFound"), (429, "RateLimit"))
RETRIED = ("RateLimit", "TransientNetwork")
BACKOFF_BASE, BACKOFF_CAP, MOST_ATTEMPTS = 2.0, 60.0, 5
BREAKER_FAILURES, BREAKER_SECONDS = 5, 30

# Formats and the range that quality percentages map onto (from 0 % to 100 %).
FORMATS = ("jpeg", "jpg", "png", "webp", "avif", "tiff", "tif")
QUALITY_RANGES = (("JPEG", 0, 100), ("PNG", 9, 0), ("WEBP", 1, 90), ("AVIF", 10, 80), ("TIFF", 0, 95))
TIFF_CODECS = ((85, "deflate"), (75, "lzw"), (0, "jpeg"))

# Limits of listings, stores and lifetimes (seconds).
DEFAULT_LIMIT, MOST_LISTED, MOST_KEPT = 50, 100, 10_000
SESSION_SECONDS, OUTPUT_SECONDS = 300, 600
