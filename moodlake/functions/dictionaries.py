"""Default dictionaries for symbol linking.

FIXED VALUES — these must equal the behaviour being reproduced, so they are
stated verbatim, in their natural order, and are only defaults: every linking
function takes its dictionaries as arguments.
"""

# FIXED VALUES: candidate tokens that are never linked, even when whitelisted.
STOPLIST = (
    "A", "I", "IT", "CEO", "CFO", "CTO", "COO", "CIO", "USA", "US", "UK", "EU",
    "AI", "ML", "API", "IPO", "ETF", "USD", "GDP", "IMF", "WTO",
)

# FIXED VALUES: lower-case keyword -> symbol, matched as substrings of the
# lower-cased text (not checked against the whitelist).
KEYWORDS = (
    ("apple", "AAPL"), ("microsoft", "MSFT"), ("google", "GOOGL"), ("alphabet", "GOOGL"),
    ("amazon", "AMZN"), ("nvidia", "NVDA"), ("tesla", "TSLA"), ("meta", "META"),
    ("facebook", "META"), ("berkshire", "BRK.B"), ("visa", "V"), ("jpmorgan", "JPM"),
    ("walmart", "WMT"), ("mastercard", "MA"), ("exxon", "XOM"), ("johnson", "JNJ"),
    ("home depot", "HD"), ("chevron", "CVX"), ("merck", "MRK"), ("abbvie", "ABBV"),
    ("coca-cola", "KO"), ("coke", "KO"), ("pepsi", "PEP"), ("costco", "COST"),
    ("broadcom", "AVGO"), ("lilly", "LLY"), ("mcdonald", "MCD"), ("cisco", "CSCO"),
    ("accenture", "ACN"), ("abbott", "ABT"), ("adobe", "ADBE"), ("nike", "NKE"),
    ("salesforce", "CRM"), ("verizon", "VZ"), ("wells fargo", "WFC"),
    ("bristol myers", "BMY"), ("ups", "UPS"), ("honeywell", "HON"), ("lowe", "LOW"),
    ("raytheon", "RTX"), ("qualcomm", "QCOM"), ("intel", "INTC"), ("amd", "AMD"),
    ("oracle", "ORCL"), ("ibm", "IBM"), ("boeing", "BA"),
)

# FIXED VALUES: most symbols linked per post.
MAX_SYMBOLS = 5

# FIXED VALUES: characters that Python's str.split() treats as whitespace
# (the text hash removes them): \t \n \v \f \r, the four information
# separators U+001C..U+001F, space, U+0085, U+00A0, U+1680, U+2000..U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
WHITESPACE_CLASS = (
    "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
)

# FIXED VALUES: the same characters as a literal string, for translate().
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# FIXED VALUES: stance for class index 0, 1, 2 of the scorer's logits.
CLASS_ORDER = (-1, 0, 1)

# FIXED VALUES: `source` of posts from the feed reader and from the listing poller.
FEED_SOURCE = "rss"
LISTING_SOURCE = "reddit"

# FIXED VALUES: model version stamped on written-back scores.
MODEL_VER = "finbert-onnx-v1"

# FIXED VALUES: scoring batch size.
BATCH_SIZE = 32
