"""Closed vocabularies. These values are fixed: results depend on them."""

# fixed values: canonical metrics and their filing tags, in order of preference
METRIC_TAGS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "total_assets": ("Assets",),
    "total_liabilities": ("Liabilities",),
    "cash_and_equivalents": ("CashAndCashEquivalentsAtCarryingValue",),
}
DURATION_METRICS = ("revenue", "net_income")
INSTANT_METRICS = ("total_assets", "total_liabilities", "cash_and_equivalents")
UNITS = ("USD",)
PERIODS = ("FY", "Q1", "Q2", "Q3", "Q4")
FORMS = {"10-K": "10-K", "10-K/A": "10-K", "10-Q": "10-Q", "10-Q/A": "10-Q"}
ACCESSION = r"^\d{10}-\d{2}-\d{6}$"

# fixed values: other names of the metrics
METRIC_SYNONYMS = {
    "revenue": "revenue", "revenues": "revenue", "total_revenue": "revenue", "net_revenue": "revenue", "net_sales": "revenue",
    "net_income": "net_income", "net_income_loss": "net_income", "net_earnings": "net_income",
    "total_assets": "total_assets", "assets": "total_assets",
    "total_liabilities": "total_liabilities", "liabilities": "total_liabilities",
    "cash_and_equivalents": "cash_and_equivalents", "cash_and_cash_equivalents": "cash_and_equivalents",
    "cash_and_cash_equivalent": "cash_and_equivalents", "cash_equivalents": "cash_and_equivalents",
}

# fixed values: sections of filings by item
ANNUAL_ITEMS = {"1A": "Risk Factors", "7": "MD&A", "8": "Notes"}
QUARTERLY_ITEMS = {("I", "1"): "Notes", ("I", "2"): "MD&A", ("II", "1A"): "Risk Factors"}
QUARTERLY_FALLBACK = {"1": "Notes", "2": "MD&A", "1A": "Risk Factors"}
WHOLE_FILING = "Full Filing"

# fixed values: intents, the tools each uses, and the route that is logged
INTENT_TOOLS = {"numeric": ("sql_tool",), "narrative": ("retrieval_tool",), "hybrid": ("sql_tool", "retrieval_tool"), "out_of_scope": ()}
ROUTE_INTENT = {"sql_tool": "numeric", "retrieval_tool": "narrative", "hybrid": "hybrid", "out_of_scope": "out_of_scope"}

# fixed values: legal forms and words of company names that do not tell an issuer
CORPORATE_SUFFIXES = ("and", "company", "co", "corp", "corporation", "group", "holdings", "inc", "incorporated", "limited", "llc", "plc", "the")

# fixed values: words without weight in questions about filings
QUESTION_STOP_WORDS = (
    "a", "about", "according", "after", "an", "and", "are", "as", "at", "be", "because", "before", "between", "by", "can", "company", "could",
    "did", "do", "does", "during", "explain", "for", "from", "had", "has", "have", "how", "in", "into", "is", "it", "its", "management", "might",
    "of", "on", "or", "reported", "say", "says", "the", "their", "they", "to", "under", "was", "were", "what", "when", "where", "which", "why",
    "will", "with", "would",
)

# fixed values: words that any question about filings may hold
GENERIC_WORDS = ("business", "disclose", "disclosed", "disclosure", "discuss", "filing", "important", "investor", "investors", "mention", "risk", "risks")

# fixed values: steps that bring a heading to the form in which it is compared, each a pattern and what takes its place
HEADING_STEPS = (
    (r"[’‘]", "'"),
    (r"[“”]", '"'),
    (r"[‐‑‒–—]", "-"),
    (r"\s*-\s*", " - "),
    (r"\s*\(continued\)\s*$", ""),
    (r"[ .:;\-–—]+$", ""),
)

# fixed values: what is masked at the end of a page footer, and the labels of forms
FOOTER_NUMBER = r"(\|\s*|\bpage\s+)\d+(?:\s+of\s+\d+)?\s*$"
FORM_LABELS = ("form 10-k", "form 10-q")
FOOTER_LENGTH = 180

# fixed values: phrases of sections that only point elsewhere
STUB_PHRASES = (
    r"\bappears?\s+on\s+pages?\b",
    r"\bsee\s+(?:pages?|part|item)\b",
    r"\bincorporat(?:ed|ion)\s+by\s+reference\b",
    r"\b(?:set\s+forth|included)\b.{0,180}\b(?:annual\s+report|part\s+iv|item\s+15|pages?)\b",
)
STUB_LENGTH = 2000

# fixed values: lines that belong to the page and not to the text
PAGE_LINES = {
    "page number": r"\d{1,3}",
    "continuation": r"\(?\s*continued\s*\)?[.:]?",
    "form label": r"(?:[^|/]{1,100}[|/]\s*)?(?:20\d{2}\s+)?form\s+10\s*[-–—]\s*[kq]",
}

# fixed values: headings that printers repeat on every page, as patterns of their compared form
PAGE_HEADERS = (r"table of contents", r".* and subsidiaries", r".*annual report.*", r".*\bform\s+10\s*-\s*[kq]\b.*")

# fixed values: headings that diagnostics show, and what tells that a filing's content is in another document
HEADING_LENGTH, MOST_HEADINGS = 240, 30
COMPANION = (r"\bannual report to shareholders\b", r"\bincorporat(?:ed|ion)\s+into\s+this\s+item\s+by\s+reference\b")
