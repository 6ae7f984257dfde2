"""Parameters of the price-matching rules."""

SANE_LOW, SANE_HIGH = 0.05, 3.0  # of the unit price
WEAK_FLOOR = 0.30
PACK_CONFLICT_RATIO = 3
LOW_OUTLIER, LOW_OUTLIER_ROWS = 0.45, 3
LOCK_OUTLIER, LOCK_PEERS = 0.5, 2
BEST_FLOOR = 0.25
VOLUME_TOLERANCE = 0.02
TOKEN_OVERLAP = 0.6
GENERIC_WORDS, GENERIC_TOKENS = 0.6, 0.55
SNIPPET_LOW, SNIPPET_HIGH = 0.55, 1.8
GROUNDING = 0.02
LINE_TOLERANCE, ORDER_TOLERANCE = 0.05, 0.01
OPTIONS = 3
SHORTLIST, RESERVE, DOMAIN_CAP = 14, 6, 2
ATTEMPTED, PAID = 24, 12
MARKETPLACES = ("amazon", "walmart")
PLAUSIBLE_LOW, PLAUSIBLE_HIGH = 0.30, 1.05  # of a headline price
HOUSE_BRANDS = ("brand#11", "brand#22")  # lower case
REPORT_MARKETS = {"amazon": "AMAZON", "walmart": "WALMART"}
# Words that don't tell products of a kind apart, and how names state a pack.
GENERIC_STOP = ("the", "and", "for", "with", "non", "sterile", "premium", "brand", "dental", "dentistry", "absorbable", "disposable")
STATED_PACK = r"(?i)\b(\d{2,5})\s*[-/]?\s*(?:bx|box|pk|pack|ct|count|ca|case)\b"
# Sites that sell nothing that is sought.
OFF_TOPIC = ("etsy.com", "pinterest.com", "youtube.com", "facebook.com", "reddit.com", "stadtkirche-michelstadt.de", "shelllumber.com")
