"""Fixed values of the extraction rules.

Every pattern, word list, label and limit below decides what a listing *is*,
so each is stated here once, as plain text, and nowhere else.  They are Java
regular expressions.  ``ci`` makes one ignore case the way the rules expect
(ASCII and Unicode case).
"""

from __future__ import annotations


def ci(pattern: str) -> str:
    return "(?iu)" + pattern


def any_of(*patterns: str) -> str:
    """One alternation that is found exactly where any of ``patterns`` is."""
    return "|".join(f"(?:{p})" for p in patterns)


# --------------------------------------------------------------------------
# characters
# --------------------------------------------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LEFT_TO_RIGHT_MARK = "\u200e"
EMOJI = r"[\p{So}\p{Cn}←-⇿⌀-➿⬀-⯿️‍•■-◿]"
FORMAT_MARKS = r"[*_~`\x00\x80-\x{10ffff}]"  # no other character is changed by strip_format
LINE_EDGE = " :•*-–—>·|."
TITLE_EDGE = " :,-|"
CALL_SIGNS = r"[📞☎️📱📲🤙:–—\-]"

# --------------------------------------------------------------------------
# Numbers in a listing
# --------------------------------------------------------------------------
SIZE_UNIT = (
    r"(sq\.?\s*(?:yd|yds|yard|yards|gaj)|sq\s*yrd|sqyd|sqyrd|yds?\b|gaj\b|"
    r"sq\.?\s*(?:ft|feet)|sqft|sqf\b|sqt\b|\bsf\b|s\.?f\.?t)"
)
# Digits and blanks are not given back, since no unit begins with them; a look at the next character spares its search.
SIZE = r"(\d{2,6}+(?:[.,]\d{1,3}+)?+)\s*+(?=[syg])" + SIZE_UNIT
SIZE_IN_YARDS = r"yd|yard|yrd|gaj"
ROOMS = r"(?:bhk|b\.h\.k|bed\s*rooms?|bedrooms?|\bbed\b|br\b)"
BHK = r"(\d(?=[.\s&,/+atb])(?:\.\d)?(?:\s*(?:&|,|/|\+|and|to)\s*\d(?:\.\d)?)*)\s*(?:\+\s*\d\s*)?\s*" + ROOMS
BHK_NUMBER = r"\d(?:\.\d)?"
CRORES = r"(?:cr\b|crore?s?\b)"
LAKHS = r"(?:lacs?\b|lakhs?\b|l\b)"
CRORE = r"(\d{1,4}+(?:[.,]\d{1,3}+)?+)\s*+" + CRORES
LAKH = r"(\d{1,4}+(?:[.,]\d{1,3}+)?+)\s*+" + LAKHS
THOUSAND = r"(\d{1,3}+(?:\.\d{1,2}+)?+)\s*+k\b"
PLAIN_AMOUNT = r"(?<![\d.])(\d[\d,]{3,8})(?:/-)?(?![\d.])"
# Found in the same texts, from the last digits on; for tests only
SIZE_SEEN = r"\d\d(?:[.,]\d{1,3})?\s*" + SIZE_UNIT
BHK_SEEN = r"\d\s*" + ROOMS
CRORE_SEEN = r"\d\s*" + CRORES
LAKH_SEEN = r"\d\s*" + LAKHS
THOUSAND_SEEN = r"\d\s*k\b"
AMOUNT_SEEN = any_of(rf"\d\s*(?:{CRORES}|{LAKHS}|k\b)", PLAIN_AMOUNT)
SECTOR = r"\b(?:sector|sec)\s*[-–:. ]?\s*(\d{1,3}\s*[A-Da-d]?)\b"
PHONE = r"(?=[+6-9])(?:\+?91[\-\s]?)?\b([6-9]\d{4}[\s\-]?\d{5})\b"
RATE_PER_AREA = r"(\d{3,6})\s*(?:/-)?\s*(?:per|/|p)\s*sq\.?\s*(?:ft|feet|yd|yard)"
RATE_AFTER_AT = r"@\s*(\d{4,6})\s*(?:/-|/)?(?![\d.])"
RATE_AFTER_AT_IN_PRICE = r"@\s*(\d{4,6})(?:\s*/-)?"
AREA_UNIT_AFTER = r"\s*(?:/|per\s*)?\s*(?:sq\.?\s*(?:ft|feet|yd|yard|yrd)|sqft|sqyd|yd\b|gaj)"
AREA_UNIT_AFTER_PLAIN = r"\s*(?:sq|sf|s\.f)"
AREA_UNIT_BEFORE_AT = r"(?:sq\.?\s*(?:yds?|yards?|ft|feet)|sqyds?|sqft|yds?|gaj)\s*[@:]\s*[\d.]"
SALE_WORDS = r"\bsale\s*price|\bfor\s*sale\b|\basking\b|\bdemand\b|\bbooks?\b|\bcost\b|\bprice\b"
RENT_WORDS = (
    r"\brents?\b|\brental\b|\brented\b|\blease\b|\btenant\b|\bp\.?\s*m\b|/month|per\s*month|\bmonthly\b|"
    r"\+\s*m\b|incl?u?d?i?n?g?\.?\s*maint|excl?u?d?i?n?g?\.?\s*maint"
)

# Accepted ranges, both ends included
BHK_RANGE = (0.5, 9.5)
SIZE_RANGE = (50.0, 500000.0)
CRORE_RANGE = (0.05, 999.0)
LAKH_RATE_RANGE = (0.01, 500.0)
LAKH_RENT_RANGE = (0.1, 100.0)
LAKH_SALE_RANGE = (1.0, 999.0)
THOUSAND_RENT_RANGE = (5.0, 999.0)
PLAIN_RENT_RANGE = (5000.0, 5000000.0)
AREA_RATE_RANGE = (1000, 500000)

# How many values and characters the display form shows
SHOWN_SIZES = 3
SHOWN_PRICES = 3
SHOWN_RATES = 2
SHOWN_PHONES = 2
MESSAGE_LIMIT = 2000

# --------------------------------------------------------------------------
# Kinds of message
# --------------------------------------------------------------------------
NOISE = r"^\s*(<media omitted>|this message was deleted|null|ok(ay)?|thanks?|done|yes|no|noted|\W*)\s*$"
MEDIA_MARK = "<media omitted>"
MEDIA_MARK_LIMIT = 60
LISTING_BODY = r"\bplot|\bshop|\boffice|\bsco\b|\bfloor|\bapartment|\bvilla"
BLOCK_BREAK = r"\n\s*\n|\n\s*[-–—_=⸻*]{3,}\s*\n"
BLOCK_SIGNAL = r"\bprice|\basking|\brent|\bdemand|\bplot|\bfloor|\bshop|\boffice"

DEAL_REQUIREMENT = (
    r"\brequire?ments?\b|\brequired\b|\blooking\s*for\b|\bneed(?:ed)?\b|\bwanted\b|"
    r"\bclient\s*(?:looking|need)|\bif\s*(?:you|any)\b.{0,30}(?:option|inventory|have)"
)
DEAL_AVAILABLE = (
    r"\bavailable\b|\bfor\s*sale\b|\bfor\s*rent\b|\bon\s*sale\b|\bon\s*rent\b|\bdeal\b|\binventory\b|\boffer\b"
)
DEAL_RENT = (
    r"\bfor\s*rent\b|\bon\s*rent\b|\brents?\b|\brental\b|\brented\b|\blease\b|\btenant\b|\bp\.?\s*m\b|"
    r"/month|per\s*month"
)
DEAL_SALE = (
    r"\bfor\s*sale\b|\bon\s*sale\b|\bsale\b|\bselling\b|\bresale\b|\basking\b|\bdemand\b|\bprice\b|\bcost\b|"
    r"\bregistry\b"
)

PROPERTY_TYPES = [
    ("SCO / Plot (Commercial)", r"\bsco\b"),
    ("Shop / Retail", r"\bshop\b|\bretail\b|\bshowroom\b|\bfood\s*court\b|\banchor\s*store\b"),
    ("Office / Commercial",
     r"\boffice\b|\bcommercial\b|\bco[- ]?working\b|\bit\s*space\b|\bwarehouse\b|\bindustrial\b|\bpre[- ]?rented\b"),
    ("Villa / Bungalow", r"\bvilla\b|\bbungalow\b|\bkothi\b|\bduplex\b|\bpent\s*house\b|\bpenthouse\b"),
    ("Independent / Builder Floor", r"builder\s*floor|independent\s*floor|\bbuilder\s*flr\b|\bfloor\b"),
    ("Plot / Land", r"\bplot\b|\bland\b|\bacres?\b|\bkanal\b"),
    ("Apartment / Flat", r"\bapartment\b|\bflat\b|\bbhk\b|\bbedroom\b|\btower\b|\bcondo|\bstudio\b"),
]

LOCALITY = (
    r"sohna(?:\s*road)?|golf\s*course\s*ext(?:n|ension)?\s*road|golf\s*course\s*road|gcr\b|dwarka\s*expressway|"
    r"\bspr\b|southern\s*peripheral\s*road|nh\s*-?\s*(?:8|48)|mg\s*road|cyber\s*(?:city|hub|park)|udyog\s*vihar|"
    r"manesar|new\s*gurgaon|old\s*gurgaon|palam\s*vihar|sushant\s*lok|south\s*city|dlf\s*phase\s*[1-5ivx]+|"
    r"northern\s*peripheral|\bnoida\b|\bdelhi\b|faridabad|\bpataudi\b|\bdharuhera\b|\bbhiwadi\b|\bneemrana\b"
)

# --------------------------------------------------------------------------
# Project titles
# --------------------------------------------------------------------------
PROJECT_HINTS = (
    r"dlf|m3m|emaar|sobha|godrej|signature\s*global|tulip|vatika|ireo|central\s*park|elan|whiteland|"
    r"uppal|suncity|adani|\bats\b|bestech|conscient|krisumi|smartworld|trump|puri|paras|pioneer|silverglades|tata|"
    r"mahindra|experion|bptp|unitech|ansal|raheja|vipul|aipl|anant\s*raj|birla|max\s*estate|trevoc|navraj|orris|"
    r"\bsare\b|nirvana|palm|county|greenopolis|indiabulls|international\s*city|\brof\b|mapsko|spaze|ninex|ocus|"
    r"eldeco|assotech|\bss\b|microtek|silver\s*oak|pyramid|shapoorji|risland|hero\s*homes|lodha|prestige|oberoi|"
    r"tarc|satya|breez|imperia|supertech|\bamb\b|\bjmd\b|good\s*earth|world\s*trade|\bwtc\b|two\s*horizon|sushant|"
    r"south\s*city|malibu|magnolia|aralias|camellias|crest|park\s*place|princeton|belaire|icon|pinnacle|summit|"
    r"wellington|regency|hamilton|richmond|windsor|carlton|beverly|oakwood|rosewood|greenwood|heritage|laburnum|"
    r"ridgewood|essentia|la\s*lagune|grove|garden\s*city|new\s*town|valley|heights?|residency|greens|enclave|"
    r"tower|plaza|mall|arcade|estate|homes?|city|court|park|vihar|kunj|nagar|bhawan|square|avenue|boulevard"
)
PROJECT_AFTER_PREFIX = (
    r"(?:(?:available\s+(?:for\s+\w+\s+)?|for\s+(?:sale|rent)\s+)?(?:in|at)\s+|project\s*[:\-–]\s*|"
    r"society\s*[:\-–]\s*|location\s*[:\-–]\s*)"
    r"([A-Za-z0-9][A-Za-z0-9\s-]{2,40}?)"
    r"(?=\s*[,|–-]\s*(?:sector|sec\b|\d+\s*(?:bhk|br|bed|sqft|cr|lac)|size|floor|tower|price|call)|"
    r"\s+(?:sector|sec\b|\d+\s*(?:bhk|br|bed|sqft|cr|lac)|size|floor|tower|price|call)\b|\n|$)"
)
PREFIXED_TITLE_LENGTHS = (4, 50)
GENERIC_TITLE = (
    r"^(?:in\s+|at\s+)?(?:plot|flat|floor|tower|block|apartment|villa|shop|office|unit|units|"
    r"property|size|area|deal|deals|option|options|multiple|inventory|sqft|sqyd|bhk|type|status|note|"
    r"ground|first|second|third|fourth|basement|stilt|corner|park\s*facing|semi\s*furnished|fully\s*furnished|"
    r"ready\s*to\s*move|under\s*construction|new\s*booking|resale|rent|rents|sale|rented|location|"
    r"price|asking|demand|details?|contact|available)\b[\s\-–:.#/]*\w{0,4}$"
)
GENERIC_UNIT = (
    r"^\d\s*(?:\+\s*\d\s*)?(?:bhk|bed)|^(?:unit|flat|shop|plot)\s*(?:no\.?|number)?\s*[-–:.#]?\s*\w{1,5}$"
)
HEADLINE = r"^\s*(available|urgent|distress|desperate|premium|prime|hot|new|exclusive|fresh|resale|for)\b.{0,60}$"
DETAIL_LINE = (
    r"\b(price|asking|demand|rent|brokerage|commission|contact|call|size|area|facing|furnished|possession|"
    r"parking|loaded|renovated|negotiable|available)\b"
)
DETAIL_CUT = (
    r"(?=\s*[,|–-]\s*(?:sector|sec\b|size|\d+\s*(?:bhk|br|sqft)|book\s*value|price|call)|"
    r"\s+(?:size|book\s*value|call)\b)"
)
LONG_LINE = 80
OVERLONG_LINE = 120
SHORTEST_TITLE = 4
# Score of a title line
SCORE_HINT = 3.0
SCORE_SECTOR = 2.0
SCORE_DETAIL = 2.5
SCORE_LEADING_DIGIT = 1.5
SCORE_FEW_LETTERS = 1.0
SCORE_FIRST_LINE = 2.5
SCORE_LINE_STEP = 0.6
LETTER_SHARE = 0.5
# Clean-ups of the winning line, in order
TITLE_CLEANUPS = [
    r"^(?:in|at)\s+",
    r"^(?:location|project|society|property|address)\s*[:\-–]\s*",
    r"\s*[,\-–|]\s*(?:sector|sec)\s*[-–: ]?\s*\d+\s*[A-Da-d]?\s*$",
    r"^(?:available\s*(?:for\s*\w+)?|for)\s+(?:sale|rent)?\s*(?:in|at)?\s*",
    r"\s+(?:bringing|presenting|offers?)\b.*$",
]
TITLE_END = r"\s+for\s+(?:sale|rent)\b"

# --------------------------------------------------------------------------
# Dealer names
# --------------------------------------------------------------------------
NOT_A_DEALER = (
    r"\b(?:bhk|b\.h\.k|bedroom|bedrooms|sq\.?\s*ft|sqft|sqyd|sq\.?\s*yd|crore?s?|\bcr\b|lacs?|lakhs?|sector|sec\b|"
    r"rent|rents|rental|sale|resale|available|demand|asking|price|cheque|facing|ready|move|furnished|"
    r"apartment|apartments|flat|flats|floor|floors|tower|villa|plot|plots|office|commercial|retail|sco|"
    r"mandate|deal|deals|exclusive|option|options|urgent|looking|required|finance|payment|budget|"
    r"video|photo|details|advance|deposit|agreement|maintenance|maintainance|"
    r"call|calling|contact|phone|mobile|mob|tele|tel|whatsapp|chat|"
    r"jai|shree|shyam|mata|radhe|krishna|ram|om|ganesh|allah|god|bless|good\s*morning|welcome|mandate)\b"
)
AGENCY_KINDS = (
    r"Properties|Realtors|Real\s*Estate|Realstate|"
    r"Associates?|Consultants?|Realty|Homes?|Enterprises?|Interiors?|Infratech|Buildtech|Promoters"
)
AGENCY_LINE = (
    r"(?:^|[\n\r])[🏠🏢🏬]?\s*([A-Za-z][A-Za-z0-9 \t&.',-]{1,35}?\s+(?:" + AGENCY_KINDS + r"))"
    r"\s*[🏠🏢🏬]?(?=$|[\n\r])"
)
NAME_END = r"(?=\s*(?:[+0-9,\n\r|•/]|📞|☎|📱|📲|🤙|$))"
SIGNATURES = [
    r"\b(?:regards|warm\s*regards|thanks\s*&?\s*regards)\s*[:—–-]?\s*([A-Za-z][A-Za-z\s&.']{1,25}?)" + NAME_END,
    r"\b(?:contact(?:\s*person)?|pls\s*call|please\s*call|call|reach(?:\s*us)?|connect\s*with)\s*[:—–-]?\s*"
    r"([A-Za-z][A-Za-z\s&.']{1,25}?)" + NAME_END,
]
NAME_MARKS = r"[*_\"#]"
AGENCY_WORDS = r"properties|realt|estate|associate"
NAME_LENGTHS = (3, 40)
NAME_LETTERS = 3
NAME_WORDS = 3
LINES_ABOVE_PHONE = 2
NO_DEALER = "Dealer"
LID_MARK = "@lid"
LID_DIGITS = 13

# --------------------------------------------------------------------------
# Inventory columns
# --------------------------------------------------------------------------
INVENTORY_SECTOR = r"\b(?:sector|sec)\s*[-–:. ]?\s*(\d{1,3}\s*[A-D]?)"
FIRST_NUMBER = r"\d+(?:\.\d+)?"
SERVANT_ROOM = any_of(
    r"\b\d\s*(?:BHK|BED(?:ROOM)?|BR)?\s*\+\s*(?:S|SQ|SR|SERVANT)\b",
    r"\b(?:servant|maid|\bSR\b)",
)
STUDY_ROOM = r"\bSTUDY\b"
TYPE_ACCOMMODATION = [
    (r"office|commercial", "OFFICE"),
    (r"sco", "SCO"),
    (r"plot|land", "PLOT"),
    (r"shop|retail", "SHOP"),
    (r"villa|bungalow", "VILLA"),
    (r"floor|builder", "BUILDER FLOOR"),
]
FLOOR_VALUE = (
    r"(lower ground|upper ground|ground|basement|middle|lower|higher|ugf|lgf|\d{1,2}(?:st|nd|rd|th)?)"
)
FLOOR_WORD_FIRST = r"\b(?:floor|flr)[ \t]*[-–:.#]?[ \t]*" + FLOOR_VALUE + r"\b"
FLOOR_WORD_LAST = r"\b" + FLOOR_VALUE + r"[ \t]*(?:floor|flr)\b"
FLOOR_CODES = ["UGF", "LGF"]
TYPE_FLOOR = [(r"sco", "SCO"), (r"plot|land", "PLOT")]
UNIT_NUMBER = r"\b(?:flat|unit)\s*(?:no\.?|number)?\s*[-–:.#]?\s*([A-Z0-9][A-Z0-9/-]{0,14})"
TOWER_NUMBER = r"\b(?:tower|twr)\s*[-–:.#]?\s*([A-Z0-9][A-Z0-9/-]{0,8})"
BLOCK_NUMBER = r"\bblock\s*[-–:.#]?\s*([A-Z0-9][A-Z0-9/-]{0,10})"

# --------------------------------------------------------------------------
# files
# --------------------------------------------------------------------------
INVENTORY_HEADERS = [
    "SOCIETY", "PROJECT LIST STATUS", "SEC ", "AREA ", "ACCO", "FLOOR", "FLAT NO", "DEALER NAME ",
    "PHONE NO", "PRICE", "FULL MESSAGE", "is_duplicate",
]
BYTE_ORDER_MARK = "\ufeff"
FORMULA_START = r"^\s*[=+\-@]"
LINE_BREAKS = r"\s*(?:\r\n|\r|\n)+\s*"
BLANK_RUN = r"[ \t]{2,}"

# code, name, label
MESSAGE_TYPES = [
    (0, "TEXT", "Text"), (1, "IMAGE", "Photo"), (2, "AUDIO", "Voice Note / Audio"), (3, "VIDEO", "Video"),
    (4, "CONTACT", "Contact Card"), (5, "LOCATION", "Location"), (7, "SYSTEM", "System Notification"),
    (9, "DOCUMENT", "Document"), (10, "MISSED_CALL", "Missed Call"), (15, "STICKER", "Sticker"),
    (20, "GROUP_INVITE", "Group Invite"), (64, "POLL", "Poll"), (99, "REACTION", "Reaction"),
    (103, "COMMUNITY_ACTION", "Community Announcement"),
]
TEXT_TYPE = 0
OTHER_TYPE_NAME, OTHER_TYPE = "UNKNOWN", "Attachment"
GROUP_SERVER = "g.us"

EXPORT_VERSION = "1.0"
EXPORT_TITLE = "=== WhatsApp Chat Export: {} ==="
EXPORT_RULE = "-" * 80
EMPTY_MESSAGE = "[Empty / System Message]"
UNKNOWN_TIME = "Unknown Time"
