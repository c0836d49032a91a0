"""The patterns and word lists whose exact content decides the extraction results."""

# --- title ------------------------------------------------------------------------------------
TITLE_PATTERNS = [
    r"(?i)^(?:\s*|.*?\n\s*)(?:title[:\s]*|)([A-Z][\w\s\-:,;&]+[?!.)]?)(?:\s*\n|$)",
    r"(?i)^(?:\s*|.*?\n\s*)([A-Z][\w\s\-:,;&]+)(?:\s*\nby\s+|$)",
    r"(?i)^(?:\s*|.*?\n\s*)(?:titel[:\s]*|)([A-Z][\w\säöüÄÖÜß\-:,;&]+[?!.)]?)(?:\s*\n|$)",
]
NOT_A_TITLE = (
    r"(?i)(abstract|keywords|introduction|chapter|volume|edition|©|copyright|author|by\s+|university|journal)"
)
NUMBERED_LINE = r"^[\d\.]+\s+"

# --- authors ----------------------------------------------------------------------------------
AUTHOR_PATTERNS = [
    r"(?i)(?:author[s]?|autor[en]?|by)[:\s]+([^,\n]+(?:,\s*[^,\n]+)*)",
    r"(?i)^(?:\s*|.*?\n\s*)([A-Z][a-z]+ [A-Z][a-z]+(?:,\s*[A-Z][a-z]+ [A-Z][a-z]+)*)",
    r"(?i)(?:prof\.|dr\.|ph\.d\.|professor|doctor)\s+([A-Z][a-z]+ [A-Z][a-z]+)",
    r"([A-Z][a-z]+ [A-Z][a-z]+)(?:\s*[0-9\*†‡§])",
    r"([A-Z][a-z]+ [A-Z][a-z]+)(?:\s*\([0-9]{4}\))",
    r"(?i)(?:von|zu|van|der|de)\s+([A-Z][a-z]+ [A-Z][a-z]+)",
]
AUTHOR_SEPARATOR = r",\s*|\s+(?:und|and|&)\s+"
NOT_AN_AUTHOR = r"(?i)(university|institute|department|abstract|keyword|introduction)"
FILENAME_AUTHOR = r"^([A-Za-z]+(?:\s*et\s*al)?)[_\s\-]"

# --- year -------------------------------------------------------------------------------------
YEAR_PATTERNS = [
    r"(?i)(?:published|accepted|received).*?(\d{4})",
    r"(?i)(?:copyright|©).*?(\d{4})",
    r"(?i)(?:\d{1,2}\.{0,1}\s*)?(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?"
    r"|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.{0,1}\s*(?:\d{1,2},?\s*)?(\d{4})",
    r"\((\d{4})\)",
    r"(?<=\s)(\d{4})(?=\s)",
    r"Volume\s+\d+,?\s+\((\d{4})\)",
]
# Longest wording of a year pattern that may stand on an earlier line than its digits: a month and its full stop.
YEAR_REACH = 10
MIN_YEAR = 1900
MAX_YEAR = 2025
PAGE_ONE_YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
PAGE_ONE_YEARS = (1990, 2030)

# --- publisher and journal --------------------------------------------------------------------
PUBLISHERS = [
    "Elsevier", "Springer", "Wiley", "IEEE", "ACM", "Nature", "Science",
    "Oxford University Press", "Cambridge University Press", "MIT Press",
    "Springer Nature", "Taylor & Francis", "SAGE", "Wolters Kluwer",
    "De Gruyter", "Thieme", "Hanser", "Academic Press",
]
PUBLISHER_PATTERNS = [
    r"(?i)published by\s+([^\.]+)\.",
    r"(?i)©\s*\d{4}\s+([^\.]+)",
    r"(?i)journal of\s+([^\.]+)",
    r"(?i)university\s+of\s+([^\.]+)\s+press",
    r"(?i)verlag\s+([^\.]+)",
    r"(?i)press\s+([^\.]+)",
]
# What a text holds, in lower case, wherever the pattern at the same place matches.
PUBLISHER_HINTS = ["published by", "©", "journal of", "university", "verlag", "press"]
JOURNALS = [
    "Nature", "Science", "PNAS", "Cell", "The Lancet", "JAMA",
    "IEEE Transactions", "ACM Transactions", "Physical Review",
    "Journal of the American Chemical Society", "Angewandte Chemie",
    "Bioinformatics", "Journal of Machine Learning Research", "PLOS ONE",
    "Nucleic Acids Research", "New England Journal of Medicine",
]
JOURNAL_PATTERNS = [
    r"(?i)published in[:\s]*([^\.]+)",
    r"(?i)journal of ([^\.]+)",
    r"(?i)proceedings of ([^\.]+)",
    r"(?i)transactions on ([^\.]+)",
    r"(?i)zeitschrift für ([^\.]+)",
    r"(?i)in\: ([^\.]+), vol\.",
]
JOURNAL_HINTS = ["published in", "journal of ", "proceedings of ", "transactions on ", "zeitschrift für ", "in: "]
JOURNAL_TAILS = [r"(?i)\s*\(.*?\)", r"(?i)\s*vol\..*$", r"(?i)\s*pp\..*$"]
PAGE_ONE_JOURNAL = [
    r"(?i)journal of ([^,\.]+)",
    # Anchored at the start of its comma- or period-free stretch, where the leftmost match begins anyway.
    r"(?i)(?<![^,\.])([^,\.]+) journal",
    r"(?i)transactions on ([^,\.]+)",
    r"(?i)proceedings of ([^,\.]+)",
]

# --- identifiers ------------------------------------------------------------------------------
DOI_BODY = r"""(10\.\d{4,}(?:[.][0-9]+)*/[^\s"&'<>]+)"""
DOI_PATTERN = r"(?i)(?:doi|DOI|https?://doi\.org/)[:\s/]*" + DOI_BODY
LOOSE_DOI_PATTERNS = [
    r"(?i)DOI:\s*" + DOI_BODY,
    r"(?i)https?://doi\.org/" + DOI_BODY,
    r"(?i)doi\.org/" + DOI_BODY,
    r"(?i)DOI\s+" + DOI_BODY,
    r"(?i)" + DOI_BODY,
]
DOI_KEY = r"(10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+)"
ISBN_PATTERNS = [
    r"(?i)ISBN(?:-10)?[:\s]*(\d{1,5}[- ]\d{1,7}[- ]\d{1,7}[- ][\dXx])",
    r"(?i)ISBN(?:-13)?[:\s]*(\d{3}[- ]\d{1,5}[- ]\d{1,7}[- ]\d{1,7}[- ][\dXx])",
    r"(?i)ISBN(?:-10)?[:\s]*(\d{10})",
    r"(?i)ISBN(?:-13)?[:\s]*(\d{13})",
]

# --- page one ---------------------------------------------------------------------------------
PAGE_ONE_NOT_A_TITLE = r"(?i)(abstract|keywords|introduction|references|university|department|faculty|school of)"
PAGE_ONE_NAMES = [
    r"^([A-Z][a-z]+\s+[A-Z][a-z]+)$",
    r"^([A-Z][A-Z\s]+)$",
    r"^([A-Z][a-z]+(?:\s+[A-Z]\.?)+\s+[A-Z][a-z]+)$",
    r"^([A-Z][a-z]+(?:-[A-Z][a-z]+)?\s+[A-Z][a-z]+)$",
]
PAGE_ONE_DEGREE = r"(?i)(professor|dr\.|ph\.?d|department|university)"
PAGE_ONE_INSTITUTION = r"(?i)^(department|school|faculty|university)"
PAGE_ONE_ANY_NAME = r"([A-Z][a-z]+(?:\s+[A-Z]\.?)*\s+[A-Z][a-z]+)"

# --- language ---------------------------------------------------------------------------------
GERMAN_WORDS = [
    "der", "die", "das", "und", "ist", "von", "für", "auf", "mit", "dem",
    "sich", "des", "ein", "nicht", "auch", "es", "bei", "wird", "sind", "einer",
]
ENGLISH_WORDS = [
    "the", "and", "of", "to", "in", "is", "that", "for", "it", "as",
    "was", "with", "be", "by", "on", "not", "he", "this", "are", "from",
]
# The presence test uses the first fifteen words of each list.
PRESENCE_WORDS = 15

# --- sentiment --------------------------------------------------------------------------------
POSITIVE_WORDS = [
    "gut", "großartig", "exzellent", "hervorragend", "positiv", "vorteilhaft",
    "good", "great", "excellent", "outstanding", "positive", "beneficial",
]
NEGATIVE_WORDS = [
    "schlecht", "furchtbar", "schrecklich", "negativ", "nachteilig", "problematisch",
    "bad", "terrible", "awful", "negative", "detrimental", "problematic",
]

# --- customary heads: explicit arguments only, except the line counts of title and page-one rules ---
TITLE_LINES = 20
TITLE_PATTERN_LINES = 10
PAGE_ONE_TITLE_LINES = 10
PAGE_ONE_AUTHOR_LINES = 9
PAGE_ONE_NAME_LINES = 30
PAGE_ONE_JOURNAL_LINES = 10
AUTHOR_CHARS = 1500
YEAR_CHARS = 2000
PUBLISHER_CHARS = 3000
JOURNAL_CHARS = 3000
LANGUAGE_CHARS = 5000
LANGUAGE_MIN_CHARS = 500
PRESENCE_CHARS = 1500
ANALYSIS_CHARS = 10000
