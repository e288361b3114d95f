"""Default rules of the legal-corpus jobs. Every operator takes its rules as an argument."""

# ---------------------------------------------------------------------------
# Names, markers, thresholds and patterns the results depend on.
# ---------------------------------------------------------------------------

# Entity labels of the main text: general labels, then the legal ones.
GENERAL_LABELS = ["GPE", "DATE", "NORP", "ORG", "LAW"]
LEGAL_LABELS = [
    "CLAIMANT_EVENTS",
    "CREDIBILITY",
    "DETERMINATION",
    "CLAIMANT_INFO",
    "PROCEDURE",
    "DOC_EVIDENCE",
    "EXPLANATION",
    "LEGAL_GROUND",
    "LAW_CASE",
    "LAW_REPORT",
]
ENTITY_LABELS = GENERAL_LABELS + LEGAL_LABELS

# Separator between the features of one example.
SEP = "[SEP]"

# Feature columns of the cover training set, in the order they are joined.
COVER_FEATURES = [
    "extracted_dates",
    "LOC_HEARING",
    "TRIBUNAL",
    "PUBLIC_PRIVATE_HEARING",
    "INCHAMBER_VIRTUAL_HEARING",
    "JUDGE",
    "DATE_DECISION",
]

# Feature columns of the all-entities training set, in the order they are joined.
ALL_FEATURES = [
    "GPE",
    "DATE",
    "NORP",
    "ORG",
    "LAW",
    "CREDIBILITY",
    "DETERMINATION",
    "CLAIMANT_INFO",
    "PROCEDURE",
    "DOC_EVIDENCE",
    "EXPLANATION",
    "LEGAL_GROUND",
    "LAW_CASE",
    "LAW_REPORT",
] + COVER_FEATURES

# Extracted column -> feature name.
FEATURE_NAMES = {
    "decision_date": "DATE_DECISION",
    "extracted_gpe": "LOC_HEARING",
    "extracted_org": "TRIBUNAL",
    "public_private_hearing": "PUBLIC_PRIVATE_HEARING",
    "in_chamber_virtual": "INCHAMBER_VIRTUAL_HEARING",
    "judge_name": "JUDGE",
}

# File names carry the decision id as 1 to 6 digits.
FILE_KEY_PATTERN = r"canlii(\d{1,6})(?:\.pdf|\.html)"
NO_KEY = "no_match_filename"
# Names of covers that were taken out of a document and stored as text, beside those of the documents.
COVER_KEY_PATTERN = r"canlii(\d{1,6})(?:\.pdf|\.html|\.txt)"

# Cover text of a document that could not be read.
UNREADABLE = "False"

# Cell contents that mean "nothing found".
NULL_MARKERS = ["", "[]", "[None]", "''"]

# Spelling repairs of place names.
FIXUPS = {"que bec": "quebec"}

# Hearing mode assumed when the cover names none.
DEFAULT_HEARING_MODE = "in chambers"

# Hearing type and hearing mode phrases, matched on lower-case text.
HEARING_TYPE_PATTERN = (
    r"private\s*proceedings?|private\s*hearings?|procédure\s*publique|audience\s*publique"
    r"|public\s*proceedings?|public\s*hearings?|huis\s*clos"
)
HEARING_MODE_PATTERN = (
    r"virtual|\bin\s*chambers?|video-?conference|\bin\s*camera|\bin\s*person|telephone"
)

# A signature table with one of these is the wrong table.
TRIAGE_PATTERN = r"appell*ant|repondant|intim|19[^9]\d|appeal|ottawa|toronto"
NO_TABLE = "no table found"

# Dates are written "may 23, 2017"; the date of a statute appears on every cover.
DATE_FORMAT = "MMMM d, yyyy"
DATE_SHAPE = r"^\p{L}+ \d{1,2},? \d{4}$"
DATE_PRINT_FORMAT = "MMMM dd, yyyy"
NOISE_DATES = ["october 2007"]
BARE_YEAR_PATTERN = r"^\d{4}"

# Sentence score -> class: below LOW rejected, above HIGH accepted, otherwise uncertain.
LOW_SCORE = 0.4
HIGH_SCORE = 0.6
REJECTED, ACCEPTED, UNCERTAIN = 0, 1, 2
OUTCOME_NAMES = {0: "REJECTED", 1: "GRANTED"}
CLASS_NAMES = {0: "NEGATIVE", 1: "POSITIVE"}

# A person span keeps its head; its last characters become the mask character.
MASK_CHAR = "X"
MASK_LENGTH = 20

# Fuzzy date agreement must score above this.
DATE_SIMILARITY = 90

# Tail paragraphs that hold the determination.
TAIL_PARAGRAPHS = 10

# Test share of a split, copies of a minority example, tokens per example, words in a report.
TEST_SHARE = 0.2
MINORITY_COPIES = 5
SENTENCE_TOKENS = 100
CASE_TOKENS = 512
TOP_WORDS = 50

# Bandwidth factor of the score density, and its grid.
DENSITY_BANDWIDTH = 0.25
DENSITY_GRID = 200
DENSITY_CUT = 3.0

# Members without a place on the map, and the country every case mentions.
EXCLUDED_MEMBERS = ["Antarctica"]
EXCLUDED_MENTIONS = ["canada"]

# ---------------------------------------------------------------------------
# Tagging rules: one pattern per label, to be replaced by the user's own.
# ---------------------------------------------------------------------------

_MONTH = (
    "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
)


def _sentence_with(words: str) -> str:
    """The sentence around some words. It can only begin where a sentence begins, so a long text
    without a match is read once and not once per character."""
    return rf"(?i)(?<![^.\n])[^.\n]*?\b(?:{words})\b[^.\n]*"


ENTITY_RULES = {
    "GPE": r"(?i)\b(?:canada|quebec|ontario|toronto|montreal|ottawa|vancouver|calgary)\b",
    "DATE": rf"(?i)\b{_MONTH} \d{{1,2}},? \d{{4}}\b",
    "NORP": r"(?i)\b(?:canadian|christian|muslim|hindu|sikh|tamil|kurdish|roma)s?\b",
    "ORG": r"(?i)\b(?:immigration and refugee board|refugee protection division|federal court)\b",
    "LAW": r"(?i)\b(?:sub)?sections? \d+(?:\(\d+\))?",
    "CLAIMANT_EVENTS": _sentence_with("(?:was|were) (?:arrested|attacked|detained|threatened)"),
    "CREDIBILITY": _sentence_with("credible|credibility|implausible"),
    "DETERMINATION": _sentence_with("claim is (?:rejected|accepted)|(?:rejects|accepts) the claim"),
    "CLAIMANT_INFO": _sentence_with("claimants? (?:is|are) (?:a |an )?(?:citizens?|nationals?)"),
    "PROCEDURE": _sentence_with("hearing|adjourned|postponed"),
    "DOC_EVIDENCE": r"(?i)\bexhibits? [a-z]?-?\d+",
    "EXPLANATION": _sentence_with("because|explained that"),
    "LEGAL_GROUND": r"(?i)\b(?:well-founded fear|convention refugee|membership in a particular social group)\b",
    "LAW_CASE": r"\b[A-Z][A-Za-z]+ v\. [A-Z][A-Za-z]+",
    "LAW_REPORT": r"\[\d{4}\] \d+ [A-Z.]+ \d+",
}

# Part of a name: a capital and letters of any script, also after a hyphen or an apostrophe; all capitals too.
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:[-'’]\p{L}+)*"
PERSON_RULE = rf"(?<![\p{{L}}\p{{N}}]){_NAME} (?:\p{{Lu}}\. )?{_NAME}(?![\p{{L}}\p{{N}}])"

COVER_RULES = {
    "DATE": ENTITY_RULES["DATE"],
    "GPE": ENTITY_RULES["GPE"],
    "ORG": ENTITY_RULES["ORG"],
    "PERSON": r"(?i)(?<=member )[\p{L}.'’-]+ [\p{L}.'’-]+",
}
