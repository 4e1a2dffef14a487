"""Column functions on text: metadata out of file names and headers, cell values, cleaning, labels.

Every function takes and returns columns, so that Catalyst sees the whole expression.  Null in
gives null out unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by the abbreviations that are recognised, in the order they are tried.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Look-around for letters and digits, and the two code patterns.
STRICT_CODE = r"(?i)(?<![A-Za-z0-9])(B[A-Z]{1,5}\d{3}[A-Z]?)(?![A-Za-z0-9])"
LOOSE_CODE = r"(?<![A-Za-z0-9])([B8][A-Z]{1,5}[0-9SOIL]{3}[A-Z]?)(?![A-Za-z0-9])"
#: Words that mark a line as a question.
QUESTION_WORDS = (
    "explain define describe discuss derive prove show compare differentiate list write draw illustrate state "
    "evaluate analyse analyze outline find solve with what how why briefly note"
).split()
#: Beginnings of page furniture rows.
SKIP_ROW = r"(?i)^\s*(?:\d+\s+of\s+\d+|Page\s+\d+|USN|CBCS|Time\s*:|Max\.?\s*Marks|Note\s*[:\d]|Answer\s+any|M\s*[:,]\s*Marks|\*{3,}|[-=]{10,})"
#: Words that no label is made of.
STOP_WORDS = (
    "a an the and or of in on at to for with by from is are was be as its it that this which how what why when where "
    "explain define describe discuss derive prove show compare differentiate list write draw illustrate state evaluate analyze analyse outline find solve "
    "give obtain determine compute calculate neat brief short note detail example suitable sketch diagram block using between following hence also "
    "necessary clearly important"
).split()
#: Words kept in lower case inside a label.
SMALL_WORDS = "of and in for to on the a an vs or with by at".split()
#: Instruction verbs that open a question.
VERBS = (
    "explain define describe discuss derive prove show compare contrast differentiate distinguish list write draw illustrate state evaluate analyse analyze "
    "outline find solve give mention enumerate elaborate sketch construct design develop obtain calculate compute determine identify demonstrate justify "
    "apply implement summarise summarize"
).split()


#: What a question, a text for the encoder and a label are freed from.
QUESTION_LABEL = r"^(?i)(?:Q\.?\s*\d{1,2}|[a-c]\.)\s*"
LEVEL_TOKENS = r"(?i)\b(?:L[1-6]|CO\d+|col)\b"
LEADING_JUNK = r"(?i)^[\s_\-|.]*(?:[a-c]\.?\s*)?(?:Q\.?\s*\d{1,2}\.?\s*)?(?:[a-c]\.?\s*)?[\s_\-|.]*"
TRAILING_JUNK = r"[\s_\-|.]+$"
STUCK_PREFIX = r"^[A-Z][a-z]?((?:With|Explain|Describe|Define|List|Derive|Illustrate)\b)"
WITH_DIAGRAM = r"(?i)\bwith\s+(?:an?\s+)?(?:neat\s+|suitable\s+|relevant\s+|clear\s+)?(?:block\s+|labell?ed\s+)?(?:diagrams?|sketch(?:es)?|examples?|figures?)\b\s*,?\s*"
LIST_MARKER = r"(?i)(?<![A-Za-z])(?:[a-d]|i{1,3}|iv)\)\s*"
CLAUSE_END = r"(?i)[?.;:]\s*|,\s*|\s+(?:with|using|for\s+the\s+given|by\s+taking)\s+"
INSTRUCTIONS = (
    r"(?i)^(?:(?:what|which|how|why|when)\s+(?:is\s+meant\s+by|is\s+the|are\s+the|is|are|do|does)\s+|(?:briefly|clearly|neatly)\s+|"
    rf"(?:{'|'.join(VERBS)})(?:\s+|$)(?:and\s+(?:explain|describe|discuss)\s+|out\s+|down\s+)?|"
    r"(?:an?|the|about|in\s+brief|in\s+detail|short\s+notes?\s+on|notes?\s+on|(?:the\s+)?following|between|different|various|any\s+(?:two|three|four))(?:\s+|$))+"
)
SUB_LABEL = r"^[a-cA-C][.)]\s+"
WELL_FORMED = (
    r"(?i)^(?:what|which|how|why|explain|define|describe|discuss|derive|compare|differentiate|distinguish|"
    r"list|write|draw|illustrate|state|briefly|give|find|solve|design|develop|construct)\b"
)
TRAILING_ADVERB = r"(?i)\s+(?:in\s+detail|in\s+brief|briefly|neatly|in\s+short)$"


def blank_to_null(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def squeeze(c: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strict_codes(text: Column) -> Column:
    """All well-formed subject codes of a text, upper case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(STRICT_CODE), F.lit(1)), lambda c: F.upper(c))


def repaired_codes(text: Column) -> Column:
    """Codes whose digits a scan may have read as letters, with the digits put back."""
    def mend(code: Column) -> Column:
        head = F.regexp_extract(code, r"^[B8]([A-Z]{1,5})([0-9SOIL]{3})([A-Z]?)$", 1)
        digits = F.translate(F.regexp_extract(code, r"^[B8]([A-Z]{1,5})([0-9SOIL]{3})([A-Z]?)$", 2), "SOIL", "5011")
        return F.concat(F.lit("B"), head, digits, F.regexp_extract(code, r"^[B8]([A-Z]{1,5})([0-9SOIL]{3})([A-Z]?)$", 3))

    return F.transform(F.regexp_extract_all(F.upper(text), F.lit(LOOSE_CODE), F.lit(1)), mend)


def code_variants(code: Column) -> Column:
    """The code itself, then the code without each letter of its branch part, leftmost first."""
    letters = F.regexp_extract(code, r"^B([A-Z]+)\d{3}[A-Z]?$", 1)
    shorter = F.transform(F.sequence(F.lit(1), F.greatest(F.length(letters), F.lit(1))), lambda i: F.concat(F.substring(code, F.lit(1), i), F.substr(code, i + 2)))
    return F.when(letters != "", F.concat(F.array(code), shorter)).otherwise(F.array(code))


def find_code(text: Column, known: Column) -> Column:
    """The subject code a text names: a known strict one, a known repaired one, else the first strict one.

    ``known``: map or array of the catalogue's codes, as an array column.
    """
    def first_known(codes: Column) -> Column:
        hits = F.flatten(F.transform(codes, lambda c: F.slice(F.filter(code_variants(c), lambda v: F.array_contains(known, v)), 1, 1)))
        return F.get(hits, F.lit(0))

    strict = strict_codes(text)
    return F.coalesce(first_known(strict), first_known(repaired_codes(text)), F.get(strict, F.lit(0)))


def stem(filename: Column) -> Column:
    """A file name without folder and last extension, separators as blanks."""
    base = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    return F.translate(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), "_-", "  ")


def year_of(text: Column) -> Column:
    """Latest four-digit year, else the first two-digit number from 20 to 50."""
    four = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int")))
    two = blank_to_null(F.regexp_extract(text, r"\b([2-9]\d)\b", 1)).cast("int")
    return F.coalesce(four, F.when(two.between(20, 50), two + 2000))


def month_in(text: Column, whole_word: bool = False) -> Column:
    """First month, in calendar order, whose abbreviation (or June, July) stands between non-letters."""
    out = F.lit(None).cast("string")
    edge = (r"\b", r"\b") if whole_word else ("(?<![a-z])", "(?![a-z])")
    tries = [(m[:3], m) for m in MONTHS] + [("june", "June"), ("july", "July")]
    for abbreviation, name in reversed(tries):
        out = F.when(text.rlike(f"(?i){edge[0]}{abbreviation.lower()}{edge[1]}"), F.lit(name)).otherwise(out)
    return out


def exam_type(text: Column) -> Column:
    """``mqp`` for model question papers, else ``regular``."""
    return F.when(text.rlike(r"(?i)\b(?:mqp|model)\b|\bmodel[\s_](?:q|question|paper)\b"), "mqp").otherwise("regular")


def question_number(cell: Column) -> Column:
    """Question number of a cell, doubled digits read once; 1 to 10."""
    doubled = blank_to_null(F.regexp_extract(cell, r"[QqOo0](\d)\1", 1)).cast("int")
    loose = blank_to_null(F.regexp_extract(cell, r"[Qq0Oo][.\s]?[Oo0]?(\d{1,2})", 1)).cast("int")
    return F.coalesce(doubled, F.when(loose.between(1, 10), loose))


def sub_label(cell: Column) -> Column:
    """Label a, b or c that a cell begins with."""
    return blank_to_null(F.lower(F.regexp_extract(F.trim(cell), r"^([a-cA-C])", 1)))


def marks_in(cell: Column) -> Column:
    """First even number from 4 to 20 in a cell, else the first in that range."""
    numbers = F.filter(F.transform(F.regexp_extract_all(cell, F.lit(r"\b(\d{1,2})\b"), F.lit(1)), lambda x: x.cast("int")), lambda x: x.between(4, 20))
    return F.coalesce(F.get(F.filter(numbers, lambda x: x % 2 == 0), F.lit(0)), F.get(numbers, F.lit(0)))


def bloom_in(cell: Column) -> Column:
    """Bloom level L1 to L6."""
    digit = F.regexp_extract(cell, r"(?i)L\s*([1-6])", 1)
    return F.when(digit != "", F.concat(F.lit("L"), digit))


def outcome_in(cell: Column) -> Column:
    """Course outcome CO and its digit."""
    digit = F.regexp_extract(cell, r"(?i)C[oq]q?\s*(\d)", 1)
    return F.when(digit != "", F.concat(F.lit("CO"), digit))


def module_of_question(q_no: Column) -> Column:
    """Module that a question number belongs to: two per module, at most 5."""
    return F.least(F.lit(5), F.ceil(q_no / 2)).cast("int")


def clean_question(text: Column) -> Column:
    """Label, level and outcome tokens and cell bars removed."""
    c = F.regexp_replace(F.regexp_replace(text, QUESTION_LABEL, ""), LEVEL_TOKENS, "")
    c = F.regexp_replace(F.replace(c, F.lit("|"), F.lit(" ")), r"\s+", " ")
    return F.regexp_replace(c, r"^[ .,;:]+|[ .,;:]+$", "")


def clean_for_embedding(text: Column) -> Column:
    """Labels, rules and stuck-on scan prefixes removed before a text is encoded."""
    c = F.regexp_replace(F.trim(F.regexp_replace(text, LEADING_JUNK, "")), TRAILING_JUNK, "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, STUCK_PREFIX, "$1"), r"\s{2,}", " "))


def title_case(words: Column) -> Column:
    """Words of a label: codes and acronyms as written, small words low unless first, else a capital."""
    def shape(w: Column, i: Column) -> Column:
        as_is = w.rlike(r"\d|/") | ((F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))
        return F.when(as_is, w).when((i > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))

    return F.array_join(F.transform(words, shape), " ")


def bare_wording(text: Column) -> Column:
    """A question without white space at its ends and without its label a, b or c."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), SUB_LABEL, "")


def well_formed(bare: Column) -> Column:
    """Whether a wording begins as a question does."""
    return bare.rlike(WELL_FORMED)


def shown_word(word: Column) -> Column:
    """A word as labels show it: capitals as written, else with one at the front."""
    return F.when(F.upper(word) == word, word).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2)))))


def clean_label(label: Column) -> Column:
    """White space squeezed, at most 80 signs, never empty."""
    return F.coalesce(blank_to_null(F.substring(squeeze(label), 1, 80)), F.lit("Untitled topic"))


def phrase_label(text: Column) -> Column:
    """Subject of a question: its first clause without instruction words, at most six words."""
    return phrase_of(bare_wording(text))


def phrase_of(bare: Column) -> Column:
    """``phrase_label`` of a wording that is bare already."""
    clauses = F.split(F.regexp_replace(F.regexp_replace(bare, WITH_DIAGRAM, ""), LIST_MARKER, " "), CLAUSE_END)

    def words(clause: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.trim(clause), INSTRUCTIONS, ""), TRAILING_ADVERB, "")
        parts = F.split(F.regexp_replace(bare, r"^[ \-()'\"]+|[ \-()'\"]+$", ""), r"\s+")
        return F.slice(F.filter(F.transform(parts, lambda w: F.regexp_replace(w, r"^[()'\"]+|[()'\"]+$", "")), lambda w: w != ""), 1, 6)

    def without_tail(ws: Column) -> Column:
        last = F.array_max(F.transform(ws, lambda w, i: F.when(~F.lower(w).isin(SMALL_WORDS), i + 1).otherwise(0)))
        return F.slice(ws, 1, F.coalesce(last, F.lit(0)))

    found = F.filter(F.transform(clauses, words), lambda ws: F.length(F.array_join(ws, " ")) >= 3)
    found = F.filter(F.transform(found, without_tail), lambda ws: F.size(ws) > 0)
    return title_case(F.get(found, F.lit(0)))


def label_family(label: Column) -> Column:
    """First telling word of a label in lower case."""
    ws = F.filter(F.split(F.lower(F.regexp_replace(label, rf"(?i)^(?:{'|'.join(VERBS)})\s+", "")), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return F.get(ws, F.lit(0))


def latin_only(text: Column) -> Column:
    """Typographic signs in plain form, anything else outside Latin-1 as a question mark."""
    #: Single signs, then those that become several.
    c = F.translate(text, "‘’“”–—•·★☆âé", "''\"\"--****ae")
    for sign, plain in {"®": "(R)", "©": "(C)", "…": "...", "°": "deg", "→": "->", "←": "<-"}.items():
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return F.regexp_replace(c, r"[^\x00-\xFF]", "?")


def safe_filename(name: Column) -> Column:
    """Base name with unusual signs as underscores, its last 120 characters."""
    base = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.substring(F.trim(F.regexp_replace(base, r"[^\p{L}\p{N}_ .()\-]+", "_")), -120, 120)


def shorten(text: Column, most: int = 170) -> Column:
    """White space squeezed; a longer text ends at a word before the limit."""
    c = squeeze(text)
    cut = F.substring(c, 1, most - 3)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("...")))
