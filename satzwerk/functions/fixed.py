"""Patterns, marks, colours and output formats.

These strings decide what the results look like, so they are stated once, as
plain text, and shared by the Spark expressions and the SQL checks.
"""

# --- character classes ------------------------------------------------------
# Java's and RE2's \s and \w are ASCII unless told otherwise, and each engine
# widens them differently, so the members are spelled out.
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD_CHARS = r"\p{L}\p{N}_"
# The members of SPACE_CHARS one by one, for trimming.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- patterns ---------------------------------------------------------------
SPACE_RUN = f"[{SPACE_CHARS}]+"
UNWANTED = rf"[^{WORD_CHARS}{SPACE_CHARS}.,!?-]"
# The hyphen group is possessive: Java's matcher then loops over its repetitions,
# while it recurses over those of a greedy one and overflows its stack.
TOKEN = rf"[{WORD_CHARS}]+(?:-[{WORD_CHARS}]+)*+|[^{WORD_CHARS}{SPACE_CHARS}]"
SENTENCE = rf"[^.!?]*[.!?][.!?{SPACE_CHARS}]*|[^.!?]+"
NOT_PUNCTUATION = r"""[^.,!?;:"'()\[\]{}]"""
HAS_WORD_CHAR = f"[{WORD_CHARS}]"
LETTERS_ONLY = r"\A\p{L}+\z"
CAPITALISED = r"\A\p{Lu}"
ASCII_QUOTED = r'"([^"]*)("|\z)'
OPENING_QUOTE = "„"

# Spacing of joined tokens, applied in this order. Quote marks are taken in
# pairs: the first loses the space after it, the second the space before it.
DETOKENIZE_RULES = (
    (r'(["„“]) ?([^"„“]*?) ?(["„“]|\z)', "$1$2$3"),
    (r"(') ?([^']*?) ?('|\z)", "$1$2$3"),
    (r"(`) ?([^`]*?) ?(`|\z)", "$1$2$3"),
    (r" ([,.?!:;\\%}\])])|([\p{Sc}(\[{¿¡]) ", "$1$2"),
)

TERMINALS = (".", "!", "?")
# A capital right after one of these says nothing about the word class.
SENTENCE_OPENERS = (".", "!", "?", ":", '"', "„", "“", "”")
# A lower-case letter that has a capital of its own.
LOWER_INITIAL = r"\A(?!ß)\p{Ll}"

# --- verb highlighting ------------------------------------------------------
VERB_COLOUR = "#0066cc"
AUX_COLOUR = "#ff8c00"
HIGHLIGHT_OPEN = '<span style="color: {colour}; font-weight: bold;">'
HIGHLIGHT_CLOSE = "</span>"

# --- tense markup -----------------------------------------------------------
TENSE_COLOURS = {
    "PRES": "linear-gradient(90deg, #9cffac, #49e85d)",
    "PAST": "linear-gradient(90deg, #ff9c9c, #e84949)",
    "VERB": "linear-gradient(90deg, #ffd799, #ffa500)",
}
MARKUP_OPEN = '<div class="entities" style="line-height: 2.5; direction: ltr">'
MARKUP_CLOSE = "</div>"
MARK_OPEN = (
    '<mark class="entity" style="background: {colour}; padding: 0.45em 0.6em; '
    'margin: 0 0.25em; line-height: 1; border-radius: 0.35em;">'
)
MARK_LABEL = (
    '<span style="font-size: 0.8em; font-weight: bold; line-height: 1; '
    'border-radius: 0.35em; vertical-align: middle; margin-left: 0.5rem">'
    "{label}</span></mark>"
)

# --- tables and reports -----------------------------------------------------
METRIC_SERIES = {
    "Total Words": "total_words",
    "Total Verbs": "total_verbs",
    "Main Verbs": "main_verbs",
    "Auxiliaries": "aux_verbs",
}
TENSE_COUNTS_FORMAT = "{'PRES': %d, 'PAST': %d, 'VERB': %d}"
COST_FORMAT = "Total Cost for Correction with LLM: $%.6f"
USAGE_FORMAT = "Total Tokens: %d (prompt: %d, completion: %d)"
INFO_SEPARATOR = " | "

SECTION_LINES = (
    '<div class="section">',
    '<div class="text-index">Text: %d</div>',
    '<div class="counts original">Original: %s</div>',
    "%s",
    '<div class="counts corrected">Spellings Corrected(LLM): %s</div>',
    "%s",
    "</div>",
)
REPORT_HEADER = """
<!DOCTYPE html>
<html>
<head>
    <title>Language Evaluation Results</title>
    <style>
        body { font-family: Arial, sans-serif; margin: 20px; }
        .section { margin: 30px 0; border-bottom: 1px solid #ccc; padding-bottom: 20px; }
        .text-index { font-size: 24px; font-weight: bold; color: #333; }
        .counts { font-size: 16px; margin: 10px 0; }
        .original { color: #d32f2f; }
        .corrected { color: #388e3c; }
    </style>
</head>
<body>
    <h1>Language Evaluation Results</h1>
"""
REPORT_FOOTER = """
</body>
</html>
"""

# --- worked correction pairs: tokens before, tokens after -------------------
WORKED_PAIRS = (
    (
        "Herr Jakob so heiß die Haand Figure . Herr Jakob ist neben drei männer und die kuken auf dass wasser",
        "Herr Jakob , so heißt die Hauptfigur . Herr Jakob ist neben drei Männern und sie gucken auf das Wasser .",
    ),
    (
        "der lehrer sakte dehn schülern sie sollen ihrre Handys während der unterricht ausschalten .",
        "Der Lehrer sagte den Schülern , sie sollen ihre Handys während des Unterrichts ausschalten .",
    ),
    (
        "Die Boote fahrten im runden Brunnen . Die Boote segelten ins saubere Wasser .",
        "Die Boote fuhren im runden Brunnen . Die Boote segelten ins saubere Wasser .",
    ),
    (
        "Er gab das Buch der Mann .",
        "Er gab das Buch dem Mann .",
    ),
    (
        'Er sagte : , , Ich habe zu Hause noch eine Eisenbahn . "',
        'Er sagte : " Ich habe zu Hause noch eine Eisenbahn . "',
    ),
    (
        "Herr Jakob vor den Brunnen und kuckt die Schiffe an . Die im Brunnen segeln . Er ging zurück . "
        "Er kam wenig später mit einem Karton zurück . Als er am Brunnen ankamm leerte er den Karton aus . "
        "Darin waren Schienen und Eisenbahnen . Er machte die Schienien um den Brunnen .",
        "Herr Jakob vor dem Brunnen und guckt die Schiffe an , die im Brunnen segeln . Er ging zurück . "
        "Er kam wenig später mit einem Karton zurück . Als er am Brunnen ankam , leerte er den Karton aus . "
        "Darin waren Schienen und Eisenbahnen . Er machte die Schienen um den Brunnen .",
    ),
)
