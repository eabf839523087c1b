"""The registered queries as SQL, written on their own terms.

Where the Spark side works on arrays within a row, this side works on tables:
tokens are rows, neighbours come from window functions, lookups are joins and
texts are put together by ordered string aggregation.
"""

from __future__ import annotations

from satzwerk.functions import fixed
from satzwerk.operators.lexicon import (
    MIN_STEM,
    fold,
    seed_contractions,
    seed_lexicon_rows,
    seed_rewrites,
)
from satzwerk.plans.registry import COST_PER_TOKEN, EXCLUDED, TABLE_REWRITES


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def cell(value) -> str:
        if isinstance(value, (list, tuple)):
            return "[" + ", ".join(lit(v) for v in value) + "]"
        return str(value) if isinstance(value, int) else lit(value)

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


def replace_all(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)}, 'g')"


def folded(text: str) -> str:
    return f"replace(lower({text}), 'ß', 'ss')"


STRIP = rf"\A[{fixed.SPACE_CHARS}]+|[{fixed.SPACE_CHARS}]+\z"


def cleaned(text: str) -> str:
    once = replace_all(replace_all(text, fixed.SPACE_RUN, " "), r"\A +| +\z", "")
    return replace_all(once, fixed.UNWANTED, "")


def flattened(text: str) -> str:
    return replace_all(f"replace({text}, chr(10), ' ')", STRIP, "")


def quoted(text: str) -> str:
    return replace_all(text, fixed.ASCII_QUOTED, "„\\1\\2")


def detokenized(text: str) -> str:
    for pattern, replacement in fixed.DETOKENIZE_RULES:
        text = replace_all(text, pattern, replacement.replace("$", "\\"))
    return text


def escaped(text: str) -> str:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, {lit(mark)}, {lit(entity)})"
    return text


def diff_label(number: str) -> str:
    return f"CASE WHEN {number} > 0 THEN '+' ELSE '' END || CAST({number} AS VARCHAR)"


# Stated on its own: this engine knows no possessive groups and does not recurse.
TOKEN = rf"[{fixed.WORD_CHARS}]+(?:-[{fixed.WORD_CHARS}]+)*|[^{fixed.WORD_CHARS}{fixed.SPACE_CHARS}]"

DOCS = "SELECT doc_id AS id, text FROM documents"


def with_(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n"


# --- tokens -----------------------------------------------------------------


def token_cte(source: str, name: str = "tok") -> list[tuple[str, str]]:
    return [
        (
            name,
            f"""SELECT id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS tok_id
            FROM (SELECT id, regexp_extract_all(text, {lit(TOKEN)}) AS t FROM ({source}))""",
        )
    ]


IS_WORD = f"regexp_matches(token, {lit(fixed.NOT_PUNCTUATION)})"
TERMINAL = "('.', '!', '?')"


# --- tagging ----------------------------------------------------------------


def lexicon_ctes() -> list[tuple[str, str]]:
    rows = seed_lexicon_rows()
    forms = [(r[1], r[2], r[3], r[4]) for r in rows if r[0] == "form"]
    suffixes = [(r[1], r[2], r[3], r[4]) for r in rows if r[0] == "suffix"]
    parts = [
        (form, place, word, fold(word))
        for form, words in seed_contractions().items()
        for place, word in enumerate(words)
    ]
    return [
        ("lex(form, lemma, upos, tense)", values(forms)),
        ("sfx(suffix, ending, upos, tense)", values(suffixes)),
        ("mwt(form, word_id, word, part)", values(parts)),
    ]


def words_ctes(tok: str = "tok", p: str = "") -> list[tuple[str, str]]:
    """Tables ctx and words over the token table ``tok``; names start with ``p``."""
    openers = "(" + ", ".join(map(lit, fixed.SENTENCE_OPENERS)) + ")"
    return [
        (
            f"{p}ctx",
            f"""SELECT *, {folded("token")} AS form,
            lag(token) OVER (PARTITION BY id ORDER BY tok_id) AS before FROM {tok}""",
        ),
        (
            f"{p}bysuffix",
            f"""SELECT form, lemma, upos, tense FROM (
              SELECT v.form, left(v.form, length(v.form) - length(suffix)) || ending AS lemma, upos, tense,
                row_number() OVER (PARTITION BY v.form ORDER BY length(suffix) DESC) AS r
              FROM (SELECT DISTINCT form FROM {p}ctx) v JOIN sfx
              ON suffix(v.form, sfx.suffix) AND length(v.form) >= length(sfx.suffix) + {MIN_STEM}) WHERE r = 1""",
        ),
        (
            f"{p}words",
            f"""SELECT c.id, c.tok_id, 0 AS word_id, c.token AS word,
              CASE WHEN lex.form IS NOT NULL THEN lex.lemma
                   WHEN NOT regexp_matches(c.token, {lit(fixed.HAS_WORD_CHAR)}) THEN c.token
                   WHEN c.noun THEN c.token ELSE s.lemma END AS lemma,
              CASE WHEN lex.form IS NOT NULL THEN lex.upos
                   WHEN NOT regexp_matches(c.token, {lit(fixed.HAS_WORD_CHAR)}) THEN 'PUNCT'
                   WHEN c.noun THEN 'NOUN' ELSE coalesce(s.upos, 'X') END AS upos,
              CASE WHEN lex.form IS NOT NULL THEN lex.tense
                   WHEN NOT regexp_matches(c.token, {lit(fixed.HAS_WORD_CHAR)}) THEN NULL
                   WHEN c.noun THEN NULL ELSE s.tense END AS tense
            FROM (SELECT *, regexp_matches(token, {lit(fixed.CAPITALISED)})
                    AND before IS NOT NULL AND before NOT IN {openers} AS noun FROM {p}ctx) c
            LEFT JOIN lex ON lex.form = c.form LEFT JOIN {p}bysuffix s ON s.form = c.form
            WHERE c.form NOT IN (SELECT form FROM mwt)
            UNION ALL
            SELECT c.id, c.tok_id, m.word_id,
              CASE WHEN m.word_id = 0 AND regexp_matches(c.token, {lit(fixed.CAPITALISED)})
                   THEN upper(left(m.word, 1)) || substr(m.word, 2) ELSE m.word END,
              lex.lemma, coalesce(lex.upos, 'X'), lex.tense
            FROM {p}ctx c JOIN mwt m ON m.form = c.form LEFT JOIN lex ON lex.form = m.part""",
        ),
    ]


def tagged_ctes(source: str = DOCS) -> str:
    return with_(("src", source), *token_cte("FROM src"), *lexicon_ctes(), *words_ctes())


VERB = "upos = 'VERB'"
ANY_VERB = "upos IN ('VERB', 'AUX')"


def count_by_doc(condition: str) -> str:
    return (
        tagged_ctes()
        + f"""SELECT src.id AS doc_id, count(w.id) AS verb_count
        FROM src LEFT JOIN (SELECT * FROM words WHERE {condition}) w ON w.id = src.id GROUP BY 1"""
    )


# Of the forms seen twice, those whose length is a multiple of three are verbs.
VOCABULARY_VERBS = (
    with_(
        ("src", DOCS),
        *token_cte("FROM src"),
        ("forms", f"SELECT id, {folded('token')} AS form FROM tok"),
        ("lex", "SELECT form FROM forms GROUP BY form HAVING count(*) >= 2 AND length(form) % 3 = 0"),
    )
    + """SELECT src.id AS doc_id, count(lex.form) AS verb_count
    FROM src LEFT JOIN forms ON forms.id = src.id LEFT JOIN lex ON lex.form = forms.form GROUP BY 1"""
)


def label_cte(condition: str, label: str, p: str = "") -> tuple[str, str]:
    """One label per token: that of its first matching word."""
    return (
        f"{p}label",
        f"SELECT id, tok_id, arg_min({label}, word_id) AS label FROM {p}words WHERE {condition} GROUP BY 1, 2",
    )


def gap_cte(source: str, p: str = "") -> tuple[str, str]:
    """The white space before each token, and after the last one."""
    pieces = f"{lit(fixed.SPACE_RUN + '|' + TOKEN)}"
    return (
        f"{p}piece",
        f"""SELECT id, piece, n, regexp_matches(piece, {lit(fixed.SPACE_RUN)}) AS blank,
          sum(CASE WHEN regexp_matches(piece, {lit(fixed.SPACE_RUN)}) THEN 0 ELSE 1 END)
            OVER (PARTITION BY id ORDER BY n) - 1 AS tok_id
        FROM (SELECT id, unnest(t) AS piece, generate_subscripts(t, 1) AS n
              FROM (SELECT id, regexp_extract_all(text, {pieces}) AS t FROM {source}))""",
    )


def span(upos: str, inner: str) -> str:
    def opening(colour: str) -> str:
        return lit(fixed.HIGHLIGHT_OPEN.format(colour=colour))

    return (
        f"CASE {upos} WHEN 'VERB' THEN {opening(fixed.VERB_COLOUR)} || {inner} || {lit(fixed.HIGHLIGHT_CLOSE)}"
        f" WHEN 'AUX' THEN {opening(fixed.AUX_COLOUR)} || {inner} || {lit(fixed.HIGHLIGHT_CLOSE)} ELSE {inner} END"
    )


def marked_cte(p: str = "") -> tuple[str, str]:
    return (
        f"{p}marked",
        f"""SELECT x.id, string_agg({span("CASE WHEN NOT x.blank THEN l.label END", "x.piece")}, '' ORDER BY n) AS out
        FROM {p}piece x LEFT JOIN {p}label l ON l.id = x.id AND l.tok_id = x.tok_id GROUP BY 1""",
    )


TENSE_LABEL = "CASE tense WHEN 'Pres' THEN 'PRES' WHEN 'Past' THEN 'PAST' ELSE 'VERB' END"


def markup_cte(p: str = "") -> tuple[str, str]:
    def entity(label: str) -> str:
        opening = lit(fixed.MARK_OPEN.format(colour=fixed.TENSE_COLOURS[label]))
        closing = lit(fixed.MARK_LABEL.format(label=label))
        return f"WHEN '{label}' THEN {opening} || {escaped('x.piece')} || {closing}"

    cases = " ".join(entity(label) for label in fixed.TENSE_COLOURS)
    piece = (
        f"CASE WHEN x.blank THEN replace(x.piece, chr(10), '<br>') ELSE "
        f"CASE l.label {cases} ELSE {escaped('x.piece')} END END"
    )
    return (
        f"{p}markup",
        f"""SELECT x.id, string_agg({piece}, '' ORDER BY n) AS out
        FROM {p}piece x LEFT JOIN {p}label l ON l.id = x.id AND l.tok_id = x.tok_id GROUP BY 1""",
    )


def whole_markup(content: str) -> str:
    whole = f"{lit(fixed.MARKUP_OPEN)} || coalesce({content}, '') || {lit(fixed.MARKUP_CLOSE)}"
    return f"replace({whole}, '    ', '')"


# --- correction -------------------------------------------------------------


def corrected_ctes(tok: str = "tok") -> list[tuple[str, str]]:
    """Table corr(id, pos, token): the corrected tokens of table ``tok``."""
    rules = seed_rewrites(TABLE_REWRITES) + seed_rewrites()
    single = {s[0]: d for s, d in rules if len(s) == 1}
    pair = {tuple(s): d for s, d in rules if len(s) == 2}
    return [
        ("rw1(src, dst)", values([(s, d) for s, d in single.items()])),
        ("rw2(src, nxt, dst)", values([(*s, d) for s, d in pair.items()])),
        (
            "cand",
            f"""SELECT t.id, t.tok_id, t.token, rw2.dst, CASE WHEN rw2.src IS NULL THEN 0 ELSE 1 END AS c
            FROM (SELECT *, lead(token) OVER (PARTITION BY id ORDER BY tok_id) AS nxt FROM {tok}) t
            LEFT JOIN rw2 ON rw2.src = t.token AND rw2.nxt = t.nxt""",
        ),
        ("runs", "SELECT *, sum(1 - c) OVER (PARTITION BY id ORDER BY tok_id) AS g FROM cand"),
        (
            "hits",
            """SELECT *, c = 1 AND sum(c) OVER (PARTITION BY id, g ORDER BY tok_id) % 2 = 1 AS hit FROM runs""",
        ),
        (
            "kept",
            """SELECT *, coalesce(lag(hit) OVER (PARTITION BY id ORDER BY tok_id), false) AS gone FROM hits""",
        ),
        (
            "outs",
            """SELECT id, tok_id, CASE WHEN hit THEN k.dst WHEN rw1.src IS NOT NULL THEN rw1.dst ELSE [token] END AS o
            FROM kept k LEFT JOIN rw1 ON rw1.src = k.token WHERE NOT gone""",
        ),
        (
            "flat",
            """SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY tok_id, sub) - 1 AS pos
            FROM (SELECT id, tok_id, unnest(o) AS token, generate_subscripts(o, 1) AS sub FROM outs)""",
        ),
        (
            "caps",
            f"""SELECT id, pos, CASE WHEN regexp_matches(token, '\\A[\\p{{Ll}}]') AND left(token, 1) <> 'ß' AND
              coalesce(lag(token) OVER (PARTITION BY id ORDER BY pos), '.') IN {TERMINAL}
              THEN upper(left(token, 1)) || substr(token, 2) ELSE token END AS token FROM flat""",
        ),
        (
            "corr",
            f"""SELECT id, pos, token FROM caps UNION ALL
            SELECT id, max(pos) + 1, '.' FROM caps GROUP BY id
            HAVING regexp_matches(arg_max(token, pos), {lit(fixed.HAS_WORD_CHAR)})""",
        ),
        (
            "corrtext",
            f"""SELECT src.id, src.text AS original, coalesce(c.plain, '') AS plain,
              {quoted(detokenized("coalesce(c.plain, '')"))} AS text
            FROM src LEFT JOIN (SELECT id, string_agg(token, ' ' ORDER BY pos) AS plain FROM corr GROUP BY id) c
            ON c.id = src.id""",
        ),
    ]


def correction_prefix(*more: tuple[str, str], source: str = DOCS) -> str:
    return with_(("src", source), *token_cte("FROM src"), *corrected_ctes(), *more)


def metrics_prefix(source: str, original: str) -> str:
    """Table met(id, total_words, total_verbs, main_verbs, aux_verbs, corrected, highlighted)."""
    return with_(
        ("src", source),
        *token_cte(f"SELECT id, {original} AS text FROM src"),
        *corrected_ctes(),
        *token_cte("SELECT id, text FROM corrtext", "ctok"),
        *lexicon_ctes(),
        *words_ctes("ctok"),
        label_cte(ANY_VERB, "upos"),
        gap_cte("corrtext"),
        marked_cte(),
        (
            "met",
            f"""SELECT x.id, coalesce(n.total_words, 0) AS total_words,
              coalesce(v.main_verbs, 0) + coalesce(v.aux_verbs, 0) AS total_verbs,
              coalesce(v.main_verbs, 0) AS main_verbs, coalesce(v.aux_verbs, 0) AS aux_verbs,
              x.text AS corrected, coalesce(m.out, '') AS highlighted
            FROM corrtext x
            LEFT JOIN (SELECT id, count(*) FILTER (WHERE {IS_WORD}) AS total_words FROM tok GROUP BY 1) n ON n.id = x.id
            LEFT JOIN (SELECT id, count(*) FILTER (WHERE upos = 'VERB') AS main_verbs,
                count(*) FILTER (WHERE upos = 'AUX') AS aux_verbs FROM words GROUP BY 1) v ON v.id = x.id
            LEFT JOIN marked m ON m.id = x.id""",
        ),
    )


DOC_METRICS = metrics_prefix(DOCS, flattened("text"))
METRICS = ("total_words", "total_verbs", "main_verbs", "aux_verbs")


def rule_prefix() -> str:
    """Table outs(id, pos, o): the tokens of all documents by rules of one to six tokens."""
    leads = ", ".join(f"lead(token, {k}) OVER w AS t{k}" for k in range(1, 6))
    joined = ["token"]
    for k in range(1, 6):
        joined.append(f"{joined[-1]} || ' ' || t{k}")
    keys = " UNION ALL ".join(f"SELECT id, tok_id, {n} AS n, {key} AS key FROM near" for n, key in enumerate(joined, 1))
    return with_(
        ("src", DOCS),
        *token_cte("FROM src"),
        ("near", f"SELECT *, {leads} FROM tok WINDOW w AS (PARTITION BY id ORDER BY tok_id)"),
        ("keys", keys),
        ("rules", """SELECT DISTINCT n, key FROM keys JOIN documents ON doc_id = id
            WHERE lang = 'de' AND tok_id = 0 AND n = doc_id % 6 + 1 AND key IS NOT NULL"""),
        ("longest", "SELECT id, tok_id, max_by(key, n) AS key, max(n) AS n FROM keys JOIN rules USING (n, key) GROUP BY ALL"),
        ("flags", """SELECT id, string_agg(coalesce(n, 0), '' ORDER BY tok_id) AS f
            FROM tok LEFT JOIN longest USING (id, tok_id) GROUP BY id"""),
        ("steps", """SELECT id, unnest(s) AS step, generate_subscripts(s, 1) AS no FROM
            (SELECT id, regexp_extract_all(f, '0|1|2.|3..|4...|5....|6.....') AS s FROM flags)"""),
        ("places", """SELECT id, step, sum(length(step)) OVER (PARTITION BY id ORDER BY no) - length(step) AS pos FROM steps"""),
        ("outs", """SELECT p.id, p.pos, CASE WHEN step = '0' THEN token ELSE '<' || key || '>' END AS o
            FROM places p JOIN tok ON tok.id = p.id AND tok.tok_id = p.pos
            LEFT JOIN longest l ON l.id = p.id AND l.tok_id = p.pos"""),
    )


def spelling_prefix() -> str:
    """Table best(word, n, suggestion, suggestion_n, distance) for words said once and one letter off."""
    return with_(
        ("src", DOCS),
        *token_cte("FROM src"),
        ("vocab", "SELECT token AS word, count(*) AS n FROM tok WHERE regexp_full_match(token, '\\p{L}+') GROUP BY 1"),
        ("cut", """SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
            FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)"""),
        ("near", """SELECT u.word, u.n, k.word AS suggestion, k.n AS suggestion_n FROM cut u JOIN cut k
              ON k.i = u.i AND k.rest = u.rest AND length(k.word) = length(u.word)
            UNION SELECT u.word, u.n, k.word, k.n FROM cut u JOIN vocab k ON k.word = u.rest
            UNION SELECT u.word, u.n, k.word, k.n FROM vocab u JOIN cut k ON k.rest = u.word"""),
        ("best", """SELECT *, 1::BIGINT AS distance FROM near WHERE n <= 1 AND suggestion_n >= 10 AND length(word) >= 4
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY suggestion_n DESC, suggestion) = 1"""),
    )


def usage_prefix() -> str:
    return correction_prefix(
        (
            "usage",
            f"""SELECT d.doc_id, coalesce(a.n, 0) AS p, coalesce(b.n, 0) AS c,
              CASE WHEN d.lang = 'de' THEN (coalesce(a.n, 0) + coalesce(b.n, 0)) * {COST_PER_TOKEN!r}::DOUBLE END AS cost
            FROM documents d
            LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY 1) a ON a.id = d.doc_id
            LEFT JOIN (SELECT id, count(*) AS n FROM corr GROUP BY 1) b ON b.id = d.doc_id""",
        ),
        (
            "total",
            """SELECT CAST(coalesce(sum(p), 0) AS BIGINT) AS prompt_tokens,
              CAST(coalesce(sum(c), 0) AS BIGINT) AS completion_tokens,
              CAST(coalesce(sum(p + c), 0) AS BIGINT) AS total_tokens,
              coalesce(sum(coalesce(cost, 0)), 0)::DOUBLE AS cost FROM usage""",
        ),
    )


def tense_pair_prefix() -> str:
    """Words of the cleaned original (b_) and of the corrected text (a_)."""
    return correction_prefix(
        ("before", f"SELECT id, {cleaned('text')} AS text FROM src"),
        *token_cte("FROM before", "b_tok"),
        *token_cte("SELECT id, text FROM corrtext", "a_tok"),
        *lexicon_ctes(),
        *words_ctes("b_tok", "b_"),
        *words_ctes("a_tok", "a_"),
        *(
            (
                f"{p}count",
                f"""SELECT src.id, count(w.id) FILTER (WHERE tense = 'Pres') AS pres,
                count(w.id) FILTER (WHERE tense = 'Past') AS past, count(w.id) AS verb
                FROM src LEFT JOIN (SELECT * FROM {p}words WHERE {ANY_VERB}) w ON w.id = src.id GROUP BY 1""",
            )
            for p in ("b_", "a_")
        ),
        label_cte(ANY_VERB, TENSE_LABEL, "b_"),
        label_cte(ANY_VERB, TENSE_LABEL, "a_"),
        gap_cte("before", "b_"),
        gap_cte("corrtext", "a_"),
        markup_cte("b_"),
        markup_cte("a_"),
    )


def section_sql() -> str:
    def counts(c: str) -> str:
        return f"""'{{''PRES'': ' || {c}.pres || ', ''PAST'': ' || {c}.past || ', ''VERB'': ' || {c}.verb || '}}'"""

    fills = iter(
        [
            "CAST(b.id + 1 AS VARCHAR)",
            counts("b"),
            whole_markup("bm.out"),
            counts("a"),
            whole_markup("am.out"),
        ]
    )
    parts = []
    for line in fixed.SECTION_LINES:
        before, mark, after = line.replace("%d", "%s").partition("%s")
        parts.append(" || ".join([lit(before)] + ([next(fills), lit(after)] if mark else [])))
    return " || chr(10) || ".join(parts)


def build() -> dict[str, str]:
    tokens = with_(("src", DOCS), *token_cte("FROM src"))
    exclude = "(" + ", ".join(map(lit, EXCLUDED)) + ")"
    excluded = (
        f"{ANY_VERB} AND {folded('word')} NOT IN {exclude} "
        f"AND {folded('coalesce(lemma, chr(0))')} NOT IN {exclude}"
    )
    starts = f"before IS NULL OR (before IN {TERMINAL} AND token NOT IN {TERMINAL})"
    placed = f"""SELECT *, sum(CASE WHEN {starts} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY tok_id) - 1 AS sent_id
        FROM (SELECT *, lag(token) OVER (PARTITION BY id ORDER BY tok_id) AS before FROM tok)"""
    diffs = ", ".join(f"arg_max({m}, turn) - arg_min({m}, turn) AS diff_{m}" for m in METRICS)
    labels = ", ".join(f"{diff_label(f'diff_{m}')} AS label_{m}" for m in METRICS)
    csv_columns = ", ".join(f'{column} AS "{label}"' for label, column in fixed.METRIC_SERIES.items())
    series = " UNION ALL ".join(
        f"SELECT 'Text ' || (id + 1) AS name, {lit(label)} AS metric, {column} AS value FROM met"
        for label, column in fixed.METRIC_SERIES.items()
    )
    example_rows = [
        (number, sorted(set(before.split(" "))), len(before.split(" ")), len(after.split(" ")))
        for number, (before, after) in enumerate(fixed.WORKED_PAIRS, start=1)
    ]
    usage_text = (
        "'Total Tokens: ' || total_tokens || ' (prompt: ' || prompt_tokens || ', completion: ' || completion_tokens || ')'"
    )
    return {
        "clean_text": f"SELECT doc_id, {cleaned('text')} AS out FROM documents",
        "flatten_text": f"SELECT doc_id, {flattened('text')} AS out FROM documents",
        "german_quotes": f"SELECT doc_id, {quoted('text')} AS out FROM documents",
        "detokenize": tokens
        + f"""SELECT src.id AS doc_id, {detokenized("coalesce(string_agg(token, ' ' ORDER BY tok_id), '')")} AS out
        FROM src LEFT JOIN tok ON tok.id = src.id GROUP BY src.id""",
        "word_count": tokens
        + f"""SELECT src.id AS doc_id, count(tok.id) FILTER (WHERE {IS_WORD}) AS total_words
        FROM src LEFT JOIN tok ON tok.id = src.id GROUP BY src.id""",
        "tokens": tokens + "SELECT id AS doc_id, CAST(tok_id AS BIGINT) AS tok_id, token FROM tok",
        "token_offsets": with_(("src", DOCS), gap_cte("src"))
        + f"""SELECT doc_id, tok_id, CAST(sent_id AS BIGINT) AS sent_id,
          CAST(tok_id - min(tok_id) OVER (PARTITION BY doc_id, sent_id) AS BIGINT) AS tok_in_sent,
          token, start_char, end_char
        FROM (SELECT id AS doc_id, tok_id, token, start_char, end_char,
                sum(CASE WHEN {starts} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY tok_id) - 1 AS sent_id
              FROM (SELECT *, lag(token) OVER (PARTITION BY id ORDER BY tok_id) AS before
                FROM (SELECT id, CAST(tok_id AS BIGINT) AS tok_id, piece AS token, blank,
                        CAST(upto - length(piece) AS BIGINT) AS start_char, CAST(upto AS BIGINT) AS end_char
                      FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY id ORDER BY n) AS upto FROM piece))
                WHERE NOT blank))""",
        "sentences": tokens
        + f"""SELECT id AS doc_id, CAST(sent_id AS BIGINT) AS sent_id, count(*) AS n_tokens
        FROM ({placed}) GROUP BY 1, 2""",
        "mwt_words": with_(("src", DOCS), *token_cte("FROM src"), *lexicon_ctes())
        + f"""SELECT id AS doc_id, CAST(tok_id AS BIGINT) AS tok_id, CAST(coalesce(word_id, 0) AS BIGINT) AS word_id,
          CASE WHEN m.word IS NULL THEN token
               WHEN m.word_id = 0 AND regexp_matches(token, {lit(fixed.CAPITALISED)})
               THEN upper(left(m.word, 1)) || substr(m.word, 2) ELSE m.word END AS word
        FROM tok LEFT JOIN mwt m ON m.form = {folded("token")}""",
        "casefold_vocab": tokens + f"SELECT {folded('token')} AS form, count(*) AS n FROM tok GROUP BY 1",
        "drop_blank": f"""SELECT doc_id, 'Text ' || slot AS name, text
        FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS slot
              FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
        WHERE {replace_all("text", STRIP, "")} <> ''""",
        "correct_tokens": correction_prefix() + "SELECT id AS doc_id, plain AS corrected FROM corrtext",
        "correct_spelling": correction_prefix() + "SELECT id AS doc_id, text AS corrected FROM corrtext",
        "correct_identity": tokens
        + f"""SELECT src.id AS doc_id,
          {quoted(detokenized("coalesce(string_agg(token, ' ' ORDER BY tok_id), '')"))} AS corrected,
          CAST(NULL AS VARCHAR) AS error
        FROM src LEFT JOIN tok ON tok.id = src.id GROUP BY src.id""",
        "correct_whole_text": f"SELECT doc_id, {cleaned('text')} AS corrected, CAST(NULL AS VARCHAR) AS error FROM documents",
        "correction_audit": correction_prefix(
            ("b", "SELECT id, tok_id AS pos, token FROM tok"),
            (
                "place",
                """SELECT coalesce(b.id, c.id) AS id, b.token AS bt, c.token AS ct
                FROM b FULL JOIN corr c ON c.id = b.id AND c.pos = b.pos""",
            ),
            ("gone", "SELECT id, count(*) AS n FROM (SELECT id, token FROM b EXCEPT SELECT id, token FROM corr) GROUP BY 1"),
            ("come", "SELECT id, count(*) AS n FROM (SELECT id, token FROM corr EXCEPT SELECT id, token FROM b) GROUP BY 1"),
        )
        + """SELECT src.id AS doc_id, count(bt) AS n_before, count(ct) AS n_after,
          count(*) FILTER (WHERE bt IS DISTINCT FROM ct) AS n_changed,
          coalesce(any_value(gone.n), 0) AS n_deleted, coalesce(any_value(come.n), 0) AS n_inserted,
          count(ct) < count(bt) AS flag_shorter, coalesce(any_value(gone.n), 0) > 0 AS flag_deleted
        FROM src LEFT JOIN place ON place.id = src.id LEFT JOIN gone ON gone.id = src.id LEFT JOIN come ON come.id = src.id
        GROUP BY src.id""",
        "rewrite_rules": rule_prefix()
        + """SELECT src.id AS doc_id, count(o) AS n_tokens, coalesce(string_agg(o, ' ' ORDER BY pos), '') AS rewritten
        FROM src LEFT JOIN outs ON outs.id = src.id GROUP BY src.id""",
        "spelling_suggestions": spelling_prefix() + "SELECT * FROM best",
        "correct_unknown": spelling_prefix()
        + """SELECT src.id AS doc_id, coalesce(string_agg(coalesce(suggestion, token), ' ' ORDER BY tok_id), '') AS corrected
        FROM src LEFT JOIN tok ON tok.id = src.id LEFT JOIN best ON best.word = tok.token GROUP BY src.id""",
        "answer_store": with_(
            ("src", DOCS),
            *token_cte("FROM src"),
            ("lists", f"SELECT lang, regexp_extract_all(text, {lit(TOKEN)}) AS t FROM documents"),
            ("calls", """SELECT count(DISTINCT t) FILTER (lang = 'de') AS german, count(DISTINCT t) AS all_ FROM lists"""),
        )
        + f"""SELECT src.id AS doc_id, {quoted(detokenized("coalesce(string_agg(token, ' ' ORDER BY tok_id), '')"))} AS corrected,
          CAST(NULL AS VARCHAR) AS error, any_value(german) AS calls_german, any_value(all_ - german) AS calls_all, 0::BIGINT AS calls_again
        FROM src LEFT JOIN tok ON tok.id = src.id, calls GROUP BY src.id""",
        "usage_of_calls": with_(
            ("lists", f"SELECT lang, regexp_extract_all(text, {lit(TOKEN)}) AS t FROM documents"),
            ("asked", "SELECT t, bool_or(lang IS NOT DISTINCT FROM 'de') AS german, len(t) AS p, len(list_filter(t, lambda x: length(x) > 3)) AS c FROM lists WHERE t IS NOT NULL GROUP BY t"),
            ("runs", """SELECT CASE WHEN german THEN '1 german' ELSE '2 all' END AS run, * FROM asked
              UNION ALL SELECT 'store', * FROM asked"""),
        )
        + f"""SELECT names.run, count(t) AS calls, 0::BIGINT AS failed, CAST(coalesce(sum(p), 0) AS BIGINT) AS prompt_tokens,
          CAST(coalesce(sum(c), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(p + c), 0) AS BIGINT) AS total_tokens,
          coalesce(sum(CASE WHEN p % 2 = 0 THEN p * {COST_PER_TOKEN!r}::DOUBLE END), 0) AS cost
        FROM (VALUES ('1 german'), ('2 all'), ('3 again'), ('store')) AS names(run) LEFT JOIN runs USING (run) GROUP BY names.run""",
        "dedupe_requests": f"""SELECT count(*) AS n_texts,
          count(DISTINCT regexp_extract_all(text, {lit(TOKEN)})) AS n_calls FROM documents""",
        "usage_totals": usage_prefix() + "SELECT * FROM total",
        "cost_info": usage_prefix()
        + f"""SELECT concat_ws({lit(fixed.INFO_SEPARATOR)},
          CASE WHEN cost > 0 THEN printf({lit(fixed.COST_FORMAT)}, cost) END,
          CASE WHEN total_tokens > 0 THEN {usage_text} END) AS info FROM total""",
        "examples": with_(
            ("src", DOCS),
            *token_cte("FROM src"),
            ("ex(ex_id, sought, n_tokens, n_corrected)", values(example_rows)),
            ("one", "SELECT ex_id, unnest(sought) AS token FROM ex"),
            ("hit", "SELECT ex_id, count(*) AS n FROM one JOIN tok USING (token) GROUP BY 1"),
        )
        + """SELECT ex.ex_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_corrected AS BIGINT) AS n_corrected,
          coalesce(hit.n, 0) AS corpus_hits FROM ex LEFT JOIN hit ON hit.ex_id = ex.ex_id""",
        "tag_words": tagged_ctes()
        + """SELECT id AS doc_id, CAST(tok_id AS BIGINT) AS tok_id, CAST(word_id AS BIGINT) AS word_id,
          word, lemma, upos, tense FROM words""",
        "count_verbs": count_by_doc(VERB),
        "count_verbs_aux": count_by_doc(ANY_VERB),
        "count_verbs_exclude": count_by_doc(excluded),
        "count_verbs_broadcast": VOCABULARY_VERBS,
        "count_verbs_shuffled": VOCABULARY_VERBS,
        "verbs_list": tagged_ctes()
        + f"""SELECT src.id AS doc_id,
          coalesce(string_agg(concat_ws('/', word, lemma, upos), ' ' ORDER BY tok_id, word_id), '') AS verbs
        FROM src LEFT JOIN (SELECT * FROM words WHERE {VERB}) w ON w.id = src.id GROUP BY 1""",
        "verb_split": tagged_ctes()
        + """SELECT src.id AS doc_id, count(w.id) FILTER (WHERE upos = 'VERB') AS main_verbs,
          count(w.id) FILTER (WHERE upos = 'AUX') AS aux_verbs
        FROM src LEFT JOIN words w ON w.id = src.id GROUP BY 1""",
        "highlight_verbs": with_(
            ("src", DOCS),
            *token_cte("FROM src"),
            *lexicon_ctes(),
            *words_ctes(),
            label_cte(ANY_VERB, "upos"),
            gap_cte("src"),
            marked_cte(),
        )
        + "SELECT src.id AS doc_id, coalesce(out, '') AS highlighted FROM src LEFT JOIN marked ON marked.id = src.id",
        "highlight_words": tagged_ctes()
        + f"""SELECT src.id AS doc_id,
          coalesce(string_agg({span("upos", "word")}, ' ' ORDER BY tok_id, word_id), '') AS highlighted
        FROM src LEFT JOIN words ON words.id = src.id GROUP BY 1""",
        "tense_counts": tagged_ctes()
        + f"""SELECT src.id AS doc_id, count(w.id) FILTER (WHERE tense = 'Pres') AS pres,
          count(w.id) FILTER (WHERE tense = 'Past') AS past, count(w.id) AS verb
        FROM src LEFT JOIN (SELECT * FROM words WHERE {ANY_VERB}) w ON w.id = src.id GROUP BY 1""",
        "tense_markup": with_(
            ("src", DOCS),
            *token_cte("FROM src"),
            *lexicon_ctes(),
            *words_ctes(),
            label_cte(ANY_VERB, TENSE_LABEL),
            gap_cte("src"),
            markup_cte(),
        )
        + f"SELECT src.id AS doc_id, {whole_markup('m.out')} AS html FROM src LEFT JOIN markup m ON m.id = src.id",
        "process_frame": metrics_prefix(DOCS, "text")
        + """SELECT src.id AS doc_id, src.text AS original_text, met.corrected AS corrected_text,
          met.main_verbs AS verb_count FROM src JOIN met ON met.id = src.id""",
        "process_texts": metrics_prefix(DOCS, "text")
        + "SELECT id AS doc_id, main_verbs AS verb_count FROM met",
        "text_metrics": DOC_METRICS
        + "SELECT id AS doc_id, total_words, total_verbs, main_verbs, aux_verbs, corrected, highlighted FROM met",
        "compare_first_last": metrics_prefix(
            f"""SELECT conv_id * 1000000 + turn AS id, text, conv_id, turn FROM conversations
            WHERE {replace_all("text", STRIP, "")} <> ''""",
            flattened("text"),
        )
        + f"""SELECT conv_id, {", ".join(f"diff_{m}" for m in METRICS)}, {labels}
        FROM (SELECT conv_id, count(*) AS n, {diffs} FROM met JOIN src ON src.id = met.id GROUP BY 1) WHERE n >= 2""",
        "metrics_long": DOC_METRICS + series,
        "metrics_csv": DOC_METRICS + f"""SELECT 'Text ' || (id + 1) AS "Text", {csv_columns} FROM met""",
        "original_vs_corrected": tense_pair_prefix()
        + """SELECT b.id AS doc_id, b.pres AS original_pres, b.past AS original_past, b.verb AS original_verb,
          a.pres AS corrected_pres, a.past AS corrected_past, a.verb AS corrected_verb
        FROM b_count b JOIN a_count a ON a.id = b.id""",
        "report_sections": tense_pair_prefix()
        + f"""SELECT b.id AS doc_id, {section_sql()} AS fragment
        FROM b_count b JOIN a_count a ON a.id = b.id
        LEFT JOIN b_markup bm ON bm.id = b.id LEFT JOIN a_markup am ON am.id = b.id""",
    }
