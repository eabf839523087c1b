"""Seed data: a small German lexicon, contractions and rewrites.

The seed covers common function words, auxiliaries and the verbs of the worked
examples. It is a default, not a dictionary: pass a larger table as a frame of
the same shape and the lookup changes from an inline literal to a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from satzwerk.functions import fixed
from satzwerk.operators.kept import kept
from satzwerk.operators.reference import ReferenceTable, table_bytes

TAG_TYPE = "struct<lemma:string,upos:string,tense:string>"
LEXICON_SCHEMA = (
    "kind string, form string, lemma string, upos string, tense string, priority int"
)

# lemma, class, tense ("-" for none): forms
SEED_FORMS = """
sein AUX Pres: bin bist ist sind seid
sein AUX Past: war warst waren wart
sein AUX -: gewesen
haben AUX Pres: habe hast hat haben habt
haben AUX Past: hatte hattest hatten hattet
haben AUX -: gehabt
werden AUX Pres: werde wirst wird werden werdet
werden AUX Past: wurde wurdest wurden wurdet
werden AUX -: geworden worden
können AUX Pres: kann kannst können könnt
können AUX Past: konnte konnten
müssen AUX Pres: muss musst müssen müsst
müssen AUX Past: musste mussten
sollen AUX Pres: soll sollst sollen sollt
sollen AUX Past: sollte sollten
wollen AUX Pres: will willst wollen wollt
wollen AUX Past: wollte wollten
dürfen AUX Pres: darf darfst dürfen dürft
dürfen AUX Past: durfte durften
mögen AUX Pres: mag magst mögen mögt
mögen AUX Past: mochte mochten
laufen VERB Pres: laufe läufst läuft laufen lauft
laufen VERB Past: lief liefen
laufen VERB -: gelaufen
bringen VERB Pres: bringe bringst bringt bringen
bringen VERB Past: brachte brachten
bringen VERB -: gebracht
lassen VERB Pres: lasse lässt lassen lasst
lassen VERB Past: ließ ließen
lassen VERB -: gelassen
fahren VERB Pres: fahre fährst fährt fahren fahrt
fahren VERB Past: fuhr fuhren
fahren VERB -: gefahren
losfahren VERB -: losfahren losgefahren
geben VERB Pres: gebe gibst gibt geben
geben VERB Past: gab gaben
geben VERB -: gegeben
gehen VERB Pres: gehe gehst geht gehen
gehen VERB Past: ging gingen
gehen VERB -: gegangen
kommen VERB Pres: komme kommst kommt kommen
kommen VERB Past: kam kamen
ankommen VERB Past: ankam ankamen
ankommen VERB -: ankommen angekommen
heißen VERB Pres: heiße heißt heißen
heißen VERB Past: hieß hießen
heißen VERB -: geheißen
segeln VERB Pres: segelt segeln
segeln VERB Past: segelte segelten
aufbauen VERB -: aufbauen aufgebaut
ausschalten VERB -: ausschalten ausgeschaltet
d DET -: der die das den dem des
ein DET -: ein eine einen einem einer eines
ich PRON -: ich mich mir
du PRON -: du dich dir
er PRON -: er ihn ihm
sie PRON -: sie
es PRON -: es
wir PRON -: wir uns
sich PRON -: sich
in ADP -: in
an ADP -: an
auf ADP -: auf
aus ADP -: aus
mit ADP -: mit
von ADP -: von
zu ADP -: zu
bei ADP -: bei
für ADP -: für
und CCONJ -: und
oder CCONJ -: oder
aber CCONJ -: aber
dass SCONJ -: dass
als SCONJ -: als
nicht PART -: nicht
so ADV -: so
heute ADV -: heute
zurück ADV -: zurück
"""
# Regular verbs; their forms follow from the rule in ``_regular_forms``.
SEED_REGULAR_VERBS = "bauen spielen sagen machen gucken leeren zeigen beobachten"

# ending, ending of the lemma, class, tense; at least three letters must precede
SEED_SUFFIXES = """
ierten ieren VERB Past
ierte ieren VERB Past
ieren ieren VERB Pres
iert ieren VERB Pres
ten en VERB Past
te en VERB Past
"""
MIN_STEM = 3

SEED_CONTRACTIONS = """
im: in dem
am: an dem
zum: zu dem
zur: zu der
vom: von dem
beim: bei dem
ins: in das
ans: an das
aufs: auf das
fürs: für das
ums: um das
durchs: durch das
vors: vor das
übers: über das
unters: unter das
hinters: hinter das
überm: über dem
unterm: unter dem
hinterm: hinter dem
vorm: vor dem
"""

# tokens before -> tokens after, one or two tokens on the left
SEED_REWRITES = """
heiß -> heißt
kuken -> gucken
männer -> Männer
wasser -> Wasser
lehrer -> Lehrer
sakte -> sagte
dehn -> den
schülern -> Schülern
ihrre -> ihre
unterricht -> Unterricht
fahrten -> fuhren
kuckt -> guckt
ankamm -> ankam
Schienien -> Schienen
Haand Figure -> Hauptfigur
, , -> "
"""

LexiconRow = tuple[str, str, str, str, str | None, int]


def _regular_forms(infinitive: str) -> list[tuple[str, str | None]]:
    stem = infinitive.removesuffix("en")
    link = "e" if stem.endswith(("t", "d")) else ""
    past = stem + link + "te"
    participle = stem + link + "t"
    if not stem.startswith("be"):
        participle = "ge" + participle
    return [
        (stem + "e", "Pres"),
        (stem + link + "st", "Pres"),
        (stem + link + "t", "Pres"),
        (infinitive, "Pres"),
        (past, "Past"),
        (past + "st", "Past"),
        (past + "n", "Past"),
        (past + "t", "Past"),
        (participle, None),
    ]


def fold(text: str) -> str:
    """The folding of lookup keys; the same as ``functions.text.casefold``."""
    return text.lower().replace("ß", "ss")


def seed_lexicon_rows() -> list[LexiconRow]:
    """(kind, form, lemma, upos, tense, priority); forms are folded and unique."""
    rows: dict[tuple[str, str], LexiconRow] = {}

    def add(kind: str, form: str, lemma: str, upos: str, tense: str | None) -> None:
        rows.setdefault((kind, fold(form)), (kind, fold(form), lemma, upos, tense, 1))

    for line in SEED_FORMS.strip().splitlines():
        head, forms = line.split(": ")
        lemma, upos, tense = head.split(" ")
        for form in forms.split(" "):
            add("form", form, lemma, upos, None if tense == "-" else tense)
    for infinitive in SEED_REGULAR_VERBS.split(" "):
        for form, form_tense in _regular_forms(infinitive):
            add("form", form, infinitive, "VERB", form_tense)
    for line in SEED_SUFFIXES.strip().splitlines():
        suffix, ending, upos, tense = line.split(" ")
        add("suffix", suffix, ending, upos, tense)
    return list(rows.values())


def seed_contractions() -> dict[str, list[str]]:
    pairs = (line.split(": ") for line in SEED_CONTRACTIONS.strip().splitlines())
    return {form: words.split(" ") for form, words in pairs}


def seed_rewrites(lines: str = SEED_REWRITES) -> list[tuple[list[str], list[str]]]:
    pairs = (line.split(" -> ") for line in lines.strip().splitlines())
    return [(source.split(" "), target.split(" ")) for source, target in pairs]


@dataclass(frozen=True)
class Lexicon:
    """Tags by folded form, suffix rules, and contractions with tagged parts."""

    forms: ReferenceTable
    suffixes: tuple[tuple[str, str, str, str | None], ...]
    contractions: dict[str, list[dict]]

    @staticmethod
    def from_rows(
        rows: Iterable[LexiconRow] | None = None,
        contractions: dict[str, list[str]] | None = None,
    ) -> Lexicon:
        rows = seed_lexicon_rows() if rows is None else list(rows)
        forms: dict[str, dict] = {}
        best_first = sorted(rows, key=lambda row: (row[5], row[2], row[3], row[4] or ""))
        for kind, form, lemma, upos, tense, _ in best_first:
            if kind == "form":
                forms.setdefault(form, {"lemma": lemma, "upos": upos, "tense": tense})
        suffixes = [(r[1], r[2], r[3], r[4], r[5]) for r in rows if r[0] == "suffix"]
        return Lexicon._assemble(
            ReferenceTable.from_rows(forms, TAG_TYPE), suffixes, contractions
        )

    @staticmethod
    def from_frame(
        frame: DataFrame, contractions: dict[str, list[str]] | None = None, **limits: int
    ) -> Lexicon:
        """A lexicon table of LEXICON_SCHEMA of any size.

        Suffix rules are grammar, written by hand; all of them come to the driver.

        Of several rows for a form the one of lowest ``priority`` counts.
        """
        ranked = F.struct("priority", "lemma", "upos", "tense")
        forms = (
            frame.where(F.col("kind") == "form")
            .groupBy(F.col("form").alias("key"))
            .agg(F.min(ranked).alias("best"))
            .select("key", F.struct("best.lemma", "best.upos", "best.tense").alias("value"))
        )
        rules = frame.where(F.col("kind") == "suffix")
        suffixes = rules.select("form", "lemma", "upos", "tense", "priority")
        return Lexicon._assemble(
            ReferenceTable.from_frame(forms, **limits),
            [tuple(rule) for rule in suffixes.collect()],
            contractions,
        )

    @staticmethod
    def _assemble(forms: ReferenceTable, suffixes: list, contractions: dict | None) -> Lexicon:
        contractions = seed_contractions() if contractions is None else contractions
        parts = forms.subset(word for words in contractions.values() for word in words)
        unknown = {"lemma": None, "upos": "X", "tense": None}
        tagged = {
            form: [{"word": word, **parts.get(fold(word), unknown)} for word in words]
            for form, words in contractions.items()
        }
        by_length = sorted(suffixes, key=lambda rule: (-len(rule[0]), rule[4]))
        return Lexicon(forms, tuple(rule[:4] for rule in by_length), tagged)


@dataclass(frozen=True)
class Rewrites:
    """Replacement of one or more neighbouring tokens by a token list.

    ``tables`` holds the rules by their number of tokens. The key of a rule is its
    tokens with spaces between; tokens hold none.
    """

    tables: Mapping[int, ReferenceTable]

    @staticmethod
    def from_rows(rows: Iterable[tuple[list[str], list[str]]] | None = None) -> Rewrites:
        rows = seed_rewrites() if rows is None else list(rows)
        by_length: dict[int, dict[str, list[str]]] = {}
        for source, target in rows:
            if not source:
                raise ValueError("a rule needs a token to replace")
            by_length.setdefault(len(source), {})[" ".join(source)] = target
        return Rewrites({n: ReferenceTable.from_rows(some, "array<string>") for n, some in sorted(by_length.items())})

    @staticmethod
    def from_frame(frame: DataFrame, **limits: int) -> Rewrites:
        """A table ``n INT, src ARRAY<STRING>, dst ARRAY<STRING>`` of any size.

        Of several rules for the same tokens the one of the smallest ``dst`` counts.
        The numbers of tokens that occur come to the driver, with the bytes of their rules.
        The rules are kept in files, as each look-up reads those of each number of tokens.
        """
        rules = frame.where("size(src) > 0 AND dst IS NOT NULL").select(
            F.array_size("src").alias("n"), F.array_join("src", " ").alias("key"), F.col("dst").alias("value")
        )
        best = kept(rules.groupBy("n", "key").agg(F.min("value").alias("value")), "rules")
        sizes = {row.n: row.bytes for row in best.groupBy("n").agg(table_bytes().alias("bytes")).collect()}

        def table(n: int) -> ReferenceTable:
            return ReferenceTable.of_size(best.where(F.col("n") == n).select("key", "value"), sizes[n], **limits)

        return Rewrites({n: table(n) for n in sorted(sizes)})


def examples_frame(spark: SparkSession) -> DataFrame:
    """The worked correction pairs: ex_id, tokens, corrected."""
    rows = [
        (number, before.split(" "), after.split(" "))
        for number, (before, after) in enumerate(fixed.WORKED_PAIRS, start=1)
    ]
    return spark.createDataFrame(
        rows, "ex_id int, tokens array<string>, corrected array<string>"
    )
