"""The queries over the given tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from satzwerk.functions import tags, text as tx
from satzwerk.operators import alignment, answers, correction, spelling, tokens as tk, usage as us
from satzwerk.operators.kept import scratch_path
from satzwerk.operators.lexicon import Lexicon, Rewrites, examples_frame, seed_rewrites
from satzwerk.operators.tagging import tag_texts, word_table
from satzwerk.plans import metrics as plans
from satzwerk.sources.sinks import metrics_rows
from satzwerk.sources.texts import drop_blank, read_texts, spread

# The words of the test tables are invented; these rewrites occur in them.
TABLE_REWRITES = """
ung -> und
sch -> sich
ench -> mancher
thatin -> that in
Of -> Off
! ! -> !
% % -> %
* * -> *
der der -> der
. Der -> , der
"""
EXCLUDED = ("ist", "erten", "haben")
COST_PER_TOKEN = 2.0**-20

Query = Callable[[SparkSession, str], DataFrame]


def rewrites() -> Rewrites:
    return Rewrites.from_rows(seed_rewrites(TABLE_REWRITES) + seed_rewrites())


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_texts(spark, f"{folder}/documents.parquet", "doc_id")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    return spread(table.select("conv_id", "turn", "text"), "conv_id", "turn")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).withColumn("tokens", tx.tokenize(F.col("text")))


def _tagged(spark: SparkSession, folder: str, verbs_only: bool = True) -> DataFrame:
    return tag_texts(documents(spark, folder), id_col="doc_id", verbs_only=verbs_only)


def _corrected(spark: SparkSession, folder: str) -> DataFrame:
    return correction.correct_tokens(_tokens(spark, folder), rewrites(), id_col="doc_id")


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return plans.text_metrics(documents(spark, folder), rewrites(), id_col="doc_id")


def _named_metrics(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("Text "), (F.col("doc_id") + 1).cast("string"))
    return _metrics(spark, folder).withColumn("name", name)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    corrected = correction.correct_spelling(
        documents(spark, folder), rewrites(), id_col="doc_id"
    )
    return corrected.withColumnRenamed("text", "original")


def _over_documents(name: str, function: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return documents(spark, folder).select("doc_id", function(F.col("text")).alias(name))

    return query


def casefold_vocab(spark: SparkSession, folder: str) -> DataFrame:
    form = tx.casefold(F.col("token")).alias("form")
    table = tk.token_table(documents(spark, folder), id_col="doc_id")
    return table.groupBy(form).agg(F.count("*").alias("n"))


def drop_blank_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = documents(spark, folder).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("_slot", "text")
    )
    name = F.concat(F.lit("Text "), (F.col("_slot") + 1).cast("string")).alias("name")
    return drop_blank(lines.select("doc_id", name, "text"))


def correct_tokens(spark: SparkSession, folder: str) -> DataFrame:
    joined = F.array_join("corrected_tokens", " ").alias("corrected")
    return _corrected(spark, folder).select("doc_id", joined)


def correct_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("doc_id", "corrected")


def correct_identity(spark: SparkSession, folder: str) -> DataFrame:
    done = correction.correct_spelling(
        documents(spark, folder), correction.identity_corrector, id_col="doc_id"
    )
    return done.select("doc_id", "corrected", "error")


def _same_text() -> correction.TextCorrector:
    return str


def correct_whole_text(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = documents(spark, folder).select("doc_id", tx.clean_text(F.col("text")).alias("text"))
    done = correction.correct_whole_text(cleaned, _same_text)
    return done.select("doc_id", "corrected", "error")


def correction_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = correction.correction_audit(F.col("tokens"), F.col("corrected_tokens"))
    return _corrected(spark, folder).select("doc_id", audit.alias("_audit")).select("doc_id", "_audit.*")


def dedupe_requests(spark: SparkSession, folder: str) -> DataFrame:
    key = correction.request_key(F.col("tokens")).alias("key")
    counts = _tokens(spark, folder).groupBy(key).agg(F.count("*").alias("n_texts"))
    return counts.agg(
        F.coalesce(F.sum("n_texts"), F.lit(0)).alias("n_texts"), F.count("*").alias("n_calls")
    )


def _by_language(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, lang and tokens of the documents."""
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    return spread(table, "doc_id").withColumn("tokens", tx.tokenize(F.col("text"))).drop("text")


def correction_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's correction as a shortest edit script, counted."""
    audit = alignment.edit_audit(F.col("tokens"), F.col("corrected_tokens"))
    return _corrected(spark, folder).select("doc_id", audit.alias("_audit")).select("doc_id", "_audit.*").drop("script")


def rewrite_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All documents by rules of one to six tokens: the beginnings of the German ones, put in brackets."""
    texts = _by_language(spark, folder)
    n = (F.col("doc_id") % 6 + 1).cast("int")
    src = F.slice("tokens", F.lit(1), n)
    rules = texts.where((F.col("lang") == "de") & (F.array_size("tokens") >= n)).select(
        n.alias("n"), src.alias("src"), F.array(F.concat(F.lit("<"), F.array_join(src, " "), F.lit(">"))).alias("dst")
    )
    done = correction.rewrite_tokens(texts, Rewrites.from_frame(rules, inline_bytes=0), "tokens", "_out", keep=True)
    return done.select("doc_id", tags.size_of(F.col("_out")).alias("n_tokens"), F.array_join("_out", " ").alias("rewritten"))


def _suggestions(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.suggestions(spelling.vocabulary(documents(spark, folder)), two_from=None)


def correct_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with words said once replaced by a frequent one a letter away."""
    rules = spelling.as_rewrites(_suggestions(spark, folder))
    done = correction.rewrite_tokens(_tokens(spark, folder), rules, "tokens", "_out")
    return done.select("doc_id", F.array_join("_out", " ").alias("corrected"))


def answer_store(spark: SparkSession, folder: str) -> DataFrame:
    """All documents by answers of three runs, and how often each run called: German ones, all, all again."""
    texts, path = _by_language(spark, folder), scratch_path(spark, "answers")
    german = answers.answer_open_requests(texts.where("lang = 'de'"), correction.identity_corrector, path)
    all_ = answers.answer_open_requests(texts, correction.identity_corrector, path)
    again = answers.answer_open_requests(texts, correction.identity_corrector, path)
    done = answers.correct_stored(texts, correction.identity_corrector, path, id_col="doc_id")
    return done.select(
        "doc_id", correction.corrected_text(F.col("corrected_tokens")).alias("corrected"), "error",
        F.lit(german).cast("bigint").alias("calls_german"), F.lit(all_).cast("bigint").alias("calls_all"), F.lit(again).cast("bigint").alias("calls_again"),
    )


def _reporting_corrector() -> correction.Corrector:
    """Returns what it gets and reports usage; a cost only for an even number of tokens."""

    def run(tokens: list[str]) -> correction.Answered:
        prompt, completion = len(tokens), sum(len(token) > 3 for token in tokens)
        told = {"prompt_tokens": prompt, "completion_tokens": completion, "total_tokens": prompt + completion}
        return correction.Answered(tokens, told if prompt % 2 else told | {"cost": prompt * COST_PER_TOKEN})

    return run


def usage_of_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and usage of three runs over all documents (German ones, all, all again) and of their store."""
    texts, path = _by_language(spark, folder), scratch_path(spark, "answers")
    runs = [
        (name, *answers.call_open_requests(asked, _reporting_corrector, path))
        for name, asked in (("1 german", texts.where("lang = 'de'")), ("2 all", texts), ("3 again", texts))
    ]
    kept = answers.read_usage(spark, path)
    store = kept.agg(F.lit("store").alias("run"), F.count("*").alias("calls"), F.lit(0).cast("bigint").alias("failed"), *us.total_columns())
    return spark.createDataFrame(runs, store.schema).unionByName(store)


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage of one call per document; only German calls report a cost."""
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    called = spread(table, "doc_id").withColumn("tokens", tx.tokenize(F.col("text")))
    called = correction.correct_tokens(called, rewrites(), id_col="doc_id")
    prompt = tags.size_of(F.col("tokens"))
    completion = tags.size_of(F.col("corrected_tokens"))
    return called.select(
        F.col("doc_id").alias("call_id"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
        F.when(F.col("lang") == "de", (prompt + completion) * COST_PER_TOKEN).alias("cost"),
    )


def examples(spark: SparkSession, folder: str) -> DataFrame:
    """The worked pairs, and how often the table of documents uses their tokens."""
    pairs = examples_frame(spark)
    sought = pairs.select("ex_id", F.explode(F.array_distinct("tokens")).alias("token"))
    found = (
        tk.token_table(documents(spark, folder), id_col="doc_id")
        .groupBy("token")
        .agg(F.count("*").alias("_n"))
        .join(F.broadcast(sought), "token")
        .groupBy("ex_id")
        .agg(F.sum("_n").alias("_hits"))
    )
    return pairs.join(found, "ex_id", "left").select(
        "ex_id",
        tags.size_of(F.col("tokens")).alias("n_tokens"),
        tags.size_of(F.col("corrected")).alias("n_corrected"),
        F.coalesce("_hits", F.lit(0)).alias("corpus_hits"),
    )


def verbs_list(spark: SparkSession, folder: str) -> DataFrame:
    found = tags.verbs(F.col("words"))
    shown = F.transform(found, lambda w: F.concat_ws("/", w["word"], w["lemma"], w["upos"]))
    return _tagged(spark, folder).select("doc_id", F.array_join(shown, " ").alias("verbs"))


def verb_split(spark: SparkSession, folder: str) -> DataFrame:
    found = tags.verbs(F.col("words"), include_aux=True)
    return _tagged(spark, folder).withColumn("_verbs", found).select(
        "doc_id",
        tags.of_class(F.col("_verbs"), "VERB").alias("main_verbs"),
        tags.of_class(F.col("_verbs"), "AUX").alias("aux_verbs"),
    )


def tense_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = tags.verbs(F.col("words"), include_aux=True)
    counts = _tagged(spark, folder).withColumn("_verbs", found)
    return counts.select("doc_id", tags.tense_counts(F.col("_verbs")).alias("_c")).select("doc_id", "_c.*")


def _count(**options) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        count = tags.verb_count(F.col("words"), **options).alias("verb_count")
        return _tagged(spark, folder).select("doc_id", count)

    return query


def vocabulary_lexicon(spark: SparkSession, folder: str, **limits: int) -> Lexicon:
    """A lexicon that grows with the corpus: each form seen twice, its class by its length."""
    length = F.length("form") % 3
    upos = F.when(length == 0, "VERB").when(length == 1, "AUX").otherwise("NOUN")
    seen = casefold_vocab(spark, folder).where("n >= 2").select(
        F.lit("form").alias("kind"), "form", F.col("form").alias("lemma"), upos.alias("upos"),
        F.lit(None).cast("string").alias("tense"), F.lit(1).alias("priority"),
    )
    return Lexicon.from_frame(seen, contractions={}, **limits)


def _vocabulary_verbs(**limits: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        lexicon = vocabulary_lexicon(spark, folder, **limits)
        tagged = tag_texts(documents(spark, folder), lexicon, id_col="doc_id", verbs_only=True)
        return tagged.select("doc_id", tags.verb_count(F.col("words")).alias("verb_count"))

    return query


def highlight_verbs(spark: SparkSession, folder: str) -> DataFrame:
    marked = tags.highlight_verbs(F.col("text"), F.col("tokens"), F.col("words"))
    return _tagged(spark, folder).select("doc_id", marked.alias("highlighted"))


def highlight_words(spark: SparkSession, folder: str) -> DataFrame:
    marked = tags.highlight_words(F.col("words")).alias("highlighted")
    return _tagged(spark, folder, verbs_only=False).select("doc_id", marked)


def tense_markup(spark: SparkSession, folder: str) -> DataFrame:
    marked = tags.tense_markup(F.col("text"), F.col("tokens"), F.col("words"))
    return _tagged(spark, folder).select("doc_id", marked.alias("html"))


def process_frame(spark: SparkSession, folder: str) -> DataFrame:
    return plans.process_frame(documents(spark, folder), rewrites(), id_col="doc_id")


def process_texts(spark: SparkSession, folder: str) -> DataFrame:
    return plans.verb_counts(documents(spark, folder), rewrites(), id_col="doc_id")


def text_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder).select("doc_id", *plans.METRICS, "corrected", "highlighted")


def compare_first_last(spark: SparkSession, folder: str) -> DataFrame:
    version_id = F.concat_ws(":", "conv_id", "turn")
    versions = drop_blank(turns(spark, folder)).withColumn("version_id", version_id)
    measured = plans.text_metrics(versions, rewrites(), id_col="version_id")
    return plans.compare_first_last(measured, "conv_id", "turn")


QUERIES: dict[str, Query] = {
    "clean_text": _over_documents("out", tx.clean_text),
    "flatten_text": _over_documents("out", tx.flatten_text),
    "german_quotes": _over_documents("out", tx.german_quotes),
    "detokenize": _over_documents("out", lambda text: tx.detokenize(tx.tokenize(text))),
    "word_count": _over_documents("total_words", lambda text: tx.word_count(tx.tokenize(text))),
    "tokens": lambda s, f: tk.token_table(documents(s, f), id_col="doc_id"),
    "token_offsets": lambda s, f: tk.token_offsets(documents(s, f), id_col="doc_id"),
    "sentences": lambda s, f: tk.sentence_table(documents(s, f), id_col="doc_id").drop("tokens"),
    "mwt_words": lambda s, f: tk.expand_contractions(documents(s, f), id_col="doc_id"),
    "casefold_vocab": casefold_vocab,
    "drop_blank": drop_blank_lines,
    "correct_tokens": correct_tokens,
    "correct_spelling": correct_spelling,
    "correct_identity": correct_identity,
    "correct_whole_text": correct_whole_text,
    "correction_audit": correction_audit,
    "correction_edits": correction_edits,
    "rewrite_rules": rewrite_rules,
    "spelling_suggestions": _suggestions,
    "correct_unknown": correct_unknown,
    "answer_store": answer_store,
    "dedupe_requests": dedupe_requests,
    "usage_of_calls": usage_of_calls,
    "usage_totals": lambda s, f: us.usage_totals(usage(s, f)),
    "cost_info": lambda s, f: us.cost_info(usage(s, f)),
    "examples": examples,
    "tag_words": lambda s, f: word_table(_tagged(s, f, verbs_only=False), id_col="doc_id"),
    "count_verbs": _count(),
    "count_verbs_aux": _count(include_aux=True),
    "count_verbs_exclude": _count(include_aux=True, exclude=EXCLUDED),
    "count_verbs_broadcast": _vocabulary_verbs(inline_bytes=0),
    "count_verbs_shuffled": _vocabulary_verbs(inline_bytes=0, broadcast_bytes=0),
    "verbs_list": verbs_list,
    "verb_split": verb_split,
    "highlight_verbs": highlight_verbs,
    "highlight_words": highlight_words,
    "tense_counts": tense_counts,
    "tense_markup": tense_markup,
    "process_frame": process_frame,
    "process_texts": process_texts,
    "text_metrics": text_metrics,
    "compare_first_last": compare_first_last,
    "metrics_long": lambda s, f: plans.metrics_long(_named_metrics(s, f)),
    "metrics_csv": lambda s, f: metrics_rows(_named_metrics(s, f)),
    "original_vs_corrected": lambda s, f: plans.original_vs_corrected(_pairs(s, f), id_col="doc_id"),
    "report_sections": lambda s, f: plans.report_sections(_pairs(s, f), id_col="doc_id"),
}
