"""Spelling correction as a data job: table rewrites, batch backends, audit."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import partial, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from satzwerk.functions import fixed, text as tx
from satzwerk.operators.kept import kept
from satzwerk.operators.lexicon import Rewrites
from satzwerk.operators.reference import ReferenceTable, lookup_tokens
from satzwerk.operators.settled import settled
from satzwerk.operators.usage import USAGE_TYPE
from satzwerk.operators.workers import once_per_worker, worker_key


def _first_token(table: ReferenceTable) -> list[str]:
    """The first tokens of all rules of a small table."""
    return sorted({key.split(" ")[0] for key in table.rows})


def _windows(tokens: Column, n: int, starts: Callable[[Column], Column], *more: Column) -> Column:
    """At each place the ``n`` tokens from there on as one key, NULL where the text ends before.

    ``starts`` tests an entry of the tokens (``t0``) and ``more``; the places where no
    rule begins need no key.
    """
    moved = [F.slice(tokens, F.lit(k + 1), F.greatest(F.array_size(tokens) - k, F.lit(0))) for k in range(n)]

    def key(entry: Column) -> Column:
        parts = [entry[f"t{k}"] for k in range(n)]
        return F.when(starts(entry) & parts[-1].isNotNull(), F.concat_ws(" ", *parts))

    return F.transform(F.arrays_zip(*(part.alias(f"t{k}") for k, part in enumerate(moved)), *more), key)


def _of_length(n: int, key: Column) -> Column:
    """The key of a rule among those of all lengths."""
    return F.concat(F.lit(f"{n} "), key)


def _joined_rules(frame: DataFrame, tables: Mapping[int, ReferenceTable], tokens: str, keep: bool) -> DataFrame:
    """Add ``_rule{n}`` for rules of tables that need a join.

    The first tokens of all rules are looked up at first, with the lengths of the rules
    that begin so; only windows of these lengths are made there, and all of them are
    looked up together. The first look-up is planned twice, for the rows and for what they
    ask the second one, however many lengths there are; with ``keep`` it runs once, now,
    and what it moved is off the disk before the second one.
    """
    how = "shuffled" if any(table.how == "shuffled" for table in tables.values()) else "broadcast"
    if list(tables) == [1]:
        return lookup_tokens(frame, tokens, tables[1], "_rule1")
    begins = [
        table.frame.select(F.substring_index("key", " ", 1).alias("key"), F.lit(1 << place).alias("bit"))
        for place, table in enumerate(tables.values())
    ]
    first = reduce(DataFrame.unionAll, begins).groupBy("key").agg(F.bit_or("bit").alias("value"))
    frame = lookup_tokens(frame, tokens, ReferenceTable("bigint", how, frame=first), "_starts")
    windows, rules = [], []
    for place, (n, table) in enumerate(tables.items()):
        begun = F.col("_starts").alias("starts")
        keys = _windows(F.col(tokens), n, lambda entry, place=place: entry["starts"].bitwiseAND(1 << place) != 0, begun)
        windows.append(F.transform(keys, partial(_of_length, n)))
        rules.append(table.frame.select(_of_length(n, F.col("key")).alias("key"), "value"))
    frame = settled(frame, _keys=F.concat(*windows)).drop("_starts")
    frame = kept(frame, "rule-windows") if keep else frame
    together = ReferenceTable(rules[0].schema["value"].dataType.simpleString(), how, frame=reduce(DataFrame.unionAll, rules))
    frame = lookup_tokens(frame, "_keys", together, "_hits")
    size = F.array_size(tokens)
    parts = {f"_rule{n}": F.slice("_hits", size * place + 1, size) for place, n in enumerate(tables)}
    return frame.withColumns(parts).drop("_keys", "_hits")


def _chosen_rules(found: list[Column], lengths: list[int]) -> Column:
    """A sign for each token: the rule that starts there, ``-`` inside one, ``0`` without.

    Written as a string of signs of the longest rule at each place, the choice from
    left to right without overlap is one regular expression: each sign takes as many
    places as its rule has tokens.
    """
    signs = [chr(65 + place) for place in range(len(lengths))]
    longest_first = list(zip(signs, lengths, found, strict=True))[::-1]
    hits = F.arrays_zip(*(hit.alias(sign) for sign, _, hit in longest_first))

    def sign_of(hit: Column) -> Column:
        chosen = F.when(F.lit(False), "0")
        for sign, _, _ in longest_first:
            chosen = chosen.when(hit[sign].isNotNull(), sign)
        return chosen.otherwise("0")

    flags = F.array_join(F.transform(hits, sign_of), "")
    steps = "|".join(f"{sign}.{{{n - 1}}}" for sign, n, _ in longest_first)
    taken = F.regexp_extract_all(flags, F.lit(f"({steps}|.)"), F.lit(1))
    shown = F.transform(
        taken, lambda step: F.rpad(F.substring(step, 1, 1), F.length(step), "-")
    )
    return F.split(F.array_join(shown, ""), "")


def rewrite_tokens(frame: DataFrame, rewrites: Rewrites, tokens: str, out: str, keep: bool = False) -> DataFrame:
    """Replace tokens of an ARRAY<STRING> column by rules of any number of tokens.

    From left to right the longest rule that starts at a token counts, and the next
    one starts behind it. NULL stays NULL. ``keep`` writes the rows to the shared folder
    between the two look-ups of rules that need a join; otherwise only a plan is made.
    """
    lengths = sorted(rewrites.tables)
    if not lengths:
        return frame.withColumn(out, F.col(tokens))
    if len(lengths) > 57:
        raise ValueError("rules may have at most 57 different numbers of tokens")
    frame = settled(frame, **{tokens: F.col(tokens)})
    columns = [f"_rule{n}" for n in lengths]
    for n, column in zip(lengths, columns, strict=True):
        table = rewrites.tables[n]
        if table.how != "inline":
            continue
        if n == 1:
            frame = lookup_tokens(frame, tokens, table, column)
            continue
        first = _first_token(table)
        keys = _windows(F.col(tokens), n, lambda entry, first=first: entry["t0"].isin(*first))
        frame = lookup_tokens(settled(frame, _keys=keys), "_keys", table, column)
    joined = {n: rewrites.tables[n] for n in lengths if rewrites.tables[n].how != "inline"}
    if joined:
        frame = _joined_rules(frame, joined, tokens, keep)
    found = [F.col(column) for column in columns]
    entries = F.arrays_zip(F.col(tokens).alias("token"), *found, _chosen_rules(found, lengths).alias("sign"))

    def replaced(entry: Column) -> Column:
        chosen = F.when(entry["sign"] == "0", F.array(entry["token"]))
        for place, column in enumerate(columns):
            chosen = chosen.when(entry["sign"] == chr(65 + place), entry[column])
        return chosen.otherwise(F.array().cast("array<string>"))

    any_rule = F.exists(columns[0], _is_set)
    for column in columns[1:]:
        any_rule |= F.exists(column, _is_set)
    # The signs are only made for texts with a rule in them.
    result = F.when(any_rule, F.flatten(F.transform(entries, replaced))).otherwise(F.col(tokens))
    return frame.withColumn(out, result).drop("_keys", *columns)


def _is_set(value: Column) -> Column:
    return value.isNotNull()


def capitalise_starts(tokens: Column) -> Column:
    """A capital for the first token of the text and of each sentence."""

    def shown(token: Column, before: Column) -> Column:
        initial = F.substring(token, 1, 1)
        starts = before.isNull() | before.isin(*fixed.TERMINALS)
        raised = F.concat(F.upper(initial), F.substring(token, F.lit(2), F.length(token)))
        return F.when(starts & token.rlike(fixed.LOWER_INITIAL), raised).otherwise(token)

    return F.zip_with(tokens, tx.preceding(tokens), shown)


def final_period(tokens: Column) -> Column:
    """A full stop after a text that ends in a word."""
    last = F.get(tokens, F.array_size(tokens) - 1)
    return F.when(
        last.rlike(fixed.HAS_WORD_CHAR), F.concat(tokens, F.array(F.lit(".")))
    ).otherwise(tokens)


def correct_tokens(
    frame: DataFrame,
    rewrites: Rewrites | None = None,
    tokens: str = "tokens",
    out: str = "corrected_tokens",
    id_col: str | None = None,
    capitalise: bool = True,
    add_period: bool = True,
) -> DataFrame:
    """The table backend: rewrites, then sentence capitals, then a final period.

    ``id_col`` is not needed: rows may share an id or have none.
    """
    rewrites = Rewrites.from_rows() if rewrites is None else rewrites
    frame = rewrite_tokens(frame, rewrites, tokens, out)
    if capitalise:
        frame = frame.withColumn(out, capitalise_starts(F.col(out)))
    if add_period:
        frame = frame.withColumn(out, final_period(F.col(out)))
    return settled(frame, **{out: F.col(out)})


#: Rows of an Arrow batch that a backend takes at once, in bytes.
SLICE_BYTES = 4 << 20

Corrector = Callable[[list[str]], list[str]]
TextCorrector = Callable[[str], str]


class Answered(NamedTuple):
    """What a backend returns that also reports the usage of the call.

    ``usage`` may hold prompt_tokens, completion_tokens, total_tokens and cost.
    """

    value: list[str] | str
    usage: Mapping[str, float | None] | None = None


def identity_corrector() -> Corrector:
    """Builds a corrector that returns what it gets."""
    return list


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of about ``SLICE_BYTES``, so that few of them are Python objects at a time."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _apply_backend(
    frame: DataFrame, make_backend: Callable, column: str, out: str, on_error: str, with_usage: bool = False
) -> DataFrame:
    """Run a backend over one column in Arrow batches; adds ``out``, ``error`` and, if asked for, the usage."""
    if on_error not in ("column", "raise"):
        raise ValueError("on_error must be 'column' or 'raise'")
    kind = frame.schema[column].dataType
    is_array = isinstance(kind, ArrayType)
    reported = [(field.name, field.dataType) for field in StructType.fromDDL(USAGE_TYPE)] if with_usage else []
    added = [(out, kind), ("error", StringType()), *reported]
    schema = StructType([field for field in frame.schema.fields if field.name not in dict(added)])
    for name, type_ in added:
        schema = schema.add(name, type_)
    names = schema.fieldNames()

    def call(backend: Callable, value):
        usage: Mapping = {}
        if value is None:
            return None, None, *(None for _ in reported)
        try:
            answer, failed = backend(list(value) if is_array else value), None
            if isinstance(answer, Answered):
                answer, usage = answer.value, answer.usage or {}
            answer = list(answer) if is_array else answer
        except Exception as failure:
            if on_error == "raise":
                raise
            answer, failed = None, f"{type(failure).__name__}: {failure}"
        return answer, failed, *(usage.get(name) for name, _ in reported)

    key = worker_key()

    kinds = {field.name: field.type for field in to_arrow_schema(StructType([schema[name] for name, _ in added]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = once_per_worker(make_backend, key)
        for batch in batches:
            for part in slices(batch):
                results = [call(backend, value) for value in part.column(column).to_pylist()]
                made = {
                    name: pa.array([r[place] for r in results], kinds[name], from_pandas=True) for place, (name, _) in enumerate(added)
                }
                yield pa.RecordBatch.from_arrays([made[name] if name in made else part.column(name) for name in names], names=names)

    return frame.mapInArrow(run, schema)


def correct_with(
    frame: DataFrame,
    make_corrector: Callable[[], Corrector],
    tokens: str = "tokens",
    out: str = "corrected_tokens",
    on_error: str = "column",
    with_usage: bool = False,
) -> DataFrame:
    """Correct token lists with any callable, built once per Python worker.

    A failed call leaves NULL and its message in ``error``; with
    ``on_error="raise"`` it ends the job. ``with_usage`` adds what the call reports
    by ``Answered``: prompt_tokens, completion_tokens, total_tokens and cost, NULL
    where it reports nothing.
    """
    return _apply_backend(frame, make_corrector, tokens, out, on_error, with_usage)


def correct_whole_text(
    frame: DataFrame,
    make_corrector: Callable[[], TextCorrector],
    text: str = "text",
    out: str = "corrected",
    on_error: str = "column",
) -> DataFrame:
    """The older form: a whole text in, a whole text out, no tokens and no quotes."""
    return _apply_backend(frame, make_corrector, text, out, on_error)


def corrected_text(tokens: Column) -> Column:
    """Corrected tokens as a text with German quotes."""
    return tx.german_quotes(tx.detokenize(tokens))


def correct_spelling(
    frame: DataFrame,
    backend: Rewrites | Callable[[], Corrector] | None = None,
    source: str = "text",
    out: str = "corrected",
    id_col: str = "text_id",
    on_error: str = "column",
    answers_path: str | None = None,
) -> DataFrame:
    """Correct a STRING or ARRAY<STRING> column into a text.

    ``backend`` is a rewrite table (the default) or a function that builds a
    corrector; the latter is called once per distinct token list, and its answers
    are kept in the store under ``answers_path`` if that is given.
    """
    tokens = "_source_tokens"
    is_text = isinstance(frame.schema[source].dataType, StringType)
    if is_text:
        frame = settled(frame, **{tokens: tx.tokenize(F.col(source))})
    else:
        frame = frame.withColumn(tokens, F.col(source))
    if callable(backend):
        frame = correct_distinct(frame, backend, tokens, "_fixed", id_col, on_error, answers_path)
    else:
        frame = correct_tokens(frame, backend, tokens, "_fixed", id_col)
    return frame.withColumn(out, corrected_text(F.col("_fixed"))).drop(tokens, "_fixed")


def request_key(tokens: Column) -> Column:
    """Equal token lists have equal keys."""
    return F.sha2(F.to_json(tokens), 256)


def distinct_requests(frame: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row per distinct token list: key, tokens, n_texts.

    Copies are combined before the shuffle, however many there are.
    """
    # The list itself is the grouping key: a list carried by an aggregate would need a sort.
    counted = frame.where(F.col(tokens).isNotNull()).groupBy(tokens).agg(F.count("*").alias("n_texts"))
    return counted.select(request_key(F.col(tokens)).alias("key"), tokens, "n_texts")


def with_answers(
    frame: DataFrame, answers: DataFrame, tokens: str = "tokens", id_col: str = "text_id"
) -> DataFrame:
    """Join the answers to the texts of each request.

    Very frequent requests make skewed keys, which adaptive execution splits. Rows
    without tokens have no request; keys of their own keep them apart.
    """
    no_request = F.concat(F.lit("none "), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keyed = frame.withColumn("key", F.coalesce(request_key(F.col(tokens)), no_request))
    return keyed.join(answers, "key", "left").drop("key")


def correct_distinct(
    frame: DataFrame,
    make_corrector: Callable[[], Corrector],
    tokens: str = "tokens",
    out: str = "corrected_tokens",
    id_col: str = "text_id",
    on_error: str = "column",
    answers_path: str | None = None,
) -> DataFrame:
    """Call the backend once per distinct token list and join the answers back.

    With ``answers_path`` the calls are made now and kept in the store there, which
    later runs ask first. Without it this only makes a plan: fit for backends whose
    calls may be repeated.
    """
    if answers_path is not None:
        from satzwerk.operators.answers import correct_stored  # that module builds on this one

        return correct_stored(frame, make_corrector, answers_path, tokens, out, id_col, on_error)
    requests = distinct_requests(frame, tokens)
    answers = correct_with(requests, make_corrector, tokens, out, on_error).select("key", out, "error")
    return with_answers(frame, answers, tokens, id_col)


def correction_audit(before: Column, after: Column) -> Column:
    """What a correction did to a token list. Rules are flagged, not enforced.

    STRUCT<n_before, n_after, n_changed, n_deleted, n_inserted, flag_shorter,
    flag_deleted>; changed counts places, deleted and inserted distinct tokens.
    """

    def size(array: Column) -> Column:
        return F.array_size(array).cast("bigint")

    changed = F.filter(F.zip_with(before, after, lambda b, a: ~b.eqNullSafe(a)), lambda hit: hit)
    deleted = F.array_except(before, after)
    return F.struct(
        size(before).alias("n_before"),
        size(after).alias("n_after"),
        size(changed).alias("n_changed"),
        size(deleted).alias("n_deleted"),
        size(F.array_except(after, before)).alias("n_inserted"),
        (F.array_size(after) < F.array_size(before)).alias("flag_shorter"),
        (F.array_size(deleted) > 0).alias("flag_deleted"),
    )
