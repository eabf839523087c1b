"""Sources and sinks: S1 to S8."""

import pytest
from pyspark.sql import functions as F

from satzwerk.functions import fixed
from satzwerk.operators.lexicon import Lexicon, seed_lexicon_rows, LEXICON_SCHEMA
from satzwerk.plans import metrics as plans
from satzwerk.sources import sinks
from satzwerk.sources.texts import drop_blank, read_text_files, read_text_pairs, texts_from_list
from satzwerk.streaming.metrics import read_text_stream, write_available

GERMAN = "Herr Jakob beobachtete den Brunnen. Die Männer ließen ihre Boote fahren.\n"


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def rows(frame):
    return [tuple(row) for row in frame.orderBy("text_id").collect()]


@pytest.mark.parametrize("name", ["a b.txt", "a+b.txt", "a%20b.txt", "ä[1].txt", "x{y}.txt"])
def test_listed_files_of_any_name(spark, tmp_path, name):
    put(tmp_path, "sub/other.txt", "no")
    path = put(tmp_path, name, "one\r\ntwo\rthree")
    assert rows(read_text_files(spark, [path])) == [(0, name, "one\ntwo\nthree")]


def test_listed_files_keep_their_order_and_repeats(spark, tmp_path):
    b, a = put(tmp_path, "b.txt", "b"), put(tmp_path, "a.txt", "a")
    dotted = str(tmp_path / "sub" / ".." / "a.txt")
    (tmp_path / "sub").mkdir()
    found = rows(read_text_files(spark, [b, dotted, f"file://{a}", b]))
    assert found == [(0, "b.txt", "b"), (1, "a.txt", "a"), (2, "a.txt", "a"), (3, "b.txt", "b")]


def test_a_missing_file_is_an_error(spark, tmp_path):
    path = put(tmp_path, "a.txt", "a")
    with pytest.raises(Exception, match="b.txt"):
        read_text_files(spark, [path, str(tmp_path / "b.txt")]).collect()


def test_no_files(spark):
    assert read_text_files(spark, []).collect() == []


def test_folder_gives_ids_and_equal_counts_for_every_lookup(spark, tmp_path):
    for number, text in enumerate([GERMAN, GERMAN, "Er baute es auf.", ""]):
        put(tmp_path, f"{number}.txt", text)
    files = read_text_files(spark, str(tmp_path))
    assert files.select("text_id").distinct().count() == files.count() == 3 + 1
    table = spark.createDataFrame(seed_lexicon_rows(), LEXICON_SCHEMA)
    results = []
    for limits in ({}, {"inline_bytes": 0}, {"inline_bytes": 0, "broadcast_bytes": 0}):
        lexicon = Lexicon.from_frame(table, **limits)
        done = plans.process_frame(files, None, lexicon)
        results.append(sorted((r.filename, r.corrected_text, r.verb_count) for r in done.collect()))
    assert results[0] == results[1] == results[2]
    assert [r[2] for r in results[0]] == [3, 3, 1, 0]


def test_repeated_and_missing_ids_keep_their_rows_in_every_lookup(spark):
    table = spark.createDataFrame(seed_lexicon_rows(), LEXICON_SCHEMA)
    rows = [(1, "Er baute."), (1, "Er baute es und spielt."), (None, "Er baute."), (None, None), (2, ""), (1, "Er baute."), (3, None)]
    texts = spark.createDataFrame(rows, "text_id bigint, text string").repartition(3)
    results = []
    for limits in ({}, {"inline_bytes": 0}, {"inline_bytes": 0, "broadcast_bytes": 0}):
        done = plans.process_frame(texts, None, Lexicon.from_frame(table, **limits))
        results.append(sorted((repr(r.original_text), r.corrected_text or "", r.verb_count) for r in done.collect()))
    assert results[0] == results[1] == results[2]
    assert [r[2] for r in results[0]] == [0, 2, 1, 1, 1, 0, 0]


def test_process_files_keeps_input_order(spark, tmp_path):
    paths = [put(tmp_path, f"{n}.txt", t) for n, t in (("z", "Er spielt."), ("a", GERMAN), ("m", "Der Hund."))]
    done = plans.process_files(spark, paths).collect()
    assert [(r.filename, r.verb_count) for r in done] == [("z.txt", 1), ("a.txt", 3), ("m.txt", 0)]
    assert done[1].original_text == GERMAN


def test_text_pairs_with_quotes_newlines_and_blanks(spark, tmp_path):
    path = put(tmp_path, "p.csv", 'text,llm\n"a ""q""\nb",ä\n,leer\n"😀, x",\n')
    found = read_text_pairs(spark, path).orderBy("row_idx").collect()
    assert [tuple(r) for r in found] == [(0, 'a "q"\nb', "ä"), (1, None, "leer"), (2, "😀, x", None)]


def test_text_pairs_number_across_files(spark, tmp_path):
    for name in "ba":
        put(tmp_path, f"{name}.csv", f"o,c\n{name}1,x\n{name}2,y\n")
    found = read_text_pairs(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.row_idx, r.original) for r in found] == [(0, "a1"), (1, "a2"), (2, "b1"), (3, "b2")]


def test_list_and_blank_slots(spark):
    texts = drop_blank(texts_from_list(spark, ["eins", " \n\u2003", " drei "]))
    assert rows(texts) == [(0, "Text 1", "eins"), (2, "Text 3", " drei ")]


def test_metrics_csv(spark, tmp_path):
    texts = texts_from_list(spark, ['Er "baute".', "Er ist da."])
    measured = plans.text_metrics(texts)
    out = tmp_path / "csv"
    assert sinks.write_metrics_csv(measured, str(out))
    data = b"".join(p.read_bytes() for p in sorted(out.glob("part-*")))
    lines = data.split(b"\r\n")
    assert lines[0] == b"Text,Total Words,Total Verbs,Main Verbs,Auxiliaries"
    assert [line.split(b",")[0] for line in lines[1:] if line and line != lines[0]] == [b"Text 1", b"Text 2"]
    assert not sinks.write_metrics_csv(measured.limit(1), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_write_corrected(spark, tmp_path):
    texts = texts_from_list(spark, ["a  😀 b", "c"])
    sinks.write_corrected(texts, lambda: str.upper, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, **sinks.CSV_FORMAT).orderBy("text_id")
    assert [r.llm_corrected_text for r in back.collect()] == ["A  B", "C"]


def test_report(spark, tmp_path):
    pairs = spark.createDataFrame([(0, "Er hieß <A>.", "Er heißt A."), (1, "x", "y")], "row_idx bigint, original string, corrected string")
    fragments = plans.report_sections(pairs)
    sinks.write_report(fragments, str(tmp_path / "page"))
    page = "".join(p.read_text() for p in sorted((tmp_path / "page").glob("part-*")))
    assert page.startswith(fixed.REPORT_HEADER) and page.rstrip("\n").endswith(fixed.REPORT_FOOTER.rstrip("\n"))
    first, second = page.index("Text: 1"), page.index("Text: 2")
    assert first < second and "'PAST': 1" in page[first:second]


def test_stream_names_files_like_the_batch(spark, tmp_path):
    put(tmp_path, "in/a b+c.txt", "Er baute.\r\n")
    stream = read_text_stream(spark, str(tmp_path / "in"))
    write_available(stream.withColumn("n", F.length("text")), str(tmp_path / "t"), str(tmp_path / "p")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("a b+c.txt", "Er baute.\n", 10)]
