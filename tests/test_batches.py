"""Words and n-grams of Arrow batches against plain versions, and plans that must not grow faster than the input."""

from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasemill import batches, model, queries
from phrasemill.operators import counting
from phrasemill.sources import export

LETTERS = [*"aBéßİΣ \t\r\f\x0b\n.,(!漢", "\xa0", " ", "😀"]


def plain(text):
    spaced = [re.sub(r"([.,;:!?()])", r" \1 ", line) for line in text.split("\n")]
    return [[x for x in re.split(r"[ \t\r\f\x0b]+", line) if x] for line in spaced]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lists_of(spark, lists):
    return spark.createDataFrame([(k, 0, "c", [(w, w, "N") for w in x]) for k, x in enumerate(lists)], "doc_id long, sent long, corpus string, words array<struct<surface:string,lemma:string,pos:string>>")


def test_cut_equals_a_plain_version():
    r = random.Random(1)
    for n in (0, 1, 5, 100):
        for _ in range(30):
            texts = ["".join(r.choices(LETTERS, k=r.randint(0, 12))) for _ in range(n)]
            words, at, text, sent = batches.cut(pa.array(["x y", *texts], pa.string()).slice(1))
            w = words.to_pylist()
            assert [w[at[i] : at[i + 1]] for i in range(len(at) - 1)] == [line for x in texts for line in plain(x)]
            assert [*zip(text, sent)] == [(i, j) for i, x in enumerate(texts) for j, _ in enumerate(x.split("\n"))]


def test_sentences_have_words_and_tags(spark):
    docs = spark.createDataFrame([(1, "Of The İX, (running)\n\nquickly", "a"), (2, None, "b"), (3, "", None)], "doc_id long, text string, lang string")
    got = {(x.doc_id, x.sent, x.corpus): [tuple(w) for w in x.words] for x in model.sentences(docs).collect()}
    assert got[1, 0, "a"][:2] == [("Of", "of", "P"), ("The", "the", "DT")] and got[1, 0, "a"][3:] == [(",", ",", "PCT"), ("(", "(", "PCT"), ("running", "running", "V"), (")", ")", "PCT")]
    assert got[1, 1, "a"] == [] and got[1, 2, "a"] == [("quickly", "quickly", "R")] and got[3, 0, None] == [] and len(got) == 4
    words = [*model.DETERMINERS, *model.PREPOSITIONS, *model.CONJUNCTIONS, *".,;:!?()", "sing", "bed", "only", "able", "porous", "x"]
    assert [x.t for x in spark.createDataFrame([(w,) for w in words], "w string").select(model.tag(F.col("w")).alias("t")).collect()] == [model.tag_of(w) for w in words]


def test_counts_of_runs_equal_plain_counts(spark):
    r = random.Random(2)
    lists = [r.choices(["a", "b", "c d", None], k=r.randint(0, 9)) for _ in range(60)]
    s = lists_of(spark, lists)
    want = Counter((n, " ".join(w for w in x[k : k + n] if w is not None)) for x in lists for n in (1, 2, 3) for k in range(len(x) - n + 1))
    got = counting.ngram_counts(s, 1, 3)
    assert {(x.n, x.ngram): x.cnt for x in got.collect()} == want
    # counted before the shuffle, in batches, with no row per run
    assert "MapInArrow" in plan(got) and "Generate" not in plan(got)


def test_pairs_are_joined_only_with_counts_that_are_asked_for(spark):
    s = lists_of(spark, [["a", "b", "a", "b"], ["b"]])
    assert [tuple(x) for x in counting.bigram_table(s).orderBy("w1").collect()] == [("a", "b", 2, 2, 3, 5), ("b", "a", 1, 3, 2, 5)]
    pairs = counting.bigram_table(s, counts=())
    assert "Join" not in plan(pairs) and {tuple(x) for x in pairs.collect()} == {("a", "b", 2), ("b", "a", 1)}


def test_contrast_counts_the_text_once(spark, sf):
    assert "documents" not in str(queries._source_freqs(spark, sf)[0].inputFiles())


def test_csv_is_written_by_all_tasks(spark, tmp_path):
    c = spark.range(40).repartition(4).select(F.col("id").alias("cand_id"), F.concat(F.lit("a b"), F.col("id").cast("string")).alias("ngram"), F.lit("x").alias("pos"), F.col("id").alias("corpus"), F.lit("").alias("occurs"), F.lit("").alias("sources"), F.lit(None).cast("long").alias("c1"))
    export.write_csv(c, str(tmp_path / "t"), ["corpus"], ["c1"])
    files = sorted(Path(tmp_path / "t").glob("part-*"))
    assert len(files) == 4 and all(f.read_text().startswith("id\tngram\t") for f in files)
    back = export.read_csv(spark, str(tmp_path / "t"))
    assert {(x.id, x.ngram, x.corpus, x.c1) for x in back.collect()} == {(k, f"a b{k}", str(k), None) for k in range(40)}


def test_units_are_found_without_a_shuffle_of_words(spark):
    from phrasemill.operators import annotating

    units = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"])], "cand_id long, lemmas array<string>")
    found = annotating.contiguous(lists_of(spark, [["a", "b", "a", "c", "b"]]), units, gaps=1)
    assert {(x.cand_id, *x.places) for x in found.collect()} == {(0, 0, 1), (0, 2, 4), (1, 0), (1, 2)}
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_occurrences_are_made_once_to_be_measured(spark, sf):
    assert not any("documents" in f for x in queries._gapped(spark, sf) for f in x.inputFiles())


def test_parts_of_windows_grow_with_the_texts(spark):
    from phrasemill.llm import passages

    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert passages._parts(spark, 0) == fixed and passages._parts(spark, 10_000_000_000) == 625
    docs = spark.createDataFrame([(1, "a " * 60)], "doc_id long, text string")
    assert passages.candidates(passages.links(docs, letters=100_000_000), letters=100_000_000).rdd.getNumPartitions() == 7


@pytest.mark.parametrize("fmt", ["conll", "pwac", "treetagger"])
def test_records_cut_by_column_equal_those_cut_by_row(fmt):
    from phrasemill.sources import columns, text

    r = random.Random(4)
    names, mark = text.COLUMNS[fmt], text.MARKS[fmt]
    cell = lambda n: str(r.choice([1, 2, 3])) if n == "id" and r.random() < 0.9 else r.choice(["a", "b c", mark, "${dollar}x${hash}", "1 2", ""])
    line = lambda: r.choice(["# note", "", "<s>", "bad\tline"]) if r.random() < 0.1 else "\t".join(cell(n) for n in names)
    values = ["\n".join(line() for _ in range(r.randint(0, 5))) for _ in range(300)]
    b = pa.RecordBatch.from_arrays([pa.array(["f"] * 300), pa.array([0] * 300), pa.array(range(300)), pa.array(values)], ["file", "block", "seq", "value"])
    got = {(x["seq"], x["part"]): (x["words"], x["occs"]) for o in columns.words_of(iter([b]), fmt, names, mark, None) for x in o.to_pylist()}
    assert got == {(k, p): (w, o) for k, v in enumerate(values) for p, w, o in columns._odd(v, fmt, names, mark, None)} and got


def test_column_formats_need_no_generated_rows(spark, tmp_path):
    from phrasemill.sources import text

    s = model.sentences(spark.createDataFrame([(1, "One two_three.\n\nfour $", "a")], "doc_id long, text string, lang string")).where(F.size("words") > 0)
    for fmt in text.COLUMNS:
        lines = text.write_columns(s, fmt)
        assert "MapInArrow" in plan(lines.select("value"))
        lines.select("value").write.text(str(tmp_path / fmt))
        back = text.read_columns(spark, str(tmp_path / fmt), fmt)
        assert sorted(w.surface for x in back.collect() for w in x.words) == sorted(["One", "two_three", ".", "four", "$"])
        assert "Generate" not in plan(back)


def test_matches_begin_where_the_relaxed_pattern_does():
    from phrasemill.plans import patterns

    r = random.Random(5)
    for x in (
        '<pat><w id="x" pos="D"/><w pos="N"/><w lemma="back:x.lemma"/></pat>', '<pat><pat id="x" repeat="{1,2}"><w pos="D"/></pat><w pos="N"/><backpat id="x"/></pat>', '<pat><w id="n" pos="N"/><w pos="D" syndep="dep:n"/></pat>',
        '<pat repeat="*"><w id="n" pos="N*"/><w><neg pos="D"/></w></pat>', '<pat><either><pat><w pos="N"/></pat><pat id="y"><w lemma="a"/><w/></pat></either><pat ignore="true" repeat="?"><w pos="D"/></pat><w pos="N"/></pat>',
    ):
        p = patterns.parse(x)[0]
        begins = patterns.Begins(p)
        for _ in range(200):
            ws = [{"surface": w, "lemma": w, "pos": r.choice("DN"), "syn": f"dep:{r.randint(0, 4)}"} for w in r.choices("ab", k=r.randint(0, 7))]
            for mode, over in (("All", True), ("Longest", True), ("Shortest", False)):
                assert patterns.matches(p, ws, mode, over, begins=begins) == patterns.matches(p, ws, mode, over)
    # most places are left out before the matcher walks them
    assert list(patterns.Begins(patterns.parse('<pat><w id="n" pos="N"/><w pos="D" syndep="dep:n"/></pat>')[0])([{"pos": p} for p in "NNDDN"])) == [1]
