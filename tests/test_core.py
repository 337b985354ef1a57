"""Small cases with known answers, and every query against its SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from phrasemill import model, queries
from phrasemill.functions import measures, words
from phrasemill.operators import agreement, annotating, casing, counting, filtering, numbering
from phrasemill.plans import patterns
from phrasemill.sources import convert, export, text, xml

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_association_known_values(spark):
    def all_of(o, c, n):
        df = spark.createDataFrame([(o, c, n)], "o long, c array<long>, n long")
        return df.select(*measures.association(F.col("o"), F.col("c"), F.col("n"))).first()

    r = all_of(1, [8, 5], 30623)
    assert [r.mle, r.pmi, r.t, r.dice, r.ll] == pytest.approx([3.26551938086e-05, 9.58044702114, 0.998693834902, 0.153846153846, 6.78729848938])
    r = all_of(1, [18, 1808, 47], 30623)
    assert [r.pmi, r.t, r.dice, r.ll] == pytest.approx([9.26005741805, 0.99836903382, 0.00160170848905, 0])
    r = all_of(9, [21, 10], 543804)
    assert [r.pmi, r.t, r.dice, r.ll] == pytest.approx([14.5084093745, 2.99987127739, 0.58064516129, 80.3358849639])


def test_case_classes(spark):
    forms = {"the": "lowercase", "THE": "UPPERCASE", "The": "Firstupper", "tHe": "MiXeD", "A-b": "MiXeD", "1Ab": "MiXeD", "42": "?"}
    got = {r.f: r.c for r in spark.createDataFrame([(f,) for f in forms], "f string").select("f", words.case_class(F.col("f")).alias("c")).collect()}
    assert got == forms


def sents_of(spark, tagged, doc=0):
    rows = [(doc, k, "c", [tuple(w) for w in s]) for k, s in enumerate(tagged)]
    return spark.createDataFrame(rows, "doc_id long, sent long, corpus string, words array<struct<surface:string,lemma:string,pos:string,syn:string>>")


def test_noun_compound_spans(spark):
    s = sents_of(spark, [[(w, w, "NN", None) for w in ("Hudson", "River", "school", "landscape")]])
    p = patterns.parse('<patterns><pat><pat repeat="+"><w pos="N*"/></pat><w pos="N*"/></pat></patterns>')
    modes = [("All", True), ("Longest", True), ("Longest", False), ("Shortest", True), ("Shortest", False)]
    assert [patterns.match(s, p, m, o).count() for m, o in modes] == [6, 3, 1, 3, 2]
    ws = [{"pos": "NN"}] * 4
    assert [len(patterns.matches(p[0], ws, m, o)) for m, o in modes] == [6, 3, 1, 3, 2]


def test_both_matchers_agree(spark):
    import random

    r = random.Random(3)
    tagged = [[(t, t, t, None) for t in r.choices(["N", "V", "DT", "A"], k=r.randint(0, 9))] for _ in range(40)]
    s = sents_of(spark, tagged)
    for x in ('<pat><w pos="DT"/><pat repeat="*"><w pos="A"/></pat><w pos="N"/></pat>', '<pat repeat="{2,3}"><either><pat><w pos="N"/></pat><pat><w pos="V"/><w pos="A"/></pat></either></pat>', '<pat anchor_end="true"><w><neg pos="V"/></w><w pos="N"/></pat>'):
        p = patterns.parse(x)[0]
        for mode in ("All", "Longest", "Shortest"):
            fast = {(y.sent, tuple(y.places)) for y in patterns.match(s, [p], mode).collect()}
            slow = {(k, m.places) for k, ws in enumerate(tagged) for m in patterns.matches(p, [{"pos": w[2]} for w in ws], mode)}
            assert fast == slow


def test_captures_and_dependencies(spark):
    s = [dict(surface="cat", lemma="cat", pos="N", syn="su:2"), dict(surface="sees", lemma="see", pos="V", syn="ROOT:0"), dict(surface="cat", lemma="cat", pos="N", syn="ob:2")]
    find = lambda x, **k: [m.places for m in patterns.matches(patterns.parse(x)[0], s, **k)]
    assert find('<pat><w id="a" pos="N"/><w/><w lemma="back:a.lemma"/></pat>') == [(0, 1, 2)]
    assert find('<pat><pat id="a"><w pos="N"/></pat><w/><backpat id="a"/></pat>') == [(0, 1, 2)]
    assert find('<pat><w id="v" pos="V"/><w syndep="ob:v"/></pat>') == [(1, 2)] and find('<pat><w id="v" pos="V"/><w syndep="su:v"/></pat>') == []
    assert find('<pat><w pos="N" syndep="su:v"/><w id="v"/></pat>') == [(0, 1)] and find('<pat><w syndep="x:v"/><w id="v"/></pat>') == []
    assert find('<pat><w id="a" pos="N"/><w id="b" pos="V"/></pat>', id_order=["b", "a"]) == [(1, 0)]
    assert find('<pat><w pos="V"/><pat ignore="true" repeat="?"><w/></pat></pat>') == [(1,), (1,)]
    with pytest.raises(ValueError):
        patterns.parse('<pat repeat="x"><w/></pat>')


def test_gap_annotation(spark):
    s = sents_of(spark, [[(w, w, "N", None) for w in "a x b".split()]])
    c = spark.createDataFrame([(1, ["a", "b"])], "cand_id long, lemmas array<string>")
    assert annotating.contiguous(s, c).count() == 0
    assert [r.places for r in annotating.contiguous(s, c, gaps=1).collect()] == [[0, 2]]


def test_measures_of_annotation(spark):
    p = spark.createDataFrame([(0, k, [1, 2, 3]) for k in range(3)], "doc_id long, sent long, places array<int>")
    r = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [1, 2])], "doc_id long, sent long, places array<int>")
    e = annotating.exact_match(p, r).first()
    assert (e.p_hit, e.p_all, e.r_hit, e.r_all) == (1, 3, 1, 2)
    e = annotating.link_based(p, r).first()
    assert (e.p_hit, e.p_all, e.r_hit, e.r_all) == (3, 6, 3, 3)


def test_precision_recall(spark):
    c = spark.range(26).select((F.col("id") < 20).alias("is_gold"))
    r = annotating.precision_recall(c, 1846).first()
    assert (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6)) == (0.769231, 0.010834, 0.021368)


def test_average_precision(spark):
    rows = [(1, 9.0, True), (2, 8.0, False), (3, 7.0, True), (4, None, True), (5, 6.0, None)]
    r = annotating.average_precision(spark.createDataFrame(rows, "id long, f double, y boolean"), "f", "y", ["id"]).first()
    assert r.tps == 2 and r.map == pytest.approx((100 + 200 / 3) / 2) and r.variance == pytest.approx((100 - 200 / 3) ** 2 / 2)


def test_agreement_of_perfect_raters(spark):
    r = spark.createDataFrame([(i, c, i % 3) for i in range(9) for c in "abc"], "item long, rater string, category long")
    assert all(x.ao == 1 and x.kappa == pytest.approx(1) and x.pi == pytest.approx(1) for x in agreement.pairwise(r).collect())
    m, w = agreement.multi(r).first(), agreement.multi_weighted(r, agreement.full_distances(r)).first()
    assert m.kappa == pytest.approx(1) and w.alpha == pytest.approx(1) and w.alpha_kappa == pytest.approx(1)


def test_filters_and_numbers(spark):
    df = spark.createDataFrame([(1, {"a": 3, "b": 1}), (2, {"a": 1}), (3, {})], "id long, freqs map<string,long>")
    ids = lambda c, **k: sorted(r.id for r in filtering.keep(df, c, **k).collect())
    assert ids(filtering.frequency_at_least(F.col("freqs"), 2)) == [3] and ids(filtering.frequency_at_least(F.col("freqs"), 2, "a")) == [1, 3]
    assert ids(filtering.frequency_at_least(F.col("freqs"), 2), reverse=True) == [1, 2] and ids(filtering.compare_frequency(F.col("freqs"), "eq", 1, "a")) == [2]
    n = numbering.numbered(spark.range(1000).withColumn("x", -F.col("id")), [F.col("x").asc()], "k")
    assert n.where("k <> 1000 - id").count() == 0
    assert [r.id for r in filtering.tail(spark.range(30), ["id"], 3).collect()] == [27, 28, 29]


def test_head_and_tail_part_a_table(spark):
    df = spark.range(25)
    assert {r.id for r in filtering.head(df, ["id"], 15).collect()} | {r.id for r in filtering.tail(df, ["id"], 10).collect()} == set(range(25))


def test_uniq_is_idempotent(spark):
    df = spark.createDataFrame([("a", None, 1, 5), ("a", None, 2, 3), ("b", "x", 3, 1)], "w string, p string, o long, f long")
    once = filtering.uniq(df, ["w", "p"], "o", ["f"])
    twice = filtering.uniq(once, ["w", "p"], "first", ["f"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str) and once.count() == 2


def test_formats_roundtrip(spark, tmp_path):
    s = sents_of(spark, [[("a_b", "a b", "N", "su:2"), ("$#", None, "V", "ROOT:0")], [("x|y", "<z>", "P", "m:1")]])
    for fmt in ("conll", "pwac", "treetagger"):
        p = str(tmp_path / fmt)
        text.write_columns(s, fmt).coalesce(1).select("value").write.text(p)
        got = [[(w.surface, w.lemma, w.pos) for w in r.words] for r in text.read_columns(spark, p, fmt).orderBy("sent").collect()]
        assert got == [[("a_b", "a b", "N"), ("$#", None, "V")], [("x|y", "<z>", "P")]]
    p = str(tmp_path / "xml")
    xml.write(xml.write_corpus(s), p, "corpus")
    assert sorted((w.surface, w.syn) for r in xml.read_corpus(spark, p).collect() for w in r.words) == [("$#", "ROOT:0"), ("a_b", "su:2"), ("x|y", "m:1")]
    p = str(tmp_path / "plain")
    (tmp_path / "plain").write_text("# note\nWhy give_up now\n")
    r = text.read_plain(spark, p).first()
    assert [w.surface for w in r.words] == ["Why", "give", "up", "now"] and r.occs == [[1, 2]]
    assert text.write_plain(text.read_plain(spark, p)).first().value == "Why give_up now"
    (tmp_path / "tagged").write_text('big <mwepart id="1">canning</mwepart> old <mwepart id="1,2">operation</mwepart>\n')
    r = text.read_tagged(spark, str(tmp_path / "tagged")).first()
    assert [w.surface for w in r.words] == ["big", "canning", "old", "operation"] and r.occs == [[1, 3], [3]]


SAMPLE = """<?xml version="1.0"?><candidates><meta><corpussize name="c" value="30623"/><metafeat name="x" type="real"/></meta>
<cand candid="1"><ngram><w lemma="análisis" pos="N"><freq name="c" value="18"/></w><w lemma="de" pos="P"><freq name="c" value="1808"/></w><freq name="c" value="1"/></ngram>
<occurs><ngram><w surface="análisis"/><w surface="de"/><freq name="c" value="1"/><sources ids="3:1,2"/></ngram></occurs><features><feat name="x" value="0.5"/></features></cand></candidates>"""


def test_xml_samples(spark, tmp_path):
    p = str(tmp_path / "c.xml")
    (tmp_path / "c.xml").write_text(SAMPLE)
    r = xml.read_candidates(spark, p).first()
    assert [w.lemma for w in r.words] == ["análisis", "de"] and r.freqs == {"c": 1} and [w["c"] for w in r.word_freqs] == [18, 1808] and r.features == {"x": "0.5"}
    assert r.occurs[0].sources == "3:1,2" and xml.read_meta(spark, p).where("kind = 'corpussize'").first().value == "30623"
    (tmp_path / "d.xml").write_text('<dict><entry entryid="7"><w lemma="give"/><w lemma="up"/></entry></dict>')
    r = xml.read_dict(spark, str(tmp_path / "d.xml")).first()
    assert r.entry_id == 7 and [w.lemma for w in r.words] == ["give", "up"]
    s = sents_of(spark, [[(str(k), None, None, None)] for k in range(5)], doc=3)
    xml.write(xml.write_corpus(s), str(tmp_path / "x"), "corpus")
    assert sorted((r.doc_id, r.sent, r.words[0].surface) for r in xml.read_corpus(spark, str(tmp_path / "x")).collect()) == [(3, k, str(k)) for k in range(5)]


def test_conll_breaks_and_units(spark, tmp_path):
    row = lambda i, w: f"{i}\t{w}" + "\t_" * 8
    (tmp_path / "c").write_text("\n".join([row(1, "a"), row("2 3", "give up"), row(1, "b"), row(2, "c"), "2\tbroken", row(3, "gone")]) + "\n\n" + row(1, "d") + "\n")
    got = text.read_columns(spark, str(tmp_path / "c"), "conll").orderBy("sent").collect()
    assert [[w.surface for w in r.words] for r in got] == [["a", "give", "up"], ["b", "c"], ["d"]] and got[0].occs == [[1, 2]]
    (tmp_path / "t").write_text("a\tX\ta\nodd\n.\tSENT\t.\nb\tX\t<unknown>\n</s>\n")
    split = lambda **k: [[w.surface for w in r.words] for r in text.read_columns(spark, str(tmp_path / "t"), "treetagger", **k).orderBy("sent").collect()]
    assert split() == [["a", ".", "b"]] and split(sent_tag="SENT") == [["a", "."], ["b"]]


def test_conversion_and_comments(spark, tmp_path):
    s = sents_of(spark, [[("a_b", "x", "N", None), ("c", "y", "V", None)]])
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    convert.write(s, a, "moses", ("made by hand",))
    assert convert.format_of(spark, a) == "moses" and convert.comments(spark, a).distinct().first().value == "made by hand"
    convert.convert(spark, a, b, "pwac")
    assert [w.surface for w in convert.read(spark, b).first().words] == ["a_b", "c"] and convert.comments(spark, b).distinct().count() == 1
    convert.write(s, str(tmp_path / "h"), "html")
    assert spark.read.text(str(tmp_path / "h")).where("value like '<!DOCTYPE%'").count() >= 1 and "a_b" in convert.show(s.select(F.col("words")[0]["surface"].alias("w")))
    with pytest.raises(ValueError):
        convert.write(s, a, "owl")


def test_csv_types(spark, tmp_path):
    (tmp_path / "c").write_text("id\tngram\tn\tr\te\ts\n" + "".join(f"{k}\tw${{space}}v\t{k}\t{k}.5\t{'ab'[k % 2]}\tt{k}\n" for k in range(40)))
    t = export.read_csv(spark, str(tmp_path / "c"))
    assert t.first().ngram == "w v" and export.types_of(t, ["n", "r", "e", "s"]) == {"n": "integer", "r": "real", "e": "{a,b}", "s": "string"}


def test_gold_options(spark):
    kind = "id long, words array<struct<surface:string,lemma:string,pos:string>>"
    cands = spark.createDataFrame([(1, [("Cats", "cat", "N")]), (2, [("cats", "Cat", "V")]), (3, [("dogs", "dog", "N")])], kind).withColumnRenamed("id", "cand_id")
    hit = lambda gold, **k: sorted(r.cand_id for r in annotating.gold_match_words(cands, spark.createDataFrame([(0, [g]) for g in gold], kind), **k).where("is_gold").collect())
    assert hit([(None, "cat", "N")]) == [1] and hit([(None, "cat", "N")], ignore_pos=True) == [1, 2] and hit([(None, "cat", "N")], ignore_case=False, ignore_pos=True) == [1]
    assert hit([(None, "dogs", None)]) == [] and hit([(None, "dogs", None)], cross=True) == [3]


def test_sub_sentence_and_groups(spark):
    s = sents_of(spark, [[("a", "a", "N", "su:2"), ("b", "b", "V", "ROOT:0"), (",", ",", "P", "x:2"), ("c", "c", "N", "ob:2;y:3")]])
    places = lambda *x: F.array(*map(F.lit, x))
    r = s.select(words.sub_sentence(F.col("words"), places(0, 1, 3), F.array(places(0, 3), places(1, 2))).alias("x")).first().x
    assert [(w.surface, w.syn) for w in r.words] == [("a", "su:2"), ("b", "ROOT:0"), ("c", "ob:2;y:0")] and r.occs == [[0, 2]]
    assert one(spark, words.groups(F.lit(5), F.array(places(1, 3), places(0, 1))).alias("g")).g == [[0, 1, 3], [2], [4]]


def test_whole_and_pattern_xml(spark):
    c = spark.createDataFrame([(1, [("a", "a", "A"), ("b", "b", "N")]), (2, [("a", "a", "A")])], "id long, words array<struct<surface:string,lemma:string,pos:string>>")
    plain = patterns.parse('<patterns><pat><w pos="V"/></pat><pat><w pos="A"/><w pos="N"/></pat></patterns>')
    assert [(r.id, r.pattern) for r in patterns.whole(c, plain).collect()] == [(1, 1)]
    gone = patterns.parse('<pat><w pos="A"/><pat ignore="true"><w pos="N"/></pat></pat>')
    assert [(r.id, [w.surface for w in r.matched]) for r in patterns.whole(c, gone).collect()] == [(1, ["a"])]
    for x in ('<pat><pat repeat="{2,3}" id="q"><w pos="N*"/></pat><either><w lemma="x"/><w><neg pos="P"/></w></either><backpat id="q"/></pat>', '<pat anchor_start="true"><w id="v"/><w syndep="ob:v"/></pat>'):
        assert patterns.parse(patterns.to_xml(patterns.parse(x))) == patterns.parse(x)


def test_localmaxs_against_brute_force(spark):
    import random

    from phrasemill.operators import localmaxs

    r = random.Random(5)
    lines = [r.choices("abcde", k=r.randint(0, 14)) for _ in range(25)] * 2
    s = sents_of(spark, [[(w, w, "N", None) for w in x] for x in lines])
    count = {}
    for x in lines:
        for n in range(1, 6):
            for k in range(len(x) - n + 1):
                count[tuple(x[k : k + n])] = count.get(tuple(x[k : k + n]), 0) + 1
    total = sum(len(x) for x in lines)
    glue = {g: (c / total) ** 2 if len(g) == 1 else c * c / (sum(count[g[:k]] * count[g[k:]] for k in range(1, len(g))) / (len(g) - 1)) for g, c in count.items()}
    want = set()
    for g, c in count.items():
        if 2 <= len(g) <= 4 and c >= 2:
            over = [v for h, v in glue.items() if len(h) == len(g) + 1 and g in (h[1:], h[:-1])]
            if glue[g] >= max(glue[g[1:]], glue[g[:-1]]) - 1e-12 and max(over, default=0) <= glue[g] + 1e-12:
                want.add((" ".join(g), c))
    assert {(x.ngram, x.cnt) for x in localmaxs.localmaxs(s, 2, 4).collect()} == want and want


def test_rating_tables(spark, tmp_path):
    (tmp_path / "r").write_text("item\tx\ty\nq\ta\tb\nr\ta\ta\n")
    t = agreement.read_ratings(spark, str(tmp_path / "r"), header=True, item_col=True)
    assert sorted(map(tuple, t.collect())) == [("q", "x", "a"), ("q", "y", "b"), ("r", "x", "a"), ("r", "y", "a")]


def test_counts_of_words_and_pairs(spark):
    s = sents_of(spark, [[(w, w, "N", None) for w in "a b a b c".split()]])
    c = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "a"]), (3, ["z"])], "cand_id long, words array<string>")
    got = {r.cand_id: (r.cnt, r.word_cnts, r.pair_cnts) for r in counting.lookup_all(c, s).collect()}
    assert got == {1: (1, [2, 2, 1], [2, 1]), 2: (1, [2, 2], [1]), 3: (0, [0], [])}
    assert [r.places for r in counting.found(s, ["a", "b"]).collect()] == [[0, 2]]


def test_a_session_on_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(RuntimeError):
        model.shared_dir(Session())


def test_zip_and_detection(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "one\ntwo")
    assert sorted(r.value for r in text.read_zip(spark, str(tmp_path / "a.zip")).collect()) == ["one", "two"]
    assert text.detect('# X: filetype="Moses"\n') == "moses" and text.detect("@relation x") == "arff" and text.detect("a|b|c|d e|f|g|h") == "moses" and text.detect("id\tl1\tl2\tf") == "ucs"


def test_entropy_and_preferred_forms(spark):
    assert one(spark, measures.entropy(F.array(F.lit(1), F.lit(1)), 2).alias("h")).h == pytest.approx(1)
    v = spark.createDataFrame([("The", 10, 9, "the", 0.2, 2), ("the", 8, 0, "the", 0.8, 2)], "form string, cnt long, cnt_start long, low string, pct double, forms long")
    assert {(r.form, r.place): r.new_form for r in casing.complex_case(v).collect()}[("The", "inside")] == "the"


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda x: "" if x is None or x != x else f"{float(x):.9g}" if not isinstance(x, str) else x
    return sorted(tuple(show(None if repr(x) == "<NA>" else x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, sf, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(queries.SQL[name]).df())


def test_the_rest_works_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "phrasemill", tmp_path / "phrasemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'ngram_assoc_top' in e.queries() and not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_the_rest_works_without_what_the_llm_folder_needs():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert 'wc' in e.queries() and 'pipeline' not in e.queries() and 'op7_toxicity' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_streaming_counts_equal_batch_counts(spark, sf, tmp_path):
    from phrasemill.streaming import counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.parquet").symlink_to(f"{sf}/documents.parquet")
    stream = counts.token_counts(counts.documents(spark, str(tmp_path / "in"), f"{sf}/documents.parquet"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("stream_counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.corpus, r.lemma): r.cnt for r in spark.table("stream_counts").collect()}
    want = {(r.corpus, r.lemma): r.cnt for r in counts.token_counts(model.table(spark, sf, "documents")).collect()}
    assert got == want and got
