import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs
    return seen


def test_stages(spark):
    prose = [" ".join(f"{a}{b}{k % 7}the" for k in range(40)) for a in "abcd" for b in "efgh"]
    rows = [(i, t, "en") for i, t in enumerate(prose)]
    rows += [(100, None, "en"), (101, "12 34", "en"), (102, prose[3], "en"), (103, prose[4] + ' token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"', "en"), (103, prose[4] + ' token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"', "en")]
    seen = run(spark, rows)
    for name in list(seen)[:-1]:
        assert seen[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: sorted(r.doc_id for r in seen[name].select("doc_id").collect())
    assert ids("language") == [*range(16), 102, 103, 103]
    assert ids("near_duplicates") == [*range(16)] or ids("near_duplicates") == [*range(16), 103]
    assert seen["secrets"].where(F.contains("text", F.lit("9c8b4543"))).count() == 0
    assert sorted({r.doc_id for r in seen["pack"].collect()}) == ids("secrets")


def test_an_empty_table(spark):
    assert run(spark, [])["pack"].count() == 0


def test_odd_rows_and_clashing_columns(spark):
    """Each stage by itself: nulls in any column, repeated ids with different texts, other columns under clashing names."""
    prose = [" ".join(f"{a}{b}{k % 7}the" for k in range(40)) for a in "abcd" for b in "efgh"]
    rows = [(i, t, "en", None, None, i, 1.5, "x", "y") for i, t in enumerate(prose)]
    rows += [(3, prose[5] + " more of it", None, None, 7, 1, None, None, None), (3, prose[3], "en", "s", 9, None, 2.0, "p", "q"), (None, prose[7], "en", "s", 1, 1, 1.0, "x", "y"), (70, "", None, None, None, None, None, None, None), (71, None, None, None, None, None, None, None, None), (72, "12 34", "en", "s", 5, 1, 1.0, "x", "y"), (73, "word " * 50_000, "en", "s", 5, 1, 1.0, "x", "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, score double, lang_pred string, n_dropped string"
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language", "lines", "near_duplicates", "secrets"):
        assert stages[name](spark, docs, "").schema.names == docs.schema.names, name
    told = stages["language"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in told if r.doc_id is not None) == [0, 1, 2, 3, 3, 3, *range(4, 16), 73] and len(told) == 20
    assert {r.score for r in told} == {1.5, None, 2.0, 1.0} and all(r.lang == "en" for r in told)
    kept = stages["near_duplicates"](spark, docs, "").collect()
    threes = sorted(r.text for r in kept if r.doc_id == 3)
    assert threes == sorted({prose[3], prose[5] + " more of it"})
    assert {70, 71, None} <= {r.doc_id for r in kept}
    assert stages["language"](spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == len(told)
    assert stages["pack"](spark, docs, "").select("doc_id").distinct().count() == 21


INTERNAL = "_ _x x _row _rows _lines _drops _part _place _base _rank _n _node _component _c0 c0 row lines leaf template place size hash prints node part d0 path at number rank sequence_id offset step bits lang_pred score n_lines n_dropped _text".split()


def test_columns_of_any_name_and_maps_come_back(spark):
    """Every stage with a column under each name that the operators use themselves, and with a map."""
    line = "a common line of some length that recurs"
    rows = [(i, f"{line}\nown text {'abcdefghijklmnop'[i % 16]} of document number {i} with words enough to tell", "en", "s", 60, {"k": str(i)}, *[f"v{i}"] * len(INTERNAL)) for i in range(14)]
    rows += [(3, rows[3][1], "en", "s", 60, {"k": "z"}, *["w"] * len(INTERNAL))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tags map<string,string>, " + ", ".join(f"`{n}` string" for n in INTERNAL)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "")
        assert made.schema.names == docs.schema.names, name
        got = made.collect()
        assert len(got) == (14 if name == "near_duplicates" else 15), name
        for r in got:
            assert r.tags["k"] in (str(r.doc_id), "z") and {r[n] for n in INTERNAL} == ({"w"} if r.tags["k"] == "z" else {f"v{r.doc_id}"}), name
    assert corpus_pipeline.pack(spark, docs, "").count() == 15


def test_the_whole_run_against_its_parts_by_brute_force(spark):
    """The documents that stages keep on the smallest table, against plain rules for each stage."""
    import re

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept[name] = docs
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    rows = kept["language"].collect()
    assert {r.doc_id for r in kept["lines"].collect()} == {r.doc_id for r in rows if r.text and any(map(str.isalpha, r.text))}
    texts = {r.doc_id: r.text for r in kept["near_duplicates"].collect()}
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    assert {r.doc_id for r in kept["secrets"].collect()} == {i for i in sets if root(i) == i}
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in kept["secrets"].collect()}
