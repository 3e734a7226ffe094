import duckdb

from parley.llm import linededup, queries

SCHEMA = "doc_id long, text string, n_lines string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], SCHEMA)


def test_recurring_templates_go_from_all_but_the_first_document(spark):
    texts = [(i, f"own line {chr(97 + i)}\nCopyright 20{10 + i} by someone\n\nend {chr(97 + i)}") for i in range(12)]
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert got[0].text == texts[0][1] and got[0].n_dropped == 0
    assert got[5].text == "own line f\n\nend f" and got[5].n_dropped == 1 and got[5].n_lines == 4


def test_a_leaf_generalises_places_that_vary(spark):
    texts = [(i, f"printed for the reader {name} on this very day\nunlike {name}") for i, name in enumerate("ann bob cyd dan eve fay gus hal ida jon kim".split())]
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 for i in range(1, 11))


NAMES = "ann bob cyd dan eve fay gus hal ida jon kim leo".split()


def test_two_templates_of_one_leaf_are_both_found(spark):
    first = [(i, f"printed for the reader {name} on this very day\nunlike {name}") for i, name in enumerate(NAMES)]
    other = [(20 + i, f"printed for the sake of {name} by nobody else\nunlike {name}") for i, name in enumerate(NAMES)]
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(docs_of(spark, first + other)).collect()}
    assert [i for i, r in got.items() if not r.n_dropped] == [0, 20] or {i for i, r in got.items() if not r.n_dropped} == {0, 20}


def test_many_lines_of_one_document_count_once(spark):
    lines = [f"printed for the reader {name} on this very day" for name in NAMES]
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(docs_of(spark, [(1, "\n".join(lines[:11])), (2, lines[11])])).collect()}
    assert got[1].n_dropped == got[2].n_dropped == 0


def test_passages_of_otherwise_different_documents_go_and_copies_stay(spark):
    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    own = {i: "\n".join(" ".join(f"{chr(97 + i)}{chr(97 + j)}{chr(97 + k)}" for k in range(24)) for j in range(4)) for i in range(6)}
    texts = [(1, f"{own[1]}\n{passage}"), (2, f"{passage}\n{own[2]}"), (3, f"{own[3]}\n{passage}\nend"), (4, own[4]), (5, f"{own[1]}\n{passage}\nlast line")]
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert got[1].text == texts[0][1] and got[2].text == own[2] and got[3].text == f"{own[3]}\nend" and got[4].n_dropped == 0
    assert got[5].text == texts[4][1]  # a near copy of 1: left to the search for near-duplicates
    short = " ".join(passage.split(" ")[:50])
    got = linededup.drop_recurring_lines(docs_of(spark, [(1, f"{own[1]}\n{short}"), (2, f"{short}\n{own[2]}")])).collect()
    assert all(r.n_dropped == 0 for r in got)


def test_odd_rows(spark):
    line = "the same line in all of them"
    texts = [(1, None), (2, ""), (3, "\n \n"), (None, line), (50, "x " * 100_000 + "\n" + line), (7, line), (7, line), *((i, line) for i in range(10, 20))]
    got = linededup.drop_recurring_lines(docs_of(spark, texts))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"] and got.count() == len(texts)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].text is None and by[1].n_lines == 0 and by[2].text == "" and by[3].text == "\n \n"
    assert by[7].text == line and by[12].text == "" and by[None].text == "" and by[50].n_dropped == 1
    assert linededup.drop_recurring_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    documents = duckdb.sql(f"SELECT * FROM '{sf_dir}/documents.parquet'")  # noqa: F841
    wanted = duckdb.sql(queries.OP3_SQL).fetchall()
    got = queries.op3_line_templates(spark, sf_dir).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_no_python_in_the_plan(spark):
    plan = linededup.drop_recurring_lines(docs_of(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
