"""The registered queries on whole small tables: against DuckDB where SQL can say it, and the pipeline stage by stage."""

import duckdb
import pytest

from tidemill.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert got == sorted(map(repr, con.execute(f"select {cols} from ({oracle_sql()[name]})").fetchall()))


def test_pipeline(spark):
    import corpus_pipeline as P
    from tidemill.llm.packing import pack
    from tidemill.llm.queries import tokenizer
    from tidemill.llm.store import Scratch

    scratch, sf = Scratch(spark, "test"), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf), name)
        assert docs.columns == P.COLUMNS
        now = [r.doc_id for r in docs.collect()]
        assert set(now) <= ids and len(now) == len(set(now)) and len(now) > 0.6 * len(ids)
        ids = set(now)
    want = sorted(map(tuple, pack(docs, tokenizer()).collect()))
    assert sorted(map(tuple, P.run(spark, sf).collect())) == want
    assert {r[0] for r in want} == ids


def test_documents_without_an_id_take_part_in_near_dedup(spark, frame):
    import corpus_pipeline as P

    texts = [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "h i j k l m n"), (None, "h i j k l m n"), (4, "o p q r s t"), (4, "u v w x y z"), (5, "u v w x y z")]
    rows = [(i, t, "en", "s", 13) for i, t in texts]
    got = P.near_dedup(spark, frame(rows, SCHEMA), "").collect()
    # Only copies go: what no other row has stays, with or without an id, and under a repeated one.
    assert sorted((r.doc_id or 0, r.text[0]) for r in got) == [(0, "h"), (1, "a"), (4, "o"), (4, "u")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "near_dedup"])
def test_stages_keep_what_is_clean_in_odd_tables(spark, frame, name):
    import corpus_pipeline as P

    stage = dict(P.STAGES)[name]
    sf = "/root/testdata/sf0.001"
    rows = [(None, "no id here at all", "en", "s", 1), (7, "one text of seven words or so", None, None, None), (7, "another text under the same old number", "en", "s", 1), (8, None, "en", "s", 0), (9, "", "en", "s", 0), (10, "long words " * 9000, "en", "s", 1)]
    got = stage(spark, frame([(*r, 5) for r in rows], SCHEMA + ", runs int"), sf)
    assert got.columns == P.COLUMNS
    want = rows if name != "line_dedup" else [r for r in rows if r[0] != 10]  # its repeated words go
    assert sorted((repr(r[0]), r[1] or "") for r in got.collect() if name != "line_dedup" or r[0] != 10) == sorted((repr(r[0]), r[1] or "") for r in want)
    assert stage(spark, frame([], SCHEMA), sf).collect() == []
