"""The pipeline's stages, each judged on its own input, and the queries with SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from specgrid.llm import oracles, queries


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, data)
        docs = cp.Scratch(spark, "test").keep(docs)
        seen[name] = docs
        if name != cp.STAGES[-1][0]:
            assert docs.columns == cp.COLUMNS
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    last = seen[cp.STAGES[-1][0]]
    assert last.where("NOT decoded_ok").count() == 0
    assert last.count() == seen["mixing sources to target weights"].count()
    deduped = seen["MinHash near-dedup"]
    assert deduped.count() == deduped.select("doc_id").distinct().count()


def test_line_dedup_stage_keeps_clean_rows(spark, data):
    one = " ".join(f"a{i}" for i in range(80))
    docs = spark.createDataFrame([(1, one, "en", "s", 9), (2, one, "en", "s", 9), (3, "short", "en", "s", 5), (4, None, "en", "s", None), (5, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.line_dedup(spark, docs, data).collect()}
    assert got == {1: one, 3: "short", 4: None, 5: ""}


def test_mixing_stage_with_repeated_ids(spark, data):
    docs = spark.createDataFrame([(i % 7, f"w {i} " * (i + 1), "en", "ab"[i % 2], 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.mixing(spark, docs, data)
    assert got.columns == cp.COLUMNS and got.join(docs, ["doc_id", "text"], "left_anti").count() == 0


def brute_near_dedup(rows):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()

    rows = sorted({(r[0], r[1]): r for r in rows}.values(), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    sets, top = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    return [r for i, r in enumerate(rows) if top[i] == i]


def test_near_dedup_stage_rows(spark, data):
    text = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    near = text("a", 59) + " other"
    rows = [
        (1, text("a")), (2, near), (3, text("b")), (3, text("c")), (3, text("c")), (4, text("b")), (None, text("d")), (None, text("d")), (None, near), (None, text("e")),
        (None, text("e", 59) + " other"), (None, None), (5, ""), (6, ""), (5, None), (7, text("c")), (2, text("f")),
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    told = lambda df: sorted((tuple(r[c] for c in cp.COLUMNS) for r in df.collect()), key=repr)
    assert told(cp.near_dedup(spark, spark.createDataFrame(rows, kinds), data)) == sorted(brute_near_dedup(rows), key=repr)
    plain = [(i, *r[1:]) for i, r in enumerate(rows)]
    assert told(cp.near_dedup(spark, spark.createDataFrame(plain, kinds), data)) == sorted(brute_near_dedup(plain), key=repr)


def test_run_with_odd_rows(spark, data, tmp_path):
    once = " ".join(f"k{i}" for i in range(70))
    odd = [(None, None, None, None, None), (None, once, "en", "src0", 9), (900_001, once, "en", "src0", 9), (900_002, "", "en", None, 0), (900_003, "twice here", "en", "src1", 10), (900_003, "twice here", "en", "src1", 10), (900_004, None, "en", "src1", None)]
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*cp.COLUMNS)
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"copies": F.lit("x"), "row": F.lit(1.5), "predicted": F.lit("y")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path))
    rows = got.collect()
    assert rows and got.where("NOT decoded_ok").count() == 0
    ids = [r.doc_id for r in rows]
    assert not {900_002, 900_004} & set(ids)  # without words, so the mix never takes them
    assert ids.count(900_003) <= 2  # the repeated row counts once, and twice its size at most
    assert ids.count(None) + ids.count(900_001) <= 2  # the same passage stands in one document only
    assert set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    told = con.execute(oracles.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in told.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_empty_documents(spark, data, tmp_path):
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{data}/{t}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    for name, q in queries.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == (1 if name == "op9_chat" else 0)
