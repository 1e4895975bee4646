"""The pipeline's stages against brute force on one fixture."""

import zlib

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
from test_cleaned import CLEANED_SQL
from test_files import library
from test_tables import connect, tables

from tallyweave.llm import registry as r


def rows_of(folder, name):
    return pq.read_table(f"{folder}/{name}").to_pylist()


def test_stages(spark, tmp_path):
    folder = tables(tmp_path, extra=True)
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    con = connect(folder)
    con.execute("CREATE TABLE cur AS SELECT row_number() OVER () AS r, * FROM documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = columns or docs.columns
        out = f"{folder}/stage{k}"
        stage(spark, docs, folder).write.parquet(out)
        base = "WITH RECURSIVE docs AS (SELECT r, doc_id, source AS host, text FROM cur)"
        keep = {
            "quality rules": f"{base}{r.QUALITY_SQL} SELECT r FROM judged WHERE NOT base_failed AND NOT depleted",
            "near-duplicates": f"{base}{r.CLASSES_SQL} SELECT min_by(r, doc_id) FROM (SELECT r, doc_id, root FROM dr WHERE doc_id IS NOT NULL OR root NOT IN (SELECT root FROM dr WHERE doc_id IS NOT NULL)) GROUP BY root",
            "benchmark decontamination": f"{base}{r.HITS_SQL} SELECT r FROM found WHERE NOT contaminated",
        }.get(name)
        got = rows_of(folder, f"stage{k}")
        if keep:
            if name == "quality rules":  # kept documents go on without their lines above the limits
                fresh = CLEANED_SQL.replace("SELECT j.doc_id, stay.fresh", "SELECT j.r, stay.fresh")
                con.execute(f"CREATE TABLE next AS SELECT cur.* REPLACE (CASE WHEN text IS NULL THEN NULL ELSE f.fresh END AS text) FROM cur JOIN ({base}{r.QUALITY_SQL}{fresh}) f USING (r)")
            else:
                con.execute(f"CREATE TABLE next AS SELECT * FROM cur WHERE r IN ({keep})")
            con.execute("DROP TABLE cur")
            con.execute("ALTER TABLE next RENAME TO cur")
        elif name == "source mix":
            sql = rf"WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{r._WORD}')), 0)::BIGINT AS size FROM cur){r.MIX_SQL} SELECT doc_id, copies FROM mix"
            copies = con.execute(sql).fetchall()
            want = sorted(str(i) for i, n in copies for _ in range(n))
            assert sorted(str(x["doc_id"]) for x in got) == want and len(want) > 20
        if keep:
            assert list(got[0]) == columns
            want = con.execute("SELECT doc_id, text FROM cur").fetchall()
            assert sorted(map(str, ((x["doc_id"], x["text"]) for x in got))) == sorted(map(str, want)), name
        if k + 1 < len(corpus_pipeline.STAGES):
            docs = spark.read.parquet(out)
    t, start = library(), 0
    encoded = sorted(((x["doc_id"], t.encode(x["text"] or "", add_special_tokens=False).ids) for x in rows_of(folder, "stage3")), key=lambda x: (x[0] is None, x[0] or 0))
    sums = []
    for i, ids in encoded:
        data = np.array([*ids, 0], "<u4")
        sums.append((str(i), len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    got = sorted(got, key=lambda x: x["start"])
    assert sorted((str(x["doc_id"]), x["n_tokens"], x["ids_crc32"]) for x in got) == sorted(sums)
    assert [x["start"] for x in got] == [0, *np.cumsum([x["n_tokens"] for x in got])[:-1].tolist()] and start == got[-1]["start"] + got[-1]["n_tokens"]
    assert [x["doc_id"] is None for x in got] == sorted(x["doc_id"] is None for x in got)


def test_run_on_empty_tables(spark, tmp_path):
    folder = tables(tmp_path, extra=False, empty=True)
    assert corpus_pipeline.run(spark, folder).count() == 0
