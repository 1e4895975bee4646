"""Kept documents leave the quality stage without their lines above the limits."""

import random

import corpus_pipeline
from test_tables import connect, prose, tables

from tallyweave.llm import quality, registry as r

CLEANED_SQL = r""", gone_lines AS (SELECT k.r, k.key FROM k JOIN often o ON o.host IS NOT DISTINCT FROM k.host AND o.key = k.key JOIN hosts h ON h.host IS NOT DISTINCT FROM k.host
   WHERE o.n > 20 AND o.n > h.texts * 0.01::DOUBLE AND coalesce(doc_id, 9223372036854775807) > first),
 parts AS (SELECT r, pos, line, array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' ') AS key
   FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs)),
 stay AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS fresh FROM parts p WHERE NOT EXISTS (SELECT 1 FROM gone_lines g WHERE g.r = p.r AND g.key = p.key) GROUP BY r)
 SELECT j.doc_id, stay.fresh FROM judged j LEFT JOIN stay USING (r) WHERE NOT base_failed AND NOT depleted"""


def test_stage_equals_sql(spark, tmp_path):
    folder = tables(tmp_path, extra=True)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.quality_rules(spark, docs, folder)
    got = sorted(str((x.doc_id, x.text)) for x in out.collect())
    sql = f"WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source AS host, text FROM documents){r.QUALITY_SQL}{CLEANED_SQL}"
    assert out.columns == docs.columns and got == sorted(map(str, connect(folder).execute(sql).fetchall()))
    assert sum("NEWSLETTER" in x for x in got) == 1


def test_removed_words_are_those_of_the_text(spark):
    draw = random.Random(7)
    rows = [(i, f"{prose(draw, 20)}\n\n  Shared  LINE\tof all\n{prose(draw, 15)}\nshared line of all", host) for host in ("a", None) for i in range(25)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, source string")
    words = {(x._raw, x._host): x.n_words - x.removed_words for x in quality.judge(docs).where("kept").collect()}
    got = quality.cleaned(docs).collect()
    assert len(got) == 51 and all(len(x.text.split()) == words[x.doc_id, x.source] for x in got)
    assert {(x.doc_id, x.source) for x in got if "hared" in x.text} == {(0, "a"), (0, None)}
    assert quality.without_lines("a b\n\nA  B \nc\r\n", {quality.line_key("a b")[0]}) == "\nc\r\n"
