import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from noticelake.llm import decontaminate
from noticelake.llm.common import read_table
from noticelake.llm.queries import QUERIES, SQL
from oracle import connect, difference
from pyspark.sql import functions as F
from test_similar import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs, left = read_table(spark, SF, "documents"), []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    start = {r["doc_id"] for r in read_table(spark, SF, "documents").collect()}
    assert left[0] <= start and left[1] <= left[0] and left[2] <= left[1] and left[3] <= left[2]
    known = read_table(spark, SF, "documents").where(f"doc_id in ({','.join(map(str, left[0]))})")
    assert left[1] == set(brute_groups([(r["doc_id"], r["text"]) for r in known.collect()]).values())
    single = known.where(f"doc_id in ({','.join(map(str, left[1]))})")
    leaks = decontaminate.contaminated_pairs(single, read_table(spark, SF, "benchmark"))
    assert left[2] == left[1] - {r["doc_id"] for r in leaks.collect()}
    copies = docs.count()
    assert corpus_pipeline.run(spark, SF).count() == copies


def test_queries_with_sql(spark):
    con = connect(SF)
    for name, sql in SQL.items():
        assert difference(QUERIES[name](spark, SF), con, sql) is None


def test_stages_on_empty_tables_and_further_columns(spark, docs, no_docs, tmp_path):
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, no_docs, SF)
        assert out.count() == 0
        assert name == "token_files" or out.columns == no_docs.columns
    extra = {c: F.lit(c) for c in ("row", "fp", "digest", "maybe", "c0", "mix_size", "mix_source", "mix_source_size", "mix_target", "mix_rate", "mix_copies", "score")}
    clashing = docs.withColumns(extra)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, clashing, SF)
        assert out.columns == clashing.columns, name
        assert out.where(" or ".join(f"{c} is null or {c} <> '{c}'" for c in extra)).isEmpty(), name
        assert out.count() > 0, name
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    read_table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
