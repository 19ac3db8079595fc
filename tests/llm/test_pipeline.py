"""The pipeline against a brute-force version, and the queries' SQL."""

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries, toxicity

from .test_documents import by_rules
from .test_jaccard import brute as brute_groups
from .test_lines import brute_left


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 1500").limit(70)
    extra = [(9_000, "You are an idiot, you moron.", "en", "src0", 28), (9_001, "\n".join(["A line that many documents share, again."] + [f"Own line {k * 7919} with {k * 104729} several {k * 1299709} words" for k in range(1, 9)]), "en", "src0", 0), (9_002, "\n".join([f"Text {k * 15485863} in {k * 32452843} this {k * 49979687} one" for k in range(1, 9)] + ["A line that many documents share, again"]), "en", "src0", 0), (None, "no id at all", None, None, None), (9_003, None, "en", None, 0), (9_004, "", "en", "src0", 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = [now, now := spark.read.parquet(f"{tmp_path}/{name}")]
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    # toxicity
    before, after = map(texts, kept["toxicity"])
    g = toxicity.fit(spark.read.parquet(f"{tmp_path}/labels.parquet"), docs)
    assert after == {i: t for i, t in before.items() if by_rules(t, g)[0] < toxicity.THRESHOLD} and 9_000 not in after
    # lines
    before, after = map(texts, kept["line_dedup"])
    want = brute_left([(r.doc_id, r.text) for r in kept["line_dedup"][0].collect()])
    assert after == want and after[9_002] != before[9_002]
    # near duplicates
    before, after = map(texts, kept["near_duplicates"])
    dropped = {i for i, _ in brute_groups(list(before.items()))}
    assert after == {i: t for i, t in before.items() if i not in dropped}
    # packing
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(after)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, packed), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cursor.fetchall())
