"""No repeated line is left when documents are packed."""

import corpus_pipeline
from tessera.llm import lines


def test_no_repeated_line_reaches_packing(spark, tmp_path):
    own = [f"Own line {k * 7919} with {k * 104729} several {k * 1299709} words" for k in range(12)]
    passage = "\n".join(f"A passage {k * 15485863} that {k * 32452843} documents {k * 49979687} share" for k in range(3))
    rows = [
        (1, "\n".join(own[:3] * 4)),  # repeats its own lines
        (2, "\n".join([passage, *own[3:5], *(f"More {k * 86028121} of {k * 122949823} the {k * 141650939} second" for k in range(1, 9))])),
        (3, f"{passage}\n{own[5]}"),  # short, mostly a shared passage
        (4, "\n".join(own[6:])),
        (5, "\n".join(own[6:])),  # a copy, which the near duplicates must still see
        (6, passage.split("\n")[0]),  # nothing of its own
        (None, None),
    ]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert lines.repeats(docs).count() == 0
    left = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text for i, r in left.items()} == {1: "\n".join(own[:3]), 2: rows[1][1], 3: own[5], 4: rows[3][1], 6: "", None: None}
    assert left[3].n_chars == len(own[5])
