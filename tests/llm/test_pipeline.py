import corpus_pipeline
from leadforge.llm.queries import QUERIES
from leadforge.llm.sql import SQL
from leadforge.llm.tables import materialise

from .conftest import ODD, prose
from .test_maps import items
from .test_models import labelled


def test_stages_work_on_what_the_one_before_kept(spark, docs_of, tmp_path):
    rows, labels = labelled(200)
    bench_rows, bench = items(spark)
    near = prose(900, 120)
    docs = docs_of([*rows, (1000, rows[1][1]), (1001, near), (1002, near + " tail"), (1003, prose(901, 50) + " " + bench_rows[2][1]),
                    *[(i + 5000 if i else None, t) for i, t in ODD]])
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string").write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "packing"]
    current, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = materialise(stage(spark, current, sf), f"test-{name}")
        assert current.columns == docs.columns
        kept.append([r["doc_id"] for r in current.collect()])
    toxic = {i for i, _, t, _ in labels if t}
    assert len(toxic & set(kept[0])) <= 4 and {1000, 1001, 1002, 1003} <= set(kept[0])
    assert 1000 not in kept[1] and 1 in kept[1] and {1001, 1002} <= set(kept[1]) and len(kept[1]) == len(set(kept[1]))
    assert 1002 not in kept[2] and 1001 in kept[2]
    assert 1003 not in kept[3] and set(kept[3]) == set(kept[2]) - {1003}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == set(kept[3])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
