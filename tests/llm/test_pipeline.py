import corpus_pipeline
from tests.llm.data import SF, edge_docs
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_linededup import brute as lines
from tests.llm.test_neardup import brute as copies
from voxelyard.llm import linededup, quality


def test_stages_against_brute_force(spark):
    """Near copies: five-word shingles, similarity 0.8 (the contract of stages on word shingles)."""
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    left = {r.doc_id for r in quality.judge_quality(docs, labels).where("kept").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in left]
    cleaned = [(d, t) for d, t in map(eval, lines(rows, linededup.MIN_SITES, linededup.MIN_WORDS)) if t.strip(" ")]
    kept = {int(c) for _, c in copies(cleaned)}
    texts = [(d, t) for d, t in cleaned if d in kept]
    bad = {d for d, _ in leaks(texts, [(r.item_id, r.text) for r in items.collect()])}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert sorted({p.doc_id for p in pieces}) == sorted(d for d, _ in texts if d not in bad)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_on_edge_cases(spark):
    """Nulls in every column, texts without words, one very long, repeated rows and ids, clashing extra columns: the same columns come back, with a defined choice of rows."""
    docs = edge_docs(spark)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda x: (x is None, x))
    left = stages["quality_rules"](spark, docs, SF)
    assert left.dtypes == docs.dtypes and set(ids(left)) <= {6, 7, 8}  # the others have under 50 words
    cut = stages["line_dedup"](spark, docs, SF)
    assert cut.dtypes == docs.dtypes and ids(cut) == ids(docs)
    apart = stages["simhash_near_dedup"](spark, docs, SF)
    # 1 and 2 are alike but for case and repeats; 3, 4 and 5 have no word; 7 and 8 differ in one of many words; 9 and 10 are equal
    assert apart.dtypes == docs.dtypes and ids(apart) == [1, 3, 6, 7, 9, 11, 12, None]
    clean = stages["decontamination"](spark, docs, SF)
    assert clean.dtypes == docs.dtypes and ids(clean) == ids(docs)
    pieces = stages["packing"](spark, docs, SF).collect()
    assert sorted((p.doc_id is None, p.doc_id or 0) for p in pieces if p.start == 0) == sorted((d is None, d or 0) for d in ids(docs))


def test_stages_follow_each_other_on_edge_cases(spark, tmp_path):
    for rows, name in ((edge_docs(spark), "edge"), (edge_docs(spark).limit(0), "none")):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").limit(0 if name == "none" else 1000).write.parquet(f"{folder}/labels.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").limit(0 if name == "none" else 1000).write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {p.doc_id for p in got} <= {6, 7} and (name == "edge") == bool(got)
