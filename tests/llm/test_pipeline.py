import corpus_pipeline as cp
from pyspark.sql import functions as F

from turnloom.llm.queries import oracle_sql, queries


def test_stages_and_registration(spark, sf):
    import __spark_entry__ as e

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "simhash_dedup", "pii", "packing"]
    assert set(queries()) < set(e.queries()) and "pipeline" in e.queries()
    assert set(oracle_sql()) <= set(queries())


def test_stages_on_the_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == cp.COLUMNS, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] > 0
    left = {r.doc_id for r in docs.collect()}
    assert not any(labels[i].toxic or not labels[i].quality for i in left if i in labels)
    assert not docs.filter("text like '%@%.%'").filter("text rlike '[a-z0-9.]+@[a-z0-9]+[.]com'").count()
    packed = cp.pack(spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == left


def test_run_gives_what_the_stages_give(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    own = sorted((r.doc_id, r.piece, r.length) for r in cp.pack(spark, docs, sf).collect())
    assert own == sorted((r.doc_id, r.piece, r.length) for r in cp.run(spark, sf).collect())


def test_no_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_rows_that_share_ids_and_other_columns(spark, sf):
    """Repeated and null ids, null texts and columns with the names that stages use themselves."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 and toxic = 0")
    good = docs.join(labels, "doc_id").filter("lang = 'en'").orderBy(F.abs(F.col("n_chars") - 1500), "doc_id").first().text
    odd = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (1, "too few words", "en", "s", 1), (None, "The " + good, "en", None, None), (2, None, "en", "s", None)]
    both = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'x' as h", "1 as n", "'y' as base", "0 as row", "1 as k")
    passed = cp.keep_by_rules(spark, both, sf)
    assert passed.columns == cp.COLUMNS
    rows = [(r.doc_id, r.text) for r in passed.collect()]
    assert rows.count((1, good)) == 2 and rows.count((None, "The " + good)) == 1
    assert (1, "too few words") not in rows and not any(t is None for _, t in rows)
    clean = cp.sanitise(spark, both.filter("doc_id is null or doc_id in (1, 2)"), sf)
    texts = {r.doc_id: r.text for r in clean.filter("text is null").collect()}
    assert texts == {2: None} and sorted(r.doc_id or 0 for r in clean.collect()) == sorted(r.doc_id or 0 for r in both.collect() if r.doc_id in (None, 1, 2))


def test_run_leaves_only_what_its_result_needs(spark, sf, monkeypatch, tmp_path):
    from turnloom.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    assert cp.run(spark, sf).count() > 0
    left = {p.name.split("-")[1] for p in tmp_path.iterdir()}
    assert left == {"pii", "pieces"}
