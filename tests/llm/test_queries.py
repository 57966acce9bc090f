"""The registered queries of the package: SQL where there is some, else columns, keys and the pipeline by hand."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from daygrain.llm import line_dedup, packing, quality, queries, secret_scan, simhash
from daygrain.llm.sql import ORACLE
from tests.llm.data import ROWS
from tests.llm.test_dedup import components_by_hand, lines_by_hand
from tests.llm.test_tokens import check_packing
from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_simhash": {"doc_id", "fingerprint", "component_id"},
    "op3_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op4_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op6_vector_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op7_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op8_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op9_quality": {"doc_id", "held_out", "score", "predicted"},
    "op10_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op13_cross_tokenizer": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
}


def test_every_query_is_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) | set(COLUMNS) == set(queries.QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert compare(spark, con, queries.QUERIES[name], ORACLE[name], SF) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_a_row_for_every_input(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(got.columns)
    key, table = ("vec_id", "embeddings") if name.startswith("op6") else ("doc_id", "documents")
    ids = sorted(r[0] for r in got.select(key).distinct().collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


def test_pipeline_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        got[name] = docs.collect()
    assert [len(x) > 0 for x in got.values()] == [True] * 5
    quality_rows, line_rows, print_rows, clean_rows, packed_rows = got.values()
    # the classifier's decisions take effect, and only those
    scored = quality.classify(
        spark.createDataFrame(before, spark.read.parquet(f"{SF}/documents.parquet").schema),
        spark.read.parquet(f"{SF}/labels.parquet"),
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2,
    ).collect()
    assert {r.doc_id for r in quality_rows} == {r.doc_id for r in scored if r.score >= 0.7}
    expected = lines_by_hand([(r.doc_id, r.text) for r in quality_rows])
    assert {(r.doc_id, r.text) for r in line_rows} == {(i, t) for (i, _), t in expected.items()}
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in line_rows}
    left = {r.doc_id for r in print_rows}
    for i, p in prints.items():
        near = [j for j, q in prints.items() if ((p ^ q) % (1 << 64)).bit_count() <= 2]
        assert i in left or any(j < i for j in near)
    ratio = secret_scan.train(spark.createDataFrame([(r.text,) for r in print_rows], "text string"))
    table = secret_scan._symbol_table()
    by_id = {r.doc_id: r for r in clean_rows}
    assert set(by_id) == left
    for r in print_rows:
        spans = secret_scan.find_spans([r.text], ratio, table)[0]
        assert (by_id[r.doc_id].text == r.text) == (not spans)
        assert all(r.text[a:b] not in by_id[r.doc_id].text for a, _, b in spans)
        assert by_id[r.doc_id].n_chars == len(by_id[r.doc_id].text)
    assert {r.doc_id for r in packed_rows} == left
    assert [c for c in by_id[min(left)].__fields__] == list(corpus_pipeline.COLUMNS)


def test_pipeline_runs_and_keeps_nulls(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_pipeline_on_awkward_rows(spark, docs):
    """Nulls, ties, repeated rows, very long texts and clashing columns through all five stages."""
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, SF).collect()
    scored = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"), queries.fold(4) != 2).collect()
    assert sorted(str(tuple(r)) for r in kept) == sorted(str(tuple(r)[:5]) for r in scored if r.predicted == 1)
    # the later stages get all rows, so that none of the awkward ones is missing
    lines = stages["line dedup"](spark, docs, SF).cache()
    assert lines.columns == list(corpus_pipeline.COLUMNS)
    assert Counter(r.doc_id for r in lines.collect()) == Counter(r[0] for r in ROWS)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())
    one_each = stages["SimHash near-dedup"](spark, lines, SF).cache()
    rows = lines.collect()
    prints = [simhash.fingerprint(r.text) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if ((prints[i] ^ prints[j]) % (1 << 64)).bit_count() <= 2]
    root = components_by_hand(range(len(rows)), near)
    left = one_each.collect()
    assert len(left) == len({root[i] for i in range(len(rows))})
    least = {}
    for i, r in enumerate(rows):
        order = (r.doc_id is None, r.doc_id or 0)
        least[root[i]] = min(least.get(root[i], order), order)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted(least.values())
    # all rows again, as near copies have gone
    clean = stages["secret scans"](spark, lines, SF).cache()
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in ROWS)
    assert not any("3fdf5a35c7b8d733" in (r.text or "") for r in clean.collect())
    placed = stages["best-fit packing"](spark, clean, SF).collect()
    check_packing(placed, [(r.doc_id, r.text) for r in clean.collect()], 2048)


def test_plans_have_no_cross_join(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (line_dedup.dedup_lines(docs), simhash.drop_near_duplicates(docs), packing.pack_documents(docs, packing_path())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
