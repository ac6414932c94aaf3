import random
import statistics

import pytest
from pyspark.sql import functions as F

from foliolens.operators import inventory
from foliolens.schema import FILES
from foliolens.sources import files as sources, index


def record(dataset, name, pages=1, mb=0.0, text="t", error=None):
    full = dict.fromkeys(f.name for f in FILES.fields)
    full.update(dataset=dataset, filename=name, filepath=f"/data-set-{dataset}/{name}", error=error)
    if error is None:
        full.update(pages=pages, size_mb=mb, size_bytes=int(mb * 1048576), full_text=text,
                    text_length=len(text), word_count=len(text.split()), title="")
    return tuple(full[f.name] for f in FILES.fields)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([
        record(1, "a.pdf", 2, 0.25, "a\fb"), record(1, "b.pdf", 3, 0.29, ""),
        record(1, "c.pdf", error="broken"), record(3, "a.pdf", None, 1.5, "x" * 501)], FILES)


def test_rollups_count_error_rows_and_totals_do_not(files):
    got = {r.dataset: tuple(r)[1:] for r in inventory.dataset_rollup(files).collect()}
    assert got == {1: (3, 5, 0.54), 3: (1, 0, 1.5)}
    assert tuple(inventory.corpus_totals(files).first()) == (3, 5, 2.04)
    table = inventory.extraction_summary(files, 3).collect()
    assert sorted(map(tuple, table), key=str) == sorted(
        [(1, 3, 5, 0.54), (2, 0, 0, 0.0), (3, 1, 0, 1.5), (None, 3, 5, 2.04)], key=str)
    assert tuple(inventory.corpus_totals(files.limit(0)).first()) == (0, 0, 0.0)


def test_sizes_round_halves_to_even(spark):
    sizes = [5242, 5243, 15728, 15729, 131072, 393216, 10 ** 9]
    got = spark.createDataFrame([(s,) for s in sizes], "s bigint").select(sources.size_mb(F.col("s"))).collect()
    assert [r[0] for r in got] == [round(s / 1048576, 2) for s in sizes]


def test_index_rows(files):
    got = {(r.dataset, r.filename): (r.pages, list(r.page_offsets)) for r in sources.build_index(files).collect()}
    assert got == {(1, "a.pdf"): (2, [0, 2]), (1, "b.pdf"): (3, [0]), (3, "a.pdf"): (0, [0])}
    assert sorted(map(tuple, index.file_list(files).collect())) == [
        (1, "a.pdf", 2, 0.25, 2), (1, "b.pdf", 3, 0.29, 0), (3, "a.pdf", 0, 1.5, 1)]
    previews = {r.filename + str(r.dataset): r.text_preview for r in index.summary_rows(files).collect()}
    assert len(previews["a.pdf3"]) == 503 and previews["c.pdf1"] is None


@pytest.mark.parametrize("seed", range(4))
def test_describe_is_exact(spark, seed):
    rng = random.Random(seed)
    shapes = [lambda: rng.randint(0, 5), lambda: rng.randint(0, 10 ** 6), lambda: rng.choice([0, 0, 0, 10 ** 9]),
              lambda: rng.random()]
    values = [[float(shapes[seed]()), 7.0] for _ in range(rng.randint(2, 400))]
    df = spark.createDataFrame(values + [[None, None]], "a double, b double")
    got = {r["column"]: r for r in inventory.describe_corpus(df, ["a", "b"]).collect()}
    column = [v[0] for v in values]
    q = statistics.quantiles(column, n=4, method="inclusive")
    want = [len(column), statistics.mean(column), statistics.stdev(column), min(column), *q, max(column)]
    assert list(got["a"])[1:] == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert list(got["b"])[1:] == [len(column), 7, 0, 7, 7, 7, 7, 7]


def test_tables(spark):
    rows = [(1, "a", 1, "t", [[["c"]], [["d"]]]), (1, "a", 2, "t", []), (1, "b", 1, "t", None)]
    pages = spark.createDataFrame(rows, "dataset int, filename string, page_number int, text string, "
                                        "tables array<array<array<string>>>")
    got = {(r.filename, r.page_number): (r.table_count, r.has_tables) for r in inventory.page_tables(pages).collect()}
    assert got == {("a", 1): (2, True), ("a", 2): (0, False), ("b", 1): (0, False)}
    assert sorted(map(tuple, inventory.document_tables(pages).collect())) == [(1, "a", 2, 1), (1, "b", 0, 0)]


def test_validity(spark):
    rows = [(1, "a", b"%PDF-1"), (1, "b", b"<html>"), (2, "c", b""), (2, "d", None)]
    files = spark.createDataFrame(rows, "dataset int, filename string, content binary")
    assert sorted(map(tuple, inventory.validity_counts(files).collect())) == [(1, 1, 1), (2, 0, 2)]
    good, bad = inventory.quarantine(files)
    assert [r.filename for r in good.collect()] == ["a"]
    assert sorted(r.filename for r in bad.collect()) == ["b", "c", "d"]
    kinds = {r.filename: r.kind for r in inventory.sniff_content(files).collect()}
    assert kinds == {"a": "pdf", "b": "html", "c": "empty", "d": "empty"}


def test_archive_and_index_come_back_whole(spark, files, tmp_path):
    for part_bytes in (1024, 1 << 26):
        nested = index.nest_archive(files, "http://h", 4, part_bytes)
        back = index.archive_files(nested)
        assert sorted(map(str, back.select(files.columns).collect())) == sorted(map(str, files.collect()))
        heads = {r.dataset_number: (r.dataset_name, r.file_count, r.total_pages) for r in nested.collect()}
        assert heads == {1: ("data-set-1", 3, 5), 2: ("data-set-2", 0, 0), 3: ("data-set-3", 1, 0),
                         4: ("data-set-4", 0, 0)}
    names = [[f.filename for f in r.files] for r in nested.filter("dataset_number = 1").collect()]
    assert names == [["a.pdf", "b.pdf", "c.pdf"]]
    index.write_archive(files, str(tmp_path / "archive"), source="http://h")
    flat = index.flatten_archive(index.read_archive(spark, str(tmp_path / "archive")))
    want = sources.build_index(files)
    assert sorted(map(str, flat.collect())) == sorted(map(str, want.collect()))
    meta = spark.read.json(str(tmp_path / "archive/metadata")).first()
    assert (meta.total_datasets, meta.total_files, meta.total_pages) == (12, 3, 5)

    index.write_index(want, str(tmp_path / "index"))
    assert sorted(map(str, index.read_index(spark, str(tmp_path / "index")).select(want.columns).collect())) == \
        sorted(map(str, want.collect()))


def test_one_json_document(spark, tmp_path):
    (tmp_path / "index.json").write_text(
        '[{"dataset": 1, "filename": "a.pdf", "filepath": "/a.pdf", "pages": 2, "text": "a\\fb", '
        '"page_offsets": [0, 2]}, {"dataset": 2, "filename": "b.pdf", "text": "x"}]')
    rows = index.read_index(spark, str(tmp_path / "index.json"), "json_array").orderBy("dataset").collect()
    assert [(r.filename, r.pages, r.page_offsets) for r in rows] == [("a.pdf", 2, [0, 2]), ("b.pdf", None, None)]
    (tmp_path / "archive.json").write_text(
        '{"metadata": {"total_files": 1}, "datasets": [{"dataset_number": 1, "files": ['
        '{"filename": "a.pdf", "filepath": "/a.pdf", "pages": 2, "full_text": "a\\fb"}, '
        '{"filename": "c.pdf", "filepath": "/c.pdf", "error": "x"}]}, {"dataset_number": 2, "files": []}]}')
    flat = index.flatten_archive(index.read_archive_document(spark, str(tmp_path / "archive.json"))).collect()
    assert [(r.dataset, r.filename, r.pages, r.text) for r in flat] == [(1, "a.pdf", 2, "a\fb")]


def test_exports(spark, tmp_path):
    hits = spark.createDataFrame([(1, 'a "b".pdf', "/a", 3, 7, [])],
                                 "dataset int, filename string, filepath string, pages int, match_count int, "
                                 "contexts array<int>")

    def written(name):
        return "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))

    index.export_csv(hits, str(tmp_path / "c"))
    assert written("c").splitlines()[0] == "filename,dataset,pages,match_count"
    index.export_csv(hits.withColumn("filename", F.lit("a.pdf")), str(tmp_path / "q"), header=False, quote_all=True)
    assert written("q").strip() == '"a.pdf","1","7"'
    index.export_json(hits, str(tmp_path / "j"))
    assert written("j").strip() == '{"filename":"a \\"b\\".pdf","dataset":1,"pages":3,"match_count":7,"filepath":"/a"}'


def test_scan_files(spark, tmp_path):
    for name, body in (("data-set-1/a.pdf", b"%PDF-1"), ("data-set-1/b.txt", b"x"), ("data-set-10/a.pdf", b"<html>"),
                       ("other/c.pdf", b"%PDF-1")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body)
    scanned = sources.scan_files(spark, str(tmp_path))
    stats = sources.file_stats(scanned, str(tmp_path))
    assert sorted((r.dataset, r.filename, r.filepath, r.size_bytes) for r in stats.collect()) == [
        (1, "a.pdf", "/data-set-1/a.pdf", 6), (10, "a.pdf", "/data-set-10/a.pdf", 6)]
    assert "content" not in stats._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert sorted(map(tuple, inventory.validity_counts(scanned).collect())) == [(1, 1, 0), (10, 0, 1)]
    counts = sources.with_empty_datasets(stats).groupBy("dataset").agg(F.count("filename").alias("n")).collect()
    assert {r.dataset: r.n for r in counts} == {d: int(d in (1, 10)) for d in range(1, 13)}


def test_quartiles_with_one_outlier(spark):
    df = spark.range(5001).select((F.when(F.col("id") == 5000, 1e15).otherwise(F.col("id"))).alias("v"))
    got = inventory.describe_corpus(df, ["v"]).first()
    assert (got["count"], got.p25, got.p50, got.p75, got["max"]) == (5001, 1250.0, 2500.0, 3750.0, 1e15)


def test_records_need_no_join_and_keep_error_rows(spark):
    rows = spark.createDataFrame(
        [(1, "a.pdf", "/1/a.pdf", 10, 0.0, None, "x y", "Title: T\nPages: 3", None),
         (1, "a.pdf", "/2/a.pdf", 10, 0.0, None, "x", "Pages: 1", "broken")],
        "dataset int, filename string, filepath string, size_bytes bigint, size_mb double, modified_date timestamp, "
        "full_text string, raw string, error string")
    found = sources.records(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.filepath: (r.pages, r.title, r.word_count, r.error) for r in found.collect()}
    assert got == {"/1/a.pdf": (3, "T", 2, None), "/2/a.pdf": (None, None, None, "broken")}


def test_file_records(spark):
    stats = spark.createDataFrame([(1, n, "/" + n, 2048, 0.0, None) for n in ("a", "b", "c")],
                                  "dataset int, filename string, filepath string, size_bytes bigint, "
                                  "size_mb double, modified_date timestamp")
    texts = spark.createDataFrame([(1, "a", "one two", "Title: T\nPages: 4", None), (1, "b", None, None, "timeout")],
                                  "dataset int, filename string, full_text string, raw string, error string")
    got = {r.filename: r for r in sources.file_records(stats, texts).collect()}
    assert (got["a"].title, got["a"].pages, got["a"].word_count, got["a"].author) == ("T", 4, 2, "")
    assert (got["b"].error, got["b"].pages, got["b"].full_text) == ("timeout", None, None)
    assert (got["c"].pages, got["c"].full_text, got["c"].error) == (0, "", None)
