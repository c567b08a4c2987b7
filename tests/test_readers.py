import math
import re
from pathlib import Path

import pytest
from conftest import line, rows, write_run
from pyspark.sql import functions as F

from permscan import tables
from permscan.functions import is_malformed, number, perm_id, perm_name, source_name, three_digits, variant_stem
from permscan.operators.ordering import row_index
from permscan.operators.traits import cell_counts, extract_trait, trait_columns, trait_of_cells, valid_counts
from permscan.schema import RAW_HEADER, RESULT, RESULT_COLUMNS
from permscan.sources import files, phenotypes, results, writers
from permscan.staging import stage


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("text", ["", "NA", "nan", "NaN", "#N/A", "null", None])
def test_missing_numbers_are_null_and_not_malformed(spark, text):
    assert one(spark, number, text) is None
    assert not one(spark, lambda c: is_malformed(c, number(c)), text)


@pytest.mark.parametrize("text", ["abc", "1d", "1.5f", "0x1p3", "1,5", "--1", "1e"])
def test_malformed_numbers(spark, text):
    assert one(spark, number, text) is None
    assert one(spark, lambda c: is_malformed(c, number(c)), text)


def test_number_forms(spark):
    assert one(spark, number, "1.00E-300") == 0.0
    assert one(spark, number, " 2 ") == 2.0
    assert one(spark, number, ".5") == 0.5
    assert one(spark, number, "-inf") == float("-inf")
    assert one(spark, number, "Infinity") == float("inf")
    assert one(spark, number, "1.23E-01") == pytest.approx(0.123, rel=1e-6)


def test_names(spark):
    assert one(spark, source_name, "file:/a/perm_0007.txt") == "perm_0007"
    assert one(spark, source_name, "file:/a/my%20run.v1.txt") == "my run.v1"
    assert one(spark, source_name, "file:/a+b/x+y.txt") == "x+y"
    assert one(spark, source_name, "file:/a/source_file=perm_0001/part-0.txt") == "perm_0001"
    assert one(spark, perm_id, "perm_10000") == 10000
    assert one(spark, perm_id, "observed") is None
    assert one(spark, variant_stem, "/x/unitigs.tab.gz") == "unitigs"
    names = spark.range(9999, 10002).select(perm_name(F.col("id")).alias("n"))
    assert [r.n for r in names.orderBy("n").collect()] == ["perm_10000", "perm_10001", "perm_9999"]


def test_three_digits(spark):
    values = spark.createDataFrame([(0.12345,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in values.select(three_digits(F.col("x"))).collect()] == ["1.23E-01", "", "", ""]


def test_typed_scan_matches_columns_by_name(spark, tmp_path):
    extra = [*RAW_HEADER[::-1], "lineage"]
    values = line("007", notes="a,b").split("\t")[::-1] + ["L1"]
    path = write_run(tmp_path / "r", {"perm_0001": ["\t".join(values)]}, header=extra)
    read = results.read_results(spark, path)
    row = read.first()
    assert (row.variant, row.notes, row.source_file, row.perm_id) == ("007", "a,b", "perm_0001", 1)
    assert [read.schema[c].dataType for c in RESULT_COLUMNS] == [f.dataType for f in RESULT]


def test_missing_column_is_an_error(spark, tmp_path):
    path = write_run(tmp_path / "r", {"perm_0001": ["A\t1"]}, header=["variant", "af"])
    with pytest.raises(ValueError, match="lrt_pvalue"):
        results.read_results(spark, path)


def test_empty_notes_and_quotes(spark, tmp_path):
    path = write_run(tmp_path / "r", {"a_1": [line("x"), line('"say ""hi"""')]})
    assert rows(results.read_results(spark, path), "variant", "notes") == [('say "hi"', ""), ("x", "")]


def test_read_column_and_file(spark, tmp_path):
    path = write_run(tmp_path / "r", {"perm_0001": [line("A"), line("B", lrt="")]})
    assert rows(results.read_column(spark, path, "lrt_pvalue")) == [(pytest.approx(0.2),), (None,)]
    with pytest.raises(ValueError, match="lrt-pvalue"):
        results.read_column(spark, path, "lrt-pvalue")
    assert results.read_file(spark, path).columns == RAW_HEADER
    assert dict(results.read_file(spark, path).dtypes)["beta"] == "double"


def test_read_column_prunes(spark, tmp_path, capsys):
    path = write_run(tmp_path / "r", {"perm_0001": [line("A")]})
    results.read_column(spark, path, "af").explain()
    assert "ReadSchema: struct<af:string>" in capsys.readouterr().out


def test_listing_is_sorted_and_flat(spark, tmp_path):
    path = write_run(tmp_path / "r", {n: [line("A")] for n in ("perm_1000", "perm_9999", "perm_10000")})
    (tmp_path / "r" / "deep").mkdir()
    (tmp_path / "r" / "deep" / "perm_1.txt").write_text("x")
    (tmp_path / "r" / "log.tsv").write_text("x")
    names = [r.source_file for r in files.list_result_files(spark, path).collect()]
    assert names == ["perm_1000", "perm_10000", "perm_9999"]
    assert [p.rsplit("/", 1)[1] for p in files.first_files(spark, path, 2)] == ["perm_1000.txt", "perm_10000.txt"]


def test_row_index_over_many_splits(spark, tmp_path):
    lines = [line(f"V{i:04d}") for i in range(400)]
    path = write_run(tmp_path / "r", {f"perm_{i:04d}": lines for i in range(1, 4)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        staged = stage(results.typed(results.scan_text(spark, path)), "t")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert staged.select("file_path", "block_start").distinct().count() > 20
    indexed = row_index(staged)
    expected = sorted((f"perm_{p:04d}", i, f"V{i:04d}") for p in range(1, 4) for i in range(400))
    assert sorted(map(tuple, indexed.select("source_file", "row_idx", "variant").collect())) == expected


MASTER = "ID\tT\tU\n" + "\n".join(
    f"{i}\t{t}\tx"
    for i, t in [
        ("s1", "1.5"), ("s2", " 2 "), ("s3", "NA"), ("s4", ""), ("s5", "abc"), ("s6", "inf"), ("s7", "1d"),
        ("s8", "1.5f"), ("s9", "0x1p3"), ("s10", "NaN"), ("", "3"), ("NA", "3"), ("s1", "7"),
    ]
)


def test_trait_extraction(spark, tmp_path):
    (tmp_path / "m.tsv").write_text(MASTER + "\n")
    master = phenotypes.read_master(spark, str(tmp_path / "m.tsv"))
    assert trait_columns(master) == ["T", "U"]
    got = rows(extract_trait(master, "T"))
    assert got == sorted([("s1", 1.5), ("s2", 2.0), ("s6", math.inf), ("s1", 7.0)], key=repr)
    # An id does not matter for the preview of valid values.
    assert rows(valid_counts(master)) == [("T", 6), ("U", 0)]
    with pytest.raises(ValueError, match="lacks the trait column 'Z'"):
        extract_trait(master, "Z")
    with pytest.raises(ValueError, match="lacks the ID column 'sample'"):
        extract_trait(master, "T", "sample")


def test_phenotype_round_trip(spark, tmp_path):
    pheno = spark.createDataFrame([("a", 1.5), ("b", -2.0)], "sample string, phenotype double")
    for header in (False, True):
        path = str(tmp_path / f"p{header}")
        writers.write_phenotype(pheno, path, header)
        assert rows(phenotypes.read_phenotype(spark, path, header)) == [("a", 1.5), ("b", -2.0)]
    assert next((tmp_path / "pTrue").glob("*.csv")).read_text().startswith("sample\tphenotype\n")


def test_presence_matrix(spark, tmp_path):
    (tmp_path / "p.Rtab").write_text("Gene\ts1\ts2\ts.3\ng1\t1\t0\t1\ng2\t0\t\t0\n")
    read = phenotypes.read_presence(spark, str(tmp_path / "p.Rtab"))
    assert rows(read) == sorted(
        [("g1", "s1", 1), ("g1", "s2", 0), ("g1", "s.3", 1), ("g2", "s1", 0), ("g2", "s2", 0), ("g2", "s.3", 0)], key=repr
    )


def test_presence_matrix_takes_any_number_of_samples(spark, tmp_path):
    samples = [f"s{i}" for i in range(25_000)]
    for part, names in enumerate((["g1"], ["g2", "g3"])):
        body = "".join(f"{name}\t" + "1\t0\t" * 12_499 + "1\t1\n" for name in names)
        (tmp_path / f"part{part}.Rtab").write_text('"Gene"\t' + "\t".join(samples) + "\n" + body)
    read = phenotypes.read_presence(spark, str(tmp_path))
    counted = read.groupBy("variant").agg(F.count_distinct("sample").alias("n"), F.sum("present").alias("held"))
    assert rows(counted) == [("g1", 25_000, 12_501), ("g2", 25_000, 12_501), ("g3", 25_000, 12_501)]


def test_master_cells_take_any_number_of_traits(spark, tmp_path):
    traits = [f"t{i}" for i in range(25_000)]
    body = "".join(f"{name}\t" + "\t".join("NA" if i % 5 == 0 else str(i) for i in range(25_000)) + "\n" for name in ("s1", "s2"))
    (tmp_path / "m.tsv").write_text("ID\t" + "\t".join(traits) + "\n" + body)
    cells = phenotypes.read_master_cells(spark, str(tmp_path / "m.tsv"))
    assert rows(trait_of_cells(cells, "t24999")) == [("s1", 24999.0), ("s2", 24999.0)]
    assert rows(trait_of_cells(cells, "t5")) == []
    assert rows(cell_counts(cells).groupBy("n_valid").count()) == [(0, 5000), (2, 20_000)]


def test_master_cells_equal_the_wide_form(spark, tmp_path):
    (tmp_path / "m.tsv").write_text(MASTER + "\n")
    cells = phenotypes.read_master_cells(spark, str(tmp_path / "m.tsv"))
    master = phenotypes.read_master(spark, str(tmp_path / "m.tsv"))
    assert rows(trait_of_cells(cells, "T")) == rows(extract_trait(master, "T"))
    assert rows(cell_counts(cells)) == rows(valid_counts(master))


def test_presence_matrix_with_ragged_lines_and_inner_id(spark, tmp_path):
    (tmp_path / "p.Rtab").write_text('s1\t"Gene"\ts2\r\n1\t"g1"\r\n\r\n\tg2\t1\t1\r\n0\t\t1\r\n')
    read = phenotypes.read_presence(spark, str(tmp_path / "p.Rtab"), "Gene")
    assert rows(read) == sorted(
        [("g1", "s1", 1), ("g1", "s2", 0), ("g2", "s1", 0), ("g2", "s2", 1), (None, "s1", 0), (None, "s2", 1)], key=repr
    )
    with pytest.raises(ValueError, match="lacks the id column"):
        phenotypes.read_presence(spark, str(tmp_path / "p.Rtab"), "Other")


def test_row_numbers_need_no_shuffle_of_lines(spark, tmp_path):
    write_run(tmp_path, {"perm_0001": [line("a"), line("b")], "perm_0002": [line("a"), line("b")]})
    lines = stage(results.typed(results.scan_text(spark, str(tmp_path))), "lines")
    plan = row_index(lines)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_result_text_from_placed_rows(spark, tmp_path, monkeypatch):
    """Rows are placed before the runs multiply them; the text is that of rows ranged afterwards, in the same order."""
    parts = spark.range(500).select(((F.col("id") * 77) % 500).alias("p_partkey"), F.concat(F.lit("n"), "id").alias("p_name"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(tables, "PARTS_PER_FILE", 100)
    placed = tables.placed_result_rows(spark, str(tmp_path))
    exchanges = re.findall(r"Exchange (\w+\(\w+)", placed._jdf.queryExecution().executedPlan().toString())
    assert set(exchanges) == {"rangepartitioning(p_partkey"}

    def lines(folder):
        files = sorted(Path(folder).glob("source_file=*/*.txt"))
        runs = {}
        for file in files:
            runs.setdefault(file.parent.name, []).extend(file.read_text().splitlines()[1:])
        return runs, len(files)

    writers.write_result_text(placed, f"{tmp_path}/placed", placed=True)
    writers.write_result_text(tables.result_rows(spark, str(tmp_path)), f"{tmp_path}/ranged")
    runs, n_files = lines(f"{tmp_path}/placed")
    assert runs == lines(f"{tmp_path}/ranged")[0]
    assert len(runs) == tables.RUNS and all(len(run) == 500 for run in runs.values())
    assert n_files > 2 * tables.RUNS
