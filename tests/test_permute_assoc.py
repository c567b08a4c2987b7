import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from permscan.functions import chi2_tail
from permscan.operators import association, grid, permute


@pytest.fixture(scope="module")
def pheno(spark):
    rng = np.random.default_rng(3)
    data = [(f"s{i:03d}", float(v)) for i, v in enumerate(rng.normal(size=60))]
    return spark.createDataFrame(data, "sample string, phenotype double").cache()


@pytest.fixture(scope="module")
def presence(spark):
    rng = np.random.default_rng(4)
    data = [(f"v{v:02d}", f"s{i:03d}") for v in range(25) for i in range(60) if rng.random() < 0.02 * (v + 1)]
    data += [("all", f"s{i:03d}") for i in range(60)] + [("v00", "not a sample"), ("v01", "s000"), ("v01", "s000")]
    return spark.createDataFrame(data, "variant string, sample string").cache()


def vector(pheno):
    return [r.phenotype for r in pheno.orderBy("sample").collect()]


def test_numpy_permutations_equal_numpy(spark, pheno):
    got = permute.numpy_permutations(pheno, 8, seed=84).orderBy("perm_id", "sample").collect()
    for i in range(1, 9):
        drawn = [r.phenotype for r in got if r.perm_id == i]
        assert drawn == list(np.random.default_rng(84 + i).permutation(np.array(vector(pheno))))


def test_numpy_permutations_check_the_size(spark, pheno, monkeypatch):
    monkeypatch.setattr(permute, "VECTOR_SAMPLES", 10)
    with pytest.raises(permute.TooManySamples):
        permute.numpy_permutations(pheno, 1)


def test_keyed_permutations_do_not_depend_on_the_cut(spark, pheno):
    whole = rows(permute.keyed_permutations(pheno, 3))
    assert rows(permute.keyed_permutations(pheno, 3, rank_rows=2)) == whole
    for i in (1, 2, 3):
        assert sorted(v for p, _, v in whole if p == i) == sorted(vector(pheno))
    assert len({tuple(v for p, _, v in whole if p == i) for i in (1, 2, 3)}) == 3
    assert rows(permute.keyed_permutations(pheno, 3, seed=85)) != whole


def test_keyed_permutations_keep_repeated_samples(spark):
    twice = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "sample string, phenotype double")
    got = rows(permute.keyed_permutations(twice, 4))
    for i in range(1, 5):
        assert sorted(v for p, _, v in got if p == i) == [1.0, 2.0, 3.0]
        assert sorted(s for p, s, _ in got if p == i) == ["a", "a", "b"]


SMALL = grid.Blocks(samples=7, variants=4, perms=2, dense=3)


def sums_of(scan):
    return {(r.perm_id, r.variant): (r.k, r.t) for r in scan.sums.join(scan.variants, "variant_id").collect()}


def near(sums):
    """Sums whose last digits may depend on the order in which they were formed."""
    return {key: (k, pytest.approx(t, abs=1e-9)) for key, (k, t) in sums.items()}


def expected_sums(pheno, presence, drawn):
    """drawn: perm_id → values in the order of the samples."""
    at = {f"s{i:03d}": i for i in range(60)}
    held = {}
    for r in presence.collect():
        if r.sample in at:
            held.setdefault(r.variant, set()).add(at[r.sample])
    return {
        (perm, variant): (len(rows), pytest.approx(sum(values[i] for i in rows), abs=1e-9))
        for perm, values in drawn.items()
        for variant, rows in held.items()
    }


@pytest.mark.parametrize("size", [grid.Blocks(), SMALL])
def test_cells_add_up_to_the_sums(spark, pheno, presence, size):
    y = np.array(vector(pheno))
    drawn = {i: np.random.default_rng(84 + i).permutation(y) if i else y for i in range(6)}
    scan = association.scan_sums(presence, pheno, 5, method=permute.NUMPY, size=size)
    assert sums_of(scan) == expected_sums(pheno, presence, drawn)
    keyed = permute.keyed_permutations(pheno, 5)
    by_perm = {}
    for r in keyed.orderBy("perm_id", "sample").collect():
        by_perm.setdefault(r.perm_id, []).append(r.phenotype)
    given = sums_of(association.scan_sums(presence, pheno, 5, permuted=keyed, size=size))
    assert given == expected_sums(pheno, presence, by_perm)
    drawn_here = sums_of(association.scan_sums(presence, pheno, 5, size=size))
    assert {key: v for key, v in drawn_here.items() if key[0]} == near(given)
    plan = scan.sums._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_draws_are_made_once_per_set_of_samples(spark, pheno, presence, monkeypatch):
    made = []
    draw = permute.PermutationStore._draw
    monkeypatch.setattr(permute.PermutationStore, "_draw", lambda self, index, n: made.append(n) or draw(self, index, n))
    store = permute.PermutationStore(4, block=SMALL.samples)
    other = pheno.withColumn("phenotype", F.col("phenotype") * 2 + 1)
    first = sums_of(association.scan_sums(presence, pheno, 4, store=store, size=SMALL))
    second = sums_of(association.scan_sums(presence.where("variant < 'v09'"), pheno, 4, store=store, size=SMALL))
    third = sums_of(association.scan_sums(presence, other, 4, store=store, size=SMALL))
    assert made == [60] and first and second
    assert all(third[key] == (k, pytest.approx(2 * t + k)) for key, (k, t) in first.items())
    assert second == near({key: value for key, value in first.items() if key[1] < "v09"})
    association.scan_sums(presence, pheno.where("sample > 's004'"), 4, store=store, size=SMALL)
    assert made == [60, 55]
    draws = store.draws(permute.sample_index(pheno))
    assert draws.groupBy("perm_id", "block").count().where("count > 1").isEmpty()


def test_a_poisoned_permutation_does_not_stop_the_others(spark, pheno, presence):
    keyed = permute.keyed_permutations(pheno, 6)
    value = F.when((F.col("perm_id") == 2) & (F.col("sample") == "s011"), F.lit(None)).otherwise(F.col("phenotype"))
    odd = keyed.withColumn("phenotype", value).where("perm_id <> 3 or sample <> 's012'")
    twice = odd.where("perm_id = 5 and sample = 's001'")
    whole = sums_of(association.scan_sums(presence, pheno, 6, permuted=keyed, size=SMALL))
    scan = association.scan_sums(presence, pheno, 6, permuted=odd.union(twice), size=SMALL)
    errors = {r.perm_id: r.error for r in scan.outcomes.collect()}
    assert errors[1] is errors[4] is errors[6] is None
    assert errors[2].startswith("missing") and errors[3] == "59 phenotype values for 60 samples"
    assert errors[5].startswith("more than one")
    assert all(r.elapsed_seconds >= 0 for r in scan.outcomes.collect())
    assert sums_of(scan) == near({key: value for key, value in whole.items() if key[0] in (1, 4, 6)})


def test_an_error_in_one_cell_fails_its_permutations_only():
    cells = [grid._Cell(2, grid.Blocks(samples=2)) for _ in range(2)]
    for cell in cells:
        cell.add_values(0, np.array([7, 8]), [np.array([0, 1])] * 2, [np.array([1.0, 2.0]), np.array([3.0, 4.0])])
        cell.add_carriers(0, np.array([0]), np.array([1]), [np.array([1])])
    cells[1].broken = "ValueError: broken"
    good, bad = ([b.to_pylist() for b in cell.results()] for cell in cells)
    assert [(r["perm_id"], r["t"]) for r in good[0]] == [(7, 2.0), (8, 4.0)]
    assert [r["error"] for r in good[1]] == [None, None]
    assert len(bad) == 1 and [r["error"] for r in bad[0]] == ["ValueError: broken"] * 2


def test_scan_against_regression(spark, pheno, presence):
    scan = association.association_scan(
        presence, pheno, 2, min_af=0.05, max_af=0.95, method=permute.NUMPY
    ).collect()
    assert {r.variant for r in scan} >= {"v10", "v20"} and "all" not in {r.variant for r in scan}
    y0 = np.array(vector(pheno))
    names = [f"s{i:03d}" for i in range(60)]
    carried = {}
    for r in presence.collect():
        carried.setdefault(r.variant, set()).add(r.sample)
    for r in scan:
        y = y0 if r.perm_id == 0 else np.random.default_rng(84 + r.perm_id).permutation(y0)
        x = np.array([float(s in carried[r.variant]) for s in names])
        assert 0.05 <= r.af <= 0.95 and r.af == pytest.approx(x.mean())
        slope, intercept = np.polyfit(x, y, 1)
        rss = ((y - slope * x - intercept) ** 2).sum()
        assert r.beta == pytest.approx(slope, abs=1e-9)
        assert r.beta_std_err == pytest.approx(math.sqrt(rss / 58 / ((x - x.mean()) ** 2).sum()), abs=1e-9)
        assert r.lrt_stat == pytest.approx(60 * math.log(((y - y.mean()) ** 2).sum() / rss), abs=1e-8)


def test_keyed_draws_beyond_the_vector_size(spark, pheno, presence, monkeypatch):
    packed = association.association_scan(presence, pheno, 1, method=permute.NUMPY)
    observed = {r.variant: r.beta for r in packed.where("perm_id = 0").collect()}
    monkeypatch.setattr(permute, "VECTOR_SAMPLES", 10)
    with pytest.raises(permute.TooManySamples):
        association.association_scan(presence, pheno, 1, method=permute.NUMPY)
    keyed = association.association_scan(presence, pheno, 1)
    assert {r.variant: pytest.approx(r.beta) for r in keyed.where("perm_id = 0").collect()} == observed
    assert keyed.select("perm_id").distinct().count() == 2


@pytest.mark.parametrize("limit", [0, 1000])
def test_degenerate_variants(spark, pheno, presence, monkeypatch, limit):
    monkeypatch.setattr(permute, "VECTOR_SAMPLES", limit)
    names = spark.createDataFrame([("nobody",), ("all",), ("v10",)], "variant string")
    scan = association.association_scan(presence, pheno, 2, variants=names, min_af=0.0, max_af=1.0)
    got = {(r.variant, r.perm_id): r for r in scan.collect()}
    for name in ("nobody", "all"):
        for perm in range(3):
            r = got[(name, perm)]
            assert (r.beta, r.lrt_stat, r.notes) == (None, None, "pre-filtering-failed")
    assert got[("v10", 1)].notes == ""
    fits = spark.createDataFrame([(f"s{i}", float(i % 2)) for i in range(20)], "sample string, phenotype double")
    odd = spark.createDataFrame([("odd", f"s{i}") for i in range(1, 20, 2)], "variant string, sample string")
    r = association.association_scan(odd, fits, 0).first()
    assert (r.beta, r.notes) == (None, "perfectly-separable-data")


def test_result_rows(spark, pheno, presence):
    out = association.result_rows(association.association_scan(presence, pheno, 2))
    types = dict(out.dtypes)
    assert types["lrt_pvalue"] == "float" and types["notes"] == "string" and types["perm_id"] == "int"
    for r in out.collect():
        assert r.source_file == f"perm_{r.perm_id:04d}" and 0 <= r.lrt_pvalue <= 1
        assert r.beta == np.float32(float(f"{r.beta:.2E}"))


def test_chi2_tail(spark):
    values = [0.0, 0.5, 3.841458820694124, 50.0, 1400.0, *(0.01 * 1.13**i for i in range(95)), -1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    got = [r[0] for r in df.select(chi2_tail("x")).collect()]
    assert got[0] == 1.0 and got[2] == pytest.approx(0.05) and got[-1] is None
    assert got[4] == pytest.approx(math.erfc(math.sqrt(700)), rel=1e-12) and got[4] > 0
    for x, tail in zip(values[:-2], got):
        assert tail == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-12)
    assert got[-2] == 1.0
    assert "Python" not in df.select(chi2_tail("x"))._jdf.queryExecution().toString()
