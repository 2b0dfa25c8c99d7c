import numpy as np
import pytest

from tabsieve.operators import neighbours as N


def tables(spark, seed, n, m, d):
    """Points with repeated rows: a third of the base is one point, some probes equal base points."""
    rng = np.random.default_rng(seed)
    base = np.round(rng.normal(size=(n, d)), 2)
    base[: n // 3] = base[0]
    probe = np.round(rng.normal(size=(m, d)) * 1.5, 2)
    probe[: m // 5] = base[rng.integers(0, n, m // 5)]
    cols = [f"c{k}" for k in range(d)]
    make = lambda x, at: spark.createDataFrame([(int(at + i), *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    return base, probe, make(base, 0), make(probe, 0), cols


@pytest.mark.parametrize("d", [1, 3, 12])
@pytest.mark.parametrize("most_held", [N.HELD, 60])
def test_nearest_and_within_by_brute_force(spark, d, most_held):
    base, probe, b, p, cols = tables(spark, d, 700, 400, d)
    full = N.distances(probe, base)
    got = {r.id: r.dist for r in N.nearest(p, b, "id", cols, most_held=most_held).collect()}
    assert [got[k] for k in range(len(probe))] == full.min(1).tolist()
    other = N.distances(base, base)
    np.fill_diagonal(other, np.inf)
    radius = other.min(1)
    got = {r.id: r.dist for r in N.nearest(b, b, "id", cols, others_only=True, most_held=most_held).collect()}
    assert [got[k] for k in range(len(base))] == radius.tolist()
    rows = spark.createDataFrame([(i, *map(float, x), float(r)) for i, (x, r) in enumerate(zip(base, radius))], "id long, " + ", ".join(f"{c} double" for c in cols) + ", r double")
    got = {r.id: r.flag for r in N.any_within(p, rows, "id", cols, "r", most_held=most_held).collect()}
    assert [got[k] for k in range(len(probe))] == (full < radius[None, :]).any(1).astype(int).tolist()


def test_empty_and_single(spark):
    _, _, b, p, cols = tables(spark, 1, 30, 5, 2)
    assert {r.dist for r in N.nearest(p, b.limit(0), "id", cols).collect()} == {None}
    one = b.where("id = 20")
    assert N.nearest(one, one, "id", cols, others_only=True).first().dist is None


def test_stream_against_many_fixed_rows(spark, tmp_path):
    from tabsieve.streaming import flag_batches, flag_stream

    base, probe, b, p, cols = tables(spark, 4, 300, 120, 2)
    radii = b.withColumnsRenamed({}).join(N.nearest(b, b, "id", cols, others_only=True), "id")
    want = {r.id: r.flag for r in N.any_within(p, radii, "id", cols, "dist").collect()}
    p.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError):
        flag_stream(stream, radii, "id", cols, most_held=5)
    q = flag_stream(stream, radii, "id", cols).writeStream.format("memory").queryName("flagged").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(120)
    assert {r.id: r.flag for r in spark.table("flagged").collect()} == want
    q = flag_batches(stream, radii, "id", cols, lambda t, k: t.write.mode("append").parquet(f"{tmp_path}/out"), most_held=5).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination(120)
    assert {r.id: r.flag for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
