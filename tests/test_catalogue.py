"""Every registered query of the library against its SQL, and plans without products of tables."""

import itertools
import math

import pytest
from conftest import SF

from lumenframe.plans import files, tables  # noqa: F401
from lumenframe.plans.catalogue import ORACLES, QUERIES


def same(spark_rows, sql_rows):
    columns = sorted(sql_rows.columns)
    assert columns == sorted(spark_rows.columns)
    a = spark_rows[columns].sort_values(columns).reset_index(drop=True)
    b = sql_rows[columns].sort_values(columns).reset_index(drop=True)
    assert len(a) == len(b)
    b = b.astype(a.dtypes.to_dict())
    assert ((a == b) | (a.isna() & b.isna())).all(axis=None)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df.toPandas(), duck.sql(ORACLES[name]).df())
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["contains_join", "pairwise_suppression", "particles_join_items", "good_particles"])
def test_no_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    products = [x for x in plan.split("\n") if "Join Cross" in x or x.strip().endswith("Join Inner")]
    # the only product is that of the filter's statistics, one row
    assert len(products) <= (name == "good_particles")


def rows(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def sha(raw):
    import base64
    import hashlib

    return base64.b64encode(hashlib.sha1(raw).digest()).decode().rstrip("=").replace("/", "-").replace("+", "_")


def test_content_hashes(spark):
    """Orders' hashes over their lines in order, and pages' by root name and the first 512 KiB."""
    lines = {}
    for r in sorted(rows("lineitem"), key=lambda r: r["l_linenumber"]):
        lines.setdefault(r["l_orderkey"], []).append((r["l_linenumber"], str(r["l_partkey"])))
    found = {r["l_orderkey"]: r["hash"] for r in QUERIES["content_hash"](spark, SF).collect()}
    assert set(found) == set(lines)
    sole = [k for k, v in lines.items() if len({n for n, _ in v}) == len(v)]  # else the order of equal lines is open
    assert len(sole) > 100 and all(found[k] == sha("".join(p for _, p in lines[k]).encode("utf-16-le")) for k in sole)
    found = {r["page_id"]: r["hash"] for r in QUERIES["file_hashes"](spark, SF).collect()}
    for r in rows("pages"):
        base = r["url"].replace("\\", "/").rsplit("/", 1)[-1]
        root = base.rsplit(".", 1)[0] if "." in base else base
        assert found[r["page_id"]] == sha(root.encode("utf-16-le") + r["html"].encode()[: 512 * 1024])


def points():
    out = {}
    for r in rows("embeddings"):
        out.setdefault(r["vec_id"] // 64, []).append((r["vec_id"], [float(v) for v in r["embedding"][:3]]))
    return out


def test_density_peaks(spark):
    """Densities, distances and clusters of each image by plain loops."""
    found = {r["vec_id"]: r for r in QUERIES["density_peaks"](spark, SF).collect()}
    seen = 0
    for image in points().values():
        image.sort()
        gap = [[math.dist(p, q) for _, q in image] for _, p in image]
        density = [sum(d < 0.1 for d in g) - 1 for g in gap]
        order = sorted(range(len(image)), key=lambda i: (-density[i], i))
        cluster = {}
        for k, i in enumerate(order):
            near = min(order[:k], key=lambda j: gap[i][j]) if k else None
            distance = gap[i][near] if k else max(gap[i])
            cluster[i] = image[i][0] if density[i] >= 3 and distance >= 0.15 else cluster[near] if k else -1
            r = found[image[i][0]]
            assert (r["density"], r["cluster"]) == (density[i], cluster[i]) and r["distance"] == pytest.approx(distance)
            seen += 1
    assert seen == len(found)


def test_approximate_sets(spark):
    """Own, both and other by the pairs of least total distance, which no swap of two pairs shortens."""
    found = {r["vec_id"]: r["origin"] for r in QUERIES["approx_set_ops"](spark, SF).collect()}
    pairs = {}
    for r in QUERIES["optimal_match"](spark, SF).collect():
        pairs.setdefault(r["image"], []).append((r["own_id"], r["other_id"], r["distance"]))
    own, other = set(), set()
    for image, members in points().items():
        at = dict(members)
        p = pairs.get(image, [])
        assert len(p) == min(sum(i % 2 == 0 for i in at), sum(i % 2 for i in at))
        for a, b, d in p:
            assert d == pytest.approx(math.dist(at[a], at[b]), abs=1e-6)
            if d <= 0.1 + 1e-6:
                own.add(a)
                other.add(b)
        for (a, b, d), (e, f, g) in itertools.combinations(p, 2):
            assert d + g <= math.dist(at[a], at[f]) + math.dist(at[e], at[b]) + 1e-9
    every = {i for members in points().values() for i, _ in members}
    assert found == {i: "both" if i in own else "own" if i % 2 == 0 else "other" for i in every if i not in other}


def test_resampled_curves(spark):
    """Curves go through their nodes and never leave the range of the two nodes beside a point."""
    nodes = {}
    for r in rows("lineitem"):
        nodes.setdefault(r["l_orderkey"], {}).setdefault(float(r["l_linenumber"]), set()).add(float(r["l_quantity"]))
    found = QUERIES["resample_curves"](spark, SF).collect()
    assert len(found) == 2 * len(rows("lineitem"))
    for r in found:
        own = nodes[r["l_orderkey"]]
        if any(len(v) > 1 for v in own.values()):
            continue  # which of two nodes at one place counts is open
        y = {x: next(iter(v)) for x, v in own.items()}
        if r["x"] in y:
            assert r["y"] == pytest.approx(y[r["x"]])
        elif min(y) < r["x"] < max(y):
            low, high = y[max(x for x in y if x < r["x"])], y[min(x for x in y if x > r["x"])]
            assert min(low, high) - 1e-9 <= r["y"] <= max(low, high) + 1e-9
