"""Key networks: hand-known answers."""

import os
import random

import pytest

from pyspark.sql import functions as F

from zonepack.operators import graph, reports, strata
from zonepack.operators import membership as M
from zonepack.plans.catalog import Catalog, PlanError
from zonepack.plans.packager import Packager, RunFailed, read_copies, read_manifest, read_table


@pytest.fixture
def catalog(spark):
    """Orchards have rows of trees (by plot and year, both must fit), trees have pickings."""
    c = Catalog(spark)
    c.add("orchards", spark.createDataFrame([(70, "hill", 2001), (71, "lake", 2001), (72, "hill", 2002)], "oid long, plot string, year int"), "oid")
    trees = [(1, "hill", 2001), (2, "lake", 2001), (3, "hill", 2001), (4, "hill", 2002), (5, "lake", None), (6, None, None), (7, "moor", 2001)]
    c.add("trees", spark.createDataFrame(trees, "tid long, in_plot string, planted int"), "tid")
    c.add("pickings", spark.createDataFrame([(501, 1), (502, 1), (503, 3), (504, 4), (505, 7), (506, None)], "pid long, tree long"), "pid")
    c.relate("tree_of_orchard", "trees", "orchards", [("in_plot", "plot"), ("planted", "year")])
    c.relate("picking_of_tree", "pickings", "trees", [("tree", "tid")])
    return c


def members(catalog, layer, spark, **options):
    found = Packager(spark, catalog, "orchards", layers=[layer], **options).membership(layer)
    return sorted((r[0], r[1]) for r in found.collect())


def test_all_fields_of_a_key_must_fit_and_none_be_null(spark, catalog):
    assert members(catalog, "trees", spark) == [(70, 1), (70, 3), (71, 2), (72, 4)]


def test_chain_of_two(spark, catalog):
    assert members(catalog, "pickings", spark) == [(70, 501), (70, 502), (70, 503), (72, 504)]


def test_filter_of_the_table_in_between(spark, catalog):
    assert members(catalog.with_layer("trees", subset="tid <> 1"), "pickings", spark) == [(70, 503), (72, 504)]


def test_strata_layer_itself(spark, catalog):
    assert members(catalog, "orchards", spark) == [(70, 70), (71, 71), (72, 72)]


def test_stratum_with_a_null_in_its_key_gets_nothing(spark, catalog):
    nulls = catalog.with_layer("orchards", source=spark.createDataFrame([(73, "hill", None), (74, None, 2001)], "oid long, plot string, year int"))
    assert members(nulls, "trees", spark) == []


def test_two_relations_between_the_same_tables_need_a_choice(spark, catalog):
    catalog.relate("grafted_on", "trees", "orchards", [("in_plot", "plot")])
    with pytest.raises(PlanError, match="relation_path"):
        catalog.plan("orchards", ["trees"])
    chosen = catalog.with_layer("trees", relation_path='["grafted_on"]')
    assert chosen.plan("orchards", ["trees"])[0].relation_ids == ("grafted_on",)
    assert members(chosen, "trees", spark) == [(70, 1), (70, 3), (70, 4), (71, 2), (71, 5), (72, 1), (72, 3), (72, 4)]


@pytest.mark.parametrize("pin", ["{", "7", '["picking_of_tree"]', '["of nothing"]', "[]"])
def test_refused_choices(catalog, pin):
    with pytest.raises(PlanError):
        catalog.with_layer("trees", relation_path=pin).plan("orchards", ["trees"])


def test_errors_come_together(catalog):
    bad = catalog.with_layer("trees", matching_method="by smell").with_layer("pickings", relation_path="{")
    with pytest.raises(PlanError, match="trees.*pickings"):
        bad.plan("orchards", ["trees", "pickings"])


def test_membership_does_not_depend_on_partitions_or_broadcast(spark, catalog):
    expected = members(catalog, "pickings", spark)
    for key, value in (("spark.sql.shuffle.partitions", "1"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        old = spark.conf.get(key)
        spark.conf.set(key, value)
        try:
            assert members(catalog, "pickings", spark) == expected
        finally:
            spark.conf.set(key, old)


def test_matched_and_orphans_add_up(spark, catalog):
    trees = catalog.layers["trees"].source
    found = Packager(spark, catalog, "orchards", layers=["trees"]).membership("trees")
    assert M.matched(found).count() + M.orphans(trees, found, ["tid"]).count() == trees.count()


def test_shared_prefix_is_built_once(spark, catalog):
    p = Packager(spark, catalog, "orchards", layers=["pickings"])
    first = p.membership("pickings").collect()
    built = p.memo.built
    assert sorted(p.membership("pickings").collect()) == sorted(first)
    assert p.memo.built == built


BOX = "minx double, miny double, maxx double, maxy double"


@pytest.fixture
def farm(spark, catalog):
    """Orchards with a box each, ponds by place, tools for all; hill orchards share a bundle."""
    places = [(70, "hill", 2001, 0.0, 0.0, 8.0, 8.0), (71, "lake", 2001, 50.0, 0.0, 58.0, 8.0), (72, "hill", 2002, 0.0, 50.0, 8.0, 58.0)]
    c = catalog.with_layer("orchards", source=spark.createDataFrame(places, f"oid long, plot string, year int, {BOX}"), geometry="polygon")
    c.add("ponds", spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (2, 51.0, 1.0, 52.0, 2.0), (3, 300.0, 1.0, 301.0, 2.0)], f"pond int, {BOX}"), "pond", geometry="polygon")
    return c.add("tools", spark.createDataFrame([("axe",), ("saw",)], "tool string"), "tool", matching_method="whole_export")


def run(spark, farm, out, layers=("trees", "ponds", "tools"), **options):
    p = Packager(spark, farm, "orchards", layers=list(layers), name_expr="concat(plot, year)", package_expr="concat(plot, '/', name)", bundle_expr="plot", **options)
    return sorted(((r.stratum, r.layer, r.feature_count, r.status) for r in p.package(str(out), fail_at_end=False).collect()), key=str)


def test_package_run(spark, farm, tmp_path):
    assert run(spark, farm, tmp_path / "out") == sorted([
        ("hill2001", "trees", 2, "ok"), ("lake2001", "trees", 1, "ok"), ("hill2002", "trees", 1, "ok"), ("<unmatched>", "trees", 3, "ok"),
        ("hill2001", "ponds", 1, "ok"), ("lake2001", "ponds", 1, "ok"), ("hill2002", "ponds", 0, "empty-skipped"), ("<unmatched>", "ponds", 1, "ok"),
        ("hill2001", "tools", 2, "ok"), ("lake2001", "tools", 2, "ok"), ("hill2002", "tools", 2, "ok"),
    ], key=str)
    assert read_table(spark, str(tmp_path / "out"), "trees").where("stratum_id = 70").count() == 2 and read_copies(spark, str(tmp_path / "out"), "tools").count() == 2
    assert {(r.stratum_id, r["count"]) for r in read_table(spark, str(tmp_path / "out"), "tools").groupBy("stratum_id").count().collect()} == {(70, 2), (71, 2), (72, 2)}
    manifest = read_manifest(spark, str(tmp_path / "out"))
    assert manifest.count() == 9 and manifest.where("shared").select("table").distinct().collect() == [("tools",)]


def test_bundles_that_exist(spark, farm, tmp_path):
    out = tmp_path / "out"
    run(spark, farm.with_layer("orchards", subset="plot = 'lake'"), out, ["trees"])
    with pytest.raises(FileExistsError, match="lake"):
        run(spark, farm, out, ["trees"])
    less = farm.with_layer("trees", subset="tid > 3")
    assert run(spark, less, out, ["trees"], overwrite_mode="skip-existing") == sorted([("hill2001", "trees", 0, "empty-skipped"), ("hill2002", "trees", 1, "ok"), ("lake2001", "trees", None, "skipped-existing"), ("<unmatched>", "trees", 3, "ok")], key=str)
    assert sorted((r.stratum_id, r.tid) for r in read_table(spark, str(out), "trees").collect()) == [(71, 2), (72, 4)]
    run(spark, farm, out, ["trees"], overwrite_mode="overwrite")
    assert sorted((r.stratum_id, r.tid) for r in read_table(spark, str(out), "trees").collect()) == [(70, 1), (70, 3), (71, 2), (72, 4)]


def test_shared_copies_stay_with_their_run(spark, farm, tmp_path):
    out = str(tmp_path / "out")
    farm = farm.with_layer("tools", matching_method="whole_export")
    run(spark, farm.with_layer("orchards", subset="plot = 'lake'"), out, ["tools"])
    more = farm.layers["tools"].source
    more = more.union(more).withColumn("weight", F.lit(3))
    run(spark, farm.with_layer("tools", source=more), out, ["tools", "trees"], overwrite_mode="skip-existing")
    for _ in range(4):
        found = read_table(spark, out, "tools").groupBy("stratum_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
        assert sorted(map(tuple, found)) == [(70, 4, 12), (71, 2, None), (72, 4, 12)]
    assert sorted(r["count"] for r in read_copies(spark, out, "tools").groupBy("run").count().collect()) == [2, 4]
    assert {r.stratum_id for r in read_table(spark, out, "trees").collect()} == {70, 72}
    run(spark, farm, out, ["tools"], overwrite_mode="overwrite")
    assert {(r.stratum_id, r["count"]) for r in read_table(spark, out, "tools").groupBy("stratum_id").count().collect()} == {(70, 2), (71, 2), (72, 2)}
    with pytest.raises(PlanError, match="spoons"):
        read_table(spark, out, "spoons")


def rows_scanned(df):
    """Rows that come out of the scan: those of the row groups and pages that are read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_indexed_tables_are_read_in_part(spark, tmp_path, monkeypatch):
    from zonepack.sources import packages as P

    monkeypatch.setattr(P, "INDEXED_GROUP", 32 << 10)
    zones = spark.createDataFrame([(1,), (2,)], "zone long")
    rows = spark.range(40_000).select(F.col("id").alias("i"), (F.col("id") % 2 + 1).alias("z"), (F.hash("id") % 5000).alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("b"), F.lit("x").alias("c"))
    c = Catalog(spark).add("zones", zones, "zone").add("rows", rows, "i").add("all", rows, "i", matching_method="whole_export").relate("r", "rows", "zones", [("z", "zone")])
    key = rows.where("i = 777").first()
    queries = {"first": "select * from rows r join other o on r.a = o.q where b = c1", "second": "select 1 from rows where a=3", "third": "select 1"}
    scanned = {}
    for name, given in (("plain", None), ("indexed", queries)):
        p = Packager(spark, c, "zones", layers=["rows", "all"], queries=given)
        assert p.indexed("rows") == (["a", "b"] if given else [])
        p.package(str(tmp_path / name))
        for table in ("rows", "all"):
            path = read_manifest(spark, str(tmp_path / name)).where(F.col("table") == table).first().run
            df = spark.read.parquet(f"{tmp_path}/{name}/{path}/{'_shared/' if table == 'all' else ''}{table}")
            for column in "ab":
                found = df.where(F.col(column) == key[column])
                assert found.where("i = 777").count() == 1
                scanned[name, table, column] = rows_scanned(found)
    for table in ("rows", "all"):
        for column in "ab":
            assert scanned["indexed", table, column] * 4 < scanned["plain", table, column], scanned


def test_partial_cache_gives_what_a_cold_run_gives(spark, farm, tmp_path):
    from zonepack.sources import packages as P

    warm = farm.with_layer("trees", warm=True)
    cold = Packager(spark, farm, "orchards", layers=["trees"]).slices("trees")
    P.write_partitioned(cold.where("stratum_id = 70"), str(tmp_path / "cache/trees"))
    found = run(spark, warm, tmp_path / "out", ["trees"], warm_dir=str(tmp_path / "cache"), warm_mode="use")
    assert found == sorted([("hill2001", "trees", 2, "warm"), ("lake2001", "trees", 1, "cold-fallback"), ("hill2002", "trees", 1, "cold-fallback")], key=str)
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "out"), "trees").select(cold.columns).collect())) == sorted(map(tuple, cold.collect()))
    P.write_partitioned(cold, str(tmp_path / "cache/weeds"))  # a table that is not marked warm
    found = run(spark, warm, tmp_path / "out2", ["trees"], warm_dir=str(tmp_path / "cache"), warm_mode="use")
    assert {s for *_, s in found} == {"cold-fallback"}
    found = run(spark, warm, tmp_path / "out3", ["trees"], warm_dir=str(tmp_path / "cache2"), warm_mode="update")
    assert {s for n, *_, s in found if n != "<unmatched>"} == {"warm"}


def test_keys_that_look_like_numbers_stay_text(spark, tmp_path):
    c = Catalog(spark).add("zones", spark.createDataFrame([("01",), ("1",)], "z string"), "z").add("rows", spark.createDataFrame([(1, "01"), (2, "1"), (3, "01")], "i int, zone string"), "i", warm=True)
    c.relate("r", "rows", "zones", [("zone", "z")])
    for out in ("a", "b"):
        Packager(spark, c, "zones", warm_dir=str(tmp_path / "cache"), warm_mode="update" if out == "a" else "use").package(str(tmp_path / out))
        assert sorted((r.stratum_id, r.i) for r in read_table(spark, str(tmp_path / out), "rows").collect()) == [("01", 1), ("01", 3), ("1", 2)]


def test_full_package_is_a_member(spark, farm, tmp_path):
    found = run(spark, farm, tmp_path / "out", ["trees", "tools"], full_package=True, full_path="all/everything")
    assert ("<full>", "trees", 7, "ok") in found and ("<full>", "tools", 2, "ok") in found
    full = read_manifest(spark, str(tmp_path / "out")).where("name = '<full>'")
    assert {(r.package_rel, r.bundle_rel, r.stratum_id) for r in full.collect()} == {("all/everything", "everything", None)}
    with pytest.raises(PlanError):
        run(spark, farm, tmp_path / "out2", ["trees"], full_package=True, full_path="../up")


def test_failures_are_contained(spark, farm, tmp_path):
    found = run(spark, farm, tmp_path / "out", ["trees"], display_expr="CASE WHEN stratum_name <> 'lake2001' THEN layer_name END")
    assert found == sorted([("hill2001", "trees", 2, "ok"), ("hill2002", "trees", 1, "ok"), ("lake2001", "trees", None, "failed"), ("<unmatched>", "trees", 4, "ok")], key=str)
    assert {r.bundle_rel for r in read_manifest(spark, str(tmp_path / "out")).collect()} == {"hill"}
    broken = farm.with_layer("ponds", source=farm.layers["ponds"].source.withColumn("depth", F.expr("raise_error('no water')")))
    with pytest.raises(RunFailed, match="ponds"):
        Packager(spark, broken, "orchards", layers=["ponds"]).package(str(tmp_path / "out2"))


def test_rows_that_fail_take_their_strata_only(spark, tmp_path, monkeypatch):
    from zonepack.plans import packager as K

    zones = spark.createDataFrame([(i,) for i in range(20)], "zone long")
    rows = spark.createDataFrame([(i, i % 20, "bad" if i in (27, 44, 47) else str(i)) for i in range(100)], "i long, z long, t string")
    c = Catalog(spark).add("zones", zones, "zone").add("rows", rows, "i", computed={"n": "cast(t as int) + stratum_id"}).add("more", rows, "i").relate("r", "rows", "zones", [("z", "zone")]).relate("m", "more", "zones", [("z", "zone")])
    out = str(tmp_path / "out")
    with pytest.raises(RunFailed, match="4, 7") as failed:
        Packager(spark, c, "zones", layers=["more", "rows"]).package(out)
    found = {(r.stratum, r.layer): (r.feature_count, r.status, r.detail) for r in failed.value.report.collect() if r.stratum != "<unmatched>"}
    assert {k for k, v in found.items() if v[1] == "failed"} == {(z, t) for z in "47" for t in ("rows", "more")} and "CAST_INVALID_INPUT" in found["4", "more"][2]
    assert len(found) == 40 and all(v == (5, "ok", "") for k, v in found.items() if k[0] not in "47")
    assert sorted((r.stratum_id, r.i, r.n) for r in read_table(spark, out, "rows").collect()) == sorted((i % 20, i, i + i % 20) for i in range(100) if i % 20 not in (4, 7))
    assert {r.stratum_id for r in read_table(spark, out, "more").collect()} == set(range(20)) - {4, 7} == {r.stratum_id for r in read_manifest(spark, out).collect()}
    monkeypatch.setattr(K, "MOST_TRIES", 8)  # groups that are left fail as they are
    report = Packager(spark, c, "zones", layers=["rows"]).package(str(tmp_path / "few"), fail_at_end=False)
    lost = {r.stratum for r in report.where("status = 'failed'").collect()}
    assert {"4", "7"} <= lost and len(lost) < 12
    with pytest.raises(RunFailed, match="rows"):
        Packager(spark, c.with_layer("rows", computed={"n": "raise_error('none')"}), "zones", layers=["rows"]).package(str(tmp_path / "none"))


def test_a_run_without_strata_is_refused(spark, farm, tmp_path):
    nothing = spark.createDataFrame([], "oid long")
    with pytest.raises(PlanError, match="selected"):
        run(spark, farm, tmp_path / "out", ["trees"], selection=nothing)
    with pytest.raises(PlanError, match="no strata"):
        run(spark, farm.with_layer("orchards", subset="false"), tmp_path / "out", ["trees"])


EDGE = "array<struct<x1: double, y1: double, x2: double, y2: double>>"


def ring(*points):
    return [(*map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1])]


def placed(spark, features, strata, feature, stratum, **flags):
    """Pairs of a spatial match; features and strata as (id, edges) or (id, box)."""
    def layer(rows):
        out = []
        for i, shape in rows:
            edges = shape if isinstance(shape, list) else None
            xs, ys = ([e[k] for e in edges for k in ks] for ks in ((0, 2), (1, 3))) if edges else ((shape[0], shape[2]), (shape[1], shape[3]))
            out.append((i, *map(float, (min(xs), min(ys), max(xs), max(ys))), edges))
        return spark.createDataFrame(out, f"id long, {BOX}, shape {EDGE}")

    c = Catalog(spark)
    for name, rows, kind in (("s", strata, stratum), ("f", features, feature)):
        c.add(name, layer(rows), "id", geometry=kind, shape="shape" if isinstance(rows[0][1], list) else None, **{k[2:]: v for k, v in flags.items() if k[0] == name})
    return sorted(map(tuple, Packager(spark, c, "s", layers=["f"]).membership("f").collect()))


def test_spatial_match_uses_the_shapes(spark):
    triangle = ring((0, 0), (10, 0), (0, 10))
    points = [(1, (1, 1, 1, 1)), (2, (9, 9, 9, 9)), (3, (5, 5, 5, 5)), (4, (5, 0, 5, 0))]
    assert placed(spark, points, [(7, triangle)], "point", "polygon") == [(7, 1), (7, 3), (7, 4)]
    assert placed(spark, points, [(7, triangle)], "point", "polygon", f_spatial_predicate="within") == [(7, 1)]
    boxes = [(1, (1, 1, 2, 2)), (2, (8, 8, 9, 9)), (3, (4, 4, 7, 7)), (4, (10, 0, 12, 2))]
    assert placed(spark, boxes, [(7, triangle)], "polygon", "polygon") == [(7, 1), (7, 3)]
    assert placed(spark, boxes, [(7, triangle)], "polygon", "polygon", f_spatial_predicate="touches") == [(7, 4)]
    lines = [(1, ring((1, 1), (2, 2))[:1]), (2, ring((9, 9), (6, 9))[:1]), (3, ring((0, 12), (12, 0))[:1]), (4, ring((-1, 5), (20, 5))[:1])]
    assert placed(spark, lines, [(7, triangle)], "line", "polygon") == [(7, 1), (7, 4)]
    assert placed(spark, lines, [(7, triangle)], "line", "polygon", f_spatial_predicate="crosses") == [(7, 4)]
    assert placed(spark, [(1, triangle)], [(7, (9, 9, 9, 9)), (8, (1, 1, 1, 1))], "polygon", "point") == [(8, 1)]
    assert placed(spark, [(1, (2, 2, 2, 2)), (2, (2, 3, 2, 3))], [(7, ring((0, 0), (4, 4))[:1])], "point", "line") == [(7, 1)]


def test_strata_go_to_the_layers_coordinate_system(spark):
    import math

    x, y = math.radians(2) * 6378137, math.log(math.tan(math.pi / 4 + math.radians(2) / 2)) * 6378137
    points = [(1, (x, y, x, y)), (2, (x * 4, y * 4, x * 4, y * 4))]
    triangle = ring((0, 0), (10, 0), (0, 10))
    assert placed(spark, points, [(7, triangle)], "point", "polygon", s_srid=4326, f_srid=3857) == [(7, 1)]
    with pytest.raises(PlanError, match="2056"):
        placed(spark, points, [(7, triangle)], "point", "polygon", s_srid=4326, f_srid=2056)


def test_excluding_every_field_is_an_error(spark, catalog):
    with pytest.raises(ValueError, match="excluded"):
        Packager(spark, catalog.with_layer("pickings", excluded_fields=("pid", "tree")), "orchards", layers=["pickings"]).slices("pickings").collect()


def test_names_that_collide_are_refused(spark):
    c = Catalog(spark).add("s", spark.createDataFrame([(1, "AB"), (2, "ab")], "sid long, n string"), "sid")
    with pytest.raises(PlanError, match="AB"):
        Packager(spark, c, "s", layers=["s"], name_expr="n").check()


def test_failed_stratum_comes_first(spark):
    s = spark.createDataFrame([("A",), ("B",), ("C",)], "stratum string")
    layers = spark.createDataFrame([("pts", True)], "layer string, warm boolean")
    outcomes = spark.createDataFrame([("A", "pts", 3, "ok"), ("B", "pts", 2, "ok")], "stratum string, layer string, feature_count long, status string")
    why = lambda rows: spark.createDataFrame(rows, "stratum string, reason string")
    out = reports.run_rows(s, layers, outcomes, why([("A", "boom")]), why([("A", "cold"), ("B", "cold"), ("C", "cold")]))
    assert sorted((r.stratum, r.feature_count, r.status, r.detail) for r in out.collect()) == [("A", None, "failed", "boom"), ("B", 2, "cold-fallback", "cold"), ("C", 0, "empty-skipped", "")]


def one_by_one(names):
    taken, out = set(), []
    for n in names:
        k, new = 2, n
        while new.casefold() in taken:
            new, k = f"{n}_{k}", k + 1
        taken.add(new.casefold())
        out.append(new)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_dedupe_names_is_the_sequential_rule(spark, seed):
    pick = random.Random(seed)
    names = ["a", "A", "a_2", "a", "b", "a_2", "c_2", "c", "c", "b", "a_2_2"] if not seed else [pick.choice("xX") + pick.choice(["", "", "", "_2", "_3", "_4", "_02", "_1", "_2_2", "_2_3", "_3_2", "_9"]) for _ in range(60)]
    found = strata.dedupe_names(spark.createDataFrame(list(enumerate(names)), "i long, n string"), "i", "n")
    assert [r[1] for r in sorted(found.collect())] == one_by_one(names)


def test_dedupe_names_without_rows_or_names(spark):
    found = strata.dedupe_names(spark.createDataFrame([(1, None), (2, "ſtraße"), (3, "STRASSE"), (4, "stras\nse_2")], "i long, n string"), "i", "n")
    assert sorted(map(tuple, found.collect())) == [(1, None), (2, "ſtraße"), (3, "STRASSE_2"), (4, "stras\nse_2")]
    assert strata.dedupe_names(spark.createDataFrame([], "i long, n string"), "i", "n").collect() == []


def test_long_chains_are_followed_to_the_end(spark):
    rows = [(f"e{i}", f"n{i}", f"n{i + 1}", True, "normal") for i in range(40)] + [("twin", "n0", "n1", True, "normal")]
    steps = graph.hops(spark.createDataFrame(rows, "relation_id string, child string, parent string, valid boolean, kind string"))
    found = {r.node: (r.hops, r.paths) for r in graph.shortest_paths(steps, "n0").collect()}
    assert found == {f"n{i}": (i, 2 if i else 1) for i in range(41)}
    short = graph.hops(spark.createDataFrame(rows[:3] + rows[-1:], "relation_id string, child string, parent string, valid boolean, kind string"))
    assert {r.node: r.paths for r in graph.ambiguous(graph.listed_paths(short, "n0")).collect()} == {"n1": "e0; twin", "n2": "e0 > e1; twin > e1", "n3": "e0 > e1 > e2; twin > e1 > e2"}


def test_listed_paths_are_the_first_by_text(spark):
    rows = [(f"r{i}", "a", "b", True, "normal") for i in range(30)]
    steps = graph.hops(spark.createDataFrame(rows, "relation_id string, child string, parent string, valid boolean, kind string"))
    assert {r.node: r.paths for r in graph.listed_paths(steps, "a").collect()} == {"a": [[]], "b": [[x] for x in sorted(f"r{i}" for i in range(30))[:16]]}


@pytest.mark.parametrize("most", [3, 16])
def test_listed_paths_equal_a_full_search(spark, most):
    """Layers of nodes with many ways between them, parallel relations, ids that begin like others, and ways back."""
    pick = random.Random(most)
    nodes = [["s"], *[[f"n{level}{i}" for i in range(7)] for level in range(3)], ["far"]]
    ids = [f"{pick.choice('abc')}{i if i % 3 else ''}{'!' * (i % 2)}{i}" for i in range(200)]
    rows = []
    for near, far in zip(nodes, nodes[1:]):
        rows += [(ids.pop(), a, b, True, "normal") if pick.random() < 0.5 else (ids.pop(), b, a, True, "normal") for a in near for b in far for _ in range(pick.choice([0, 1, 1, 2]))]
    steps = graph.hops(spark.createDataFrame(rows, "relation_id string, child string, parent string, valid boolean, kind string"))
    level, wanted = {"s": [[]]}, {"s": [[]]}
    while level:
        below = {}
        for r, a, b, *_ in rows:
            for here, there in ((a, b), (b, a)):
                if here in level and there not in wanted:
                    below.setdefault(there, []).extend([*p, r] for p in level[here])
        level = {n: sorted(p) for n, p in below.items()}
        wanted |= level
    assert {r.node: r.paths for r in graph.listed_paths(steps, "s", most).collect()} == {n: p[:most] for n, p in wanted.items()}


@pytest.mark.parametrize(
    "one_plan, text",
    [
        (True, "SELECT c, count(*) AS n, max(o) AS m FROM customer JOIN orders ON oc = c GROUP BY c"),
        (True, "SELECT count(*) AS n, sum(o) AS m FROM orders"),
        (True, "SELECT o, row_number() OVER (ORDER BY o) AS k FROM orders ORDER BY o DESC LIMIT 1"),
        (True, "SELECT c FROM customer UNION SELECT oc FROM orders"),
        (False, "SELECT c, o FROM customer LEFT JOIN orders ON oc = c"),
        (False, "SELECT c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE oc = c)"),
        (False, "SELECT c, (SELECT count(*) FROM orders) AS n FROM customer"),
    ],
)
def test_queries_over_all_strata(spark, one_plan, text):
    from zonepack.operators import views

    strata = spark.createDataFrame([("1",), ("2",), ("3",)], "stratum_id string")
    slices = {"customer": spark.createDataFrame([("1", 10), ("1", 11), ("2", 10)], "stratum_id string, c int"), "orders": spark.createDataFrame([("1", 10, 100), ("1", 10, 101), ("2", 10, 7), ("2", 12, 8)], "stratum_id string, oc int, o int")}
    assert (views._in_one_plan(spark, text, slices, strata) is not None) == one_plan
    each = [[(i, *r) for r in views.live_view(spark, text, slices, i).collect()] for i in "123"]
    assert sorted(map(tuple, views.over_strata(spark, text, slices, strata).collect()), key=str) == sorted(sum(each, []), key=str)


def test_queries_that_do_not_open(spark):
    from zonepack.operators import views

    strata, slices = spark.createDataFrame([(1,)], "stratum_id int"), {"t": spark.createDataFrame([(1, 2)], "stratum_id int, a int")}
    for text, why in (("SELECT a FROM t JOIN gone ON a = b", "gone"), ("SELECT nothing FROM t", "does not open")):
        with pytest.warns(UserWarning, match=why):
            assert views.over_strata(spark, text, slices, strata) is None


def test_listed_paths_keep_each_relation_once(spark, monkeypatch):
    """Steps lead both ways, but relations are ranked, written and joined in one direction."""
    edges = spark.createDataFrame([("r1", "b", "a"), ("r2", "a", "b"), ("r3", "b", "c"), ("loop", "a", "a")], "relation_id string, child string, parent string")
    counts = {}

    def counted(df, name, whole=graph.stage):
        found = whole(df, name)
        counts.setdefault(name, found.count())
        return found

    monkeypatch.setattr(graph, "stage", counted)
    found = {r.node: r.paths for r in graph.listed_paths(graph.hops(edges), "a").collect()}
    assert found == {"a": [[]], "b": [["r1"], ["r2"]], "c": [["r1", "r3"], ["r2", "r3"]]}
    assert counts["steps"] == 4


def test_pinned_paths_of_repeated_relations_and_one_join(spark):
    edges = spark.createDataFrame([("r1", "a", "b"), ("r1", "a", "b"), ("r2", "c", "b"), ("r3", "c", None)], "relation_id string, child string, parent string")
    pins = [(1, "a", "c", ["r1", "r2"]), (2, "a", "a", []), (3, "a", "b", []), (4, "a", "b", None), (5, "c", "b", ["r3"]), (6, "a", "c", ["r1"]), (None, "a", "b", ["r1"]), (7, "c", "b", ["r1", "r9"])]
    pins = spark.createDataFrame(pins, 'pin_id long, start string, `end` string, relation_ids array<string>')
    found = graph.pinned(edges, pins)
    assert {r.pin_id: (r.error, r.reached) for r in found.collect()} == {
        1: (None, "c"), 2: (None, "a"), 3: ("path is empty", "a"), 4: ("ends elsewhere", "a"), 5: ("does not connect", "c"), 6: ("ends elsewhere", "b"), 7: ("does not connect", "c"),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_running_sums_shuffle_rows_once_and_end_where_a_range_ends(spark):
    pick = random.Random(5)
    rows = [(g, i, pick.choice([0, 1, 2])) for i, g in enumerate("a" * 3 + "b" * 500 + "c" * 2 + "d" * 300 + "e")]
    found = strata.running_sum(spark.createDataFrame(pick.sample(rows, len(rows)), "g string, i long, n long"), "g", ["i"], "n", "total")
    sums, expected = {}, {}
    for g, i, n in rows:
        expected[i] = sums[g] = sums.get(g, 0) + n
    assert {r.i: r.total for r in found.collect()} == expected
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()


def test_relations_that_do_not_lead_on_are_written_once(spark, monkeypatch):
    """Relations that the source doesn't reach, and those inside a level, are written once and then no more; large levels give the same paths."""
    far = [(f"f{i}", f"x{i}", f"y{i % 50}") for i in range(3000)]
    near = [("b", "s", "m"), ("a", "s", "m"), ("c", "m", "n"), ("d", "s", "o"), ("e", "o", "n"), ("g", "m", "o"), ("h", "n", "n")]
    edges = spark.createDataFrame([(*e, True, "normal") for e in near + far], "relation_id string, child string, parent string, valid boolean, kind string")
    wanted = {"s": (0, [[]]), "m": (1, [["a"], ["b"]]), "o": (1, [["d"]]), "n": (2, [["a", "c"], ["b", "c"], ["d", "e"]])}
    written, folders, stage = [], {}, graph.stage

    def counted(df, name):
        out = stage(df, name)
        written.append((name, out.count()))
        folders.setdefault(name, []).append(out.staged_at.removeprefix("file:"))
        return out

    monkeypatch.setattr(graph, "stage", counted)
    for small in (graph.SMALL, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        assert {r.node: (r.hops, r.paths) for r in graph.listed_paths(graph.hops(edges), "s").collect()} == wanted
        assert {r.node: (r.hops, r.paths) for r in graph.shortest_paths(graph.hops(edges), "s").collect()} == {n: (h, len(p)) for n, (h, p) in wanted.items()}
        assert {r.node: r.paths for r in graph.listed_paths(graph.hops(edges), "s", 2).collect()} == {n: p[:2] for n, (_, p) in wanted.items()}
    assert {r.node: r.paths for r in graph.listed_paths(graph.hops(edges), "elsewhere").collect()} == {"elsewhere": [[]]}
    written.clear(), folders.clear()
    graph.listed_paths(graph.hops(edges), "s")
    assert written[0] == ("steps", 3007) and sum(n for _, n in written[1:]) <= 20
    assert not any(os.path.exists(f) for name in ("steps", "ahead") for f in folders[name]) and all(map(os.path.exists, folders["level"]))
