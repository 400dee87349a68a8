"""Column functions against hand-known vectors and plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from zonepack.functions import geometry as G
from zonepack.functions import text as T
from zonepack.operators import spatial as S
from zonepack.plans.catalog import PlanError, auto_predicates, predicate_tokens
from zonepack.sources import packages as P
from zonepack.sources import scans


def apply(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_sanitize_filename(spark):
    vectors = {"north|south": "northsouth", "NUL": "_NUL", "aux.tar.gz": "_aux.tar.gz", " . .": "_", "a<b>c": "abc", "\tone\n two ": "one two", "": "_", "end. .": "end", "Com3": "_Com3", "Łódź": "Łódź", "q" * 260: "q" * 255, "PRN .x": "_PRN .x"}
    once = apply(spark, list(vectors), T.sanitize_filename)
    assert once == list(vectors.values())
    assert apply(spark, once, T.sanitize_filename) == once


def test_sanitize_is_idempotent_and_never_empty(spark):
    pick = random.Random(5)
    values = ["".join(pick.choice("aB. /\\<>:|?*\t\n_COM1é ") for _ in range(pick.randint(0, 12))) for _ in range(500)]
    once = apply(spark, values, T.sanitize_filename)
    assert all(once) and apply(spark, once, T.sanitize_filename) == once
    assert not any(apply(spark, once, T.component_error))


def test_paths(spark):
    bad = ["up/../down", "D:\\here", "one//two", "nul/x", "", "\t ", "\\root", "\\\\server\\share", "one./two", "one/ two", "one/", "q?"]
    assert all(apply(spark, bad, T.path_error))
    assert apply(spark, ["one/two", "one\\two\\three", "plot 7"], T.path_error) == [None] * 3


def test_strip_accents(spark):
    text = "Çà et là, naïve Ærø — ñandú Ångström ﬁ e\u0301 Ελλάδα"
    assert apply(spark, [text], T.strip_accents) == ["".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")]
    assert apply(spark, ["1 Été!"], T.slugify) == ["_1_ete_"]


def test_every_character_loses_its_marks(spark):
    every = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = ["".join(every[i : i + 200]) for i in range(0, len(every), 200)]
    plain = lambda t: "".join(x for c in t for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    for text, found in zip(texts, apply(spark, texts, T.strip_accents)):
        assert found == plain(text), [c for c in text if plain(c) not in found][:5]
    assert apply(spark, ["한글 각 가", "", None], T.strip_accents) == [plain("한글 각 가"), "", None]


def test_query_texts(spark):
    sql = 'select * from "My Table" t join db.other o on t.id = o . ref where a <= b and c=d'
    assert apply(spark, [sql], T.equality_operands) == [["c", "d", "id", "ref"]]
    assert apply(spark, [sql], T.source_tables) == [["My Table", "other"]]


def test_operands_beside_anything(spark):
    texts = ["on a.id = b.ref;", "a.x=b.y||'z'", "`a`.x = b.y", "a=b=c=d", "x == y", "n = 4.5 and m=(k)", "ä.ö = ü . ß.z", "=a", "a=", "", "p = q.*", "a\x1f=\u3000b"]
    assert apply(spark, texts, T.equality_operands) == [["id", "ref"], ["x", "y"], ["x", "y"], ["a", "b", "c", "d"], [], ["5", "n"], ["ß", "ö"], [], [], [], ["p", "q"], ["a", "b"]]
    pick = random.Random(3)
    parts = ["a", "b1", "_c", "é", "=", "=", ".", " ", "\n", "(", ")", "'", '"', "`", ";", "|", "<", ">", "!", ",", "--", "12"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    rule = re.compile(r"(\w+)\s*=\s*(?:\w+\s*[.]\s*)?(\w+)")
    assert apply(spark, texts, T.equality_operands) == [sorted({n for m in rule.finditer(t) for n in m.groups()}) for t in texts]


def test_bool_tokens(spark):
    assert apply(spark, [" YES ", "0", "", "maybe"], T.coerce_bool) == [True, False, False, None]
    assert apply(spark, [" YES ", "0", "", "maybe", None], T.bool_error) == [None, None, None, "not a boolean: maybe", None]


def related(spark, a, b):
    df = spark.createDataFrame([(i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(a, b))], "i long, a0 double, a1 double, a2 double, a3 double, b0 double, b1 double, b2 double, b3 double")
    return [r.matrix for r in G.with_box_matrix(df, ("a0", "a1", "a2", "a3"), ("b0", "b1", "b2", "b3")).orderBy("i").collect()]


def test_boxes_of_the_grid(spark):
    boxes = [(2, 2, 4, 4), (10, 0, 12, 2), (9, 9, 13, 13), (50, 50, 52, 52), (-5, -5, 25, 25), (0, 2, 0, 5)]
    expected = ["2FF1FF212", "FF2F11212", "212101212", "FF2FF1212", "212FF1FF2", "F1FF0F212"]
    assert related(spark, boxes, [(0, 0, 10, 10)] * len(boxes)) == expected


def brute_matrix(a, b):
    """Cells of the plane at half steps: dimension of each part's overlap, by points, open unit edges and squares."""

    def part(v, lo, hi):
        return "o" if v < lo or v > hi else "e" if lo < hi and v in (lo, hi) else "i"

    best = {}
    for x in range(-2, 14):
        for y in range(-2, 14):
            dim = x % 2 + y % 2
            names = []
            for box in (a, b):
                px, py = part(x / 2, box[0], box[2]), part(y / 2, box[1], box[3])
                names.append("E" if "o" in px + py else "B" if "e" in px + py else "I")
            best[tuple(names)] = max(best.get(tuple(names), -1), dim)
    return "".join(str(best[r, c]) if (r, c) in best else "F" for r in "IBE" for c in "IBE")


def test_random_boxes_equal_counted_cells(spark):
    pick = random.Random(7)
    box = lambda: (lambda x, y: (x, y, x + pick.randint(0, 3), y + pick.randint(0, 3)))(pick.randint(0, 3), pick.randint(0, 3))
    a, b = [box() for _ in range(600)], [box() for _ in range(600)]
    assert related(spark, a, b) == [brute_matrix(x, y) for x, y in zip(a, b)]


def test_grid_join_equals_all_pairs(spark):
    pick = random.Random(9)
    box = lambda: (lambda x, y: (x, y, x + pick.choice([0, 1, 5, 60]), y + pick.choice([0, 2, 7, 90])))(pick.randint(-50, 50), pick.randint(-50, 50))
    a, b = [box() for _ in range(80)], [box() for _ in range(60)]
    frame = lambda name, boxes: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(boxes)], f"{name} long, {name}0 double, {name}1 double, {name}2 double, {name}3 double")
    found = S.bbox_join(frame("a", a), ("a0", "a1", "a2", "a3"), frame("b", b), ("b0", "b1", "b2", "b3"))
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] <= y[2] and x[2] >= y[0] and x[1] <= y[3] and x[3] >= y[1]}


def polygon(spark, points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ([(0, 0), (4, 0), (0, 4)], [(0, 0), (4, 0), (0, 4)], "2FFF1FFF2"),
        ([(0, 0), (4, 0), (0, 4)], [(10, 10), (14, 10), (10, 14)], "FF2FF1212"),
        ([(1, 1), (2, 1), (1, 2)], [(0, 0), (9, 0), (0, 9)], "2FF1FF212"),
        ([(0, 0), (9, 0), (0, 9)], [(1, 1), (2, 1), (1, 2)], "212FF1FF2"),
        ([(0, 0), (4, 0), (4, 4), (0, 4)], [(4, 4), (8, 4), (8, 8), (4, 8)], "FF2F01212"),
        ([(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (8, 2), (8, 8), (2, 8)], "212101212"),
    ],
)
def test_polygons(spark, a, b, expected):
    rows = spark.range(1).select("id", G.ring_edges(polygon(spark, a)).alias("a"), G.ring_edges(polygon(spark, b)).alias("b"))
    assert S.polygon_relate(rows, ["id"], "a", "b").first().matrix == expected


def rectangles(pick, count):
    return [(p, x, y, x + pick.randint(1, 3), y + pick.randint(1, 3)) for p in range(count) for x, y in [(pick.randint(0, 4), pick.randint(0, 4))]]


def polygon_places(shape):
    """{(doubled x, y): B or I} of cells, sides and corners of the grid; the rectangles that lie in an odd number hold."""
    cells = {(x, y) for x in range(-1, 9) for y in range(-1, 9) if sum(a <= x < c and b <= y < d for _, a, b, c, d in shape) % 2}
    out = {}
    for x in range(-2, 18):
        for y in range(-2, 18):
            around = [(i, j) in cells for i in {(x - 1) // 2, x // 2} for j in {(y - 1) // 2, y // 2}]
            if any(around):
                out[x, y] = "I" if all(around) else "B"
    return out


def line_places(shape):
    out, ends = {}, {}
    for _, a, b, c, d in shape:
        for x in range(2 * a, 2 * c + 1):
            for y in range(2 * b, 2 * d + 1):
                out[x, y] = "I"
        for p in ((2 * a, 2 * b), (2 * c, 2 * d)):
            ends[p] = ends.get(p, 0) + 1
    return out | {p: "B" for p, n in ends.items() if n % 2}


def places_matrix(a, b):
    best = {}
    for x in range(-3, 20):
        for y in range(-3, 20):
            key = a.get((x, y), "E") + b.get((x, y), "E")
            best[key] = max(best.get(key, -1), x % 2 + y % 2)
    return "".join(str(best.get(r + c, "F")) for r in "IBE" for c in "IBE")


def separate(shape):
    """Do the rectangles touch nowhere, but for those that lie strictly inside another? Then all of them are parts or holes."""
    for i, (_, a, b, c, d) in enumerate(shape):
        for _, e, f, g, h in shape[:i]:
            if not (g < a or c < e or h < b or d < f) and not (a < e and g < c and b < f and h < d) and not (e < a and c < g and f < b and d < h):
                return False
    return True


def sheared(x, y):
    return float(2 * x + y), float(x + 3 * y)


def test_shapes_of_several_parts_equal_counted_cells(spark):
    """Polygons and lines of the grid, sheared: relations stay the same, edges slant."""
    pick = random.Random(13)
    edge = lambda p, x1, y1, x2, y2: (p, *sheared(x1, y1), *sheared(x2, y2))

    def polygon_shape():
        while True:
            shape = rectangles(pick, pick.randint(1, 3))
            if separate(shape):
                depth = [sum(o[1] < s[1] and s[3] < o[3] and o[2] < s[2] and s[4] < o[4] for o in shape) for s in shape]
                holes = [i for i, n in enumerate(depth) if n % 2]
                owner = {i: next(j for j, o in enumerate(shape) if depth[j] == depth[i] - 1 and o[1] < shape[i][1] and shape[i][3] < o[3] and o[2] < shape[i][2] and shape[i][4] < o[4]) for i in holes}
                edges = [edge(owner.get(i, i), *e) for i, (_, a, b, c, d) in enumerate(shape) for e in ((a, b, c, b), (c, b, c, d), (c, d, a, d), (a, d, a, b))]
                return edges, polygon_places(shape)

    def line_shape():
        while True:
            shape = [(p, x, y, *((x + n, y) if pick.random() < 0.5 else (x, y + n))) for p in range(pick.randint(1, 4)) for x, y, n in [(pick.randint(0, 4), pick.randint(0, 4), pick.randint(1, 4))]]
            steps = [(x, y) for _, a, b, c, d in shape for x in range(2 * a, 2 * c + 1) for y in range(2 * b, 2 * d + 1) if (x + y) % 2]
            # noded at its own corners: no step twice, and no end or crossing in the middle of another segment
            inner = {(x, y) for _, a, b, c, d in shape for x in range(2 * a, 2 * c + 1) for y in range(2 * b, 2 * d + 1) if (x, y) not in ((2 * a, 2 * b), (2 * c, 2 * d))}
            if len(steps) == len(set(steps)) and not inner & {p for _, a, b, c, d in shape for p in ((2 * a, 2 * b), (2 * c, 2 * d))}:
                return [edge(p, *rest) for p, *rest in shape], line_places(shape)

    kind = "array<struct<part: int, x1: double, y1: double, x2: double, y2: double>>"
    for relate, one, other in ((S.polygon_relate, polygon_shape, polygon_shape), (S.line_relate, line_shape, polygon_shape), (S.line_line_relate, line_shape, line_shape)):
        a, b = [one() for _ in range(250)], [other() for _ in range(250)]
        rows = spark.createDataFrame([(i, x[0], y[0]) for i, (x, y) in enumerate(zip(a, b))], f"id long, a {kind}, b {kind}")
        found = {r.id: r.matrix for r in relate(rows, ["id"], "a", "b").collect()}
        wanted = {i: places_matrix(x[1], y[1]) for i, (x, y) in enumerate(zip(a, b))}
        assert found == wanted, relate.__name__
        assert len(set(wanted.values())) > 8


def test_grid_follows_the_data(spark):
    """Few rows are compared for each pair that is found, whatever the unit, and where half of the features lie in one spot."""
    from tests.conftest import DATA
    from zonepack.queries.registry import Tables
    from zonepack.queries.spatial import A, B, dense

    features, strata = dense(Tables(spark, DATA))
    more = features.crossJoin(spark.range(8)).withColumns({c: F.col(c) + F.col("id") * 1e-4 for c in A})
    for scale in (1.0, 1e7, 1e-9):
        f, s = (df.withColumns({c: F.col(c) * scale for c in box}) for df, box in ((more, A), (strata, B)))
        tested, found = S.candidates(f, A, s, B).count(), S.bbox_join(f, A, s, B).count()
        assert found and tested <= 4 * found, (scale, tested, found)


def test_transpose(spark):
    assert apply(spark, ["212FF1FF2"], G.transpose) == ["2FF1FF212"]


def test_unknown_transformation_is_refused():
    with pytest.raises(ValueError):
        G.reproject(F.lit(0.0), F.lit(0.0), 4326, 2056)


def test_predicate_tokens():
    assert predicate_tokens("intersects,  Touches", "polygon", "polygon") == ("intersects", "touches")
    assert predicate_tokens("T*F**F***, t*f**f**1", "polygon", "polygon") == ("T*F**F***", "T*F**F**1")
    for bad in ("auto, touches", "TTTTTTTTTT", "near"):
        with pytest.raises(PlanError):
            predicate_tokens(bad, "polygon", "polygon")
    assert auto_predicates("line", "polygon") == ("T********", "*1*******") and auto_predicates("point", "polygon") == ("intersects",)


def test_geojson_lines(spark, tmp_path):
    lines = ['{"type":"Feature","properties":{"name":"A"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]]]}}', '{"type":"Feature","properties":{"name":"p"},"geometry":{"type":"Point","coordinates":[1,2]}}']
    (tmp_path / "x.geojsonl").write_text("\n".join(lines))
    lines += ['{"type":"Feature","properties":{"name":"M"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0,7],[4,0,7],[0,4,7],[0,0,7]]],[[[9,9],[12,9],[9,12],[9,9]],[[10,10],[10,10.5],[10.5,10],[10,10]]]]}}']
    lines += ['{"type":"Feature","properties":{"name":"L"},"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3],[4,2]]]}}', '{"type":"Feature","properties":{"name":"none"},"geometry":null}']
    (tmp_path / "x.geojsonl").write_text("\n".join(lines))
    rows = scans.scan_geojson_lines(spark, str(tmp_path / "x.geojsonl"), ["name"])
    found = {r.name: (r.kind, r.parts and [[[tuple(p) for p in ring] for ring in part] for part in r.parts]) for r in rows.collect()}
    triangle = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    assert found.pop("M") == ("MultiPolygon", [[triangle], [[(9.0, 9.0), (12.0, 9.0), (9.0, 12.0), (9.0, 9.0)], [(10.0, 10.0), (10.0, 10.5), (10.5, 10.0), (10.0, 10.0)]]])
    assert found.pop("L") == ("MultiLineString", [[[(0.0, 0.0), (1.0, 1.0)]], [[(2.0, 2.0), (3.0, 3.0), (4.0, 2.0)]]]) and found.pop("none") == (None, None)
    assert found == {"A": ("Polygon", [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]]), "p": ("Point", [[[(1.0, 2.0)]]])}
    sizes = rows.select("name", F.size(G.polygon_edges(F.col("parts"))).alias("edges"), F.size(G.line_edges(F.col("parts"))).alias("steps"), *G.shape_box(F.col("parts"))).collect()
    assert {r.name: r.edges for r in sizes if r.name in "AM"} == {"A": 4, "M": 9} and {r.name: r.steps for r in sizes if r.name == "L"} == {"L": 3}
    assert {r.name: (r.minx, r.maxy) for r in sizes} == {"A": (0.0, 4.0), "M": (0.0, 12.0), "L": (0.0, 3.0), "p": (1.0, 2.0), "none": (None, None)}


def test_checksum_lines(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"data")
    assert [r.line for r in P.checksums(spark, str(tmp_path)).collect()] == [f"{hashlib.sha256(b'data').hexdigest()}  a.bin\n"]


def test_checksums_in_chunks(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    for name, size in (("large.bin", (2 << 30) + 5), ("in/chunk 1%20.bin", P.CHUNK), ("in/more.bin", 2 * P.CHUNK + 1), ("none.bin", 0)):
        with open(tmp_path / name, "wb") as f:
            f.write(name.encode()[:size])
            f.truncate(size)  # sparse
    expected = {}
    for path in (p for p in tmp_path.rglob("*") if p.is_file() and p.stat().st_size):  # Spark lists no empty files
        with open(path, "rb") as f:
            expected[str(path.relative_to(tmp_path))] = f"{hashlib.file_digest(f, 'sha256').hexdigest()}  {path.name}\n"
    assert {r.name: r.line for r in P.checksums(spark, str(tmp_path)).collect()} == expected
    assert {r.name: r.line for r in P.checksums(spark, str(tmp_path / "in"), whole=P.CHUNK).collect()} == {k[3:]: v for k, v in expected.items() if k.startswith("in/")}
    assert {r.name: r.line for r in P.checksums(spark, str(tmp_path / "in"), whole=0).collect()} == {k[3:]: v for k, v in expected.items() if k.startswith("in/")}


def test_publish_replaces_as_a_whole(spark, tmp_path):
    final, seen = str(tmp_path / "final"), []
    assert P.current(spark, final) is None
    for text in ("first", "second", "third"):
        built = tmp_path / f"built_{text}"
        built.mkdir()
        (built / "x").write_text(text)
        seen.append(P.publish(spark, str(built), final))
        assert P.current(spark, final) == seen[-1] and open(f"{seen[-1]}/x").read() == text
    assert [P.exists(spark, v) for v in seen] == [False, True, True]  # readers of the one before go on


def test_payload_members(spark, tmp_path):
    for name in ("map.tif", "map.tfw", "map.tif.aux.xml", "maps.tif", "grid/a.bin", "grid/b/c.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    assert [r.arcname for r in scans.payload_members(spark, str(tmp_path / "map.tif"), "data/t").collect()] == ["data/t/map.tfw", "data/t/map.tif", "data/t/map.tif.aux.xml"]
    assert [tuple(r) for r in scans.payload_members(spark, str(tmp_path / "grid"), "data/t").collect()] == [("data/t/grid/a.bin", 10), ("data/t/grid/b/c.bin", 12)]


def test_fold_is_full_case_folding(spark):
    texts = ["Straße", "ſo", "ΣΑΣ", "σας", "ﬁn", "ẞ", "İ", "ΐ", "Ꭰꭰ", "plain"]
    assert apply(spark, texts, T.fold) == [t.casefold() for t in texts]


def test_large_features_of_heavy_cells_are_not_multiplied(spark):
    """Features as large as the parts of a heavy cell are filed a few times each, and spread by hash; each pair is found once."""
    names = lambda n: tuple(f"{n}{c}" for c in ("x0", "y0", "x1", "y1"))
    a, b = names("a"), names("b")
    k = F.col("fid")
    features = spark.range(4000).select(F.col("id").alias("fid")).select("fid", *[(c + d).cast("double").alias(n) for (c, d), n in zip(((k % 50, 0), (k % 97, 0), (k % 50, 5), (k % 97, 4)), a)])
    i = F.col("stratum_id")
    strata = spark.range(25).select(F.col("id").alias("stratum_id")).select("stratum_id", *[(c + d).cast("double").alias(n) for (c, d), n in zip(((i % 5 * 10, 0), (F.floor(i / 5) * 20, 0), (i % 5 * 10, 10), (F.floor(i / 5) * 20, 20)), b)])
    tested = S.candidates(features, a, strata, b)
    assert tested.count() <= 16 * features.count()
    assert tested.select("part_x", "part_y").distinct().count() == S.SPLIT**2
    found = [(r.fid, r.stratum_id) for r in S.bbox_join(features, a, strata, b).collect()]
    wanted = {(f, s) for f in range(4000) for s in range(25) if f % 50 <= s % 5 * 10 + 10 and f % 50 + 5 >= s % 5 * 10 and f % 97 <= s // 5 * 20 + 20 and f % 97 + 4 >= s // 5 * 20}
    assert len(found) == len(set(found)) and set(found) == wanted


def test_relations_of_pairs_need_no_shuffle_and_bounded_memory(spark):
    """A pair's flags come from its own row; shapes of many edges are met in slices."""
    from zonepack.functions import noding

    def comb(dx, dy, n=1500):
        """A polygon with many teeth: its lower side is straight."""
        points = [(dx, dy), (dx + n, dy)] + [(dx + n - i, dy + 2 + i % 2) for i in range(n + 1)]
        return [(*map(float, p), *map(float, q)) for p, q in zip(points, [*points[1:], points[0]])]

    kind = "array<struct<x1: double, y1: double, x2: double, y2: double>>"
    shapes = [(0, comb(0, 0), comb(0, 0)), (1, comb(0, 0), comb(0, -10)), (2, comb(0, 0), comb(0.5, 1)), (3, None, comb(0, 0)), (4, [], comb(0, 0))]
    assert 1500 * 1500 > 8 * noding.SLICE
    found = S.polygon_relate(spark.createDataFrame(shapes, f"id long, a {kind}, b {kind}"), ["id"], "a", "b")
    assert {r.id: r.matrix for r in found.collect()} == {0: "2FFF1FFF2", 1: "FF2FF1212", 2: "212101212", 4: "FFFFFF212"}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_plan_of_the_box_join_is_small(spark):
    """Levels and heavy cells are no parts of the plan: it has each side once, so the boxes' expressions too."""
    from tests.conftest import DATA
    from zonepack.queries import QUERIES

    for name in ("multi_relate", "line_line_relate", "sp_intersects"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan()
        assert plan.collectLeaves().size() <= 8 and len(plan.toString()) < 100_000, name


def test_box_join_without_rows_on_a_side(spark):
    box = lambda n: tuple(f"{n}{i}" for i in range(4))
    frame = lambda n, rows: spark.createDataFrame(rows, f"{n} long, " + ", ".join(f"{c} double" for c in box(n)))
    for a, b in (([], [(1, 0.0, 0.0, 1.0, 1.0)]), ([(1, 0.0, 0.0, 1.0, 1.0)], []), ([], []), ([(1, None, 0.0, 1.0, 1.0)], [(1, 0.0, 0.0, 1.0, 1.0)])):
        assert S.bbox_join(frame("a", a), box("a"), frame("b", b), box("b")).collect() == []
    assert S.bbox_join(frame("a", [(1, 0.0, 0.0, 0.0, 0.0)]), box("a"), frame("b", [(2, 0.0, 0.0, 0.0, 0.0)]), box("b")).count() == 1
