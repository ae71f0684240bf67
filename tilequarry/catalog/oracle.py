"""The SQL each registered query must agree with.

The SQL takes the plain route: every tile against every edge, every cell against
every region edge.  It shares no binning, tracing or rewriting with the engine.
"""

from __future__ import annotations

from tilequarry.functions import projection as prj

# --- shared views ----------------------------------------------------------------------------

CELLS = """
cells AS (
  SELECT lpad(CAST(k AS VARCHAR), 8, '0') AS dataset_uid, k,
         CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py,
         CAST(px // 8 AS INTEGER) AS col, CAST(py // 8 AS INTEGER) AS row_,
         CAST(300000 + 10 * (64 * (k % 4) + px) + 5 AS DOUBLE) AS cx,
         CAST(1500000 - 10 * (64 * (k // 4) + py) - 5 AS DOUBLE) AS cy,
         b1, b2
  FROM (SELECT o_orderkey // 4096 AS k, o_orderkey % 64 AS px, (o_orderkey % 4096) // 64 AS py,
               CASE WHEN o_orderstatus = 'P' THEN NULL
                    ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 4096 AS DOUBLE) END AS b1,
               CAST(o_custkey % 256 AS DOUBLE) AS b2
        FROM orders)
)"""

TILES = CELLS + """,
tiles AS (
  SELECT dataset_uid, col, row_, min(cx) - 5 AS xmin, max(cy) + 5 - 80 AS ymin,
         min(cx) - 5 + 80 AS xmax, max(cy) + 5 AS ymax, count(*) AS n_cells
  FROM cells GROUP BY dataset_uid, col, row_
)"""

FEATURES = """
fbase AS (
  SELECT c_custkey AS fid, CAST(300000 + 10 * ((c_custkey * 97) % 509) AS DOUBLE) AS x,
         CAST(1500000 - 10 * ((c_custkey * 61) % 257) AS DOUBLE) AS y,
         CAST(10 * (1 + c_custkey % 4) AS DOUBLE) AS r, c_custkey % 5 AS shp,
         CAST(floor(10 * (1 + c_custkey % 4) * 0.4) AS DOUBLE) AS hh,
         c_mktsegment AS seg, c_nationkey, c_acctbal
  FROM customer
),
boxes AS (
  SELECT fid, 0 AS ring, x - r AS xa, y - r AS ya, x + r AS xb, y + r AS yb FROM fbase WHERE shp IN (0, 3, 4)
  UNION ALL SELECT fid, 1, x - hh, y - hh, x + hh, y + hh FROM fbase WHERE shp = 3
  UNION ALL SELECT fid, 1, x + 120 - r, y - r, x + 120 + r, y + r FROM fbase WHERE shp = 4
),
fedges AS (
  SELECT fid, ring, xa AS x1, ya AS y1, xb AS x2, ya AS y2 FROM boxes
  UNION ALL SELECT fid, ring, xb, ya, xb, yb FROM boxes
  UNION ALL SELECT fid, ring, xb, yb, xa, yb FROM boxes
  UNION ALL SELECT fid, ring, xa, yb, xa, ya FROM boxes
  UNION ALL SELECT fid, 0, x - r, y - r, x + r, y - r FROM fbase WHERE shp = 1
  UNION ALL SELECT fid, 0, x + r, y - r, x, y + r FROM fbase WHERE shp = 1
  UNION ALL SELECT fid, 0, x, y + r, x - r, y - r FROM fbase WHERE shp = 1
  UNION ALL SELECT fid, 0, x, y - r, x + r, y FROM fbase WHERE shp = 2
  UNION ALL SELECT fid, 0, x + r, y, x, y + r FROM fbase WHERE shp = 2
  UNION ALL SELECT fid, 0, x, y + r, x - r, y FROM fbase WHERE shp = 2
  UNION ALL SELECT fid, 0, x - r, y, x, y - r FROM fbase WHERE shp = 2
),
attrs AS (
  SELECT fid, 1 AS n, 'Block_Name' AS kw, 'B' || CAST(fid % 50 AS VARCHAR) AS v FROM fbase
  UNION ALL SELECT fid, 2, 'UID', CAST(fid AS VARCHAR) FROM fbase
  UNION ALL SELECT fid, 3, 'acctbal', CAST(c_acctbal AS VARCHAR) FROM fbase WHERE fid % 7 = 0
  UNION ALL SELECT fid, 4, 'nation', CAST(c_nationkey AS VARCHAR) FROM fbase WHERE fid % 3 = 0
  UNION ALL SELECT fid, 5, 'seg_' || lower(seg), '1' FROM fbase
),
fjson AS (
  SELECT fid, '{' || string_agg('"' || kw || '":"' || v || '"', ',' ORDER BY n) || '}' AS data FROM attrs GROUP BY fid
)"""

REGIONS = """
redges AS (
  SELECT CAST(r_regionkey AS BIGINT) AS region_id, x + dx1 AS x1, y + dy1 AS y1, x + dx2 AS x2, y + dy2 AS y2
  FROM (SELECT r_regionkey, CAST(300100 + 450 * r_regionkey AS DOUBLE) AS x, CAST(1499950 AS DOUBLE) AS y FROM region),
       (VALUES (0, 0, 400, 0), (400, 0, 400, -200), (400, -200, 200, -200), (200, -200, 200, -400),
               (200, -400, 0, -400), (0, -400, 0, 0)) AS o(dx1, dy1, dx2, dy2)
),
renv AS (
  SELECT region_id, min(x1) AS qxmin, min(y1) AS qymin, max(x1) AS qxmax, max(y1) AS qymax FROM redges GROUP BY region_id
)"""


def crosses(px: str, py: str, e: str = "e") -> str:
    """The ray from (px, py) towards +x crosses edge e."""
    cross = f"(({e}.x2 - {e}.x1) * ({py} - {e}.y1) - ({px} - {e}.x1) * ({e}.y2 - {e}.y1))"
    return (f"(({e}.y1 > {py}) <> ({e}.y2 > {py}) AND "
            f"CASE WHEN {e}.y2 > {e}.y1 THEN {cross} > 0 ELSE {cross} < 0 END)")


def touches(e: str = "e", t: str = "t") -> str:
    """Edge e meets the closed rectangle t."""
    side = [f"(({e}.x2 - {e}.x1) * ({t}.{cy} - {e}.y1) - ({t}.{cx} - {e}.x1) * ({e}.y2 - {e}.y1))"
            for cx in ("xmin", "xmax") for cy in ("ymin", "ymax")]
    every = ", ".join(side)
    return (f"least({e}.x1, {e}.x2) <= {t}.xmax AND greatest({e}.x1, {e}.x2) >= {t}.xmin AND "
            f"least({e}.y1, {e}.y2) <= {t}.ymax AND greatest({e}.y1, {e}.y2) >= {t}.ymin AND "
            f"least({every}) <= 0 AND greatest({every}) >= 0")


def intersections(name: str, edges: str, fid: str) -> str:
    """View ``name``: tiles x polygons that intersect, with is_inside where no edge touches."""
    return f"""
{name}_edge AS (
  SELECT DISTINCT t.dataset_uid, t.col, t.row_, e.{fid} FROM tiles t JOIN {edges} e ON {touches()}
),
{name}_corner AS (
  SELECT DISTINCT dataset_uid, col, row_, {fid} FROM (
    SELECT t.dataset_uid, t.col, t.row_, t.px, t.py, e.{fid}
    FROM (SELECT dataset_uid, col, row_, unnest([xmin, xmax, xmin, xmax]) AS px,
                 unnest([ymin, ymin, ymax, ymax]) AS py FROM tiles) t
    JOIN {edges} e ON {crosses('t.px', 't.py')}
    GROUP BY ALL HAVING count(*) % 2 = 1)
),
{name} AS (
  SELECT *, false AS is_inside FROM {name}_edge
  UNION ALL (SELECT *, true FROM (SELECT * FROM {name}_corner EXCEPT SELECT * FROM {name}_edge))
)"""


PAIRS = TILES + "," + FEATURES + "," + intersections("pairs", "fedges", "fid")
POSTINGS = PAIRS + """,
postings AS (
  SELECT DISTINCT kw, dataset_uid, col, row_ FROM pairs JOIN attrs USING (fid)
)"""


def hilbert(source: str, key: str, x: str, y: str, bits: str) -> str:
    """Views hstep and hcode: one curve level per recursion step."""
    return f"""
hstep AS (
  SELECT {key}, CAST({bits} AS INTEGER) AS bits, CAST({bits} AS INTEGER) - 1 AS i,
         CAST({x} AS BIGINT) AS hx, CAST({y} AS BIGINT) AS hy, CAST(0 AS BIGINT) AS d
  FROM {source}
  UNION ALL
  SELECT {key}, bits, i - 1,
         CASE WHEN ry = 1 THEN hx WHEN rx = 1 THEN (1 << bits) - 1 - hy ELSE hy END,
         CASE WHEN ry = 1 THEN hy WHEN rx = 1 THEN (1 << bits) - 1 - hx ELSE hx END,
         d * 4 + xor(3 * rx, ry)
  FROM (SELECT *, (hx >> i) & 1 AS rx, (hy >> i) & 1 AS ry FROM hstep WHERE i >= 0)
),
hcode AS (SELECT {key}, d AS sfc FROM hstep WHERE i = -1)"""


CODED = """,
dsize AS (
  SELECT dataset_uid, greatest(1, CAST(ceil(log2(greatest(max(col), max(row_)) + 1)) AS INTEGER)) AS bits
  FROM tiles GROUP BY dataset_uid
),
sized AS (SELECT t.*, bits FROM tiles t JOIN dsize USING (dataset_uid)),""" + hilbert(
    "sized", "dataset_uid, col, row_", "col", "row_", "bits") + """,
hexed AS (SELECT *, lower(to_hex(sfc)) AS hex FROM hcode),
padded AS (SELECT dataset_uid, col, row_, sfc, CASE WHEN length(hex) >= 8 THEN hex ELSE lpad(hex, 8, '0') END AS tile_code
           FROM hexed),
coded AS (
  SELECT *, dataset_uid || '_' || tile_code || '_' || CAST(col AS VARCHAR) || '_' || CAST(row_ AS VARCHAR) AS stem
  FROM padded JOIN tiles USING (dataset_uid, col, row_)
)"""

DOC_POSTINGS = POSTINGS + CODED + """,
doc_postings AS (
  SELECT kw, 'json/' || stem || '.json' AS doc_path, tile_code, dataset_uid, sfc
  FROM postings JOIN coded USING (dataset_uid, col, row_)
)"""

MASK = CELLS + "," + REGIONS + f""",
mask AS (
  SELECT region_id, dataset_uid, px, py, col, row_, cx, cy, b1, b2
  FROM cells c JOIN redges e ON {crosses('c.cx', 'c.cy')}
  GROUP BY ALL HAVING count(*) % 2 = 1
)"""


def search_views(keywords: list[str], name: str = "hits") -> str:
    listed = ", ".join(f"'{k}'" for k in keywords)
    return f""",
{name} AS (
  SELECT dataset_uid, col, row_ FROM postings WHERE kw IN ({listed})
  GROUP BY ALL HAVING count(DISTINCT kw) = {len(keywords)}
)"""


def _masked_postings() -> str:
    """Postings and mask views together; cells are shared."""
    return POSTINGS + MASK[len(CELLS):]


def _sides(a: str, b: str) -> str:
    def side(e: str, px: str, py: str) -> str:
        return f"sign(({e}.x2 - {e}.x1) * ({py} - {e}.y1) - ({px} - {e}.x1) * ({e}.y2 - {e}.y1))"
    return (f"{side(a, f'{b}.x1', f'{b}.y1')} * {side(a, f'{b}.x2', f'{b}.y2')} <= 0 AND "
            f"{side(b, f'{a}.x1', f'{a}.y1')} * {side(b, f'{a}.x2', f'{a}.y2')} <= 0")


def polygon_pairs(left: str, lid: str, right: str, rid: str, extra: str = "true") -> str:
    """Views meet, left_in, right_in: edges that meet, and vertices of one inside the other."""
    boxes = ("least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND "
             "least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2)")
    return f"""
meet AS (
  SELECT DISTINCT a.{lid} AS lid, b.{rid} AS rid FROM {left} a JOIN {right} b ON {extra} AND {boxes} AND {_sides('a', 'b')}
),
left_in AS (
  SELECT DISTINCT lid, rid FROM (
    SELECT a.{lid} AS lid, b.{rid} AS rid, a.x1 AS vx, a.y1 AS vy
    FROM (SELECT DISTINCT {lid}, x1, y1 FROM {left}) a JOIN {right} b ON {extra} AND {crosses('a.x1', 'a.y1', 'b')}
    GROUP BY ALL HAVING count(*) % 2 = 1)
),
right_in AS (
  SELECT DISTINCT lid, rid FROM (
    SELECT a.{lid} AS lid, b.{rid} AS rid, b.x1 AS vx, b.y1 AS vy
    FROM {left} a JOIN (SELECT DISTINCT {rid}, x1, y1 FROM {right}) b ON {extra} AND {crosses('b.x1', 'b.y1', 'a')}
    GROUP BY ALL HAVING count(*) % 2 = 1)
),
poly_pairs AS (SELECT * FROM meet UNION SELECT * FROM left_in UNION SELECT * FROM right_in)"""


# --- projections in SQL ----------------------------------------------------------------------

def sql_to_lonlat(source: str, x: str, y: str, keep: str) -> str:
    """View geo: degrees of UTM zone 51 north coordinates."""
    k = prj.UTM_SCALE * prj.RECTIFYING_RADIUS
    xi1 = "xi" + "".join(f" - {b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(prj.BETA, 1))
    eta1 = "eta" + "".join(f" - {b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(prj.BETA, 1))
    phi = "chi" + "".join(f" + {v!r} * sin({2 * j} * chi)" for j, v in enumerate(prj.DELTA, 1))
    return f"""
g0 AS (SELECT {keep}, {x} AS gx_, {y} AS gy_ FROM {source}),
g1 AS (SELECT *, gy_ / {k!r} AS xi, (gx_ - 500000.0) / {k!r} AS eta FROM g0),
g2 AS (SELECT *, {xi1} AS xi1, {eta1} AS eta1 FROM g1),
g3 AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM g2),
geo AS (SELECT *, 123.0 + degrees(atan2(sinh(eta1), cos(xi1))) AS lon, degrees({phi}) AS lat FROM g3)"""


def sql_from_lonlat(source: str, keep: str) -> str:
    """View utm: UTM zone 51 north coordinates (ux, uy) of lon, lat."""
    k = prj.UTM_SCALE * prj.RECTIFYING_RADIUS
    e = "eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(prj.ALPHA, 1))
    n = "xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(prj.ALPHA, 1))
    c = repr(prj.CONFORMAL)
    return f"""
u1 AS (SELECT {keep}, lon, lat, sin(radians(lat)) AS sp, radians(lon - 123.0) AS dl FROM {source}),
u2 AS (SELECT *, sinh(atanh(sp) - {c} * atanh({c} * sp)) AS t FROM u1),
u3 AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM u2),
utm AS (SELECT *, 500000.0 + {k!r} * ({e}) AS ux, {k!r} * ({n}) AS uy FROM u3)"""


def rounded(expr: str, scale: str, name: str) -> str:
    return f"CAST(floor(({expr}) * {scale} + 0.5) AS BIGINT) AS {name}"


# --- the statements --------------------------------------------------------------------------

ORACLE: dict[str, str] = {}

ORACLE["scan_cells"] = f"WITH {CELLS} SELECT dataset_uid, px, py, cx, cy, b1, b2 FROM cells"
ORACLE["scan_tiles"] = f"WITH {TILES} SELECT * FROM tiles"
ORACLE["key_to_extent"] = f"WITH {TILES} SELECT dataset_uid, col, row_, xmin, ymin, xmax, ymax FROM tiles"
ORACLE["scan_features"] = f"""WITH {FEATURES}
SELECT fid, 'MultiPolygon' AS geom_type, n_rings, n_vertices, block_name, uid, n_attrs
FROM (SELECT fid, count(DISTINCT ring) AS n_rings, count(*) + count(DISTINCT ring) AS n_vertices FROM fedges GROUP BY fid)
JOIN (SELECT fid, max(CASE WHEN kw = 'Block_Name' THEN v END) AS block_name,
             CAST(max(CASE WHEN kw = 'UID' THEN v END) AS BIGINT) AS uid, count(*) AS n_attrs
      FROM attrs GROUP BY fid) USING (fid)"""

GEOM_KIND = """CASE fid % 6 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon'
  WHEN 3 THEN 'MultiPoint' WHEN 4 THEN 'MultiLineString' ELSE 'MultiPolygon' END"""
ORACLE["features_by_geom_type"] = f"""WITH {FEATURES}
SELECT fid, {GEOM_KIND} AS geom_type,
       CAST(CASE fid % 6 WHEN 0 THEN 1 WHEN 1 THEN n0 WHEN 2 THEN n0 + 1 WHEN 3 THEN n0 + 1 ELSE n END AS BIGINT) AS n_vertices
FROM (SELECT fid, count(*) FILTER (ring = 0) AS n0, count(*) AS n FROM fedges GROUP BY fid) WHERE fid % 6 <> 5"""
ORACLE["features_single_attr"] = f"""
SELECT c_custkey AS fid, {GEOM_KIND.replace('fid', 'c_custkey')} AS geom_type,
       CASE WHEN c_custkey % 7 = 0 THEN c_acctbal END AS value FROM customer"""
ORACLE["scan_tile_docs"] = f"""WITH RECURSIVE {PAIRS}{CODED}
SELECT 'json/' || stem || '.json' AS doc_path, dataset_uid, tile_code,
       count(DISTINCT fid) AS n_features, count(*) AS n_values
FROM pairs JOIN attrs USING (fid) JOIN coded USING (dataset_uid, col, row_) GROUP BY ALL"""
ORACLE["index_load_text"] = f"WITH RECURSIVE {DOC_POSTINGS} SELECT kw, doc_path, tile_code, dataset_uid FROM doc_postings"

ORACLE["tile_file_names"] = f"""WITH RECURSIVE {TILES}{CODED}
SELECT dataset_uid, col, row_, tile_code, stem || '.tif' AS file_name, 'tiles/' || stem || '.tif' AS tile_path FROM coded"""
ORACLE["index_render_text"] = f"""WITH RECURSIVE {DOC_POSTINGS}
SELECT kw, dataset_uid, sfc >> 12 AS block, count(*) AS n,
       '(' || kw || ',' || string_agg('(' || doc_path || ',' || tile_code || ',' || dataset_uid || ')', ', '
                                      ORDER BY doc_path) || ')' AS line
FROM doc_postings GROUP BY kw, dataset_uid, sfc >> 12"""
ORACLE["features_to_geojson"] = f"""WITH {FEATURES},
placed AS (
  SELECT fid, ring, o, '[' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || ']' AS p FROM (
    SELECT fid, ring, unnest([xa, xb, xb, xa, xa]) AS x1, unnest([ya, ya, yb, yb, ya]) AS y1,
           unnest([1, 2, 3, 4, 5]) AS o FROM boxes
    UNION ALL SELECT fid, 0, unnest([x - r, x + r, x, x - r]), unnest([y - r, y - r, y + r, y - r]),
                     unnest([1, 2, 3, 4]) FROM fbase WHERE shp = 1
    UNION ALL SELECT fid, 0, unnest([x, x + r, x, x - r, x]), unnest([y - r, y, y + r, y, y - r]),
                     unnest([1, 2, 3, 4, 5]) FROM fbase WHERE shp = 2)
),
texts AS (SELECT fid, ring, '[' || string_agg(p, ',' ORDER BY o) || ']' AS r FROM placed GROUP BY fid, ring),
parts AS (SELECT fid, min(ring) AS ring, '[' || string_agg(texts.r, ',' ORDER BY ring) || ']' AS part
          FROM texts JOIN fbase USING (fid) GROUP BY fid, CASE WHEN shp = 3 THEN 0 ELSE ring END)
SELECT fid, 'B' || CAST(fid % 50 AS VARCHAR) AS name,
       '{{"type":"MultiPolygon","coordinates":[' || string_agg(part, ',' ORDER BY ring) || ']}}' AS geometry, any_value(data) AS data
FROM parts JOIN fjson USING (fid) GROUP BY fid"""
ORACLE["features_flatten"] = """
SELECT c_custkey AS fid, 'MultiPolygon' AS geom_type, 'EPSG:32651' AS srs, 'B' || CAST(c_custkey % 50 AS VARCHAR) AS "Block_Name",
       c_custkey AS "UID", CASE WHEN c_custkey % 7 = 0 THEN c_acctbal END AS acctbal,
       CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS nation, 0 AS n_bad_values
FROM customer"""

ORACLE["tile_name_parse"] = f"""WITH RECURSIVE {TILES}{CODED}
SELECT stem || '.tif' AS file_name, dataset_uid, tile_code, col, row_ FROM coded"""
ORACLE["doc_path_rewrite"] = f"""WITH RECURSIVE {TILES}{CODED}
SELECT dataset_uid, col, row_,
       CASE WHEN col % 2 = 0 THEN 'file:/data/tiles' ELSE 'hdfs://host:9000/tiles' END || '/json/' || stem || '.json' AS doc_uri,
       CASE WHEN col % 2 = 0 THEN '/data/tiles' ELSE '//host:9000/tiles' END || '/json/' || stem || '.json' AS doc_path,
       CASE WHEN col % 2 = 0 THEN '/data/tiles' ELSE '//host:9000/tiles' END || '/' || stem || '.tif' AS tile_path
FROM coded"""
ORACLE["feature_envelope"] = f"""WITH {FEATURES}
SELECT fid, min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM fedges GROUP BY fid"""
ORACLE["tile_outlines"] = f"""WITH {TILES}
SELECT dataset_uid, col, row_, unnest([0, 1, 2, 3, 4]) AS vertex, unnest([xmin, xmax, xmax, xmin, xmin]) AS x,
       unnest([ymin, ymin, ymax, ymax, ymin]) AS y FROM tiles"""

ORACLE["drop_negative_keys"] = f"""WITH {TILES}
SELECT dataset_uid, CAST(col - 2 AS INTEGER) AS col, CAST(row_ - 2 AS INTEGER) AS row_
FROM tiles WHERE col >= 2 AND row_ >= 2"""
ORACLE["polygon_intersects_tile"] = f"""WITH {TILES},{REGIONS},{intersections('hits', 'redges', 'region_id')}
SELECT region_id, dataset_uid, col, row_, is_inside FROM hits"""
ORACLE["features_intersect_region"] = f"""WITH {FEATURES},{REGIONS},{polygon_pairs('fedges', 'fid', 'redges', 'region_id')}
SELECT lid AS fid, rid AS region_id FROM poly_pairs"""
ORACLE["tiles_in_extent"] = f"""WITH {TILES},{REGIONS}
SELECT region_id, dataset_uid, col, row_ FROM tiles JOIN renv
ON xmin < qxmax AND xmax > qxmin AND ymin < qymax AND ymax > qymin"""
ORACLE["filter_by_suffix"] = f"""WITH RECURSIVE {TILES}{CODED}
SELECT name FROM (SELECT stem || '.tif' AS name FROM coded UNION ALL SELECT stem || '.json' FROM coded)
WHERE name LIKE '%tif'"""
ORACLE["tag_value_search"] = f"""WITH {PAIRS},
vals AS (SELECT DISTINCT dataset_uid, col, row_, kw, v FROM pairs JOIN attrs USING (fid))
SELECT dataset_uid, col, row_ FROM vals GROUP BY ALL
HAVING bool_or(kw = 'acctbal' AND TRY_CAST(v AS DOUBLE) >= 1000) AND bool_or(kw = 'nation' AND TRY_CAST(v AS DOUBLE) < 15)
   AND bool_or(kw = 'Block_Name' AND contains(v, 'B1'))"""
ORACLE["extent_covering_keys"] = f"""WITH {TILES},{FEATURES},
lay AS (SELECT min(xmin) AS x0, max(ymax) AS y0, (max(xmax) - min(xmin)) / 80 AS nc, (max(ymax) - min(ymin)) / 80 AS nr FROM tiles),
keys AS (
  SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row_, x0 + 80 * c AS xa, x0 + 80 * (c + 1) AS xb,
         y0 - 80 * r AS yb, y0 - 80 * (r + 1) AS ya
  FROM lay, range(0, 100000) cs(c), range(0, 100000) rs(r) WHERE c < nc AND r < nr
),
env AS (SELECT fid, min(x1) AS qxa, min(y1) AS qya, max(x1) AS qxb, max(y1) AS qyb FROM fedges GROUP BY fid)
SELECT fid, col, row_ FROM env JOIN keys ON xa < qxb AND xb > qxa AND ya < qyb AND yb > qya"""

ORACLE["tile_feature_join"] = f"""WITH {PAIRS}
SELECT t.dataset_uid, t.col, t.row_, p.fid FROM tiles t LEFT JOIN pairs p USING (dataset_uid, col, row_)"""
ORACLE["tile_feature_join_inner"] = f"WITH {PAIRS} SELECT dataset_uid, col, row_, fid FROM pairs"
ORACLE["tile_metadata_docs"] = f"""WITH RECURSIVE {PAIRS}{CODED},
bodies AS (
  SELECT dataset_uid, col, row_, count(*) AS n, string_agg(data, chr(44) || chr(10) ORDER BY fid) AS body
  FROM pairs JOIN fjson USING (fid) GROUP BY ALL
)
SELECT dataset_uid, col, row_, tile_code, stem || '.tif' AS file_name, 'json/' || stem || '.json' AS doc_path,
       0 AS part, coalesce(n, 0) AS n_features,
       '{{"tile_file_name":"' || stem || '.tif","tile_code":"' || tile_code || '","tile_dataset_uid":"' || dataset_uid
         || '"}}' || chr(44) || chr(10) || coalesce(body, '{{}}') AS doc
FROM coded LEFT JOIN bodies USING (dataset_uid, col, row_)"""
ORACLE["features_on_tiles"] = f"""WITH {PAIRS}
SELECT fid, data FROM fjson WHERE fid IN (SELECT fid FROM pairs)"""
ORACLE["tiles_without_features"] = f"""WITH {PAIRS}
SELECT dataset_uid, col, row_ FROM tiles EXCEPT SELECT dataset_uid, col, row_ FROM pairs"""
ORACLE["clip_features_to_grid"] = f"WITH {PAIRS} SELECT fid, dataset_uid, col, row_ FROM pairs"
ORACLE["feature_feature_join"] = f"""WITH {FEATURES},{polygon_pairs('fedges', 'fid', 'fedges', 'fid', 'a.fid < b.fid')}
SELECT lid AS left_fid, rid AS right_fid FROM poly_pairs"""

LAYOUT = """
  SELECT dataset_uid, count(*) AS n_cells, 10.0::DOUBLE AS cell_w, 10.0::DOUBLE AS cell_h,
         min(col) AS min_col, min(row_) AS min_row, max(col) AS max_col, max(row_) AS max_row,
         300000.0 + 640 * (any_value(k) % 4) + 80 * min(col) AS xmin,
         1500000.0 - 640 * (any_value(k) // 4) - 80 * (max(row_) + 1) AS ymin,
         300000.0 + 640 * (any_value(k) % 4) + 80 * (max(col) + 1) AS xmax,
         1500000.0 - 640 * (any_value(k) // 4) - 80 * min(row_) AS ymax
  FROM cells GROUP BY dataset_uid"""
NAMED = """
  SELECT dataset_uid, count(*) AS n_tiles, min(col) AS min_col, min(row_) AS min_row, max(col) AS max_col,
         max(row_) AS max_row, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax,
         max(xmax - xmin) / 8 AS cell_w, max(ymax - ymin) / 8 AS cell_h
  FROM tiles GROUP BY dataset_uid"""
_FIELDS = ["cell_h", "cell_w", "max_col", "max_row", "min_col", "min_row", "xmax", "xmin", "ymax", "ymin"]


def _unpivot(view: str, value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT dataset_uid, '{f}' AS field, CAST({f} AS DOUBLE) AS {value} FROM {view}" for f in _FIELDS)


ORACLE["layout_metadata"] = f"WITH {CELLS} SELECT * REPLACE (CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax) FROM ({LAYOUT})"
ORACLE["layout_from_names"] = f"WITH {TILES} {NAMED}"
ORACLE["compare_layouts"] = f"""WITH {TILES}, merged AS ({LAYOUT}), rebuilt AS ({NAMED}),
l AS ({_unpivot('merged', 'left_value')}), r AS ({_unpivot('rebuilt', 'right_value')})
SELECT dataset_uid, field, left_value, right_value, left_value IS NOT DISTINCT FROM right_value AS is_equal
FROM l FULL JOIN r USING (dataset_uid, field)"""

ORACLE["features_per_tile"] = f"WITH {PAIRS} SELECT dataset_uid, col, row_, count(*) AS n_features FROM pairs GROUP BY ALL"
ORACLE["inverted_index"] = f"WITH {POSTINGS} SELECT kw, dataset_uid, col, row_ FROM postings"
ORACLE["inverted_index_counts"] = """
SELECT kw, doc, count(*) AS n FROM (
  SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS kw FROM documents)
WHERE kw <> '' GROUP BY kw, doc"""
ORACLE["tile_cut"] = f"""WITH {CELLS}
SELECT dataset_uid, col, row_, 64 AS n_cells, CAST(64 - count(b1) AS INTEGER) AS n_null,
       coalesce(sum(b1), 0.0) AS sum_b1, min(b1) AS min_b1, max(b1) AS max_b1
FROM cells GROUP BY dataset_uid, col, row_"""
ORACLE["mosaic"] = f"""WITH {CELLS}
SELECT CAST((cx - 300005) / 10 AS BIGINT) AS gx, CAST((1499995 - cy) / 10 AS BIGINT) AS gy, b1, b2,
       CAST(floor((1499995 - cy) / 80) AS BIGINT) AS band_row FROM cells"""
ORACLE["feature_stats"] = f"""WITH {FEATURES}
SELECT count(*) AS n_features, CAST(sum(nr) AS BIGINT) AS n_rings, CAST(sum(ne + nr) AS BIGINT) AS n_vertices
FROM (SELECT fid, count(DISTINCT ring) AS nr, count(*) AS ne FROM fedges GROUP BY fid)"""

ORACLE["keyword_and_search"] = f"WITH {POSTINGS}{search_views(['nation', 'seg_building', 'acctbal'])} SELECT * FROM hits"
_LENIENT = "('nation', 'seg_building', 'no_such_keyword')"
ORACLE["keyword_and_search_lenient"] = f"""WITH {POSTINGS}
SELECT dataset_uid, col, row_ FROM postings WHERE kw IN {_LENIENT} GROUP BY ALL
HAVING count(DISTINCT kw) = (SELECT count(DISTINCT kw) FROM postings WHERE kw IN {_LENIENT})"""
ORACLE["keyword_and_search_setop"] = f"WITH {POSTINGS} " + " INTERSECT ".join(
    f"SELECT dataset_uid, col, row_ FROM postings WHERE kw = '{k}'" for k in ("nation", "seg_building", "acctbal"))

ORACLE["first_query_feature"] = f"""WITH {FEATURES},
firsts AS (SELECT seg, fid FROM (SELECT seg, fid, row_number() OVER (PARTITION BY seg ORDER BY fid) AS rn FROM fbase) WHERE rn = 1)
SELECT seg, fid, min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax
FROM firsts JOIN fedges USING (fid) GROUP BY seg, fid"""
ORACLE["tiles_in_curve_order"] = f"""WITH RECURSIVE {TILES}{CODED}
SELECT dataset_uid, col, row_, sfc, row_number() OVER (PARTITION BY dataset_uid ORDER BY sfc) AS pos FROM coded"""

ORACLE["zorder_encode"] = f"""WITH {CELLS}
SELECT dataset_uid, px, py,
       CAST(list_sum(list_transform(range(0, 31), lambda i: (((px::BIGINT >> i) & 1) << (2 * i)) + (((py::BIGINT >> i) & 1) << (2 * i + 1)))) AS BIGINT) AS code
FROM cells"""
ORACLE["zorder_roundtrip"] = """
SELECT col, row_, col AS back_col, row_ AS back_row
FROM (SELECT l_orderkey * 7 % 2147483648 AS col, (l_partkey * 1009 + l_linenumber) % 2147483648 AS row_ FROM lineitem)"""
ORACLE["hilbert_encode"] = f"WITH RECURSIVE {TILES}{CODED} SELECT dataset_uid, col, row_, sfc FROM coded"
ORACLE["hilbert_roundtrip"] = f"""WITH RECURSIVE {CELLS},{hilbert('cells', 'dataset_uid, px, py', 'px', 'py', '6')}
SELECT dataset_uid, px, py, sfc AS code, CAST(px AS BIGINT) AS back_px, CAST(py AS BIGINT) AS back_py FROM hcode"""
ORACLE["tile_code_format"] = """
SELECT o_orderkey, sfc, CASE WHEN length(h) >= 8 THEN h ELSE lpad(h, 8, '0') END AS tile_code, sfc AS back
FROM (SELECT *, lower(to_hex(sfc)) AS h FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 68719476736 + o_orderkey ELSE o_orderkey END AS sfc FROM orders))"""
ORACLE["tile_snap"] = """
SELECT o_orderkey, CAST(floor(o_totalprice / 1024) AS INTEGER) AS floor_count, CAST(floor(o_totalprice / 1024) * 1024 AS INTEGER) AS floor_value,
       CAST(ceil(o_totalprice / 1024) AS INTEGER) AS ceiling_count, CAST(ceil(o_totalprice / 1024) * 1024 AS INTEGER) AS ceiling_value
FROM orders"""
ORACLE["round_half_up"] = """
SELECT o_orderkey, floor((o_orderkey - 100) / 8.0::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS r2,
       floor((o_orderkey - 100) / 8.0::DOUBLE + 0.5) AS r0,
       floor((o_orderkey * 1234567)::DOUBLE / 1000000000.0::DOUBLE * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS seconds,
       floor((o_orderkey * 1000003)::DOUBLE / 1048576.0::DOUBLE * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS mib
FROM orders"""
ORACLE["date_label"] = "SELECT event_id, strftime(ts, '%Y-%m%d-%I%M%S') AS label FROM events"
ORACLE["json_keys"] = f"""WITH {FEATURES}
SELECT 'events' AS src, event_id AS id, unnest(json_keys(props)) AS kw FROM events
UNION ALL SELECT 'customer', fid, kw FROM attrs"""

ORACLE["reproject_points"] = f"""WITH pts AS (
  SELECT o_orderkey, (300000 + 10 * (o_orderkey % 256))::DOUBLE AS x, (1500000 - 10 * (o_orderkey % 64))::DOUBLE AS y FROM orders),
{sql_to_lonlat('pts', 'x', 'y', 'o_orderkey')},{sql_from_lonlat('geo', 'o_orderkey')}
SELECT o_orderkey, {rounded('lon', '1e7', 'lon_e7')}, {rounded('lat', '1e7', 'lat_e7')},
       {rounded('ux', '1000', 'x_mm')}, {rounded('uy', '1000', 'y_mm')},
       {rounded(f'radians(lon) * {prj.SEMI_MAJOR!r}', '1000', 'mx_mm')},
       {rounded(f'ln(tan(radians(lat) / 2 + pi() / 4)) * {prj.SEMI_MAJOR!r}', '1000', 'my_mm')}
FROM utm"""
REPROJECTED = f"""{TILES},
border AS (
  SELECT dataset_uid, unnest([xmin, xmin, xmin, xmax, xmax, xmax, (xmin + xmax) / 2, (xmin + xmax) / 2]) AS bx,
         unnest([ymin, (ymin + ymax) / 2, ymax, ymin, (ymin + ymax) / 2, ymax, ymin, ymax]) AS by_ FROM tiles),
{sql_to_lonlat('border', 'bx', 'by_', 'dataset_uid')},
ext AS (
  SELECT dataset_uid, floor(min(radians(lon) * {prj.SEMI_MAJOR!r}) / 10) - 2 AS ca, ceil(max(radians(lon) * {prj.SEMI_MAJOR!r}) / 10) + 2 AS cb,
         floor(-max(ln(tan(radians(lat) / 2 + pi() / 4)) * {prj.SEMI_MAJOR!r}) / 10) - 2 AS ra,
         ceil(-min(ln(tan(radians(lat) / 2 + pi() / 4)) * {prj.SEMI_MAJOR!r}) / 10) + 2 AS rb
  FROM geo GROUP BY dataset_uid),
xs AS (SELECT dataset_uid, unnest(range(CAST(ca AS BIGINT), CAST(cb AS BIGINT))) AS gx FROM ext),
ys AS (SELECT dataset_uid, unnest(range(CAST(ra AS BIGINT), CAST(rb AS BIGINT))) AS gy FROM ext),
want AS (SELECT dataset_uid, gx, gy, degrees((gx + 0.5) * 10 / {prj.SEMI_MAJOR!r}) AS lon,
                degrees(2 * atan(exp(-(gy + 0.5) * 10 / {prj.SEMI_MAJOR!r})) - pi() / 2) AS lat FROM xs JOIN ys USING (dataset_uid)),
{sql_from_lonlat('want', 'dataset_uid, gx, gy')},
dset AS (SELECT dataset_uid, any_value(k) AS k, max(px) + 1 AS nx, max(py) + 1 AS ny FROM cells GROUP BY dataset_uid),
pos AS (SELECT dataset_uid, gx, gy, (ux - (300000 + 640 * (k % 4))) / 10 - 0.5 AS u,
               ((1500000 - 640 * (k // 4)) - uy) / 10 - 0.5 AS v, nx, ny FROM utm JOIN dset USING (dataset_uid)),
used AS (SELECT *, floor(u) AS px0, floor(v) AS py0 FROM pos
         WHERE u BETWEEN -0.5 AND nx - 0.5 AND v BETWEEN -0.5 AND ny - 0.5),
asks AS (SELECT p.dataset_uid, gx, gy, px0 + i AS px, py0 + j AS py,
                abs(1 - i - (u - px0)) * abs(1 - j - (v - py0)) AS w
         FROM used p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j)
         JOIN tiles t ON t.dataset_uid = p.dataset_uid AND t.col = floor(greatest(px0, 0) / 8)
                     AND t.row_ = floor(greatest(py0, 0) / 8)),
sums AS (SELECT a.dataset_uid, gx, gy, sum(b1 * w) AS v1, sum(w) FILTER (b1 IS NOT NULL) AS w1, sum(b2 * w) AS v2, sum(w) AS w2
         FROM asks a JOIN cells c ON c.dataset_uid = a.dataset_uid AND c.px = a.px AND c.py = a.py GROUP BY ALL),
moved AS (
SELECT dataset_uid, gx, gy, {rounded('CASE WHEN w1 > 0 THEN v1 / w1 END', '100', 'b1_e2')},
       {rounded('CASE WHEN w2 > 0 THEN v2 / w2 END', '100', 'b2_e2')} FROM sums)"""
ORACLE["reproject_raster"] = f"WITH {REPROJECTED} SELECT dataset_uid, gx, gy, b1_e2, b2_e2 FROM moved"
ORACLE["resample_bilinear"] = f"""WITH {CELLS},
near AS (
  SELECT a.dataset_uid, a.px, a.py, n.b1, n.b2,
         (CASE WHEN n.px = a.px THEN 0.75 ELSE 0.25 END)::DOUBLE * 0.5::DOUBLE AS w
  FROM cells a JOIN cells n ON n.dataset_uid = a.dataset_uid AND n.px - a.px IN (0, 1) AND n.py - a.py IN (0, 1))
SELECT dataset_uid, px, py, sum(b1 * w) / sum(w) FILTER (b1 IS NOT NULL) AS b1, sum(b2 * w) / sum(w) AS b2,
       count(b1) AS n_b1, count(b2) AS n_b2 FROM near GROUP BY ALL"""
ORACLE["mask_region"] = f"WITH {MASK} SELECT region_id, dataset_uid, px, py, b1, b2 FROM mask"
ORACLE["mask_region_tiles"] = f"""WITH {MASK}
SELECT region_id, dataset_uid, col, row_, count(b2) AS n_kept, sum(b2) AS sum_b2 FROM mask GROUP BY ALL"""
ORACLE["crop_to_region"] = f"""WITH {MASK}
SELECT region_id, c.dataset_uid, c.px, c.py, m.px IS NOT NULL AS in_region,
       CASE WHEN m.px IS NOT NULL THEN c.b1 END AS b1, CASE WHEN m.px IS NOT NULL THEN c.b2 END AS b2
FROM cells c JOIN renv ON c.cx >= qxmin AND c.cx < qxmax AND c.cy >= qymin AND c.cy < qymax
LEFT JOIN mask m USING (region_id, dataset_uid, px, py)"""

ORACLE["pipeline_tile_raster"] = f"""WITH RECURSIVE {TILES}{CODED},
sums AS (SELECT dataset_uid, col, row_, coalesce(sum(b1), 0.0) AS sum_b1, coalesce(sum(b2), 0.0) AS sum_b2 FROM cells GROUP BY ALL)
SELECT dataset_uid, col, row_, xmin, ymin, xmax, ymax, sfc, stem || '.tif' AS file_name, sum_b1, sum_b2
FROM coded JOIN sums USING (dataset_uid, col, row_)"""
ORACLE["pipeline_query_region"] = f"WITH {MASK} SELECT dataset_uid, px, py, b1, b2 FROM mask WHERE region_id = 0"
ORACLE["search_then_query"] = f"""WITH {_masked_postings()}{search_views(['nation', 'seg_building'])}
SELECT region_id, dataset_uid, px, py, b1, b2 FROM mask SEMI JOIN hits USING (dataset_uid, col, row_)"""
ORACLE["search_then_query_first"] = f"""WITH {_masked_postings()}{search_views(['UID'])}
SELECT region_id, dataset_uid, px, py, b1, b2 FROM mask SEMI JOIN hits USING (dataset_uid, col, row_) WHERE region_id = 0"""
ORACLE["pipeline_simple"] = f"""WITH {PAIRS},{REGIONS},
near AS (SELECT dataset_uid, col, row_ FROM tiles JOIN renv
         ON region_id = 0 AND xmin < qxmax AND xmax > qxmin AND ymin < qymax AND ymax > qymin)
SELECT fid, data FROM fjson WHERE fid IN (SELECT fid FROM pairs SEMI JOIN near USING (dataset_uid, col, row_))"""
ORACLE["pipeline_simple_cells"] = f"""WITH {MASK}
SELECT CAST((cx - 300005) / 10 AS BIGINT) AS gx, CAST((1499995 - cy) / 10 AS BIGINT) AS gy, b1, b2,
       CAST(floor((1499995 - cy) / 80) AS BIGINT) AS band_row FROM mask WHERE region_id = 0"""

_SUMS = "count(b2) AS n_kept, coalesce(sum(b1), 0.0) AS sum_b1, coalesce(sum(b2), 0.0) AS sum_b2"
ORACLE["query_region_tiles"] = f"""WITH {MASK}
SELECT dataset_uid, col, row_, {_SUMS} FROM mask WHERE region_id = 0 GROUP BY ALL"""
ORACLE["search_then_query_tiles"] = f"""WITH {_masked_postings()}{search_views(['nation', 'seg_building'])}
SELECT region_id, dataset_uid, col, row_, {_SUMS} FROM mask SEMI JOIN hits USING (dataset_uid, col, row_) GROUP BY ALL"""

SCENES = CELLS + """,
placed AS (
  SELECT dataset_uid, k, b1, b2, 52 * (k % 4) + k % 3 AS ox, 52 * (k // 4) + k % 2 AS oy, px, py FROM cells
),
merged AS (
  SELECT 'layer' AS dataset_uid, gx, gy, CAST(gx // 8 AS INTEGER) AS col, CAST(gy // 8 AS INTEGER) AS row_, x0, y0,
         first(b1 ORDER BY d) FILTER (b1 IS NOT NULL) AS b1, first(b2 ORDER BY d) FILTER (b2 IS NOT NULL) AS b2
  FROM (SELECT dataset_uid AS d, ox + px - (SELECT min(ox) FROM placed) AS gx, oy + py - (SELECT min(oy) FROM placed) AS gy,
               300000 + 10 * (SELECT min(ox) FROM placed) AS x0, 1500000 - 10 * (SELECT min(oy) FROM placed) AS y0, b1, b2 FROM placed)
  GROUP BY gx, gy, x0, y0
),
tiles AS (
  SELECT dataset_uid, col, row_, CAST(x0 + 80 * col AS DOUBLE) AS xmin, CAST(y0 - 80 * (row_ + 1) AS DOUBLE) AS ymin,
         CAST(x0 + 80 * (col + 1) AS DOUBLE) AS xmax, CAST(y0 - 80 * row_ AS DOUBLE) AS ymax,
         count(b2) AS n_kept, coalesce(sum(b1), 0.0) AS sum_b1, coalesce(sum(b2), 0.0) AS sum_b2
  FROM merged GROUP BY dataset_uid, col, row_, x0, y0
)"""
ORACLE["layer_from_scenes"] = f"""WITH RECURSIVE {SCENES}{CODED}
SELECT dataset_uid, col, row_, xmin, ymin, xmax, ymax, sfc, stem || '.tif' AS file_name, n_kept, sum_b1, sum_b2 FROM coded"""
ORACLE["mosaic_stored_tiles"] = f"""WITH {SCENES}
SELECT dataset_uid, col, row_, xmin, ymin, xmax, ymax, n_kept, sum_b1, sum_b2 FROM tiles"""
ORACLE["pipeline_tile_raster_reprojected"] = f"""WITH RECURSIVE {REPROJECTED},
corner AS (SELECT dataset_uid, min(gx) AS cx0, min(gy) AS cy0 FROM moved GROUP BY dataset_uid),
rtiles AS (
  SELECT dataset_uid, CAST((gx - cx0) // 8 AS INTEGER) AS col, CAST((gy - cy0) // 8 AS INTEGER) AS row_,
         CAST(10 * (any_value(cx0) + 8 * ((gx - cx0) // 8)) AS DOUBLE) AS xmin,
         CAST(10 * (any_value(cx0) + 8 * ((gx - cx0) // 8 + 1)) AS DOUBLE) AS xmax,
         CAST(-10 * (any_value(cy0) + 8 * ((gy - cy0) // 8)) AS DOUBLE) AS ymax,
         CAST(-10 * (any_value(cy0) + 8 * ((gy - cy0) // 8 + 1)) AS DOUBLE) AS ymin,
         count(b2_e2) AS n_kept, CAST(coalesce(sum(b1_e2), 0) AS BIGINT) AS sum_b1_e2, CAST(coalesce(sum(b2_e2), 0) AS BIGINT) AS sum_b2_e2
  FROM moved JOIN corner USING (dataset_uid) GROUP BY dataset_uid, (gx - cx0) // 8, (gy - cy0) // 8
){CODED.replace('tiles', 'rtiles')}
SELECT dataset_uid, col, row_, xmin, ymin, xmax, ymax, sfc, stem || '.tif' AS file_name, n_kept, sum_b1_e2, sum_b2_e2 FROM coded"""

# --- bitmaps, document lines, borders, cell types ---------------------------------------------
ORACLE["keyword_and_search_bitmap"] = ORACLE["keyword_and_search"]
ORACLE["keyword_or_search_bitmap"] = f"""WITH {POSTINGS}
SELECT DISTINCT dataset_uid, col, row_ FROM postings WHERE kw IN ('nation', 'seg_building', 'acctbal')"""
ORACLE["keyword_tile_counts"] = f"WITH {POSTINGS} SELECT kw, count(*) AS n_tiles FROM postings GROUP BY kw"
ORACLE["tile_document_lines"] = f"""WITH RECURSIVE {PAIRS}{CODED},
numbered AS (SELECT *, max(fid) OVER (PARTITION BY dataset_uid, col, row_) AS last FROM pairs)
SELECT dataset_uid, 'json/' || stem || '.json' AS doc_path,
       '{{"tile_file_name":"' || stem || '.tif","tile_code":"' || tile_code || '","tile_dataset_uid":"' || dataset_uid || '"}},' AS line
FROM coded
UNION ALL SELECT dataset_uid, 'json/' || stem || '.json', data || CASE WHEN fid = last THEN '' ELSE ',' END
FROM numbered JOIN fjson USING (fid) JOIN coded USING (dataset_uid, col, row_)
UNION ALL SELECT dataset_uid, 'json/' || stem || '.json', '{{}}' FROM coded ANTI JOIN pairs USING (dataset_uid, col, row_)"""
ORACLE["resample_bilinear_tiles"] = f"""WITH {TILES},
spread AS (
  SELECT dataset_uid, px - i AS px, py - j AS py, b1, b2, (CASE WHEN i = 0 THEN 0.75 ELSE 0.25 END)::DOUBLE * 0.5::DOUBLE AS w
  FROM cells CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j)),
moved AS (
  SELECT dataset_uid, px, py, sum(b1 * w) / sum(w) FILTER (b1 IS NOT NULL) AS b1, sum(b2 * w) / sum(w) FILTER (b2 IS NOT NULL) AS b2
  FROM spread GROUP BY ALL)
SELECT m.* FROM moved m SEMI JOIN tiles t
ON t.dataset_uid = m.dataset_uid AND t.col = floor(m.px / 8.0) AND t.row_ = floor(m.py / 8.0)
WHERE b1 IS NOT NULL OR b2 IS NOT NULL"""
ORACLE["typed_tiles"] = f"""WITH {CELLS}
SELECT 'uint16' AS cell_type, 32651 AS epsg, dataset_uid, col, row_, count(b2) AS n_kept,
       coalesce(sum(b1), 0.0) AS sum_b1, coalesce(sum(b2), 0.0) AS sum_b2 FROM cells GROUP BY ALL"""
_TYPED = """SELECT dataset_uid, 32651 AS epsg, '{}' AS cell_type, 8 AS tile_size, count(*) AS n_tiles,
  10.0::DOUBLE AS cell_w, 10.0::DOUBLE AS cell_h, min(col) AS min_col, min(row_) AS min_row, max(col) AS max_col, max(row_) AS max_row,
  min(xmin)::DOUBLE AS xmin, min(ymin)::DOUBLE AS ymin, max(xmax)::DOUBLE AS xmax, max(ymax)::DOUBLE AS ymax
  FROM tiles WHERE {} GROUP BY dataset_uid"""
_TYPED_FIELDS = "cell_h cell_type cell_w epsg max_col max_row min_col min_row tile_size xmax xmin ymax ymin".split()


def _typed_fields(source: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT dataset_uid, '{f}' AS field, CAST({f} AS VARCHAR) AS {value} FROM {source}" for f in _TYPED_FIELDS)


ORACLE["layer_metadata_typed"] = f"WITH {TILES} {_TYPED.format('uint16', 'true')}"
ORACLE["compare_typed_layers"] = f"""WITH {TILES}, a AS ({_TYPED.format('uint16', 'true')}), b AS ({_TYPED.format('int32', 'col > 0')}),
l AS ({_typed_fields('a', 'left_value')}), r AS ({_typed_fields('b', 'right_value')})
SELECT dataset_uid, field, left_value, right_value, left_value IS NOT DISTINCT FROM right_value AS is_equal
FROM l FULL JOIN r USING (dataset_uid, field)"""


# --- clipping ---------------------------------------------------------------------------------
def _share(axis: str, at_end: bool) -> str:
    """Where edge e enters (or leaves) the tile's extent along an axis, as a share of its length."""
    step = f"(e.{axis}2 - e.{axis}1)"
    near, far = (f"(t.{axis}{side} - e.{axis}1) / {step}" for side in (("max", "min") if at_end else ("min", "max")))
    within = f"e.{axis}1 BETWEEN t.{axis}min AND t.{axis}max"
    return f"CASE WHEN {step} = 0 THEN (CASE WHEN {within} THEN {'1 ELSE -1' if at_end else '0 ELSE 2'} END) WHEN {step} > 0 THEN {near} ELSE {far} END"


ORACLE["clip_paths_to_grid"] = f"""WITH {TILES},{FEATURES},
lines AS (
  SELECT e.* FROM fedges e JOIN fbase USING (fid)
  WHERE (fid % 6 = 4 OR (fid % 6 = 1 AND ring = 0))
    AND NOT (y2 < y1 AND CASE shp WHEN 1 THEN true WHEN 2 THEN x2 > x1 ELSE x1 = x2 END)),
parts AS (
  SELECT fid, dataset_uid, col, row_, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))
    * greatest(0, least(1, {_share('x', True)}, {_share('y', True)}) - greatest(0, {_share('x', False)}, {_share('y', False)})) AS part
  FROM lines e JOIN tiles t ON {touches()})
SELECT fid, dataset_uid, col, row_, CAST(floor(sum(part) * 1000 + 0.5) AS BIGINT) AS length_e3
FROM parts GROUP BY ALL HAVING length_e3 > 0"""
ORACLE["clip_metadata_all"] = ORACLE["clip_features_to_grid"]
ORACLE["clip_metadata_first"] = f"""WITH {PAIRS},{REGIONS},{polygon_pairs('fedges', 'fid', 'redges', 'region_id')}
SELECT fid, dataset_uid, col, row_ FROM pairs WHERE fid IN (SELECT lid FROM poly_pairs WHERE rid = 0)"""
