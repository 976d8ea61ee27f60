"""Queries over particles, mass series, routed paths and distance-time diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.operators import particles as K
from flowgrid.operators.grids import surface_normals

from .geometry import NORMALS
from .paths import ON_SL, grid
from .registry import Inputs, query, rounded

NR, NC = 40, 50
AVG = ", ".join(f"round(sum(m * {c}) / sum(m), 6) AS {c}, round(sqrt(greatest(0, sum(m * pow({c} - mu_{c}, 2)) / sum(m))), 5) AS {c}_std" for c in ("x", "y", "z", "s", "u2"))


@query(f"""WITH p AS (SELECT *, ux * ux + uy * uy + uz * uz AS u2 FROM particles), q AS (SELECT *, {", ".join(f"sum(m * {c}) OVER w / sum(m) OVER w AS mu_{c}" for c in ("x", "y", "z", "s", "u2"))} FROM p WINDOW w AS (PARTITION BY sim_name, t)) SELECT sim_name, t, {AVG}, round(0.5 * sum(m * u2), 6) AS e_kin FROM q GROUP BY 1, 2""")
def mass_averaged_path(x: Inputs) -> DataFrame:
    out = rounded(K.mass_averaged_path(x.particles), "x", "y", "z", "s", "u2", "e_kin")
    return rounded(out, *[f"{c}_std" for c in ("x", "y", "z", "s", "u2")], digits=5)


@query("SELECT sim_name, t, round(sum(m * x) / sum(m), 6) AS mean FROM particles GROUP BY 1, 2")
def weighted_mean_std(x: Inputs) -> DataFrame:
    return rounded(K.mass_averaged_path(x.particles, ("x",)).select("sim_name", "t", F.col("x").alias("mean")), "mean")


@query("WITH p AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS v FROM particles) SELECT sim_name, t, round(max(v), 6) AS v_max, round(min(v), 6) AS v_min, round(avg(v), 6) AS v_mean, round(quantile_cont(v, 0.5), 6) AS v_median, max(s) AS s_max, min(s) AS s_min FROM p GROUP BY 1, 2")
def velocity_envelope_time(x: Inputs) -> DataFrame:
    return rounded(K.velocity_envelope_time(x.particles), "v_max", "v_min", "v_mean", "v_median")


@query("WITH p AS (SELECT *, round(sqrt(ux * ux + uy * uy + uz * uz), 6) AS v FROM particles) SELECT sim_name, CAST(floor(s / 4) AS BIGINT) AS i_s, max(v) AS v_max, min(v) AS v_min, round(CAST(sum(CAST(round(v * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6, 5) AS v_mean, round(quantile_cont(v, 0.5), 5) AS v_median, round(avg(z), 5) AS z_mean FROM p GROUP BY 1, 2")
def velocity_envelope_thalweg(x: Inputs) -> DataFrame:
    return rounded(K.velocity_envelope_thalweg(x.particles, 4.0), "v_mean", "v_median", "z_mean", digits=5)


@query("WITH f AS (SELECT *, min(t) OVER (PARTITION BY sim_name, parent_id) AS t0 FROM particles), k AS (SELECT DISTINCT sim_name, parent_id FROM f WHERE t = t0 AND pow(x - 20, 2) + pow(y - 15, 2) <= 36) SELECT p.sim_name, p.parent_id, p.t, p.id, p.x, p.y FROM particles p JOIN k ON p.sim_name = k.sim_name AND p.parent_id = k.parent_id")
def track_particles(x: Inputs) -> DataFrame:
    return K.track_particles(x.particles, 20.0, 15.0, 6.0).select("sim_name", "parent_id", "t", "id", "x", "y")


@query("WITH k AS (SELECT sim_name, t, count(*) AS n, string_agg(CAST(CAST(m AS INT) AS STRING), ',' ORDER BY id) AS vals FROM particles GROUP BY 1, 2) SELECT *, n = first_value(n) OVER (PARTITION BY sim_name ORDER BY t) AS same_count FROM k")
def particle_time_arrays(x: Inputs) -> DataFrame:
    return K.particle_time_arrays(x.particles, "m").select("sim_name", "t", "n", F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), ",").alias("vals"), "same_count")


@query("WITH k AS (SELECT sim_name, t, CAST(floor(id / 16) AS BIGINT) AS chunk, string_agg(CAST(CAST(m AS INT) AS STRING), ',' ORDER BY id) AS vals FROM particles GROUP BY 1, 2, 3), n AS (SELECT *, n = first_value(n) OVER (PARTITION BY sim_name ORDER BY t) AS same_count FROM (SELECT sim_name, t, count(*) AS n FROM particles GROUP BY 1, 2) q) SELECT k.*, n.n, n.same_count FROM k JOIN n ON k.sim_name = n.sim_name AND k.t = n.t")
def particle_time_arrays_in_chunks(x: Inputs) -> DataFrame:
    out = K.particle_time_arrays(x.particles, "m", width=16)
    return out.select("sim_name", "t", "chunk", F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), ",").alias("vals"), "n", "same_count")


@query("WITH f AS (SELECT sim_name, parent_id, z AS z0, row_number() OVER (PARTITION BY sim_name, parent_id ORDER BY t, id DESC) AS n FROM particles) SELECT p.sim_name, p.t, p.id, round(CASE WHEN s > 0 THEN degrees(atan2(z0 - z, s)) ELSE 0 END, 6) AS travel_angle FROM particles p JOIN f ON p.sim_name = f.sim_name AND p.parent_id = f.parent_id AND n = 1")
def travel_angle(x: Inputs) -> DataFrame:
    return rounded(K.travel_angle(x.particles).select("sim_name", "t", "id", "travel_angle"), "travel_angle")


@query("""WITH k AS (SELECT sim_name, t, m, ux, uy, uz, CAST(floor(y) AS INT) + di AS r, CAST(floor(x) AS INT) + dj AS c, (CASE WHEN di = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dj = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM particles, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS q(di, dj)),
s AS (SELECT sim_name, t, r, c, sum(m * w) AS mass, sum(m * w * ux) AS ux, sum(m * w * uy) AS uy, sum(m * w * uz) AS uz FROM k WHERE w > 0 GROUP BY 1, 2, 3, 4), f AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) / mass AS v FROM s)
SELECT sim_name, t, r, c, round(mass, 6) AS mass, round(mass / 200, 6) AS ft, round(v, 6) AS v, round(200 * v * v, 5) AS p, round(0.5 * mass * v * v, 9) AS ke FROM f""")
def particles_to_fields(x: Inputs) -> DataFrame:
    return rounded(rounded(K.particles_to_fields(x.particles, 1.0), "mass", "ft", "v"), "p", digits=5).withColumn("ke", F.round("ke", 9))


#: Masses without short decimals, so that no sum lies between two rounded values.
LOADED = "p AS (SELECT sim_name, t, x, y, ln(2 + m) AS m, ux, uy, uz, h * ln(2 + m) / 10 AS dm_det, h * ln(2 + m) / 4 AS dm_ent, s AS travel_angle FROM particles)"


@query(f"""WITH {NORMALS}, {LOADED}, e AS (SELECT sim_name, t, x, y, m, m * ux AS ux, m * uy AS uy, m * uz AS uz, dm_det, dm_ent, 0.0 AS ms, travel_angle AS ta FROM p UNION ALL SELECT sim_name, t, x, y, 0, 0, 0, 0, 0, 0, m, 0 FROM p WHERE ux = 0 AND uy = 0 AND uz = 0),
kw AS (SELECT e.*, CAST(floor(y) AS INT) + di AS r, CAST(floor(x) AS INT) + dj AS c, (CASE WHEN di = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN dj = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM e, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS q(di, dj)),
s AS (SELECT sim_name, t, r, c, sum(m * w) AS mass, sum(dm_det * w) AS m_det, sum(dm_ent * w) AS m_ent, sum(ms * w) AS m_stop, sum(ux * w) AS ux, sum(uy * w) AS uy, sum(uz * w) AS uz, coalesce(max(ta) FILTER (WHERE r = floor(y + 0.5) AND c = floor(x + 0.5)), 0) AS ta FROM kw WHERE w > 0 GROUP BY 1, 2, 3, 4),
f AS (SELECT s.*, n.area, coalesce(ux / nullif(mass, 0), 0) AS vx, coalesce(uy / nullif(mass, 0), 0) AS vy, coalesce(uz / nullif(mass, 0), 0) AS vz, coalesce(sqrt(ux * ux + uy * uy + uz * uz) / nullif(mass, 0), 0) AS v FROM s JOIN normals n ON s.r = n.r AND s.c = n.c)
SELECT sim_name, t, r, c, round(mass, 6) AS mass, round(m_det, 6) AS m_det, round(m_ent, 6) AS m_ent, round(m_stop, 6) AS m_stop, round(mass / (area * 200), 9) AS ft, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy, round(vz, 6) + 0.0 AS vz, round(v, 6) AS v, round(200 * v * v, 5) AS p, round(0.5 * mass * v * v, 5) AS ke, ta, round((0 - m_det) / (area * 200), 9) AS ft_det, round((0 - m_ent) / (area * 100), 9) AS ft_ent, round(m_stop / (area * 200), 9) AS ft_stop FROM f""")
def all_particle_fields(x: Inputs) -> DataFrame:
    m = F.log(2 + F.col("m"))
    p = x.particles.select("sim_name", "t", "x", "y", m.alias("m"), "ux", "uy", "uz", (F.col("h") * m / 10).alias("dm_det"), (F.col("h") * m / 4).alias("dm_ent"), F.col("s").alias("travel_angle"))
    out = K.all_particle_fields(p, 1.0, area=surface_normals(x.dem, 5.0), stopped=p.where("ux = 0 and uy = 0 and uz = 0"))
    out = rounded(out, "mass", "m_det", "m_ent", "m_stop", "vx", "vy", "vz", "v").withColumns({c: F.col(c) + 0.0 for c in ("vx", "vy", "vz")})
    return rounded(rounded(out, "ft", "ft_det", "ft_ent", "ft_stop", digits=9), "p", "ke", digits=5)


@query(f"WITH k AS (SELECT sim_name, t, CAST(round_even(y, 0) AS INT) AS r, CAST(round_even(x, 0) AS INT) AS c, count(*) AS n FROM particles GROUP BY 1, 2, 3, 4) SELECT *, coalesce(sum(n) OVER (PARTITION BY sim_name, t ORDER BY r * {NC} + c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k".replace("AS before", 'AS "before"'))
def particles_per_cell(x: Inputs) -> DataFrame:
    return K.particles_per_cell(x.particles, 1.0, NC)


@query("WITH p AS (SELECT event_id AS id, CAST(event_id % 40 AS INT) AS r, CAST(event_id % 50 AS INT) AS c FROM events), n AS (SELECT r, c, count(*) AS k FROM p GROUP BY 1, 2) SELECT p.id, p.r, p.c, round(d.z / n.k, 6) AS m FROM p JOIN n ON p.r = n.r AND p.c = n.c JOIN dem d ON p.r = d.r AND p.c = d.c")
def split_cell_mass(x: Inputs) -> DataFrame:
    p = x.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 40).cast("int").alias("r"), (F.col("event_id") % 50).cast("int").alias("c"))
    return rounded(K.split_cell_mass(p, x.dem.withColumnRenamed("z", "mass")), "m")


@query("""WITH k AS (SELECT o_orderkey AS id, CAST(o_orderkey % 997 AS DOUBLE) AS altitude, CAST(1 + o_custkey % 9 AS DOUBLE) AS weight FROM orders), s AS (SELECT *, row_number() OVER (ORDER BY altitude DESC, id) AS rank, sum(weight) OVER (ORDER BY altitude DESC, id) - weight AS w, sum(weight) OVER () AS total FROM k)
SELECT id, altitude, weight, rank, CAST(least(7, floor(w / total * 8)) AS BIGINT) AS part FROM s""")
def start_balanced_chunks(x: Inputs) -> DataFrame:
    cells = x.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 997).cast("double").alias("altitude"), (1 + F.col("o_custkey") % 9).cast("double").alias("weight"))
    return K.start_balanced_chunks(cells, 8)


# ---- mass ----
@query("SELECT *, sum(detrained) OVER (PARTITION BY sim_name ORDER BY t) AS detrained_total FROM mass")
def write_mass_series(x: Inputs) -> DataFrame:
    return K.write_mass_series(x.mass)


@query("""WITH k AS (SELECT sim_name, min_by(total, t) AS first, max_by(total, t) AS last, sum(entrained) AS entrained, max(t) - min(t) AS duration FROM mass GROUP BY 1)
SELECT sim_name, first, last, entrained, round(last / first, 6) AS growth_index, round((last - first) / duration, 6) AS growth_gradient, round(((SELECT last FROM k WHERE sim_name = 'sim0') - last) * 100 / (SELECT last FROM k WHERE sim_name = 'sim0'), 6) AS difference, CASE WHEN entrained = 0 THEN abs(last - first) <= 0.0005 * first ELSE abs(last - first - entrained) <= 0.0005 * last END AS kept FROM k""".replace(" AS first", ' AS "first"').replace(" AS last,", ' AS "last",').replace("last", '"last"').replace('""last""', '"last"').replace("/ first", '/ "first"').replace("- first", '- "first"').replace(", first,", ', "first",').replace("* first", '* "first"'))
def mass_summary(x: Inputs) -> DataFrame:
    return rounded(K.mass_summary(x.mass, "sim0"), "growth_index", "growth_gradient", "difference")


@query("""WITH k AS (SELECT sim_name, t, total, coalesce(entrained / (t - lag(t) OVER w), 0) AS flow FROM mass WINDOW w AS (PARTITION BY sim_name ORDER BY t)), w AS (SELECT n.sim_name, g.t FROM (SELECT DISTINCT sim_name FROM mass) n, (SELECT DISTINCT CAST(o_custkey % 150 * 110 AS DOUBLE) AS t FROM orders) g),
a AS (SELECT w.sim_name, w.t, k.t AS ta, k.total AS va, k.flow AS fa FROM w ASOF LEFT JOIN k ON w.sim_name = k.sim_name AND w.t >= k.t), b AS (SELECT w.sim_name, w.t, k.t AS tb, k.total AS vb, k.flow AS fb FROM w ASOF LEFT JOIN k ON w.sim_name = k.sim_name AND w.t <= k.t)
SELECT a.sim_name, a.t, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR tb = ta THEN va ELSE va + (a.t - ta) / (tb - ta) * (vb - va) END, 6) AS total, round(CASE WHEN ta IS NULL THEN fb WHEN tb IS NULL OR tb = ta THEN fa ELSE fa + (a.t - ta) / (tb - ta) * (fb - fa) END, 6) AS flow FROM a JOIN b ON a.sim_name = b.sim_name AND a.t = b.t""")
def interp_to_time_grid(x: Inputs) -> DataFrame:
    return rounded(K.interp_to_time_grid(x.mass, x.orders.select((F.col("o_custkey") % 150 * 110).cast("double").alias("t")).distinct()), "total", "flow")


# ---- routing ----
@query("""WITH p AS (SELECT start_id, r, c, max(z_delta) AS z_delta, max(flux) AS flux, sum(flux) AS fs, sum(flux_dep) AS ds, max(fp_gamma) AS fa, min(fp_gamma) AS fb, max(sl_gamma) AS sa, min(sl_gamma) AS sb, max(dist) AS da, min(dist) AS db FROM visits GROUP BY 1, 2, 3)
SELECT r, c, max(z_delta) AS z_delta, max(flux) AS flux, round(sum(fs), 6) AS flux_sum, round(sum(ds), 6) AS dep_sum, max(fa) AS fp_gamma_max, min(fb) AS fp_gamma_min, max(sa) AS sl_gamma_max, min(sb) AS sl_gamma_min, max(da) AS dist_max, min(db) AS dist_min, count(*) AS n_starts, round(sum(z_delta), 5) AS z_delta_sum FROM p GROUP BY 1, 2""")
def path_visit_layers(x: Inputs) -> DataFrame:
    return rounded(rounded(K.path_visit_layers(x.visits), "flux_sum", "dep_sum"), "z_delta_sum", digits=5)


@query("SELECT a.l_orderkey AS start_id, CAST(a.l_linenumber AS BIGINT) AS node, max(CAST(b.l_partkey % 11 AS DOUBLE)) AS value FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, max(l_partkey % 11) AS l_partkey FROM lineitem GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber >= a.l_linenumber GROUP BY 1, 2")
def backtrack_max(x: Inputs) -> DataFrame:
    rows = x.lineitem.select(F.col("l_orderkey").alias("start_id"), F.col("l_linenumber").cast("long").alias("node"), (F.col("l_partkey") % 11).cast("double").alias("value")).repartition("start_id")  # once for the groups and the windows
    values = rows.groupBy("start_id", "node").agg(F.max("value").alias("value"))
    edges = values.select("start_id", F.col("node").alias("parent"), F.lead("node").over(K.Window.partitionBy("start_id").orderBy("node")).alias("child")).where("child is not null")
    return K.backtrack_max(edges, values)


@query("""WITH RECURSIVE n AS (SELECT DISTINCT l_suppkey AS start_id, CAST(l_linenumber * 1000 + l_partkey % 17 AS BIGINT) AS node, CAST((l_linenumber + 1) * 1000 + l_orderkey % 17 AS BIGINT) AS child FROM lineitem), e AS (SELECT a.start_id, a.node, a.child FROM n a SEMI JOIN n b ON a.start_id = b.start_id AND a.child = b.node),
v AS (SELECT l_suppkey AS start_id, CAST(l_linenumber * 1000 + l_partkey % 17 AS BIGINT) AS node, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2), r AS (SELECT start_id, node, node AS below FROM v UNION SELECT r.start_id, r.node, e.child FROM r JOIN e ON r.start_id = e.start_id AND r.below = e.node)
SELECT r.start_id, r.node, max(v.value) AS value FROM r JOIN v ON r.start_id = v.start_id AND r.below = v.node GROUP BY 1, 2""")
def backtrack_max_branching(x: Inputs) -> DataFrame:
    node = (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 17).cast("long")
    values = x.lineitem.groupBy(F.col("l_suppkey").alias("start_id"), node.alias("node")).agg(F.max("l_extendedprice").alias("value"))
    child = ((F.col("l_linenumber") + 1) * 1000 + F.col("l_orderkey") % 17).cast("long")
    edges = x.lineitem.select(F.col("l_suppkey").alias("start_id"), node.alias("parent"), child.alias("child"))
    return K.backtrack_max(edges, values)  # a child without a value has nothing below it


FIELDS = "f AS (SELECT sim_name, t, r, c, max(value) FILTER (WHERE res_type = 'pft') AS ft, max(value) FILTER (WHERE res_type = 'ppr') AS fm, max(value) FILTER (WHERE res_type = 'pfv') AS fv FROM cells_t GROUP BY 1, 2, 3, 4)"


@query(f"""WITH {FIELDS}, q AS (SELECT sim_name, t, CAST(f.c AS DOUBLE) AS x, CAST(f.r AS DOUBLE) AS y, z, fm AS m, fv * fv AS u2, 0.5 * fm * fv * fv AS ekin FROM f JOIN dem d ON f.r = d.r AND f.c = d.c WHERE ft > 0 AND fm IS NOT NULL AND fv IS NOT NULL),
a AS (SELECT sim_name, t, {", ".join(f"sum(m * {c}) / sum(m) AS {c}" for c in ("x", "y", "z", "u2", "ekin"))}, sum(ekin) AS e_kin FROM q GROUP BY 1, 2),
s AS (SELECT sim_name, t, x, y, sum(d) OVER (PARTITION BY sim_name ORDER BY t) AS s FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM a WINDOW w AS (PARTITION BY sim_name ORDER BY t)) k)
SELECT a.sim_name, a.t, {", ".join(f"round(a.{c}, 6) AS {c}" for c in ("x", "y", "z"))}, round(a.u2, 4) AS u2, round(a.ekin, 3) AS ekin, round(e_kin, 2) AS e_kin, round(s.s, 6) AS s FROM a JOIN s ON a.sim_name = s.sim_name AND a.t = s.t""")
def mass_averaged_path_of_fields(x: Inputs) -> DataFrame:
    part = lambda k: F.max(F.when(F.col("res_type") == k, F.col("value")))
    fields = x.cells_t.groupBy("sim_name", "t", "r", "c").agg(part("pft").alias("ft"), part("ppr").alias("fm"), part("pfv").alias("fv"))
    out = K.mass_averaged_path_of_fields(fields, x.dem).select("sim_name", "t", "x", "y", "z", F.round("u2", 4).alias("u2"), F.round("ekin", 3).alias("ekin"), F.round("e_kin", 2).alias("e_kin"), "s")
    return rounded(out, "x", "y", "z", "s")


# ---- distance and time ----
VIEW = "view AS (SELECT r, c, sqrt(pow(c - 25, 2) + pow(r - 60, 2) + pow(z - 1000, 2)) AS range, degrees(atan2(c - 25, r - 60)) AS azimuth FROM dem WHERE abs((CAST(degrees(atan2(c - 25, r - 60)) AS DOUBLE) - 180 + 180 + 720) - 360 * floor((CAST(degrees(atan2(c - 25, r - 60)) AS DOUBLE) - 180 + 180 + 720) / 360) - 180) <= 30)".replace(" AS range", ' AS "range"')


def view(x: Inputs) -> DataFrame:
    return K.radar_mask(x.dem, x.dem, (25.0, 60.0, 1000.0), 180.0, 30.0)


@query(f"""WITH {VIEW} SELECT r, c, round("range", 6) AS "range", round(azimuth, 6) AS azimuth FROM view""".replace("view", "vw"))
def radar_mask(x: Inputs) -> DataFrame:
    return rounded(view(x), "range", "azimuth")


FLOW = f"""{VIEW}, fl AS (SELECT sim_name, t, value, "range" AS g FROM cells_t k JOIN view v ON k.r = v.r AND k.c = v.c WHERE res_type = 'pfv' AND value > 30)""".replace("view", "vw")


@query(f"""WITH {FLOW}, h AS (SELECT sim_name, t, CAST(floor(g / 20 + 0.5) AS BIGINT) AS gate, max(value) AS value FROM fl WHERE abs(g - floor(g / 20 + 0.5) * 20) < 10 GROUP BY 1, 2, 3), e AS (SELECT sim_name, t, min(g) AS lo, max(g) AS hi FROM fl GROUP BY 1, 2), n AS (SELECT sim_name, t, unnest(range(CAST(ceil(lo / 20) AS BIGINT), CAST(floor(hi / 20) AS BIGINT) + 1)) AS gate FROM e)
SELECT n.sim_name, n.t, n.gate, coalesce(h.value, 0) AS value FROM n LEFT JOIN h ON n.sim_name = h.sim_name AND n.t = h.t AND n.gate = h.gate""")
def range_time(x: Inputs) -> DataFrame:
    return K.range_time(x.cells_t.where("res_type = 'pfv'"), view(x), 30.0, 20.0)[0]


CROSS_T = f"""tc AS (SELECT concat('set', CAST(CAST(substr(sim_name, 4) AS BIGINT) % 4 AS STRING)) AS sim_name, t, r, c, max(value) AS value FROM cells_t GROUP BY 1, 2, 3, 4), {ON_SL.replace("cells_peak", "tcx").split(", cor AS")[0]},
nd AS (SELECT path_id, i_s, s, CAST(round_even(y, 0) AS INT) AS r, CAST(round_even(x, 0) AS INT) AS c FROM sl), crt AS (SELECT tc.sim_name, nd.path_id, tc.t, nd.i_s, any_value(nd.s) AS s, max(value) AS v_max FROM nd JOIN tc ON nd.r = tc.r AND nd.c = tc.c GROUP BY 1, 2, 3, 4)"""


FAR = """far AS (SELECT path_id, i_s, s, d - max(CASE WHEN i_s = 10 THEN d END) OVER (PARTITION BY path_id) AS d, s - max(CASE WHEN i_s = 10 THEN s END) OVER (PARTITION BY path_id) AS flat FROM (SELECT path_id, i_s, s, sum(st) OVER (PARTITION BY path_id ORDER BY i_s) AS d FROM (SELECT path_id, i_s, s, coalesce(sqrt(pow(s - lag(s) OVER w, 2) + pow(12.5 * s - 12.5 * lag(s) OVER w, 2)), 0) AS st FROM sl WHERE i_l = 0 WINDOW w AS (PARTITION BY path_id ORDER BY i_s)) q) q)"""


def cross_in_time(x: Inputs) -> tuple[DataFrame, DataFrame]:
    g = grid(x)
    name = F.concat(F.lit("set"), (F.substring("sim_name", 4, 9).cast("long") % 4).cast("string"))
    cells = x.cells_t.groupBy(name.alias("sim_name"), "t", "r", "c").agg(F.max("value").alias("value"))
    nodes = g.select("path_id", "i_s", "area", F.rint("y").cast("int").alias("r"), F.rint("x").cast("int").alias("c"))
    mean = F.try_divide(F.sum(F.col("area") * F.col("value")), F.sum("area"))
    cross = nodes.join(cells, ["r", "c"]).groupBy("sim_name", "path_id", "t", "i_s").agg(F.max("value").alias("v_max"), mean.alias("v_mean"))
    return cross, g.where("i_l = 0").select("path_id", "i_s", "s", (900 - 12.5 * F.col("s")).alias("z"))


@query(f"WITH {CROSS_T}, {FAR}, k AS (SELECT crt.*, flat, row_number() OVER (PARTITION BY sim_name, crt.path_id, t ORDER BY crt.i_s DESC) AS n FROM crt JOIN far ON crt.path_id = far.path_id AND crt.i_s = far.i_s WHERE v_max > 60) SELECT sim_name, path_id, t, round(flat, 6) AS front FROM k WHERE n = 1")
def thalweg_time(x: Inputs) -> DataFrame:
    return rounded(K.thalweg_time(*cross_in_time(x), 60.0, 10), "front")


@query(f"WITH {CROSS_T}, {FAR}, k AS (SELECT crt.*, d, row_number() OVER (PARTITION BY sim_name, crt.path_id, t ORDER BY crt.i_s DESC) AS n FROM crt JOIN far ON crt.path_id = far.path_id AND crt.i_s = far.i_s WHERE v_max > 60) SELECT sim_name, path_id, t, round(d, 6) AS front FROM k WHERE n = 1")
def thalweg_time_parallel(x: Inputs) -> DataFrame:
    return rounded(K.thalweg_time(*cross_in_time(x), 60.0, 10, parallel=True), "front")


@query(f"WITH {CROSS_T}, {FAR}, k AS (SELECT tc.sim_name, sl.path_id, tc.t, sl.i_s, sum(sl.area * tc.value) / CASE WHEN sum(sl.area) <> 0 THEN sum(sl.area) END AS value FROM sl JOIN tc ON tc.r = round_even(sl.y, 0) AND tc.c = round_even(sl.x, 0) GROUP BY 1, 2, 3, 4) SELECT sim_name, k.path_id, t, round(d, 6) AS distance, round(value, 6) AS value FROM k JOIN far ON k.path_id = far.path_id AND k.i_s = far.i_s")
def thalweg_time_values(x: Inputs) -> DataFrame:
    return rounded(K.thalweg_time_values(*cross_in_time(x), 10, how="mean", parallel=True), "distance", "value")


@query("""WITH f AS (SELECT o_custkey AS sim_name, CAST(o_orderkey AS DOUBLE) AS t, o_totalprice / 1000 AS g FROM orders), u AS (SELECT *, row_number() OVER (PARTITION BY sim_name, round(g, 2) ORDER BY t) AS n FROM f), v AS (SELECT sim_name, t, g, abs((lead(g) OVER w - g) / (lead(t) OVER w - t)) AS velocity FROM u WHERE n = 1 WINDOW w AS (PARTITION BY sim_name ORDER BY t)),
k AS (SELECT *, coalesce(velocity > 2 * (lag(velocity) OVER w + lead(velocity) OVER w) / 2, false) AS o FROM v WHERE velocity IS NOT NULL WINDOW w AS (PARTITION BY sim_name ORDER BY t)), r AS (SELECT *, row_number() OVER (PARTITION BY sim_name ORDER BY velocity DESC, t) AS n FROM k WHERE NOT o)
SELECT sim_name, round(velocity, 6) AS velocity, g AS "range", t FROM r WHERE n = 1""")
def approach_velocity(x: Inputs) -> DataFrame:
    front = x.orders.select(F.col("o_custkey").alias("sim_name"), F.col("o_orderkey").cast("double").alias("t"), (F.col("o_totalprice") / 1000).alias("range"))
    return rounded(K.approach_velocity(front), "velocity")
