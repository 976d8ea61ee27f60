"""Queries of the composed workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowgrid.plans import workloads as W

from .paths import CROSS, LIMIT, NC, NR, ON_SL, PEAK, STEP, WIDTH, peaks
from .registry import Inputs, query, rounded


@query("""WITH s AS (SELECT sim_name FROM sims WHERE rel_th > 0.6 AND sim_type = 'null'), own AS (SELECT c.* FROM cells c JOIN s ON c.sim_name = s.sim_name WHERE res_type = 'ppr')
SELECT g.r, g.c, round(coalesce(h.hits, 0) / CAST((SELECT count(DISTINCT sim_name) FROM own) AS DOUBLE), 6) AS probability FROM (SELECT DISTINCT r, c FROM cells) g LEFT JOIN (SELECT r, c, count(*) AS hits FROM own WHERE value > 40 GROUP BY 1, 2) h ON g.r = h.r AND g.c = h.c""")
def workload_probability_map(x: Inputs) -> DataFrame:
    return rounded(W.probability_map(x.cells, x.sims, {"rel_th": ">0.6", "sim_type": ["null"]}, 40.0), "probability")


@query(f"""WITH {PEAK}, {ON_SL}, {CROSS}, h AS (SELECT *, row_number() OVER (PARTITION BY sim_name, path_id ORDER BY i_s DESC, value DESC, i_l) AS n, min(i_s) OVER (PARTITION BY sim_name, path_id) AS i0 FROM slc WHERE value > {LIMIT}), k AS (SELECT sim_name, path_id, max(v_max) AS v_max, avg(v_max) AS cross_mean FROM crs GROUP BY 1, 2)
SELECT h.sim_name, h.res_type, h.path_id, round(b.s, 6) AS s_release, round(a.s, 6) AS s_runout, round(k.v_max, 6) AS v_max, round(cross_mean, 6) AS cross_mean FROM h JOIN sl a ON h.path_id = a.path_id AND h.i_s = a.i_s AND h.i_l = a.i_l JOIN sl b ON h.path_id = b.path_id AND h.i0 = b.i_s AND b.i_l = 0 JOIN k ON h.sim_name = k.sim_name AND h.path_id = k.path_id WHERE h.n = 1""")
def workload_thalweg_analysis(x: Inputs) -> DataFrame:
    out = W.thalweg_analysis(peaks(x), x.thal, WIDTH, STEP, LIMIT, NR, NC)
    return rounded(out.select("sim_name", "res_type", "path_id", "s_release", "s_runout", "v_max", "cross_mean"), "s_release", "s_runout", "v_max", "cross_mean")


@query("""WITH k AS (SELECT sim_name, t, sum(m * x) / sum(m) AS x, sum(m * y) / sum(m) AS y, sum(m * z) / sum(m) AS z, 0.5 * sum(m * (ux * ux + uy * uy + uz * uz)) AS e FROM particles GROUP BY 1, 2), d AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM k WINDOW w AS (PARTITION BY sim_name ORDER BY t))
SELECT sim_name AS path_id, CAST(i AS INT) AS i, t, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(e, 6) AS e_kin, round(sum(d) OVER (PARTITION BY sim_name ORDER BY i), 6) AS s FROM d""")
def workload_particle_path(x: Inputs) -> DataFrame:
    return rounded(W.particle_path(x.particles), "x", "y", "z", "e_kin", "s")
