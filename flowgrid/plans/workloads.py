"""The three main workloads, put together from operators: one plan each, with as few exchanges as its keys allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowgrid.operators import ensemble, particles, profiles, simulations, thalweg


def probability_map(cells: DataFrame, sims: DataFrame, parameters: dict, limit: float, res_type: str = "ppr") -> DataFrame:
    """Probability map of the simulations that meet the predicates: r, c, probability.

    Simulations are filtered before their cells are looked at; the one exchange of size is by cell, after partial sums.
    """
    chosen = simulations.filter_sims(sims, parameters)
    return ensemble.exceedance_probability(cells, limit, res_type, chosen, grid=cells)


def thalweg_analysis(cells: DataFrame, path: DataFrame, width: float, step: float, limit: float, nrows: int, ncols: int) -> DataFrame:
    """Per simulation, type and path: runout and release along the path, largest value, and the mean of the cross maxima.

    The grid is made once; rasters are sampled once, and both summaries read that result.
    """
    grid = thalweg.sl_grid(path, width, step)
    on = thalweg.transform_to_sl(cells, grid, nrows, ncols)
    keys = ["sim_name", "res_type", "path_id"]
    cross = thalweg.cross_section_max_mean(on, grid).groupBy(*keys).agg(F.max("v_max").alias("v_max"), F.avg("v_max").alias("cross_mean"))
    middle = grid.where(F.abs("l") < step / 2).select("path_id", "i_s", "s", "x", "y", F.lit(None).cast("double").alias("z"))
    ends = thalweg.runout(on, grid, middle, limit).select(*keys, "s_release", "s_runout", "l", "x", "y", "delta_s")
    return ends.join(cross, keys)


def particle_path(snapshots: DataFrame) -> DataFrame:
    """Per simulation the mass-averaged path: path_id, i, t, x, y, z, s, with the kinetic energy; ready for the profile models."""
    mean = particles.mass_averaged_path(snapshots, ("x", "y", "z"))
    own = Window.partitionBy("sim_name").orderBy("t")
    path = mean.select(F.col("sim_name").alias("path_id"), (F.row_number().over(own) - 1).alias("i"), "t", "x", "y", "z", "e_kin")
    return profiles.along_line_distance(path)
