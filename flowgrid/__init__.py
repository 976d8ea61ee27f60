"""flowgrid: PySpark jobs over ensembles of gravitational mass-flow results, as plain DataFrame -> DataFrame functions."""
