"""fluxgrid: N-dimensional signals, operators, solvers and samplers on Spark DataFrames."""

__version__ = "0.1.0"
