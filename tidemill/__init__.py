"""Walk-forward research on time-series panels, as composable Spark DataFrame operators.

NULL is the only missing value inside the engine, every ordered expression carries its own
window order, and every operator is a function from DataFrames to DataFrames.
"""
