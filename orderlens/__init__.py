"""orderlens — order analytics expressed as Spark DataFrame plans.

Every public function takes DataFrames (and plain Python parameters) and
returns a DataFrame. Nothing is collected to the driver except bounded,
single-row control values (for example the time grain of a chart).
"""

__version__ = "0.1.0"
