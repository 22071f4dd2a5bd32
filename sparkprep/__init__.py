"""sparkprep: data cleaning, profiling, exploration and modelling on Spark.

Every operation is a lazy DataFrame transformation or a ``fit``/``apply``
pair whose fitted state is a handful of small statistics.
"""

__version__ = "0.1.0"
