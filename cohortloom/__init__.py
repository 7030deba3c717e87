"""Cohort analytics on PySpark: clean, align, describe, harmonise, norm, predict, cluster and test.

Every operator takes a DataFrame and returns a DataFrame (use ``df.transform``), a Column, or a small fitted
parameter set.  Work that grows with the data is Spark SQL / Spark ML; the driver only sees tables whose size is
bounded by the number of features, folds, sites or groups.
"""

__version__ = "0.1.0"
