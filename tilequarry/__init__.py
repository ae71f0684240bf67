"""tilequarry: index and query large rasters together with vector features, on Spark.

Rasters are cut into fixed-size tiles and coded along a space-filling curve,
vector features are matched to tiles, their attributes become a searchable
inverted index, and queries combine keyword search, extent filtering and
polygon masking.  Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
