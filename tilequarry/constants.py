"""Fixed values shared by all modules."""

# The results depend on them.
TILE_SIZE = 1024          # cells per tile edge
PAD_LENGTH = 8            # hex digits of a tile code, at least
SFC_HILBERT = "hilbert"
SFC_ZORDER = "zorder"
TARGET_EPSG = 32651       # default target of a reprojection

# Sizes that bound how much one row may hold.
POSTINGS_BLOCK_BITS = 12  # a rendered posting list covers 2^12 curve positions
REGION_SIZE = None        # edge, in map units, of the squares that pair features with grids; None: by the size of each
