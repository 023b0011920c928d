"""folio: scanned-page data as Spark DataFrames.

Pages, pixels, histograms, lines, outlines, words, catalogues, frames and export
events are ordinary tables; every capability is a ``Column -> Column`` function or
a ``DataFrame -> DataFrame`` transformation.
"""

__version__ = "0.1.0"
