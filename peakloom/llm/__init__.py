"""Operators for building text corpora: scans, archives, duplicates, contamination, search, scoring and mixing.

Every operator takes and returns DataFrames and names its columns by parameter; columns that it does not use
are not read. The modules need nothing from the rest of the package.
"""
