"""Readers and writers of vector, ground-truth and graph files.

``register(spark)`` adds the data source ``vectorfile``; its option ``kind`` is
one of fbin, u8bin, i8bin (a header of rows and columns, then rows), fvecs,
bvecs, ivecs (each row after its length), ibin (ids and distances of nearest
neighbours), range (ragged ids) and graph (ragged neighbours). Files are read
in byte ranges by tasks, through any file system that Arrow knows.
"""

from skerry.sources.binary import VectorFile, read_header, register, write_graph, write_neighbours, write_ranges, write_vectors

__all__ = ["VectorFile", "read_header", "register", "write_graph", "write_neighbours", "write_ranges", "write_vectors"]
