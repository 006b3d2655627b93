"""quire: PDF corpora as Spark relations.

Files become rows; parsing, decoding and writing run as Arrow-batch functions over
rows; everything across objects and files is DataFrame work left to Catalyst.
"""
