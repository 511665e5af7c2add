"""Evidence and provenance analytics as Spark jobs.

Every operator takes DataFrames (or a mapping of them) plus plain parameters
and returns a lazy DataFrame.  Clocks are always an explicit ``as_of``.
"""
