"""Spoken question-answering datasets on Spark: build, join, nest and score them.

Every operator takes and returns DataFrames (or Columns), so jobs chain with
``df.transform`` and Catalyst sees one plan from scan to sink.
"""
