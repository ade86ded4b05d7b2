"""Operators for preparing large language-model training corpora.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its queries when it is
present.  Every operator takes and returns DataFrames; intermediate tables live in the folder that
``spark.checkpoint.dir`` names.
"""
