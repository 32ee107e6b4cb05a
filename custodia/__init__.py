"""custodia: data governance on Spark.

Every operator takes DataFrames and returns a DataFrame, takes its clock
(``as_of``), run id and roles as arguments, and leaves planning to Spark.
"""
