"""Operations of a training-data pipeline: one module for each operator.

Nothing outside this package imports it. ``registry`` lists the queries, ``contracts`` derives
the digest columns of the query contracts from the operators' own outputs.
"""
