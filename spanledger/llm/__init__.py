"""Training-data operators: thirteen table operators and the queries that apply them.

Nothing outside this folder imports it; queries are added only where it is present.
"""
