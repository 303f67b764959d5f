"""Training-data operators: thirteen numbered operators and the pieces they share.

Nothing else in the repository imports this subpackage; `registry` lists its
queries and their SQL.
"""
