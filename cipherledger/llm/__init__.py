"""Operations of a training-data pipeline. Nothing outside this subpackage imports it.

Every module holds one operator with a general interface, and the thin ``opN_<name>`` query that applies it to a
whole table with production parameters. ``registry`` gathers the queries and their SQL.
"""
