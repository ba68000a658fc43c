"""Operators for preparing large text corpora for model training.

Nothing outside this folder imports it. Each module holds one operator; ``registry`` binds the
operators to the tables of a data folder as the ``opN_<name>`` queries.
"""
