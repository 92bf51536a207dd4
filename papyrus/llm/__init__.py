"""Operators of a training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; :mod:`papyrus.llm.queries` derives the
registered ``opN_<name>`` queries from them.
"""
