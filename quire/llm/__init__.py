"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  Each module is one operator with a
general DataFrame interface; :mod:`quire.llm.queries` binds them to the test
tables.
"""
