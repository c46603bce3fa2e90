"""Operators for training-data pipelines: one module for each operator.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
``opN_<name>`` and their SQL; the operators themselves keep general interfaces.
"""
