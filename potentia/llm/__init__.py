"""Training-data pipeline operators: one module per operator, queries in ``queries``.

Nothing outside this sub-package imports it except the driver's entry file.
"""
