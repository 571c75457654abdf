"""Set-based PySpark operators for dated financial data.

Three kinds of frame go in: a step series of levels (``rates``), daily price
bars per ticker (``prices``) and a dated article corpus (``articles``).  Every
operator takes DataFrames and returns a DataFrame; none collects data.
"""
