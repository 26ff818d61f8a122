"""Operators for preparing training text: ten DataFrame-in, DataFrame-out modules.

Nothing else in ``cairn`` imports this subpackage.  ``registry`` lists the
queries, ``oracles`` the SQL that states the same results where SQL can.
"""
