"""Legal-entity ownership analytics as Spark DataFrame operators.

Every operator takes DataFrames (entities, relationships, reporting
exceptions, optional ``requests`` of LEIs) and returns a DataFrame, so the
same code answers one LEI, a list of LEIs or the whole registry in one job.
"""

__version__ = "0.1.0"
