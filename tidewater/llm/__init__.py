"""Operations of a training-data pipeline over text tables, each a DataFrame-to-DataFrame job.

``queries()`` and ``oracle_sql()`` in :mod:`tidewater.llm.registry` list the queries of this subpackage.
"""
