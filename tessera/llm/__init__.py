"""Training-data operators over document, embedding and benchmark tables.

Every operator is a function of DataFrames; the column names it reads are
arguments and no other column of the input is looked at, so extra columns
with clashing names do no harm.  ``queries.py`` binds the operators to the
driver tables."""
