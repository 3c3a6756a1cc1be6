"""DuckDB SQL used as the correctness oracle for each registered query.

These builders only produce SQL text; they are used by
``__spark_entry__.oracle_sql`` and the test-suite, never by the Spark
operators themselves."""
