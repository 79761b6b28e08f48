"""Sources: canonical depot tables derived from the TPC-H style parquet, and
file ingest (CSV / JSON / parquet) with column normalisation."""
