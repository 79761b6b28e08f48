"""depotlens: multi-depot stock analytics expressed as Spark DataFrame plans.

Every operator is a pure ``DataFrame -> DataFrame`` function that takes an
explicit ``as_of`` date; nothing reads the wall clock.  Sub-packages:

* ``sources``   – canonical tables (from the TPC-H style parquet), file ingest
* ``functions`` – reusable column expressions (calendar, text, numbers)
* ``operators`` – ledger, demand, expiry, stock-out, FEFO, anomaly, decisions,
                  reconciliation, invoice text, drift, training
* ``plans``     – the nightly run over all depots and the sinks it writes
* ``streaming`` – cold-chain sensor stream and request-burst sessions
"""

AS_OF_DEFAULT = "2001-08-01"
