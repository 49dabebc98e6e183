"""Evidence analytics on Spark: text, logs, ledgers, code facts and the graphs between them."""
