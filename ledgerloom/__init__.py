"""ledgerloom: grounded retrieval over web pages and documents, built on Spark DataFrames."""
