"""sparkloom: a pretraining-data engine whose plans are Spark DataFrames."""
