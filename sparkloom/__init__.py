"""sparkloom: content and catalog analytics written for Spark DataFrames."""
