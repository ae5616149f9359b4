"""keyloom: keyed tables, addressed arrays, row routing and transfer ledgers as lazy Spark DataFrames."""
