"""Analytics over sensor frames, events and manifests, built on Spark DataFrames."""
