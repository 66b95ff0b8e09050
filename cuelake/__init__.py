"""cuelake: time-segment analytics over transcripts, intervals and signals, on Spark."""
