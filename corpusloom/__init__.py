"""Text-corpus and network analytics as pure functions from DataFrames to DataFrames."""
