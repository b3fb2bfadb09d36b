"""Search and analytics over file corpora, as DataFrames."""
