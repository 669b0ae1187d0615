"""Path indexes of labelled directed graphs as DataFrames."""
