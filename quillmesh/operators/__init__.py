"""Record-linkage operators, each a function of DataFrames."""
