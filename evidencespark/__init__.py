"""Evidence verification over DataFrames: matching, intervals, rules, merging, pages, works and quality metrics."""
