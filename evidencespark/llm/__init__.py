"""Training-data operators: each module holds one operator, queries.py registers one query per operator."""
